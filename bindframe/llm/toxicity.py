"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector is shared by all ordered
thresholds, and the expected severity is the sum over thresholds of P(grade > k). Features
are words and beginnings of words, picked from counts over all labelled documents outside the
held fold: those whose share of toxic documents differs from the rest by more than chance allows. Grades of the
labelled rows: 0 not toxic; toxic rows are 1, or 2 where more
different words mark toxicity than in the median toxic row. The fit uses a bounded sample
of labelled rows (`most`); scoring reads every text whole.

Defined results: null and empty texts have no features, so the grade that the thresholds
alone give; without toxic labels the severity is 0; repeated rows are scored each for itself;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import bounded_batches, pieces, stash, text_or_empty, to_bytes
from bindframe.llm._folds import fold, labelled

#: Labelled documents that the fit may use, and words that may be features.
MOST_DOCS, MOST_FEATURES = 20_000, 2048
#: A word is a feature if its share of toxic documents is so many standard errors off.
LEAST_Z = 4.0
HELD_FOLD, FOLDS = 2, 4
#: Characters of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Signs cut from both ends of a word.
EDGES = b".,;:!?\"'()[]{}|#*$%&<>"


def tokens(text: str | None) -> list[bytes]:
    return [w.strip(EDGES) for w in to_bytes(text).lower().split()]


class Features(dict):
    """word -> the features it stands for: itself, and its beginnings of PREFIXES characters ('*' behind); a bounded memo."""

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        out = self[word] = (text, *(text[:k] + "*" for k in PREFIXES if k < len(text)))
        return out

    def of(self, found: list[bytes]) -> set[str]:
        out: set[str] = set()
        for word in set(found):
            out.update(self[word])
        return out


def feature_words(rows: DataFrame, most: int = MOST_FEATURES, least_z: float = LEAST_Z, flush: int = 200_000) -> dict[str, float]:
    """word -> z score of its share of toxic documents, from all rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        features = Features()

        def out() -> Iterator[pa.RecordBatch]:
            for label, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "label", "docs"])
                c.clear()

        for part in pieces(batches, "text"):
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                counts[int(label > 0)].update(features.of(tokens(text)) | {""})
            if len(counts[0]) + len(counts[1]) > flush:
                yield from out()
        yield from out()

    toxic = F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0))
    table = stash(rows.mapInArrow(run, "word string, label int, docs long").groupBy("word").agg(toxic.alias("toxic"), F.sum("docs").alias("docs")).where("docs >= 3 or word = ''"))
    whole = table.where("word = ''").first()
    if whole is None or not 0 < whole["toxic"] < whole["docs"]:
        return {}
    share = whole["toxic"] / whole["docs"]
    z = (F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * (share * (1 - share)))
    marked = table.where("word <> ''").select("word", z.alias("z")).where(F.abs("z") >= least_z)
    return {r["word"]: r["z"] for r in marked.orderBy(F.desc(F.abs("z")), "word").limit(most).collect()}


class OrdinalModel:
    """Weights by word and ordered thresholds."""

    def __init__(self, words: dict[str, float], grades: int = 3):
        self.words = {w: i for i, w in enumerate(sorted(words))}
        self.marked = {self.words[w] for w, z in words.items() if z > 0}
        self.weights = np.zeros(len(words))
        self.thresholds = np.full(grades - 1, np.inf)

    def features(self, text: str | None, memo: dict[bytes, tuple[int, ...]]) -> tuple[list[int], int]:
        """Indexes of the features in a text, and how many different words have a marking one."""
        found = tokens(text)
        if len(memo) > 300_000:
            memo.clear()
        for word in set(found):
            if word not in memo:
                memo[word] = tuple(self.words[f] for f in Features()[word] if f in self.words)
        hits = [memo[w] for w in found if memo[w]]
        own = sorted({i for h in hits for i in h})
        return own, sum(any(i in self.marked for i in h) for h in set(hits))

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - z[:, None]))

    def fit(self, rows: list[list[int]], grades: np.ndarray, rounds: int = 600, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
        """Adam on the mean negative log likelihood; thresholds stay ordered as one base and exponentiated steps."""
        n, k = len(rows), len(self.thresholds)
        sizes = np.array([len(r) for r in rows])
        row = np.repeat(np.arange(n), sizes)
        column = np.array([i for r in rows for i in r], np.int64)
        share = np.array([(np.sum(grades <= j) + 1) / (n + 2) for j in range(k)])
        start = np.log(share / (1 - share))
        theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
        params = [self.weights, theta]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, rounds + 1):
            cuts = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]), [np.inf]])
            z = np.bincount(row, self.weights[column], n)
            hi, lo = 1 / (1 + np.exp(np.clip(z - cuts[grades + 1], -50, 50))), 1 / (1 + np.exp(np.clip(z - cuts[grades], -50, 50)))
            hi, lo = np.where(grades == k, 1.0, hi), np.where(grades == 0, 0.0, lo)
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
            g_w = np.bincount(column, (d_hi - d_lo)[row], len(self.weights)) + decay * self.weights
            g_cuts = np.array([-(d_hi[grades == j].sum()) + d_lo[grades == j + 1].sum() for j in range(k)])
            g_theta = np.concatenate([[g_cuts.sum()], [np.exp(theta[i]) * g_cuts[i:].sum() for i in range(1, k)]])
            for x, g, (m, v) in zip(params, [g_w, g_theta], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.thresholds = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
        return self


def fit_ordinal(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    words = feature_words(labelled(docs, labels, label, HELD_FOLD, FOLDS, None, id_col, text_col))
    model = OrdinalModel(words)
    if not words:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for part in pieces(batches, "text"):
            found = [model.features(t, memo) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32())], names=["label", "features", "marks"])

    rows = labelled(docs, labels, label, HELD_FOLD, FOLDS, most, id_col, text_col).mapInArrow(run, "label int, features array<int>, marks int").collect()
    rows = sorted((r["label"], tuple(r["features"]), r["marks"]) for r in rows)
    y = np.array([r[0] > 0 for r in rows])
    if not 0 < y.sum() < len(y):
        return model
    marks = np.array([r[2] for r in rows])
    return model.fit([list(r[1]) for r in rows], np.where(y, np.where(marks > np.median(marks[y]), 2, 1), 0))


def severity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """(doc_id, held_out, p_toxic, p_severe, expected_severity, grade, toxic), one row per input row.

    grade is the most probable one; toxic is 1 if P(grade > 0) is at least one half.
    """
    model = fit_ordinal(docs, labels, label, id_col=id_col, text_col=text_col, **fit_options)
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_FOLD).alias("held_out"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for part in pieces(batches, "text"):
            z = np.array([model.weights[model.features(t, memo)[0]].sum() for t in part.column("text").to_pylist()])
            above = model.above(z)
            each = -np.diff(np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(above[:, 0]), pa.array(above[:, -1]), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array((above[:, 0] >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "p_toxic", "p_severe", "expected_severity", "grade", "toxic"],
            )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, p_toxic double, p_severe double, expected_severity double, grade int, toxic int")
