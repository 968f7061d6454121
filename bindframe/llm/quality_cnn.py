"""A quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of 256 bytes, one every 128, to its end.
Filters of 8 bytes, moved by 2, are max-pooled over each chunk; the mean and the maximum
over all chunks go into one logistic unit. Scoring adds up table rows for byte pairs, in the
scan, in bounded memory. The network is fitted on a bounded sample of labelled rows (`most`
documents and `most_bytes` of text, with all their chunks); scores read whole texts and nothing else.

Defined results: null and empty texts get the score of a text of zero bytes; without labels
(or with one class) the score is the share of label 1, smoothed by one row of each class;
repeated rows are scored each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import bounded_batches, pieces, text_or_empty, to_bytes
from bindframe.llm._folds import fold, labelled

HALF = 128
WIDTH = 8
FILTERS = 16
#: Labelled documents that the fit may use.
MOST_DOCS = 2000
#: Bytes of their texts together; chunks overlap, so the driver holds about twice as many.
MOST_BYTES = 64_000_000
HELD_FOLD, FOLDS = 2, 4


def padded(raw: bytes) -> bytes:
    """Bytes with at least WIDTH zeros behind them, in whole halves of a chunk."""
    return raw + b"\0" * (WIDTH + -(len(raw) + WIDTH) % HALF)


def chunks_of(raw: bytes) -> bytes:
    """All chunks of a text, one every half, each with the bytes its last windows reach into."""
    whole = padded(raw) + b"\0" * (HALF + WIDTH)
    return b"".join(whole[i : i + 2 * HALF + WIDTH] for i in range(0, len(padded(raw)), HALF))


class ByteNetwork:
    """filters[j, byte, f] add up over a window's bytes; relu, max over a chunk; mean and max over chunks; logistic."""

    def __init__(self, seed: int = 5, prior: float = 0.5):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.bias = np.array([np.log(prior / (1 - prior))], np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.shift, self.out, self.bias]

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best filter response in each chunk, and the window that has it."""
        n = HALF
        total = np.zeros((len(chunks), n, FILTERS), np.float32)
        for j in range(WIDTH):
            total += self.filters[j][chunks[:, j : j + 2 * n : 2]]
        best = total.argmax(1)
        return np.take_along_axis(total, best[:, None, :], 1)[:, 0] + self.shift, best

    @staticmethod
    def _batches(order: np.ndarray, sizes: np.ndarray, batch: int, most: int = 2000) -> Iterator[np.ndarray]:
        """Documents in order, at most `batch` at a time and about so many chunks."""
        start = 0
        while start < len(order):
            room = int(np.searchsorted(np.cumsum(sizes[order[start : start + batch]]), most, side="right"))
            yield order[start : start + max(1, room)]
            start += max(1, room)

    def fit(self, chunks: np.ndarray, owner_sizes: np.ndarray, labels: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> ByteNetwork:
        """Adam on the logistic loss of whole documents; chunks come in the order of documents."""
        rng = np.random.default_rng(seed)
        first = np.cumsum(owner_sizes) - owner_sizes
        params = self.parameters()
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs) + rate * 0.05
            order = rng.permutation(len(labels))
            for docs in self._batches(order, owner_sizes, batch):
                sizes = owner_sizes[docs]
                rows = np.concatenate([np.arange(first[i], first[i] + owner_sizes[i]) for i in docs])
                part = chunks[rows]
                raw, best = self.pool(part)
                act = np.maximum(raw, 0)
                starts = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(act, starts) / sizes[:, None]
                top = np.maximum.reduceat(act, starts)
                z = np.concatenate([mean, top], 1) @ self.out + self.bias
                error = (1 / (1 + np.exp(-z)) - labels[docs]).astype(np.float32) / len(docs)
                g_out = np.concatenate([mean, top], 1).T @ error + decay * self.out
                g_mean, g_top = error[:, None] * self.out[:FILTERS], error[:, None] * self.out[FILTERS:]
                who = np.repeat(np.arange(len(docs)), sizes)
                is_top = act == top[who]
                g_act = (g_mean / sizes[:, None])[who] + np.where(is_top, g_top[who], 0)
                g_raw = np.where(raw > 0, g_act, 0).astype(np.float32)
                g_filters = np.zeros_like(self.filters)
                lanes = np.broadcast_to(np.arange(FILTERS), best.shape)
                for j in range(WIDTH):
                    codes = np.take_along_axis(part, 2 * best + j, 1)
                    np.add.at(g_filters[j], (codes, lanes), g_raw)
                g_filters += decay * self.filters
                step += 1
                for p, g, (m, v) in zip(params, [g_filters, g_raw.sum(0), g_out.astype(np.float32), error.sum(keepdims=True)], moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def pair_tables(self) -> np.ndarray:
        """Rows for the byte pairs at offsets 0, 2, 4, 6 of a window; a pair's code is little-endian."""
        low, high = np.arange(65536) & 255, np.arange(65536) >> 8
        return np.stack([self.filters[2 * i][low] + self.filters[2 * i + 1][high] for i in range(WIDTH // 2)])


def score_texts(raws: list[bytes], net: ByteNetwork, tables: np.ndarray, block: int = 16_384) -> np.ndarray:
    """Probabilities of whole texts."""
    full = [padded(r) for r in raws]
    codes = np.frombuffer(b"".join(full) + b"\0" * WIDTH, "<u2")
    halves = np.array([len(f) // HALF for f in full])
    ends = np.cumsum(halves)
    n = int(ends[-1]) * (HALF // 2)
    best = np.empty((int(ends[-1]), FILTERS), np.float32)
    for a in range(0, n, block):
        b = min(a + block, n)
        total = tables[0][codes[a:b]]
        for i in range(1, WIDTH // 2):
            total += tables[i][codes[a + i : b + i]]
        shaped = total.reshape(-1, HALF // 2, FILTERS)
        best[a // (HALF // 2) : b // (HALF // 2)] = shaped.max(1)
        # the last three windows of a text would reach into the next one; they start in its zeros
        last = ends[(ends > a // (HALF // 2)) & (ends <= b // (HALF // 2))] - 1 - a // (HALF // 2)
        if len(last):
            best[last + a // (HALF // 2)] = shaped[last, : HALF // 2 - WIDTH // 2 + 1].max(1)
    # a chunk is two halves; the last half of a text is followed by nothing
    nxt = np.append(np.arange(1, len(best)), len(best) - 1)
    nxt[ends - 1] = ends - 1
    act = np.maximum(np.maximum(best, best[nxt]) + net.shift, 0)
    starts = ends - halves
    pooled = np.concatenate([np.add.reduceat(act, starts) / halves[:, None], np.maximum.reduceat(act, starts)], 1)
    return 1 / (1 + np.exp(-(pooled @ net.out + net.bias[0]).astype(np.float64)))


def fit_network(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_DOCS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> ByteNetwork:
    """Fit on a bounded sample: labelled documents outside the held fold, whole, at most `most` of them and `most_bytes` of text."""
    rows = labelled(docs, labels, label, HELD_FOLD, FOLDS, most, id_col, text_col, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            cut = [chunks_of(to_bytes(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([len(c) // (2 * HALF + WIDTH) for c in cut], pa.int32()), pa.array(cut, pa.binary())], names=["label", "n", "chunks"])

    found = sorted((r["label"], r["n"], bytes(r["chunks"])) for r in rows.mapInArrow(run, "label int, n int, chunks binary").collect())
    y = np.array([r[0] > 0 for r in found], np.float32)
    net = ByteNetwork(prior=float((y.sum() + 1) / (len(y) + 2)))
    if not 0 < y.sum() < len(y):
        net.out[:] = 0
        return net
    flat = np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(-1, 2 * HALF + WIDTH)
    return net.fit(flat, np.array([r[1] for r in found]), y)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    net = fit_network(docs, labels, label, id_col=id_col, text_col=text_col, **fit_options)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_FOLD).alias("held_out"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.pair_tables()
        for part in pieces(batches, "text", 1_000_000):
            score = score_texts([to_bytes(t) for t in part.column("text").to_pylist()], sent.value, tables)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
