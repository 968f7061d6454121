"""Repeated passages across documents by MinHash banding of paragraphs, exact checks and components.

Two kinds of paragraphs cover every text. The first are a line of at least `min_words` words, and a stretch
of shorter lines without a blank line that has as many together; equal shingle sets are one
item. Each item is dealt to `bands` buckets of `rows` minwise values each. At similarity s a pair shares a
bucket with probability 1 - (1 - s^rows)^bands: 0.9997 at 0.8 with 8 bands of 2. Buckets over the
limit branch in as many trees as find a pair in them with 0.999 at full depth. Paragraphs
that collide are compared in bounded groups, verified by exact Jaccard similarity on the full
sets, and joined to components. Of each component the first paragraph (by document id, then
line) stays, and the others are removals.

The second are all windows of min_words words, over lines or within them, which overlap. Their
bucket is the minwise hash of their k-word shingles: one band of one row finds every pair of equal
windows. Windows that follow each other in one bucket are a stretch, so buckets are dealt by
stretch; equal stretches are settled by one hash, and the single windows are compared where a
bucket has different stretches. So every run of min_words words or more that occurs again is found.

Defined results: null and empty texts have no paragraphs; a line is taken whole, however
long; of a text that repeats itself word by word the first min_words words of the period stay; repeated rows of one id count as one document; rows without an id are left alone; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindframe.llm._common import BROADCAST_ROWS_BY_TEXTS, Words, bounded_batches, connected_components, free_name, likely_in, pieces, roomy_heap, run_hashes, shingle_hashes, shingle_sets, sliding_min, small_side, spread, stash, text_or_empty, to_bytes
from bindframe.llm._setjoin import DEPTH, Sketcher, candidate_clusters, digest, exact_links
from bindframe.llm.near_dedup import STEP, trees_for

BANDS, ROWS, WIDTH = 8, 2, 64


def paragraphs(words: Words, min_words: int) -> np.ndarray:
    """Rows (text, line number, lines, first word in its text, words) of each long line and each stretch of short ones."""
    out: list[tuple[int, int, int, int, int]] = []
    owner, number = words.owners(), words.lines()
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(owner)))
    at = begin - words.first[owner[begin]]
    text, line, first, lines, held = -1, 0, 0, 0, 0
    for row in zip(owner[begin].tolist(), number[begin].tolist(), at.tolist(), counts.tolist(), strict=True):
        if held and (row[3] >= min_words or row[0] != text or row[1] != line + lines):
            if held >= min_words:
                out.append((text, line, lines, first, held))
            held = 0
        if row[3] >= min_words:
            out.append((row[0], row[1], 1, row[2], row[3]))
        elif held:
            lines, held = lines + 1, held + row[3]
        else:
            text, line, first, held = row
            lines = 1
    if held >= min_words:
        out.append((text, line, lines, first, held))
    return np.array(out, np.int64).reshape(-1, 5)


def paragraph_sets(text: str | None, k: int, min_words: int) -> Iterator[np.ndarray]:
    """The shingle set of each paragraph of a text."""
    words = Words(pa.array([to_bytes(text)], pa.large_binary()).view(pa.large_string()))
    found = paragraphs(words, min_words)
    sets, sizes = shingle_sets(words.hashes, found[:, 3], found[:, 4], k)
    ends = np.cumsum(sizes)
    return (sets[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True))


def stretches(words: Words, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minwise hash) of the windows of min_words words that follow each other in one bucket."""
    n = len(words.hashes) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each = shingle_hashes(words.hashes, k)
    least = sliding_min(each, min_words - k + 1)
    fits = np.arange(n) + min_words <= np.repeat(words.first + words.sizes, words.sizes)[:n]
    # where the least shingle leaves and an equal one stays, another stretch begins
    same = fits[1:] & fits[:-1] & (least[1:] == least[:-1]) & (each[: n - 1] != least[1:])
    first = np.flatnonzero(fits & ~np.append(False, same))
    last = np.flatnonzero(fits & ~np.append(same, False))
    return first, last, least[first]


def paragraph_features(slim: DataFrame, k: int, min_words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, paragraph, lines, start, n_words, n, id, sig, bits) of (doc_id, text)."""
    sketch = Sketcher(bands * rows, WIDTH, seed=11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        for part in pieces(batches, "text", STEP):
            words = Words(part.column("text"))
            found = paragraphs(words, min_words)
            sets, sizes = shingle_sets(words.hashes, words.first[found[:, 0]] + found[:, 3], found[:, 4], k)
            ends = np.cumsum(sizes).tolist()
            names = [digest(sets[end - size : end]) for end, size in zip(ends, sizes.tolist(), strict=True)]
            numbers = [pa.array(found[:, i].astype(np.int32)) for i in range(1, 5)]
            sketches = [pa.array(x, pa.binary()) for x in (names, *sketch(sets, sizes))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(found[:, 0])), *numbers, pa.array(sizes, pa.int64()), *sketches], names=["doc_id", "paragraph", "lines", "start", "n_words", "n", "id", "sig", "bits"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, paragraph int, lines int, start int, n_words int, n long, id binary, sig binary, bits binary")


def bucket_trees(similarity: float, recall: float = 0.999) -> int:
    """Trees in which a bucket over the limit branches, for that recall within it at the full depth."""
    return trees_for(similarity, recall, DEPTH)


def repeated_paragraphs(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 50, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, n_words, kept_doc_id, kept_paragraph, removed, lines, start): what occurs again, with the one that stays.

    `paragraph` is the number of the (first) line, from 0, and `start` of the first word in the document. `lines`
    is the number of lines, null for a passage, which is the words from start on; those in removed paragraphs are not listed again.
    What stays is listed too, as kept by itself and not removed.
    """
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).where("doc_id is not null")
    feats = stash(paragraph_features(slim, k, min_words, bands, rows))
    items = stash(feats.groupBy("id").agg(F.min(F.struct("doc_id", "paragraph")).alias("place"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")))
    width = 4 * rows
    keys = F.array(*[F.expr(f"xxhash64({b}, substring(sig, {b * width + 1}, {width}))") for b in range(bands)])
    nodes = items.select(F.explode(keys).alias("node"), "id")
    clusters = stash(candidate_clusters(items, nodes, percent / 100, bands * rows, WIDTH, trees=bucket_trees(percent / 100)))
    places = items.select("id", F.col("place.doc_id").alias("doc_id"))
    links = exact_links(clusters, places, slim, lambda text: paragraph_sets(text, k, min_words), percent)
    linked = stash(connected_components(links).join(items.select("id", "place").hint("merge"), "id"))
    first = linked.groupBy("component").agg(F.min("place").alias("first"))
    linked = linked.select("id", "component").join(first.hint("merge"), "component").select("id", "first")
    named = items.join(linked.hint("merge"), "id", "left").where("copies > 1 or first is not null").select("id", F.coalesce("first", "place").alias("keeper"))
    out = feats.select("doc_id", "paragraph", "n_words", "id", "lines", "start").join(named.hint("merge"), "id")
    removed = (F.struct("doc_id", "paragraph") != F.col("keeper")).alias("removed")
    out = stash(out.select("doc_id", "paragraph", "n_words", F.col("keeper.doc_id").alias("kept_doc_id"), F.col("keeper.paragraph").alias("kept_paragraph"), removed, "lines", "start"))
    gone = out.where("removed").select(F.col("doc_id").alias("_id"), F.col("start").alias("_from"), (F.col("start") + F.col("n_words")).alias("_to"))
    runs = stash(repeated_passages(slim, k, min_words))
    none = F.lit(None).cast("int").alias("lines")
    kept = runs.groupBy("kept_doc_id", "kept_start", "kept_line").agg(F.max(F.col("end") - F.col("start")).alias("n_words"))
    kept = kept.select(F.col("kept_doc_id").alias("doc_id"), F.col("kept_line").alias("paragraph"), "n_words", "kept_doc_id", F.col("kept_line").alias("kept_paragraph"), F.lit(False).alias("removed"), none, F.col("kept_start").alias("start"))
    runs = runs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("start") >= F.col("_from")) & (F.col("end") <= F.col("_to")), "left_anti")
    runs = runs.select("doc_id", F.col("line").alias("paragraph"), (F.col("end") - F.col("start")).alias("n_words"), "kept_doc_id", F.col("kept_line").alias("kept_paragraph"), F.lit(True).alias("removed"), none, "start")
    return out.unionByName(runs).unionByName(kept)


def repeated_passages(slim: DataFrame, k: int, min_words: int) -> DataFrame:
    """(doc_id, start, end, line, kept_doc_id, kept_start, kept_line): runs of min_words words or more that equal an earlier run."""
    kind = slim.schema["doc_id"].dataType.simpleString()

    def hashed(begin: np.ndarray, end: np.ndarray, words: Words) -> pa.Array:
        return pa.array(run_hashes(words.hashes, begin, end, 32).view(np.int64))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        for part in pieces(batches, "text", STEP):
            words = Words(part.column("text"))
            begin, last, seed = stretches(words, k, min_words)
            own = words.owners()[begin]
            places = [pa.array((x - words.first[own]).astype(np.int32)) for x in (begin, last)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own)), *places, pa.array(words.lines()[begin].astype(np.int32)), pa.array(seed.view(np.int64)), hashed(begin, last + min_words, words)], names=["doc_id", "start", "last", "line", "seed", "h"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        for part in pieces(batches, "text", STEP):
            words = Words(part.column("text"))
            ranges = part.column("ranges")
            own = np.repeat(np.arange(len(ranges)), ranges.value_lengths().to_numpy(zero_copy_only=False))
            low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) + words.first[own] for x in ranges.flatten().flatten())
            at = np.unique(spread(low, high - low + 1))
            at = at[at + min_words <= len(words.hashes)]
            own = words.owners()[at]
            # another row of the same id may be shorter
            fits = at + min_words <= (words.first + words.sizes)[own]
            at, own = at[fits], own[fits]
            least = sliding_min(shingle_hashes(words.hashes, k), min_words - k + 1)[at]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own)), pa.array((at - words.first[own]).astype(np.int32)), pa.array(words.lines()[at].astype(np.int32)), pa.array(least.view(np.int64)), hashed(at, at + min_words, words)], names=["doc_id", "start", "line", "seed", "h"])

    def again(rows: DataFrame, last: str) -> DataFrame:
        """Rows that equal an earlier one of the same hashes; what overlaps the kept words of its own document stays."""
        found = rows.groupBy("seed", "h").agg(F.min(F.struct("doc_id", "start", "line")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("seed", "h", "kept")
        later = rows.join(found.hint("merge"), ["seed", "h"]).where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("start") != F.col("kept.start")))
        overlap = F.when(F.col("doc_id") == F.col("kept.doc_id"), F.greatest(F.lit(0), F.col("kept.start") + min_words - F.col("start"))).otherwise(0)
        return later.select("doc_id", (F.col("start") + overlap).cast("int").alias("start"), (F.expr(last) + min_words).cast("int").alias("end"), "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), F.col("kept.line").alias("kept_line")).where("start < end")

    def repeated(rows: DataFrame) -> DataFrame:
        """Rows whose hash occurs again: counted by the hash alone, so that single rows are not moved whole."""
        twice = stash(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        return stash(likely_in(rows, twice, "h").join(twice.hint("merge"), "h", "left_semi"))

    every = stash(slim.mapInArrow(first, f"doc_id {kind}, start int, last int, line int, seed long, h long"))
    # buckets with more than one stretch; mixed ones hold different stretches
    full = every.groupBy("seed").agg(F.count("*").alias("n"), (F.min("h") < F.max("h")).alias("mixed")).where("n > 1").select("seed", "mixed")
    seeds = stash(every.join(full.hint("merge"), "seed"))
    copies = again(seeds, "last")
    reps = seeds.where("mixed").groupBy("seed", "h").agg(F.min(F.struct("doc_id", "start", "last")).alias("place"))
    wanted = stash(reps.groupBy("place.doc_id").agg(F.collect_list(F.struct("place.start", "place.last")).alias("ranges")))
    # only texts that are wanted move, and they do at every size
    windows = stash(likely_in(slim, wanted, "doc_id").join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "ranges").mapInArrow(single, f"doc_id {kind}, start int, line int, seed long, h long"))
    parts = copies.unionByName(again(repeated(windows), "start"))
    own = Window.partitionBy("doc_id", "kept_doc_id").orderBy("start", "end")
    parts = parts.withColumn("before", F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("part", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(own))
    place = F.min(F.struct("start", "line", "kept_start", "kept_line"))
    whole = parts.groupBy("doc_id", "kept_doc_id", "part").agg(place.alias("at"), F.max("end").alias("end"))
    return whole.select("doc_id", F.col("at.start").alias("start"), "end", F.col("at.line").alias("line"), "kept_doc_id", F.col("at.kept_start").alias("kept_start"), F.col("at.kept_line").alias("kept_line"))


_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def without(text: str | None, lines: list[int] | None, spans: list[tuple[int, int]] | None) -> str | None:
    """The text without these lines and without the words of these spans; a line that loses all its words goes."""
    if text is None or not (lines or spans):
        return text
    gone, drop = set(lines or ()), set()
    for start, end in spans or ():
        drop.update(range(start, end))
    out, at = [], 0
    for number, line in enumerate(to_bytes(text).split(b"\n")):
        found = list(_WORD.finditer(line))
        kept = [i for i in range(len(found)) if at + i not in drop]
        at += len(found)
        if number in gone or found and not kept:
            continue
        if len(kept) < len(found):
            ends = [m.start() for m in found[1:]] + [len(line)]
            line = line[: found[0].start()] + b"".join(line[found[i].start() : ends[i]] for i in kept)
        out.append(line)
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the paragraphs and passages that repeat an earlier one; documents with no word left go."""
    found = repeated_paragraphs(docs, k, percent, min_words, id_col=id_col, text_col=text_col).where("removed")
    lines = F.flatten(F.collect_list(F.when(F.col("lines").isNotNull(), F.sequence(F.col("paragraph"), F.col("paragraph") + F.col("lines") - 1))))
    spans = F.collect_list(F.when(F.col("lines").isNull(), F.array(F.col("start"), F.col("start") + F.col("n_words"))))
    mark = free_name(docs.columns, "_gone")
    gone = found.groupBy("doc_id").agg(lines.alias("lines"), spans.alias("spans")).select(F.col("doc_id").alias(f"{mark}id"), F.struct("lines", "spans").alias(mark))
    joined = docs.join(small_side(stash(gone), BROADCAST_ROWS_BY_TEXTS), F.col(id_col) == F.col(f"{mark}id"), "left")
    text = F.udf(without, "string", useArrow=True)(F.col(text_col), F.col(f"{mark}.lines"), F.col(f"{mark}.spans"))
    left = F.col(mark).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return joined.withColumn(text_col, F.when(F.col(mark).isNull(), F.col(text_col)).otherwise(text)).where(left).select(*[F.col(f"`{c}`") for c in docs.columns])
