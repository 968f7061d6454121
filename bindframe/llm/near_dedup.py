"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct k-word shingles, kept as 64-bit hashes; documents with
equal sets are one item. Independent trees branch the items: each node takes a minwise
coordinate (and sometimes a second, 1/similarity expected), and items with the same value go
on together. Nodes that are small are compared exhaustively, larger ones branch further. Two
items of similarity s stay together over d levels with a probability q(d), q(0) = 1,
q(d+1) = s*q(d)/s0 - (1/s0 - 1)*(s*q(d))^2 at the threshold s0, so the number of trees is set by the
target recall at the depth of the join. Links are confirmed on the full sets of whole texts;
components are found by Spark from those links.

Defined results: texts without words (null, empty, blanks) have an empty set and are linked
with nothing; texts with fewer than k words have one shingle, their whole word sequence;
repeated rows give repeated rows; a row without an id is compared with nothing and kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import BROADCAST_ROWS_BY_TEXTS, Words, bounded_batches, connected_components, free_name, pieces, roomy_heap, shingle_sets, shingles, small_side, stash, text_or_empty, words_of_text
from bindframe.llm._setjoin import DEPTH, Sketcher, candidate_clusters, coordinate, digest, exact_links

COORDS, WIDTH = 64, 64

#: Bytes of text whose sets a task holds at a time.
STEP = 1_000_000


def survival(similarity: float, depth: int) -> float:
    """The probability that a pair at the threshold shares a node after so many levels of one tree."""
    q, second = 1.0, 1 / similarity - 1
    for _ in range(depth):
        q = (1 - second) * similarity * q + second * (1 - (1 - similarity * q) ** 2)
    return q


def trees_for(similarity: float, recall: float = 0.999, depth: int = DEPTH + 1) -> int:
    """Independent trees that find a pair at the threshold with that probability, at that depth: as given, the root and all branching."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return shingles(words_of_text(text), k)


def features(slim: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, id, sig, bits) of (doc_id, text)."""
    sketch = Sketcher(COORDS, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        for part in pieces(batches, "text", STEP):
            words = Words(part.column("text"))
            sets, sizes = shingle_sets(words.hashes, words.first, words.sizes, k)
            full = np.flatnonzero(sizes)
            ends = np.cumsum(sizes).tolist()
            sig, bits = sketch(sets, sizes[full])
            own: list[list[bytes | None]] = [[None] * len(sizes) for _ in range(3)]
            for i, at in enumerate(full.tolist()):
                own[0][at], own[1][at], own[2][at] = digest(sets[ends[at] - sizes[at] : ends[at]]), sig[i], bits[i]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in own)], names=["doc_id", "n_shingles", "id", "sig", "bits"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_shingles long, id binary, sig binary, bits binary")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Links documents whose sets meet 100 * intersection >= percent * union. component_id is the
    smallest id that is reachable; kept marks the row whose own id that is.
    """
    similarity = percent / 100
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    feats = stash(features(slim, k))
    items = stash(feats.where("id is not null and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")))

    trees = trees_for(similarity, recall)
    every = max(1, round(1 / (1 / similarity - 1)))  # each so many trees have two first branches
    roots = [(t, j) for t in range(trees) for j in ([2 * t, 2 * t + 1] if t % every == 0 else [2 * t])]
    first = F.array(*[F.expr(f"xxhash64({t}, {j}, {coordinate(str(j % COORDS))})") for t, j in roots])
    nodes = items.select(F.explode(first).alias("node"), "id")

    clusters = stash(candidate_clusters(items, nodes, similarity, COORDS, WIDTH))
    links = exact_links(clusters, items.select("id", "doc_id"), slim, lambda text: iter([shingle_set(text, k)]), percent)
    linked = stash(connected_components(links).join(items.select("id", "doc_id").hint("merge"), "id"))
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("low"))
    low = linked.select("id", "component").join(lowest.hint("merge"), "component").select("id", "low")
    named = items.select("id", "doc_id").join(low.hint("merge"), "id", "left").select("id", F.coalesce("low", "doc_id").alias("low"))
    out = feats.select("doc_id", "n_shingles", "id").join(named.hint("merge"), "id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("low", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: those with the smallest id of their group; rows without an id stay."""
    groups = near_dedup(docs, k, percent, recall, id_col, text_col)
    mark = free_name(docs.columns, "_gone")
    gone = stash(groups.where("not kept").select(F.col("doc_id").alias(mark)).distinct())
    return docs.join(small_side(gone, BROADCAST_ROWS_BY_TEXTS), docs[id_col] == gone[mark], "left_anti")
