"""Set similarity join in bounded groups: nodes of similar sets, candidate clusters, exact links.

Items are distinct sets, named by a 128-bit digest. A *node* is a group of items that agree on
some minwise coordinates. Nodes of at most `limit` items are compared exhaustively by sketch
in one task; larger ones branch on further coordinates. What a sketch finds likely is then
verified on the full sets, and only enough verified links to keep every component whole leave
the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import BROADCAST_ROWS_BY_TEXTS, by_run, connected_components, join_wanted, minhashes, odd_numbers, small_side, spread, stash

#: Items that one task compares with each other, at most.
NODE_LIMIT = 4096

#: Items of clusters that are merged for verification, and hashes in their sets, at most.
MERGE_LIMIT, MERGE_HASHES = 512, 4_000_000

#: Levels of branching before what is still too large is compared block by block.
DEPTH = 8


def digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


class Sketcher:
    """sig: `coords` minwise values of 4 bytes, for branching; bits: the low bytes of `width` values, for estimates."""

    def __init__(self, coords: int, width: int, seed: int = 7):
        self.coords, self.width = coords, width
        self.factors = odd_numbers(max(coords, width), seed)

    def __call__(self, sets: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Of many sets, given as one run of hashes and the size of each."""
        values = minhashes(sets, sizes, self.factors)
        sig, bits = values[:, : self.coords].astype("<u4").tobytes(), (values[:, : self.width] & 0xFF).astype(np.uint8).tobytes()
        return _rows(sig, 4 * self.coords, len(sizes)), _rows(bits, self.width, len(sizes))


def _rows(raw: bytes, width: int, n: int) -> list[bytes]:
    return [raw[i * width : (i + 1) * width] for i in range(n)]


def coordinate(j: str) -> str:
    """SQL of the 4 bytes of the signature at a coordinate."""
    return f"substring(sig, cast(4 * ({j}) + 1 as int), 4)"


def branch(coords: int, similarity: float) -> Column:
    """The children of a row (node, sig): one, and often enough a second that 1/similarity are expected."""
    second = round(100 * (1 / similarity - 1))
    j1 = f"pmod(xxhash64(node, 1), {coords})"
    j2 = f"pmod(xxhash64(node, 2), {coords})"
    one = f"xxhash64(node, 1, {coordinate(j1)})"
    two = f"if(pmod(xxhash64(node, 3), 100) < {second} and {j2} <> {j1}, xxhash64(node, 2, {coordinate(j2)}), null)"
    return F.expr(f"filter(array({one}, {two}), x -> x is not null)")


def likely_clusters(members: DataFrame, similarity: float, width: int) -> DataFrame:
    """(node, id, n, bits) of bounded nodes -> (cluster, id, low, n): the parts of each node that sketches connect.

    Two items are likely if their sizes allow the similarity and their sketches agree to within
    4.5 standard deviations of it, which a true link misses about 3 times in a million.
    """
    least = width * similarity - 4.5 * (width * similarity * (1 - similarity)) ** 0.5

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        ids: list[bytes] = []
        lows: list[bytes] = []
        sizes: list[int] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(lows, pa.binary()), pa.array(sizes, pa.int64())], names=["cluster", "id", "low", "n"])
            for x in (keys, ids, lows, sizes):
                x.clear()
            return batch

        for group in groups:
            own = group.column("id").to_pylist()
            n = group.column("n").to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(own), width)
            order = np.argsort(n, kind="stable")
            own, n, bits = [own[i] for i in order], n[order], bits[order]
            # by size, so that what may be similar to an item stands right behind it
            ends = np.searchsorted(n, n / similarity + 1e-6, side="right")
            part = np.arange(len(own))
            for i in range(len(own) - 1):
                stop = int(ends[i])
                if stop <= i + 1 or part[i] == part[stop - 1] and (part[i:stop] == part[i]).all():
                    continue
                near = np.flatnonzero(np.count_nonzero(bits[i + 1 : stop] == bits[i], axis=1) >= least) + i + 1
                if len(near):
                    joined = np.unique(part[np.append(near, i)])
                    part[np.isin(part, joined)] = joined[0]
            names, counts = np.unique(part, return_counts=True)
            for name in names[counts > 1].tolist():
                found = dict(sorted((own[i], int(n[i])) for i in np.flatnonzero(part == name)))
                if len(found) > 1:
                    sizes += found.values()
                    found = list(found)
                    ids += found
                    lows += found[:1] * len(found)
                    keys += [xxhash.xxh3_64_intdigest(b"".join(found)) - (1 << 63)] * len(found)
            if len(keys) > 20_000:
                yield out()
        yield out()

    return by_run(members, "node", run, "cluster long, id binary, low binary, n long").distinct()


def candidate_clusters(items: DataFrame, nodes: DataFrame, similarity: float, coords: int, width: int, limit: int = NODE_LIMIT, depth: int = DEPTH, *, trees: int = 1) -> DataFrame:
    """(cluster, id) over items(id, n, sig, bits) and first nodes(node, id): bounded groups that hold every likely pair.

    Clusters that share items are one, so that each item goes to verification once, as long
    as together they have at most MERGE_LIMIT items; else they stay as they were found. First nodes over
    the limit branch in so many independent trees.
    """
    found = None
    for level in range(depth + 1):
        sizes = stash(nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        sized = join_wanted(nodes, sizes, "node") if level == 0 else nodes.join(small_side(sizes), "node")
        small = sized.where(F.col("size") <= limit).select("node", "id").join(items.select("id", "n", "bits").hint("merge"), "id")
        part = stash(likely_clusters(small.select("node", "id", "n", "bits"), similarity, width))
        found = part if found is None else found.unionByName(part)
        if sizes.where(F.col("size") > limit).limit(1).count() == 0:
            return _merged(found)
        big = stash(sized.where(F.col("size") > limit).select("node", "id", "size"))
        if level < depth:
            apart = big.select("node", "id")
            if level == 0 and trees > 1:
                apart = apart.select(F.explode(F.array(*[F.xxhash64("node", F.lit(t)) for t in range(trees)])).alias("node"), "id")
            nodes = stash(apart.join(items.select("id", "sig").hint("merge"), "id").select(F.explode(branch(coords, similarity)).alias("node"), "id"))
    last = likely_clusters(_blocks(big, limit).join(items.select("id", "n", "bits").hint("merge"), "id").select("node", "id", "n", "bits"), similarity, width)
    return _merged(found.unionByName(stash(last)))


def _merged(found: DataFrame, limit: int = MERGE_LIMIT) -> DataFrame:
    """Clusters that share items become one where the whole is small enough."""
    whole = stash(connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).join(found.select("id", "n").distinct().hint("merge"), "id"))
    large = stash(whole.groupBy("component").agg(F.count("*").alias("items"), F.sum("n").alias("hashes")).where((F.col("items") > limit) | (F.col("hashes") > MERGE_HASHES)).select("component"))
    side = small_side(large)
    one = whole.join(side, "component", "left_anti").select(F.xxhash64("component").alias("cluster"), "id")
    rest = found.join(whole.join(side, "component").select("id").hint("merge"), "id", "left_semi").select("cluster", "id").distinct()
    return one.unionByName(rest)


def _blocks(big: DataFrame, limit: int) -> DataFrame:
    """Nodes that do not split: every pair of blocks of half the limit becomes a node, so that every pair of items meets."""
    count = F.greatest(F.lit(1), F.ceil(F.col("size") * 4 / F.lit(limit))).cast("int")
    dealt = big.withColumn("blocks", count).withColumn("own", F.pmod(F.xxhash64("id", "node"), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id")


def exact_links(clusters: DataFrame, places: DataFrame, docs: DataFrame, sets_of: Callable[[str], Iterator[np.ndarray]], percent: int) -> DataFrame:
    """(a, b): links that hold on the full sets, enough of them to connect what is connected.

    clusters(cluster, id); places(id, doc_id): a document that holds the set; docs(doc_id, text).
    sets_of gives the sets of a text; those that are wanted are made again, in the scan.
    """
    wanted = stash(clusters.join(places.hint("merge"), "id").groupBy("doc_id").agg(F.collect_list("id").alias("ids"), F.collect_list("cluster").alias("clusters")))
    texts = join_wanted(docs, wanted, "doc_id", BROADCAST_ROWS_BY_TEXTS).select("text", "ids", "clusters")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                want: dict[bytes, list[int]] = {}
                for name, cluster in zip(row.column("ids")[0].as_py(), row.column("clusters")[0].as_py(), strict=True):
                    want.setdefault(name, []).append(cluster)
                out = []
                for items in sets_of(row.column("text")[0].as_py()):
                    name = digest(items)
                    out += [(cluster, name, items.tobytes()) for cluster in want.pop(name, ())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["cluster", "id", "items"])

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            sets = dict(zip(group.column("id").to_pylist(), group.column("items").to_pylist(), strict=True))
            a, b = links_within(list(sets), [np.frombuffer(x, np.uint64) for x in sets.values()], percent)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return by_run(texts.mapInArrow(again, "cluster long, id binary, items binary"), "cluster", run, "a binary, b binary")


def links_within(ids: list[bytes], sets: list[np.ndarray], percent: int) -> tuple[list[bytes], list[bytes]]:
    """Links (member, smallest member) of the components that exact comparison of a bounded group gives."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (sizes.sum() - both):
            return [max(ids)], [min(ids)]
        return [], []
    part = np.arange(n)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, group, counts = np.unique(values, return_inverse=True, return_counts=True)
    holders = owner[np.argsort(group, kind="stable")]
    first = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    held = np.zeros(len(counts), bool)
    for i in range(n - 1):
        own = group[ends[i] - sizes[i] : ends[i]]
        # what is not connected yet, was not compared before, and has a size that allows a link
        open_ = np.flatnonzero(part != part[i])
        open_ = open_[open_ > i]
        open_ = open_[(100 * sizes[open_] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[open_])]
        if not len(open_):
            continue
        own_counts = counts[own]
        total = np.cumsum(own_counts)
        if sizes[open_].sum() < total[-1]:
            held[own] = True
            both = np.add.reduceat(held[group[spread(ends[open_] - sizes[open_], sizes[open_])]], np.cumsum(sizes[open_]) - sizes[open_], dtype=np.int64)
            held[own] = False
        else:
            at = np.arange(total[-1]) + np.repeat(first[own] - total + own_counts, own_counts)
            both = np.bincount(holders[at], minlength=n)[open_]
        near = open_[100 * both >= percent * (sizes[open_] + sizes[i] - both)]
        joined = np.unique(part[np.append(near, i)])
        if len(joined) > 1:
            part[np.isin(part, joined)] = joined[0]
    a, b = [], []
    for name in np.unique(part).tolist():
        members = [ids[i] for i in np.flatnonzero(part == name)]
        low = min(members)
        a += [x for x in members if x != low]
        b += [low] * (len(members) - 1)
    return a, b
