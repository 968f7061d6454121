"""What several text operators share: shared storage, word hashing, runs of rows, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast; larger sides are joined by shuffle. Beside whole
#: texts more rows are worth it (still within the bytes), since a shuffle would move the texts.
BROADCAST_ROWS, BROADCAST_ROWS_BY_TEXTS, BROADCAST_BYTES = 2_000, 400_000, 24_000_000

#: Bytes of text that one numpy step holds at a time.
STEP_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of its own is made in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes: 48 a value, the length of texts and blobs, 32 an element of arrays."""
    total: Column = F.lit(0)
    for field in df.schema:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        total = total + F.coalesce(F.octet_length(column) + 16 if kind in ("string", "binary") else F.size(column) * 32 + 16 if kind == "array" else F.lit(48), F.lit(16))
    return total


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df is measured to have at most so many rows and bytes."""
    counted = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return counted[0] <= rows and counted[1] <= most


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else one for a sorted join: alike at every size."""
    return F.broadcast(df) if is_small(df, rows, most) else df.hint("merge")


#: Bits for a key, and bits in all at most (16 MB), of the filter that is sent to the tasks by `likely_in`.
FILTER_BITS, FILTER_MOST, FILTER_BLOCK = 16, 1 << 27, 1 << 16


def likely_in(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose value of a column is in keys(column), and few others: what a join with keys has to move.

    A bitmap of the keys' hashes goes to the tasks. It has at most FILTER_MOST bits: with more keys it lets more
    rows through, and never loses one, so the join afterwards gives the same.
    """
    spark = df.sparkSession
    bits = max(FILTER_BLOCK, min(FILTER_MOST, 1 << (FILTER_BITS * keys.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    places = keys.select(at(column).alias("at")).withColumn("block", F.floor(F.col("at") / FILTER_BLOCK).cast("long"))

    def blocks(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            own = np.zeros(FILTER_BLOCK, bool)
            own[group.column("at").to_numpy() % FILTER_BLOCK] = True
            yield pa.RecordBatch.from_arrays([group.column("block").slice(0, 1), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["block", "bits"])

    table = np.zeros(bits // 8, np.uint8)
    for r in by_run(places, "block", blocks, "block long, bits binary").toLocalIterator():
        start = r["block"] * (FILTER_BLOCK // 8)
        table[start : start + FILTER_BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = spark.sparkContext.broadcast(table)

    def known(places: pd.Series) -> pd.Series:
        n = places.to_numpy()
        return pd.Series((sent.value[n >> 3] >> (7 - (n & 7)).astype(np.uint8)) & 1 == 1)

    return df.where(F.pandas_udf(known, "boolean")(at(column)))


def join_wanted(df: DataFrame, wanted: DataFrame, column: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with wanted on a column: a small side is broadcast, else only rows that are likely wanted move."""
    if is_small(wanted, rows):
        return df.join(F.broadcast(wanted), column)
    return likely_in(df, wanted, column).join(wanted.hint("merge"), column)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column has it (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def roomy_heap() -> None:
    """Let this process keep what it frees: a large array once freed raises the size from which arrays are mapped anew."""
    np.ones(31 << 20, np.uint8)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: Bytes that Spark puts into one batch of rows on its way to a Python worker, at most (one row at least).
BATCH_BYTES = 2_000_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session now hands rows to Python in batches of at most BATCH_BYTES; a lower setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, "2147483646").rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give memory that this Python worker has freed back to the system, as the worker waits for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def pieces(batches: Iterable[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `step` bytes of the text column each, one row at least."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64, len(texts) + 1 + texts.offset)[texts.offset :]) if len(texts) else np.zeros(0, np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > step:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=64)
def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=3)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = int(odd_numbers(1, seed)[0])
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run values[begin:end], from running sums of values times powers."""
    up, down = _powers(1 << max(18, int(len(values)).bit_length()), seed)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text whose words are hashed at a time.
HASH_BYTES = 250_000


def _data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins (one more entry than texts)."""
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(buffers[1], kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of many texts as arrays: their hashes (A-Z lower-cased) in order, and how many each text has.

    sizes: words of each text; first: the place of each text's first word; hashes: 64 bits a word.
    """

    def __init__(self, texts: pa.Array):
        data, at = _data(texts)
        self.data, self.at = data, at
        word = ~_BLANK[data]
        inner = word.copy()
        inner[1:] &= word[:-1]
        inner[at[:-1][at[:-1] < len(data)]] = False
        self.starts = np.flatnonzero(word & ~inner)
        inner = word.copy()
        inner[:-1] &= word[1:]
        inner[at[1:][at[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~inner) + 1
        edges = np.searchsorted(self.starts, at)
        self.first, self.sizes = edges[:-1], np.diff(edges)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + HASH_BYTES, side="right")))
            low, high = self.starts[i], self.ends[j - 1]
            if high - low > HASH_BYTES:  # one very long word
                self.hashes[i] = xxhash.xxh3_64_intdigest(_LOWER[data[low:high]].tobytes())
            else:
                self.hashes[i:j] = run_hashes(_LOWER[data[low:high]].astype(np.uint64) + np.uint64(1), self.starts[i:j] - low, self.ends[i:j] - low, 21)
            i = j

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def lines(self) -> np.ndarray:
        """The number of each word's line in its text, from 0."""
        breaks = np.flatnonzero(self.data == 10)
        return np.searchsorted(breaks, self.starts) - np.repeat(np.searchsorted(breaks, self.at[:-1]), self.sizes)


def words_of_text(text: str | None) -> np.ndarray:
    """The hashes of the words of one text."""
    return Words(pa.array([to_bytes(text)], pa.large_binary()).view(pa.large_string())).hashes


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = odd_numbers(k, 1000 + k)
    total = words[:n] * factors[0]
    for i in range(1, k):
        total += words[i : n + i] * factors[i]
    return mix(total)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one; none without words."""
    return np.unique(shingle_hashes(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of many runs of words: all their sorted distinct hashes in order, and the size of each set."""
    flat = shingle_hashes(words, k)
    counts = np.maximum(sizes - k + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    values = flat[spread(first, counts)]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        own = [shingle_hashes(words[first[i] : first[i] + sizes[i]], int(sizes[i])) for i in short]
        values, owner = np.concatenate([values, *own]), np.concatenate([owner, short])
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(sizes))


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (counts[0] of them), first[1], .."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first - ends + counts, counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by minima over runs of doubled length."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def minhashes(sets: np.ndarray, sizes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each set (a run of `sizes` hashes, none empty) and factor."""
    out = np.empty((len(sizes), len(factors)), np.uint32)
    if len(sizes):
        first = np.cumsum(sizes) - sizes
        for j, factor in enumerate(factors):
            out[:, j] = np.minimum.reduceat(sets * factor, first) >> np.uint64(32)
    return out


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with the same int64 key as one batch each; a run may go over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if last is not None and keys[a] != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield _joined(held)
    release()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_run(df: DataFrame, key: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over the bounded groups of an int64 key: rows are dealt by the key, sorted in place, and read run by run."""
    n = int(bounded_batches(df).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(lambda it: fn(runs(it, key)), schema)


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """links(a, b) of any ordered type -> (id, component): the smallest id that each id reaches.

    Alternates the large-star and small-star steps until all edges are stars around a smallest
    id; each round is written to the shared folder. Ids without a link to another id have no row.
    """

    def with_low(edges: DataFrame, count: int) -> DataFrame:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        return edges.join(F.broadcast(low) if count <= BROADCAST_ROWS else low.hint("merge"), "a")

    def state(edges: DataFrame) -> tuple[int, int]:
        """How many edges there are, and how many ids keep them from being stars: with two smaller ids, or with one and larger ones."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        each = ends.groupBy("id").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        return tuple(each.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first())

    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count, loose = state(edges)
    for _ in range(rounds):
        if not loose:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours (b > a) move to the smallest of a's neighbourhood
        large = with_low(both, 2 * count).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # small star: a and its smaller neighbours move to the smallest of them
        small = with_low(large, 2 * count).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stash(small.select("e.a", "e.b").where("a <> b").distinct())
        count, loose = state(edges)
    if loose:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())
