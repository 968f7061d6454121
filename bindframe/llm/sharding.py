"""Sharding by extendible hashing.

A directory maps prefixes of a 60-bit key hash to shards. It starts with one bucket; only a
bucket over the byte limit is split on the next bit, until each fits. Bytes are summed once
for each cell (a prefix of `cell_bits` bits, about 64 cells a shard), so the directory is
made from cell sums and no text is moved; cells over the limit by themselves are resolved
further down in the next round, from the rows of those cells alone.

Defined results: a null text has 0 bytes; rows with equal keys (a null key is a key) share
all bits and so a shard, which is marked `oversize` if it is over the limit and cannot be
split; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import small_side, stash

#: Bits of the hash; the directory is never deeper.
HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\\N")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: int, of: int = HASH_BITS) -> Column:
    return F.shiftright(h, of - bits) if bits < of else h


def _resolve(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(bits, prefix, bytes, rows) of the directory's buckets with low to high bits over cell sums at `high` bits.

    A cell sum is added up for each of its prefixes; a prefix is a bucket if it fits and its
    parent does not. At HASH_BITS bits what is over the limit is a bucket too.
    """
    spread = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("bits"), "cell", "bytes", "rows")
    sums = spread.groupBy("bits", F.expr(f"shiftright(cell, {high} - bits)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    parents = sums.where(F.col("bytes") > limit).select((F.col("bits") + 1).alias("bits"), F.col("prefix").alias("parent"))
    fits = (F.col("bytes") <= limit) | (F.col("bits") == HASH_BITS)
    found = sums.where(fits & (F.col("bits") > low)).withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["bits", "parent"], "left_semi")
    return found.select("bits", "prefix", "bytes", "rows").unionByName(sums.where(fits & (F.col("bits") == low)))


def directory(keyed: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Directory (bits, prefix, bytes, rows) of a table (h, bytes), and the largest number of bits in use."""
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    step = max(1, math.ceil(math.log2(max(1, total / limit))) + 6)
    low, high = 0, min(HASH_BITS, step)
    parts, rest = [], keyed
    while True:
        cells = stash(rest.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))
        parts.append(_resolve(cells, low, high, limit))
        over = cells.where(F.col("bytes") > limit).select("cell")
        if high == HASH_BITS or over.limit(1).count() == 0:
            break
        rest = rest.withColumn("cell", _prefix(F.col("h"), high)).join(small_side(stash(over)), "cell", "left_semi").drop("cell")
        # one row for each cell that goes deeper, so that its own sum is not taken for a bucket
        low, high = high + 1, min(HASH_BITS, high + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stash(out)
    return out, out.agg(F.max("bits")).first()[0] or 0


def shard(docs: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_rows, oversize), one row per input row.

    `shard` is the bucket's hash prefix as a bit string ('' for a single shard).
    """
    keyed = docs.select(F.col(key_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes")).withColumn("h", key_hash(F.col("doc_id")))
    keyed = stash(keyed)
    found, deepest = directory(keyed, limit)
    # every bucket under its prefixes of `shallow` bits: rows find their bucket by one equal key and a test of the bits below
    shallow = found.agg(F.min("bits")).first()[0] or 0
    found = found.withColumn("top", F.expr(f"shiftright(prefix, bits - {shallow})"))
    found = small_side(found)
    joined = keyed.withColumn("top", _prefix(F.col("h"), shallow)).join(found.withColumnRenamed("bytes", "shard_bytes").withColumnRenamed("rows", "shard_rows"), "top")
    joined = joined.where(F.expr(f"shiftright(h, {HASH_BITS} - bits) = prefix"))
    bits_text = F.when(F.col("bits") == 0, F.lit("")).otherwise(F.expr("right(lpad(bin(prefix), 64, '0'), bits)"))
    return joined.select("doc_id", "bytes", bits_text.alias("shard"), F.col("bits").cast("int").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"))
