"""Running totals, quantiles and ranks of few large groups, without a task that holds a whole group.

Rows are counted by value first. Totals run over BLOCKS parts of a group's value range, and then
inside each part, so a window holds BLOCKS rows of a group or one part of its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindframe.sources.shared import saved

#: Parts of a group's value range.
BLOCKS = 1024


def _beside(df: DataFrame, other: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """df with the columns of other, joined on keys (null equals null) and on `also`; without both, other is one row."""
    by = [*keys, *also]
    if not by:
        return df.join(F.broadcast(other))
    named = other.select(*(F.col(k).alias(f"_of_{k}") for k in by), *(c for c in other.columns if c not in by))
    return df.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by))).drop(*(f"_of_{k}" for k in by))


def running_totals(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """counts(keys, value, sums), one row a value -> with c<sum>, the total up to and with the value, t<sum>, the group's total, and `_block`."""
    ends = counts.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), *(F.sum(s).alias(f"t{s}") for s in sums))
    far = (F.col("_high") - F.col(value)) if descending else (F.col(value) - F.col("_low"))
    block = F.when(F.col("_high") > F.col("_low"), F.floor(far / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * BLOCKS)).otherwise(F.lit(0))
    blocked = _beside(counts, ends, keys).withColumn("_block", block.cast("long")).drop("_low", "_high")
    over = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    parts = blocked.groupBy(*keys, "_block").agg(*(F.sum(s).alias(f"_b{s}") for s in sums))
    before = parts.select(*keys, "_block", *(F.coalesce(F.sum(f"_b{s}").over(over), F.lit(0)).alias(f"_before_{s}") for s in sums))
    inner = W.partitionBy(*keys, "_block").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(W.unboundedPreceding, 0)
    out = _beside(blocked, before, keys, ["_block"])
    return out.withColumns({f"c{s}": F.col(f"_before_{s}") + F.sum(s).over(inner) for s in sums}).drop(*(f"_before_{s}" for s in sums))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], counted: str | None = None) -> DataFrame:
    """(keys, points): exact quantiles with linear interpolation, null where a group has no value; `counted` names a column for the number of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("n"))
    placed = running_totals(counts, keys, "_value", ["n"])
    out = []
    for name, q in points.items():
        at = q * (F.col("tn") - 1)
        of = lambda place: F.max(F.when((F.col("cn") - F.col("n") <= place) & (place < F.col("cn")), F.col("_value")))
        low, high, share = of(F.floor(at)), of(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(name))
    return placed.groupBy(*keys).agg(*out, *([F.sum("n").alias(counted)] if counted else []))


def adjusted_p(df: DataFrame, keys: Sequence[str], p: Column) -> DataFrame:
    """df with p_adjusted, Benjamini-Hochberg within the keys: for each distinct p, the least of p' * n / rank over all p' from p up."""
    # written once, since what p comes from may be long
    rows = saved(df.withColumn("_q", p.cast("double")))
    ranked = running_totals(rows.groupBy(*keys, "_q").agg(F.count("*").alias("n")), keys, "_q", ["n"]).withColumn("_ratio", F.col("_q") * F.col("tn") / F.col("cn"))
    above = W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    later = ranked.groupBy(*keys, "_block").agg(F.min("_ratio").alias("_least")).select(*keys, "_block", F.min("_least").over(above).alias("_later"))
    inner = W.partitionBy(*keys, "_block").orderBy(F.desc("_q")).rowsBetween(W.unboundedPreceding, 0)
    table = _beside(ranked, later, keys, ["_block"]).select(*keys, "_q", F.least(F.lit(1.0), F.min("_ratio").over(inner), F.col("_later")).alias("p_adjusted"))
    return _beside(rows, table, keys, ["_q"]).drop("_q")


def score_steps(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """(keys, score, p, n, cp, cn, tp, tn): at each distinct score of a group the positive and negative rows, those down to it from the top, and all. Null scores do not count."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    return running_totals(counts, keys, "score", ["p", "n"], descending=True).select(*keys, "score", "p", "n", "cp", "cn", "tp", "tn")


def hashed_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `_number`: the place of a row, from 1, among those of its key in the order of the MD5 of name; counted by the hash's first three digits, then inside each."""
    rows = df.withColumn("_digest", F.md5(F.col(name))).withColumn("_part", F.substring("_digest", 1, 3))
    over = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(key, "_part").agg(F.count("*").alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    inner = W.partitionBy(key, "_part").orderBy("_digest")
    return _beside(rows, sizes, [key, "_part"]).withColumn("_number", F.col("_before") + F.row_number().over(inner)).drop("_digest", "_part", "_before")
