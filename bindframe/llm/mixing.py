"""Mixing sources to target weights with exact budgets.

Every row gets a hash-random key. Rows are range-partitioned by (source, key), so that a source
of any size lies over as many partitions as its rows need, and sorted inside each partition;
running sums within partitions and the sums of the partitions before them give each row the
number of words that its source has before it. A source's budget then says how often all its
rows are taken (epochs) and at which row the last epoch is cut, to the word.

Budgets come from weights: all sources share `share` times all words by weight, no source takes
more than `most` times its size, and what is above that is shared anew among the others. Sources
are ordered by how soon they fill, again with distributed prefix sums; a source is full if its
cap is at most its share of what the sources before it leave.

Defined results: a null text has size 0; rows of size 0 take nothing; null is a source of its
own behind all others; a null id has a key like any other; repeated rows are dealt out one by
one, alike but for the cut; sources without a word have target 0; an empty table gives an empty
result; columns that are not named are left out, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from bindframe.llm._common import bounded_batches, small_side, stash

WORD = r"[^\x20\x09-\x0D]+"

#: Weights of the sources in code-point order, from the first again after the last.
WEIGHTS = (5, 2, 1)
#: What all sources give together, in sizes of all; and what a source gives at most, in its own sizes.
SHARE, MOST = Fraction(3, 2), 2


def measure(docs: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """docs with the number of words of each text."""
    return docs.withColumn(size_col, F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))


def random_key(column: Column) -> Column:
    """60 bits of the MD5 of a value as text; null has a text of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("\\N"))), 1, 15), 16, 10).cast("long")


def prefix_sums(df: DataFrame, group: str | None, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """df with before_<v> for each long column v: its sum over the earlier rows of the group, in the order given.

    group names a long column without nulls; equal rows in the order are taken in any one order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_group", F.col(group) if group else F.lit(0).cast("long"))
    by = ([F.col("_group")] if group else []) + list(order)
    dealt = bounded_batches(rows.repartitionByRange(n, *by).sortWithinPartitions(*by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, dict.fromkeys(values, 0)
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_group").to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = keys[0] != last
            begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            columns = [*batch.columns, pa.array(np.full(len(keys), part, np.int32))]
            for v in values:
                each = batch.column(v).to_numpy()
                total = np.cumsum(each)
                earlier = total - each
                before = np.where(begin < 0, earlier + sums[v], earlier - earlier[begin])
                columns.append(pa.array(before))
                sums[v] = int(before[-1] + each[-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", *(f"_in_{v}" for v in values)])

    schema = StructType([*dealt.schema, StructField("_part", IntegerType()), *(StructField(f"_in_{v}", LongType()) for v in values)])
    inside = stash(dealt.mapInArrow(run, schema))
    parts = stash(inside.groupBy("_part", "_group").agg(*(F.sum(v).alias(f"_of_{v}") for v in values)))
    # a group has at most as many rows here as there are partitions
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(stash(parts.select("_part", "_group", *(F.coalesce(F.sum(f"_of_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values))))
    return inside.join(offsets, ["_part", "_group"]).select(*(inside[c] for c in df.columns), *((F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """rows(source, size) -> (source, rank, source_size, target, budget): one row for each source; budget is the target in whole words."""
    sources = stash(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one")))
    ranked = prefix_sums(sources, None, [F.col("source").asc_nulls_last()], ["one"]).withColumnRenamed("before_one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sized = ranked.drop("one").withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # a source is the sooner full the smaller its size is against its weight
    soon = F.col("source_size") * F.element_at(F.array(*(F.lit(lcm(*weights) // w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = stash(prefix_sums(sized.withColumn("soon", soon), None, [F.col("soon"), F.col("rank")], ["cap", "weight"]))
    all_weights = filled.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    p, q = share.numerator, share.denominator
    big = lambda c: c.cast("decimal(19,0)")
    full = big(F.col("cap")) * big(q * (all_weights - F.col("before_weight"))) <= big(F.col("weight")) * big(F.lit(p * total) - q * F.col("before_cap"))
    judged = filled.withColumn("full", full)
    taken, left = judged.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
    over, under = F.col("weight") * (p * total - q * taken), max(1, q * left)
    return judged.select(
        "source", "rank", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(over.cast("double") / F.lit(float(under))).alias("target"),
        F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"(weight * {p * total - q * taken}L) div {under}L")).alias("budget"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", keep: Sequence[str] = ()) -> DataFrame:
    """docs(id, source, size) -> (doc_id, source, size, source_size, target, taken, *keep), one row for each row of docs.

    taken counts words, those of repeated epochs too; all sources' taken words add up to their
    targets, rounded down. `keep` names further columns to carry along, texts for `mixed_texts`.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(size_col).cast("long").alias("size"), *keep)
    # written once, so that the number that tells repeated rows apart is the same in every read
    rows = stash(rows.withColumn("_key", random_key(F.col("doc_id"))))
    plan = small_side(stash(targets(rows, weights, share, most)))
    ours = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(*(rows[c] for c in rows.columns), "rank", "source_size", "target", "budget")
    placed = prefix_sums(stash(ours.withColumn("_row", F.monotonically_increasing_id())), "rank", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_row")], ["size"])
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    last = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("before_size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, source, epoch, text): the mix itself, a row for each epoch of a document; at the cut, the words that are left, one blank between them."""
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast((taken - 1) div size as int))")))
    left = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")).cast("int")
    text = F.col(text_col).cast("string")
    return rows.select("doc_id", "source", "epoch", F.when(left == F.col("size"), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, left), " ")).alias("text"))
