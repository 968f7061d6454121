"""Operators on rows that carry positions, groups and variants: orientation, joins by name, ids, order, selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindframe.functions import sequences as fn
from bindframe.operators.sites import pwm_score
from bindframe.sources.shared import saved

#: What stands for a score that could not be made.
SENTINEL = -999


def flip_strand(df: DataFrame, length: int) -> DataFrame:
    """Rows with both cores on the minus strand become plus: positions count from the other end and change places."""
    both = (F.col("strand_1") == "-") & (F.col("strand_2") == "-")
    turned = lambda other, own: F.when(both, F.lit(length) - F.col(other)).otherwise(F.col(own))
    strand = lambda c: F.when(both, F.lit("+")).otherwise(F.col(c))
    return df.withColumns({"pos_1": turned("pos_2", "pos_1"), "pos_2": turned("pos_1", "pos_2"), "strand_1": strand("strand_1"), "strand_2": strand("strand_2")})


def orient_by_factor(df: DataFrame, width: int) -> DataFrame:
    """Where factor 1 starts right of factor 2 the sequence is turned, and both starts (of sites so wide) with it."""
    turn = F.col("start_1") > F.col("start_2")
    start = lambda c: F.when(turn, F.length("sequence") - F.col(c) - width).otherwise(F.col(c))
    return df.withColumns({"start_1": start("start_1"), "start_2": start("start_2"), "sequence": F.when(turn, fn.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))})


def to_positional(df: DataFrame) -> DataFrame:
    """Strong and weak site (site_str_pos, str_score, site_wk_pos, wk_score) as left and right one."""
    left = F.col("site_str_pos") <= F.col("site_wk_pos")
    pick = lambda a, b, name: F.when(left, F.col(a)).otherwise(F.col(b)).alias(name)
    rest = [c for c in df.columns if c not in ("site_str_pos", "site_wk_pos", "str_score", "wk_score")]
    return df.select(*rest, pick("site_str_pos", "site_wk_pos", "pos_1"), pick("site_wk_pos", "site_str_pos", "pos_2"), pick("str_score", "wk_score", "score_1"), pick("wk_score", "str_score", "score_2"))


def rebase_coordinates(df: DataFrame, position: str, start: str, offset: int = 1) -> DataFrame:
    """A genome position as one in its interval."""
    return df.withColumn(position, F.col(position) - F.col(start) + offset)


def drop_sentinels(df: DataFrame, columns: list[str], value: float = SENTINEL) -> DataFrame:
    """Rows in which none of the columns is the sentinel; nulls stay."""
    bad: Column = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) == value, F.lit(False))
    return df.where(~bad)


def required_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P20: df, or a ValueError that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(lacking)}")
    return df


def chamber_join(x: DataFrame, y: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Rows of two chambers with the same keys; the other columns get a suffix."""
    named = [d.select(*keys, *[F.col(c).alias(c + s) for c in d.columns if c not in keys]) for d, s in zip((x, y), suffixes, strict=True)]
    return named[0].join(named[1], keys)


def matching_positions(a: Column, b: Column) -> Column:
    """How many positions of two sequences hold the same base."""
    return F.size(F.filter(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda x: x["a"] == x["b"]))


def similar_sequences(df: DataFrame, n: int, name: str = "name", sequence: str = "sequence", wild: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Per name the n sequences that match its wild type in most positions; ties by sequence, then by the columns in ties."""
    is_wild = F.col("type") == "wt" if wild is None else wild
    base = df.where(is_wild).select(name, F.col(sequence).alias("wild"))
    found = df.where(~is_wild).join(base, name).withColumn("matches", matching_positions(F.col(sequence), F.col("wild")))
    return found.withColumn("_r", F.row_number().over(W.partitionBy(name, "wild").orderBy(F.desc("matches"), sequence, *ties))).where(F.col("_r") <= n).drop("_r")


def keep_groups(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose group is in ids."""
    return df.join(ids, key, "left_semi")


def rest_of(df: DataFrame, kept: Column) -> DataFrame:
    """The rows that a condition does not keep, those where it is null included."""
    return df.where(~F.coalesce(kept, F.lit(False)))


def restore_sequences(df: DataFrame, mapping: DataFrame, column: str = "sequence") -> DataFrame:
    """Designed sequences back to their sources by mapping(designed, source); others stay."""
    joined = df.join(mapping, F.col(column) == F.col("designed"), "left")
    return joined.withColumn(column, F.coalesce("source", column)).drop("designed", "source")


def site_at(df: DataFrame, sites: DataFrame, position: Column, reach: int) -> DataFrame:
    """(key, pos, score) of the best site of each row whose span (pos - reach to pos + reach) holds the position."""
    spans = sites.select("key", "pos", "score")
    near = df.withColumn("_at", position).join(spans, "key").where(F.abs(F.col("pos") - F.col("_at")) <= reach)
    return near.groupBy("key").agg(F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("b")).select("key", "b.pos", "b.score")


def by_appearance(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, ori): o1, o2, .. for the values of each group, as they first appear in an explicit order."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("_first", value))
    return first.select(*keys, value, F.concat(F.lit("o"), number).alias("ori"))


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, id): ids from 1 without gaps, ordered by the md5 of the key.

    Numbered in 4,096 blocks of that hash; the running total goes over the blocks, not over the rows.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_md5", F.md5(F.col(key).cast("string"))).withColumn("_block", F.substring("_md5", 1, 3))
    sizes = keys.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))
    numbered = keys.withColumn("_r", F.row_number().over(W.partitionBy("_block").orderBy("_md5", key)))
    return numbered.join(F.broadcast(before), "_block").select(key, (F.col("_before") + F.col("_r")).alias("id"))


def with_dense_ids(df: DataFrame, key: str) -> DataFrame:
    """df with `id`, as `dense_ids` has it, for the rows that have a key: numbered as they are, in one shuffle, and written once."""
    digest = df.where(F.col(key).isNotNull()).withColumn("_md5", F.md5(F.col(key).cast("string")))
    blocked = digest.withColumn("_block", F.substring("_md5", 1, 3)).withColumn("_md5", F.unhex("_md5"))
    placed = saved(blocked.withColumn("_r", F.dense_rank().over(W.partitionBy("_block").orderBy("_md5", key))).drop("_md5"))
    sizes = placed.groupBy("_block").agg(F.max("_r").cast("long").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_block").withColumn("id", F.col("_before") + F.col("_r")).drop("_block", "_before", "_r")


def order_by_change(df: DataFrame, group: str, name: str, score: str) -> DataFrame:
    """Rows with the change of score to the group's first name (the wild type), and their place by its size."""
    base = df.groupBy(group).agg(F.min_by(score, name).alias("_base"), F.min(name).alias("_wild"))
    changed = df.join(base, group).where(F.col(name) != F.col("_wild")).withColumn("change", F.col(score) - F.col("_base")).drop("_base", "_wild")
    return changed.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.abs("change")), name)))


def union_tables(*tables: DataFrame, distinct: bool = False) -> DataFrame:
    """T4: the rows of all tables, columns by name; equal rows once if asked for."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct() if distinct else out


def count_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows and different names of each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(name).alias("names"))


def base_counts(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(position, A, C, G, T, share_A, ..): how often each base stands at each position."""
    cells = df.select(F.posexplode(F.split(sequence, "")).alias("position", "base")).where("base <> ''")
    counts = cells.groupBy("position").agg(*[F.count(F.when(F.col("base") == b, 1)).alias(b) for b in "ACGT"], F.count("*").alias("_n"))
    return counts.select("position", *"ACGT", *[(F.col(b) / F.col("_n")).alias(f"share_{b}") for b in "ACGT"])


def delta_to_original(df: DataFrame, key: str = "name", kind: str = "type", value: str = "intensity", original: str = "wt") -> DataFrame:
    """The median of each variant and its difference to the median of the original of its name."""
    medians = df.groupBy(key, kind).agg(F.median(value).alias("median"))
    base = medians.where(F.col(kind) == original).select(key, F.col("median").alias("_base"))
    return medians.where(F.col(kind) != original).join(base, key).select(key, kind, "median", (F.col("median") - F.col("_base")).alias("delta"))


def pwm_at(df: DataFrame, pwm: list[dict[str, float]], start: Column, core: int, flank: int = 0) -> DataFrame:
    """K5: score, strand and core text of the window at a known start (of the core; the matrix begins `flank` before it); SENTINEL if it is cut short; equal strands count as minus."""
    window = F.substring("sequence", (start - flank + 1).cast("int"), F.lit(len(pwm)))
    whole = (start >= flank) & (F.length(window) == len(pwm))
    forward, back = pwm_score(window, pwm), pwm_score(fn.reverse_complement(window), pwm)
    return df.select("key", F.when(whole, F.greatest(forward, back)).otherwise(F.lit(float(SENTINEL))).alias("score"), F.when(whole, F.when(forward > back + 1e-9, "+").otherwise("-")).alias("strand"), F.substring("sequence", (start + 1).cast("int"), F.lit(core)).alias("core"))


def multi_factor_sites(df: DataFrame, callers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Sites (key, pos, score) of several callers, tagged by factor and numbered along each sequence."""
    every = union_tables(*[call(df).select("key", F.lit(factor).alias("factor"), "pos", "score") for factor, call in callers.items()])
    return every.withColumn("number", F.row_number().over(W.partitionBy("key").orderBy("pos", "factor")))


def most_central_pair(sites: DataFrame, centre: float) -> DataFrame:
    """The two sites of each sequence whose middle lies nearest to the centre; ties by the left, then the right one."""
    a, b = sites.select("key", F.col("pos").alias("pos_1")), sites.select("key", F.col("pos").alias("pos_2"))
    both = a.join(b, "key").where("pos_1 < pos_2").withColumn("off", F.abs((F.col("pos_1") + F.col("pos_2")) / 2 - centre))
    return both.groupBy("key").agg(F.min(F.struct("off", "pos_1", "pos_2")).alias("m")).select("key", "m.pos_1", "m.pos_2", "m.off")


def sub_select(df: DataFrame, group: str, name: str, score: str, n: int, seed: str = "seed") -> DataFrame:
    """Of each group the wild type (first name), the mutants with the least and the greatest score, and n of the others in a hashed order."""
    w = W.partitionBy(group)
    marked = df.withColumn("_wild", F.col(name) == F.min(name).over(w))
    mutants = W.partitionBy(group, "_wild")
    marked = marked.withColumns({"_low": F.row_number().over(mutants.orderBy(score, name)), "_high": F.row_number().over(mutants.orderBy(F.desc(score), name))})
    end = F.col("_wild") | (F.col("_low") == 1) | (F.col("_high") == 1)
    marked = marked.withColumn("_end", end)
    place = F.row_number().over(W.partitionBy(group, "_end").orderBy(F.md5(F.concat(F.lit(seed), name))))
    return marked.withColumn("_r", place).where(F.col("_end") | (F.col("_r") <= n)).drop("_wild", "_low", "_high", "_end", "_r")


def affinity_feature(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """the strengths as features, and their mean."""
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    return df.select(key, *columns, mean.alias("mean_strength"))
