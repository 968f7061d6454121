"""Chains from sequences to training tables, mutants and array designs, put together from the operators that call and change sites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindframe.functions.calling import Caller
from bindframe.functions.sequences import packed, reverse_complement, unpacked
from bindframe.operators import design, mutation
from bindframe.operators.models import cross_validated_folds
from bindframe.operators.replicates import rank_test
from bindframe.operators.sites import pwm_scan
from bindframe.sources.shared import saved


def two_sites(df: DataFrame, rows: list[dict[str, float]], above: float) -> DataFrame:
    """df(key, sequence) with exactly two matrix sites -> (key, sequence, pos_1, pos_2, score_1, score_2, side_1, side_2), in order; pos is where a site starts.

    A sequence's sites are gathered by key; a site takes a few numbers of it.
    """
    found = pwm_scan(df, rows, above=above)
    each = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "score", "orientation"))).alias("s")).where(F.size("s") == 2)
    part = lambda i, c, name: F.get("s", F.lit(i))[c].alias(name)
    flat = each.select("key", *(part(i, c, f"{n}_{i + 1}") for c, n in (("start", "pos"), ("score", "score"), ("orientation", "side")) for i in (0, 1)))
    return df.select("key", "sequence").join(flat, "key")


def training_table(df: DataFrame, rows: list[dict[str, float]], above: float) -> DataFrame:
    """(key, sequence, site_str_pos, site_str_score, site_wk_pos, site_wk_score, distance, orientation, turned) of sequences with two sites.

    Rows whose sites both lie on the minus strand are turned and called again, so that '-/-' goes into '+/+'; turned rows that no longer
    hold two sites are left out. The site with the higher score is str, the left one of equals.
    """
    first = two_sites(df, rows, above)
    minus = (F.col("side_1") == -1) & (F.col("side_2") == -1)
    again = two_sites(first.where(minus).select("key", reverse_complement(F.col("sequence")).alias("sequence")), rows, above)
    both = first.where(~minus).withColumn("turned", F.lit(False)).unionByName(again.withColumn("turned", F.lit(True)))
    left = F.col("score_1") >= F.col("score_2")
    pick = lambda c, a, b: F.when(left, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    sign = lambda i: F.when(F.col(f"side_{i}") == 1, "+").otherwise("-")
    return both.select("key", "sequence", pick("pos", 1, 2).alias("site_str_pos"), pick("score", 1, 2).alias("site_str_score"), pick("pos", 2, 1).alias("site_wk_pos"), pick("score", 2, 1).alias("site_wk_score"), (F.col("pos_2") - F.col("pos_1")).alias("distance"), F.concat(sign(1), F.lit("/"), sign(2)).alias("orientation"), "turned")


def mutant_table(pairs: DataFrame, caller: Caller, cores: list[str], flank: int = 2, least: int = 4) -> DataFrame:
    """I8: (key, sequence, muttype, comment, pos_1, pos_2, score_1, score_2, distance): I3 to I7 of pairs(key, sequence, pos_1, pos_2) in one table, each called again.

    Only sequences that still hold two sites stay; flank mutants may change one of the two at most. Every mutant is called once, by numpy on
    batches of rows of all kinds; originals are joined with the pairs, before there are mutants. Predictions are added by `score_table` of the models.
    """
    k = caller.k
    # written once, since six branches read them
    pairs = saved(pairs)
    both = pairs.select("key", F.col("sequence").alias("original"))
    made = lambda df, kind, comment, key="key", original=F.lit(None).cast("string"): df.select(F.col(key).alias("key"), "sequence", F.lit(kind).alias("muttype") if kind else "muttype", comment.alias("comment"), original.alias("original"))
    core = made(design.mutate_core(pairs, cores), "affinity", F.concat(F.lit("core:"), "site", F.lit(":"), "core"))
    near = design.mutate_flank(pairs.join(both, "key").withColumn("key", F.struct("key", "original")), k, flank)
    flanks = made(near, "affinity", F.concat(F.lit("flank:"), "site", F.lit(":"), "position", "base"), "key.key", F.col("key.original"))
    moved = made(design.mutate_distance(pairs, k, least), "distance", F.concat(F.lit("distance:"), "distance"))
    turned = made(design.mutate_orientation(pairs, k), "orientation", F.concat(F.lit("turned:"), "turned"))
    wild = made(design.wild_type_rows(pairs), None, F.lit("wt"))
    rows = reduce(DataFrame.unionByName, (core, flanks, moved, turned, wild))
    called = rows.withColumn("_two", mutation.settled(caller.two_on_batches(F.col("sequence"), F.col("original")))).where("_two is not null")
    return called.select("key", "sequence", "muttype", "comment", "_two.*", (F.col("_two.pos_2") - F.col("_two.pos_1")).alias("distance"))


def filtered_probes(df: DataFrame, caller: Caller, profile: Caller, primer: str, cutoffs: Sequence[float], gaps: Sequence[int]) -> DataFrame:
    """(key, wt, m1, m2, m3, site_1, site_2, cutoff, gap): I11, I18 and I12 one after the other.

    A set stays if some cut-off and gap pass and all four sequences have, or can be given, clean borders to the primer.
    """
    sets = mutation.variant_sets(df, caller)
    passed = mutation.check_probe_set(sets, profile, caller.k, cutoffs, gaps)
    kinds = ("wt", "m1", "m2", "m3")
    each = sets.join(passed, "key").select(F.struct("key", "site_1", "site_2", "cutoff", "gap").alias("of"), F.explode(F.array(*(F.struct(F.lit(x).alias("kind"), F.col(x).alias("sequence")) for x in kinds))).alias("v"))
    clean = mutation.clean_junction(each.select(F.struct("of", "v.kind").alias("key"), "v.sequence"), primer, caller)
    wide = clean.where("new is not null").groupBy("key.of").agg(*(F.max(F.when(F.col("key.kind") == x, F.col("new"))).alias(x) for x in kinds), F.count("*").alias("_n"))
    return wide.where(F.col("_n") == len(kinds)).select("of.key", *kinds, "of.site_1", "of.site_2", "of.cutoff", "of.gap")


def move_sites(df: DataFrame, direction: str = "to_right", fixed: bool = False, cushion: int = 5) -> DataFrame:
    """df(key, sequence, end_1, start_2, flank_left, flank_right) -> (key, step, sequence): one site moved towards the other, or both together.

    The step is 1 or 2 bases, 1 where the bases between the sites are odd in number. Moving one site takes so many bases out of the middle
    between the sites; moving both (`fixed`) takes them out `cushion` bases before the end that they move to. The flank of the
    other end fills up, so the length stays. Rows without so many bases to give, in between or in the flank, have no row.
    """
    if direction not in ("to_right", "to_left"):
        raise ValueError("direction is to_right or to_left")
    right = direction == "to_right"
    between = F.col("start_2") - F.col("end_1") - 1
    step = F.lit(2) - F.pmod(between, F.lit(2))
    n = F.length("sequence")
    begin = (n - cushion - step if right else F.lit(cushion)) if fixed else F.col("end_1") + 1 + F.expr("(start_2 - end_1 - 1) div 2") - F.expr("(2 - pmod(start_2 - end_1 - 1, 2)) div 2")
    short = F.concat(F.substring("sequence", F.lit(1), begin), F.substring("sequence", begin + step + 1, n))
    new = F.concat(F.substring("flank_left", F.length("flank_left") - step + 1, step), short) if right else F.concat(short, F.substring("flank_right", F.lit(1), step))
    room = (begin > F.col("start_2")) & (begin + step <= n) if fixed and right else (begin + step <= F.col("end_1")) & (begin >= 0) if fixed else between >= step
    flank = F.length("flank_left" if right else "flank_right") >= step
    return df.where(room & flank).select("key", (step if right else -step).cast("int").alias("step"), new.alias("sequence"))


def array_design(df: DataFrame, primer: str, replicates: int, prefix: str, width: int = 15) -> DataFrame:
    """S20's rows: (id, sequence, score, kind, type, coordinate) of I13 for every variant of df(key, wt, m1, m2, m3); ids run from 1, filled up with zeros to `width` with the prefix.

    Ids follow the md5 of the type text, numbered in blocks, so no task sees all rows. Only the sets are written; their rows are moved once, as a key, a
    number and the packed bases, and the type text, its hash, the turned bases and the primer are made where the rows are numbered.
    """
    kinds = [x for x in ("wt", "m1", "m2", "m3") if x in df.columns]
    sets = saved(df.select("key", *(packed(F.col(x)).alias(x) for x in kinds)))
    ways = F.explode(F.array(*(F.struct(F.lit(i * 2 + o).alias("way"), F.lit(r).alias("rep")) for i in range(len(kinds)) for o in (0, 1) for r in range(1, replicates + 1))))
    kind, ori = F.get(F.array(*map(F.lit, kinds)), F.shiftright("way", 1)), F.concat(F.lit("o"), F.col("way").bitwiseAND(1) + 1)
    typed = F.concat(F.concat_ws("_", "key", kind), F.lit("_"), ori, F.lit("_r"), "rep")
    block = F.substring(F.md5(typed), 1, 3)

    # equal types share an id, so a block is as large as its different types
    names = sets.select("key").distinct().select("key", ways.alias("w")).select("key", "w.*")
    sizes = names.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))

    text = F.get(F.array(*kinds), F.shiftright("w.way", 1))
    rows = sets.select("key", *kinds, ways.alias("w")).select("key", "w.*", text.alias("bases"))
    moved = rows.withColumn("_block", block).repartition("_block").select("key", "way", "rep", "bases", "_block", typed.alias("type"))
    ranked = moved.withColumn("_r", F.dense_rank().over(W.partitionBy("_block").orderBy(F.unhex(F.md5("type")), "type")))
    sequence = F.concat(unpacked(F.col("bases"), F.col("way").bitwiseAND(1) == 1), F.lit(primer))
    numbered = ranked.join(F.broadcast(before), "_block").select("type", sequence.alias("sequence"), (F.col("_before") + F.col("_r")).alias("id"))
    filled = F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), max(1, width - len(prefix)), "0"))
    return numbered.select(filled.alias("id"), "sequence", F.lit("Na|Na").alias("score"), F.lit("Na").alias("kind"), "type", F.lit("chr1:0-0").alias("coordinate"))


def write_array_design(df: DataFrame, path: str) -> None:
    """The seven columns of an array order, tab-separated, without a header; the type stands twice."""
    df.select("id", "sequence", F.col("type").alias("a"), "score", "kind", F.col("type").alias("b"), "coordinate").write.option("sep", "\t").csv(path)


def compare_feature_sets(df: DataFrame, sets: dict[str, Sequence[str]], estimator, positive: Column, folds: int, repeats: int) -> DataFrame:
    """M9: (first, second, m, n, u, method, p): the rank test, greater, of the AUCs by fold and repeat between each two feature sets."""
    scored = cross_validated_folds(df, sets, estimator, positive, folds, repeats)
    names = sorted(sets)
    ways = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a in names for b in names if a != b))
    held = scored.select("model", "auc", F.explode(ways).alias("w")).where((F.col("model") == F.col("w.first")) | (F.col("model") == F.col("w.second")))
    return rank_test(held.select("w.first", "w.second", F.when(F.col("model") == F.col("w.first"), "two").otherwise("indiv").alias("kind"), F.col("auc").alias("value")), ["first", "second"])
