"""Picks of designed groups for an array, by the predictions of models and by site strengths; verdicts on site pairs.

Designs are rows (key, name, wild, ..) of which `wild` marks the wild types of a group. A group may hold a large
share of all rows: ends and ranges come from aggregates, a choice in hashed order goes over parts of a group first,
and neighbours in an order are found within parts of its range. Picks are top-k reports over groups.
Rows whose key is null are in no group; a null `wild` is a mutant; rows with one name count as copies of one row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bindframe.functions.calling import Caller
from bindframe.functions.likeness import block_ratios
from bindframe.sources.shared import saved

#: Parts of a group that a choice or an order goes over first.
PARTS = 256


def first_of_group(df: DataFrame, keys: list[str], order: list[Column], n: int, part: str) -> DataFrame:
    """n rows of each group in an order without ties: within parts by a hash of the column `part`, then over what they leave, at most n x PARTS rows."""
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    some = df.withColumn("_part", F.pmod(F.xxhash64(part), F.lit(PARTS))).withColumn("_r", place(*keys, "_part")).where(F.col("_r") <= n)
    return some.withColumn("_r", place(*keys)).where(F.col("_r") <= n).drop("_r", "_part")


def next_in_group(df: DataFrame, key: str, score: str, columns: list[str]) -> DataFrame:
    """df with next_<column>, the values of the row behind it by (score, name) in its group; null at the end. Rows without a score go.

    Rows are ordered within parts of the group's range; the last row of a part is given the first row of the next one.
    """
    held = df.where(F.col(score).isNotNull() & F.col(key).isNotNull())
    ends = held.groupBy(key).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    placed = held.join(ends, key).withColumn("_part", F.coalesce(F.floor((F.col(score) - F.col("_low")) / width * PARTS), F.lit(0))).drop("_low", "_high")
    kept = F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(columns)])
    heads = placed.groupBy(key, "_part").agg(F.min_by(kept, F.struct(score, "name")).alias("_head"))
    behind = heads.select(key, "_part", F.lead("_head").over(W.partitionBy(key).orderBy("_part")).alias("_behind"))
    own = F.lead(kept).over(W.partitionBy(key, "_part").orderBy(score, "name"))
    found = placed.withColumn("_own", own).join(behind, [key, "_part"]).withColumn("_next", F.coalesce("_own", "_behind"))
    return found.select(*[F.col(c) for c in df.columns], *[F.col(f"_next.n{i}").alias(f"next_{c}") for i, c in enumerate(columns)])


def with_ends(df: DataFrame, key: str, score: str, n: int, seed: str = "seed") -> DataFrame:
    """I28 on designs: of each group the wild types, the mutants with the least and the greatest score (ties by name), and n others in a hashed order."""
    place = F.struct(score, "name")
    mutant = ~F.coalesce("wild", F.lit(False))
    ends = df.groupBy(key).agg(F.min(F.when(mutant & F.col(score).isNotNull(), place)).alias("_low"), F.max(F.when(mutant & F.col(score).isNotNull(), place)).alias("_high"))
    end = ~mutant | F.coalesce((F.col("name") == F.col("_low.name")) | (F.col("name") == F.col("_high.name")), F.lit(False))
    marked = df.join(ends, key).withColumn("_end", end).drop("_low", "_high")
    others = first_of_group(marked.where(~F.col("_end")), [key], [F.md5(F.concat(F.lit(seed), "name")), F.col("name")], n, "name")
    return marked.where("_end").unionByName(others).drop("_end")


def _chosen(df: DataFrame, key: str, groups: DataFrame, m: int, *order: Column) -> DataFrame:
    """Rows of the first m groups of an order, ties by key."""
    return df.join(F.broadcast(groups.orderBy(*order, key).limit(m).select(key)), key, "left_semi")


def pick_inconsistent(df: DataFrame, key: str, a: str, b: str, m: int, n: int, cut: float = 0.5) -> DataFrame:
    """Rows on which two models disagree (one below `cut`, one not), of the m groups with the largest difference among such rows; `with_ends` of them by the first model."""
    apart = df.where((F.col(a) >= cut) != (F.col(b) >= cut))
    groups = apart.groupBy(key).agg(F.max(F.abs(F.col(a) - F.col(b))).alias("_d"))
    return with_ends(_chosen(apart, key, groups.where(F.col(key).isNotNull()), m, F.desc("_d")), key, a, n)


def group_shifts(df: DataFrame, key: str, proba: str, how: str, order: str = "distance", cut: float = 0.5) -> DataFrame:
    """I23 on designs: (key, n, n_zero, n_one, range, shifted) of each group.

    how 'distance': the first and the last row along `order` are of different class; 'orientation': a mutant
    differs from the wild type (the first by name); 'strength': two mutants at least do. Groups of one row do not shift,
    nor do groups without a wild type but by distance. Rows without a probability or without a key are left out.
    """
    if how not in ("distance", "orientation", "strength"):
        raise ValueError("how is distance, orientation or strength")
    held = df.where(F.col(proba).isNotNull() & F.col(key).isNotNull()).withColumn("_c", (F.col(proba) >= cut).cast("int")).withColumn("_w", F.coalesce("wild", F.lit(False)))
    place, count = F.struct(order, "name"), lambda c: F.sum(c.cast("long"))
    groups = held.groupBy(key).agg(
        F.count("*").alias("n"), count(F.col("_c") == 0).alias("n_zero"), count(F.col("_c") == 1).alias("n_one"), (F.max(proba) - F.min(proba)).alias("range"),
        (F.min_by("_c", place) != F.max_by("_c", place)).alias("_ends"), F.min(F.when(F.col("_w"), F.struct("name", "_c")))["_c"].alias("_wild"),
        count(~F.col("_w") & (F.col("_c") == 0)).alias("_m0"), count(~F.col("_w") & (F.col("_c") == 1)).alias("_m1"))
    others = F.when(F.col("_wild") == 1, F.col("_m0")).when(F.col("_wild") == 0, F.col("_m1")).otherwise(0)
    shifted = F.col("_ends") if how == "distance" else others >= (1 if how == "orientation" else 2)
    return groups.select(key, "n", "n_zero", "n_one", "range", (shifted & (F.col("n") > 1)).alias("shifted"))


def pick_largest_shift(df: DataFrame, key: str, proba: str, how: str, m: int, n: int, order: str = "distance") -> DataFrame:
    """The m groups with the largest range of predictions among those that shift, topped up with the largest of the others; `with_ends` of them."""
    return with_ends(_chosen(df, key, group_shifts(df, key, proba, how, order), m, F.desc("shifted"), F.desc("range")), key, proba, n)


def pick_most_ones(df: DataFrame, key: str, proba: str, how: str, m: int, n: int, order: str = "distance") -> DataFrame:
    """The m groups that shift and have rows of both classes, with most rows of class one; `with_ends` of them."""
    both = group_shifts(df, key, proba, how, order).where("shifted and n_zero > 0 and n_one > 0")
    return with_ends(_chosen(df, key, both, m, F.desc("n_one")), key, proba, n)


def _at_site(df: DataFrame, site: str) -> Column:
    return F.coalesce(F.col("comment").contains(site), F.lit(False))


def pick_small_change(df: DataFrame, key: str, proba: str, site: str, score: str, tol: float, cut: float = 0.5) -> DataFrame:
    """Where a small change at one site flips the prediction: the wild type (the first by name) and the mutants of that site of the other class whose score is within `tol` (strictly).

    Groups that keep no mutant go. `comment` says which sites a mutant changes.
    """
    wild = F.coalesce("wild", F.lit(False))
    rows = df.where((wild | _at_site(df, site)) & F.col(key).isNotNull()).withColumn("_c", F.col(proba) >= cut)
    base = rows.where(wild).groupBy(key).agg(F.min(F.struct("name", "_c", F.col(score).alias("s"))).alias("_b"))
    near = rows.join(base, key).withColumn("_keep", ~wild & (F.col("_c") != F.col("_b._c")) & (F.abs(F.col(score) - F.col("_b.s")) < tol)).where(F.col("_keep") | (F.col("name") == F.col("_b.name")))
    some = near.groupBy(key).agg(F.bool_or("_keep").alias("_any")).where("_any").select(key)
    return near.join(some, key, "left_semi").drop("_c", "_b", "_keep")


def pick_large_change(df: DataFrame, key: str, site: str, score: str, m: int, n: int, close: float) -> DataFrame:
    """The m groups with the largest range of a site's score among its mutants; of each the wild types, both ends, and n pairs of neighbours by score.

    A pair are neighbours less than `close` apart, one of them changed to the left of the site and one to the right
    (as their comments say); pairs come in a hashed order of their first name.
    """
    wild = F.coalesce("wild", F.lit(False))
    mutants = df.where(~wild & _at_site(df, site) & F.col(key).isNotNull() & F.col(score).isNotNull())
    place = F.struct(score, "name")
    groups = mutants.groupBy(key).agg((F.max(score) - F.min(score)).alias("_d"), F.min(place).alias("_low"), F.max(place).alias("_high"))
    top = F.broadcast(groups.orderBy(F.desc("_d"), key).limit(m))
    held = mutants.join(F.broadcast(groups.orderBy(F.desc("_d"), key).limit(m).select(key)), key, "left_semi")
    behind = next_in_group(held, key, score, ["name", "comment", score])
    sides = F.concat("comment", "next_comment")
    pairs = behind.where((F.col(f"next_{score}") - F.col(score) < close) & sides.contains("left") & sides.contains("right"))
    some = first_of_group(pairs.select(key, "name", "next_name"), [key], [F.md5("name"), F.col("name"), F.col("next_name")], n, "name")
    both = some.select(key, F.explode(F.array("name", "next_name")).alias("name"))
    ends = top.select(key, F.explode(F.array("_low.name", "_high.name")).alias("name"))
    # at most 2 n + 2 names of m groups
    names = both.unionByName(ends).distinct()
    return held.join(F.broadcast(names), [key, "name"], "left_semi").select(df.columns).unionByName(df.where(wild).join(top.select(key), key, "left_semi").select(df.columns))


def pair_verdicts(df: DataFrame, sites: DataFrame, regions: Callable[[DataFrame], DataFrame], profile: Callable[[DataFrame], DataFrame], low: float, near: int = 10, far: int = 20) -> DataFrame:
    """(key, n_sites, pos_1, pos_2, distance, status) of every sequence; sites count if they lie in a region of high scores.

    status is 'sites' without exactly two of them, 'distance' if they are not `near` to `far` apart, 'linker' if no
    window between the end of the first site's region and the start of the second's scores below `low`, else 'valid'.
    A site on the border of two regions belongs to the first. Regions are asked for of sequences that have a site only,
    and profiles of those whose pair has a fitting distance. Keys are unique.
    """
    inside = F.col("pos").between(F.col("startpos"), F.col("startpos") + F.col("escorelength"))
    found = regions(df.select("key", "sequence").join(sites.select("key"), "key", "left_semi"))
    placed = sites.join(found.select("key", "startpos", "escorelength"), "key").where(inside).groupBy("key", "pos").agg(F.min(F.struct("startpos", "escorelength")).alias("_g"))
    place = F.struct("pos", "_g")
    two = placed.groupBy("key").agg(F.count("*").alias("n_sites"), F.min(place).alias("_a"), F.max(place).alias("_b"))
    pair, distance = F.col("n_sites") == 2, F.col("_b.pos") - F.col("_a.pos")
    # written once, since the sequences are read again for what is left
    two = saved(two.select("key", "n_sites", F.when(pair, F.col("_a.pos")).alias("pos_1"), F.when(pair, F.col("_b.pos")).alias("pos_2"), F.when(pair, distance).alias("distance"), (F.col("_a._g.startpos") + F.col("_a._g.escorelength")).alias("_from"), F.col("_b._g.startpos").alias("_to")))
    open_ = two.where(F.col("distance").between(near, far)).select("key", "_from", "_to")
    scores = profile(df.select("key", "sequence").join(open_, "key", "left_semi"))
    quiet = scores.where(F.col("score") < low).join(open_, "key").where((F.col("start") >= F.col("_from")) & (F.col("start") < F.col("_to"))).select("key", F.lit(True).alias("_quiet")).distinct()
    out = df.select("key").join(two.join(quiet, "key", "left"), "key", "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))
    status = F.when(F.col("distance").isNull(), "sites").when(~F.col("distance").between(near, far), "distance").when(F.col("_quiet").isNull(), "linker").otherwise("valid")
    return out.select("key", "n_sites", "pos_1", "pos_2", "distance", status.alias("status"))


def pair_verdicts_in_rows(df: DataFrame, matrix: Caller, profile: Caller, gap: int, low: float, near: int = 10, far: int = 20) -> DataFrame:
    """`pair_verdicts` of the matrix's sites, at their middles, and the profile's regions, with everything done in the row of a sequence: nothing is shuffled or joined."""
    ready = df.select("key", *(c.alias(n) for n, c in {"_sites": matrix.sites_on_batches(F.col("sequence")), "_regions": profile.regions_on_batches(F.col("sequence"), gap), "_scores": profile.scores_on_batches(F.col("sequence"))}.items()))
    pos = lambda s: (s + matrix.k // 2).cast("long")
    region = lambda s: F.array_min(F.filter("_regions", lambda r: (r["begin"] <= pos(s)) & (pos(s) <= r["end"])))
    placed = F.filter(F.transform("_sites", lambda s: F.struct(pos(s).alias("pos"), region(s).alias("g"))), lambda x: x["g"].isNotNull())
    place = lambda i: F.get("_placed", F.lit(i))
    pair = F.size("_placed") == 2
    begin, end = place(0)["g"]["end"], place(1)["g"]["begin"]
    quiet = F.exists(F.slice("_scores", begin + 1, F.greatest(end - begin, F.lit(0))), lambda x: F.coalesce(x < low, F.lit(False)))
    judged = ready.withColumn("_placed", F.explode(F.array(placed))).select("key", F.size("_placed").cast("long").alias("n_sites"), F.when(pair, place(0)["pos"]).alias("pos_1"), F.when(pair, place(1)["pos"]).alias("pos_2"), F.when(pair, place(1)["pos"] - place(0)["pos"]).alias("distance"), F.when(pair, quiet).alias("_quiet"))
    status = F.when(F.col("distance").isNull(), "sites").when(~F.col("distance").between(near, far), "distance").when(~F.col("_quiet"), "linker").otherwise("valid")
    return judged.select("key", "n_sites", "pos_1", "pos_2", "distance", status.alias("status"))


@F.pandas_udf(DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters of the matching blocks over those of both texts; null beside a null."""
    return pd.Series(block_ratios(a.tolist(), b.tolist()), dtype="float64")


def similar_by_ratio(df: DataFrame, n: int, name: str = "name", sequence: str = "sequence", wild: str = "wild") -> DataFrame:
    """(name, wild_sequence, sequence, ratio): per name and distinct wild-type sequence the n distinct sequences of the name that are most alike by matching blocks; ties by sequence."""
    # written once, since both sides of the join read it
    held = saved(df.where(F.col(sequence).isNotNull()).select(name, sequence, wild))
    base = held.where(F.coalesce(F.col(wild), F.lit(False))).select(name, F.col(sequence).alias("wild_sequence")).distinct()
    found = held.select(name, sequence).distinct().join(base, name).withColumn("ratio", text_ratio("wild_sequence", sequence))
    return first_of_group(found, [name, "wild_sequence"], [F.desc("ratio"), F.col(sequence)], n, sequence)


def labelled_training(features: DataFrame, classes: DataFrame, sums: tuple[int, ...] = (36, 37)) -> DataFrame:
    """Features of each sequence by medians of its repeated rows, sites ordered by strength, with the label of its class.

    features(sequence, core1_start, core1_end, core2_start, core2_end, site1_pref, site2_pref, distance), classes(id, name,
    sequence, class). Sites stand at the rounded-down middles of their cores; pairs whose middles add up to none of `sums` are not
    centred and go. The label is what stands before the first '_' of the class. Of rows with one sequence the first by (class, id, name) stays.
    With equal strengths the second site is the stronger one.
    """
    columns = ["core1_start", "core1_end", "core2_start", "core2_end", "site1_pref", "site2_pref", "distance"]
    middle = lambda i: F.floor((F.col(f"core{i}_start") + F.col(f"core{i}_end")) / 2)
    known = features.groupBy("sequence").agg(*[F.median(c).alias(c) for c in columns]).withColumns({"site1_pos": middle(1), "site2_pos": middle(2)})
    centred = known.where((F.col("site1_pos") + F.col("site2_pos")).isin(*sums))
    first = classes.groupBy("sequence").agg(F.min(F.struct("class", "id", "name")).alias("c"))
    strong = F.col("site1_pref") > F.col("site2_pref")
    pick = lambda a, b: F.when(strong, F.col(a)).otherwise(F.col(b))
    return first.join(centred, "sequence").select(
        "c.id", "c.name", "sequence", pick("site1_pos", "site2_pos").alias("site_str_pos"), pick("site2_pos", "site1_pos").alias("site_wk_pos"),
        pick("site1_pref", "site2_pref").alias("site_str_score"), pick("site2_pref", "site1_pref").alias("site_wk_score"), "distance", F.split("c.class", "_")[0].alias("label"))


def turned_variant(df: DataFrame, flip: dict[str, str], kind: str = "type", ori: str = "ori", original_ori: str = "orig_ori") -> DataFrame:
    """Variant types as seen from the original orientation: those in `flip` change to their counterpart where the orientation is another."""
    other = F.col(kind)
    for a, b in flip.items():
        other = F.when(F.col(kind) == a, b).otherwise(other)
    return df.withColumn(kind, F.when(F.col(ori) != F.col(original_ori), other).otherwise(F.col(kind)))


def step_type(step: Column, sequence: Column, length: int) -> Column:
    """I22: 'orig' at step 0; 'to_right' or 'to_left' of full-length sequences; else 'shorter'."""
    whole = F.length(sequence) == length
    return F.when(step == 0, "orig").when((step > 0) & whole, "to_right").when((step < 0) & whole, "to_left").otherwise("shorter")


def expand_by_index(short: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(kmer, score) of condensed scores(line, score) through an index map(code, line); a code holds two bits a base, A, C, G, T from 0. Codes whose line has no score give no row."""
    kmer = F.expr(f"array_join(transform(sequence({k - 1}, 0, -1), i -> substring('ACGT', cast(shiftright(code, 2 * i) & 3 as int) + 1, 1)), '')")
    return index.join(short, "line").select(kmer.alias("kmer"), "score")


def known_orientation(first: Column, second: Column, one: str = "1") -> Column:
    """P13 of known orientation columns: '+/+', '+/-', '-/+' or '-/-', forward where the text of a value is `one`; null beside a null."""
    sign = lambda c: F.when(c.cast("string") == one, "+").otherwise("-")
    return F.when(first.isNotNull() & second.isNotNull(), F.concat(sign(first), F.lit("/"), sign(second)))


def site_extents(peaks: DataFrame, calls: DataFrame) -> DataFrame:
    """K8: (name, chr, start_pos, end_pos, orientation) in the genome of calls(key, core_start, core_end, orientation) within peaks(name, chr, start_pos, end_pos, strand).

    The end is behind the last base. On '-' peaks, whose bases were turned, places count from the peak's end and the orientation is turned.
    """
    on = calls.withColumnRenamed("key", "name").join(peaks, "name")
    back = F.coalesce(F.col("strand") == "-", F.lit(False))
    begin = F.when(back, F.col("end_pos") - F.col("core_end")).otherwise(F.col("start_pos") + F.col("core_start"))
    end = F.when(back, F.col("end_pos") - F.col("core_start")).otherwise(F.col("start_pos") + F.col("core_end"))
    turned = F.when(back, -F.col("orientation")).otherwise(F.col("orientation"))
    return on.select("name", "chr", begin.alias("start_pos"), end.alias("end_pos"), turned.alias("orientation"))
