"""k-mer features around and between two sites, canonical k-mers of several lengths, base weights by label, names of two label tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindframe.functions.sequences import canonical
from bindframe.operators.curves import quantiles

MODES = ("positional", "relative", "linker")


def _cut(seq: Column, begin: Column, end: Column) -> Column:
    """seq[begin:end], both ends brought inside the sequence."""
    low = F.greatest(F.lit(0), begin)
    return F.substring(seq, (low + 1).cast("int"), F.greatest(F.lit(0), F.least(end, F.length(seq)) - low).cast("int"))


def pair_flank_kmers(df: DataFrame, seqin: int, maxk: int = 2, mode: str = "positional") -> DataFrame:
    """df(key, sequence, pos_1, pos_2) -> (key, label, site, k, position, kmer), the positional k-mers beside two sites, as sparse one-hot features.

    seqin > 0 reads so many bases inwards of each site ('inner'), seqin < 0 outwards ('outer'), from the site on: the first site's inner and the second's
    outer flank forwards, the others backwards. 'positional' takes pos_1 as the left site; 'relative' takes whichever lies left, under its own name;
    'linker' reads seqin bases to either side of the middle. Flanks that leave the sequence are shorter.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    a, b, seq, n = F.col("pos_1"), F.col("pos_2"), F.col("sequence"), abs(seqin)
    swapped = F.lit(mode == "relative") & (a >= b)
    left, right = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    if mode == "linker":
        middle = F.expr("(pos_1 + pos_2) div 2")
        one, two, label = _cut(seq, middle, middle + n), _cut(seq, middle - n, middle), "linker"
        names = F.lit("toright"), F.lit("toleft")
    else:
        names = F.when(swapped, "s2").otherwise("s1"), F.when(swapped, "s1").otherwise("s2")
        label = "inner" if seqin > 0 else "outer"
        one = _cut(seq, left, left + n) if seqin > 0 else F.reverse(_cut(seq, left - n, left))
        two = F.reverse(_cut(seq, right - n, right)) if seqin > 0 else _cut(seq, right, right + n)
    cut = df.select("key", names[0].alias("_name_1"), names[1].alias("_name_2"), one.alias("_one"), two.alias("_two"))
    flanks = F.array(F.struct(F.col("_name_1").alias("site"), F.col("_one").alias("flank")), F.struct(F.col("_name_2").alias("site"), F.col("_two").alias("flank")))
    each = cut.select("key", F.explode(flanks).alias("f")).select("key", "f.*", F.explode(F.sequence(F.lit(1), F.lit(maxk))).alias("k"))
    placed = each.where(F.length("flank") >= F.col("k")).withColumn("position", F.explode(F.expr("sequence(0, length(flank) - k)")))
    return placed.select("key", F.lit(label).alias("label"), "site", "k", "position", F.expr("substring(flank, position + 1, k)").alias("kmer"))


def linker_features(df: DataFrame, width: int, k: int) -> DataFrame:
    """df(key, sequence, pos_1, pos_2) -> (key, kmer, ratio, gc): the share of each k-mer among those of the bases between two sites of `width`, and the share of G and C in them; linkers shorter than k have no row."""
    linker = df.select("key", _cut(F.col("sequence"), F.col("pos_1") + width, F.col("pos_2")).alias("linker")).where(F.length("linker") >= k)
    windows = F.transform(F.sequence(F.lit(0), F.length("linker") - k), lambda i: F.substring("linker", i + 1, F.lit(k)))
    total = F.length("linker") - (k - 1)
    gc = F.length(F.regexp_replace("linker", "[^GC]", "")) / F.length("linker")
    ready = linker.select("key", gc.alias("gc"), total.alias("total"), windows.alias("w"))
    kinds = ready.select("key", "gc", "total", "w", F.explode(F.array_distinct("w")).alias("kmer"))
    return kinds.select("key", "kmer", (F.size(F.filter("w", lambda x: x == F.col("kmer"))) / F.col("total")).alias("ratio"), "gc")


def canonical_counts(df: DataFrame, maxk: int, average: bool = False) -> DataFrame:
    """(key, kmer, n) of canonical k-mers of 1 to maxk bases; with `average` n is their share among the sequence's windows of that length."""
    each = df.select("key", "sequence", F.explode(F.sequence(F.lit(1), F.lit(maxk))).alias("k")).where(F.length("sequence") >= F.col("k"))
    windows = each.select("key", "k", F.length("sequence").alias("size"), "sequence", F.explode(F.expr("sequence(0, length(sequence) - k)")).alias("i"))
    counts = windows.groupBy("key", "k", "size", canonical(F.expr("substring(sequence, i + 1, k)")).alias("kmer")).agg(F.count("*").alias("n"))
    return counts.select("key", "kmer", (F.col("n") / (F.col("size") - F.col("k") + 1)).alias("n") if average else F.col("n"))


def base_weights(df: DataFrame) -> DataFrame:
    """df(label, sequence) -> (label, position, base, n, share, weight): bases at each position by label; weight is log2 of the share over a quarter, 0 at least.

    Each row is counted by position in the scan's partial counts; missing bases have no row.
    """
    cells = df.select("label", F.posexplode(F.split("sequence", "")).alias("position", "base")).where(F.col("base").isin(*"ACGT"))
    counts = cells.groupBy("label", "position", "base").agg(F.count("*").alias("n"))
    # four rows a label and position at most
    total = counts.groupBy("label", "position").agg(F.sum("n").alias("total")).select(F.col("label").alias("_label"), F.col("position").alias("_position"), "total")
    share = F.col("n") / F.col("total")
    weight = F.greatest(F.lit(0.0), (F.log(share) - math.log(0.25)) / math.log(2))
    return counts.join(total, F.col("label").eqNullSafe(F.col("_label")) & (F.col("position") == F.col("_position"))).select("label", "position", "base", "n", share.alias("share"), weight.alias("weight"))


def label_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """J14 as rows: (name, label_a, label_b, kind) of two label tables; kind is agree, differ, only_a or only_b."""
    both = a.select("name", F.col("label").alias("label_a"), F.lit(True).alias("_a")).join(b.select("name", F.col("label").alias("label_b"), F.lit(True).alias("_b")), "name", "full")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("label_a").eqNullSafe(F.col("label_b")), "agree").otherwise("differ")
    return both.select("name", "label_a", "label_b", kind.alias("kind"))


def factor_summary(sites: DataFrame, factors: list[str]) -> DataFrame:
    """K20 whole: sites(key, factor, pos, score) -> (key, n_sites, span, <factor>_n, <factor>_pos, <factor>_score, distance).

    pos and score are those of a factor's best site (the left one of equals); distance lies between the best sites of the first two factors.
    """
    best = lambda f, c: F.max(F.when(F.col("factor") == f, F.struct("score", (-F.col("pos")).alias("back")))).getField(c)
    columns = [x for f in factors for x in (F.count(F.when(F.col("factor") == f, 1)).alias(f"{f}_n"), (-best(f, "back")).alias(f"{f}_pos"), best(f, "score").alias(f"{f}_score"))]
    out = sites.groupBy("key").agg(F.count("*").alias("n_sites"), (F.max("pos") - F.min("pos")).alias("span"), *columns)
    return out.withColumn("distance", F.abs(F.col(f"{factors[0]}_pos") - F.col(f"{factors[1]}_pos"))) if len(factors) > 1 else out


def side_training(df: DataFrame, width: int, cores: list[str], side: str) -> DataFrame:
    """K21 whole: df(key, sequence, score) -> (window, score): windows of `width` with one of the cores (of one length) at the left or right end or in the centre, and the median score of the sequences that hold them."""
    size = len(cores[0])
    at = {"left": 0, "centre": (width - size) // 2, "right": width - size}
    if side not in at:
        raise ValueError(f"side is one of {', '.join(at)}")
    starts = df.where(F.length("sequence") >= width).select("sequence", "score", F.explode(F.expr(f"sequence(0, length(sequence) - {width})")).alias("i"))
    cut = starts.where(F.expr(f"substring(sequence, i + {at[side] + 1}, {size})").isin(cores)).select(F.expr(f"substring(sequence, i + 1, {width})").alias("window"), "score")
    return quantiles(cut, ["window"], "score", {"score": 0.5})
