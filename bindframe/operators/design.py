"""Bulk mutation of probes (key, sequence, pos_1, pos_2) and rows for array design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindframe.functions.calling import Caller, number_array
from bindframe.functions.sequences import reverse_complement


def overlay(seq: Column, at: Column, new: Column) -> Column:
    """seq with `new` written over it from position `at` (from 0)."""
    return F.concat(F.substring(seq, F.lit(1), at.cast("int")), new, F.substring(seq, (at + F.length(new) + 1).cast("int"), F.length(seq)))


def mutate_core(df: DataFrame, cores: list[str]) -> DataFrame:
    """Each site's core replaced by each other core of the same length: (key, site, core, sequence)."""
    width = len(cores[0])
    at = F.col("at")
    sites = df.select("key", "sequence", F.posexplode(F.array("pos_1", "pos_2")).alias("site", "at"))
    old = F.substring("sequence", (at + 1).cast("int"), F.lit(width))
    spread = sites.where(F.length(old) == width).withColumn("core", F.explode(F.array(*map(F.lit, cores)))).where(F.col("core") != old)
    return spread.select("key", (F.col("site") + 1).alias("site"), "core", overlay(F.col("sequence"), at, F.col("core")).alias("sequence"))


def mutate_flank(df: DataFrame, core: int, n: int) -> DataFrame:
    """I4: every single-base change within n bases beside each core: (key, site, position, base, sequence)."""
    sites = df.select("key", "sequence", F.posexplode(F.array("pos_1", "pos_2")).alias("site", "at"))
    near = F.concat(F.sequence(F.lit(1), F.lit(n)), F.sequence(F.lit(-core), F.lit(-core - n + 1), F.lit(-1)))
    spread = sites.withColumn("position", F.explode(F.transform(near, lambda d: F.col("at") - d))).where((F.col("position") >= 0) & (F.col("position") < F.length("sequence")))
    spread = spread.withColumn("base", F.explode(F.array(*map(F.lit, "ACGT")))).where(F.col("base") != F.substring("sequence", (F.col("position") + 1).cast("int"), F.lit(1)))
    return spread.select("key", (F.col("site") + 1).alias("site"), "position", "base", overlay(F.col("sequence"), F.col("position"), F.col("base")).alias("sequence"))


def mutate_distance(df: DataFrame, core: int, least: int) -> DataFrame:
    """The second site moved left base by base down to a least distance; the bases it passes go behind it."""
    gap = F.col("pos_2") - F.col("pos_1")
    spread = df.where(gap > least).select("*", F.explode(F.sequence(F.lit(1), gap - least)).alias("step"))
    sub = lambda a, n: F.substring("sequence", a.cast("int"), n.cast("int"))
    new = F.concat(sub(F.lit(1), F.col("pos_2") - F.col("step")), sub(F.col("pos_2") + 1, F.lit(core)), sub(F.col("pos_2") - F.col("step") + 1, F.col("step")), sub(F.col("pos_2") + core + 1, F.length("sequence")))
    return spread.select("key", (gap - F.col("step")).alias("distance"), new.alias("sequence"))


def mutate_orientation(df: DataFrame, core: int) -> DataFrame:
    """One or both cores turned to their reverse complement: (key, turned, sequence)."""
    turn = lambda seq, at: overlay(seq, at, reverse_complement(F.substring(seq, (at + 1).cast("int"), F.lit(core))))
    s, a, b = F.col("sequence"), F.col("pos_1"), F.col("pos_2")
    ways = F.array(F.struct(F.lit("1").alias("turned"), turn(s, a).alias("sequence")), F.struct(F.lit("2").alias("turned"), turn(s, b).alias("sequence")), F.struct(F.lit("12").alias("turned"), turn(turn(s, a), b).alias("sequence")))
    return df.where(F.col("pos_2") - F.col("pos_1") >= core).select("key", F.explode(ways).alias("w")).select("key", "w.*")


def wild_type_rows(df: DataFrame) -> DataFrame:
    """Each sequence once for every kind of mutation."""
    return df.select("key", F.explode(F.array(*map(F.lit, ("affinity", "distance", "orientation")))).alias("muttype"), "sequence")


def array_rows(df: DataFrame, primer: str, replicates: int) -> DataFrame:
    """Orientation x replicate rows with the primer behind; o2 is the reverse complement."""
    ways = F.array(F.struct(F.lit("o1").alias("ori"), F.col("sequence").alias("s")), F.struct(F.lit("o2").alias("ori"), reverse_complement(F.col("sequence")).alias("s")))
    return df.select("key", F.explode(ways).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).select("key", "w.ori", "rep", F.concat("w.s", F.lit(primer)).alias("sequence"))


def weakest_abolishing_core(df: DataFrame, caller: Caller) -> DataFrame:
    """I9 without a second call: of the single-base changes that lower the score of a sequence's only site, the weakest; ties by position, then base.

    (key, position, base, before, after). What is best depends on the core alone, so it is a table of all
    cores that the site's own window is looked up in.
    """
    k, scores = caller.k, caller.scores
    best = []
    for code, before in enumerate(scores):
        ways = [(scores[code + (b - code // 4 ** (k - 1 - i) % 4) * 4 ** (k - 1 - i)], i, b) for i in range(k) for b in range(4)]
        best.append(min((w for w in ways if w[0] < before), default=(before, -1, 0)))
    codes = F.col("_codes")
    called = df.select("key", caller.codes_of(F.col("sequence")).alias("_codes")).select("key", "_codes", caller.sites(codes).alias("_sites"))
    one = called.select("key", F.explode(F.when(F.size("_sites") == 1, F.array(F.struct(F.get("_sites", F.lit(0)).alias("at"), F.get(codes, F.get("_sites", F.lit(0))).alias("code"))))).alias("s"))
    of = lambda j: F.get(number_array([w[j] for w in best]), F.col("s.code"))
    place = of(1).cast("int")
    found = one.where(place >= 0)
    return found.select("key", (F.col("s.at") + place).alias("position"), F.substring(F.lit("ACGT"), of(2).cast("int") + 1, F.lit(1)).alias("base"), caller.score(F.col("s.code")).alias("before"), of(0).alias("after"))


def quiet_sequences(profile: DataFrame, threshold: float) -> DataFrame:
    """I16: keys whose every score is below a threshold."""
    return profile.groupBy("key").agg(F.max("score").alias("best")).where(F.col("best") < threshold)
