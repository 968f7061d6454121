"""Labels from both orientations together, and variants against their group's wild type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIENTATIONS = ("o1", "o2")
TYPES = ("m1", "m2", "m3", "wt")


def orientation_table(medians: DataFrame, tests: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """One row a name with all that A32 needs of both orientations: medians(name, ori, type, median), tests(name, ori, p_greater, p_less), cutoffs(ori, cutoff).

    The three tables are counted together by name in one aggregation; names that lack a figure are left out.
    """
    none = F.lit(None).cast("double")
    # two orientations are two rows
    own = medians.join(F.broadcast(cutoffs.where(F.col("ori").isin(*ORIENTATIONS))), "ori").select("name", "ori", "type", "median", "cutoff", none.alias("p_greater"), none.alias("p_less"))
    both = own.unionByName(tests.select("name", "ori", F.lit("p").alias("type"), none.alias("median"), none.alias("cutoff"), "p_greater", "p_less"))
    pick = lambda c, o, t, name: F.max(F.when((F.col("ori") == o) & (F.col("type") == t), F.col(c))).alias(f"{name}_{o}")
    columns = [pick("median", o, t, t) for o in ORIENTATIONS for t in TYPES] + [pick("cutoff", o, "wt", "cutoff") for o in ORIENTATIONS] + [pick(c, o, "p", c) for o in ORIENTATIONS for c in ("p_greater", "p_less")]
    return both.groupBy("name").agg(*columns).dropna()


def classify_combined(wide: DataFrame, p_cut: float = 0.05) -> DataFrame:
    """A row of `orientation_table` -> (name, label, side, indiv, two), one decision over both orientations.

    An orientation is fit if m1, m2 and wt are above its cut-off and m3 is not; a fit one is cooperative if
    its greater test is below p_cut, steric if its less test is, else additive. Cooperative in one and steric in the other is
    a 'conflict'; no fit orientation is 'unfit'; both without a side. Else cooperative goes before steric
    before additive. If both orientations have the label, the side with the larger signal counts, for steric the smaller, o1 of equals.
    two is wt less m3, indiv is m1 and m2 less twice m3, on the side chosen.
    """
    c = lambda name, o: F.col(f"{name}_{o}")
    fit = {o: (c("m1", o) > c("cutoff", o)) & (c("m2", o) > c("cutoff", o)) & (c("wt", o) > c("cutoff", o)) & (c("m3", o) <= c("cutoff", o)) for o in ORIENTATIONS}
    kind = lambda o: F.when(~fit[o], "unfit").when(c("p_greater", o) < p_cut, "cooperative").when(c("p_less", o) < p_cut, "steric").otherwise("additive")
    ready = wide.select(
        "name", *(kind(o).alias(f"kind_{o}") for o in ORIENTATIONS), *((c("wt", o) - c("m3", o)).alias(f"two_{o}") for o in ORIENTATIONS),
        *((c("m1", o) + c("m2", o) - 2 * c("m3", o)).alias(f"indiv_{o}") for o in ORIENTATIONS))
    a, b = F.col("kind_o1"), F.col("kind_o2")
    has = lambda label: (a == label) | (b == label)
    label = F.when(has("cooperative") & has("steric"), "conflict")
    for name in ("cooperative", "steric", "additive"):
        label = label.when(has(name), name)
    first = F.when(F.col("label") == "steric", F.col("two_o1") <= F.col("two_o2")).otherwise(F.col("two_o1") >= F.col("two_o2"))
    side = F.when(F.col("label").isin("conflict", "unfit"), F.lit(None)).when((a == F.col("label")) & ((b != F.col("label")) | first), "o1").otherwise("o2")
    sided = ready.withColumn("label", label.otherwise("unfit")).withColumn("side", side)
    chosen = lambda name: F.when(F.col("side") == "o1", F.col(f"{name}_o1")).when(F.col("side") == "o2", F.col(f"{name}_o2")).alias(name)
    return sided.select("name", "label", "side", chosen("indiv"), chosen("two"))


def combine_chamber_labels(wide: DataFrame, favoured: tuple[str, str]) -> DataFrame:
    """A30, chamber rule: wide(o1, o2, p_o1, p_o2) with `label`.

    A cut-off missed in either orientation is kept; anticooperative if both greater tests have p = 1;
    cooperative or independent if both say so or one does beside an ambiguous one, cooperative also for the favoured pair of labels; else ambiguous.
    """
    a, b = F.col("o1"), F.col("o2")
    pair = lambda x: ((a == x) & b.isin(x, "ambiguous")) | ((a == "ambiguous") & (b == x))
    low = F.when((a == "fail_cutoff") | (b == "fail_cutoff"), "fail_cutoff").when((F.col("p_o1") == 1) & (F.col("p_o2") == 1), "anticooperative")
    label = low.when(pair("cooperative") | ((a == favoured[0]) & (b == favoured[1])), "cooperative").when(pair("independent"), "independent")
    return wide.withColumn("label", label.otherwise("ambiguous"))


def combine_by_cutoffs(wide: DataFrame, strict: float, loose: float) -> DataFrame:
    """A30, two cut-offs either way: wide(p_o1, p_o2) with `label`: cooperative if one p is below the strict cut-off and the other below the loose one; a missing p fails."""
    p, q = F.col("p_o1"), F.col("p_o2")
    low = F.when(p.isNull() | q.isNull() | F.isnan(p) | F.isnan(q), "fail_cutoff").when((p == 1) & (q == 1), "anticooperative")
    return wide.withColumn("label", low.when(((p < strict) & (q < loose)) | ((p < loose) & (q < strict)), "cooperative").otherwise("independent"))


def attach_wild_type(df: DataFrame, keys: list[str], columns: list[str], wild: Column) -> DataFrame:
    """Each row with <column>_wt of its group's wild type (the one row that `wild` marks; of several the least) and <column>_delta.

    Groups without a wild type keep nulls.
    """
    of = lambda c: F.min(F.when(wild, F.struct(*(F.col(x) for x in columns)))).getField(c).alias(f"{c}_wt")
    base = df.groupBy(*keys).agg(*map(of, columns)).select(*(F.col(k).alias(f"_{k}") for k in keys), *(f"{c}_wt" for c in columns))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = df.join(base, on).drop(*(f"_{k}" for k in keys))
    return both.withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_wt") for c in columns})


def residual_keep(df: DataFrame, keys: list[str], x: str, y: str, cut: float, wild: Column) -> DataFrame:
    """Variants whose change of y lies within a distance of the line of all changes on the change of x, the signs agreeing; wild types are always kept.

    The residual is null for wild types. The line is fitted on all variants with a wild type.
    """
    deltas = attach_wild_type(df, keys, [x, y], wild)
    variant = ~wild & F.col(f"{x}_delta").isNotNull() & F.col(f"{y}_delta").isNotNull()
    dx, dy = (F.when(variant, F.col(f"{c}_delta")) for c in (x, y))
    fit = deltas.agg(F.regr_slope(dy, dx).alias("_a"), F.regr_intercept(dy, dx).alias("_b"))
    held = deltas.join(F.broadcast(fit)).withColumn("residual", F.when(variant, F.col(f"{y}_delta") - F.col("_a") * F.col(f"{x}_delta") - F.col("_b")))
    return held.where(wild | ((F.abs("residual") <= cut) & (F.signum(f"{x}_delta") == F.signum(f"{y}_delta")))).drop("_a", "_b")
