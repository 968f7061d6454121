"""Replicate tables (name, type, ori, rep, intensity): combinations, cut-offs, rank tests, labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bindframe.functions.ranks import TYPES, rank_sums_of
from bindframe.operators.curves import adjusted_p, quantiles


def median_by(df: DataFrame, keys: list[str], col: str = "intensity") -> DataFrame:
    """A3."""
    return df.groupBy(*keys).agg(F.median(col).alias("median"))


def negative_cutoff(controls: DataFrame, q: float = 0.95) -> DataFrame:
    """A4: a quantile (linear interpolation) of the medians of each control name; one row."""
    return quantiles(median_by(controls, ["name"]), [], "median", {"cutoff": q})


def type_profile(df: DataFrame) -> DataFrame:
    """A5: mean and median of each (name, type), types as columns."""
    return df.groupBy("name").pivot("type", ["m1", "m2", "m3", "wt"]).agg(F.mean("intensity").alias("mean"), F.median("intensity").alias("median"))


def pivot_replicates(df: DataFrame) -> DataFrame:
    """One row per (name, type) with columns o1_r1.. and medians."""
    cells = df.withColumn("_c", F.concat("ori", F.lit("_r"), F.col("rep").cast("string")))
    wide = cells.groupBy("name", "type").pivot("_c", [f"{o}_r{r}" for o in ("o1", "o2") for r in (1, 2, 3)]).agg(F.first("intensity"))
    medians = df.groupBy("name", "type").agg(F.median("intensity").alias("median"), *[F.median(F.when(F.col("ori") == o, F.col("intensity"))).alias(f"median_{o}") for o in ("o1", "o2")])
    return wide.join(medians, ["name", "type"])


def unpivot_array(wide: DataFrame) -> DataFrame:
    """Wide replicate columns back to (ori, rep, intensity) rows; medians are dropped."""
    cells = [f"{o}_r{r}" for o in ("o1", "o2") for r in (1, 2, 3)]
    long = wide.unpivot(["name", "type"], cells, "cell", "intensity").where("intensity is not null")
    return long.select("name", "type", F.split("cell", "_r")[0].alias("ori"), F.split("cell", "_r")[1].cast("int").alias("rep"), "intensity")


def replicate_combinations(df: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """m1 x m2 x m3 of a (name, ori), value m1 + m2 - m3, and the wild-type values: (name, ori, kind, value).

    One shuffle brings a group's replicates together, and its combinations, of which there are as many as the product
    of three of them, are made in its row. `also` names further aggregates of df to come out on every row of the group.
    """
    of = lambda t: F.collect_list(F.when(F.col("type") == t, F.struct(F.col("intensity").alias("v")))).alias(f"_{t}")
    cells = df.groupBy("name", "ori").agg(*(of(t) for t in ("m1", "m2", "m3", "wt")), *(c.alias(n) for n, c in (also or {}).items()))
    joined = F.flatten(F.transform("_m1", lambda a: F.flatten(F.transform("_m2", lambda b: F.transform("_m3", lambda c: F.struct(F.lit("indiv").alias("kind"), (a["v"] + b["v"] - c["v"]).alias("value")))))))
    # null names match nothing, but keep their wild types
    indiv = F.filter(joined, lambda _: F.col("name").isNotNull() & F.col("ori").isNotNull())
    two = F.transform("_wt", lambda w: F.struct(F.lit("two").alias("kind"), w["v"].alias("value")))
    return cells.select("name", "ori", F.explode(F.concat(indiv, two)).alias("_e"), *(also or {})).select("name", "ori", "_e.kind", "_e.value", *(also or {}))


def pair_orientations(df: DataFrame, col: str) -> DataFrame:
    """o1 and o2 rows of a name side by side."""
    return df.groupBy("name").pivot("ori", ["o1", "o2"]).agg(F.first(col)).where("o1 is not null and o2 is not null")


def r_squared(df: DataFrame, x: str, y: str) -> DataFrame:
    """A10."""
    return df.agg((F.corr(x, y) * F.corr(x, y)).alias("r2"), F.count("*").alias("n"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, standard error of the slope and its t value; one row."""
    fit = df.agg(F.expr(f"regr_slope({y}, {x})").alias("slope"), F.expr(f"regr_intercept({y}, {x})").alias("intercept"), F.expr(f"regr_sxx({y}, {x})").alias("sxx"), F.expr(f"regr_syy({y}, {x})").alias("syy"), F.expr(f"regr_sxy({y}, {x})").alias("sxy"), F.count("*").alias("n"))
    error = F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return fit.select("slope", "intercept", error.alias("stderr"), (F.col("slope") / error).alias("t"), "n")


def normalise_chamber(main: DataFrame, second: DataFrame) -> DataFrame:
    """Fit second on main by medians of names, then (y - intercept) / slope on the second chamber."""
    x = median_by(main, ["name"]).withColumnRenamed("median", "x")
    y = median_by(second, ["name"]).withColumnRenamed("median", "y")
    fit = linear_fit(x.join(y, "name"), "x", "y").select("slope", "intercept")
    return second.join(F.broadcast(fit)).withColumn("intensity", (F.col("intensity") - F.col("intercept")) / F.col("slope")).drop("slope", "intercept")


def rank_sums(df: DataFrame, keys: list[str], first: str = "two", second: str = "indiv", also: dict[str, Column] | None = None) -> DataFrame:
    """Sizes, U of the first kind, and tie terms of (keys, kind, value) groups: from mean ranks in a window over the group. `also` names further aggregates."""
    by = W.partitionBy(*keys)
    ranked = df.withColumn("_t", F.count("*").over(W.partitionBy(*keys, "value"))).withColumn("_r", F.rank().over(by.orderBy("value")) + (F.col("_t") - 1) / 2)
    a = F.col("kind") == first
    sums = ranked.groupBy(*keys).agg(F.sum(a.cast("long")).alias("m"), F.sum((F.col("kind") == second).cast("long")).alias("n"), F.sum(F.when(a, F.col("_r"))).alias("_sum"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties"), *(c.alias(n) for n, c in (also or {}).items()))
    return sums.where("m > 0 and n > 0").withColumn("u", F.col("_sum") - F.col("m") * (F.col("m") + 1) / 2).drop("_sum")


def replicate_rank_sums(df: DataFrame) -> DataFrame:
    """`rank_sums` of `replicate_combinations` of df(name, type, ori, intensity), with median_two, median_indiv and m3, the median of that type.

    One shuffle brings a group's replicates together; its combinations are made and ranked in a batch of groups and never become rows.
    """
    cell = F.struct((F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")) - 1).cast("int").alias("t"), F.col("intensity").cast("double").alias("v"))
    known = df.where(F.col("name").isNotNull() & F.col("ori").isNotNull() & F.col("type").isin(*TYPES))
    cells = known.groupBy("name", "ori").agg(F.collect_list(cell).alias("_cells"))
    # by way of a generator, so that the filter does not take a copy of the call along
    sums = cells.select("name", "ori", F.explode(F.array(rank_sums_of(F.col("_cells")))).alias("_s"))
    return sums.select("name", "ori", "_s.m", "_s.n", "_s.ties", "_s.u", "_s.median_two", "_s.median_indiv", "_s.m3").where("m > 0 and n > 0")


def null_counts(m: int, n: int) -> list[int]:
    """How many of the orders of m and n values have each U: the recurrence on the largest value."""
    table: dict[tuple[int, int], list[int]] = {}
    for i in range(m + 1):
        for j in range(n + 1):
            row = [0] * (i * j + 1)
            if i == 0 or j == 0:
                row[0] = 1
            else:
                for u, c in enumerate(table[i - 1, j]):
                    row[u + j] += c
                for u, c in enumerate(table[i, j - 1]):
                    row[u] += c
            table[i, j] = row
    return table[m, n]


#: Values a side below which a rank test without ties is exact.
EXACT_BELOW = 50


@F.pandas_udf(DoubleType())
def exact_greater(m: pd.Series, n: pd.Series, u: pd.Series) -> pd.Series:
    """P(U >= u) of the Mann-Whitney statistic of m and n values without ties; null sizes have none."""
    out = np.full(len(m), np.nan)
    held = m.notna().to_numpy()
    sizes = np.stack([m[held].to_numpy(np.int64), n[held].to_numpy(np.int64)], axis=1)
    at, values = np.flatnonzero(held), np.ceil(u[held].to_numpy("float64")).astype(np.int64)
    shapes, of = np.unique(sizes, axis=0, return_inverse=True)
    for i, (a, b) in enumerate(shapes.tolist()):
        counts = null_counts(a, b)
        total, run, tail = sum(counts), 0, []
        for c in reversed(counts):
            run += c
            tail.append(run / total)
        mine = of.ravel() == i
        out[at[mine]] = np.array(tail[::-1])[values[mine]]
    return pd.Series(out).where(held, None)


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the Chebyshev fit of the complementary error function in Numerical Recipes (erfcc; relative error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly: Column = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    half = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def rank_method(ties_exact: bool = False) -> Column:
    """How the p of a row of `rank_sums` is worked out: exact below 50 values a side, without ties or, on demand, with them; else normal, or constant where all values are equal."""
    total = F.col("m") + F.col("n")
    exact = (F.col("m") < EXACT_BELOW) & (F.col("n") < EXACT_BELOW) & (F.lit(ties_exact) | (F.col("ties") == 0))
    # as `sigma` below, which is 0 where all values are one
    return F.when(exact, "exact").when(total + 1 - F.col("ties") / (total * (total - 1)) > 0, "normal").otherwise("constant")


def rank_p(side: str = "greater") -> Column:
    """The p of one side from a row of `rank_sums` with its `method`; an exact one counts orders with U at the observed value, rounded up, or more."""
    total = F.col("m") + F.col("n")
    u = F.col("u") if side == "greater" else F.col("m") * F.col("n") - F.col("u")
    sigma = F.sqrt(F.col("m") * F.col("n") / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = (u - F.col("m") * F.col("n") / 2 - 0.5) / sigma
    if_exact = lambda c: F.when(F.col("method") == "exact", c)
    return F.when(F.col("method") == "exact", exact_greater(if_exact(F.col("m")), if_exact(F.col("n")), if_exact(u))).when(F.col("method") == "normal", normal_tail(z)).otherwise(1.0)


def rank_test(df: DataFrame, keys: list[str], side: str = "greater", first: str = "two", second: str = "indiv", ties_exact: bool = False) -> DataFrame:
    """Mann-Whitney of (keys, kind, value) groups: exact below 50 values a side without ties, else normal with tie and continuity correction.

    (keys, m, n, u, method, p); p is 1 where all values are equal. With ties_exact small groups with ties
    are exact too, by the distribution without ties and the mean ranks' U rounded up.
    """
    return rank_p_of(rank_sums(df, keys, first, second), side, ties_exact)


def rank_p_of(sums: DataFrame, side: str = "greater", ties_exact: bool = False) -> DataFrame:
    """A row of `rank_sums` with method and p in place of its tie terms."""
    return sums.withColumn("method", rank_method(ties_exact)).withColumn("p", rank_p(side)).drop("ties")


def fdr(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg within the keys; null p counts as 1."""
    return adjusted_p(df, keys, F.coalesce(F.col(p), F.lit(1.0)))


def coop_labels(df: DataFrame, cutoff: DataFrame, p_cut: float = 0.015, p_band: float = 0.105, ties_exact: bool = False) -> DataFrame:
    """(name, ori, median_two, median_indiv, p_greater, p_less, label) for names with 27 combinations and 3 wild types.

    Fails where the wild type's median is below the cut-off, or m3's above it; then
    cooperative, anticooperative, ambiguous (up to p_band) or independent.
    """
    full = replicate_rank_sums(df).where("m = 3 and n = 27").withColumn("method", rank_method(ties_exact))
    joined = full.withColumns({"p_greater": rank_p("greater"), "p_less": rank_p("less")}).join(F.broadcast(cutoff))
    failed = (F.col("median_two") < F.col("cutoff")) | (F.col("m3") > F.col("cutoff"))
    label = F.when(failed, "fail_cutoff").when(F.col("p_greater") < p_cut, "cooperative").when(F.col("p_less") < p_cut, "anticooperative").when(F.least("p_greater", "p_less") <= p_band, "ambiguous").otherwise("independent")
    return joined.select("name", "ori", "median_two", "median_indiv", "p_greater", "p_less", label.alias("label"))


def combine_orientation_labels(wide: DataFrame, rule: str = "strict") -> DataFrame:
    """One label from o1 and o2: 'strict' the same one; 'ambiguous' independent also beside ambiguous; 'either' cooperative in one is enough."""
    a, b = F.col("o1"), F.col("o2")
    same = F.when(a == b, a)
    if rule == "ambiguous":
        same = F.coalesce(same, F.when(a.isin("independent", "ambiguous") & b.isin("independent", "ambiguous"), "independent"))
    if rule == "either":
        same = F.when((a == "cooperative") | (b == "cooperative"), "cooperative").otherwise(same)
    return wide.withColumn("label", F.coalesce(same, F.lit("ambiguous")))


def fdr_relabel(df: DataFrame, cut: float) -> DataFrame:
    """The label holds only where the corrected p is below the cut, else independent."""
    return df.withColumn("label", F.when(F.col("label").isin("cooperative", "anticooperative") & (F.col("p_adjusted") >= cut), "independent").otherwise(F.col("label")))


def welch_test(df: DataFrame, keys: list[str], pooled: bool = False) -> DataFrame:
    """T and degrees of freedom of (keys, kind two/indiv, value) groups, Welch or pooled."""
    part = lambda k: F.when(F.col("kind") == k, F.col("value"))
    s = df.groupBy(*keys).agg(*[f(part(k)).alias(f"{n}_{k}") for k in ("two", "indiv") for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    va, vb = F.col("var_two") / F.col("n_two"), F.col("var_indiv") / F.col("n_indiv")
    if pooled:
        dof = F.col("n_two") + F.col("n_indiv") - 2
        v = ((F.col("n_two") - 1) * F.col("var_two") + (F.col("n_indiv") - 1) * F.col("var_indiv")) / dof
        error = F.sqrt(v * (1 / F.col("n_two") + 1 / F.col("n_indiv")))
    else:
        dof = (va + vb) * (va + vb) / (va * va / (F.col("n_two") - 1) + vb * vb / (F.col("n_indiv") - 1))
        error = F.sqrt(va + vb)
    return s.where(error > 0).select(*keys, ((F.col("mean_two") - F.col("mean_indiv")) / error).alias("t"), dof.cast("double").alias("dof"))


def configuration_table(df: DataFrame) -> DataFrame:
    """Count of each (distance, orientation, label), percentage in its (distance, orientation), medians of both strengths."""
    by = ["distance", "orientation", "label"]
    both = quantiles(df, by, "str_score", {"str_median": 0.5}), quantiles(df, by, "wk_score", {"wk_median": 0.5})
    out = df.groupBy(*by).agg(F.count("*").alias("n")).join(both[0], by, "left").join(both[1], by, "left")
    return out.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy("distance", "orientation")))


def label_share(df: DataFrame, by: str, label: str) -> DataFrame:
    """The share of a label in each group, with count and median strength."""
    shares = df.groupBy(by).agg(F.avg((F.col("label") == label).cast("double")).alias("share"), F.count("*").alias("n"))
    return shares.join(quantiles(df, [by], "str_score", {"median": 0.5}), by, "left")


def category_table(df: DataFrame, x: str, labels: list[str]) -> DataFrame:
    """Count of labels in each category, missing cells 0."""
    return df.groupBy(x).pivot("label", labels).count().fillna(0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, matches and percentage for each class of a."""
    return df.groupBy(F.col(a).alias("class")).agg(F.count("*").alias("n"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("matches")).withColumn("percent", 100 * F.col("matches") / F.col("n"))


def constraint_violations(wide: DataFrame, low: float, high: float) -> DataFrame:
    """How many names break each cut-off rule; one row."""
    bad = {"wt_low": F.col("wt_median") < low, "m3_high": F.col("m3_median") > high, "m1_above_wt": F.col("m1_median") > F.col("wt_median"), "m2_above_wt": F.col("m2_median") > F.col("wt_median")}
    return wide.agg(*[F.sum(c.cast("long")).alias(n) for n, c in bad.items()], F.count("*").alias("n"))


def inconsistent_labels(wide: DataFrame) -> DataFrame:
    """Names for each ordered pair of different labels of o1 and o2."""
    return wide.where("o1 <> o2").groupBy("o1", "o2").agg(F.count("*").alias("n"))


def p_value_distribution(df: DataFrame, p: str = "p") -> DataFrame:
    """A34."""
    return df.groupBy(F.round(p, 4).alias("p")).agg(F.count("*").alias("n"))


def association_test(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """The 2 x 2 table of two conditions and its chi-square with and without continuity correction; one row."""
    cell = lambda i, j: F.sum(((x == i) & (y == j)).cast("double"))
    t = df.agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    cross = F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c"))
    under = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    yates = F.greatest(cross - n / 2, F.lit(0.0))
    return t.select("a", "b", "c", "d", (n * cross * cross / under).alias("chi2"), (n * yates * yates / under).alias("chi2_corrected"))


def label_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common names of two label tables and how many agree, with the names that only one has; one row."""
    both = a.select("name", F.col("label").alias("x")).join(b.select("name", F.col("label").alias("y")), "name", "full")
    return both.agg(F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("long")).alias("common"), F.sum(F.coalesce((F.col("x") == F.col("y")).cast("long"), F.lit(0))).alias("agree"), F.sum(F.col("y").isNull().cast("long")).alias("only_a"), F.sum(F.col("x").isNull().cast("long")).alias("only_b"))
