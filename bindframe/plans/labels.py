"""Queries of labels from both orientations, and of variants against their wild type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.operators import labels as op
from bindframe.operators.replicates import rank_method, rank_p
from bindframe.plans.replicates import KEYS, LABELLED, TESTS, _labels, _sums
from bindframe.sources import views as v


def _medians(s: SparkSession, d: str) -> DataFrame:
    return v.probes(s, d).groupBy("name", "ori", "type").agg(F.median("intensity").alias("median"), F.median("quantity").alias("quantity"))


def _wide(s: SparkSession, d: str) -> DataFrame:
    sums = _sums(s, d).withColumn("method", rank_method(ties_exact=True))
    tests = sums.select("name", "ori", rank_p("greater").alias("p_greater"), rank_p("less").alias("p_less"))
    cutoffs = v.controls(s, d).groupBy("ori").agg(F.avg("intensity").alias("cutoff"))
    return op.orientation_table(_medians(s, d).select("name", "ori", "type", "median"), tests, cutoffs)


def _both(s: SparkSession, d: str) -> DataFrame:
    pick = lambda c, o: F.max(F.when(F.col("ori") == o, F.col(c)))
    return _labels(s, d).groupBy("name").agg(*(pick("label", o).alias(o) for o in ("o1", "o2")), *(pick("p_greater", o).alias(f"p_{o}") for o in ("o1", "o2"))).where("o1 is not null and o2 is not null")


WILD = "type = 'wt'"

QUERIES = {
    "a32_classify_combined": lambda s, d: op.classify_combined(_wide(s, d), 0.2),
    "a32_conflicts": lambda s, d: op.classify_combined(_wide(s, d), 0.2).groupBy("label", "side").agg(F.count("*").alias("n")),
    "a30_chamber_rule": lambda s, d: op.combine_chamber_labels(_both(s, d), ("independent", "cooperative")),
    "a30_two_cutoffs": lambda s, d: op.combine_by_cutoffs(_both(s, d), 0.1, 0.5),
    "j19_attach_wild_type": lambda s, d: op.attach_wild_type(_medians(s, d), KEYS, ["median", "quantity"], F.expr(WILD)),
    "a13_residual_keep": lambda s, d: op.residual_keep(_medians(s, d), KEYS, "quantity", "median", 20000.0, F.expr(WILD)).select("name", "ori", "type", "residual"),
}

_MED = "med AS (SELECT name, ori, type, median(intensity) AS median, median(quantity) AS quantity FROM probes GROUP BY ALL)"
_DELTA = f"{v.with_views('probes')}, {_MED}, dl AS (SELECT m.*, w.median AS median_wt, w.quantity AS quantity_wt, m.median - w.median AS median_delta, m.quantity - w.quantity AS quantity_delta FROM med m LEFT JOIN (SELECT * FROM med WHERE {WILD}) w USING (name, ori))"
_CELL = ", ".join(f"max(median) FILTER (ori = '{o}' AND type = '{t}') AS {t}_{o}" for o in op.ORIENTATIONS for t in op.TYPES)
_FIT = lambda o: f"(m1_{o} > c_{o} AND m2_{o} > c_{o} AND wt_{o} > c_{o} AND m3_{o} <= c_{o})"
_KIND = lambda o: f"CASE WHEN NOT {_FIT(o)} THEN 'unfit' WHEN g_{o} < 0.2 THEN 'cooperative' WHEN l_{o} < 0.2 THEN 'steric' ELSE 'additive' END"
_CLASSES = f"""{TESTS}, {_MED}, cells AS (SELECT name, {_CELL} FROM med GROUP BY name),
ps AS (SELECT name, max(p) FILTER (ori = 'o1') AS g_o1, max(p) FILTER (ori = 'o2') AS g_o2, max(p_less) FILTER (ori = 'o1') AS l_o1, max(p_less) FILTER (ori = 'o2') AS l_o2 FROM tests GROUP BY name),
cu AS (SELECT avg(intensity) FILTER (ori = 'o1') AS c_o1, avg(intensity) FILTER (ori = 'o2') AS c_o2 FROM controls),
kd AS (SELECT name, {_KIND('o1')} AS a, {_KIND('o2')} AS b, wt_o1 - m3_o1 AS two_o1, wt_o2 - m3_o2 AS two_o2, m1_o1 + m2_o1 - 2 * m3_o1 AS indiv_o1, m1_o2 + m2_o2 - 2 * m3_o2 AS indiv_o2 FROM cells JOIN ps USING (name), cu),
ld AS (SELECT *, CASE WHEN a = 'cooperative' AND b = 'cooperative' THEN CASE WHEN two_o1 >= two_o2 THEN 'cooperative:o1' ELSE 'cooperative:o2' END
  WHEN a = 'cooperative' THEN CASE WHEN b = 'steric' THEN 'conflict:' ELSE 'cooperative:o1' END WHEN b = 'cooperative' THEN CASE WHEN a = 'steric' THEN 'conflict:' ELSE 'cooperative:o2' END
  WHEN a = 'steric' AND b = 'steric' THEN CASE WHEN two_o1 <= two_o2 THEN 'steric:o1' ELSE 'steric:o2' END WHEN a = 'steric' THEN 'steric:o1' WHEN b = 'steric' THEN 'steric:o2'
  WHEN a = 'additive' AND b = 'additive' THEN CASE WHEN two_o1 >= two_o2 THEN 'additive:o1' ELSE 'additive:o2' END WHEN a = 'additive' THEN 'additive:o1' WHEN b = 'additive' THEN 'additive:o2' ELSE 'unfit:' END AS l FROM kd),
cl AS (SELECT name, split_part(l, ':', 1) AS label, nullif(split_part(l, ':', 2), '') AS side, CASE split_part(l, ':', 2) WHEN 'o1' THEN indiv_o1 WHEN 'o2' THEN indiv_o2 END AS indiv, CASE split_part(l, ':', 2) WHEN 'o1' THEN two_o1 WHEN 'o2' THEN two_o2 END AS two FROM ld)"""
_BOTH = f"{LABELLED}, bo AS (SELECT a.name, a.label AS o1, b.label AS o2, a.p_greater AS p_o1, b.p_greater AS p_o2 FROM lab a JOIN lab b ON a.name = b.name AND a.ori = 'o1' AND b.ori = 'o2')"

ORACLE_SQL = {
    "a32_classify_combined": f"{_CLASSES} SELECT * FROM cl",
    "a32_conflicts": f"{_CLASSES} SELECT label, side, count(*) AS n FROM cl GROUP BY ALL",
    "a30_chamber_rule": f"""{_BOTH} SELECT *, CASE WHEN o1 = 'fail_cutoff' OR o2 = 'fail_cutoff' THEN 'fail_cutoff' WHEN p_o1 = 1 AND p_o2 = 1 THEN 'anticooperative'
  WHEN (o1, o2) IN (('cooperative', 'cooperative'), ('cooperative', 'ambiguous'), ('ambiguous', 'cooperative'), ('independent', 'cooperative')) THEN 'cooperative'
  WHEN (o1, o2) IN (('independent', 'independent'), ('independent', 'ambiguous'), ('ambiguous', 'independent')) THEN 'independent' ELSE 'ambiguous' END AS label FROM bo""",
    "a30_two_cutoffs": f"{_BOTH} SELECT *, CASE WHEN p_o1 IS NULL OR p_o2 IS NULL THEN 'fail_cutoff' WHEN p_o1 = 1 AND p_o2 = 1 THEN 'anticooperative' WHEN least(p_o1, p_o2) < 0.1 AND greatest(p_o1, p_o2) < 0.5 THEN 'cooperative' ELSE 'independent' END AS label FROM bo",
    "j19_attach_wild_type": f"{_DELTA} SELECT * FROM dl",
    "a13_residual_keep": f"{_DELTA}, ft AS (SELECT regr_slope(median_delta, quantity_delta) AS a, regr_intercept(median_delta, quantity_delta) AS b FROM dl WHERE type <> 'wt'), rs AS (SELECT dl.*, CASE WHEN type <> 'wt' THEN median_delta - a * quantity_delta - b END AS residual FROM dl, ft) SELECT name, ori, type, residual FROM rs WHERE type = 'wt' OR (abs(residual) <= 20000 AND sign(quantity_delta) = sign(median_delta))",
}
