"""Queries of tests with p values, curves by fold, estimators and affinity regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.operators import models as op
from bindframe.operators import sites as site
from bindframe.operators.tables import stratified_folds
from bindframe.plans.replicates import BASE, KEYS, _values
from bindframe.plans.replicates import ORACLE_SQL as REPLICATES_SQL
from bindframe.plans.sites import _scored
from bindframe.sources import views as v
from bindframe.sources.shared import saved

FEATURES = ["str_score", "wk_score", "distance", "probability"]
FOLDS = 3


def _is() -> Column:
    return F.col("label") == "cooperative"


def _dealt(s: SparkSession, d: str) -> DataFrame:
    return stratified_folds(v.pairs(s, d), 10)


def _train(s: SparkSession, d: str) -> DataFrame:
    parts = [site.core_centred_training(_scored(s, d), 8, [core]).withColumn("core", F.lit(core)) for core in ("GGAA", "GGAT")]
    return parts[0].unionByName(parts[1])


def _affinity(s: SparkSession, d: str) -> op.Affinity:
    return op.affinity_regression(_train(s, d), [0.1, 1.0, 10.0, 100.0], 8)


def _estimators() -> dict:
    return {"logistic": op.classifier("logistic", maxIter=20), "tree": op.classifier("tree", maxDepth=4), "forest": op.classifier("forest", numTrees=8, maxDepth=4), "bayes": op.classifier("bayes")}


def _top(s: SparkSession, d: str) -> DataFrame:
    ranked, folds = op.refit_on_top(v.pairs(s, d), FEATURES, _is(), op.classifier("forest", numTrees=8, maxDepth=4), 2, FOLDS)
    top = ",".join(name for name, _ in ranked[:2])
    return folds.withColumn("features", F.lit(top))


def _routed(s: SparkSession, d: str) -> DataFrame:
    # written once, since every fit and the prediction read it
    data = saved(op.feature_rows(v.pairs(s, d), FEATURES[2:], _is(), FOLDS, keep=("name", "orientation")))
    fitted = {o: op.classifier("logistic", maxIter=20).fit(data.where(F.col("orientation") == o)) for o in ("HH", "TT", "HT/TH")}
    return op.predict_by(data, "orientation", fitted).select("name", "orientation", "label", "score")


def _table(s: SparkSession, d: str) -> DataFrame:
    data = saved(op.feature_rows(v.pairs(s, d), FEATURES, _is(), FOLDS))
    return op.score_table(data, {"forest": op.classifier("forest", numTrees=4, maxDepth=3).fit(data), "bayes": op.classifier("bayes").fit(data)}).drop("features", "y", "fold")


QUERIES = {
    "a20_t_test": lambda s, d: op.t_test(_values(s, d), KEYS),
    "a20_t_test_greater": lambda s, d: op.t_test(_values(s, d), KEYS, "greater", pooled=True),
    "a11_wald_fit": lambda s, d: op.wald_fit(v.probes(s, d), "quantity", "intensity").drop("t", "stderr"),
    "a24_exact_association": lambda s, d: op.exact_association(v.pairs(s, d), F.col("distance") > 14, F.col("orientation") == "HH").select("a", "b", "c", "d", "p_fisher"),
    "m5_mean_curve": lambda s, d: op.mean_curve(_dealt(s, d), "fold", "probability", _is()),
    "m6_fold_scores": lambda s, d: op.fold_scores(_dealt(s, d), ["fold"], "probability", _is()),
    "m3_estimators": lambda s, d: op.cross_validated(op.feature_rows(v.pairs(s, d), FEATURES, _is(), FOLDS), _estimators(), FOLDS, repeats=2),
    "m4_refit_on_top": _top,
    "m7_predict_by_orientation": _routed,
    "m13_score_table": _table,
    "m11_affinity_regression": lambda s, d: _affinity(s, d).choice,
    "m12_feature_weights": lambda s, d: op.feature_weights(_affinity(s, d).weights, 8, 2),
}

#: Two-sided p of t by the continued fraction of the incomplete beta function, from columns t and dof of a table q.
_SAFE = lambda x: f"CASE WHEN abs({x}) < 1e-300 THEN 1e-300 ELSE {x} END"


def _t_sql(source: str) -> str:
    """CTEs that add p, two-sided, to a table with unique rows (rid, t, dof): the fraction's steps as a recursive table."""
    return f"""
bx AS (SELECT *, dof / (dof + t * t) AS x0 FROM {source}),
bt AS (SELECT *, x0 >= (dof / 2 + 1) / (dof / 2 + 2.5) AS turn FROM bx),
bp AS (SELECT *, CASE WHEN turn THEN 0.5 ELSE dof / 2 END::DOUBLE AS a, CASE WHEN turn THEN dof / 2 ELSE 0.5 END::DOUBLE AS b, CASE WHEN turn THEN 1 - x0 ELSE x0 END::DOUBLE AS x FROM bt),
fr AS (
  SELECT rid, a, b, x, 0 AS m, 1.0::DOUBLE AS c, 1 / ({_SAFE('(1 - (a + b) * x / (a + 1))')}) AS d, 1 / ({_SAFE('(1 - (a + b) * x / (a + 1))')}) AS h FROM bp
  UNION ALL
  SELECT rid, a, b, x, m, c2, d2, h1 * c2 * d2 FROM (
    SELECT *, 1 / ({_SAFE('(1 + od * d1)')}) AS d2, {_SAFE('(1 + od / c1)')} AS c2 FROM (
      SELECT *, h * c1 * d1 AS h1 FROM (
        SELECT rid, a, b, x, m, h, od, 1 / ({_SAFE('(1 + ev * d)')}) AS d1, {_SAFE('(1 + ev / c)')} AS c1 FROM (
          SELECT rid, a, b, x, m + 1 AS m, c, d, h, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS ev, -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS od FROM fr WHERE m < 400))))
), pv AS (
  SELECT bp.*, CASE WHEN x0 <= 0 THEN 0.0 WHEN x0 >= 1 THEN 1.0 WHEN turn THEN 1 - front * h / a ELSE front * h / a END AS p2
  FROM (SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) AS front FROM bp) bp JOIN (SELECT rid AS r2, h FROM fr WHERE m = 400) f ON f.r2 = bp.rid)"""


_RECURSIVE = BASE.replace("WITH ", "WITH RECURSIVE ", 1)
_STEPS = """c AS (SELECT fold, probability AS score, count(*) FILTER (label = 'cooperative') AS p, count(*) FILTER (label <> 'cooperative') AS n FROM folds GROUP BY ALL),
s AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY fold) AS tp, sum(n) OVER (PARTITION BY fold) AS tn FROM c WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
g AS (SELECT fold, p::DOUBLE AS p, n::DOUBLE AS n, cp::DOUBLE AS cp, cn::DOUBLE AS cn, tp::DOUBLE AS tp, tn::DOUBLE AS tn, score, (cn - n)::DOUBLE / tn AS l, cn::DOUBLE / tn AS r, (cp - p)::DOUBLE / tp AS lo, cp::DOUBLE / tp AS hi FROM s)"""
_FOLDS = f"{v.with_views('pairs')}, folds AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(name)) % 10 AS fold FROM pairs), {_STEPS}"

ORACLE_SQL = {
    "a20_t_test": f"{_RECURSIVE}, tt AS (SELECT name || ':' || ori AS rid, * FROM ({REPLICATES_SQL['a20_welch_test']})), {_t_sql('tt')} SELECT name, ori, t, dof, p2 AS p FROM pv",
    "a20_t_test_greater": f"{_RECURSIVE}, tt AS (SELECT name || ':' || ori AS rid, * FROM ({REPLICATES_SQL['a20_pooled_test']})), {_t_sql('tt')} SELECT name, ori, t, dof, CASE WHEN t >= 0 THEN p2 / 2 ELSE 1 - p2 / 2 END AS p FROM pv",
    "a11_wald_fit": f"{_RECURSIVE}, tt AS (SELECT 1 AS rid, *, (n - 2)::DOUBLE AS dof FROM ({REPLICATES_SQL['a11_linear_fit']})), {_t_sql('tt')} SELECT slope, intercept, n, p2 AS p FROM pv",
    "a24_exact_association": f"""{v.with_views('pairs')}, t AS (SELECT count(*) FILTER (x AND y)::DOUBLE AS a, count(*) FILTER (x AND NOT y)::DOUBLE AS b, count(*) FILTER (NOT x AND y)::DOUBLE AS c, count(*) FILTER (NOT x AND NOT y)::DOUBLE AS d FROM (SELECT distance > 14 AS x, orientation = 'HH' AS y FROM pairs)),
k AS (SELECT *, unnest(range(greatest(0, (a + a + b + c - (a + b + c + d)))::BIGINT, least(a + b, a + c)::BIGINT + 1))::DOUBLE AS x FROM t),
l AS (SELECT *, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) AS f FROM k),
w AS (SELECT *, f - lgamma(x+1) - lgamma(a+b-x+1) - lgamma(a+c-x+1) - lgamma(d-a+x+1) AS ln, f - lgamma(a+1) - lgamma(b+1) - lgamma(c+1) - lgamma(d+1) AS own FROM l)
SELECT a, b, c, d, least(1.0, sum(exp(ln)) FILTER (ln <= own + 1e-7)) AS p_fisher FROM w GROUP BY ALL""",
    "m5_mean_curve": f"""{_FOLDS},
q AS (SELECT g.fold, k, (cp - p + (k * tn / 100 - (cn - n)) * p / n) / tp AS tpr FROM g, range(0, 101) z(k) WHERE n > 0 AND 100 * (cn - n) <= k * tn AND k * tn < 100 * cn UNION ALL SELECT DISTINCT fold, 100, 1.0 FROM g)
SELECT k / 100 AS fpr, avg(tpr) AS tpr, count(*) AS folds FROM q GROUP BY k""",
    "m6_fold_scores": f"""{_FOLDS}, a AS (SELECT fold, sum((r - l) * (lo + hi) / 2) AS auc, sum(CASE WHEN l < 0.1 THEN (least(r, 0.1) - l) * (lo + lo + CASE WHEN r > l THEN (least(r, 0.1) - l) / (r - l) ELSE 1 END * (hi - lo)) / 2 ELSE 0 END) AS part,
  sum(p / tp * cp / (cp + cn)) AS average_precision, sum(n) FILTER (score < 0.5) AS tn, sum(n) FILTER (score >= 0.5) AS fp, sum(p) FILTER (score < 0.5) AS fn, sum(p) FILTER (score >= 0.5) AS tp FROM g GROUP BY fold)
SELECT fold, auc, 0.5 * (1 + (part - 0.005) / (0.1 - 0.005)) AS partial_auc, average_precision, (tp + tn) / (tn + fp + fn + tp) AS accuracy, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM a""",
}
