"""Tails against numerical integration and enumeration, curves and estimators against plain code, affinity regression against a direct fit."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindframe.functions import tails
from bindframe.operators import labels, models


def test_log_gamma_and_beta(spark):
    xs = [0.05, 0.5, 1.0, 1.5, 7.0, 33.3, 1e3, 1e6, 1e9]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(tails.log_gamma(F.col("x")).alias("v")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-13)
    rows = [(a, b, x) for a in (0.5, 2.0, 13.5, 400.0) for b in (0.5, 3.0, 25.0) for x in (0.0, 0.01, 0.3, 0.77, 0.999, 1.0)]
    found = spark.createDataFrame(rows, "a double, b double, x double").select("*", tails.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("p")).collect()
    for r in found:
        # with x = sin(t)^2 the integrand is smooth
        t = np.linspace(0, math.asin(math.sqrt(r.x)), 200_001)
        y = 2 * np.sin(t) ** (2 * r.a - 1) * np.cos(t) ** (2 * r.b - 1) if r.x else np.zeros_like(t)
        step = t[1] - t[0]
        area = step / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
        assert r.p == pytest.approx(area * math.exp(math.lgamma(r.a + r.b) - math.lgamma(r.a) - math.lgamma(r.b)), abs=1e-9)


def test_t_tails(spark):
    rows = [(0.0, 5.0), (2.570581836, 5.0), (-2.570581836, 5.0), (1.0, 1.0), (12.7062047, 1.0), (1.959963985, 1e9), (1.959963985, 1e13)]
    df = spark.createDataFrame(rows, "t double, dof double")
    got = df.select(*(tails.t_p(F.col("t"), F.col("dof"), s).alias(s) for s in ("two", "greater", "less"))).collect()
    assert [r.two for r in got] == pytest.approx([1, 0.05, 0.05, 0.5, 0.05, 0.05, 0.05], abs=1e-8)
    assert [r.greater for r in got] == pytest.approx([0.5, 0.025, 0.975, 0.25, 0.025, 0.025, 0.025], abs=1e-8)
    assert all(r.greater + r.less == pytest.approx(1) for r in got)


def test_fisher_against_all_tables(spark):
    rnd = random.Random(3)
    rows = [tuple(rnd.randrange(0, 9) for _ in range(4)) for _ in range(30)] + [(0, 0, 0, 0), (5, 0, 0, 5), (3, 0, 4, 0), (60, 5, 7, 90)]
    got = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double").select(*"abcd", tails.fisher_p(*(F.col(x) for x in "abcd")).alias("p")).collect()
    for r in got:
        a, b, c, d = (int(r[x]) for x in "abcd")
        weight = lambda x: math.comb(a + b, x) * math.comb(c + d, a + c - x) if 0 <= a + c - x <= c + d and 0 <= x <= a + b else 0  # noqa: E731, B023
        every = [weight(x) for x in range(a + c + 1)]
        assert r.p == pytest.approx(sum(w for w in every if w <= weight(a)) / sum(every), abs=1e-9)
    large = spark.createDataFrame([(25_010.0, 25_000.0, 25_000.0, 25_000.0)], "a double, b double, c double, d double").select(tails.fisher_p(*(F.col(x) for x in "abcd")).alias("p")).first().p
    assert 0.9 < large < 1


def plain_scores(rows, most=0.1):
    """AUC, partial AUC and average precision of (positive, score) by walking down the scores."""
    p, n = sum(y for y, _ in rows), sum(not y for y, _ in rows)
    cp = cn = 0
    points, precision = [(0.0, 0.0)], 0.0
    for score in sorted({s for _, s in rows}, reverse=True):
        up, down = sum(y for y, s in rows if s == score), sum(not y for y, s in rows if s == score)
        cp, cn = cp + up, cn + down
        precision += up / p * cp / (cp + cn)
        points.append((cn / n, cp / p))
    area = lambda stop: sum((min(b[0], stop) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * ((min(b[0], stop) - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 1)) / 2 for a, b in itertools.pairwise(points) if a[0] < stop)
    return points, area(1), 0.5 * (1 + (area(most) - most * most / 2) / (most - most * most / 2)), precision


@pytest.fixture(scope="module")
def scored():
    rnd = random.Random(7)
    return [(f, rnd.random() < 0.4, round(rnd.gauss(0.5, 0.2), 2)) for f in range(3) for _ in range(150)] + [(0, True, -50.0), (0, False, 900.0), (1, True, 0.5)]


def test_fold_scores_and_mean_curve(spark, scored):
    df = spark.createDataFrame(scored, "fold int, yes boolean, s double").repartition(4)
    got = {r.fold: r for r in models.fold_scores(df, ["fold"], "s", F.col("yes")).collect()}
    curves = {}
    for f in range(3):
        rows = [(y, s) for g, y, s in scored if g == f]
        curves[f], auc, part, precision = plain_scores(rows)
        assert (got[f].auc, got[f].partial_auc, got[f].average_precision) == pytest.approx((auc, part, precision))
        assert (got[f].tn, got[f].fp, got[f].fn, got[f].tp) == tuple(sum(y == want and (s >= 0.5) == hit for y, s in rows) for want, hit in ((False, False), (False, True), (True, False), (True, True)))
    whole = models.fold_scores(df, [], "s", F.col("yes")).first()
    assert whole.auc == pytest.approx(plain_scores([(y, s) for _, y, s in scored])[1])
    mean = {round(r.fpr * 100): r.tpr for r in models.mean_curve(df, "fold", "s", F.col("yes")).collect()}
    assert sorted(mean) == list(range(101))
    for g in range(101):
        values = []
        for points in curves.values():
            at = max(i for i, p in enumerate(points) if p[0] * 100 <= g + 1e-9)
            a, b = points[at], points[min(at + 1, len(points) - 1)]
            values.append(a[1] + ((g / 100 - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) if b[0] > a[0] else 0))
        assert mean[g] == pytest.approx(sum(values) / 3)
    assert models.fold_scores(df.where("false"), ["fold"], "s", F.col("yes")).count() == 0


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(240):
        a, b, c = rnd.random(), rnd.random(), rnd.random()
        rows.append((f"n{i}", "yes" if (a > 0.6) ^ (rnd.random() < 0.05) else "no", a, b, c, "u" if i % 3 else "v"))
    return spark.createDataFrame(rows, "name string, label string, a double, b double, c double, side string")


def test_split_of_the_largest_gain(spark, data):
    rows = data.collect()
    one = models.classifier("tree", maxDepth=1, maxBins=256).fit(models.feature_rows(data, ["a", "b", "c"], F.col("label") == "yes", 3))
    impurity = lambda part: 2 * (p := sum(part) / len(part)) * (1 - p) if part else 0.0
    gains = {}
    for column in "abc":
        values = sorted((r[column], r.label == "yes") for r in rows)
        ys = [y for _, y in values]
        gains[column] = max(impurity(ys) - i / len(ys) * impurity(ys[:i]) - (1 - i / len(ys)) * impurity(ys[i:]) for i in range(1, len(ys)))
    ranked = models.importances(one, ["a", "b", "c"])
    assert ranked[0] == (max(gains, key=gains.get), 1.0)


def test_top_features_and_refit_repeat(spark, data):
    run = lambda: models.refit_on_top(data, ["a", "b", "c"], F.col("label") == "yes", models.classifier("forest", numTrees=5, maxDepth=3), 1, 3)
    (ranked, folds), (again, _) = run(), run()
    assert ranked == again and ranked[0][0] == "a"
    assert [r.fold for r in folds.orderBy("fold").collect()] == [0, 1, 2] and min(r.auc for r in folds.collect()) > 0.85


@pytest.mark.parametrize(("name", "params"), [("boosted", {"maxIter": 3}), ("svm", {"maxIter": 10}), ("perceptron", {"layers": [3, 4, 2], "maxIter": 30}), ("bayes", {})])
def test_every_estimator_gives_scores(spark, data, name, params):
    rows = models.feature_rows(data, ["a", "b", "c"], F.col("label") == "yes", 2)
    got = models.cross_validated(rows, {name: models.classifier(name, **params)}, 2).first()
    assert got.model == name and 0.6 < got.auc <= 1 and 0.5 < got.accuracy <= 1
    with pytest.raises(ValueError, match="forest"):
        models.classifier("unknown")


def test_rows_go_to_their_model_in_one_pass(spark, data):
    rows = models.feature_rows(data, ["a", "b"], F.col("label") == "yes", 2, keep=("name", "side")).cache()
    fitted = {side: models.classifier("logistic").fit(rows.where(F.col("side") == side)) for side in ("u", "v")}
    routed = models.predict_by(rows, "side", {"u": fitted["u"]})
    alone = {r.name: r.score for side, m in fitted.items() for r in models.score_table(rows.where(F.col("side") == side), {"x": m}).select("name", F.col("score_x").alias("score")).collect()}
    got = {r.name: (r.side, r.score, r.label) for r in models.predict_by(rows, "side", fitted).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(alone)
    assert all((r.score is None) == (r.side == "v") for r in routed.collect())
    plan = models.predict_by(data.withColumn("features", F.lit(None).cast(rows.schema["features"].dataType)), "side", fitted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    rows.unpersist()


def test_affinity_regression_equals_a_direct_fit(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(core, "".join(rnd.choice("ACGT") for _ in range(5))) for core in ("one", "two") for _ in range(300)]
    rows = [(c, w, w.count("G") * 0.7 + (w[0] == "A") * (2 if c == "one" else -1) + rnd.gauss(0, 0.1)) for c, w in dict.fromkeys(rows)]
    monkeypatch.setattr(models, "PART_WINDOWS", 50)
    found = models.affinity_regression(spark.createDataFrame(rows, "core string, window string, score double"), [0.5, 50.0], 5, 2, 4)
    import zlib

    def vector(w):
        v = np.zeros(1 + 20 + 64)
        v[0] = 1
        for i, x in enumerate(w):
            v[1 + 4 * i + "ACGT".index(x)] = 1
        for i in range(4):
            v[21 + 16 * i + 4 * "ACGT".index(w[i]) + "ACGT".index(w[i + 1])] = 1
        return v

    def fit(some, ridge):
        x, y = np.array([vector(w) for w, _ in some]), np.array([s for _, s in some])
        return np.linalg.lstsq(x.T @ x + np.diag([0.0] + [ridge] * 84), x.T @ y, rcond=None)[0]

    got = {(r.core, r.ridge): r for r in found.choice.collect()}
    total = 0.0
    for core in ("one", "two"):
        own = [(w, s) for c, w, s in rows if c == core]
        errors = {}
        for ridge in (0.5, 50.0):
            errors[ridge] = sum((s - vector(w) @ b) ** 2 for f in range(4) for b in [fit([x for x in own if zlib.crc32(x[0].encode()) % 4 != f], ridge)] for w, s in own if zlib.crc32(w.encode()) % 4 == f)
            assert got[core, ridge].mse == pytest.approx(errors[ridge] / len(own), rel=1e-6)
        assert got[core, 0.5].chosen and not got[core, 50.0].chosen and got[core, 0.5].r2 > 0.9
        total += errors[0.5]
        weights = np.array([r.weight for r in found.weights.where(F.col("core") == core).orderBy("idx").collect()])
        assert np.array([vector(w) @ weights for w, _ in own]) == pytest.approx(np.array([vector(w) @ fit(own, 0.5) for w, _ in own]), abs=1e-6)
    assert got[None, None].mse == pytest.approx(total / len(rows), rel=1e-6)
    named = {(r.core, r.kmer, r.position): r.weight for r in models.feature_weights(found.weights, 5, 2).collect()}
    assert len(named) == 2 * 84 and named["one", "A", 1] > named["two", "A", 1]
    assert {r.position for r in models.weights_by_position(models.feature_weights(found.weights, 5, 2)).collect()} == {1, 2, 3, 4, 5}


def test_combined_labels_over_all_kinds(spark):
    kinds = {"unfit": (0.0, 1.0, 1.0), "cooperative": (5.0, 0.01, 0.9), "steric": (5.0, 0.9, 0.01), "additive": (5.0, 0.5, 0.5)}
    rows = []
    for (a, x), (b, y), flip in itertools.product(kinds.items(), kinds.items(), (0, 1)):
        row = [f"{a}|{b}|{flip}"]
        for kind, two in ((x, 3 - flip), (y, 2 + flip)):
            row += [kind[0], kind[0], 0.5, 0.5 + two, 0.6, kind[1], kind[2]]
        rows.append(row)
    columns = ["name"] + [f"{c}_{o}" for o in ("o1", "o2") for c in ("m1", "m2", "m3", "wt", "cutoff", "p_greater", "p_less")]
    got = {r.name: (r.label, r.side, r.two) for r in labels.classify_combined(spark.createDataFrame(rows, columns)).collect()}
    assert len(got) == 32
    for name, (label, side, two) in got.items():
        a, b, flip = name.split("|")
        if {a, b} == {"cooperative", "steric"}:
            assert (label, side, two) == ("conflict", None, None)
        elif {a, b} == {"unfit"}:
            assert (label, side) == ("unfit", None)
        else:
            want = next(k for k in ("cooperative", "steric", "additive") if k in (a, b))
            larger = "o1" if flip == "0" else "o2"
            smaller = "o2" if flip == "0" else "o1"
            assert label == want and side == (("o1" if a == want else "o2") if a != b else smaller if want == "steric" else larger)


def test_wild_types_stay_and_lone_groups_have_none(spark):
    df = spark.createDataFrame([("g", "wt", 1.0, 1.0), ("g", "m1", 2.0, 2.0), ("g", "m2", 3.0, 3.0), ("g", "m3", 4.0, 0.0), ("h", "m1", 1.0, 1.0), (None, "wt", 0.0, 0.0)], "name string, type string, x double, y double")
    got = {(r.name, r.type): (r.x_wt, r.y_delta) for r in labels.attach_wild_type(df, ["name"], ["x", "y"], F.expr("type = 'wt'")).collect()}
    assert got["g", "m1"] == (1.0, 1.0) and got["h", "m1"] == (None, None) and got[None, "wt"] == (0.0, 0.0)
    kept = {(r.name, r.type) for r in labels.residual_keep(df, ["name"], "x", "y", 2.5, F.expr("type = 'wt'")).collect()}
    assert kept == {("g", "wt"), (None, "wt"), ("g", "m1"), ("g", "m2")}
