"""Curves and scores of classifiers by fold, estimators by name, selected features, routing to stored models, affinity regression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindframe.functions.tails import fisher_p, t_p
from bindframe.operators.curves import score_steps
from bindframe.operators.replicates import association_test, linear_fit, normal_tail, welch_test
from bindframe.operators.sites import _positional
from bindframe.operators.tables import stratified_folds
from bindframe.sources.shared import saved


# tests with p values


def t_test(df: DataFrame, keys: list[str], side: str = "two", pooled: bool = False) -> DataFrame:
    """A20 with its p value: (keys, t, dof, p) of groups (keys, kind two/indiv, value)."""
    return welch_test(df, keys, pooled).withColumn("p", t_p(F.col("t"), F.col("dof"), side))


def wald_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """A11 with the Wald test that the slope is 0."""
    return linear_fit(df, x, y).withColumn("p", t_p(F.col("t"), (F.col("n") - 2).cast("double")))


def exact_association(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """A24 whole: the 2 x 2 table, chi-square with and without correction and their p values, and Fisher's two-sided p."""
    t = association_test(df, x, y)
    tail = lambda c: 2 * normal_tail(F.sqrt(c))
    return t.withColumns({"p": tail("chi2"), "p_corrected": tail("chi2_corrected"), "p_fisher": fisher_p(*(F.col(c) for c in "abcd"))})


# curves


def fold_scores(df: DataFrame, keys: list[str], score: str, positive: Column, most_fpr: float = 0.1, cut: float = 0.5) -> DataFrame:
    """M6 whole: by group the AUC, its part up to most_fpr (0.5 is chance, 1 is best), average precision, accuracy and the confusion counts.

    Groups without both kinds of rows have null curves' figures.
    """
    s = score_steps(df, keys, score, positive)
    p, n, cp, cn, tp, tn = (F.col(c).cast("double") for c in ("p", "n", "cp", "cn", "tp", "tn"))
    left, right = (cn - n) / tn, cn / tn
    low, high = (cp - p) / tp, cp / tp
    # the part of a step's trapezoid that lies left of most_fpr
    stop = F.least(right, F.lit(most_fpr))
    at_stop = low + F.when(right > left, (stop - left) / (right - left)).otherwise(F.lit(1.0)) * (high - low)
    part = F.when(left < most_fpr, (stop - left) * (low + at_stop) / 2).otherwise(F.lit(0.0))
    least, count = most_fpr * most_fpr / 2, lambda c: F.sum(c).cast("long")
    hit = F.col("score") >= cut
    sums = s.groupBy(*keys).agg(
        F.sum((right - left) * (low + high) / 2).alias("auc"), F.sum(part).alias("_part"), F.sum(p / tp * cp / (cp + cn)).alias("average_precision"),
        count(F.when(~hit, F.col("n")).otherwise(0)).alias("tn"), count(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), count(F.when(~hit, F.col("p")).otherwise(0)).alias("fn"), count(F.when(hit, F.col("p")).otherwise(0)).alias("tp"))
    partial = 0.5 * (1 + (F.col("_part") - least) / (most_fpr - least))
    return sums.select(*keys, "auc", partial.alias("partial_auc"), "average_precision", ((F.col("tp") + F.col("tn")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).alias("accuracy"), "tn", "fp", "fn", "tp")


def mean_curve(df: DataFrame, fold: str, score: str, positive: Column, points: int = 100) -> DataFrame:
    """M5's mean curve: (fpr, tpr, folds) at 0, 1/points, .. 1, the folds' curves interpolated and averaged.

    A step of a fold's curve covers the grid places from its left end up to before its right end, so
    every grid place of a fold is made by exactly one step, without a join of curve and grid. Where a
    curve rises at a place, its upper end counts. Folds without both kinds of rows are left out.
    """
    s = score_steps(df, [fold], score, positive).where("tp > 0 and tn > 0")
    up = F.when(F.expr(f"({points} * (cn - n)) % tn") > 0, 1).otherwise(0) + F.expr(f"({points} * (cn - n)) div tn")
    end = F.when(F.expr(f"({points} * cn) % tn") > 0, 1).otherwise(0) + F.expr(f"({points} * cn) div tn")
    places = F.when(up < end, F.sequence(up, end - 1))
    on_step = s.select(fold, F.explode(places).alias("place"), "p", "n", "cp", "cn", "tp", "tn")
    share = (F.col("place") * F.col("tn") / points - (F.col("cn") - F.col("n"))) / F.col("n")
    inner = on_step.select(fold, "place", ((F.col("cp") - F.col("p") + share * F.col("p")) / F.col("tp")).alias("tpr"))
    last = s.select(fold).distinct().select(fold, F.lit(points).cast("long").alias("place"), F.lit(1.0).alias("tpr"))
    return inner.select(fold, F.col("place").cast("long").alias("place"), "tpr").unionByName(last).groupBy("place").agg(F.avg("tpr").alias("tpr"), F.count("*").alias("folds")).select((F.col("place") / points).alias("fpr"), "tpr", "folds")


# estimators


def classifier(name: str, seed: int = 1, **params: Any) -> Estimator:
    """M3: an estimator for columns features and y by name, with its own parameters.

    logistic (elasticNetParam makes it an elastic net), tree, forest, boosted, bayes (Gaussian), svm and perceptron
    (both on scaled features; layers must begin with the number of features).
    """
    from pyspark.ml import classification as c
    from pyspark.ml.feature import StandardScaler

    made: dict[str, Callable[..., Estimator]] = {
        "logistic": lambda **k: c.LogisticRegression(**k), "tree": lambda **k: c.DecisionTreeClassifier(seed=seed, **k), "forest": lambda **k: c.RandomForestClassifier(seed=seed, **k),
        "boosted": lambda **k: c.GBTClassifier(seed=seed, **k), "bayes": lambda **k: c.NaiveBayes(modelType="gaussian", **k),
        "svm": lambda **k: c.LinearSVC(**k), "perceptron": lambda **k: c.MultilayerPerceptronClassifier(seed=seed, **k),
    }
    if name not in made:
        raise ValueError(f"no classifier {name}; there are {', '.join(sorted(made))}")
    if name in ("svm", "perceptron"):
        return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), made[name](labelCol="y", featuresCol="scaled", **params)])
    return made[name](labelCol="y", featuresCol="features", **params)


def feature_rows(df: DataFrame, features: Sequence[str], positive: Column, folds: int, label: str = "label", keep: Sequence[str] = ("name",)) -> DataFrame:
    """(keep, features, y, fold): a vector of the named columns, 1.0 for positive rows, and M1's fold."""
    from pyspark.ml.feature import VectorAssembler

    data = stratified_folds(df, folds, label).withColumn("y", positive.cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(data).select(*keep, "features", "y", F.col("fold").cast("int").alias("fold"))


def positive_score(predicted: DataFrame) -> Column:
    """The score of class 1: its probability, or for a model without probabilities its raw value."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col("probability" if "probability" in predicted.columns else "rawPrediction"))[1]


def held_out(data: DataFrame, estimator: Estimator, folds: int) -> DataFrame:
    """data with the score of a model that was fitted on the other folds: (fold, y, score), every row once."""
    out = []
    for f in range(folds):
        predicted = estimator.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
        out.append(predicted.select("fold", "y", positive_score(predicted).alias("score")))
    return reduce(DataFrame.unionByName, out)


def cross_validated(data: DataFrame, estimators: dict[str, Estimator], folds: int, repeats: int = 1) -> DataFrame:
    """M2 for any estimators: (model, auc, average_precision, accuracy), averaged over folds and repeats.

    A repeat deals the rows to folds anew, by the hash of the features' text and its number.
    """
    data = saved(data)
    parts = []
    for repeat in range(repeats):
        dealt = data if not repeat else data.withColumn("fold", F.pmod(F.xxhash64(F.col("features").cast("string"), F.lit(repeat)), F.lit(folds)).cast("int"))
        for name, estimator in estimators.items():
            parts.append(held_out(dealt, estimator, folds).select(F.lit(name).alias("model"), F.lit(repeat).alias("repeat"), "fold", "y", "score"))
    each = fold_scores(saved(reduce(DataFrame.unionByName, parts)), ["model", "repeat", "fold"], "score", F.col("y") == 1)
    return each.groupBy("model").agg(F.avg("auc").alias("auc"), F.avg("average_precision").alias("average_precision"), F.avg("accuracy").alias("accuracy"))


def cross_validated_folds(df: DataFrame, sets: dict[str, Sequence[str]], estimator: Estimator, positive: Column, folds: int, repeats: int) -> DataFrame:
    """M6 of one estimator by feature set, repeat and fold: (model, repeat, fold, auc, ..); every set sees the same folds."""
    parts = []
    for name, features in sets.items():
        rows = saved(feature_rows(df, features, positive, folds))
        for repeat in range(repeats):
            dealt = rows if not repeat else rows.withColumn("fold", F.pmod(F.xxhash64("name", F.lit(repeat)), F.lit(folds)).cast("int"))
            parts.append(held_out(dealt, estimator, folds).select(F.lit(name).alias("model"), F.lit(repeat).alias("repeat"), "fold", "y", "score"))
    return fold_scores(saved(reduce(DataFrame.unionByName, parts)), ["model", "repeat", "fold"], "score", F.col("y") == 1)


def importances(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """M4: features by falling importance, ties by name: a tree model's own, else the size of the coefficients."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def refit_on_top(df: DataFrame, features: Sequence[str], positive: Column, estimator: Estimator, n: int, folds: int) -> tuple[list[tuple[str, float]], DataFrame]:
    """M4: all importances, and M6 by fold of the same estimator on the n most important features: (fold, auc, ..)."""
    whole = saved(feature_rows(df, features, positive, folds))
    ranked = importances(estimator.fit(whole), features)
    top = [name for name, _ in ranked[:n]]
    scored = held_out(saved(feature_rows(df, top, positive, folds)), estimator, folds)
    return ranked, fold_scores(scored, ["fold"], "score", F.col("y") == 1)


def score_table(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    """df(features) with label_<name> and score_<name> of each stored model, in one pass over df."""
    out = df
    for name, model in models.items():
        before = out.columns
        predicted = model.transform(out)
        out = predicted.select(*before, F.col("prediction").alias(f"label_{name}"), positive_score(predicted).alias(f"score_{name}"))
    return out


def predict_by(df: DataFrame, column: str, models: dict[str, Model]) -> DataFrame:
    """M7: df(column, features) with label and score of the model that the row's value names, null where none does; one pass over df."""
    numbered = {f"m{i}": (value, model) for i, (value, model) in enumerate(models.items())}
    scored = score_table(df, {k: m for k, (_, m) in numbered.items()})
    pick = lambda what: F.coalesce(*(F.when(F.col(column) == v, F.col(f"{what}_{k}")) for k, (v, _) in numbered.items()))
    return scored.select(*df.columns, pick("label").alias("label"), pick("score").alias("score"))


# affinity regression


class Affinity(NamedTuple):
    """choice: (core, ridge, n, r2, mse, chosen) by held-out folds, with a row for the pooled choice; weights: (core, idx, weight) of the chosen models, idx 0 the constant."""

    choice: DataFrame
    weights: DataFrame


def _moments(kmax: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """A function of groups (core, fold, part, window, score): sums from which any of their least-squares fits follows."""

    def run(group: pa.Table) -> pa.Table:
        size = 1 + sum(max(0, width - k + 1) * 4**k for k in range(1, kmax + 1))
        texts, y = group.column("window").to_pylist(), group.column("score").to_numpy().astype(np.float64)
        index = _positional(np.array([["ACGT".index(c) for c in t] for t in texts], np.int64).reshape(len(texts), width), kmax)
        ones = np.zeros((len(texts), size))
        ones[:, 0] = 1
        np.put_along_axis(ones, index, 1.0, 1)
        first = lambda c: group.column(c)[0].as_py()
        return pa.table({"core": [first("core")], "fold": pa.array([first("fold")], pa.int32()), "n": [len(y)], "yy": [float(y @ y)], "xy": [(ones.T @ y).tobytes()], "xx": [(ones.T @ ones).tobytes()]})

    return run


#: Windows that one task sums at a time.
PART_WINDOWS = 4_096


def affinity_regression(train: DataFrame, ridges: Sequence[float], width: int, kmax: int = 2, folds: int = 5) -> Affinity:
    """train(core, window, score), windows of one width of A, C, G, T -> ridge regressions on positional k-mers, one for each core.

    One pass sums the normal equations of every core and fold, in parts of PART_WINDOWS windows; leaving a fold
    out is a subtraction, so the whole grid needs no further pass, and a held-out error follows from the
    sums as well. What comes to the driver is one matrix a core and fold, of a size that the width
    and kmax fix. The ridge does not weigh on the constant. For each core the ridge of the least held-out error
    is chosen, the smallest of equals.
    """
    spark = train.sparkSession
    dealt = train.withColumn("fold", F.pmod(F.crc32(F.col("window").cast("binary")), F.lit(folds)).cast("int"))
    rows = train.count()
    parts = max(1, -(-rows // PART_WINDOWS))
    part = F.pmod(F.xxhash64("window"), F.lit(parts)).cast("int")
    sums = saved(dealt.withColumn("part", part).groupBy("core", "fold", "part").applyInArrow(_moments(kmax, width), "core string, fold int, n long, yy double, xy binary, xx binary"))

    def added(group: pa.Table) -> pa.Table:
        total = lambda c: np.sum([np.frombuffer(b) for b in group.column(c).to_pylist()], 0).tobytes()
        return pa.table({"core": group.column("core").slice(0, 1), "fold": group.column("fold").slice(0, 1), "n": [sum(group.column("n").to_pylist())], "yy": [sum(group.column("yy").to_pylist())], "xy": [total("xy")], "xx": [total("xx")]})

    # parts meet in halves of halves, so that no task holds many of them
    while parts > 64:
        parts = -(-parts // 64)
        sums = saved(sums.groupBy("core", "fold", (F.xxhash64("n", "yy") % parts).alias("part")).applyInArrow(added, sums.schema))
    found: dict[str, dict[int, tuple]] = {}
    for r in sums.groupBy("core", "fold").applyInArrow(added, sums.schema).collect():
        xy = np.frombuffer(r.xy)
        found.setdefault(r.core, {})[r.fold] = (r.n, r.yy, xy, np.frombuffer(r.xx).reshape(len(xy), len(xy)))
    choice, weights, pooled = [], [], [0, 0.0, 0.0, 0.0]
    for core, by in sorted(found.items()):
        n, yy, xy, xx = (sum(v[i] for v in by.values()) for i in range(4))
        spread = yy - xy[0] ** 2 / n
        tried = []
        for ridge in ridges:
            error = 0.0
            for held in by.values():
                b = _ridge(xx - held[3], xy - held[2], ridge)
                error += held[1] - 2 * b @ held[2] + b @ held[3] @ b
            tried.append((error, ridge))
        best = min(tried)
        for error, ridge in tried:
            choice.append((core, float(ridge), int(n), float(1 - error / spread) if spread > 0 else None, float(error / n), ridge == best[1]))
        for i, w in enumerate(_ridge(xx, xy, best[1])):
            weights.append((core, i, float(w)))
        pooled = [pooled[0] + n, pooled[1] + yy, pooled[2] + xy[0], pooled[3] + best[0]]
    if pooled[0]:
        spread = pooled[1] - pooled[2] ** 2 / pooled[0]
        choice.append((None, None, int(pooled[0]), float(1 - pooled[3] / spread) if spread > 0 else None, float(pooled[3] / pooled[0]), True))
    return Affinity(spark.createDataFrame(choice, "core string, ridge double, n long, r2 double, mse double, chosen boolean"), spark.createDataFrame(weights, "core string, idx int, weight double"))


def _ridge(xx: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    """Least squares with a ridge on all but the constant; columns that never occur get 0."""
    penalty = np.full(len(xy), float(ridge))
    penalty[0] = 0.0
    return np.linalg.lstsq(xx + np.diag(penalty), xy, rcond=None)[0]


def feature_weights(weights: DataFrame, width: int, kmax: int) -> DataFrame:
    """(core, idx, weight) of fitted models -> (core, kmer, position, weight), position from 1."""
    names = [("".join("ACGT"[code // 4 ** (k - 1 - i) % 4] for i in range(k)), p + 1) for k in range(1, kmax + 1) for p in range(width - k + 1) for code in range(4**k)]
    table = weights.sparkSession.createDataFrame([(i + 1, kmer, p) for i, (kmer, p) in enumerate(names)], "idx int, kmer string, position int")
    return weights.join(F.broadcast(table), "idx").select("core", "kmer", "position", "weight")


def weights_by_position(weighed: DataFrame) -> DataFrame:
    """How much all k-mers of a position weigh, by size."""
    return weighed.groupBy("core", "position").agg(F.sum(F.abs("weight")).alias("weight"))
