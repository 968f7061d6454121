"""Windows, top-k and set operators over labelled tables; feature tables; model evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindframe.functions.sequences import canonical
from bindframe.operators.curves import hashed_numbers, score_steps
from bindframe.sources.shared import saved


def hashed(*cols: str) -> Column:
    """A reproducible random order of rows that any engine can compute."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def first_last_by(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """W4."""
    return df.groupBy(key).agg(F.min_by(col, order).alias("first"), F.max_by(col, order).alias("last"))


def adjacent_similar(df: DataFrame, key: str, col: str, tol: float, side: Column) -> DataFrame:
    """Rows whose next row in the group is within tol and on the other side."""
    by = W.partitionBy(key).orderBy(col, "name")
    marked = df.withColumn("_side", side).withColumn("next", F.lead(col).over(by)).withColumn("_next", F.lead("_side").over(by))
    return marked.where((F.col("next") - F.col(col) <= tol) & (F.col("_side") != F.col("_next"))).drop("_side", "_next")


def top_groups(df: DataFrame, key: str, score: str, m: int) -> DataFrame:
    """Rows of the m groups with the best score (ties by key); the report is a top-k."""
    best = df.groupBy(key).agg(F.max(score).alias("_best")).orderBy(F.desc("_best"), key).limit(m)
    return df.join(F.broadcast(best.select(key)), key, "left_semi")


def fit_budget(df: DataFrame, key: str, order: Column, spots: int) -> DataFrame:
    """Groups in order while their sizes together fit; (key, size, total).

    Running sums go by blocks of the order: block totals are summed once, then within each block.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("size"), F.min(order).alias("_o"))
    blocked = sizes.withColumn("_block", F.substring("_o", 1, 2))
    per = blocked.groupBy("_block").agg(F.sum("size").alias("_s"))
    before = per.withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = W.partitionBy("_block").orderBy("_o", key).rowsBetween(W.unboundedPreceding, 0)
    total = blocked.join(F.broadcast(before), "_block").withColumn("total", F.col("_before") + F.sum("size").over(inner))
    return total.where(F.col("total") <= spots).select(key, "size", "total")


def groups_larger_than(df: DataFrame, key: str, n: int) -> DataFrame:
    """W8."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(key))).where(F.col("_n") > n).drop("_n")


def share_of_group(df: DataFrame, key: str, col: str) -> DataFrame:
    """W9."""
    return df.withColumn("share", F.col(col) / F.sum(col).over(W.partitionBy(key)))


def sample_per_group(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """N rows of each group in a hashed order, all if fewer."""
    order = F.md5(F.concat(F.lit(seed), "name"))
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def extreme_by_label(df: DataFrame, two: str, indiv: str, n: int, m: int) -> DataFrame:
    """The n cooperative rows farthest from the diagonal of two scores, |two - indiv| / sqrt 2, and the m independent ones nearest to it."""
    far = df.withColumn("diagonal", F.abs(F.col(two) - F.col(indiv)) / F.sqrt(F.lit(2.0)))
    a = far.where("label = 'cooperative'").orderBy(F.desc("diagonal"), "name").limit(n)
    return a.unionByName(far.where("label = 'independent'").orderBy("diagonal", "name").limit(m))


def top_up(df: DataFrame, chosen: DataFrame, key: str, score: str, m: int) -> DataFrame:
    """The chosen groups, filled up to m by the best of the others."""
    rest = df.join(chosen, key, "left_anti").groupBy(key).agg(F.max(score).alias("s"))
    tagged = chosen.select(key).distinct().withColumn("s", F.lit(0.0)).withColumn("_own", F.lit(0)).unionByName(rest.withColumn("_own", F.lit(1)))
    return tagged.orderBy("_own", F.desc("s"), key).limit(m).select(key)


def label_shift(df: DataFrame, key: str, order: str) -> DataFrame:
    """First and last label along the distance in each group, counted."""
    ends = df.groupBy(key).agg(F.min_by("label", F.struct(order, "name")).alias("first"), F.max_by("label", F.struct(order, "name")).alias("last"))
    return ends.groupBy("first", "last").agg(F.count("*").alias("n"))


def attach_first(df: DataFrame, key: str, col: str) -> DataFrame:
    """Each row with its group's first row (by name) and the difference to it."""
    base = df.groupBy(key).agg(F.min_by(col, "name").alias("base"))
    return df.join(base, key).withColumn("delta", F.col(col) - F.col("base"))


def residual_filter(df: DataFrame, x: str, y: str, cut: float) -> DataFrame:
    """Rows within a distance of the line of y on x, with signs that agree."""
    fit = df.agg(F.expr(f"regr_slope({y}, {x})").alias("_a"), F.expr(f"regr_intercept({y}, {x})").alias("_b"))
    out = df.join(F.broadcast(fit)).withColumn("residual", F.col(y) - F.col("_a") * F.col(x) - F.col("_b"))
    return out.where((F.abs("residual") <= cut) & (F.signum(F.col(x)) == F.signum(F.col(y)))).drop("_a", "_b")


def one_hot(df: DataFrame, key: str, col: str, values: list, prefix: str) -> DataFrame:
    """0 and 1 columns for fixed categories; absent ones are 0."""
    return df.select(key, *[(F.col(col) == x).cast("int").alias(f"{prefix}{i}") for i, x in enumerate(values)])


def flank_kmers(df: DataFrame, start: Column, length: int, kmax: int) -> DataFrame:
    """(key, k, position, kmer) of all k-mers up to kmax inside a flank of each sequence, as sparse one-hot features."""
    out = None
    for k in range(1, kmax + 1):
        flank = df.select("key", F.substring("sequence", start, F.lit(length)).alias("flank")).where(F.length("flank") == length)
        part = flank.select("key", F.lit(k).alias("k"), F.expr(f"posexplode(transform(sequence(0, {length - k}), i -> substring(flank, i + 1, {k})))").alias("position", "kmer"))
        out = part if out is None else out.unionByName(part)
    return out


def gc_content(df: DataFrame) -> DataFrame:
    """F6."""
    return df.select("key", ((F.length("sequence") - F.length(F.translate("sequence", "GC", ""))) / F.length("sequence")).alias("gc"))


def canonical_kmer_counts(windows: DataFrame) -> DataFrame:
    """how often each canonical k-mer occurs in each sequence."""
    return windows.groupBy("key", canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def stratified_folds(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """M1: folds of like size within each label, in a hashed order."""
    return hashed_numbers(df, label, "name").withColumn("fold", F.pmod("_number", F.lit(k)).cast("int")).drop("_number")


def model_metrics(df: DataFrame, keys: list[str], positive: str, score: str, cut: float = 0.5) -> DataFrame:
    """M6: per group the AUC by mean ranks, accuracy and the confusion counts of (label, score)."""
    steps = score_steps(df, keys, score, F.col("label") == positive)
    hit = F.col("score") >= cut
    count = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    # each positive row beats the negative ones below it, and half of those beside it
    beaten = F.sum(F.col("p") * (F.col("tn") - F.col("cn") + F.col("n") / 2))
    out = steps.groupBy(*keys).agg(beaten.alias("_s"), count("n", ~hit).alias("tn"), count("n", hit).alias("fp"), count("p", ~hit).alias("fn"), count("p", hit).alias("tp"))
    p, n = F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp")
    return out.select(*keys, (F.col("_s") / F.nullif(p * n, F.lit(0))).alias("auc"), ((F.col("tp") + F.col("tn")) / (p + n)).alias("accuracy"), "tn", "fp", "fn", "tp")


def roc_points(df: DataFrame, positive: str, score: str) -> DataFrame:
    """M5: (score, tpr, fpr) at each distinct score from the top."""
    steps = score_steps(df, [], score, F.col("label") == positive)
    return steps.select(F.col("score").alias(score), (F.col("cp") / F.col("tp")).alias("tpr"), (F.col("cn") / F.col("tn")).alias("fpr"))


def threshold_classifier(df: DataFrame, positive: str, score: str) -> DataFrame:
    """M8: the single cut (score >= cut is positive) with the best accuracy; ties take the highest cut. One row."""
    steps = score_steps(df, [], score, F.col("label") == positive)
    accuracy = (F.col("cp") + F.col("tn") - F.col("cn")) / (F.col("tp") + F.col("tn"))
    return steps.agg(F.max_by("score", F.struct(accuracy, F.col("score"))).alias("cut"), F.max(accuracy).alias("accuracy"))


def grid_search(df: DataFrame, features: list[str], positive: str, grid: dict[str, list], folds: int = 3, metric: str = "areaUnderROC") -> DataFrame:
    """M2, M3: mean metric over folds for each point of a logistic regression's grid; (point, metric)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    # written once, since every fold and point reads the rows again
    data = saved(stratified_folds(df, folds).select(*features, (F.col("label") == positive).cast("double").alias("y"), F.col("fold").cast("int").alias("fold")))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(data).select("features", "y", "fold")
    model = LogisticRegression(labelCol="y", maxIter=20)
    points = ParamGridBuilder()
    for name, values in grid.items():
        points = points.addGrid(model.getParam(name), values)
    points = points.build()
    fitted = CrossValidator(estimator=model, estimatorParamMaps=points, evaluator=BinaryClassificationEvaluator(labelCol="y", metricName=metric), numFolds=folds, foldCol="fold", parallelism=4).fit(data)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda x: x[0].name)), float(m)) for point, m in zip(points, fitted.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "point string, metric double")
