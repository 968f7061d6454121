"""Readers and writers of the file formats that binding data comes in."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.operators.intervals import resize_peaks


def read_peaks(spark: SparkSession, path: str, mode: str = "all", length: int = 200, with_length: bool = False) -> DataFrame:
    """narrowPeak (score in column 5, summit in column 10) or BED without a summit; resized by P1. with_length adds peaklen, both ends counted."""
    raw = spark.read.csv(path, sep="\t", schema="chr string, start_pos long, end_pos long, name string, score double, strand string, signal double, p double, q double, summit long")
    peaks = resize_peaks(raw.select("chr", "start_pos", "end_pos", "score", "summit"), length, mode)
    return peaks.withColumn("peaklen", F.col("end_pos") - F.col("start_pos") + 1) if with_length else peaks


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """bedGraph."""
    return spark.read.csv(path, sep="\t", schema="chr string, start_pos long, end_pos long, pileup double")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """S3: predicted sites as BED, with an optional preference column."""
    return spark.read.csv(path, sep="\t", schema="chr string, start_pos long, end_pos long, pref double")


def genome_sites(mode: str, sites: DataFrame | None = None, called: DataFrame | None = None, before: int = 0, width: int = 1) -> DataFrame:
    """sites(chr, start_pos, end_pos) from the source that a configuration names: 'file' takes those of S3, 'caller' those of K8.

    A called position becomes the interval of `width` bases that begins `before` bases ahead of it.
    """
    if mode == "file" and sites is not None:
        return sites.select("chr", "start_pos", "end_pos")
    if mode == "caller" and called is not None:
        begin = F.col("position") - before
        return called.select("chr", begin.cast("long").alias("start_pos"), (begin + width).cast("long").alias("end_pos")).distinct()
    raise ValueError("mode is file, with sites, or caller, with called positions")


def read_escores(spark: SparkSession, path: str) -> DataFrame:
    """Both strand columns to one table (kmer, score); on a clash the second column wins."""
    raw = spark.read.csv(path, sep="\t", header=True).toDF("a", "b", "s")
    both = raw.select(F.col("a").alias("kmer"), F.col("s").cast("double").alias("score"), F.lit(1).alias("o")).union(raw.select("b", F.col("s").cast("double"), F.lit(0)))
    return both.groupBy("kmer").agg(F.min_by("score", F.struct("o", "score")).alias("score"))


def read_kmer_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, kposition, score, classified = 1); cells like [3,7] become rows."""
    raw = spark.read.csv(path, sep="\t", header=True).where("classified = 1")
    cells = F.split(F.regexp_replace("kposition", r"[\[\] ]", ""), ",")
    return raw.select("kmer", F.explode(F.transform(cells, lambda x: x.cast("int"))).alias("kposition"), F.col("Escore").cast("double").alias("score"))


def read_pwm(spark: SparkSession, path: str, log: bool = True, start: int = 0, end: int | None = None, reverse: bool = False) -> DataFrame:
    """(strand, pos, base, w) from lines like 'A:<tab>0.66<tab>0.04', columns start (from 0) up to before end; log2(p / 0.25), minus infinity for 0.

    The reverse strand is derived; with `reverse` the file is the reverse strand, and the forward one is derived.
    """
    lines = spark.read.text(path).select(F.split("value", ":")[0].alias("base"), F.split(F.regexp_replace(F.split("value", r":\s*")[1], r"\s+$", ""), r"\s+").alias("p"))
    if start or end is not None:
        lines = lines.withColumn("p", F.slice("p", F.lit(start + 1), F.lit(end - start) if end is not None else F.size("p")))
    cells = lines.select("base", F.posexplode("p").alias("pos", "p"), F.size("p").alias("n")).withColumn("p", F.col("p").cast("double"))
    w = F.when(F.col("p") == 0, F.lit(float("-inf"))).otherwise(F.log2(F.col("p") / 0.25)) if log else F.col("p")
    forward = cells.select(F.lit("+").alias("strand"), "pos", "base", w.alias("w"), "n")
    back = forward.select(F.lit("-").alias("strand"), (F.col("n") - 1 - F.col("pos")).alias("pos"), F.translate("base", "ACGT", "TGCA").alias("base"), "w", "n")
    both = forward.union(back).drop("n")
    return both.withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+")) if reverse else both


def write_pwm(df: DataFrame, path: str) -> None:
    """One line for each base, of the forward strand."""
    rows = df.where("strand = '+'").groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"].cast("string")).alias("ws"))
    rows.select(F.concat("base", F.lit(":\t"), F.array_join("ws", "\t")).alias("value")).coalesce(1).sortWithinPartitions("value").write.text(path)


def read_svm_models(spark: SparkSession, path: str) -> DataFrame:
    """Support vectors as rows (file, sv_id, coef, idx, val), without the header lines."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("sv_id"), F.split(F.trim("value"), r"\s+").alias("c")).where(F.col("c")[0].rlike(r"^-?[0-9.]") & F.col("c")[1].contains(":"))
    cells = lines.select("file", "sv_id", F.col("c")[0].cast("double").alias("coef"), F.explode(F.slice("c", F.lit(2), F.size("c"))).alias("v"))
    return cells.select("file", "sv_id", "coef", F.split("v", ":")[0].cast("int").alias("idx"), F.split("v", ":")[1].cast("double").alias("val"))


def read_shape_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(key, values) from FASTA-like number lists; NA becomes null."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    parts = records.select(F.split("value", "\n", 2).alias("v"))
    numbers = F.transform(F.split(F.regexp_replace(F.col("v")[1], r"\s", ""), ","), lambda x: F.when(x != "NA", x).cast("double"))
    return parts.select(F.trim(F.col("v")[0]).alias("key"), numbers.alias("values"))


def write_fasta(df: DataFrame, path: str) -> None:
    """Records of (key, sequence)."""
    df.select(F.concat(F.lit(">"), "key", F.lit("\n"), "sequence").alias("value")).write.text(path)


def write_profiles(df: DataFrame, path: str, wrap: int = 20) -> None:
    """Records of (key, values) as `read_shape_profiles` reads them: a line '>key', then comma-separated numbers, `wrap` on a line, NA for null."""
    text = F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("NA")))
    lines = F.transform(F.when(F.size("values") > 0, F.sequence(F.lit(1), F.size("values"), F.lit(wrap))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(text, i, F.lit(wrap)), ","))
    df.select(F.concat(F.lit(">"), "key", F.lit("\n"), F.array_join(lines, ",\n")).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, by: str | None = None, sep: str = "\t") -> None:
    """A delimited table, one file set for each value of `by`."""
    writer = df.write.option("header", True).option("sep", sep)
    (writer.partitionBy(by) if by else writer).csv(path)


def parse_probe_name(df: DataFrame, col: str = "Name", order: tuple[str, ...] = ("name", "type", "ori", "rep")) -> DataFrame:
    """Parts of a name split at '_' from the right, in the given order; the first takes what is left. Without enough parts all are empty."""
    pattern = "^(.*)" + "_([^_]+)" * (len(order) - 1) + "$"
    return df.select("*", *[F.regexp_extract(col, pattern, i + 1).alias(c) for i, c in enumerate(order)])


def include_exclude(df: DataFrame, col: str, include: str | None, exclude: str | None) -> DataFrame:
    """P5: rows that match one pattern and not the other; null matches nothing."""
    out = df
    if include:
        out = out.where(F.coalesce(F.col(col).rlike(include), F.lit(False)))
    if exclude:
        out = out.where(~F.coalesce(F.col(col).rlike(exclude), F.lit(False)))
    return out


def sequence_table(spark: SparkSession, given: list[str] | dict[str, str]) -> DataFrame:
    """Keyed rows from a list (keys from 1) or a dictionary; missing sequences are empty."""
    rows = given.items() if isinstance(given, dict) else ((str(i), s) for i, s in enumerate(given, 1))
    return spark.createDataFrame([(k, s or "") for k, s in rows], "key string, sequence string")


def read_chamber(spark: SparkSession, path: str, value: str, include: str | None = None, exclude: str | None = None, control: str = "^Neg", length: int = 36, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """An array file (Name, Sequence and a value column) as probe rows (name, type, ori, rep, sequence, intensity) and control rows (name, ori, rep, ..).

    Names are split from the right; the patterns choose among the probes; sequences are cut to the probe without its primer.
    """
    raw = spark.read.csv(path, sep=sep, header=True).select(F.col("Name").alias("full"), F.substring("Sequence", 1, length).alias("sequence"), F.col(value).cast("double").alias("intensity"))
    is_control = F.coalesce(F.col("full").rlike(control), F.lit(False))
    probes = parse_probe_name(include_exclude(raw.where(~is_control), "full", include, exclude), "full")
    parts = [F.regexp_extract("full", r"^(.*)_([^_]+)_([^_]+)$", i + 1).alias(c) for i, c in enumerate(("name", "ori", "rep"))]
    return probes.select("name", "type", "ori", "rep", "sequence", "intensity"), raw.where(is_control).select(*parts, "sequence", "intensity")


def read_result_tree(spark: SparkSession, glob: str, pattern: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Delimited files of one header under a path pattern; columns from the groups of a regular expression over each file's path."""
    found = spark.read.csv(glob, sep=sep, header=True)
    return found.select("*", *[F.regexp_extract(F.input_file_name(), pattern, i + 1).alias(c) for i, c in enumerate(columns)])


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline, written over what is at the path."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S21."""
    return PipelineModel.load(path)
