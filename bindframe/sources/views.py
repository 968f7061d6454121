"""Binding-data tables derived from the driver's tables: intervals, sequences, probes, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of a probe.
PROBE_LENGTH = 36

CHROMOSOMES = [*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('chr', cast(1 + o_custkey % 22 as string)) as chr", "1000 + (o_orderkey * 37) % 100000 as start_pos",
        "1100 + (o_orderkey * 37) % 100000 + o_orderkey % 200 as end_pos", "o_totalprice as score", "o_orderkey % 100 as summit")


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(1 + l_orderkey % 22 as string)) as chr", "1000 + (l_partkey * 53 + l_orderkey * 11) % 100000 as start_pos",
        "1020 + (l_partkey * 53 + l_orderkey * 11) % 100000 + l_suppkey % 30 as end_pos", "l_quantity as pileup")


def sites(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('chr', cast(1 + user_id % 22 as string)) as chr", f"1000 + (event_id * 97 + {shift}) % 100000 as start_pos", f"1006 + (event_id * 97 + {shift}) % 100000 as end_pos")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): every whole text as bases."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


def sequences(spark: SparkSession, sf_dir: str, length: int = PROBE_LENGTH, window: int = 1) -> DataFrame:
    """(key, sequence): whole texts as bases, cut into probes one after the other.

    With a window each piece goes on for window - 1 bases into the next, so that every window of a text
    lies in exactly one piece, the one where it starts.
    """
    # one pass over the text, which substring() at each place would not be
    found = lambda group: F.regexp_extract_all("seq", F.lit(f"(.{{1,{length}}})(?=(.{{0,{window - 1}}}))"), F.lit(group))
    pieces = found(1) if window == 1 else F.zip_with(found(1), found(2), lambda piece, more: F.concat(piece, more))
    tiles = F.posexplode(pieces).alias("tile", "sequence")
    return bases(spark, sf_dir).where("seq <> ''").select("doc_id", tiles).select(F.expr("concat(doc_id, '_', tile)").alias("key"), "sequence")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, type, ori, rep, intensity): each 24 rows of a part are a full design of their own."""
    ordered = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as int) as rn", "count(*) over (partition by l_partkey) as n")
    return ordered.where("rn < 24 * (n div 24)").selectExpr("*", "cast(rn div 24 as int) as block").withColumn("rn", F.expr("rn % 24")).selectExpr(
        "concat('p', cast(l_partkey as string), '_', block) as name", "case rn % 4 when 0 then 'wt' when 1 then 'm1' when 2 then 'm2' else 'm3' end as type",
        "case when (rn div 4) % 2 = 0 then 'o1' else 'o2' end as ori", "1 + rn div 8 as rep", "l_extendedprice as intensity", "l_quantity as quantity")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, ori, intensity): negative controls, the rows that fill no design of 24."""
    ordered = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as int) as rn", "count(*) over (partition by l_partkey) as n")
    return ordered.where("rn >= 24 * (n div 24)").selectExpr("concat('n', cast(l_partkey as string)) as name", "case when l_linenumber % 2 = 0 then 'o1' else 'o2' end as ori", "l_extendedprice as intensity")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, distance, orientation, str_score, wk_score, probability): labelled site pairs."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('s', cast(o_orderkey as string)) as name", "case o_orderkey % 3 when 0 then 'cooperative' when 1 then 'independent' else 'anticooperative' end as label",
        "cast(4 + o_custkey % 21 as int) as distance", "case o_custkey % 3 when 0 then 'HH' when 1 then 'TT' else 'HT/TH' end as orientation",
        "o_totalprice / 100000 as str_score", "o_totalprice / 200000 as wk_score", "(o_orderkey * 7919 % 1000) / 1000.0D as probability", "o_custkey as grp")


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "peaks": "peaks AS (SELECT concat('chr', CAST(1 + o_custkey % 22 AS VARCHAR)) AS chr, 1000 + (o_orderkey * 37) % 100000 AS start_pos, 1100 + (o_orderkey * 37) % 100000 + o_orderkey % 200 AS end_pos, o_totalprice AS score, o_orderkey % 100 AS summit FROM orders)",
    "pileup": "pileup AS (SELECT concat('chr', CAST(1 + l_orderkey % 22 AS VARCHAR)) AS chr, 1000 + (l_partkey * 53 + l_orderkey * 11) % 100000 AS start_pos, 1020 + (l_partkey * 53 + l_orderkey * 11) % 100000 + l_suppkey % 30 AS end_pos, l_quantity AS pileup FROM lineitem)",
    "sites": "sites AS (SELECT concat('chr', CAST(1 + user_id % 22 AS VARCHAR)) AS chr, 1000 + (event_id * 97) % 100000 AS start_pos, 1006 + (event_id * 97) % 100000 AS end_pos FROM events)",
    "sites2": "sites2 AS (SELECT concat('chr', CAST(1 + user_id % 22 AS VARCHAR)) AS chr, 1000 + (event_id * 97 + 41) % 100000 AS start_pos, 1006 + (event_id * 97 + 41) % 100000 AS end_pos FROM events)",
    "sequences": "bases AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents), sequences AS (SELECT concat(doc_id, '_', tile) AS key, substr(seq, (1 + 36 * tile)::INT, 36) AS sequence FROM (SELECT doc_id, seq, unnest(range(0, (length(seq) + 35) // 36)) AS tile FROM bases))",
    "probes": "probes AS (SELECT concat('p', CAST(l_partkey AS VARCHAR), '_', place // 24) AS name, CASE rn % 4 WHEN 0 THEN 'wt' WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' ELSE 'm3' END AS type, CASE WHEN (rn // 4) % 2 = 0 THEN 'o1' ELSE 'o2' END AS ori, 1 + rn // 8 AS rep, l_extendedprice AS intensity, l_quantity AS quantity FROM (SELECT *, place % 24 AS rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS place, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)) WHERE place < 24 * (n // 24))",
    "controls": "controls AS (SELECT concat('n', CAST(l_partkey AS VARCHAR)) AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'o1' ELSE 'o2' END AS ori, l_extendedprice AS intensity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS place, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE place >= 24 * (n // 24))",
    "pairs": "pairs AS (SELECT concat('s', CAST(o_orderkey AS VARCHAR)) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'cooperative' WHEN 1 THEN 'independent' ELSE 'anticooperative' END AS label, CAST(4 + o_custkey % 21 AS INT) AS distance, CASE o_custkey % 3 WHEN 0 THEN 'HH' WHEN 1 THEN 'TT' ELSE 'HT/TH' END AS orientation, o_totalprice / 100000 AS str_score, o_totalprice / 200000 AS wk_score, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS probability, o_custkey AS grp FROM orders)",
}


def with_windows(window: int) -> str:
    """The view of sequences whose pieces go on for window - 1 bases."""
    return with_views("sequences").replace(f", {PROBE_LENGTH}) AS sequence", f", {PROBE_LENGTH + window - 1}) AS sequence")


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
