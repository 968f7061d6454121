"""Queries of features around two sites, of base weights, and of names by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.operators import features as op
from bindframe.plans.replicates import _predicted
from bindframe.plans.sites import SITES, _scored, _sites
from bindframe.plans.tables import TWO, _pairs
from bindframe.sources import views as v


def _turned_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs whose first site is the right one in every other sequence."""
    odd = F.length("key") % 2 == 1
    return _pairs(s, d).select("key", "sequence", F.when(odd, F.col("pos_2")).otherwise(F.col("pos_1")).alias("pos_1"), F.when(odd, F.col("pos_1")).otherwise(F.col("pos_2")).alias("pos_2"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return v.sequences(s, d).select(F.when(F.length("sequence") == v.PROBE_LENGTH, "whole").otherwise("rest").alias("label"), "sequence")


def _factors(s: SparkSession, d: str) -> DataFrame:
    return _sites(s, d).withColumn("factor", F.when(F.col("orientation") == 1, "ets").otherwise("runx"))


QUERIES = {
    "f4_inner_flanks": lambda s, d: op.pair_flank_kmers(_turned_pairs(s, d), 4, 2, "relative"),
    "f4_outer_flanks": lambda s, d: op.pair_flank_kmers(_pairs(s, d), -4, 2),
    "f4_linker_kmers": lambda s, d: op.pair_flank_kmers(_pairs(s, d), 3, 2, "linker"),
    "f6_linker_features": lambda s, d: op.linker_features(_pairs(s, d), 4, 2),
    "f7_canonical_shares": lambda s, d: op.canonical_counts(v.sequences(s, d), 2, average=True),
    "a17_base_weights": lambda s, d: op.base_weights(_labelled(s, d)),
    "j14_label_names": lambda s, d: op.label_names(v.pairs(s, d).where("distance < 20"), _predicted(s, d).where("distance > 8").select("name", F.col("predicted").alias("label"))),
    "k20_factor_summary": lambda s, d: op.factor_summary(_factors(s, d), ["ets", "runx"]),
    "k21_left_training": lambda s, d: op.side_training(_scored(s, d), 8, ["GGAA", "GGAT"], "left"),
}

_TURNED = f"{TWO}, tp AS (SELECT key, sequence, CASE WHEN length(key) % 2 = 1 THEN pos_2 ELSE pos_1 END AS a, CASE WHEN length(key) % 2 = 1 THEN pos_1 ELSE pos_2 END AS b FROM two)"
_KMERS = "SELECT key, {label} AS label, site, k, i AS position, substr(flank, i::INT + 1, k::INT) AS kmer FROM (SELECT *, unnest(range(0, length(flank) - k + 1)) AS i FROM (SELECT *, unnest([1, 2]) AS k FROM fl))"
_SLICE = lambda a, b: f"substr(sequence, greatest(0, {a})::INT + 1, greatest(0, least({b}, length(sequence)) - greatest(0, {a}))::INT)"

ORACLE_SQL = {
    "f4_inner_flanks": f"{_TURNED}, lr AS (SELECT *, least(a, b) AS l, greatest(a, b) AS r, CASE WHEN a < b THEN 's1' ELSE 's2' END AS ln, CASE WHEN a < b THEN 's2' ELSE 's1' END AS rn FROM tp), fl AS (SELECT key, ln AS site, {_SLICE('l', 'l + 4')} AS flank FROM lr UNION ALL SELECT key, rn, reverse({_SLICE('r - 4', 'r')}) FROM lr) {_KMERS.format(label=repr('inner'))}",
    "f4_outer_flanks": f"{TWO}, fl AS (SELECT key, 's1' AS site, reverse({_SLICE('pos_1 - 4', 'pos_1')}) AS flank FROM two UNION ALL SELECT key, 's2', {_SLICE('pos_2', 'pos_2 + 4')} FROM two) {_KMERS.format(label=repr('outer'))}",
    "f4_linker_kmers": f"{TWO}, md AS (SELECT key, sequence, (pos_1 + pos_2) // 2 AS m FROM two), fl AS (SELECT key, 'toright' AS site, {_SLICE('m', 'm + 3')} AS flank FROM md UNION ALL SELECT key, 'toleft', {_SLICE('m - 3', 'm')} FROM md) {_KMERS.format(label=repr('linker'))}",
    "f6_linker_features": f"{TWO}, lk AS (SELECT key, {_SLICE('pos_1 + 4', 'pos_2')} AS q FROM two), w AS (SELECT key, q, substr(q, i::INT + 1, 2) AS kmer FROM (SELECT *, unnest(range(0, length(q) - 1)) AS i FROM lk WHERE length(q) >= 2)) SELECT key, kmer, count(*) / (length(q) - 1) AS ratio, length(regexp_replace(q, '[^GC]', '', 'g')) / length(q) AS gc FROM w GROUP BY key, q, kmer",
    "f7_canonical_shares": f"{v.with_views('sequences')}, w AS (SELECT key, sequence, k, substr(sequence, i::INT + 1, k::INT) AS m FROM (SELECT *, unnest(range(0, length(sequence) - k + 1)) AS i FROM (SELECT *, unnest([1, 2]) AS k FROM sequences))), c AS (SELECT key, k, length(sequence) AS n, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS kmer FROM w) SELECT key, kmer, count(*) / (n - k + 1) AS n FROM c GROUP BY key, k, c.n, kmer",
    "a17_base_weights": f"{v.with_views('sequences')}, c AS (SELECT label, i AS position, substr(sequence, i::INT + 1, 1) AS base, count(*) AS n FROM (SELECT CASE WHEN length(sequence) = 36 THEN 'whole' ELSE 'rest' END AS label, sequence, unnest(range(0, length(sequence))) AS i FROM sequences) GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY label, position) AS share FROM c) SELECT *, greatest(0, log2(share / 0.25)) AS weight FROM s",
    "j14_label_names": f"{v.with_views('pairs')}, a AS (SELECT name, label FROM pairs WHERE distance < 20), b AS (SELECT name, CASE WHEN probability > 0.6 THEN 'cooperative' WHEN probability > 0.3 THEN 'independent' ELSE 'anticooperative' END AS label FROM pairs WHERE distance > 8) SELECT coalesce(a.name, b.name) AS name, a.label AS label_a, b.label AS label_b, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' WHEN a.label = b.label THEN 'agree' ELSE 'differ' END AS kind FROM a FULL JOIN b ON a.name = b.name",
    "k20_factor_summary": f"""{SITES}, f AS (SELECT key, pos, score, orientation = 1 AS e FROM s),
g AS (SELECT key, count(*) AS n_sites, max(pos) - min(pos) AS span, count(*) FILTER (e) AS ets_n, first(pos ORDER BY score DESC, pos) FILTER (e) AS ets_pos, max(score) FILTER (e) AS ets_score, count(*) FILTER (NOT e) AS runx_n, first(pos ORDER BY score DESC, pos) FILTER (NOT e) AS runx_pos, max(score) FILTER (NOT e) AS runx_score FROM f GROUP BY key)
SELECT *, abs(ets_pos - runx_pos) AS distance FROM g""",
    "k21_left_training": f"{v.with_views('sequences')}, w AS (SELECT sequence, length(sequence) + 1.5::DOUBLE * length(regexp_replace(sequence, '[^G]', '', 'g')) AS sc, unnest(range(0, length(sequence) - 7))::INT AS i FROM sequences) SELECT substr(sequence, i + 1, 8) AS \"window\", median(sc)::DOUBLE AS score FROM w WHERE substr(sequence, i + 1, 4) IN ('GGAA', 'GGAT') GROUP BY 1",
}
