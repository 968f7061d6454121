"""Queries of the operators on rows with positions, groups and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindframe.operators import rows as op
from bindframe.plans.sites import PWM, SITES, _sites
from bindframe.sources import views as v


def _strands(s, d):
    """Pairs with positions and strands by formula."""
    return v.pairs(s, d).selectExpr("name", "distance as pos_1", "distance + 7 as pos_2", "case orientation when 'HH' then '+' else '-' end as strand_1", "case orientation when 'TT' then '+' else '-' end as strand_2")


def _two(s, d):
    return v.sequences(s, d).selectExpr("key", "sequence", "length(key) * 5 % 17 as start_1", "8 as start_2")


def _strong(s, d):
    return v.pairs(s, d).selectExpr("name", "distance as site_str_pos", "12 as site_wk_pos", "str_score", "wk_score")


def _types(s, d, kind):
    return v.probes(s, d).where(F.col("type") == kind).select("name", "ori", "rep", "intensity")


def _named(s, d):
    return v.sequences(s, d).selectExpr("split(key, '_')[0] as name", "key", "sequence")


def _mapping(s, d):
    return v.sequences(s, d).where("key like '%\\\\_0'").groupBy(F.col("sequence").alias("designed")).agg(F.min("key").alias("source"))


QUERIES = {
    "p8_flip_strand": lambda s, d: op.flip_strand(_strands(s, d), 36),
    "p9_orient_by_factor": lambda s, d: op.orient_by_factor(_two(s, d), 4),
    "p11_to_positional": lambda s, d: op.to_positional(_strong(s, d)),
    "p12_rebase": lambda s, d: op.rebase_coordinates(v.peaks(s, d).selectExpr("chr", "start_pos", "start_pos + summit as at"), "at", "start_pos"),
    "p16_drop_sentinels": lambda s, d: op.drop_sentinels(v.pairs(s, d).selectExpr("name", "if(distance = 4, -999, str_score) as score"), ["score"]),
    "p20_required_columns": lambda s, d: op.required_columns(v.pairs(s, d), ["name", "label"]).select("name", "label"),
    "j9_chamber_join": lambda s, d: op.chamber_join(_types(s, d, "m1"), _types(s, d, "wt"), ["name", "ori", "rep"]),
    "j11_similar_sequences": lambda s, d: op.similar_sequences(_named(s, d), 2, wild=F.col("key") == F.concat("name", F.lit("_0")), ties=("key",)).select("key", "matches"),
    "j12_keep_groups": lambda s, d: op.keep_groups(v.pairs(s, d), v.pairs(s, d).where("probability > 0.95").select("grp"), "grp").select("name", "grp"),
    "j13_rest_of": lambda s, d: op.rest_of(v.pairs(s, d).selectExpr("name", "if(distance > 20, null, probability) as probability"), F.col("probability") >= 0.3),
    "j17_restore_sequences": lambda s, d: op.restore_sequences(v.sequences(s, d), _mapping(s, d)).groupBy("sequence").agg(F.count("*").alias("n")),
    "j20_site_at": lambda s, d: op.site_at(v.sequences(s, d).select("key"), _sites(s, d), F.lit(18), 2),
    "w3_by_appearance": lambda s, d: op.by_appearance(v.pairs(s, d), ["grp"], "orientation", "name"),
    "w10_dense_ids": lambda s, d: op.dense_ids(v.pairs(s, d), "grp"),
    "w12_order_by_change": lambda s, d: op.order_by_change(v.pairs(s, d), "grp", "name", "str_score").select("name", "change", "place"),
    "t4_union_tables": lambda s, d: op.union_tables(v.pairs(s, d).select("grp", "label"), v.pairs(s, d).where("distance < 8").select("label", "grp"), distinct=True),
    "a6_count_by": lambda s, d: op.count_by(v.pairs(s, d), ["label", "orientation"], "grp"),
    "a17_base_counts": lambda s, d: op.base_counts(v.sequences(s, d)),
    "a36_delta_to_original": lambda s, d: op.delta_to_original(v.probes(s, d)),
    "k5_pwm_at": lambda s, d: op.pwm_at(v.sequences(s, d), PWM, F.lit(10), 4),
    "k11_multi_factor_sites": lambda s, d: op.multi_factor_sites(v.sequences(s, d), {"a": lambda _: _sites(s, d), "b": lambda _: _sites(s, d).where("score > 4.5")}),
    "k19_most_central_pair": lambda s, d: op.most_central_pair(_sites(s, d), 18),
    "i28_sub_select": lambda s, d: op.sub_select(v.pairs(s, d), "grp", "name", "str_score", 2).select("grp", "name"),
    "f3_affinity": lambda s, d: op.affinity_feature(v.pairs(s, d), "name", ["str_score", "wk_score"]),
}

P, S, R = (v.with_views(x) for x in ("pairs", "sequences", "probes"))
_BACK = [dict(zip("TGCA", (row[b] for b in "ACGT"), strict=True)) for row in reversed(PWM)]
_WAY = lambda rows: " + ".join(f"CASE substr(w, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {x}::DOUBLE" for b, x in row.items()) + " END" for i, row in enumerate(rows))

ORACLE_SQL = {
    "p8_flip_strand": f"{P}, q AS (SELECT name, distance AS a, distance + 7 AS b, CASE orientation WHEN 'HH' THEN '+' ELSE '-' END AS x, CASE orientation WHEN 'TT' THEN '+' ELSE '-' END AS y FROM pairs) SELECT name, CASE WHEN x || y = '--' THEN 36 - b ELSE a END AS pos_1, CASE WHEN x || y = '--' THEN 36 - a ELSE b END AS pos_2, CASE WHEN x || y = '--' THEN '+' ELSE x END AS strand_1, CASE WHEN x || y = '--' THEN '+' ELSE y END AS strand_2 FROM q",
    "p9_orient_by_factor": f"{S}, q AS (SELECT key, sequence, (length(key) * 5 % 17)::INT AS a FROM sequences) SELECT key, CASE WHEN a > 8 THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS sequence, CASE WHEN a > 8 THEN length(sequence)::INT - a - 4 ELSE a END AS start_1, CASE WHEN a > 8 THEN length(sequence)::INT - 12 ELSE 8 END AS start_2 FROM q",
    "p11_to_positional": f"{P} SELECT name, least(distance, 12) AS pos_1, greatest(distance, 12) AS pos_2, CASE WHEN distance <= 12 THEN str_score ELSE wk_score END AS score_1, CASE WHEN distance <= 12 THEN wk_score ELSE str_score END AS score_2 FROM pairs",
    "p12_rebase": f"{v.with_views('peaks')} SELECT chr, start_pos, summit + 1 AS at FROM peaks",
    "p16_drop_sentinels": f"{P} SELECT name, str_score AS score FROM pairs WHERE distance <> 4",
    "p20_required_columns": f"{P} SELECT name, label FROM pairs",
    "j9_chamber_join": f"{R} SELECT name, ori, rep, a.intensity AS intensity_x, b.intensity AS intensity_y FROM (SELECT * FROM probes WHERE type = 'm1') a JOIN (SELECT * FROM probes WHERE type = 'wt') b USING (name, ori, rep)",
    "j11_similar_sequences": f"{S}, q AS (SELECT split_part(key, '_', 1) AS name, key, sequence FROM sequences), m AS (SELECT b.name, b.key, b.sequence, len([i FOR i IN range(1, 37) IF substr(a.sequence, i, 1) = substr(b.sequence, i, 1) AND i <= length(a.sequence) AND i <= length(b.sequence)])::INT AS matches FROM q a JOIN q b ON a.name = b.name AND a.key = a.name || '_0' AND b.key <> a.key) SELECT key, matches FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY matches DESC, sequence, key) <= 2",
    "j12_keep_groups": f"{P} SELECT name, grp FROM pairs WHERE grp IN (SELECT grp FROM pairs WHERE probability > 0.95)",
    "j13_rest_of": f"{P} SELECT name, CASE WHEN distance <= 20 THEN probability END AS probability FROM pairs WHERE distance > 20 OR probability < 0.3",
    "j17_restore_sequences": f"{S}, m AS (SELECT sequence AS designed, min(key) AS source FROM sequences WHERE key LIKE '%!_0' ESCAPE '!' GROUP BY 1) SELECT coalesce(source, sequence) AS sequence, count(*) AS n FROM sequences LEFT JOIN m ON sequence = designed GROUP BY 1",
    "j20_site_at": f"{SITES} SELECT key, pos, score FROM s WHERE abs(pos - 18) <= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) = 1",
    "w3_by_appearance": f"{P}, f AS (SELECT grp, orientation, min(name) AS first FROM pairs GROUP BY 1, 2) SELECT grp, orientation, 'o' || row_number() OVER (PARTITION BY grp ORDER BY first, orientation) AS ori FROM f",
    "w10_dense_ids": f"{P}, k AS (SELECT DISTINCT grp FROM pairs) SELECT grp, row_number() OVER (ORDER BY md5(grp::VARCHAR)) AS id FROM k",
    "w12_order_by_change": f"{P}, b AS (SELECT grp, min_by(str_score, name) AS base, min(name) AS wild FROM pairs GROUP BY 1), c AS (SELECT name, grp, str_score - base AS change FROM pairs JOIN b USING (grp) WHERE name <> wild) SELECT name, change, row_number() OVER (PARTITION BY grp ORDER BY abs(change) DESC, name)::INT AS place FROM c",
    "t4_union_tables": f"{P} SELECT DISTINCT grp, label FROM pairs",
    "a6_count_by": f"{P} SELECT label, orientation, count(*) AS n, count(DISTINCT grp) AS names FROM pairs GROUP BY 1, 2",
    "a17_base_counts": f"{S}, c AS (SELECT i::INT - 1 AS position, substr(sequence, i::INT, 1) AS base FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS i FROM sequences)) SELECT position, " + ", ".join(f"count(*) FILTER (base = '{b}') AS {b}, count(*) FILTER (base = '{b}') / count(*) AS share_{b}" for b in "ACGT") + " FROM c GROUP BY 1",
    "a36_delta_to_original": f"{R}, m AS (SELECT name, type, median(intensity) AS median FROM probes GROUP BY 1, 2) SELECT a.name, a.type, a.median, a.median - b.median AS delta FROM m a JOIN m b ON a.name = b.name AND b.type = 'wt' AND a.type <> 'wt'",
    "k5_pwm_at": f"{S}, q AS (SELECT key, substr(sequence, 11, 4) AS w FROM sequences), z AS (SELECT key, w, {_WAY(PWM)} AS f, {_WAY(_BACK)} AS r FROM q) SELECT key, CASE WHEN length(w) = 4 THEN greatest(f, r) ELSE -999.0::DOUBLE END AS score, CASE WHEN length(w) = 4 THEN CASE WHEN f > r + 1e-9 THEN '+' ELSE '-' END END AS strand, w AS core FROM z",
    "k11_multi_factor_sites": f"{SITES}, u AS (SELECT key, 'a' AS factor, pos, score FROM s UNION ALL SELECT key, 'b', pos, score FROM s WHERE score > 4.5) SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, factor)::INT AS number FROM u",
    "k19_most_central_pair": f"{SITES}, q AS (SELECT a.key, a.pos AS pos_1, b.pos AS pos_2, abs((a.pos + b.pos) / 2 - 18)::DOUBLE AS off FROM s a JOIN s b ON a.key = b.key AND a.pos < b.pos) SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY off, pos_1, pos_2) = 1",
    "i28_sub_select": f"{P}, w AS (SELECT *, name = min(name) OVER (PARTITION BY grp) AS wild FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY grp, wild ORDER BY str_score, name) AS low, row_number() OVER (PARTITION BY grp, wild ORDER BY str_score DESC, name) AS high FROM w), e AS (SELECT *, wild OR low = 1 OR high = 1 AS fin FROM r) SELECT grp, name FROM e QUALIFY fin OR row_number() OVER (PARTITION BY grp, fin ORDER BY md5('seed' || name)) <= 2",
    "f3_affinity": f"{P} SELECT name, str_score, wk_score, (str_score + wk_score) / 2 AS mean_strength FROM pairs",
}
