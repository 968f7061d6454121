"""Queries of picks for an array, verdicts on site pairs, and site extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindframe.functions.calling import Caller, matrix_caller
from bindframe.functions import sequences as fn
from bindframe.operators import picks as op
from bindframe.operators import sites as site
from bindframe.operators.selection import fetch_sequences
from bindframe.plans.rows import _named
from bindframe.plans.selection import CHUNK, _FETCHED, _IN_PEAKS, _RC, _align, _chunks, _intervals, _short
from bindframe.plans.sites import K, PAIRS, PROFILE, PWM, REGIONS, SCORES, SITES, _pwm_sql, _sites, _windows, kmer_scores
from bindframe.sources import views as v

COMMENTS = ("site1_left", "site1_right", "site2_left", "site2_right")
FLIP = {"to_right": "to_left", "to_left": "to_right"}
_COMMENT = "case " + " ".join(f"when ascii(md5(name)) % 4 = {i} then '{c}'" for i, c in enumerate(COMMENTS)) + " end"


def _designs(s, d):
    """Pairs as designs: the first name of a group is its wild type, comments say what a mutant changes."""
    pairs = v.pairs(s, d)
    rows = pairs.join(pairs.groupBy("grp").agg(F.min("name").alias("first")), "grp")
    return rows.selectExpr("grp", "name", "name = first as wild", f"if(name = first, 'wt', {_COMMENT}) as comment", "distance", "str_score", "wk_score", "probability", "ascii(md5(name)) % 16 / 10.0D as second")


def _paired(s, d):
    return _sites(s, d).groupBy("key").agg(F.count("*").alias("n"), F.min_by("orientation", "pos").alias("a"), F.max_by("orientation", "pos").alias("b")).where("n = 2")


def _condensed(s, d):
    """Scores by the number of the canonical k-mer, and the number that each k-mer's own leads to."""
    code = "aggregate(split({}, ''), 0L, (x, b) -> x * 4 + locate(b, 'ACGT') - 1)"
    index = kmer_scores(s).withColumn("c", fn.canonical(F.col("kmer"))).selectExpr(f"{code.format('kmer')} as code", f"{code.format('c')} as line")
    return _short(s, d).where(f"length(kmer) = {K}").selectExpr(f"{code.format('kmer')} as line", "score"), index


def _training(s, d):
    pairs = v.sequences(s, d).join(site.site_pairs(_sites(s, d)), "key")
    features = pairs.selectExpr("sequence", "pos_1 - 2 as core1_start", "pos_1 + 2 as core1_end", "pos_2 - 2 as core2_start", "pos_2 + 2 as core2_end", "score_1 as site1_pref", "score_2 as site2_pref", "distance")
    return features, pairs.selectExpr("key as id", "concat('n', key) as name", "sequence", "case length(key) % 3 when 0 then 'cooperative_o1' when 1 then 'anticoop_o2' else 'independent' end as class")


def _stepped(s, d):
    rows = v.sequences(s, d).selectExpr("key", "sequence", "cast(split(key, '_')[1] as int) % 5 - 2 as step", "if(length(key) % 2 = 0, 'o1', 'o2') as ori", "'o1' as orig_ori")
    return rows.select("key", "ori", "orig_ori", op.step_type(F.col("step"), F.col("sequence"), 36).alias("type"))


def _picked(df):
    return df.select("grp", "name")


QUERIES = {
    "i23_group_shifts": lambda s, d: op.group_shifts(_designs(s, d), "grp", "probability", "strength"),
    "i25_inconsistent": lambda s, d: _picked(op.pick_inconsistent(_designs(s, d), "grp", "probability", "second", 20, 2)),
    "i26_shift_by_distance": lambda s, d: _picked(op.pick_largest_shift(_designs(s, d), "grp", "probability", "distance", 20, 2)),
    "i26_shift_by_orientation": lambda s, d: _picked(op.pick_largest_shift(_designs(s, d), "grp", "probability", "orientation", 20, 2)),
    "i26_most_ones": lambda s, d: _picked(op.pick_most_ones(_designs(s, d), "grp", "probability", "distance", 20, 2)),
    "i27_small_change": lambda s, d: _picked(op.pick_small_change(_designs(s, d), "grp", "probability", "site1", "str_score", 0.5)),
    "i27_large_change": lambda s, d: _picked(op.pick_large_change(_designs(s, d), "grp", "site2", "wk_score", 20, 2, 0.3)),
    "k14_pair_verdicts": lambda s, d: op.pair_verdicts_in_rows(v.sequences(s, d), matrix_caller(PWM, 3.0), Caller(K, site.score_table(kmer_scores(s), K), 0.2), 1, 0.0),
    "j11_similar_by_ratio": lambda s, d: op.similar_by_ratio(_named(s, d).withColumn("wild", F.col("key") == F.concat("name", F.lit("_0"))), 4),
    "i30_labelled_training": lambda s, d: op.labelled_training(*_training(s, d)),
    "i22_turned_variant": lambda s, d: op.turned_variant(_stepped(s, d), FLIP).select("key", "type"),
    "s6_condensed_escores": lambda s, d: op.expand_by_index(*_condensed(s, d), K),
    "p13_known_orientation": lambda s, d: _paired(s, d).select("key", op.known_orientation(F.col("a"), F.col("b")).alias("o")).select("key", "o", fn.head_tail(F.col("o")).alias("ht")),
    "k8_site_extents": lambda s, d: op.site_extents(_intervals(s, d), site.alignment_sites(fetch_sequences(_intervals(s, d), _chunks(s, d), CHUNK).select(F.col("name").alias("key"), "sequence"), _align(s), K, (3, 5), 4, 0.1)),
}

S = v.with_views("sequences")
DESIGNS = f"{v.with_views('pairs')}, designs AS (SELECT grp, name, name = min(name) OVER (PARTITION BY grp) AS wild, CASE WHEN name = min(name) OVER (PARTITION BY grp) THEN 'wt' ELSE {_COMMENT} END AS comment, distance, str_score, wk_score, probability, (ascii(md5(name)) % 16) / 10.0::DOUBLE AS second FROM pairs)"
SHIFTS = """c AS (SELECT *, (probability >= 0.5)::INT AS c FROM designs),
g AS (SELECT grp, count(*) AS n, count(*) FILTER (c = 0) AS n_zero, count(*) FILTER (c = 1) AS n_one, max(probability) - min(probability) AS range, first(c ORDER BY distance, name) <> last(c ORDER BY distance, name) AS ends, max(c) FILTER (wild) AS w, count(*) FILTER (NOT wild AND c = 0) AS m0, count(*) FILTER (NOT wild AND c = 1) AS m1 FROM c GROUP BY grp)"""
_OTHERS = "n > 1 AND CASE w WHEN 1 THEN m0 ELSE m1 END >= {}"


def _ends(source: str, score: str, n: int) -> str:
    """Wild types, both ends and n of the others of a table of designs."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY grp, wild ORDER BY {score}, name) AS lo, row_number() OVER (PARTITION BY grp, wild ORDER BY {score} DESC, name DESC) AS hi FROM {source}),
e AS (SELECT *, wild OR lo = 1 OR hi = 1 AS fin FROM r) SELECT grp, name FROM e QUALIFY fin OR row_number() OVER (PARTITION BY grp, fin ORDER BY md5('seed' || name), name) <= {n}"""


def _shifted(shift: str) -> str:
    return f"{DESIGNS}, {SHIFTS}, top AS (SELECT * FROM designs WHERE grp IN (SELECT grp FROM g ORDER BY {shift} DESC, range DESC, grp LIMIT 20)), {_ends('top', 'probability', 2)}"


ORACLE_SQL = {
    "i23_group_shifts": f"{DESIGNS}, {SHIFTS} SELECT grp, n, n_zero, n_one, range, {_OTHERS.format(2)} AS shifted FROM g",
    "i25_inconsistent": f"{DESIGNS}, ap AS (SELECT * FROM designs WHERE (probability >= 0.5) <> (second >= 0.5)), top AS (SELECT * FROM ap WHERE grp IN (SELECT grp FROM ap GROUP BY grp ORDER BY max(abs(probability - second)) DESC, grp LIMIT 20)), {_ends('top', 'probability', 2)}",
    "i26_shift_by_distance": _shifted("(ends AND n > 1)"),
    "i26_shift_by_orientation": _shifted(f"({_OTHERS.format(1)})"),
    "i26_most_ones": f"{DESIGNS}, {SHIFTS}, top AS (SELECT * FROM designs WHERE grp IN (SELECT grp FROM g WHERE ends AND n > 1 AND n_zero > 0 AND n_one > 0 ORDER BY n_one DESC, grp LIMIT 20)), {_ends('top', 'probability', 2)}",
    "i27_small_change": f"{DESIGNS}, q AS (SELECT * FROM designs WHERE wild OR contains(comment, 'site1')), b AS (SELECT grp, probability >= 0.5 AS c, str_score AS s FROM q WHERE wild), k AS (SELECT grp, name, wild FROM q JOIN b USING (grp) WHERE wild OR ((probability >= 0.5) <> c AND abs(str_score - s) < 0.5)) SELECT grp, name FROM k QUALIFY bool_or(NOT wild) OVER (PARTITION BY grp)",
    "i27_large_change": f"""{DESIGNS}, mu AS (SELECT * FROM designs WHERE NOT wild AND contains(comment, 'site2')), t AS (SELECT grp FROM mu GROUP BY grp ORDER BY max(wk_score) - min(wk_score) DESC, grp LIMIT 20),
h AS (SELECT *, row_number() OVER a AS lo, row_number() OVER (PARTITION BY grp ORDER BY wk_score DESC, name DESC) AS hi, lead(name) OVER a AS nn, lead(comment) OVER a AS nc, lead(wk_score) OVER a AS ns FROM mu WHERE grp IN (FROM t) WINDOW a AS (PARTITION BY grp ORDER BY wk_score, name)),
p AS (SELECT grp, name, nn FROM h WHERE ns - wk_score < 0.3 AND contains(comment || nc, 'left') AND contains(comment || nc, 'right') QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5(name), name, nn) <= 2)
SELECT grp, name FROM p UNION SELECT grp, nn FROM p UNION SELECT grp, name FROM h WHERE lo = 1 OR hi = 1 UNION SELECT grp, name FROM designs WHERE wild AND grp IN (FROM t)""",
    "k14_pair_verdicts": f"""{PROFILE}, {_pwm_sql()}, {REGIONS}, s AS (SELECT key, mid AS pos FROM scan WHERE score > 3),
i AS (SELECT s.key, pos, min(startpos) AS a, min_by(escorelength, startpos) AS len FROM s JOIN regions q ON q.key = s.key AND pos BETWEEN startpos AND startpos + escorelength GROUP BY s.key, pos),
t AS (SELECT key, count(*) AS n, min(pos) AS p1, max(pos) AS p2, min_by(a + len, pos) AS lo, max_by(a, pos) AS hi FROM i GROUP BY key),
o AS (SELECT DISTINCT t.key FROM t JOIN profile f ON f.key = t.key AND f.score < 0 AND f.start >= lo AND f.start < hi)
SELECT q.key, coalesce(n, 0) AS n_sites, CASE WHEN n = 2 THEN p1 END AS pos_1, CASE WHEN n = 2 THEN p2 END AS pos_2, CASE WHEN n = 2 THEN p2 - p1 END AS distance,
  CASE WHEN coalesce(n, 0) <> 2 THEN 'sites' WHEN p2 - p1 NOT BETWEEN 10 AND 20 THEN 'distance' WHEN o.key IS NULL THEN 'linker' ELSE 'valid' END AS status
FROM sequences q LEFT JOIN t ON t.key = q.key LEFT JOIN o ON o.key = q.key""",
    "i30_labelled_training": f"""{SITES}, {PAIRS}, f AS (SELECT q.key, sequence, pos_1, pos_2, score_1, score_2, CASE length(q.key) % 3 WHEN 0 THEN 'cooperative_o1' WHEN 1 THEN 'anticoop_o2' ELSE 'independent' END AS class FROM sequences q JOIN pr ON pr.key = q.key),
m AS (SELECT sequence, floor((median(pos_1 - 2) + median(pos_1 + 2)) / 2)::BIGINT AS a, floor((median(pos_2 - 2) + median(pos_2 + 2)) / 2)::BIGINT AS b, median(score_1) AS x, median(score_2) AS y, median(pos_2 - pos_1) AS distance FROM f GROUP BY sequence),
c AS (SELECT sequence, key, class FROM f QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY class, key) = 1)
SELECT key AS id, 'n' || key AS name, c.sequence, CASE WHEN x > y THEN a ELSE b END AS site_str_pos, CASE WHEN x > y THEN b ELSE a END AS site_wk_pos, CASE WHEN x > y THEN x ELSE y END AS site_str_score, CASE WHEN x > y THEN y ELSE x END AS site_wk_score, distance, split_part(class, '_', 1) AS label
FROM c JOIN m ON m.sequence = c.sequence WHERE a + b IN (36, 37)""",
    "i22_turned_variant": f"{S}, q AS (SELECT key, length(key) % 2 = 0 AS same, split_part(key, '_', 2)::INT % 5 - 2 AS step, length(sequence) = 36 AS whole FROM sequences) SELECT key, CASE WHEN step = 0 THEN 'orig' WHEN NOT whole THEN 'shorter' WHEN (step > 0) = same THEN 'to_right' ELSE 'to_left' END AS type FROM q",
    "s6_condensed_escores": f"{S}, {_windows(K)}, sh AS (SELECT least(kmer, {_RC('kmer')}) AS kmer, count(*)::DOUBLE AS score FROM windows GROUP BY 1), {SCORES} SELECT a.kmer, sh.score FROM scores a JOIN sh ON sh.kmer = least(a.kmer, {_RC('a.kmer')})",
    "p13_known_orientation": f"{SITES}, o AS (SELECT key, CASE min_by(orientation, pos) WHEN 1 THEN '+' ELSE '-' END || '/' || CASE max_by(orientation, pos) WHEN 1 THEN '+' ELSE '-' END AS o FROM s GROUP BY key HAVING count(*) = 2) SELECT key, o, CASE o WHEN '+/-' THEN 'HH' WHEN '-/+' THEN 'TT' ELSE 'HT/TH' END AS ht FROM o",
    "k8_site_extents": f"SELECT name, iv.chr, CASE WHEN strand = '-' THEN end_pos - core_end ELSE start_pos + core_start END AS start_pos, CASE WHEN strand = '-' THEN end_pos - core_start ELSE start_pos + core_end END AS end_pos, CASE WHEN strand = '-' THEN -orientation ELSE orientation END AS orientation FROM ({_IN_PEAKS}) c JOIN (SELECT event_id::VARCHAR AS name, (event_id % 997)::VARCHAR AS chr, event_id * 97 % 300 AS start_pos, event_id * 97 % 300 + 20 + event_id % 60 AS end_pos, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events) iv ON c.key = iv.name",
}
