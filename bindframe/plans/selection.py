"""Queries of shapes, tests between labels, sites in peaks and flanks, and selections of designed groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindframe.functions.calling import matrix_caller
from bindframe.functions import sequences as fn
from bindframe.operators import replicates, rows, tables
from bindframe.operators import selection as op
from bindframe.operators import sites as site
from bindframe.plans import replicates as rep
from bindframe.plans.rows import _BACK, _WAY
from bindframe.plans.rows import ORACLE_SQL as ROW_SQL
from bindframe.plans.sites import K, PAIRS, PROFILE, PWM, REGIONS, SCORES, SITES, _pwm_sql, _regions, _scored, _sites, _windows, kmer_scores
from bindframe.plans.sites import ORACLE_SQL as SITE_SQL
from bindframe.plans.tables import TWO, _pairs
from bindframe.sources import views as v

CHUNK = 64
#: A primer in which the matrix finds no site, unlike the one of the array.
QUIET_PRIMER = "CACACGTCTG"
CUTS = [round(0.05 * i, 2) for i in range(1, 21)]
VALUES = "transform(sequence(0, length(sequence) - 1), i -> if(i >= 30 and length(key) % 3 = 0, null, (ascii(substring(sequence, i + 1, 1)) * 31 + i * 17) % 101 / 10.0D))"


def _call(df):
    return site.pwm_scan(df, PWM, above=3.0).selectExpr("key", "mid as pos", "score", "orientation")


def _intervals(s, d):
    return v.table(s, d, "events").selectExpr("cast(event_id as string) as name", "cast(event_id % 997 as string) as chr", "event_id * 97 % 300 as start_pos", "event_id * 97 % 300 + 20 + event_id % 60 as end_pos", "if(event_id % 2 = 0, '+', '-') as strand")


def _chunks(s, d):
    return op.genome_chunks(v.bases(s, d).selectExpr("cast(doc_id as string) as chr", "seq"), CHUNK)


def _align(s):
    return kmer_scores(s).selectExpr("kmer", "score", "explode(sequence(0, 5)) as kposition").where("(ascii(kmer) + ascii(substring(kmer, 3, 1)) + kposition * 5) % 3 <> 0")


def _short(s, d):
    return site.kmer_counts(v.sequences(s, d), K).groupBy(fn.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").cast("double").alias("score"))


def _flanked(s, d):
    return v.sequences(s, d).selectExpr("key", "sequence", "right(sequence, 3) as head", "left(sequence, 3) as tail")


def _shapes(s, d):
    return v.sequences(s, d).selectExpr("key", "sequence", "if(length(key) % 2 = 0, 'a', 'b') as label", "'mgw' as shape", f"{VALUES} as values")


def _pair_shapes(s, d):
    return _pairs(s, d).selectExpr("*", f"{VALUES} as values")


def _two_models(s, d):
    return v.pairs(s, d).withColumn("second", F.expr("ascii(md5(name)) % 16 / 10.0D"))


def _ids(s, d):
    return v.sequences(s, d).selectExpr("concat(split(key, '_')[0], '_', cast(split(key, '_')[1] as int) div 2) as id", "key", "sequence")


def _builders():
    return {"distance": lambda df: tables.one_hot(df, "name", "distance", [4, 5, 6], "dist_cat_"), "orientation": lambda df: tables.one_hot(df, "name", "orientation", ["HH", "TT", "HT/TH"], "ori_"), "affinity": lambda df: rows.affinity_feature(df, "name", ["str_score", "wk_score"])}


def _moved(s, d):
    return v.pairs(s, d).selectExpr("name", "grp", "distance as pos_1", "distance + cast(str_score * 4 as int) as pos_2", "if(label = 'cooperative', 'o2', 'o1') as ori")


QUERIES = {
    "s6_expand_escores": lambda s, d: op.expand_escores(_short(s, d), K),
    "s16_fetch_sequences": lambda s, d: op.fetch_sequences(_intervals(s, d), _chunks(s, d), CHUNK),
    "k8_call_sites_in_peaks": lambda s, d: op.call_sites_in_peaks(_intervals(s, d), _chunks(s, d), CHUNK, _align(s), K, (3, 5), 4, 0.1),
    "k10_alignment_pwm_sites": lambda s, d: op.alignment_pwm_sites(site.alignment_sites(v.sequences(s, d), _align(s), K, (3, 5), 4, 0.1), v.sequences(s, d), PWM, 1),
    "k12_sites_with_flanks": lambda s, d: op.sites_with_flanks(_flanked(s, d), _call),
    "k13_peak_in_region": lambda s, d: site.region_peaks(v.sequences(s, d), kmer_scores(s), K, 0.2, 1, matrix_caller(PWM, 3.0)),
    "k14_valid_pairs": lambda s, d: op.valid_pairs(site.site_pairs(_sites(s, d)), site.escore_profile(v.sequences(s, d), kmer_scores(s), K), -0.4),
    "p19_align_to_site": lambda s, d: op.align_to_site(_pairs(s, d)),
    "a18_shape_bands": lambda s, d: op.shape_bands(_shapes(s, d)),
    "a22_shape_difference": lambda s, d: op.shape_difference(_shapes(s, d), "a", "b"),
    "a23_group_tests": lambda s, d: op.group_tests(v.pairs(s, d), ["distance", "probability"], rep.LABELS),
    "a26_threshold_search": lambda s, d: op.threshold_search(_two_models(s, d), "probability", "second", CUTS),
    "a29_coop_label_chambers": lambda s, d: op.coop_label_chambers(*[x.withColumn("name", F.concat_ws("_", "name", "type")) for x in rep._chambers(s, d)], replicates.negative_cutoff(v.controls(s, d), 0.25)),
    "a35_confidence_change": lambda s, d: op.confidence_change(rep._values(s, d), rep.KEYS),
    "i14_validate_array": lambda s, d: op.validate_array(_ids(s, d), _sites(s, d), "GG", F.lit(1)),
    "i15_clean_controls": lambda s, d: op.clean_controls(v.sequences(s, d), _call, QUIET_PRIMER, 50),
    "i17_centred_factor_pairs": lambda s, d: op.centred_factor_pairs(_sites(s, d).where("orientation = 1"), _sites(s, d).where("orientation = -1")),
    "i22_variant_type": lambda s, d: op.variant_type(_moved(s, d), "grp").select("name", "variant"),
    "i24_positive_controls": lambda s, d: op.select_positive_controls(_two_models(s, d), "grp", "probability", "second", 0.5, 40, 2).select("grp", "name"),
    "i25_disagreements": lambda s, d: op.select_disagreements(_two_models(s, d), "grp", "probability", "second", "str_score", 20, 2).select("grp", "name"),
    "i26_largest_range": lambda s, d: op.select_largest_range(v.pairs(s, d), "grp", "distance", "str_score", 20, 2).select("grp", "name"),
    "i27_affinity_change": lambda s, d: op.select_affinity_change(v.pairs(s, d), "grp", "str_score", F.col("probability") > 0.5, 20),
    "i29_filter_mutants": lambda s, d: op.filter_mutants(v.pairs(s, d), "grp", "str_score", 0.6, 0.8).select("grp", "name"),
    "i30_probe_training": lambda s, d: op.probe_training(_scored(s, d), site.centred_pair(site.site_pairs(_sites(s, d))), 50.0),
    "f5_flank_shape": lambda s, d: op.flank_shape(_pair_shapes(s, d), 4, 3),
    "f8_linker_shape": lambda s, d: op.linker_shape_summary(_pair_shapes(s, d), 4),
    "f9_linker_positional": lambda s, d: op.linker_positional(_pairs(s, d), 4, 5),
    "f10_feature_table": lambda s, d: op.feature_table(v.pairs(s, d), _builders(), ["distance", "orientation", "affinity"]),
    "m10_predicted_vs_measured": lambda s, d: op.predicted_vs_measured(v.pairs(s, d).selectExpr("distance", "probability", "ascii(md5(name)) % 5 as fold"), "distance", "probability", "fold"),
}

P, S = v.with_views("pairs"), v.with_views("sequences")
_RC = lambda e: f"reverse(translate({e}, 'ACGT', 'TGCA'))"
_VALUES = "[CASE WHEN i >= 30 AND length(key) % 3 = 0 THEN NULL ELSE ((ascii(substr(sequence, (i + 1)::INT, 1)) * 31 + i * 17) % 101) / 10.0::DOUBLE END FOR i IN range(0, length(sequence))]"
_SHAPES = f"{S}, sh AS (SELECT CASE WHEN length(key) % 2 = 0 THEN 'a' ELSE 'b' END AS label, {_VALUES} AS vals FROM sequences), cells AS (SELECT label, i::INT - 1 AS position, vals[i] AS value FROM (SELECT label, vals, unnest(range(1, len(vals) + 1)) AS i FROM sh))"
_PAIR_SHAPES = f"{TWO}, ps AS (SELECT key, pos_1, pos_2, {_VALUES} AS vals FROM two)"
_CHR = "bases AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"
_FETCHED = f"WITH {_CHR}, iv AS (SELECT event_id::VARCHAR AS name, (event_id % 997)::VARCHAR AS chr, event_id * 97 % 300 AS start_pos, event_id * 97 % 300 + 20 + event_id % 60 AS end_pos, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events), cut AS (SELECT iv.*, substr(seq, (start_pos + 1)::INT, (end_pos - start_pos)::INT) AS s FROM iv JOIN bases ON doc_id::VARCHAR = chr), fetched AS (SELECT name, chr, start_pos, end_pos, strand, CASE strand WHEN '-' THEN {_RC('s')} ELSE s END AS sequence FROM cut WHERE s <> '')"
_CALLS = SITE_SQL["k9_alignment_sites"]
_IN_PEAKS = _CALLS.replace(S, f"{_FETCHED}, sequences AS (SELECT name AS key, sequence FROM fetched)")
_MODELS = "two_models AS (SELECT *, (ascii(md5(name)) % 16) / 10.0::DOUBLE AS second FROM pairs)"


def _tail(z: str) -> str:
    """The operator's tail of the normal distribution, of a column z."""
    t, poly = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2.0)))", "0.17087277::DOUBLE"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + {c}::DOUBLE)"
    half = f"({t} * exp(-{z} * {z} / 2 + {poly}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END"


def _ranks(source: str, keys: str, first: str) -> str:
    """Mann-Whitney of rows (keys, kind, value) as the table mw."""
    return f"""rk AS (SELECT {keys}, kind, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY {keys}, value)::DOUBLE AS t FROM {source}),
sm AS (SELECT {keys}, count(*) FILTER (kind = '{first}') AS m, count(*) FILTER (kind <> '{first}') AS n, sum(r) FILTER (kind = '{first}') AS s, sum(t * t - 1) AS ties FROM rk GROUP BY ALL),
us AS (SELECT *, s - m * (m + 1) / 2 AS u, sqrt(m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1)))) AS sigma FROM sm WHERE m > 0 AND n > 0),
zs AS (SELECT *, (u - m * n / 2 - 0.5) / sigma AS z1, (m * n / 2 - u - 0.5) / sigma AS z2 FROM us),
mw AS (SELECT {keys}, m, n, u, CASE WHEN sigma > 0 THEN {_tail('z1')} ELSE 1 END AS p_greater, CASE WHEN sigma > 0 THEN {_tail('z2')} ELSE 1 END AS p_less FROM zs)"""


def _sub(source: str) -> str:
    """i28's selection of two of the middle over another table."""
    return ROW_SQL["i28_sub_select"].removeprefix(f"{P}, ").replace("FROM pairs", f"FROM {source}")


_AT = lambda p: f"coalesce(CASE WHEN {p} >= 0 THEN vals[({p} + 1)::INT] END, -999)"

ORACLE_SQL = {
    "s6_expand_escores": f"{S}, {_windows(K)}, sh AS (SELECT least(kmer, {_RC('kmer')}) AS kmer, count(*)::DOUBLE AS score FROM windows GROUP BY 1), {SCORES} SELECT a.kmer, sh.score FROM scores a JOIN sh ON sh.kmer = least(a.kmer, {_RC('a.kmer')})",
    "s16_fetch_sequences": f"{_FETCHED} SELECT * FROM fetched",
    "k8_call_sites_in_peaks": f"SELECT name, iv.chr, iv.start_pos + c.site_pos AS position, orientation FROM ({_IN_PEAKS}) c JOIN (SELECT event_id::VARCHAR AS name, (event_id % 997)::VARCHAR AS chr, event_id * 97 % 300 AS start_pos FROM events) iv ON c.key = iv.name",
    "k10_alignment_pwm_sites": f"{S}, k AS ({_CALLS}), h AS (SELECT k.key, core_start, orientation, CASE WHEN core_start >= 1 THEN substr(sequence, core_start::INT, 4) ELSE '' END AS w FROM k JOIN sequences q ON q.key = k.key), g AS (SELECT *, min(length(w)) OVER (PARTITION BY key) AS low FROM h), z AS (SELECT *, {_WAY(PWM)} AS f, {_WAY(_BACK)} AS r FROM g WHERE low = 4) SELECT key, core_start, orientation, greatest(f, r) AS score, CASE WHEN f > r + 1e-9 THEN '+' ELSE '-' END AS strand FROM z",
    "k12_sites_with_flanks": f"{S}, q AS (SELECT key, least(3, length(sequence)) AS ahead, length(sequence) AS size, right(sequence, 3) || sequence || left(sequence, 3) AS sequence FROM sequences), {_windows(K).replace('FROM sequences', 'FROM q')}, {_pwm_sql()} SELECT key, mid - ahead AS pos, score FROM scan JOIN q USING (key) WHERE score > 3 AND mid >= ahead AND mid < ahead + size",
    "k13_peak_in_region": f"{PROFILE}, {_pwm_sql()}, {REGIONS} SELECT r.key, startpos, start, score FROM regions r JOIN scan c ON c.key = r.key AND c.start BETWEEN startpos - 3 AND startpos + escorelength + 3 QUALIFY row_number() OVER (PARTITION BY r.key, startpos ORDER BY score DESC, start) = 1",
    "k14_valid_pairs": f"{SITES}, {PAIRS}, {SCORES}, lo AS (SELECT key, start + 2 AS position FROM windows JOIN scores USING (kmer) WHERE scores.score < -0.4) SELECT *, pos_2 - pos_1 AS distance FROM pr WHERE pos_2 - pos_1 BETWEEN 10 AND 20 AND EXISTS (SELECT 1 FROM lo WHERE lo.key = pr.key AND position > pos_1 AND position < pos_2)",
    "p19_align_to_site": f"{TWO}, mo AS (SELECT pos_1 AS a FROM two GROUP BY 1 ORDER BY count(*) DESC, pos_1 LIMIT 1), f AS (SELECT key, sequence, a, (a - pos_1)::INT AS k, translate(repeat(md5(key), 3), '0123456789abcdef', 'ACGTACGTACGTACGT') AS fill FROM two, mo) SELECT key, a AS pos_1, CASE WHEN k >= 0 THEN substr(fill, 1, k) || substr(sequence, 1, length(sequence)::INT - k) ELSE substr(sequence, 1 - k) || substr(fill, 1, -k) END AS sequence FROM f",
    "a18_shape_bands": f"{_SHAPES} SELECT 'mgw' AS shape, position, label, quantile_cont(value, 0.25) AS low, median(value) AS median, quantile_cont(value, 0.75) AS high FROM cells GROUP BY position, label",
    "a22_shape_difference": f"{_SHAPES}, held AS (SELECT 'mgw' AS shape, position, label AS kind, value FROM cells WHERE position NOT IN (SELECT position FROM cells WHERE value IS NULL)), {_ranks('held', 'shape, position', 'a')} SELECT * FROM mw",
    "a23_group_tests": f"{P}, w AS (SELECT * FROM (VALUES ('anticooperative', 'cooperative'), ('anticooperative', 'independent'), ('cooperative', 'independent')) t(first, second)), held AS (SELECT \"column\", first, second, CASE WHEN label = first THEN 'a' ELSE 'b' END AS kind, value FROM (SELECT label, 'distance' AS \"column\", distance::DOUBLE AS value FROM pairs UNION ALL SELECT label, 'probability', probability FROM pairs) JOIN w ON label IN (first, second)), {_ranks('held', '\"column\", first, second', 'a')} SELECT \"column\", first, second, m, n, least(p_greater, p_less) AS p FROM mw",
    "a26_threshold_search": f"{P}, {_MODELS}, c AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in CUTS)}]) AS c) SELECT a.c AS cut_a, b.c AS cut_b, count(*) FILTER ((probability < a.c) = (second < b.c)) AS agree, 100 * count(*) FILTER ((probability < a.c) = (second < b.c)) / count(*) AS percent FROM two_models, c a, c b GROUP BY 1, 2",
    "a29_coop_label_chambers": f"{rep.BASE}, vals AS (SELECT name || '_' || type AS name, ori, 'indiv' AS kind, intensity AS value FROM probes UNION ALL SELECT name || '_' || type, ori, 'two', intensity * 0.82::DOUBLE + 123.36::DOUBLE + quantity FROM probes), {rep.SUMS}, nulls AS (SELECT i + j + k - 6 AS u FROM range(1, 7) a(i), range(1, 7) b(j), range(1, 7) c(k) WHERE i < j AND j < k), tail AS (SELECT x, (SELECT count(*) FROM nulls WHERE u >= x) / 20 AS p FROM range(0, 10) r(x)), cut AS (SELECT quantile_cont(med, 0.25) AS cutoff FROM (SELECT median(intensity) AS med FROM controls GROUP BY name)), md AS (SELECT name, ori, median(value) FILTER (kind = 'indiv') AS median_first, median(value) FILTER (kind = 'two') AS median_second FROM vals GROUP BY ALL) SELECT name, ori, median_first, median_second, g.p AS p_greater, l.p AS p_less, CASE WHEN median_second < cutoff THEN 'fail_cutoff' WHEN g.p < 0.06 THEN 'cooperative' WHEN l.p < 0.06 THEN 'anticooperative' ELSE 'independent' END AS label FROM md JOIN us USING (name, ori) JOIN tail g ON g.x = ceil(us.u) JOIN tail l ON l.x = ceil(9 - us.u), cut",
    "a35_confidence_change": f"{rep.TESTS}, md AS (SELECT name, ori, median(value) FILTER (kind = 'two') - median(value) FILTER (kind = 'indiv') AS difference FROM vals GROUP BY ALL) SELECT name, ori, tests.p AS p, difference FROM tests JOIN md USING (name, ori)",
    "i14_validate_array": f"{SITES}, n AS (SELECT key, count(*) AS n FROM s GROUP BY 1), w AS (SELECT split_part(key, '_', 1) || '_' || (split_part(key, '_', 2)::INT // 2) AS id, key, sequence FROM sequences) SELECT id, key, sequence FROM w WHERE id IN (SELECT id FROM w LEFT JOIN n ON n.key = w.key GROUP BY id HAVING bool_and(coalesce(n, 0) = 1 AND contains(sequence, 'GG')))",
    "i15_clean_controls": f"{S}, q AS (SELECT key, sequence || '{QUIET_PRIMER}' AS sequence FROM sequences), {_windows(K).replace('FROM sequences', 'FROM q')}, {_pwm_sql()} SELECT key, sequence FROM sequences WHERE key NOT IN (SELECT key FROM scan WHERE score > 3) ORDER BY md5(key), key LIMIT 50",
    "i17_centred_factor_pairs": f"{SITES}, a AS (SELECT key, min(pos) AS pos_1 FROM s WHERE orientation = 1 GROUP BY key HAVING count(*) = 1), b AS (SELECT key, min(pos) AS pos_2 FROM s WHERE orientation = -1 GROUP BY key HAVING count(*) = 1) SELECT * FROM a JOIN b USING (key) WHERE abs((pos_1 + pos_2) / 2 - 18) <= 3",
    "i22_variant_type": f"{P}, m AS (SELECT name, grp, distance AS a, distance + trunc(str_score * 4)::INT AS b, CASE WHEN label = 'cooperative' THEN -1 ELSE 1 END AS way FROM pairs), o AS (SELECT grp, min_by(a, name) AS a0, min_by(b, name) AS b0 FROM m GROUP BY 1) SELECT name, CASE WHEN b - a < b0 - a0 THEN 'shorter' WHEN (a - a0) * way > 0 THEN 'to_right' WHEN (a - a0) * way < 0 THEN 'to_left' ELSE 'original' END AS variant FROM m JOIN o USING (grp)",
    "i24_positive_controls": f"{P}, {_MODELS}, u AS (SELECT * FROM two_models WHERE probability >= 0.5 AND second >= 0.5), g AS (SELECT DISTINCT grp FROM u), h AS (SELECT grp FROM g ORDER BY md5('seed' || grp::VARCHAR), grp LIMIT 40) SELECT grp, name FROM u WHERE grp IN (FROM h) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('seed' || name)) <= 2",
    "i25_disagreements": f"{P}, {_MODELS}, top AS (SELECT * FROM pairs WHERE grp IN (SELECT grp FROM two_models GROUP BY grp ORDER BY max(abs(probability - second)) DESC, grp LIMIT 20)), {_sub('top')}",
    "i26_largest_range": f"{P}, top AS (SELECT * FROM pairs WHERE grp IN (SELECT grp FROM pairs GROUP BY grp ORDER BY first(label ORDER BY distance, name) <> last(label ORDER BY distance, name) DESC, max(str_score) - min(str_score) DESC, grp LIMIT 20)), {_sub('top')}",
    "i27_affinity_change": f"{P}, l AS (SELECT grp, lead(str_score) OVER w - str_score AS change, probability > 0.5 AS a, lead(probability > 0.5) OVER w AS b FROM pairs WINDOW w AS (PARTITION BY grp ORDER BY str_score, name)) SELECT grp, min(change) AS change FROM l WHERE a <> b GROUP BY grp ORDER BY change, grp LIMIT 20",
    "i29_filter_mutants": f"{P}, o AS (SELECT grp, min(name) AS wild, min_by(label, name) AS l0, min_by(str_score, name) AS s0 FROM pairs GROUP BY 1), h AS (SELECT grp, name FROM pairs JOIN o USING (grp) WHERE name = wild OR (label <> l0 AND probability >= 0.6 AND abs(str_score - s0) <= 0.8)) SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY grp) > 1",
    "i30_probe_training": f"{SITES}, {PAIRS}, sc AS (SELECT key, sequence, length(sequence) + 1.5::DOUBLE * length(regexp_replace(sequence, '[^G]', '', 'g')) AS sc FROM sequences), h AS (SELECT sequence, pos_1, pos_2, median(sc)::DOUBLE AS score, count(*) AS n FROM sc JOIN pr ON pr.key = sc.key WHERE abs((pos_1 + pos_2) / 2 - 18) <= 3 GROUP BY ALL) SELECT *, (score >= 50)::INT AS label FROM h",
    "f5_flank_shape": f"{_PAIR_SHAPES} SELECT key, " + ", ".join(f"{_AT(p.format(i=i))} AS {name}_{i}" for name, p in {"outer_1": "pos_1 - {i}", "inner_1": "pos_1 + 3 + {i}", "inner_2": "pos_2 - {i}", "outer_2": "pos_2 + 3 + {i}"}.items() for i in (1, 2, 3)) + " FROM ps",
    "f8_linker_shape": f"{_PAIR_SHAPES}, l AS (SELECT key, list_slice(vals, (pos_1 + 5)::INT, pos_2::INT) AS v FROM ps WHERE pos_2 - pos_1 > 4) SELECT key, list_avg(v) AS mean, list_max(v) AS most, list_min(v) AS least FROM l",
    "f9_linker_positional": f"{TWO}, m AS (SELECT *, pos_1 + 4 + (pos_2 - pos_1 - 4) // 2 AS mid FROM two WHERE pos_2 - pos_1 > 4), c AS (SELECT *, 'right' AS side, mid + place AS spot FROM m, range(0, 5) r(place) UNION ALL SELECT *, 'left', mid - 1 - place FROM m, range(0, 5) r(place)) SELECT key, side, place, substr(sequence, spot::INT + 1, 1) AS base FROM c WHERE spot >= pos_1 + 4 AND spot < pos_2",
    "f10_feature_table": f"{P} SELECT name, label, " + ", ".join(f"(distance = {x})::INT AS dist_cat_{i}" for i, x in enumerate((4, 5, 6))) + ", " + ", ".join(f"(orientation = '{x}')::INT AS ori_{i}" for i, x in enumerate(("HH", "TT", "HT/TH"))) + ", str_score, wk_score, (str_score + wk_score) / 2 AS mean_strength FROM pairs",
    "m10_predicted_vs_measured": f"{P}, q AS (SELECT distance AS x, probability AS y, ascii(md5(name)) % 5 AS fold FROM pairs), g AS (SELECT DISTINCT fold AS f FROM q), lines AS (SELECT f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM q, g WHERE fold <> f GROUP BY f), o AS (SELECT a * x + b AS p, y FROM q JOIN lines ON f = fold) SELECT corr(p, y) ^ 2 AS r2, avg((p - y) ^ 2) AS mse, count(*) AS n FROM o",
}
