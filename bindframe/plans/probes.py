"""Queries of the chains from sequences to training tables, mutants and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.operators import candidates, models, mutation
from bindframe.operators import probes as op
from bindframe.plans.intervals import IN, OVER
from bindframe.plans.models import FEATURES, _is
from bindframe.plans.mutation import _BASE, _SEQ, _TAB, _VARIANTS, _VERIFIED, CUTOFFS, GAPS, PROFILE, SITES, _called, _junction, _region_sql
from bindframe.plans.mutation import ORACLE_SQL as MUTATION_SQL
from bindframe.plans.sites import _CORE, _IDX, _SV, PWM, VECTORS, _windows
from bindframe.plans.sites import SITES as SITES_SQL
from bindframe.plans.tables import CORES, PRIMER, TWO, _pairs
from bindframe.sources import views as v


def _movable(s: SparkSession, d: str) -> DataFrame:
    """Sequences with two sites and ten bases of flank on either side, which are those of their other end."""
    two = mutation.with_sites(v.sequences(s, d), SITES).where((F.size("sites") == 2) & (F.length("sequence") == v.PROBE_LENGTH))
    return two.select("key", "sequence", (F.get("sites", F.lit(0)) + 3).alias("end_1"), F.get("sites", F.lit(1)).alias("start_2"), F.expr("substring(sequence, 27, 10) as flank_left"), F.expr("substring(sequence, 1, 10) as flank_right"))


def _kernels(s: SparkSession) -> list[candidates.Kernel]:
    vectors = s.createDataFrame(VECTORS, "sv_id int, coef double, idx long, val double")
    return [candidates.Kernel("GGAA", vectors, 0.1, 0.05), candidates.Kernel("GATC", vectors, 0.2, -0.1)]


QUERIES = {
    "f11_training_table": lambda s, d: op.training_table(v.sequences(s, d), PWM, 3.0),
    "i8_mutant_table": lambda s, d: op.mutant_table(_pairs(s, d), SITES, CORES),
    "i19_filtered_probes": lambda s, d: op.filtered_probes(v.sequences(s, d), SITES, PROFILE, PRIMER, CUTOFFS, GAPS),
    "i21_move_one_site": lambda s, d: op.move_sites(_movable(s, d)),
    "i21_move_both_sites": lambda s, d: op.move_sites(_movable(s, d), "to_left", fixed=True),
    "s20_array_design": lambda s, d: op.array_design(mutation.variant_sets(v.sequences(s, d), SITES), PRIMER, 3, "Coop_"),
    "i2_candidate_probes": lambda s, d: candidates.all_candidate_probes(v.peaks(s, d), v.sites(s, d), [100, 200, 300], [2, 3, 4], 4, 100),
    "k7_kernel_sites": lambda s, d: candidates.kernel_sites(v.sequences(s, d, window=8), _kernels(s), 8, 0.5),
    "m8_best_cut": lambda s, d: candidates.best_cut(v.pairs(s, d), "cooperative", "probability"),
    "m9_compare_feature_sets": lambda s, d: op.compare_feature_sets(v.pairs(s, d), {"scores": FEATURES[:2], "all": FEATURES, "shape": FEATURES[2:]}, models.classifier("logistic", maxIter=10), _is(), 3, 2),
}

_TRAIN = f"""two AS (SELECT key, min(start) AS pos_1, max(start) AS pos_2, min_by(score, start) AS score_1, max_by(score, start) AS score_2, min_by(orientation, start) AS side_1, max_by(orientation, start) AS side_2 FROM scan WHERE score > 3 GROUP BY key HAVING count(*) = 2)"""
_SCAN_AGAIN = SITES_SQL[SITES_SQL.index("windows AS") : SITES_SQL.rindex(", s AS (")]
_STEP = "(2 - (start_2 - end_1 - 1) % 2)"
_MOVABLE = f"{_SEQ}, {_TAB}, {_BASE}, mo AS (SELECT key, sequence, s0[1] + 3 AS end_1, s0[2] AS start_2, substr(sequence, 27, 10) AS fl, substr(sequence, 1, 10) AS fr FROM called WHERE len(s0) = 2 AND length(sequence) = 36), st AS (SELECT *, {_STEP} AS step, start_2 - end_1 - 1 AS gap FROM mo WHERE start_2 > end_1), sp AS (SELECT *, end_1 + 1 + gap // 2 - step // 2 AS b FROM st)"


def _mutants() -> str:
    one = lambda name, kind, comment: f"SELECT key, sequence, '{kind}' AS muttype, {comment} AS comment FROM ({MUTATION_SQL[name]})"
    return " UNION ALL ".join([
        one("i3_core_called", "affinity", "'core:' || site || ':' || core"), one("i4_flank_called", "affinity", "'flank:' || site || ':' || position || base"),
        one("i5_distance_called", "distance", "'distance:' || distance"), one("i6_orientation_called", "orientation", "'turned:' || turned"),
        f"SELECT key, sequence, unnest(['affinity', 'distance', 'orientation']) AS muttype, 'wt' AS comment FROM ({TWO} SELECT key, sequence FROM two)"])


def _kernel_sql(core: str, back: str, gamma: float, rho: float) -> str:
    """A SELECT of K7's sites of one core over the view of sequences, as a query of its own."""
    return f"""SELECT key, start AS site_start, start + 2 AS core_start, start + 4 AS core_mid, '{core}' AS core, max(score) AS score FROM (
{v.with_windows(8)}, {_windows(8)}, {_CORE(8, core, back)}, dw AS (SELECT DISTINCT "window" FROM c), {_IDX}, {_SV}, q AS (SELECT sv_id, coef, sum(val * val) AS nsv FROM sv GROUP BY ALL), dt AS (SELECT "window", sv_id, sum(val) AS dot FROM idx JOIN sv USING (idx) GROUP BY ALL),
z AS (SELECT dw."window", sum(coef * exp(-{gamma} * (21 + nsv - 2 * coalesce(dot, 0)))) - ({rho}) AS val FROM dw CROSS JOIN q LEFT JOIN dt ON dt."window" = dw."window" AND dt.sv_id = q.sv_id GROUP BY 1) SELECT key, start, 1 / (1 + exp(-val)) AS score FROM c JOIN z USING ("window")) GROUP BY key, start HAVING max(score) > 0.5"""


ORACLE_SQL = {
    "i2_candidate_probes": f"""{v.with_views('peaks', 'sites')}, sz AS (SELECT DISTINCT chr, start_pos + summit - n // 2 AS start_pos, start_pos + summit + n // 2 - 1 AS end_pos FROM peaks, (SELECT unnest([100, 200, 300]) AS n)),
ct AS (SELECT a.chr, a.start_pos, a.end_pos, count(*) AS sites_in_peak FROM sz a JOIN sites b ON {OVER} GROUP BY ALL HAVING count(*) IN (2, 3, 4)),
i AS (SELECT DISTINCT b.chr, b.start_pos AS peak_start, b.end_pos AS peak_end, sites_in_peak, a.start_pos, a.end_pos FROM sites a JOIN ct b ON {IN}),
l AS (SELECT *, (start_pos + end_pos) / 2 AS m2, lag((start_pos + end_pos) / 2) OVER (PARTITION BY chr, peak_start, peak_end ORDER BY start_pos, end_pos) AS m1 FROM i),
c AS (SELECT DISTINCT chr, peak_start, peak_end, sites_in_peak, peak_end - peak_start + 1 AS peaklen, m2 - m1 AS distance, floor((m1 + m2) / 2)::BIGINT - 18 AS seq_start FROM l WHERE m2 - m1 BETWEEN 4 AND 100),
k AS (SELECT *, concat_ws(':', chr, peak_start, peak_end, seq_start, distance::DOUBLE) AS nm FROM c)
SELECT chr, peak_start, peak_end, sites_in_peak, peaklen, distance, seq_start, seq_start + 36 AS seq_end, seq_start - 10 AS left_start, seq_start + 46 AS right_end, floor(18 - distance / 2)::BIGINT + 1 AS mid_1, floor(18 + distance / 2)::BIGINT + 1 AS mid_2, 'sequence' || row_number() OVER (ORDER BY md5(nm), nm) AS key FROM k""",
    "k7_kernel_sites": f"{_kernel_sql('GGAA', 'TTCC', 0.1, 0.05)} UNION ALL {_kernel_sql('GATC', 'GATC', 0.2, -0.1)}",
    "m8_best_cut": f"""{v.with_views('pairs')}, c AS (SELECT probability AS score, count(*) FILTER (label = 'cooperative') AS p, count(*) FILTER (label <> 'cooperative') AS n FROM pairs GROUP BY 1),
s AS (SELECT score, (sum(p) OVER w + sum(n) OVER () - sum(n) OVER w) / (sum(p) OVER () + sum(n) OVER ()) AS acc FROM c WINDOW w AS (ORDER BY score DESC)), b AS (SELECT score AS cut, true AS above, acc AS accuracy FROM s UNION ALL SELECT score, false, 1 - acc FROM s) SELECT cut, above, accuracy FROM b ORDER BY accuracy DESC, cut DESC, above DESC LIMIT 1""",
    "f11_training_table": f"""{SITES_SQL}, {_TRAIN}, first AS (SELECT two.*, sequence FROM two JOIN sequences USING (key)), plus AS (SELECT *, false AS turned FROM first WHERE NOT (side_1 = -1 AND side_2 = -1)),
again AS (WITH sequences AS (SELECT key, reverse(translate(sequence, 'ACGT', 'TGCA')) AS sequence FROM first WHERE side_1 = -1 AND side_2 = -1), {_SCAN_AGAIN}, {_TRAIN} SELECT two.*, sequence, true AS turned FROM two JOIN sequences USING (key)),
al AS (SELECT key, sequence, pos_1, pos_2, score_1, score_2, side_1, side_2, turned FROM plus UNION ALL SELECT key, sequence, pos_1, pos_2, score_1, score_2, side_1, side_2, turned FROM again)
SELECT key, sequence, CASE WHEN score_1 >= score_2 THEN pos_1 ELSE pos_2 END AS site_str_pos, greatest(score_1, score_2) AS site_str_score, CASE WHEN score_1 >= score_2 THEN pos_2 ELSE pos_1 END AS site_wk_pos, least(score_1, score_2) AS site_wk_score, pos_2 - pos_1 AS distance,
       CASE WHEN side_1 = 1 THEN '+' ELSE '-' END || '/' || CASE WHEN side_2 = 1 THEN '+' ELSE '-' END AS orientation, turned FROM al""",
    "i8_mutant_table": f"WITH {_TAB}, mu AS ({_mutants()}), {_called('mu', 'sequence', 'mc', 1)} SELECT key, sequence, muttype, comment, s1[1] AS pos_1, s1[2] AS pos_2, p[c1[s1[1]+1]+1] AS score_1, p[c1[s1[2]+1]+1] AS score_2, s1[2] - s1[1] AS distance FROM mc, tab",
    "i19_filtered_probes": f"""{_SEQ}, {_TAB}, {_BASE}, {_VARIANTS}, {_VERIFIED}, {_region_sql()},
fp AS (SELECT key, cutoff, gap FROM ok WHERE key IN (SELECT key FROM sets WHERE len(list_distinct([wt, m1, m2, m3])) = 4) QUALIFY row_number() OVER (PARTITION BY key ORDER BY o) = 1),
ev AS (SELECT key, unnest(['wt', 'm1', 'm2', 'm3']) AS kind, unnest([wt, m1, m2, m3]) AS sequence FROM sets JOIN fp USING (key)), start AS (SELECT key || ':' || kind AS rid, key, sequence AS old, sequence AS new FROM ev), {_junction('start', 'fwd', 'new')}, {_junction('fwd', 'rev', "reverse(translate(new, 'ACGT', 'TGCA'))")},
wh AS (SELECT *, new || '{PRIMER}' AS f, reverse(translate(new, 'ACGT', 'TGCA')) || '{PRIMER}' AS r, length(new) AS n FROM rev), {_called('wh', 'f', 'j1', 1)}, {_called('j1', 'r', 'j2', 2)}, {_called('j2', 'old', 'j3', 3)}, {_called('j3', 'new', 'j4', 4)},
jd AS (SELECT key, split_part(rid, ':', 2) AS kind, new FROM j4 WHERE len([i FOR i IN s1 IF i < n AND i + 4 > n]) = 0 AND len([i FOR i IN s2 IF i < n AND i + 4 > n]) = 0 AND s3 = s4),
wd AS (SELECT key, max(new) FILTER (kind = 'wt') AS wt, max(new) FILTER (kind = 'm1') AS m1, max(new) FILTER (kind = 'm2') AS m2, max(new) FILTER (kind = 'm3') AS m3 FROM jd GROUP BY key HAVING count(*) = 4)
SELECT wd.*, site_1, site_2, cutoff, gap FROM wd JOIN (SELECT key, site_1, site_2 FROM sets) USING (key) JOIN fp USING (key)""",
    "i21_move_one_site": f"{_MOVABLE} SELECT key, step, substr(fl, (10 - step + 1)::INT, step::INT) || substr(sequence, 1, b::INT) || substr(sequence, (b + step + 1)::INT) AS sequence FROM sp WHERE gap >= step",
    "i21_move_both_sites": f"{_MOVABLE}, mi AS (SELECT key, sequence, end_1, fr, 2 - ((gap % 2 + 2) % 2) AS step FROM (SELECT *, start_2 - end_1 - 1 AS gap FROM mo)) SELECT key, -step AS step, substr(sequence, 1, 5) || substr(sequence, (5 + step + 1)::INT) || substr(fr, 1, step::INT) AS sequence FROM mi WHERE 5 + step <= end_1",
    "s20_array_design": f"""{_SEQ}, {_TAB}, {_BASE}, {_VARIANTS}, {_VERIFIED}, ev AS (SELECT key || '_' || unnest(['wt', 'm1', 'm2', 'm3']) AS k, unnest([wt, m1, m2, m3]) AS q FROM sets),
ro AS (SELECT k || '_' || ori || '_r' || rep AS type, q || '{PRIMER}' AS sequence FROM (SELECT k, 'o1' AS ori, q FROM ev UNION ALL SELECT k, 'o2', reverse(translate(q, 'ACGT', 'TGCA')) FROM ev), range(1, 4) r(rep))
SELECT 'Coop_' || lpad((row_number() OVER (ORDER BY md5(type), type))::VARCHAR, 10, '0') AS id, sequence, 'Na|Na' AS score, 'Na' AS kind, type, 'chr1:0-0' AS coordinate FROM ro""",
}
