"""Sequence and site queries, over whole texts read as bases in probes of 36."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.functions import sequences as fn
from bindframe.operators import sites as op
from bindframe.sources import views as v

K = 4
#: Fixed weights of a short matrix for GGAA, log-odds by base.
PWM = [{"A": -1.0, "C": -1.5, "G": 1.6, "T": -1.2}, {"A": -1.3, "C": -1.4, "G": 1.7, "T": -1.6}, {"A": 1.8, "C": -1.7, "G": -1.1, "T": -0.9}, {"A": 1.1, "C": -1.2, "G": -1.0, "T": 0.4}]
#: Fixed support vectors: (sv_id, coef, idx, val).
VECTORS = [(1, 0.7, 3, 1.0), (1, 0.7, 7, 1.0), (1, 0.7, 40, 1.0), (2, -0.4, 1, 1.0), (2, -0.4, 60, 1.0), (3, 0.9, 11, 1.0), (3, 0.9, 13, 1.0)]


def kmer_scores(spark: SparkSession, k: int = K) -> DataFrame:
    """A score for every k-mer by formula: (37 * code modulo 101) / 101 - 0.5, code in base 4."""
    letters = ", ".join(f"substring('ACGT', cast(shiftright(id, {2 * (k - 1 - i)}) & 3 as int) + 1, 1)" for i in range(k))
    return spark.range(4**k).selectExpr(f"concat({letters}) as kmer", "(id * 37 % 101) / 101.0D - 0.5D as score")


_LETTERS = " || ".join(f"substr('ACGT', ((id >> {2 * (K - 1 - i)}) & 3)::INT + 1, 1)" for i in range(K))
SCORES = f"scores AS (SELECT {_LETTERS} AS kmer, (id * 37 % 101) / 101.0::DOUBLE - 0.5 AS score FROM (SELECT unnest(range(0, {4**K})) AS id))"


def _windows(k: int) -> str:
    return f"windows AS (SELECT key, start, substr(sequence, start::INT + 1, {k}) AS kmer FROM (SELECT key, sequence, unnest(range(0, length(sequence) - {k - 1})) AS start FROM sequences))"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return op.pwm_scan(v.sequences(spark, d), PWM, above=3.0).selectExpr("key", "mid as pos", "score", "orientation")


def _pwm_sql() -> str:
    swap = {"A": "T", "C": "G", "G": "C", "T": "A"}
    way = lambda rows: " + ".join(f"CASE substr(kmer, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {x}::DOUBLE" for b, x in row.items()) + " END" for i, row in enumerate(rows))
    back = [{swap[b]: x for b, x in row.items()} for row in reversed(PWM)]
    return f"scan AS (SELECT key, start, kmer AS site, greatest(f, r) AS score, CASE WHEN f > r THEN 1 ELSE -1 END AS orientation, start + 2 AS mid FROM (SELECT *, {way(PWM)} AS f, {way(back)} AS r FROM windows))"


SITES = f"{v.with_views('sequences')}, {_windows(K)}, {_pwm_sql()}, s AS (SELECT key, mid AS pos, score, orientation FROM scan WHERE score > 3)"
PROFILE = f"{v.with_views('sequences')}, {_windows(K)}, {SCORES}, profile AS (SELECT key, start + 2 AS position, start, kmer, score FROM windows JOIN scores USING (kmer))"
PAIRS = "pr AS (SELECT key, min(pos) AS pos_1, max(pos) AS pos_2, min_by(score, pos) AS score_1, max_by(score, pos) AS score_2 FROM s GROUP BY key HAVING count(*) = 2)"
REGIONS = """h AS (SELECT key, start, start - lag(start) OVER (PARTITION BY key ORDER BY start) AS d FROM profile WHERE score > 0.2),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start) AS run FROM h),
r AS (SELECT key, min(start) AS startpos, max(start) AS last, count(*) AS n FROM g GROUP BY key, run),
e AS (SELECT key, max(start) AS fin FROM profile GROUP BY key),
l AS (SELECT r.*, coalesce(lead(startpos) OVER (PARTITION BY r.key ORDER BY startpos) - 1, fin) - last AS m FROM r JOIN e USING (key)),
regions AS (SELECT key, startpos, n + CASE WHEN m > 1 THEN 1 ELSE greatest(m - 1, 0) END AS escorelength, n FROM l WHERE n >= 2)"""


def _regions(s: SparkSession, d: str) -> DataFrame:
    return op.region_scan(v.sequences(s, d), kmer_scores(s), K, 0.2, 1)


def _scored(s: SparkSession, d: str) -> DataFrame:
    return v.sequences(s, d).withColumn("score", F.length("sequence") + F.length(F.regexp_replace("sequence", "[^G]", "")) * 1.5)


QUERIES = {
    "p7_reverse_complement": lambda s, d: v.sequences(s, d).select("key", fn.reverse_complement(F.col("sequence")).alias("rc"), fn.canonical(F.col("sequence")).alias("canonical")),
    "p6_drop_homopolymers": lambda s, d: v.sequences(s, d).where(~F.col("sequence").contains("GGGGG") & ~F.col("sequence").contains("CCCCC")),
    "p18_differing_positions": lambda s, d: v.sequences(s, d).select("key", fn.differing_positions(F.col("sequence"), fn.reverse_complement(F.col("sequence"))).alias("p")).select("key", F.size("p").alias("n"), F.element_at("p", 1).cast("long").alias("first")).where("n > 0"),
    "k1_kmer_windows": lambda s, d: op.kmer_windows(v.sequences(s, d, window=8), 8).groupBy("kmer").agg(F.count("*").alias("n"), F.sum("start").alias("starts")),
    "j7_kmer_lookup": lambda s, d: op.kmer_lookup(op.kmer_windows(v.sequences(s, d, window=K), K), kmer_scores(s).where("score > 0"), -0.5).groupBy("key").agg(F.sum("score").alias("total"), F.count("*").alias("n")),
    "k2_escore_profile": lambda s, d: op.escore_profile(v.sequences(s, d, window=K), kmer_scores(s), K).groupBy("key").agg(F.max("score").alias("best"), F.max_by("position", F.struct("score", "position")).alias("position")),
    "k3_specific_regions": _regions,
    "w2_runs": lambda s, d: op.runs(op.escore_profile(v.sequences(s, d), kmer_scores(s), K), ["key"], "start", F.col("score") > 0.2, 1, 3),
    "k4_pwm_scan": lambda s, d: op.pwm_scan(v.sequences(s, d, window=K), PWM, zero_threshold=True),
    "k6_core_windows": lambda s, d: op.core_windows(v.sequences(s, d, window=12), "GGAA", 12),
    "k7_kernel_score": lambda s, d: op.kernel_score(op.core_windows(v.sequences(s, d, window=8), "GGAA", 8), s.createDataFrame(VECTORS, "sv_id int, coef double, idx long, val double"), 0.1, 0.05).select("key", "start", "orientation", "score"),
    "k9_alignment_sites": lambda s, d: op.alignment_sites(v.sequences(s, d), kmer_scores(s).selectExpr("kmer", "score", "explode(sequence(0, 5)) as kposition").where("(ascii(kmer) + ascii(substring(kmer, 3, 1)) + kposition * 5) % 3 <> 0"), K, (3, 5), 4, 0.1),
    "k15_site_pairs": lambda s, d: op.site_pairs(_sites(s, d)),
    "k16_single_site": lambda s, d: op.single_site(_sites(s, d)),
    "k17_factor_order": lambda s, d: op.factor_order(_sites(s, d).where("orientation = 1"), _sites(s, d).where("orientation = -1")),
    "k18_centred_pair": lambda s, d: op.centred_pair(op.site_pairs(_sites(s, d))),
    "k20_site_summary": lambda s, d: op.site_summary(_sites(s, d)),
    "k21_core_centred_training": lambda s, d: op.core_centred_training(_scored(s, d), 8, ["GGAA", "GGAT"]),
    "p10_strong_weak_order": lambda s, d: op.strong_weak_order(op.site_pairs(_sites(s, d))),
    "j15_match_sites": lambda s, d: op.match_sites(_sites(s, d), op.pwm_scan(v.sequences(s, d), PWM, above=4.0).selectExpr("key", "mid as pos", "score")),
    "j16_specific_sites": lambda s, d: op.sites_in_regions(_sites(s, d), _regions(s, d)),
    "f12_svr_features": lambda s, d: op.positional_index(op.core_windows(v.sequences(s, d, window=8), "GGAA", 8).select("window").distinct(), "window"),
}

_RC = "reverse(translate(sequence, 'ACGT', 'TGCA'))"
_CORE = lambda w, core, rc: f"c AS (SELECT key, start, 1 AS orientation, kmer AS \"window\" FROM windows WHERE substr(kmer, {(w - 4) // 2 + 1}, 4) = '{core}' UNION ALL SELECT key, start, -1, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM windows WHERE substr(kmer, {(w - 4) // 2 + 1}, 4) = '{rc}')"
_IDX = """idx AS (
SELECT "window", p * 4 + instr('ACGT', substr("window", p + 1, 1)) AS idx FROM (SELECT "window", unnest(range(0, 8))::INT AS p FROM dw)
UNION ALL SELECT "window", 32 + p * 16 + (instr('ACGT', substr("window", p + 1, 1)) - 1) * 4 + instr('ACGT', substr("window", p + 2, 1)) FROM (SELECT "window", unnest(range(0, 7))::INT AS p FROM dw)
UNION ALL SELECT "window", 32 + 112 + p * 64 + (instr('ACGT', substr("window", p + 1, 1)) - 1) * 16 + (instr('ACGT', substr("window", p + 2, 1)) - 1) * 4 + instr('ACGT', substr("window", p + 3, 1)) FROM (SELECT "window", unnest(range(0, 6))::INT AS p FROM dw))"""
_SV = "sv AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}::DOUBLE, {c}, {e}::DOUBLE)" for a, b, c, e in VECTORS) + ") t(sv_id, coef, idx, val))"

ORACLE_SQL = {
    "p7_reverse_complement": f"{v.with_views('sequences')} SELECT key, {_RC} AS rc, least(sequence, {_RC}) AS canonical FROM sequences",
    "p6_drop_homopolymers": f"{v.with_views('sequences')} SELECT * FROM sequences WHERE sequence NOT LIKE '%GGGGG%' AND sequence NOT LIKE '%CCCCC%'",
    "p18_differing_positions": f"{v.with_views('sequences')}, x AS (SELECT key, i FROM (SELECT key, sequence, unnest(range(0, length(sequence))) AS i FROM sequences) WHERE substr(sequence, i::INT + 1, 1) <> substr({_RC}, i::INT + 1, 1)) SELECT key, count(*) AS n, min(i) AS first FROM x GROUP BY key",
    "k1_kmer_windows": f"{v.with_windows(8)}, {_windows(8)} SELECT kmer, count(*) AS n, sum(start)::BIGINT AS starts FROM windows GROUP BY kmer",
    "j7_kmer_lookup": f"{v.with_windows(K)}, {_windows(K)}, {SCORES} SELECT key, sum(coalesce(score, -0.5)) AS total, count(*) AS n FROM windows LEFT JOIN (SELECT * FROM scores WHERE score > 0) USING (kmer) GROUP BY key",
    "k2_escore_profile": f"{PROFILE.replace(v.with_views('sequences'), v.with_windows(K))} SELECT key, max(score) AS best, max_by(position, score * 1000 + position / 1000.0) AS position FROM profile GROUP BY key",
    "k3_specific_regions": f"{PROFILE}, {REGIONS} SELECT * FROM regions",
    "w2_runs": f"{PROFILE}, {REGIONS} SELECT key, startpos AS first, last, n FROM r WHERE n >= 3",
    "k4_pwm_scan": f"{v.with_windows(K)}, {_windows(K)}, {_pwm_sql()} SELECT * FROM scan WHERE score > 0",
    "k6_core_windows": f"{v.with_windows(12)}, {_windows(12)}, {_CORE(12, 'GGAA', 'TTCC')} SELECT * FROM c",
    "k7_kernel_score": f"{v.with_windows(8)}, {_windows(8)}, {_CORE(8, 'GGAA', 'TTCC')}, dw AS (SELECT DISTINCT \"window\" FROM c), {_IDX}, {_SV}, q AS (SELECT sv_id, coef, sum(val * val) AS nsv FROM sv GROUP BY ALL), dt AS (SELECT \"window\", sv_id, sum(val) AS dot FROM idx JOIN sv USING (idx) GROUP BY ALL), z AS (SELECT dw.\"window\", sum(coef * exp(-0.1 * (21 + nsv - 2 * coalesce(dot, 0)))) - 0.05 AS val FROM dw CROSS JOIN q LEFT JOIN dt ON dt.\"window\" = dw.\"window\" AND dt.sv_id = q.sv_id GROUP BY 1) SELECT key, start, orientation, 1 / (1 + exp(-val)) AS score FROM c JOIN z USING (\"window\")",
    "k9_alignment_sites": f"""{v.with_views('sequences')}, {SCORES},
al AS (SELECT kmer, kp FROM scores, range(0, 6) p(kp) WHERE score >= 0.1 AND (ascii(kmer) + ascii(substr(kmer, 3, 1)) + kp * 5) % 3 <> 0),
st AS (SELECT key, sequence, 1 AS orientation FROM sequences UNION ALL SELECT key, {_RC}, -1 FROM sequences),
w AS (SELECT key, orientation, length(sequence) AS n, sequence, unnest(range(0, length(sequence) - 3)) AS start FROM st),
h AS (SELECT DISTINCT key, orientation, n, start, kp - start AS line FROM w JOIN al ON al.kmer = substr(sequence, start::INT + 1, 4)),
g AS (SELECT *, start - row_number() OVER (PARTITION BY key, orientation, n, line ORDER BY start) AS run FROM h),
r AS (SELECT key, orientation, n, line, min(start) AS a, max(start) AS b FROM g GROUP BY key, orientation, n, line, run HAVING count(*) >= 2)
SELECT DISTINCT key, CASE WHEN orientation = -1 THEN n - (5 - line) ELSE 3 - line END AS core_start, CASE WHEN orientation = -1 THEN n - (3 - line) ELSE 5 - line END AS core_end, CASE WHEN orientation = -1 THEN n - 1 - (4 - line) ELSE 4 - line END AS site_pos, orientation
FROM r WHERE a + line <= 1 AND b + line >= 3""",
    "k15_site_pairs": f"{SITES}, {PAIRS} SELECT *, pos_2 - pos_1 AS distance FROM pr",
    "k16_single_site": f"{SITES} SELECT key, min(pos) AS pos FROM s GROUP BY key HAVING count(*) = 1",
    "k17_factor_order": f"{SITES}, a AS (SELECT key, min(pos) AS pos_1 FROM s WHERE orientation = 1 GROUP BY key HAVING count(*) = 1), b AS (SELECT key, min(pos) AS pos_2 FROM s WHERE orientation = -1 GROUP BY key HAVING count(*) = 1) SELECT *, CASE WHEN pos_1 < pos_2 THEN 'er' ELSE 're' END AS ori FROM a JOIN b USING (key)",
    "k18_centred_pair": f"{SITES}, {PAIRS} SELECT *, pos_2 - pos_1 AS distance FROM pr WHERE abs((pos_1 + pos_2) / 2 - 18) <= 3",
    "k20_site_summary": f"{SITES} SELECT key, count(*) AS n_sites, min(pos) AS first_pos, max(pos) AS last_pos, max(pos) - min(pos) AS span, max(score) AS best FROM s GROUP BY key",
    "k21_core_centred_training": f"{v.with_views('sequences')}, w AS (SELECT sequence, length(sequence) + 1.5::DOUBLE * length(regexp_replace(sequence, '[^G]', '', 'g')) AS sc, unnest(range(0, length(sequence) - 7))::INT AS start FROM sequences), x AS (SELECT substr(sequence, start + 1, 8) AS \"window\", sc FROM w) SELECT \"window\", median(sc)::DOUBLE AS score FROM x WHERE substr(\"window\", 3, 4) IN ('GGAA', 'GGAT') GROUP BY 1",
    "p10_strong_weak_order": f"{SITES}, {PAIRS} SELECT key, pos_2 - pos_1 AS distance, CASE WHEN score_1 >= score_2 THEN pos_1 ELSE pos_2 END AS site_str_pos, greatest(score_1, score_2) AS site_str_score, CASE WHEN score_1 >= score_2 THEN pos_2 ELSE pos_1 END AS site_wk_pos, least(score_1, score_2) AS site_wk_score FROM pr",
    "j15_match_sites": f"{SITES} SELECT s.key, s.pos, s.score AS score_a, b.score AS score_b FROM s JOIN scan b ON s.key = b.key AND s.pos = b.mid AND b.score > 4",
    "j16_specific_sites": f"{SITES}, {SCORES}, profile AS (SELECT key, start, score FROM windows JOIN scores USING (kmer)), {REGIONS} SELECT * FROM s WHERE EXISTS (SELECT 1 FROM regions q WHERE q.key = s.key AND s.pos BETWEEN q.startpos AND q.startpos + q.escorelength)",
    "f12_svr_features": f"{v.with_windows(8)}, {_windows(8)}, {_CORE(8, 'GGAA', 'TTCC')}, dw AS (SELECT DISTINCT \"window\" FROM c), {_IDX} SELECT * FROM idx",
}
