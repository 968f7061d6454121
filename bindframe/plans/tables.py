"""Queries of window, top-k, feature, evaluation and design operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindframe.functions import sequences as fn
from bindframe.functions.calling import matrix_caller
from bindframe.operators import design
from bindframe.operators import sites as site
from bindframe.operators import tables as op
from bindframe.plans.sites import K, PAIRS, PROFILE, PWM, SITES, _sites, _windows, kmer_scores
from bindframe.sources import views as v

PRIMER = "GTCTTGATTCGCTTGACGCTGCTG"
CORES = ["GGAA", "GGAT", "TTCC", "ATCC"]


def _pairs(s, d):
    """Sequences with two sites, and where their cores start."""
    both = site.site_pairs(_sites(s, d)).selectExpr("key", "pos_1 - 2 as pos_1", "pos_2 - 2 as pos_2")
    return v.sequences(s, d).join(both, "key")


QUERIES = {
    "p14_encode_label": lambda s, d: v.pairs(s, d).replace({"cooperative": "1", "independent": "0", "anticooperative": "-1"}, subset=["label"]).select("name", F.col("label").cast("int").alias("label")),
    "p15_logit": lambda s, d: v.pairs(s, d).where("probability > 0").select("name", fn.logit(F.col("probability")).alias("logit"), fn.logistic(fn.logit(F.col("probability"))).alias("back")),
    "p17_coordinate": lambda s, d: v.peaks(s, d).select(fn.coordinate(F.col("chr"), F.col("start_pos"), F.col("end_pos")).alias("coordinate")),
    "p13_relative_orientation": lambda s, d: _pairs(s, d).select("key", fn.relative_orientation(F.substring("sequence", (F.col("pos_1") + 1).cast("int"), F.lit(4)), F.substring("sequence", (F.col("pos_2") + 1).cast("int"), F.lit(4)), CORES[:2], CORES[:2]).alias("o")).select("key", "o", fn.head_tail(F.col("o")).alias("ht")),
    "w4_first_last_by": lambda s, d: op.first_last_by(v.pairs(s, d), "grp", "name", "label"),
    "w5_adjacent_similar": lambda s, d: op.adjacent_similar(v.pairs(s, d), "grp", "str_score", 0.2, F.col("probability") > 0.5).select("name", "grp", "str_score", "next"),
    "w6_top_groups": lambda s, d: op.top_groups(v.pairs(s, d), "grp", "str_score", 10).select("name", "grp", "str_score"),
    "w7_fit_budget": lambda s, d: op.fit_budget(v.pairs(s, d), "grp", F.md5(F.col("grp").cast("string")), 5000),
    "w8_groups_larger_than": lambda s, d: op.groups_larger_than(v.pairs(s, d), "grp", 12).select("name", "grp"),
    "w9_share_of_group": lambda s, d: op.share_of_group(v.pairs(s, d), "grp", "str_score").select("name", "share"),
    "w11_sample_per_group": lambda s, d: op.sample_per_group(v.pairs(s, d), "grp", 2, "seed").select("name", "grp"),
    "t2_extreme_by_label": lambda s, d: op.extreme_by_label(v.pairs(s, d), "str_score", "probability", 50, 50).select("name", "label", "diagonal"),
    "t3_first_per_key": lambda s, d: op.first_per_key(v.pairs(s, d), ["grp"], ["distance", "name"]).select("grp", "name"),
    "t5_common_names": lambda s, d: v.pairs(s, d).where("distance < 10").select("grp").intersect(v.pairs(s, d).where("probability > 0.9").select("grp")),
    "t6_top_up": lambda s, d: op.top_up(v.pairs(s, d), v.pairs(s, d).where("str_score > 4.4").select("grp").distinct(), "grp", "str_score", 40),
    "j19_attach_first": lambda s, d: op.attach_first(v.pairs(s, d), "grp", "str_score").select("name", "base", "delta"),
    "a13_residual_filter": lambda s, d: op.residual_filter(v.pairs(s, d), "probability", "str_score", 0.5).select("name", "residual"),
    "i23_label_shift": lambda s, d: op.label_shift(v.pairs(s, d), "grp", "distance"),
    "f1_distance_one_hot": lambda s, d: op.one_hot(v.pairs(s, d), "name", "distance", list(range(4, 25)), "dist_cat_"),
    "f2_orientation_one_hot": lambda s, d: op.one_hot(v.pairs(s, d), "name", "orientation", ["HH", "TT", "HT/TH"], "ori_"),
    "f4_flank_kmers": lambda s, d: op.flank_kmers(v.sequences(s, d), F.lit(1), 6, 2).groupBy("k", "position", "kmer").agg(F.count("*").alias("n")),
    "f6_gc_content": lambda s, d: op.gc_content(v.sequences(s, d)),
    "f7_canonical_kmers": lambda s, d: op.canonical_kmer_counts(site.kmer_windows(v.sequences(s, d), 3)),
    "m1_stratified_folds": lambda s, d: op.stratified_folds(v.pairs(s, d), 10).groupBy("label", "fold").agg(F.count("*").alias("n"), F.min("name").alias("low")),
    "m2_grid_search": lambda s, d: op.grid_search(v.pairs(s, d), ["str_score", "distance", "probability"], "cooperative", {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}),
    "m5_roc_points": lambda s, d: op.roc_points(v.pairs(s, d), "cooperative", "probability"),
    "m6_model_metrics": lambda s, d: op.model_metrics(v.pairs(s, d), ["distance"], "cooperative", "probability"),
    "m8_threshold_classifier": lambda s, d: op.threshold_classifier(v.pairs(s, d), "cooperative", "probability"),
    "i3_mutate_core": lambda s, d: design.mutate_core(_pairs(s, d), CORES),
    "i4_mutate_flank": lambda s, d: design.mutate_flank(_pairs(s, d), 4, 2),
    "i5_mutate_distance": lambda s, d: design.mutate_distance(_pairs(s, d), 4, 4),
    "i6_mutate_orientation": lambda s, d: design.mutate_orientation(_pairs(s, d), 4),
    "i7_wild_type_rows": lambda s, d: design.wild_type_rows(v.sequences(s, d)),
    "i9_abolish_core": lambda s, d: design.weakest_abolishing_core(v.sequences(s, d), matrix_caller(PWM, 3.0)),
    "i13_array_rows": lambda s, d: design.array_rows(v.sequences(s, d), PRIMER, 3),
    "i16_quiet_sequences": lambda s, d: design.quiet_sequences(site.escore_profile(v.sequences(s, d), kmer_scores(s), K), 0.4),
}

P = v.with_views("pairs")
TWO = f"{SITES}, {PAIRS}, two AS (SELECT q.key, sequence, pos_1 - 2 AS pos_1, pos_2 - 2 AS pos_2 FROM sequences q JOIN pr ON q.key = pr.key)"
_OVER = "substr(sequence, 1, ({at})::INT) || {new} || substr(sequence, ({at})::INT + {n} + 1)"
_RC4 = lambda e: f"reverse(translate({e}, 'ACGT', 'TGCA'))"
_STRAND = lambda e: f"CASE WHEN {e} IN ('GGAA', 'GGAT') THEN '+' WHEN {_RC4(e)} IN ('GGAA', 'GGAT') THEN '-' END"
_C1, _C2 = "substr(sequence, pos_1::INT + 1, 4)", "substr(sequence, pos_2::INT + 1, 4)"
_WAY = lambda e: " + ".join(f"CASE substr({e}, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {x}::DOUBLE" for b, x in row.items()) + " END" for i, row in enumerate(PWM))
_STEPS = "st AS (SELECT probability, count(*) FILTER (label = 'cooperative') AS p, count(*) FILTER (label <> 'cooperative') AS n FROM pairs GROUP BY 1), cu AS (SELECT probability, sum(p) OVER (ORDER BY probability DESC) AS cp, sum(n) OVER (ORDER BY probability DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM st)"

ORACLE_SQL = {
    "p14_encode_label": f"{P} SELECT name, CASE label WHEN 'cooperative' THEN 1 WHEN 'independent' THEN 0 ELSE -1 END AS label FROM pairs",
    "p15_logit": f"{P} SELECT name, ln(probability / (1 - probability)) AS logit, probability AS back FROM pairs WHERE probability > 0",
    "p17_coordinate": f"{v.with_views('peaks')} SELECT chr || ':' || start_pos || '-' || end_pos AS coordinate FROM peaks",
    "p13_relative_orientation": f"{TWO}, o AS (SELECT key, {_STRAND(_C1)} || '/' || {_STRAND(_C2)} AS o FROM two) SELECT key, o, CASE WHEN o IN ('+/+', '-/-') THEN 'HT/TH' WHEN o = '+/-' THEN 'HH' WHEN o = '-/+' THEN 'TT' END AS ht FROM o",
    "w4_first_last_by": f"{P} SELECT grp, min_by(label, name) AS first, max_by(label, name) AS last FROM pairs GROUP BY grp",
    "w5_adjacent_similar": f"{P}, l AS (SELECT name, grp, str_score, lead(str_score) OVER w AS next, probability > 0.5 AS a, lead(probability > 0.5) OVER w AS b FROM pairs WINDOW w AS (PARTITION BY grp ORDER BY str_score, name)) SELECT name, grp, str_score, next FROM l WHERE next - str_score <= 0.2 AND a <> b",
    "w6_top_groups": f"{P} SELECT name, grp, str_score FROM pairs WHERE grp IN (SELECT grp FROM pairs GROUP BY grp ORDER BY max(str_score) DESC, grp LIMIT 10)",
    "w7_fit_budget": f"{P}, z AS (SELECT grp, count(*) AS size FROM pairs GROUP BY grp), c AS (SELECT *, sum(size) OVER (ORDER BY md5(grp::VARCHAR), grp)::BIGINT AS total FROM z) SELECT * FROM c WHERE total <= 5000",
    "w8_groups_larger_than": f"{P} SELECT name, grp FROM pairs WHERE grp IN (SELECT grp FROM pairs GROUP BY grp HAVING count(*) > 12)",
    "w9_share_of_group": f"{P} SELECT name, str_score / sum(str_score) OVER (PARTITION BY grp) AS share FROM pairs",
    "w11_sample_per_group": f"{P} SELECT name, grp FROM pairs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('seed' || name)) <= 2",
    "t2_extreme_by_label": f"{P}, f AS (SELECT name, label, abs(str_score - probability) / sqrt(2.0) AS diagonal FROM pairs) (SELECT * FROM f WHERE label = 'cooperative' ORDER BY diagonal DESC, name LIMIT 50) UNION ALL (SELECT * FROM f WHERE label = 'independent' ORDER BY diagonal, name LIMIT 50)",
    "t3_first_per_key": f"{P} SELECT grp, name FROM pairs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY distance, name) = 1",
    "t5_common_names": f"{P} SELECT grp FROM pairs WHERE distance < 10 INTERSECT SELECT grp FROM pairs WHERE probability > 0.9",
    "t6_top_up": f"{P}, c AS (SELECT DISTINCT grp FROM pairs WHERE str_score > 4.4), r AS (SELECT grp, max(str_score) AS s FROM pairs WHERE grp NOT IN (SELECT grp FROM c) GROUP BY grp) SELECT grp FROM (SELECT grp, 0 AS o, 0 AS s FROM c UNION ALL SELECT grp, 1, s FROM r) ORDER BY o, s DESC, grp LIMIT 40",
    "j19_attach_first": f"{P} SELECT name, base, str_score - base AS delta FROM pairs JOIN (SELECT grp, min_by(str_score, name) AS base FROM pairs GROUP BY grp) USING (grp)",
    "a13_residual_filter": f"{P}, f AS (SELECT regr_slope(str_score, probability) AS a, regr_intercept(str_score, probability) AS b FROM pairs) SELECT name, str_score - a * probability - b AS residual FROM pairs, f WHERE abs(str_score - a * probability - b) <= 0.5 AND sign(probability) = sign(str_score)",
    "i23_label_shift": f"{P}, e AS (SELECT grp, first(label ORDER BY distance, name) AS first, last(label ORDER BY distance, name) AS last FROM pairs GROUP BY grp) SELECT first, last, count(*) AS n FROM e GROUP BY ALL",
    "f1_distance_one_hot": f"{P} SELECT name, " + ", ".join(f"(distance = {x})::INT AS dist_cat_{i}" for i, x in enumerate(range(4, 25))) + " FROM pairs",
    "f2_orientation_one_hot": f"{P} SELECT name, (orientation = 'HH')::INT AS ori_0, (orientation = 'TT')::INT AS ori_1, (orientation = 'HT/TH')::INT AS ori_2 FROM pairs",
    "f4_flank_kmers": f"{v.with_views('sequences')}, f AS (SELECT substr(sequence, 1, 6) AS s FROM sequences WHERE length(sequence) >= 6) SELECT k, position, substr(s, position::INT + 1, k) AS kmer, count(*) AS n FROM (SELECT s, 1 AS k, unnest(range(0, 6)) AS position FROM f UNION ALL SELECT s, 2, unnest(range(0, 5)) FROM f) GROUP BY ALL",
    "f6_gc_content": f"{v.with_views('sequences')} SELECT key, (length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', ''))) / length(sequence) AS gc FROM sequences",
    "f7_canonical_kmers": f"{v.with_views('sequences')}, {_windows(3)} SELECT key, least(kmer, {_RC4('kmer')}) AS kmer, count(*) AS n FROM windows GROUP BY 1, 2",
    "m1_stratified_folds": f"{P}, f AS (SELECT name, label, row_number() OVER (PARTITION BY label ORDER BY md5(name)) % 10 AS fold FROM pairs) SELECT label, fold, count(*) AS n, min(name) AS low FROM f GROUP BY ALL",
    "m5_roc_points": f"{P}, {_STEPS} SELECT probability, cp / tp AS tpr, cn / tn AS fpr FROM cu",
    "m6_model_metrics": f"{P}, r AS (SELECT *, rank() OVER (PARTITION BY distance ORDER BY probability) + (count(*) OVER (PARTITION BY distance, probability) - 1) / 2 AS r, label = 'cooperative' AS y, probability >= 0.5 AS h FROM pairs), c AS (SELECT distance, sum(r) FILTER (y) AS s, count(*) FILTER (NOT y AND NOT h) AS tn, count(*) FILTER (NOT y AND h) AS fp, count(*) FILTER (y AND NOT h) AS fn, count(*) FILTER (y AND h) AS tp FROM r GROUP BY 1) SELECT distance, (s - (fn + tp) * (fn + tp + 1) / 2) / ((fn + tp) * (tn + fp)) AS auc, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tn, fp, fn, tp FROM c",
    "m8_threshold_classifier": f"{P}, {_STEPS} SELECT probability AS cut, (cp + tn - cn) / (tp + tn) AS accuracy FROM cu ORDER BY accuracy DESC, probability DESC LIMIT 1",
    "i3_mutate_core": f"{TWO}, s2 AS (SELECT key, sequence, 1 AS site, pos_1 AS pos_at FROM two UNION ALL SELECT key, sequence, 2, pos_2 FROM two) SELECT key, site, core, {_OVER.format(at='pos_at', new='core', n=4)} AS sequence FROM s2, (SELECT unnest(['GGAA', 'GGAT', 'TTCC', 'ATCC']) AS core) WHERE core <> substr(sequence, pos_at::INT + 1, 4)",
    "i4_mutate_flank": f"{TWO}, s2 AS (SELECT key, sequence, 1 AS site, pos_1 AS pos_at FROM two UNION ALL SELECT key, sequence, 2, pos_2 FROM two), p AS (SELECT key, sequence, site, pos_at + o AS position FROM s2, (SELECT unnest([-1, -2, 4, 5]) AS o)) SELECT key, site, position, base, {_OVER.format(at='position', new='base', n=1)} AS sequence FROM p, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) WHERE position >= 0 AND position < length(sequence) AND base <> substr(sequence, position::INT + 1, 1)",
    "i5_mutate_distance": f"{TWO}, t AS (SELECT *, unnest(range(1, pos_2 - pos_1 - 4 + 1)) AS step FROM two WHERE pos_2 - pos_1 > 4) SELECT key, pos_2 - pos_1 - step AS distance, substr(sequence, 1, (pos_2 - step)::INT) || substr(sequence, pos_2::INT + 1, 4) || substr(sequence, (pos_2 - step)::INT + 1, step::INT) || substr(sequence, pos_2::INT + 5) AS sequence FROM t",
    "i6_mutate_orientation": f"{TWO}, a AS (SELECT *, {_OVER.format(at='pos_1', new=_RC4(_C1), n=4)} AS s1, {_OVER.format(at='pos_2', new=_RC4(_C2), n=4)} AS s2, substr(sequence, 1, pos_1::INT) || {_RC4(_C1)} || substr(sequence, pos_1::INT + 5, (pos_2 - pos_1 - 4)::INT) || {_RC4(_C2)} || substr(sequence, pos_2::INT + 5) AS s12 FROM two WHERE pos_2 - pos_1 >= 4) SELECT key, '1' AS turned, s1 AS sequence FROM a UNION ALL SELECT key, '2', s2 FROM a UNION ALL SELECT key, '12', s12 FROM a",
    "i7_wild_type_rows": f"{v.with_views('sequences')} SELECT key, muttype, sequence FROM sequences, (SELECT unnest(['affinity', 'distance', 'orientation']) AS muttype)",
    "i9_abolish_core": f"{SITES}, o AS (SELECT key, min(pos) - 2 AS pos_at FROM s GROUP BY key HAVING count(*) = 1), c AS (SELECT o.key, pos_at, i, base, substr(sequence, pos_at::INT + 1, 4) AS core FROM sequences q JOIN o ON q.key = o.key, range(0, 4) r(i), (SELECT unnest(['A', 'C', 'G', 'T']) AS base)), n AS (SELECT *, substr(core, 1, i::INT) || base || substr(core, i::INT + 2) AS new FROM c), z AS (SELECT key, pos_at + i AS position, base, greatest({_WAY('core')}, {_WAY(_RC4('core'))}) AS before, greatest({_WAY('new')}, {_WAY(_RC4('new'))}) AS after FROM n) SELECT * FROM z WHERE after < before QUALIFY row_number() OVER (PARTITION BY key ORDER BY after, position, base) = 1",
    "i13_array_rows": f"{v.with_views('sequences')}, w AS (SELECT key, 'o1' AS ori, sequence FROM sequences UNION ALL SELECT key, 'o2', {_RC4('sequence')} FROM sequences) SELECT key, ori, rep, sequence || '{PRIMER}' AS sequence FROM w, range(1, 4) r(rep)",
    "i16_quiet_sequences": f"{PROFILE} SELECT key, max(score) AS best FROM profile GROUP BY key HAVING max(score) < 0.4",
}
