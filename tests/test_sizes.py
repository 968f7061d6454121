"""What fails at size: rows with equal values, and plans whose work must not grow faster than their input."""

import ast
import math
import pathlib
import random

from pyspark.sql import functions as F

from bindframe.functions import calling, sequences, tails
from bindframe.operators import candidates, design, intervals, mutation, picks, probes, replicates, rows, selection, sites


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tied_designs_are_exact_on_demand(spark):
    rows = [("a", "two", float(v)) for v in (5, 6, 7)] + [("a", "indiv", float(v)) for v in (5, *range(10, 36))]
    df = spark.createDataFrame(rows, "name string, kind string, value double")
    assert replicates.rank_test(df, ["name"]).first().method == "normal"
    found = replicates.rank_test(df, ["name"], ties_exact=True).first()
    # U = 0.5 + 1 + 1 = 2.5, as 3
    counts = replicates.null_counts(3, 27)
    assert (found.method, found.u, round(found.p, 12)) == ("exact", 2.5, round(sum(counts[3:]) / sum(counts), 12))


def test_combinations_read_their_rows_once(spark):
    rows = [("a", t, "o1", i, float(v)) for t, v in (("m1", 1), ("m2", 10), ("m3", 3), ("wt", 7)) for i in (1, 2)] + [(None, "wt", "o1", 1, 5.0), (None, "m1", "o1", 1, 5.0), (None, "m2", "o1", 1, 5.0), (None, "m3", "o1", 1, 5.0), ("a", "m1", "o1", 3, None)]
    df = spark.createDataFrame(rows, "name string, type string, ori string, rep int, intensity double")
    found = replicates.replicate_combinations(df)
    assert "Join" not in plan_of(found)
    got = sorted(((r.name, r.kind, r.value) for r in found.collect()), key=repr)
    assert got == sorted([(None, "two", 5.0), *[("a", "two", 7.0)] * 2, *[("a", "indiv", 8.0)] * 8, *[("a", "indiv", None)] * 4], key=repr)


def test_beta_runs_on_batches(spark):
    df = spark.range(5).select(tails.t_p(F.col("id").cast("double"), F.lit(3.0)).alias("p"))
    assert "aggregate(" not in plan_of(df).lower()
    # closed form at 3 degrees of freedom
    upper = lambda t: 0.5 - (t / math.sqrt(3) / (1 + t * t / 3) + math.atan(t / math.sqrt(3))) / math.pi
    assert [round(r.p, 9) for r in df.collect()] == [round(2 * upper(t), 9) for t in range(5)]


def test_overlap_totals_against_pairs(spark):
    rnd = random.Random(5)
    value = lambda: rnd.choice([1.5, 2.25, -4.0, 0.1, None] + [float("inf")] * (rnd.random() < 0.05))
    spots = [0, 1, 6, 7, 8, 15, 16, 17, 24, 30, 31, 32, 33, 63, 64, 65]
    span = lambda: (s := rnd.choice(spots), s + rnd.choice([0, 0, 1, 7, 8, 9, 16, 40] + [-3] * (rnd.random() < 0.1)))
    a = [("c", *span()) for _ in range(60)] + [("d", 1, 5), (None, 1, 5), ("c", None, 5)]
    b = [("c", *span(), value()) for _ in range(90)] + [("e", 1, 5, 1.0), (None, 1, 5, 1.0), ("c", 3, None, 1.0)]
    want = {}
    for c, s, e in {x for x in a if None not in x}:
        hit = [(min(e, y) - max(s, x), w) for k, x, y, w in b if None not in (k, x, y) and k == c and x <= e and s <= y]
        if hit:
            held = [width * w for width, w in hit if w is not None]
            want[c, s, e] = (len(hit), len(held), sum(held) if held else None)
    at = "chr string, start_pos long, end_pos long"
    found = intervals.overlap_totals(spark.createDataFrame(a, at), spark.createDataFrame(b, f"{at}, w double"), F.col("w"), width=8)
    got = {(r.chr, r.start_pos, r.end_pos): (r.n, r.v, r.area) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, (n, held, area) in want.items():
        assert got[k][:2] == (n, held), k
        same = (math.isnan(area) and math.isnan(got[k][2])) if area is not None and math.isnan(area) else got[k][2] == area if area is None or math.isinf(area) else abs(got[k][2] - area) < 1e-9
        assert same, (k, area, got[k])


def test_peaks_and_sites_make_no_pairs(spark):
    at = "chr string, start_pos long, end_pos long"
    n = 3000
    a = spark.range(n).selectExpr("'c' as chr", "id % 7 as start_pos", "id % 7 + 20 as end_pos")
    b = spark.range(n).selectExpr("'c' as chr", "id % 5 as start_pos", "id % 5 + 9 as end_pos", "1.0D as pileup")
    # nine million pairs, of seven different peaks
    found = intervals.overlap_totals(a, b, F.col("pileup"))
    assert sorted((r.start_pos, r.n) for r in found.collect()) == [(i, n) for i in range(7)]
    joins = [line for line in plan_of(intervals.pileup_area(a, b)).splitlines() if "Join" in line and "_bin" in line]
    assert all("start_pos_a" in line for line in joins) and len(joins) <= 2
    assert spark.createDataFrame([("c", 1, 2)], at).transform(lambda df: intervals._contained(df, a)).count() == 1


def test_nearest_looks_back_only(spark):
    a, b = spark.createDataFrame([("c", 1)], "chr string, pos long"), spark.createDataFrame([("c", 5)], "chr string, pos long")
    assert "unboundedfollowing" not in plan_of(intervals.nearest_join(a, b)).lower()


def test_sites_on_batches_equal_expressions(spark):
    caller = calling.Caller(2, tuple(i / 16 for i in range(16)), 0.4)
    texts = ["ACGTTGCA", None, "", "A", "GT", "AéGTT", "acGT", "TT", "NNGTN", "😀GT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    scores = F.transform(caller.codes_of(F.col("s")), caller.score)
    for r in df.select("s", caller.sites_of(F.col("s")).alias("x"), caller.sites_on_batches(F.col("s")).alias("y"), scores.alias("a"), caller.scores_on_batches(F.col("s")).alias("b")).collect():
        assert (r.x, r.a) == (r.y, r.b), r.s
    assert "Python" in plan_of(df.withColumn("target", F.lit(0)).withColumnRenamed("s", "sequence").transform(lambda x: mutation.abolish_core(x, caller)))


def test_no_name_is_defined_twice():
    for path in pathlib.Path(sites.__file__).parents[1].rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), path


def test_kernel_windows_are_not_joined_with_vectors(spark):
    windows = spark.createDataFrame([("k", 0, "ACG"), ("k", 1, "CGT")], "key string, start int, window string")
    vectors = spark.createDataFrame([(1, 0.5, 1, 1.0)], "sv_id int, coef double, idx int, val double")
    found = sites.kernel_score(windows, vectors, 0.1, 0.0)
    assert plan_of(found).count("Join") == 1 and "MapInArrow" in plan_of(found)


def test_kernel_sites_read_their_sequences_once(spark):
    vectors = spark.createDataFrame([(1, 2.0, 1, 1.0), (2, -1.0, 5, 1.0)], "sv_id int, coef double, idx int, val double")
    models = [candidates.Kernel("GG", vectors, 0.1, 0.05), candidates.Kernel("AT", vectors, 0.2, -0.1), candidates.Kernel("GG", vectors, 0.1, 0.3, True)]
    texts = {"a": "ACGGATTACC", "b": "AGG", "c": "", "d": None, "e": "ACGGNTATCCA", "f": "C\u00e9GGATCCTA", "g": "AGGTATAT", "h": "acGGtaAT"}
    df = spark.createDataFrame(list(texts.items()), "key string, sequence string").coalesce(1)
    found = candidates.kernel_sites(df, models, 4, 0.4)
    assert "Join" not in plan_of(found) and "Union" not in plan_of(found)
    back = lambda s: "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(s))
    windows = [(i, k, j, w if way == 1 else back(w), way) for i, m in enumerate(models) for k, s in texts.items() for j in range(len(s or "") - 3) if set(w := s[j : j + 4]) <= set("ACGT") for way in (1, -1) if w[1:3] == (m.core if way == 1 else back(m.core))]
    each = sites.core_windows(df, "GG", 4).where("window rlike '^[ACGT]+$'").collect()
    assert sorted((r.key, r.start, r.window, r.orientation) for r in each) == sorted(w[1:] for w in windows if w[0] == 0)
    want = {}
    for i, m in enumerate(models):
        own = spark.createDataFrame([w[1:] for w in windows if w[0] == i], "key string, start int, window string, orientation int")
        for r in sites.kernel_score(own, *m[1:]).where("score > 0.4").collect():
            want[i, r.key, r.start] = max(r.score, want.get((i, r.key, r.start), 0))
    got = [(r.core, r.key, r.site_start, r.core_start, r.core_mid, round(r.score, 12)) for r in found.collect()]
    assert sorted(got) == sorted((models[i].core, k, j, j + 1, j + 2, round(x, 12)) for (i, k, j), x in want.items()) and len(got) > 8


def test_mutants_are_called_once(spark):
    caller = calling.Caller(2, tuple(float(i * 7 % 5) for i in range(16)), 3.5)
    rnd = random.Random(2)
    given = [(f"k{i % 25}", "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 2, 9, 12]))), rnd.randrange(3), 3 + rnd.randrange(4)) for i in range(60)] + [(None, "ACGTACGT", 1, 5), ("n", None, 1, 5), ("odd", "AC\u00e9TNCGT", 0, 6)]
    pairs = spark.createDataFrame(given, "key string, sequence string, pos_1 int, pos_2 int")
    found = probes.mutant_table(pairs, caller, ["GA", "CT"], 2, 1)
    assert plan_of(found).count("ArrowEvalPython") == 1 and plan_of(found).count("Join") == 1
    both = pairs.select("key", F.col("sequence").alias("original"))
    second = lambda df, kind, comment: mutation.still_called(df, caller).selectExpr("key", "sequence", f"{kind} as muttype", f"{comment} as comment")
    near = mutation.one_site_changed(design.mutate_flank(pairs, 2, 2).join(both, "key"), caller, F.col("original")).selectExpr("key", "sequence", "'affinity' as muttype", "concat('flank:', site, ':', position, base) as comment")
    want = near.union(second(design.mutate_core(pairs, ["GA", "CT"]), "'affinity'", "concat('core:', site, ':', core)")).union(second(design.mutate_distance(pairs, 2, 1), "'distance'", "concat('distance:', distance)"))
    want = want.union(second(design.mutate_orientation(pairs, 2), "'orientation'", "concat('turned:', turned)")).union(second(design.wild_type_rows(pairs), "muttype", "'wt'"))
    want = want.withColumn("s", caller.sites_on_batches(F.col("sequence"))).withColumn("x", caller.scores_on_batches(F.col("sequence")))
    want = want.selectExpr("key", "sequence", "muttype", "comment", "s[0] as pos_1", "s[1] as pos_2", "x[s[0]] as score_1", "x[s[1]] as score_2", "s[1] - s[0] as distance")
    assert [f.dataType for f in want.schema] == [f.dataType for f in found.schema]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and {r.muttype for r in near.collect()}


def test_array_rows_are_moved_packed(spark):
    texts = ["ACGTTGCAA", "A", "", None, "ACNGT", "acgt", "ACéGT😀", "TTTT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    for turned in (False, True):
        got = df.select("i", sequences.unpacked(sequences.packed(F.col("s")), F.lit(turned)).alias("t"), (sequences.reverse_complement(F.col("s")) if turned else F.col("s")).alias("u")).collect()
        assert [r.t for r in got] == [r.u for r in got]
    given = [("k", "ACG", "ACC", "CCG", "CCC"), ("k", "ACG", "ACC", "CCG", None), ("l", "AN", "A", "", "ACGTACGT"), (None, "A", "C", "G", "T")]
    sets = spark.createDataFrame(given, "key string, wt string, m1 string, m2 string, m3 string")
    found = probes.array_design(sets, "TT", 2, "C", 6)
    moved = [line for line in plan_of(found).splitlines() if "RepartitionByExpression" in line]
    assert len(moved) == 1
    each = sets.select("key", F.explode(F.array(*(F.struct(F.lit(x).alias("kind"), F.col(x).alias("sequence")) for x in ("wt", "m1", "m2", "m3")))).alias("v")).select(F.concat_ws("_", "key", "v.kind").alias("key"), "v.sequence")
    typed = design.array_rows(each, "TT", 2).selectExpr("concat(key, '_', ori, '_r', rep) as type", "sequence")
    want = rows.with_dense_ids(typed, "type").selectExpr("concat('C', lpad(cast(id as string), 5, '0')) as id", "sequence", "'Na|Na' as score", "'Na' as kind", "type", "'chr1:0-0' as coordinate")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # what is moved is the key, numbers and packed bases
    assert not any("primer" in line or "TT" in line for line in moved) and "parquet" in plan_of(found)


def test_site_pairs_sort_no_rows(spark):
    df = spark.createDataFrame([("a", 9, 1.0), ("a", 4, 2.0), ("b", 1, 1.0), ("c", 1, 1.0), ("c", 2, 1.0), ("c", 3, 1.0), (None, 5, 0.5), (None, 5, 0.5)], "key string, pos long, score double")
    found = sites.site_pairs(df)
    assert "Window" not in plan_of(found) and found.columns == ["key", "pos_1", "score_1", "pos_2", "score_2", "distance"]
    assert sorted(map(tuple, found.collect()), key=repr) == [("a", 4, 2.0, 9, 1.0, 5), (None, 5, 0.5, 5, 0.5, 0)]


def test_scan_looks_windows_up_on_batches(spark):
    rows = [{"A": 1.0, "C": -0.5, "G": 0.25, "T": 0.0}, {"A": -1.0, "C": 0.75, "G": 0.5, "T": 0.125}]
    texts = ["ACGTTGCA", None, "", "A", "GT", "A\u00e9GTT", "acGT", "NNGTN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, sequence string").coalesce(1)
    for above in (None, 0.4):
        found = sites.pwm_scan(df, rows, above=above)
        assert "MapInArrow" in plan_of(found) and [f.dataType.simpleString() for f in found.schema] == ["int", "int", "string", "double", "int", "bigint"]
        back = [{c: r["TGCA"["ACGT".index(c)]] for c in "ACGT"} for r in rows[::-1]]
        way = lambda w, table: sum(r[c] for r, c in zip(table, w, strict=True))
        each = [(k, j, w, max(way(w, rows), way(w, back)), 1 if way(w, rows) > way(w, back) else -1, j + 1) for k, s in enumerate(texts) for j in range(len(s or "") - 1) if set(w := s[j : j + 2]) <= set("ACGT")]
        assert sorted(map(tuple, found.collect())) == sorted(e for e in each if above is None or e[3] > above)


def test_rounds_write_and_shuffle_nothing(spark, tmp_path):
    given = [("a", "ACGGATTACGGGATCCATGAC", 3), ("a", "ACGGATTACGGGATCCATGAC", 0), ("b", None, 0)]
    caller = calling.Caller(2, tuple(float(i % 3) for i in range(16)), 1.5)
    found = mutation.abolish_site_rounds(spark.createDataFrame(given, "key string, sequence string, target int"), caller, calling.Caller(2, tuple(float(i * 7 % 5) for i in range(16)), 2.5))
    assert "Repartition" not in plan_of(found) and "parquet" not in plan_of(found)
    assert {r.key for r in found.collect()} == {"a"}
    sets = mutation.variant_sets_by_rounds(spark.createDataFrame(given, "key string, sequence string, target int"), caller, caller)
    assert "Join" not in plan_of(sets) and "parquet" not in plan_of(sets)


def test_array_ids_read_their_rows_once(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(["b", "a", "c", "a", None, "d"])], "x string, i int")
    assert sorted(map(tuple, rows.with_dense_ids(df, "x").collect()), key=repr) == sorted(map(tuple, df.join(rows.dense_ids(df, "x"), "x").collect()), key=repr)
    sets = spark.createDataFrame([("k", "ACG", "ACC", "CCG", "CCC")], "key string, wt string, m1 string, m2 string, m3 string")
    # the one join is with the counts of blocks
    assert plan_of(probes.array_design(sets, "TT", 2, "C")).count("Join Inner") == 1


def test_ranks_of_replicates_make_no_rows(spark):
    rnd = random.Random(3)
    pick = lambda: rnd.choice([1.0, 2.0, 2.5, 3.0, 4.0, float("inf")])
    given = [(f"p{i}", t, o, pick()) for i in range(40) for o in ("o1", "o2") for t in ("m1", "m2", "m3", "wt") for _ in range(rnd.randint(0 if i % 5 == 0 else 1, 4))] + [(None, t, "o1", 1.0) for t in ("m1", "m2", "m3", "wt")]
    df = spark.createDataFrame(given, "name string, type string, ori string, intensity double")
    found = replicates.replicate_rank_sums(df)
    assert "Window" not in plan_of(found) and plan_of(found).count("Aggregate") == 1
    pairs = replicates.replicate_combinations(df)
    middle = lambda kind: F.median(F.when(F.col("kind") == kind, F.col("value")))
    want = replicates.rank_sums(pairs, ["name", "ori"], also={"median_two": middle("two"), "median_indiv": middle("indiv")})
    columns = ["name", "ori", "m", "n", "ties", "u", "median_two", "median_indiv"]
    rows_of = lambda x: sorted(map(repr, x.where("name is not null").select(*columns).collect()))
    assert rows_of(found) == rows_of(want) and found.count() > 50
    # null is above NaN, and both are above numbers, as in SQL
    odd = [("a", "m1", "o1", 1.0), ("a", "m1", "o1", float("nan")), ("a", "m1", "o1", None), ("a", "m2", "o1", 1.0), ("a", "m3", "o1", 1.0), ("a", "wt", "o1", None)]
    row = replicates.replicate_rank_sums(spark.createDataFrame(odd, "name string, type string, ori string, intensity double")).first()
    assert (row.m, row.n, row.u, row.ties, row.median_two, row.m3) == (1, 3, 2.5, 6.0, None, 1.0)


def test_shapes_are_counted_in_one_pass(spark):
    given = [("a", "s", [1.0, None, 2.0]), ("a", "s", [3.0, 1.0, 2.0]), ("b", "s", [2.0, 1.0, 2.0]), ("c", "s", [None, 1.0, None])]
    found = selection.shape_difference(spark.createDataFrame(given, "label string, shape string, values array<double>"), "a", "b")
    assert "posexplode" not in plan_of(found)
    assert sorted((r.position, r.m, r.n, r.u) for r in found.collect()) == [(0, 2, 1, 1.0), (2, 2, 1, 1.0)]


def test_regions_and_verdicts_stay_in_their_rows(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 30))) for _ in range(80)] + ["ACNGTTéACGT", "", "A", "N" * 9]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)] + [("none", None)], "key string, sequence string")
    scores = spark.createDataFrame([(a + b, (i * 4 + j) * 7 % 16 / 16) for i, a in enumerate("ACGT") for j, b in enumerate("ACGT")], "kmer string, score double")
    pwm = [{"A": 1.0, "C": -1.0, "G": 0.5, "T": 0.0}, {"A": -0.5, "C": 0.25, "G": 1.0, "T": -1.0}]
    matrix = calling.matrix_caller(pwm, 1.2)
    table = sites.score_table(scores, 2)
    same = lambda x, y: sorted(map(tuple, x.collect()), key=repr) == sorted(map(tuple, y.select(*x.columns).collect()), key=repr)
    plain = df.where("sequence is not null and sequence not like '%N%'")
    for cutoff, gap in ((0.4, 0), (0.3, 1), (0.6, 3), (2.0, 1)):
        found = sites.region_scan(df, scores, 2, cutoff, gap)
        assert same(sites.region_scan(plain, scores, 2, cutoff, gap), sites.specific_regions(sites.escore_profile(plain, scores, 2), cutoff, gap))
        best = sites.region_peaks(df, scores, 2, cutoff, gap, matrix)
        assert "Join" not in plan_of(best) and same(best, selection.peak_in_region(found, sites.pwm_scan(df, pwm)))
    calls = sites.pwm_scan(df, pwm).where("score > 1.2").selectExpr("key", "mid as pos")
    want = picks.pair_verdicts(df, calls, lambda x: sites.region_scan(x, scores, 2, 0.3, 1), lambda x: sites.escore_profile(x, scores, 2), 0.2, 3, 12)
    rows_ = picks.pair_verdicts_in_rows(df, matrix, calling.Caller(2, table, 0.3), 1, 0.2, 3, 12)
    assert "Join" not in plan_of(rows_) and same(rows_, want) and rows_.select("status").distinct().count() > 2
    counted = sites.kmer_counts(df, 3)
    assert "Generate" not in plan_of(counted)
    assert same(counted.groupBy("kmer").agg(F.sum("n").alias("n")), sites.kmer_windows(df, 3).groupBy("kmer").agg(F.count("*").alias("n")))


def test_fits_read_folds_that_are_written(spark, monkeypatch):
    from pyspark.ml.tuning import CrossValidator

    from bindframe.operators import tables
    from bindframe.plans import models

    assert "Window" not in plan_of(models.QUERIES["m7_predict_by_orientation"](spark, "/root/testdata/sf0.001"))
    seen = []
    real = CrossValidator._fit
    monkeypatch.setattr(CrossValidator, "_fit", lambda self, data: (seen.append(plan_of(data)), real(self, data))[1])
    pairs = spark.range(60).selectExpr("concat('n', id) as name", "if(id % 3 = 0, 'x', 'y') as label", "id % 7 as a", "id % 5 + id % 3 as b")
    assert tables.grid_search(pairs, ["a", "b"], "x", {"regParam": [0.0, 0.1]}).count() == 2
    assert len(seen) == 1 and "Window" not in seen[0]
