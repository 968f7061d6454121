"""Every query with SQL gives DuckDB's rows on the smallest tables; unit tests of hand-made edges."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from bindframe import registry
from bindframe.operators import intervals, replicates, sites
from bindframe.sources import readers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("orders", "lineitem", "events", "documents", "labels")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_touching_peak_keeps_zero_area(spark):
    p = spark.createDataFrame([("chr1", 100, 200)], "chr string, start_pos long, end_pos long")
    u = spark.createDataFrame([("chr1", 200, 300, 5.0), ("chr1", 201, 300, 7.0)], "chr string, start_pos long, end_pos long, pileup double")
    assert [r.area for r in intervals.pileup_area(p, u).collect()] == [0.0]


def test_nearest_tie_takes_the_lower_and_crosses_bins(spark):
    a = spark.createDataFrame([("chr1", 10), ("chr1", 90_000), ("chr2", 5)], "chr string, pos long")
    b = spark.createDataFrame([("chr1", 5), ("chr1", 15)], "chr string, pos long")
    assert {(r.chr, r.pos): r.near for r in intervals.nearest_join(a, b).collect()} == {("chr1", 10): 5, ("chr1", 90_000): 15, ("chr2", 5): None}


def test_regions_cutoff_is_strict_and_tail_counts(spark):
    profile = spark.createDataFrame([("k", i, s) for i, s in enumerate([0.5, 0.4, 0.5, 0.5, 0.1, 0.1, 0.5])], "key string, start int, score double")
    got = [(r.startpos, r.n, r.escorelength) for r in sites.specific_regions(profile, 0.4, 0).collect()]
    assert got == [(2, 2, 2)]


def test_null_counts_against_enumeration():
    from itertools import combinations

    for m, n in ((1, 1), (2, 3), (3, 6)):
        found = [0] * (m * n + 1)
        for c in combinations(range(m + n), m):
            found[sum(c) - m * (m - 1) // 2] += 1
        assert replicates.null_counts(m, n) == found


def test_constant_replicates_have_p_one(spark):
    rows = [("a", "two", 1.0)] * 3 + [("a", "indiv", 1.0)] * 27
    assert [(r.method, r.p) for r in replicates.rank_test(spark.createDataFrame(rows, "name string, kind string, value double"), ["name"]).collect()] == [("constant", 1.0)]


def test_file_round_trips(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("8-mer\t8-mer.1\tE-score\nAAAC\tGTTT\t0.3\nGTTT\tAAAC\t0.1\n")
    assert {r.kmer: r.score for r in readers.read_escores(spark, str(tmp_path / "e.tsv")).collect()} == {"AAAC": 0.1, "GTTT": 0.3}
    (tmp_path / "k.tsv").write_text("kmer\tkposition\tEscore\tclassified\nAC\t[3,7]\t0.4\t1\nAG\t2\t0.1\t0\n")
    assert sorted((r.kmer, r.kposition) for r in readers.read_kmer_alignment(spark, str(tmp_path / "k.tsv")).collect()) == [("AC", 3), ("AC", 7)]
    (tmp_path / "p.txt").write_text("A:\t0.5\t0\nC:\t0.25\t1\nG:\t0.25\t0\nT:\t0\t0\n")
    pwm = readers.read_pwm(spark, str(tmp_path / "p.txt"))
    got = {(r.strand, r.pos, r.base): r.w for r in pwm.collect()}
    assert got["+", 0, "A"] == 1.0 and got["-", 1, "T"] == 1.0 and got["+", 0, "T"] == float("-inf")
    readers.write_pwm(readers.read_pwm(spark, str(tmp_path / "p.txt"), log=False), str(tmp_path / "pw"))
    again = readers.read_pwm(spark, str(tmp_path / "pw"), log=False)
    assert again.exceptAll(readers.read_pwm(spark, str(tmp_path / "p.txt"), log=False)).count() == 0
    (tmp_path / "s.txt").write_text(">a\n1,2,NA\n,4\n>b\n5\n")
    shapes = {r.key: r["values"] for r in readers.read_shape_profiles(spark, str(tmp_path / "s.txt")).collect()}
    assert shapes["b"] == [5.0] and shapes["a"][2] is None
    frame = spark.createDataFrame([("n_x_wt_o1_r2", "o1")], "Name string, ori0 string")
    assert readers.parse_probe_name(frame).first()["name"] == "n_x" and readers.parse_probe_name(frame).first()["rep"] == "r2"
    readers.write_table(frame, str(tmp_path / "t"), "ori0")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 1
    (tmp_path / "m.model").write_text("svm_type epsilon_svr\ngamma 0.1\nSV\n0.5 1:1 7:1\n-0.25 2:1\n")
    assert sorted((r.coef, r.idx) for r in readers.read_svm_models(spark, str(tmp_path / "m.model")).collect()) == [(-0.25, 2), (0.5, 1), (0.5, 7)]
    kept = readers.include_exclude(spark.createDataFrame([("ab",), ("b",), (None,)], "x string"), "x", "b", "a")
    assert [r.x for r in kept.collect()] == ["b"]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).where(F.col("area") >= 0).count() > 0


def test_required_columns_names_what_lacks(spark):
    from bindframe.operators import rows

    with pytest.raises(ValueError, match="b, c"):
        rows.required_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_probe_views_use_every_row(spark):
    from bindframe.sources import views

    assert views.probes(spark, SF).count() + views.controls(spark, SF).count() == views.table(spark, SF, "lineitem").count()


def test_wide_support_vectors_are_read_whole(spark, tmp_path):
    (tmp_path / "m.model").write_text("0.5 " + " ".join(f"{i}:1" for i in range(1, 100_051)) + "\n")
    assert readers.read_svm_models(spark, str(tmp_path / "m.model")).count() == 100_050


def test_chamber_and_result_tree(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Name\tSequence\tvalue\nab_1_wt_o1_r1\tACGTTT\t5\nab_1_m1_o2_r3\tCCGTTT\t6\nxx_wt_o1_r1\tACGTTT\t7\nNegCtrl_4_o1_r2\tGGGTTT\t2\n")
    probes, controls = readers.read_chamber(spark, str(tmp_path / "c.txt"), "value", include="^ab", length=3)
    assert sorted(map(tuple, probes.collect())) == [("ab_1", "m1", "o2", "r3", "CCG", 6.0), ("ab_1", "wt", "o1", "r1", "ACG", 5.0)]
    assert [tuple(r) for r in controls.collect()] == [("NegCtrl_4", "o1", "r2", "GGG", 2.0)]
    for tf in ("ets", "runx"):
        (tmp_path / tf).mkdir()
        (tmp_path / tf / "result_7.csv").write_text(f"a,b\n1,{tf}\n")
    found = readers.read_result_tree(spark, str(tmp_path / "*" / "result_*.csv"), r"/([a-z]+)/result_(\d+)", ["tf", "run"])
    assert sorted(map(tuple, found.collect())) == [("1", "ets", "ets", "7"), ("1", "runx", "runx", "7")]


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    readers.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df), str(tmp_path / "m"))
    assert list(readers.load_model(str(tmp_path / "m")).transform(df).first()["v"]) == [1.0, 2.0]


def test_intervals_cross_chunks_and_stop_at_the_end(spark):
    from bindframe.operators import selection

    chunks = selection.genome_chunks(spark.createDataFrame([("c", "AACCGGTTAC")], "chr string, seq string"), 4)
    rows = [("a", "c", 2, 7, "+"), ("b", "c", 2, 7, "-"), ("d", "c", 8, 20, "+"), ("e", "c", 10, 12, "+"), ("f", "c", 4, 4, "+")]
    got = selection.fetch_sequences(spark.createDataFrame(rows, "name string, chr string, start_pos long, end_pos long, strand string"), chunks, 4)
    assert {r.name: r.sequence for r in got.collect()} == {"a": "CCGGT", "b": "ACCGG", "d": "AC"}


def test_pieces_hold_every_window_once(spark, tmp_path):
    from bindframe.sources import views

    text = "abcdefghij" * 11 + "xyz"
    spark.createDataFrame([(1, text), (2, "abc"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sites.kmer_windows(views.sequences(spark, str(tmp_path), window=8), 8).groupBy("kmer").count().collect()
    bases = "".join("ACGT"[(ord(c) - 97) % 4] for c in text)
    want = {}
    for i in range(len(bases) - 7):
        want[bases[i : i + 8]] = want.get(bases[i : i + 8], 0) + 1
    assert {r.kmer: r["count"] for r in got} == want
    assert sorted((r.key, r.sequence) for r in views.sequences(spark, str(tmp_path)).where("key like '2%'").collect()) == [("2_0", "ACG")]


def test_peaks_sites_and_fasta_round_trips(spark, tmp_path):
    (tmp_path / "n.narrowPeak").write_text("chr1\t100\t300\tx\t5.5\t.\t1\t1\t1\t40\nchr2\t10\t20\ty\t1\t.\t1\t1\t1\t3\n")
    peaks = {r.chr: (r.start_pos, r.end_pos, r.peaklen) for r in readers.read_peaks(spark, str(tmp_path / "n.narrowPeak"), "summit", 50, with_length=True).collect()}
    assert peaks == {"chr1": (115, 164, 50), "chr2": (-12, 37, 50)}
    assert "peaklen" not in readers.read_peaks(spark, str(tmp_path / "n.narrowPeak")).columns
    (tmp_path / "p.bdg").write_text("chr1\t0\t50\t2.5\nchr1\t50\t60\t0\n")
    assert [tuple(r) for r in readers.read_pileup(spark, str(tmp_path / "p.bdg")).orderBy("start_pos").collect()] == [("chr1", 0, 50, 2.5), ("chr1", 50, 60, 0.0)]
    (tmp_path / "s.bed").write_text("chr1\t5\t9\nchr2\t7\t11\t0.5\n")
    bed = readers.read_sites(spark, str(tmp_path / "s.bed"))
    assert sorted((r.chr, r.start_pos, r.pref) for r in bed.collect()) == [("chr1", 5, None), ("chr2", 7, 0.5)]
    called = spark.createDataFrame([("a", "chr3", 100, 1), ("a", "chr3", 100, -1)], "name string, chr string, position long, orientation int")
    assert [tuple(r) for r in readers.genome_sites("caller", called=called, before=2, width=6).collect()] == [("chr3", 98, 104)]
    assert readers.genome_sites("file", sites=bed).count() == 2
    with pytest.raises(ValueError, match="caller"):
        readers.genome_sites("other")
    table = readers.sequence_table(spark, ["ACGT", None, "GG"])
    assert sorted(map(tuple, table.collect())) == [("1", "ACGT"), ("2", ""), ("3", "GG")]
    assert sorted(map(tuple, readers.sequence_table(spark, {"x": "AC"}).collect())) == [("x", "AC")]
    readers.write_fasta(table, str(tmp_path / "f"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "f").glob("part-*")).split(">")[1:]) == ["1\nACGT\n", "2\n\n", "3\nGG\n"]
    profiles = spark.createDataFrame([("a", [1.5, None, 3.0, 4.0, 5.0]), ("b", [2.0])], "key string, `values` array<double>")
    readers.write_profiles(profiles, str(tmp_path / "shapes"), 2)
    assert {r.key: list(r["values"]) for r in readers.read_shape_profiles(spark, str(tmp_path / "shapes")).collect()} == {"a": [1.5, None, 3.0, 4.0, 5.0], "b": [2.0]}


def test_matrix_range_and_strands(spark, tmp_path):
    (tmp_path / "p.txt").write_text("A:\t0.5\t0\t0.1\nC:\t0.25\t1\t0.2\nG:\t0.25\t0\t0.3\nT:\t0\t0\t0.4\n")
    read = lambda **k: {(r.strand, r.pos, r.base): r.w for r in readers.read_pwm(spark, str(tmp_path / "p.txt"), log=False, **k).collect()}
    part = read(start=1, end=3)
    assert part["+", 0, "C"] == 1.0 and part["+", 1, "T"] == 0.4 and part["-", 0, "A"] == 0.4 and len(part) == 16
    turned = read(start=1, reverse=True)
    assert turned["-", 0, "C"] == 1.0 and turned["+", 0, "A"] == 0.4


def test_array_order_has_seven_columns(spark, tmp_path):
    from bindframe.operators import probes

    sets = spark.createDataFrame([("k", "ACG", "AAG", "ACC", "AAC")], "key string, wt string, m1 string, m2 string, m3 string")
    rows = probes.array_design(sets, "TT", 2, "Coop_", 8)
    assert sorted(r.id for r in rows.collect()) == [f"Coop_{i:03d}" for i in range(1, 17)]
    probes.write_array_design(rows, str(tmp_path / "a"))
    lines = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*")).strip().split("\n")
    assert len(lines) == 16 and all(len(x.split("\t")) == 7 for x in lines)
    with pytest.raises(ValueError, match="direction"):
        probes.move_sites(sets, "up")


def test_quantiles_and_corrected_p_of_groups(spark):
    import random

    import numpy as np

    from bindframe.operators import curves

    rnd = random.Random(4)
    rows = [("a", rnd.choice([1.0, 2.0, rnd.gauss(0, 3)])) for _ in range(300)] + [("b", 7.0), (None, 1.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r.g: (r.low, r.mid, r.n) for r in curves.quantiles(df, ["g"], "x", {"low": 0.1, "mid": 0.5}, "n").collect()}
    for g in ("a", "b", None):
        xs = [x for k, x in rows if k == g]
        assert got[g] == pytest.approx((*np.quantile(xs, [0.1, 0.5]), len(xs)))
    assert "c" not in got and curves.quantiles(df.where("g = 'c'"), [], "x", {"mid": 0.5}).first().mid is None
    ps = [("a", round(rnd.random(), 2)) for _ in range(200)] + [("b", 0.01)]
    out = curves.adjusted_p(spark.createDataFrame(ps, "g string, p double"), ["g"], F.col("p")).collect()
    for r in out:
        own = sorted(p for g, p in ps if g == r.g)
        assert r.p_adjusted == pytest.approx(min(1.0, min(p * len(own) / (i + 1) for i, p in enumerate(own) if p >= r.p)))
    assert len(out) == len(ps)
