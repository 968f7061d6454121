"""Features, candidate probes and chains on small hand-made tables: edges, short sequences, nulls, empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from bindframe.operators import candidates, features, mutation, probes
from bindframe.plans.mutation import CUTOFFS, GAPS, PROFILE, SITES
from bindframe.plans.sites import PWM
from bindframe.plans.tables import CORES, PRIMER

SEQUENCE = "CCGGAATTTTCCGGATCC"


def test_flanks_of_two_sites(spark):
    df = spark.createDataFrame([("a", SEQUENCE, 2, 12), ("b", SEQUENCE, 12, 2), ("edge", "ACGT", 0, 3), ("none", "", 0, 0)], "key string, sequence string, pos_1 int, pos_2 int")

    def got(seqin, mode):
        out = {}
        for r in features.pair_flank_kmers(df, seqin, 1, mode).collect():
            out.setdefault((r.key, r.site), {})[r.position] = r.kmer
        return {k: "".join(v[i] for i in sorted(v)) for k, v in out.items()}

    inner = got(4, "relative")
    assert inner["a", "s1"] == SEQUENCE[2:6] and inner["a", "s2"] == SEQUENCE[8:12][::-1]
    assert inner["b", "s2"] == inner["a", "s1"] and inner["b", "s1"] == inner["a", "s2"]
    assert inner["edge", "s1"] == "ACGT" and inner["edge", "s2"] == "GCA" and ("none", "s1") not in inner
    outer = got(-3, "positional")
    assert outer["a", "s1"] == SEQUENCE[:2][::-1] and outer["a", "s2"] == SEQUENCE[12:15] and ("edge", "s1") not in outer
    linker = got(2, "linker")
    assert linker["a", "toright"] == SEQUENCE[7:9] and linker["a", "toleft"] == SEQUENCE[5:7]
    with pytest.raises(ValueError, match="linker"):
        features.pair_flank_kmers(df, 2, 1, "other")


def test_linkers_and_canonical_counts(spark):
    df = spark.createDataFrame([("a", "GGAACGCGTTCC", 0, 8), ("short", "GGAATGGAA", 0, 5), ("none", "", 0, 0)], "key string, sequence string, pos_1 int, pos_2 int")
    got = {(r.key, r.kmer): (r.ratio, r.gc) for r in features.linker_features(df, 4, 2).collect()}
    assert got == {("a", "CG"): (2 / 3, 1.0), ("a", "GC"): (1 / 3, 1.0)}
    counts = {(r.key, r.kmer): r.n for r in features.canonical_counts(df, 2).collect()}
    assert counts["short", "A"] == 5 and counts["short", "AT"] == 1 and counts["short", "CC"] == 2
    shares = features.canonical_counts(df, 2, average=True).groupBy("key", F.length("kmer")).agg(F.sum("n").alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in shares) and len(shares) == 4


def test_base_weights_and_names(spark):
    df = spark.createDataFrame([("x", "AC"), ("x", "AG"), ("y", "N"), (None, "T")], "label string, sequence string")
    got = {(r.label, r.position, r.base): (r.n, r.share, r.weight) for r in features.base_weights(df).collect()}
    assert got["x", 0, "A"] == (2, 1.0, pytest.approx(2.0)) and got["x", 1, "C"] == (1, 0.5, pytest.approx(1.0)) and got[None, 0, "T"][0] == 1 and len(got) == 4
    a = spark.createDataFrame([("p", "u"), ("q", "u"), ("r", None)], "name string, label string")
    b = spark.createDataFrame([("p", "u"), ("q", "v"), ("s", "u")], "name string, label string")
    assert {r.name: r.kind for r in features.label_names(a, b).collect()} == {"p": "agree", "q": "differ", "r": "only_a", "s": "only_b"}


def test_factor_summary_takes_the_left_of_equals(spark):
    sites = spark.createDataFrame([("k", "e", 9, 4.0), ("k", "e", 3, 4.0), ("k", "r", 20, 1.0), ("l", "r", 5, 2.0)], "key string, factor string, pos int, score double")
    got = {r.key: r for r in features.factor_summary(sites, ["e", "r"]).collect()}
    assert (got["k"].e_n, got["k"].e_pos, got["k"].distance, got["k"].span) == (2, 3, 17, 17) and got["l"].distance is None and got["l"].e_n == 0


@pytest.mark.parametrize(("side", "at"), [("left", 0), ("centre", 2), ("right", 4)])
def test_training_windows_of_a_side(spark, side, at):
    df = spark.createDataFrame([("a", "TTGGAATTCC", 1.0), ("b", "TTGGAATTCA", 4.0), ("c", "GGA", 9.0)], "key string, sequence string, score double")
    want = {}
    for _, s, x in df.collect():
        for i in range(len(s) - 7):
            if s[i + at : i + at + 4] == "GGAA":
                want.setdefault(s[i : i + 8], []).append(x)
    assert {r.window: r.score for r in features.side_training(df, 8, ["GGAA"], side).collect()} == {w: sum(x) / len(x) for w, x in want.items()}
    with pytest.raises(ValueError, match="side"):
        features.side_training(df, 8, ["GGAA"], "up")


def test_candidate_probes_of_all_lengths(spark):
    peaks = spark.createDataFrame([("chr1", 1000, 1400, 200), ("chr1", 9000, 9100, 50)], "chr string, start_pos long, end_pos long, summit long")
    sites = spark.createDataFrame([("chr1", 1190, 1196), ("chr1", 1203, 1209), ("chr1", 1300, 1306), ("chr1", 9050, 9056)], "chr string, start_pos long, end_pos long")
    got = {(r.peaklen, r.sites_in_peak, r.distance, r.seq_start, r.mid_1, r.mid_2) for r in candidates.all_candidate_probes(peaks, sites, [100, 300], [2, 3], 4, 24).collect()}
    assert got == {(100, 2, 13.0, 1181, 12, 25), (300, 3, 13.0, 1181, 12, 25)}
    assert candidates.all_candidate_probes(peaks.where("false"), sites, [100], [2], 4, 24).count() == 0


def test_cut_below(spark):
    df = spark.createDataFrame([("yes", 0.1), ("yes", 0.2), ("no", 0.7), ("no", 0.9), ("yes", 0.8)], "label string, s double")
    r = candidates.best_cut(df, "yes", "s").first()
    ways = [(sum((y == "yes") == ((s >= c) == above) for y, s in df.collect()) / 5, c, above) for c in (0.1, 0.2, 0.7, 0.8, 0.9) for above in (True, False)]
    assert (r.accuracy, r.cut, r.above) == max(ways)


def test_minus_pairs_are_turned(spark):
    back = {"A": "T", "C": "G", "G": "C", "T": "A"}
    plus = "CACAGGAACACACACACGGATACACA"
    minus = "".join(back[c] for c in reversed(plus))
    df = spark.createDataFrame([("plus", plus), ("minus", minus), ("one", "CACAGGAACACA"), ("empty", "")], "key string, sequence string")
    got = {r.key: r for r in probes.training_table(df, PWM, 3.0).collect()}
    assert set(got) == {"plus", "minus"}
    assert got["minus"].sequence == plus and got["minus"].turned and not got["plus"].turned
    assert tuple(got["minus"])[2:8] == tuple(got["plus"])[2:8] and got["plus"].orientation == "+/+" and got["plus"].site_str_pos == 4


def test_chains_of_nothing(spark):
    none = spark.createDataFrame([], "key string, sequence string")
    assert probes.training_table(none, PWM, 3.0).count() == 0
    assert probes.filtered_probes(none, SITES, PROFILE, PRIMER, CUTOFFS, GAPS).count() == 0
    pairs = spark.createDataFrame([], "key string, sequence string, pos_1 int, pos_2 int")
    assert probes.mutant_table(pairs, SITES, CORES).count() == 0
    assert mutation.variant_sets(none, SITES).count() == 0


@pytest.mark.parametrize(("direction", "fixed"), list(itertools.product(("to_right", "to_left"), (False, True))))
def test_moved_sites_keep_the_length(spark, direction, fixed):
    rows = [("odd", "A" * 8 + "GGAA" + "C" * 7 + "GGAT" + "A" * 13, 11, 19, "T" * 4, "G" * 4), ("even", "A" * 8 + "GGAA" + "C" * 6 + "GGAT" + "A" * 14, 11, 18, "T" * 4, "G" * 4), ("near", "A" * 8 + "GGAAGGAT" + "A" * 20, 11, 12, "T" * 4, "G" * 4), ("bare", "A" * 36, 11, 19, "", "")]
    df = spark.createDataFrame(rows, "key string, sequence string, end_1 int, start_2 int, flank_left string, flank_right string")
    got = {r.key: (r.step, r.sequence) for r in probes.move_sites(df, direction, fixed).collect()}
    sign, (a, b) = (1, ("TGGAA", "TTGGAA")) if direction == "to_right" else (-1, ("", ""))
    assert "bare" not in got and all(len(s) == 36 for _, s in got.values())
    assert got["odd"][0] == sign and got["even"][0] == 2 * sign and ("near" in got) == fixed
    seq = got["even"][1]
    first, second = seq.index("GGAA"), seq.index("GGAT")
    if direction == "to_right":
        assert (first, second) == (10, 20 if fixed else 18) and seq.startswith("TT")
    else:
        assert (first, second) == (6 if fixed else 8, 16) and seq.endswith("GG")
