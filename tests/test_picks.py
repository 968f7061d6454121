"""Picks of designs, pair verdicts, exact small rank tests and likeness of texts against plain loops."""

import difflib
import random
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindframe import registry
from bindframe.operators import picks, selection
from bindframe.sources import readers

SF = "/root/testdata/sf0.001"
COMMENTS = ["site1_left", "site1_right", "site2_left", "site2_right", None]


def designs(seed=3, groups=9, rows=240):
    """Rows of which one group holds a third; ties in scores, nulls in every column but name and key."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        key = 0 if rng.random() < 1 / 3 else rng.randrange(groups)
        some = lambda x: None if rng.random() < 0.05 else x
        out.append((key, f"n{i:03d}", False, some(rng.choice(COMMENTS[:4])), rng.randrange(6), some(rng.randrange(20) / 10), some(rng.random()), some(rng.random())))
    wild = {min(r[1] for r in out if r[0] == k) for k in range(groups - 1)}
    return [(r[0], r[1], r[1] in wild, "wt" if r[1] in wild else r[3], *r[4:]) for r in out] + [(None, "stray", False, "site1_left", 1, 0.5, 0.7, 0.1)]


SCHEMA = "grp int, name string, wild boolean, comment string, distance int, score double, p double, q double"


@pytest.fixture(scope="module")
def frame(spark):
    rows = designs()
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame([dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in rows])


def named(df):
    return sorted((r.grp, r.name) for r in df.collect())


def loop_ends(rows, score, n):
    import hashlib

    out = []
    for g, part in rows.groupby("grp"):
        mutants = part[~part["wild"]]
        scored = mutants[mutants[score].notna()].sort_values([score, "name"])
        ends = {scored.iloc[0]["name"], scored.iloc[-1]["name"]} if len(scored) else set()
        others = sorted((x for x in mutants["name"] if x not in ends), key=lambda x: (hashlib.md5(f"seed{x}".encode()).hexdigest(), x))[:n]
        out += [(g, x) for x in [*part[part["wild"]]["name"], *ends, *others]]
    return sorted(out)


def test_ends_and_hashed_others(frame):
    df, rows = frame
    assert named(picks.with_ends(df, "grp", "p", 2)) == loop_ends(rows[rows["grp"].notna()], "p", 2)


def test_inconsistent_groups(frame):
    df, rows = frame
    r = rows[rows["grp"].notna() & rows["p"].notna() & rows["q"].notna()]
    apart = r[(r["p"] >= 0.5) != (r["q"] >= 0.5)].assign(d=lambda x: (x["p"] - x["q"]).abs())
    best = apart.groupby("grp")["d"].max().sort_values(ascending=False).index[:4]
    assert named(picks.pick_inconsistent(df, "grp", "p", "q", 4, 1)) == loop_ends(apart[apart["grp"].isin(best)], "p", 1)


@pytest.mark.parametrize("how", ["distance", "orientation", "strength"])
def test_shifts(frame, how):
    df, rows = frame
    want = {}
    for g, part in rows[rows["grp"].notna() & rows["p"].notna()].groupby("grp"):
        part = part.sort_values(["distance", "name"])
        c = (part["p"] >= 0.5).astype(int)
        wild = c[part["wild"]]
        if how == "distance":
            moved = c.iloc[0] != c.iloc[-1]
        else:
            moved = len(wild) > 0 and ((c != wild.iloc[0]) & ~part["wild"]).sum() >= (1 if how == "orientation" else 2)
        want[g] = (len(part), int((c == 0).sum()), int((c == 1).sum()), bool(moved and len(part) > 1))
    got = {r.grp: (r.n, r.n_zero, r.n_one, r.shifted) for r in picks.group_shifts(df, "grp", "p", how).collect()}
    assert got == want
    with pytest.raises(ValueError):
        picks.group_shifts(df, "grp", "p", "colour")


def test_neighbours_over_parts(frame):
    df, rows = frame
    want = []
    for g, part in rows[rows["grp"].notna() & rows["score"].notna()].groupby("grp"):
        names = list(part.sort_values(["score", "name"])["name"])
        want += [(g, a, b) for a, b in zip(names, [*names[1:], None], strict=True)]
    got = sorted((r.grp, r.name, r.next_name) for r in picks.next_in_group(df, "grp", "score", ["name"]).collect())
    assert [(g, a, b or "") for g, a, b in got] == sorted((g, a, b or "") for g, a, b in want)


def test_small_and_large_changes(frame):
    df, rows = frame
    rows = rows[rows["grp"].notna()]
    at = rows["comment"].fillna("").str.contains("site1")
    small, large = [], {}
    for g, part in rows.groupby("grp"):
        base = part[part["wild"]]
        if len(base) and base.iloc[0]["p"] == base.iloc[0]["p"]:
            b = base.iloc[0]
            m = part[at[part.index] & ~part["wild"] & part["p"].notna() & ((part["p"] >= 0.5) != (b["p"] >= 0.5)) & ((part["score"] - b["score"]).abs() < 0.6)]
            small += [(g, x) for x in [*m["name"], *([b["name"]] if len(m) else [])]]
        m = part[at[part.index] & ~part["wild"] & part["score"].notna()]
        if len(m):
            large[g] = m.sort_values(["score", "name"])
    assert named(picks.pick_small_change(df, "grp", "p", "site1", "score", 0.6)) == sorted(small)
    top = sorted(large, key=lambda g: (-(large[g]["score"].max() - large[g]["score"].min()), g))[:3]
    want = []
    for g in top:
        m = large[g]
        near = [(a, b) for a, b, c, d, x, y in zip(m["name"], m["name"][1:], m["comment"], m["comment"][1:], m["score"], m["score"][1:], strict=False) if y - x < 0.15 and {c[6:], d[6:]} == {"left", "right"}]
        want.append((g, {m["name"].iloc[0], m["name"].iloc[-1]}, {x for p in near for x in p}, min(2, len(near))))
    got = picks.pick_large_change(df, "grp", "site1", "score", 3, 2, 0.15).collect()
    for g, ends, paired, pairs in want:
        mine = {r.name for r in got if r.grp == g and not r.wild}
        assert ends <= mine <= ends | paired and len(mine - ends) <= 2 * pairs
    assert {r.grp for r in got} == set(top) and {r.name for r in got if r.wild} == {x for x in rows[rows["wild"] & rows["grp"].isin(top)]["name"]}


def test_ratio_equals_the_plain_one(spark):
    rng = random.Random(5)
    rows = [(f"n{i % 3}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40))), i < 5) for i in range(60)] + [("n0", None, True), ("n1", "ACGT", None), ("n9", "AC", False)]
    want = []
    for name in ("n0", "n1", "n2"):
        texts = {s for n, s, _ in rows if n == name and s is not None}
        for wild in {s for n, s, w in rows if n == name and w and s is not None}:
            best = sorted((-difflib.SequenceMatcher(None, wild, s).ratio(), s) for s in texts)[:4]
            want += [(name, wild, s, round(-r, 12)) for r, s in best]
    got = picks.similar_by_ratio(spark.createDataFrame(rows, "name string, sequence string, wild boolean"), 4).collect()
    assert sorted((r.name, r.wild_sequence, r.sequence, round(r.ratio, 12)) for r in got) == sorted(want)


def test_block_ratios_equal_difflib_on_every_kind_of_text():
    from bindframe.functions.likeness import MOST, STEP, block_ratios

    rng = random.Random(8)
    for letters in ("A", "AC", "ACGT", "a\u00e9\u6f22\U0001f600"):
        for most in (3, 37, MOST + 1, MOST + 9, 260):
            a, b = (["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(80)] for _ in range(2))
            a[0], b[1], a[2], b[2] = None, None, "", ""
            assert block_ratios(a, b) == [None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert block_ratios(["AC"] * (STEP + 1), ["CA"] * (STEP + 1)) == [0.5] * (STEP + 1) and block_ratios([], []) == []


def test_ratio_query_keeps_the_wild_type_first(spark):
    rows = registry.QUERIES["j11_similar_by_ratio"](spark, SF).groupBy("name").agg(F.max("ratio").alias("best"), F.count("*").alias("n")).collect()
    assert rows and all(r.best == 1.0 and r.n <= 4 for r in rows)


def test_pair_verdicts_at_the_edges(spark):
    seqs = spark.createDataFrame([(k, "A" * 36) for k in ("none", "one", "near", "full", "good", "out")], "key string, sequence string")
    at = [("one", 5), ("near", 2), ("near", 8), ("full", 2), ("full", 14), ("good", 2), ("good", 14), ("out", 2), ("out", 30)]
    sites = spark.createDataFrame(at, "key string, pos int")
    regions = spark.createDataFrame([(k, p, 2) for k, p in at if p != 30], "key string, startpos int, escorelength int")
    # a window at the end of the first region counts, one at the start of the second does not
    profile = spark.createDataFrame([("full", 3, 0.1), ("full", 14, 0.1), ("good", 4, 0.1), ("near", 5, 0.1)], "key string, start int, score double")
    got = {r.key: (r.n_sites, r.distance, r.status) for r in picks.pair_verdicts(seqs, sites, lambda x: regions.join(x, "key", "left_semi"), lambda x: profile.join(x, "key", "left_semi"), 0.35).collect()}
    assert got == {"none": (0, None, "sites"), "one": (1, None, "sites"), "out": (1, None, "sites"), "near": (2, 6, "distance"), "full": (2, 12, "linker"), "good": (2, 12, "valid")}


def test_small_groups_have_an_exact_p(spark):
    a, b = [0.1, 0.9, 0.7], [0.2, 0.3, 0.5, 0.8]
    rows = [("k", "a", x) for x in a] + [("k", "b", x) for x in b]
    got = selection.value_rank_test(spark.createDataFrame(rows, "g string, kind string, value double"), ["g"], "a", "b").first()
    u = lambda chosen: sum(x > y for x in chosen for y in set(a + b) - set(chosen))
    null = [u(c) for c in combinations(a + b, 3)]
    assert got.u == u(a)
    assert got.p_greater == pytest.approx(sum(x >= u(a) for x in null) / len(null))
    assert got.p_less == pytest.approx(sum(x <= u(a) for x in null) / len(null))


def test_labelled_training_orders_and_centres(spark):
    f = spark.createDataFrame([("AA", 9, 13, 23, 27, 1.0, 2.0, 14), ("AA", 9, 13, 23, 27, 4.0, 2.0, 14), ("CC", 0, 4, 8, 12, 1.0, 2.0, 8), ("GG", 9, 13, 23, 27, 1.0, 1.0, 14)], "sequence string, core1_start int, core1_end int, core2_start int, core2_end int, site1_pref double, site2_pref double, distance int")
    c = spark.createDataFrame([("2", "x", "AA", "independent_o1"), ("1", "y", "AA", "cooperative_o1_o2"), ("3", "z", "CC", "cooperative"), ("4", "w", "GG", "anticoop_o2"), ("5", "v", "TT", "independent")], "id string, name string, sequence string, class string")
    got = {r.sequence: (r.id, r.site_str_pos, r.site_str_score, r.site_wk_pos, r.label) for r in picks.labelled_training(f, c).collect()}
    assert got == {"AA": ("1", 11, 2.5, 25, "cooperative"), "GG": ("4", 25, 1.0, 11, "anticoop")}


def test_extents_on_turned_peaks(spark):
    peaks = spark.createDataFrame([("a", "chr1", 100, 140, "+"), ("b", "chr1", 100, 140, "-"), ("c", "chr1", 100, 140, None)], "name string, chr string, start_pos long, end_pos long, strand string")
    calls = spark.createDataFrame([(k, 3, 7, 1) for k in "abc"], "key string, core_start int, core_end int, orientation int")
    got = {r.name: (r.start_pos, r.end_pos, r.orientation) for r in picks.site_extents(peaks, calls).collect()}
    assert got == {"a": (103, 107, 1), "b": (133, 137, -1), "c": (103, 107, 1)}


def test_name_parts_in_any_order(spark):
    df = spark.createDataFrame([("a_b_o1_wt",), ("short",)], "Name string")
    rows = readers.parse_probe_name(df, order=("name", "ori", "type")).collect()
    assert [(r.name, r.ori, r.type) for r in rows] == [("a_b", "o1", "wt"), ("", "", "")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert not picks.pick_largest_shift(df, "grp", "p", "distance", 3, 2).count()
    assert not picks.pick_large_change(df, "grp", "site1", "score", 3, 2, 0.1).count()
