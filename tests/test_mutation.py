"""Mutation operators against loops over whole sequences, on random sequences and edges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bindframe.functions.calling import BASES, Caller, matrix_caller
from bindframe.operators import mutation as op
from bindframe.operators import sites as site
from bindframe.plans.mutation import MIDDLE, PROFILE, SITES, WEAK, WIDE
from bindframe.plans.tables import PRIMER

SWAP = str.maketrans("ACGT", "TGCA")


def turned(seq):
    return seq.translate(SWAP)[::-1]


def code(kmer):
    out = 0
    for c in kmer:
        out = out * 4 + BASES.index(c)
    return out


def scores(caller, seq):
    return [caller.scores[code(seq[i : i + caller.k])] if set(seq[i : i + caller.k]) <= set(BASES) else None for i in range(len(seq) - caller.k + 1)]


def called(seq):
    return [i for i, s in enumerate(scores(SITES, seq)) if s is not None and s > SITES.above]


@pytest.fixture(scope="module")
def seqs():
    rnd = random.Random(4)
    out = {f"r{i}": "".join(rnd.choice("ACGGAAT") for _ in range(rnd.choice([36, 36, 36, 20, 9]))) for i in range(150)}
    return out | {"short": "AC", "empty": "", "none": "C" * 36, "n": "ACGTNGGAAN" * 3 + "AGGAAT", "border": "C" * 32 + "CAGG", "whole": "GGAA"}


@pytest.fixture(scope="module")
def frame(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "key string, sequence string").repartition(3)


def abolished_core(seq, target, change=None, low=0, high=None, allowed=()):
    before, old = called(seq), scores(SITES, seq)
    if target not in before:
        return None
    ways = []
    for p in range(target, target + 4):
        for b in range(4):
            new = seq[:p] + BASES[b] + seq[p + 1 :]
            after = scores(SITES, new)
            if not (low <= p < (len(seq) if high is None else high)) or not after[target] < old[target]:
                continue
            left = [i for i in called(new) if i != target]
            others = [i for i in before if i != target and i not in allowed]
            if any(i not in before for i in left) or any(i not in left for i in others):
                continue
            if change is not None and any(abs(after[i] - old[i]) > change for i in others):
                continue
            ways.append((after[target], p, b, new))
    best = min(ways, default=None)
    return best[3] if best and best[0] <= SITES.above else None


def abolished_rounds(seq, target, barrier=1, flank=4):
    others = [i for i in called(seq) if i != target]
    there, taken, positions, steps = True, set(), [], 0
    while True:
        own = scores(PROFILE, seq)
        free = [i for i in range(max(0, target - flank), min(len(seq) - 4, target + flank) + 1) if own[i] is not None and (i, seq[i : i + 4]) not in taken and not any(o - barrier <= i + 2 < o + 4 + barrier for o in others)]
        if not free:
            return seq, "stuck" if there else "abolished", steps, positions
        at = max(free, key=lambda i: (own[i], -i))
        if own[at] < PROFILE.above and not there:
            return seq, "abolished", steps, positions
        taken.add((at, seq[at : at + 4]))
        steps += 1
        place = at + 2
        new = min((PROFILE.scores[code(seq[at:place] + b + seq[place + 1 : at + 4])], b, seq[:place] + b + seq[place + 1 :]) for b in BASES)[2]
        still = target in called(new)
        if not still and len(called(new)) != len(others):
            continue
        if new != seq:
            positions = [*positions, place]
        seq, there = new, still


def test_calls_inside_a_row_equal_the_scan(spark, frame, seqs):
    got = {r.key: r.sites for r in op.with_sites(frame, SITES).collect()}
    assert got == {k: called(s) for k, s in seqs.items()}


def test_abolish_core(spark, frame, seqs):
    targets = op.with_sites(frame, SITES).select("key", "sequence", F.explode("sites").alias("target"))
    for change in (None, 0.5):
        got = {(r.key, r.target): r.abolished for r in op.abolish_core(targets, SITES, change).collect()}
        assert got == {(k, t): abolished_core(s, t, change) for k, s in seqs.items() for t in called(s)}
        assert any(got.values()) and not all(got.values())


@pytest.mark.parametrize("steps", [1, 8])
def test_rounds_equal_a_loop(spark, frame, seqs, steps, monkeypatch):
    monkeypatch.setattr(op, "STEPS", steps)
    some = frame if steps == 8 else frame.where("length(sequence) < 30")
    targets = op.with_sites(some, SITES).select("key", "sequence", F.explode("sites").alias("target"))
    got = {(r.key, r.target): (r.sequence, r.status, r.steps, r.positions) for r in op.abolish_site_rounds(targets, SITES, PROFILE).collect()}
    assert got == {(k, t): abolished_rounds(s, t) for k, s in seqs.items() if steps == 8 or len(s) < 30 for t in called(s)}


def test_rounds_end_at_the_most_and_take_nothing(spark, frame):
    targets = op.with_sites(frame, SITES).select("key", "sequence", F.explode("sites").alias("target"))
    assert {r.status for r in op.abolish_site_rounds(targets, SITES, PROFILE, most=8).select("status").distinct().collect()} >= {"steps", "abolished"}
    assert op.abolish_site_rounds(targets.where("false"), SITES, PROFILE).count() == 0
    assert op.abolish_site_rounds(targets.withColumn("target", F.lit(1000)), SITES, PROFILE).count() == 0


def sets_of(seqs, cut):
    out = {}
    for k, s in seqs.items():
        if len(called(s)) == 2:
            a, b = called(s)
            m1, m2 = cut(s, a), cut(s, b)
            m3 = cut(m1, b) if m1 else None
            if m1 and m2 and m3 and called(m1) == [b] and called(m2) == [a] and not called(m3):
                out[k] = (s, m1, m2, m3, a, b)
    return out


def test_variant_sets(spark, frame, seqs):
    got = {r.key: tuple(r)[1:] for r in op.variant_sets(frame, SITES).collect()}
    assert got == sets_of(seqs, abolished_core) and got


def test_variant_sets_by_rounds(spark, frame, seqs):
    def cut(s, t):
        if t not in called(s):
            return None
        seq, status, _, _ = abolished_rounds(s, t)
        return seq if status == "abolished" else None

    got = {r.key: tuple(r)[1:] for r in op.variant_sets_by_rounds(frame, SITES, PROFILE).collect()}
    assert got == sets_of(seqs, cut) and got


def across(seq):
    return [i for i in called(seq + PRIMER) if i < len(seq) < i + 4]


def test_clean_junction(spark, frame, seqs):
    rows = {r.key: (r.old, r.new, r.status) for r in op.clean_junction(frame, PRIMER, SITES).collect()}
    want = {}
    for k, s in seqs.items():
        new = s
        for turn in (lambda x: x, turned):
            ours = turn(new)
            if across(ours):
                cut = abolished_core(ours + PRIMER, across(ours)[0], None, 0, len(ours), across(ours))
                new = turn(cut[: len(ours)]) if cut else new
        clean = not across(new) and not across(turned(new)) and called(new) == called(s)
        want[k] = (s, new if clean else None, "dropped" if not clean else "clean" if new == s else "repaired")
    assert rows == want
    assert {x[2] for x in rows.values()} >= {"clean", "repaired"}
    mapped = {r.designed: r.source for r in op.junction_map(op.clean_junction(frame, PRIMER, SITES)).collect()}
    assert all(mapped[new] in seqs.values() for _, new, status in rows.values() if status == "repaired")


def regions(seq, cutoff, gap):
    own = scores(PROFILE, seq)
    highs = [i for i, s in enumerate(own) if s is not None and s > cutoff]
    groups: list[list[int]] = []
    for h in highs:
        if groups and h - groups[-1][-1] <= gap + 1:
            groups[-1].append(h)
        else:
            groups.append([h])
    out = []
    for i, g in enumerate(groups):
        low = (groups[i + 1][0] - 1 if i + 1 < len(groups) else len(own) - 1) - g[-1]
        if len(g) >= 2:
            out.append((g[0] + 2, g[0] + 2 + len(g) + (gap if low > gap else max(low - 1, 0))))
    return out


def test_check_probe_set(spark, seqs):
    rnd = random.Random(6)
    long = {f"x{i}": "".join(rnd.choice("ACGGAAT") for _ in range(36)) for i in range(3000)}
    sets = sets_of(long, abolished_core)
    df = spark.createDataFrame([(k, *v) for k, v in sets.items()], "key string, wt string, m1 string, m2 string, m3 string, site_1 int, site_2 int")
    cutoffs, gaps = [0.4, 0.3, 0.2, 0.1], [0, 1, 2]
    got = {r.key: (r.gap, r.cutoff) for r in op.check_probe_set(df, PROFILE, 4, cutoffs, gaps).collect()}
    want = {}
    for k, (wt, m1, m2, m3, a, b) in sets.items():
        for gap, cutoff in itertools.product(gaps, cutoffs):
            fits = lambda seq, places: len(regions(seq, cutoff, gap)) == len(places) and all(r[0] <= p + 4 and p <= r[1] for r, p in zip(regions(seq, cutoff, gap), places, strict=True))  # noqa: E731, B023
            if len({wt, m1, m2, m3}) == 4 and fits(wt, [a, b]) and fits(m1, [b]) and fits(m2, [a]) and fits(m3, []):
                want[k] = (gap, cutoff)
                break
    assert got == want and got


def weakened(seq, target, left):
    back = [{b: row[b.translate(SWAP)] for b in BASES} for row in reversed(WIDE)]

    def matrix(window):
        return max(sum(row[c] for row, c in zip(way, window, strict=True)) for way in (WIDE, back))

    if target < 2 or target + 6 > len(seq) or matrix(seq[target - 2 : target + 6]) < WEAK[1]:
        return None
    ways = []
    order = [1, 0, 2, 3] if left else [2, 3, 1, 0]
    places = [target - 2, target - 1, target + 4, target + 5]
    for number, flank in enumerate(itertools.product(BASES, repeat=4)):
        new = list(seq)
        for p, b in zip(places, flank, strict=True):
            new[p] = b
        new = "".join(new)
        inside = [s is not None and MIDDLE[0] <= s < MIDDLE[1] for i, s in enumerate(scores(PROFILE, new)) if target - 2 <= i < target + 2]
        if WEAK[0] < matrix(new[target - 2 : target + 6]) < WEAK[1] and any(x and y for x, y in itertools.pairwise(inside)):
            ways.append((max((n + 1 for n, j in enumerate(order) if flank[j] != seq[places[j]]), default=0), number, new))
    return min(ways)[2] if ways else None


def test_weaken_sites_equals_enumeration(spark):
    rnd = random.Random(9)
    rows = {f"w{i}": "".join(rnd.choice("ACGGAAT") for _ in range(36)) for i in range(600)}
    two = {k: (s, *called(s)) for k, s in rows.items() if len(called(s)) == 2}
    df = spark.createDataFrame([(k, *v) for k, v in two.items()], "key string, sequence string, site_1 int, site_2 int")
    got = {r.key: (r.weak_1, r.weak_2, r.weak_12) for r in op.weaken_sites(df, WIDE, 4, PROFILE, *WEAK, MIDDLE).collect()}
    want = {}
    for k, (s, a, b) in two.items():
        w1, w2 = weakened(s, a, True), weakened(s, b, False)
        w12 = weakened(w1, b, False) if w1 else None
        if w1 and w2 and w12 and w1 != s and w2 != s and w12 != w1:
            want[k] = (w1, w2, w12)
    assert got == want and got
    one = spark.createDataFrame([(k, s, a) for k, (s, a, _) in two.items()], "key string, sequence string, target int")
    single = {r.key: r.w for r in op.weaken_site(one, WIDE, 4, PROFILE, *WEAK, MIDDLE, "w").collect()}
    assert single == {k: weakened(s, a, True) for k, (s, a, _) in two.items()}


def test_longer_matrices_and_tables(spark, frame, seqs):
    rows = [{b: ((i * 7 + j * 3) % 5) - 1.5 for j, b in enumerate(BASES)} for i in range(9)]
    by = {}
    for n in (8, 9):  # looked up, and summed
        by[n] = site.pwm_scan(frame.where("key <> 'n'"), rows[:n]).collect()
        for r in by[n]:
            way = lambda s: sum(row[c] for row, c in zip(rows, s, strict=False))
            assert r.score == pytest.approx(max(way(r.site), way(turned(r.site)))) and r.orientation == (1 if way(r.site) > way(turned(r.site)) else -1)
        assert len(by[n]) == sum(max(0, len(s) - n + 1) for k, s in seqs.items() if k != "n")
    with pytest.raises(ValueError, match="4\\^k"):
        Caller(3, (0.0,), 1.0)
    assert matrix_caller(rows[:2], 0.0).k == 2


def test_kernel_parts_add_up(spark, monkeypatch):
    rnd = random.Random(1)
    vectors = spark.createDataFrame([(sv, float(sv - 3), rnd.randrange(1, 300), 1.0) for sv in range(7) for _ in range(9)], "sv_id int, coef double, idx int, val double")
    windows = spark.createDataFrame([(f"k{i}", i, "".join(rnd.choice(BASES) for _ in range(rnd.choice([6, 8])))) for i in range(40)], "key string, start int, window string")
    whole = {r.key: r.score for r in site.kernel_score(windows, vectors, 0.1, 0.2).collect()}
    monkeypatch.setattr(site, "VECTOR_BYTES", 8_000)
    parts = {r.key: r.score for r in site.kernel_score(windows, vectors, 0.1, 0.2).collect()}
    assert parts == pytest.approx(whole) and len(whole) == 40


def test_alignment_with_one_needed_position_needs_a_neighbour(spark):
    align = spark.createDataFrame([("AAAA", 1, 1.0), ("AAAC", 2, 1.0), ("GGGG", 1, 1.0)], "kmer string, kposition int, score double")
    df = spark.createDataFrame([("run", "AAAAC"), ("alone", "GGGGT")], "key string, sequence string")
    got = [(r.key, r.orientation) for r in site.alignment_sites(df, align, 4, (1, 5), 2, 0.5).collect()]
    assert got == [("run", 1)]
