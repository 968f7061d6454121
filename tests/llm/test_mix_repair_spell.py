"""Mixing, conversation repair and spelling variants against brute force, with nulls, ties, repeated rows, long inputs and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from bindframe.llm import conversations, mixing, spelling
from bindframe.llm.queries import ORACLE_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# mixing


def mixed(sizes, weights=(5, 2, 1)):
    """source -> target by filling sources until none is above twice its size."""
    total = Fraction(3, 2) * sum(sizes.values())
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full: dict = {}
    while True:
        rest = [s for s in sizes if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: Fraction(2 * sizes[s]) for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= over


@pytest.fixture(scope="module")
def sources(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(0, 60), rnd.choice(["b", "a", "a", "a", "a", "Z", "é", None, ""]), "x") for i in range(300)]
    rows += [(7, "one two three", "a", "x")] * 40 + [(None, "no id here", "b", "y"), (None, None, "b", "y"), (400, None, "only nulls", "y"), (401, " \n ", None, "y"), (402, "long " * 30_000, "b", "z")]
    return rows


def test_mix_meets_targets_and_is_cut_to_the_word(spark, sources):
    docs = spark.createDataFrame(sources, "doc_id long, text string, source string, target string").repartition(3)
    got = mixing.mix(mixing.measure(docs), keep=["text"]).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter((d, s, t) for d, t, s, _ in sources)
    sizes = Counter()
    for _, t, s, _ in sources:
        sizes[s] += len(WORD.findall(t or ""))
    want = mixed(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(float(want[r.source]))
        taken[r.source] += r.taken
    assert {s: taken[s] for s in want} == {s: int(want[s]) for s in want}
    again = mixing.mix(mixing.measure(docs.repartition(7))).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in again) == Counter((r.doc_id, r.source, r.size, r.taken) for r in got)


def test_the_mix_itself_holds_the_words_taken(spark, sources):
    docs = spark.createDataFrame(sources, "doc_id long, text string, source string, target string")
    plan = mixing.mix(mixing.measure(docs), keep=["text"])
    rows = mixing.mixed_texts(plan).collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == plan.agg({"taken": "sum"}).first()[0]
    assert {r.epoch for r in rows} == {0, 1}


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(mixing.measure(spark.createDataFrame([], schema))).count() == 0
    rows = mixing.mix(mixing.measure(spark.createDataFrame([(1, None, None), (2, "", "a")], schema))).collect()
    assert [(r.taken, r.target) for r in rows] == [(0, 0.0)] * 2


def test_prefix_sums_over_one_hot_group(spark):
    rows = [(1, i % 7, 1 + i % 3) for i in range(500)] + [(2, 5, 10), (0, 1, 4)]
    df = spark.createDataFrame(rows, "g long, o long, v long").withColumnRenamed("v", "size").repartition(5)
    got = defaultdict(list)
    for r in mixing.prefix_sums(df, "g", [df["o"], df["size"]], ["size"]).collect():
        got[r.g].append((r.before_size, r.o, r["size"]))
    for g, found in got.items():
        found.sort()
        assert [x[1:] for x in found] == sorted(x[1:] for x in rows if x[0] == g)
        assert [x[0] for x in found] == [0, *itertools.accumulate(x[2] for x in found)][:-1]


def test_mix_has_sql():
    assert "op11_source_mixing" in ORACLE_SQL


# conversations


def plain_repair(rows):
    """The summary of one conversation's rows (turn, role, text) after damage, with audits as whole texts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in follow[state]:
                        new = (cost + 2, audit + "I", (*out, f"{name}:"))
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, out) in inserted(best).items():
            ways = [(state, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] and role[:1] in follow[state]:
                    ways.append((role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                ways += [(to, (cost + 2 + more, audit + "R", (*out, f"{name}:{text}"))) for to, name in (("u", "user"), ("a", "assistant")) if to in follow[state]]
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    best = inserted(best)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv] += []
        conv_text, turn_text, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return by


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Same.", "ü. ", "Fine.\n"]
    rows = [(c, None if rnd.random() < 0.05 else t + 3 * (t > 4), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice([*texts, None])) for c in range(120) for t in range(rnd.randrange(1, 9))]
    rows += [(500, t, "t", f"Line {t}.") for t in range(90)]  # every row must be reroled: audits differ from the first row on
    rows += [(501, t, ("user", "assistant")[t % 2], f"Line {t}." if t % 9 else "half") for t in range(200)]
    rows += [(502, 1, "user", "Again.")] * 5 + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (503, None, "user", "word " * 50_000 + ".")]
    return rows


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 4, 1])
def test_repair_equals_whole_audits(spark, talks, segment):
    df = spark.createDataFrame([(*r, 1, 2) for r in talks], "conv_id long, turn long, role string, text string, seg int, audit int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.summaries(conversations.repair(conversations.damage(df), segment), df).collect()}
    assert got == {conv: plain_repair(rows) for conv, rows in plain_damage(talks).items()}


def test_repaired_conversations_are_right(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for r in sorted(conversations.repair(conversations.damage(df), 5).collect(), key=lambda r: (r.seg, r.place, r.step)):
        if r.edit != "D":
            by[r.conv_id].append(r.role[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.summaries(conversations.repair(conversations.damage(empty)), empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema)
    assert [tuple(r) for r in conversations.summaries(conversations.repair(conversations.damage(one)), one).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_paths_compare_like_texts():
    rnd, paths = random.Random(2), conversations.Paths()
    nodes = [0]
    for _ in range(400):
        nodes.append(paths.add(rnd.choice(nodes[-40:]), rnd.choice("DIKR")))
    for a, b in itertools.product(rnd.sample(nodes, 60), repeat=2):
        assert paths.less(a, b) == (paths.edits(a) < paths.edits(b))


def test_equal_hashes_do_not_make_paths_equal():
    paths = conversations.Paths()
    a, b = paths.add(paths.add(0, "D"), "K"), paths.add(paths.add(0, "K"), "D")
    paths.hash = [0] * len(paths.hash)
    assert paths.less(a, b) and not paths.less(b, a)


# spelling


def plain_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if counts[v] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), counts[w], len(near[w]), counts.get(form.get(w))) for w in counts}


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(5)
    stems = ["color" + x for x in "abcde"] + ["".join(rnd.choice("abé×") for _ in range(rnd.randrange(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]
    pool = []
    for i, s in enumerate(stems):
        pool += [s] * (200 if i % 3 == 0 else 30) + [s[:2] + rnd.choice("xyz") + s[2:]] * 6 + [s[:-1] + "q"] * 5
    rnd.shuffle(pool)
    rows = [(i, " ".join(x.upper() if rnd.random() < 0.1 else x for x in pool[i::40])) for i in range(40)]
    return [*rows, (None, "Straße,naïve ÉCOLES écoles " * 9), (50, None), (51, ""), (7, "repeated rows here"), (7, "repeated rows here"), (52, "z" * 3000 + " " + ("y" * 700 + "-") * 6)]


@pytest.mark.parametrize("list_words", [spelling.LIST_WORDS, 3])
def test_variants_equal_all_pairs(spark, spelled, list_words):
    df = spark.createDataFrame([(*r, 1, "x") for r in spelled], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: tuple(r)[1:] for r in spelling.variants(df, list_words=list_words).collect()}
    want = plain_variants(plain_counts(spelled))
    assert got == want and any(v[0] for v in want.values())


def test_spans_split_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "SPAN", 5)
    text = "abc defghijk l mnÀÿo×p qrs" + "t" * 20
    assert [w for span in spelling.runs_of_letters(text) for w in span] == spelling.LETTERS.findall(spelling.lowered(text))


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "too short to be counted")], "doc_id long, text string")).count() == 0


def test_ranges_against_all_pairs():
    rnd = random.Random(1)
    for _ in range(150):
        half = rnd.choice([0, 1, 2])
        words = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(half + 1, 8))) for _ in range(40)})
        group = np.cumsum([1] + [a[:half] != b[:half] for a, b in itertools.pairwise(words)])
        low, high = np.searchsorted(group, group, "left"), np.searchsorted(group, group, "right")
        a, b = spelling.near_pairs(words, np.full(len(words), half, np.int64), group, low, high, words)
        want = [(i, j) for i in range(len(words)) for j in range(len(words)) if group[i] == group[j] and one_edit(words[i], words[j])]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_roots_follow_chains(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {**dict.fromkeys("abcde", "f"), "x": "y"}
