"""Text operators against brute force and the tokenizers library, on small fixtures with every edge case."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bindframe.llm import attention_lm, bpe_transducer, decontaminate, near_dedup, quality_cnn, quality_rules, sharding, substring_dedup, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string, id string, node int, component_id string, label int, _key string, _gone int, _id int, Lines int"


def words(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice(["alpha", "beta", "gamma", "delta", "mu", "nu", "xi", "pi", "rho", "tau"]) + str(rnd.randrange(60)) for _ in range(n)]


def edited(text, at):
    parts = text.split(" ")
    parts[at] = "changed"
    return " ".join(parts)


BASE = " ".join(words(120, 1))
PASSAGE = " ".join(words(70, 2))
ITEM = "The quick brown foxes of the northern hills jumped over seventeen lazy dogs, and nobody in the valley saw them go."


@pytest.fixture(scope="module")
def texts():
    rows = [(i, " ".join(words(90, 100 + i)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, BASE, "en", "s0"), (101, BASE, "en", "s0"), (102, edited(BASE, 60), "en", "s1"), (103, edited(edited(BASE, 60), 20), "en", "s1")]
    rows += [(110 + i, f"{' '.join(words(60, 200 + i))}\n{PASSAGE}\n{' '.join(words(55, 300 + i))}", "en", "s2") for i in range(3)]
    rows += [(120, f"{' '.join(words(80, 400))} {ITEM} {' '.join(words(10, 401))}", "en", None), (121, f"{' '.join(words(60, 402))} {ITEM.replace('brown', 'brawn').upper()}", None, "s1")]
    rows += [(130, None, None, None), (131, "", "en", "s0"), (132, " \n\t ", "en", "s0"), (133, "one two", "en", "s0"), (134, "one two", "en", "s1"), (None, "text without an id " * 20, "en", "s0")]
    rows += [(140, " ".join(words(20000, 500)), "en", "s0"), (141, "same words again " * 40, "en", "s0"), (150, "repeated row " + BASE[::-1], "en", "s0"), (150, "repeated row " + BASE[::-1], "en", "s0")]
    rows += [(160, "mail a.b@example.com or +1 (706) 555-3138\nline\nline\n<|endoftext|> naïve 日本語 \x1c\x85 don't", "fr", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, 7, "x", "y", 3, "z", 5, "k", 1, 2, 3) for r in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def test_quality_rules(docs, empty, texts):
    got = as_rows(quality_rules.quality_rules(docs))
    assert len(got) == len(texts)
    expected = Counter((r[0], *quality_rules.measure_text((r[1] or "").encode())) for r in texts)
    assert Counter((g["doc_id"], *(g[m] for m in quality_rules.MEASURES)) for g in got) == expected
    by = {g["doc_id"]: g for g in got}
    assert by[130]["base_failed"] and by[131]["base_failed"] and by[141]["base_failed"] and not by[0]["base_failed"]
    assert quality_rules.measure_text("a b c a b c x ü\n\nq\nq".encode()) == (10, 10, 0, 1, 6)
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(g["doc_id"] for g in got if g["kept"])


def test_hosts_are_judged_by_rules_that_turn_down_no_document(spark):
    plain, marked = " ".join(words(80, 3)), " ".join(f"#{w}" for w in words(80, 4))
    rows = [(i, plain, "good") for i in range(60)] + [(100, marked, "good")] + [(200 + i, marked, "bad") for i in range(40)] + [(300, plain, "bad"), (301, plain, None), (302, "few", "bad")]
    got = {g["doc_id"]: g for g in as_rows(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string")))}
    assert {i for i, g in got.items() if g["kept"]} == {*range(60), 100, 301}
    assert {i for i, g in got.items() if g["base_failed"]} == {302} and got[300]["host_failed"] and not got[100]["host_failed"]
    own = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"), rules={"short": quality_rules.RULES["short"]})
    assert {g["doc_id"] for g in as_rows(own) if not g["kept"]} == {302}


def test_host_prior_shrinks():
    a, b = quality_rules._prior(1000, 10, 100_000, 100, 100 * 100 / 1000 + 500)
    assert 0 < a / (a + b) < 1 and abs(a / (a + b) - 0.1) < 1e-9


def test_sharding(docs, empty, texts):
    got = as_rows(sharding.shard(docs, 4000))
    assert len(got) == len(texts)
    sizes = Counter()
    for g in got:
        sizes[g["shard"]] += g["bytes"]
    for g in got:
        assert sizes[g["shard"]] == g["shard_bytes"] and len(g["shard"]) == g["depth"]
        assert g["shard_bytes"] <= 4000 or g["oversize"]
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert {g["doc_id"] for g in got if g["oversize"]} == {140}
    assert sharding.shard(empty, 4000).count() == 0
    assert {g["shard"] for g in as_rows(sharding.shard(docs, 10**9))} == {""}


def brute_components(sets, percent):
    ids = list(range(len(sets)))
    part = list(ids)
    for i in ids:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    return part


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(docs, empty, texts, k):
    got = as_rows(near_dedup.near_dedup(docs, k=k))
    assert len(got) == len(texts)
    real = [r for r in texts if r[0] is not None]
    sets = [set(near_dedup.shingle_set(r[1], k).tolist()) for r in real]
    part = brute_components(sets, 80)
    low = {}
    for p, r in zip(part, real):
        low[p] = min(low.get(p, r[0]), r[0])
    expected = {r[0]: (len(s), low[p]) for r, s, p in zip(real, sets, part)}
    for g in got:
        if g["doc_id"] is None:
            assert g["component_id"] is None and g["kept"]
        else:
            assert (g["n_shingles"], g["component_id"]) == expected[g["doc_id"]]
            assert g["kept"] == (g["doc_id"] == g["component_id"])
    assert expected[103][1] == 100 and expected[134][1] == 133 and expected[131][1] == 131
    assert near_dedup.near_dedup(empty).count() == 0


def test_large_nodes_split_and_block():
    """Nodes over the limit branch, and at the last level every pair of blocks meets."""
    assert near_dedup.trees_for(0.8, 0.999) >= 8
    assert abs(near_dedup.survival(0.8, 1) - 0.84) < 1e-9


def test_recall_at_full_depth():
    from bindframe.llm._setjoin import DEPTH

    assert 1 - (1 - near_dedup.survival(0.8, DEPTH + 1)) ** near_dedup.trees_for(0.8) >= 0.999
    within = 1 - (1 - near_dedup.survival(0.8, DEPTH)) ** substring_dedup.bucket_trees(0.8)
    assert 1 - (1 - 0.8**substring_dedup.ROWS * within) ** substring_dedup.BANDS >= 0.999


def test_large_buckets_branch_in_several_trees(spark, monkeypatch):
    from bindframe.llm import _setjoin

    rows = [(i, edited(BASE, (7 * i) % 115)) for i in range(40)]
    monkeypatch.setattr(_setjoin.candidate_clusters, "__defaults__", (8, 1))
    seen, branch = [], _setjoin.candidate_clusters
    monkeypatch.setattr(substring_dedup, "candidate_clusters", lambda *a, **k: seen.append(k["trees"]) or branch(*a, **k))
    got = substring_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("lines is not null").collect()
    assert seen == [substring_dedup.bucket_trees(0.8)] and {r.doc_id: (r.kept_doc_id, r.removed) for r in got} == {i: (0, i > 0) for i in range(40)}


def test_near_dedup_with_small_nodes(spark, monkeypatch):
    from bindframe.llm import _setjoin

    rows = [(i, edited(edited(BASE, i % 115), (7 * i) % 115)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(_setjoin.candidate_clusters, "__defaults__", (8, 2))
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame, k=4).collect()}
    sets = [set(near_dedup.shingle_set(t, 4).tolist()) for _, t in rows]
    part = brute_components(sets, 80)
    assert got == {i: min(j for j in range(60) if part[j] == part[i]) for i in range(60)}


def test_substring_dedup(docs, empty, texts):
    got = as_rows(substring_dedup.repeated_paragraphs(docs))
    found = {(g["doc_id"], g["paragraph"]): (g["kept_doc_id"], g["kept_paragraph"], g["removed"]) for g in got}
    for i in range(3):
        assert found[110 + i, 1] == (110, 1, i > 0)
    assert found[101, 0] == (100, 0, True) and found[150, 0][2] is False
    assert not any(d is not None and d < 100 for d, _ in found)
    clean = substring_dedup.remove_repeats(docs)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert PASSAGE in left[110] and PASSAGE not in left[111] and left[111].count("\n") == 1
    assert 101 not in left and left[130] is None and left[131] == ""
    assert substring_dedup.repeated_paragraphs(empty).count() == 0


def test_rows_that_a_join_moves_are_the_wanted_ones_and_few_others(spark):
    from bindframe.llm import _common

    rows = spark.range(40_000).selectExpr("concat('k', id) as k", "id")
    keys = spark.range(0, 40_000, 20).selectExpr("concat('k', id) as k")
    found = {r.id for r in _common.likely_in(rows, keys, "k").collect()}
    assert set(range(0, 40_000, 20)) <= found and len(found) < 8_000
    assert _common.likely_in(rows, keys.limit(0), "k").count() == 0
    for most in (10, 10_000):
        assert _common.join_wanted(rows, keys, "k", most).count() == 2_000


def test_substring_dedup_moves_wanted_texts_only(spark, monkeypatch):
    """A text without a repeated passage does not go to the search of single windows, however small the table is."""
    moved = []
    plain = substring_dedup.likely_in
    monkeypatch.setattr(substring_dedup, "likely_in", lambda df, keys, column: moved.append(plain(df, keys, column)) or moved[-1])
    passage = " ".join(words(70, 1))
    rows = [("a", " ".join([*words(9, 2), passage, *words(9, 3)])), ("b", " ".join([*words(8, 4), passage, *words(8, 5)])), *((f"c{i}", " ".join(f"w{i}x{j}" for j in range(200))) for i in range(30))]
    got = substring_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id string, text string")).where("removed").collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {("b", "a")}
    texts = {r.doc_id for df in moved if "text" in df.columns for r in df.collect()}
    assert {"a", "b"} <= texts and len(texts) < 10


def test_substring_dedup_over_lines_and_inside_lines(spark):
    run, wide = words(54, 900), words(57, 901)
    rows = [(1, " ".join(words(80, 902) + run + words(80, 903))), (2, "a title\n" + " ".join(run[:15]) + "\n" + " ".join(run[15:]) + "\nan end"), (3, " ".join(words(90, 904) + run + words(70, 905)))]
    lines = ["\n".join(" ".join(x[i : i + 19]) for i in (0, 19, 38)) for x in (wide, [*wide[:28], "changed", *wide[29:]])]
    rows += [(4, lines[0]), (5, lines[1]), (6, " ".join(words(300, 906))), (7, "same " * 200), (8, "same " * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_rows(substring_dedup.repeated_paragraphs(docs))
    found = {(g["doc_id"], g["start"], g["n_words"]): (g["kept_doc_id"], g["kept_paragraph"]) for g in got if g["removed"]}
    assert found == {(2, 2, 54): (1, 0), (3, 90, 54): (1, 0), (5, 0, 57): (4, 0), (7, 50, 150): (7, 0)}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert left == {1: rows[0][1], 2: "a title\nan end", 3: " ".join(words(90, 904) + words(70, 905)), 4: lines[0], 6: rows[5][1], 7: "same " * 50, 8: rows[7][1]}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(7, ITEM, "z"), (8, None, "z"), (9, "short", "z"), (10, "", "z"), (11, "nothing like this is anywhere in any of the documents at all", "z")], "item_id long, text string, edits string")
    got = as_rows(decontaminate.contaminated(docs, items))
    assert {(g["doc_id"], g["item_id"]): g["edits"] for g in got} == {(120, 7): 0, (121, 7): 1}
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and {120, 121}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() == docs.count() - 2
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert {(g["doc_id"], g["item_id"]) for g in as_rows(decontaminate.contaminated(docs, items, block_chars=60))} == {(120, 7), (121, 7)}


def levenshtein_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_qgram_bound_and_alignment():
    rnd = random.Random(4)
    known = decontaminate.Benchmark([1], [ITEM], decontaminate.Q, decontaminate.EDIT_PERCENT)
    for trial in range(60):
        inner = list(ITEM.lower())
        for _ in range(rnd.randrange(0, 14)):
            at = rnd.randrange(len(inner))
            inner[at : at + 1] = rnd.choice([[], ["x"], [inner[at], "q"]])
        text = " ".join(words(30, trial)) + " " + "".join(inner) + " " + " ".join(words(30, trial + 1000))
        x = decontaminate.normal(text)
        best = levenshtein_inside(known.items[0].tolist(), x.tolist())
        assert [m[1] for m in known.matches(text)] == ([best] if best <= known.edits[0] else [])


def test_bpe_against_library(docs, empty, texts):
    library = Tokenizer.from_file(VOCABULARY)
    got = as_rows(bpe_transducer.encode(docs, VOCABULARY, digests=True))
    expected = Counter()
    for r in texts:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((g["doc_id"], g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got) == expected
    full = {r["doc_id"]: r for r in as_rows(bpe_transducer.encode(docs, VOCABULARY))}
    assert full[160]["decoded"] == texts[-1][1] and full[160]["ids"] == library.encode(texts[-1][1], add_special_tokens=False).ids
    assert bpe_transducer.encode(empty, VOCABULARY, digests=True).count() == 0


def test_automaton_is_minimal_and_ranks():
    raw = sorted({w.encode() for w in ["walking", "walk", "walked", "talking", "talk", "talked", "a", "ab"]})
    found = bpe_transducer.minimal_automaton(raw)
    lexicon = bpe_transducer.Lexicon.compile(bpe_transducer.Vocabulary(VOCABULARY), [w.decode() for w in raw])
    assert lexicon.ranks([*raw, b"wal", b"", b"talkin", b"zz"]).tolist() == [*range(len(raw)), -1, -1, -1, -1]
    trie = len({w[:i] for w in raw for i in range(len(w) + 1)})
    assert len(found["final"]) < trie


def test_token_counts_follow_edits(spark, docs, empty, texts):
    library = Tokenizer.from_file(VOCABULARY)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = {g["doc_id"]: g for g in as_rows(token_counts.edited_counts(docs, VOCABULARY))}
    for r in texts:
        edits = token_counts.cleaning_edits(r[1] or "")
        assert (got[r[0]]["n_edits"], got[r[0]]["n_tokens"], got[r[0]]["n_tokens_edited"]) == (len(edits), count(r[1] or ""), count(token_counts.apply_edits(r[1] or "", edits)))
    assert got[160]["n_edits"] == 3
    assert token_counts.edited_counts(empty, VOCABULARY).count() == 0
    coder = bpe_transducer.Encoder(bpe_transducer.Lexicon.compile(bpe_transducer.Vocabulary(VOCABULARY), ["alpha1"]))
    rnd = random.Random(5)
    for trial in range(150):
        text = "".join(rnd.choice(["a", " ", "  ", "\n", "1", "'s", "é", "!", "word", " the"]) for _ in range(rnd.randrange(0, 400)))
        at = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        edits = [(at[i], at[i + 1], rnd.choice(["", " ", "x", "\n\n", "'ll", "99"])) for i in range(0, len(at) - 1, 2)]
        assert token_counts.counts_after(text, edits, coder)[:2] == (count(text), count(token_counts.apply_edits(text, edits)))
    given = spark.createDataFrame([(1, "hello world", [(0, 5, "goodbye")]), (2, "x", None), (3, None, [])], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    assert {g["doc_id"]: g["n_tokens_edited"] for g in as_rows(token_counts.edited_counts(given, VOCABULARY, edits_col="edits"))} == {1: count("goodbye world"), 2: 1, 3: 0}


def test_trees_saved_and_taken_up_again():
    library = Tokenizer.from_file(VOCABULARY)
    coder = bpe_transducer.Encoder(bpe_transducer.Lexicon.compile(bpe_transducer.Vocabulary(VOCABULARY), ["alpha1"]))
    tree = token_counts.PretokenTree(" ".join(words(900, 77)), coder)
    tree.replace(100, 140, "something else entirely")
    again = token_counts.PretokenTree(tree.text, coder, state=tree.state())
    again.replace(2000, 2000, "  \n")
    assert again.tokens == len(library.encode(again.text, add_special_tokens=False).ids)
    assert again.reencoded < 300


def test_long_pretokens_merge_as_in_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    lexicon = bpe_transducer.Lexicon.compile(bpe_transducer.Vocabulary(VOCABULARY), [])
    rnd = random.Random(6)
    raw = ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (511, 512, 3000)] + ["a" * 4001, "short"]
    counts, ids = lexicon.merge([w.encode() for w in raw])
    expected = [library.encode(w, add_special_tokens=False).ids for w in raw]
    assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]


def test_word_hashes_and_sets_equal_plain_python():
    import pyarrow as pa

    from bindframe.llm import _common

    raw = ["", " ", "One two\tthree", "one TWO three\x0b\nfour", "x" * 700_000 + " y", "one", "ÄÖ äö ÄÖ"]
    found = _common.Words(pa.array(raw).slice(1))
    plain = [w for t in raw[1:] for w in t.encode().lower().split()]
    assert found.sizes.tolist() == [len(t.encode().split()) for t in raw[1:]]
    by = dict(zip(plain, found.hashes.tolist()))
    assert [by[w] for w in plain] == found.hashes.tolist() and len(set(by.values())) == len(by)
    sets, sizes = _common.shingle_sets(found.hashes, found.first, found.sizes, 2)
    assert sizes.tolist() == [len({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else ()) for w in (t.encode().lower().split() for t in raw[1:])]
    assert (_common.sliding_min(np.array([5, 3, 9, 1, 7, 8, 6, 2]), 3) == [3, 1, 1, 1, 6, 2]).all()


def test_byte_network(spark, docs, empty, labels, texts):
    got = as_rows(quality_cnn.quality_scores(docs, labels))
    assert len(got) == len(texts) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7) for g in got)
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got if g["doc_id"] is not None)
    same = [g["score"] for g in got if g["doc_id"] in (130, 131)]
    assert same[0] == same[1]
    assert quality_cnn.quality_scores(empty, labels).count() == 0
    assert {g["score"] for g in as_rows(quality_cnn.quality_scores(docs, labels.limit(0)))} == {0.5}
    good = spark.createDataFrame([(i, " ".join(words(60, i)) if i % 2 else "### $$$ " * 50) for i in range(200)], "doc_id long, text string")
    truth = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    held = [g for g in as_rows(quality_cnn.quality_scores(good, truth)) if g["held_out"]]
    assert np.mean([g["predicted"] == g["doc_id"] % 2 for g in held]) > 0.95


def test_fit_sample_is_bounded_in_bytes(spark):
    from bindframe.llm._folds import labelled

    sizes = {i: 100 + 10 * (i % 7) for i in range(60)} | {60 + i: 900 for i in range(4)}
    table = spark.createDataFrame([(i, "x" * n) for i, n in sizes.items()], "doc_id int, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id int, quality int")
    whole = labelled(table, marks, "quality", 2, 4, 60).count()
    got = [len(r.text) for r in labelled(table, marks, "quality", 2, 4, 60, most_bytes=3200).collect()]
    assert max(got) <= 200 and 3200 - 160 < sum(got) <= 3200 and len(got) < whole
    assert labelled(table, marks, "quality", 2, 4, 60, most_bytes=1 << 20).count() == whole


def test_whole_text_scores_equal_direct_ones():
    net = quality_cnn.ByteNetwork(seed=1)
    for raw in (b"", b"x" * 119, b"y" * 121, bytes(range(256)) * 5):
        whole = quality_cnn.padded(raw) + b"\0" * (quality_cnn.HALF + quality_cnn.WIDTH)
        n = len(quality_cnn.padded(raw)) // quality_cnn.HALF
        chunks = np.array([np.frombuffer(whole[i * 128 : i * 128 + 264], np.uint8) for i in range(n)])
        act = np.maximum(net.pool(chunks)[0], 0)
        z = np.concatenate([act.mean(0), act.max(0)]) @ net.out + net.bias[0]
        got = quality_cnn.score_texts([b"before" * 50, raw, b"after" * 99], net, net.pair_tables())[1]
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-5
        cut = quality_cnn.chunks_of(raw)
        assert np.array_equal(np.frombuffer(cut, np.uint8).reshape(-1, 264), chunks)


def test_toxicity(spark, docs, empty, labels, texts):
    got = as_rows(toxicity.severity(docs, labels))
    assert len(got) == len(texts) and all(0 <= g["expected_severity"] <= 2 and abs(g["expected_severity"] - g["p_toxic"] - g["p_severe"]) < 1e-9 for g in got)
    assert toxicity.severity(empty, labels).count() == 0
    assert {g["expected_severity"] for g in as_rows(toxicity.severity(docs, labels.limit(0)))} == {0.0}
    rows = [(i, " ".join(words(60, i)) + (" vile" * (i % 4 == 0) + " foul rotten" * (i % 8 == 0))) for i in range(400)]
    truth = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    found = as_rows(toxicity.severity(spark.createDataFrame(rows, "doc_id long, text string"), truth))
    assert all(g["toxic"] == int(g["doc_id"] % 4 == 0) for g in found)
    assert np.mean([g["expected_severity"] for g in found if g["doc_id"] % 8 == 0]) > np.mean([g["expected_severity"] for g in found if g["doc_id"] % 8 == 4])


def test_language_model(docs, empty, texts):
    got = as_rows(attention_lm.score(docs, VOCABULARY, frequent=50))
    assert len(got) == len(texts)
    counts = Counter()
    for r in texts:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            counts.update([*attention_lm.words_of(r[1]), b""])
    total, distinct = sum(counts.values()), len(counts)
    of = {r[0]: [*attention_lm.words_of(r[1]), b""] for r in texts}
    for g in got:
        own = of[g["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(own), sum(w in counts for w in own), total)
        assert math.isclose(g["base_score"], sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert g["score"] < 0
    assert attention_lm.score(empty, VOCABULARY).count() == 0


def test_language_model_learns_from_all_training_texts(docs, texts, monkeypatch):
    seen, averaged = Counter(), attention_lm.averaged

    def counted(rows, learn, model):
        if rows.columns == ["text"]:
            seen.update(r.text for r in rows.collect())
        return averaged(rows, learn, model)

    monkeypatch.setattr(attention_lm, "averaged", counted)
    attention_lm.score(docs, VOCABULARY, frequent=50)
    assert seen == Counter(r[1] or "" for r in texts if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2)


def test_language_model_learns_from_all_training_words(spark, monkeypatch):
    """Every counted word is learnt from in one of the rounds, and rare words weigh as their counts."""
    rare, head = [f"w{i}x" for i in range(400)], {b"often": 100_000}
    counts = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(rare)] + [("often", 100_000), ("", 9)], "word string, count long").repartition(2)
    lexicon = bpe_transducer.Lexicon.compile(bpe_transducer.Vocabulary(VOCABULARY), [])
    name = bpe_transducer.distribute(lexicon, counts)
    known = attention_lm.encoded(counts, name, head).cache()
    own = np.arange(60_000)  # units that tell all ids apart
    learnt, seen = [Counter() for _ in range(attention_lm.ROUNDS)], []

    def gradient(self, first, last, target, scored, weight=None):
        for row, places, by in zip(first, scored, np.ones(len(first)) if weight is None else weight, strict=True):
            learnt[len(seen)][tuple(row[1 : places.nonzero()[0].max() + 1])] += by
        return np.zeros_like(self.flat)

    def averaged(rows, learn, model):
        list(learn(iter(rows.toArrow().combine_chunks().to_batches())))
        seen.append(rows.count())
        return model

    monkeypatch.setattr(attention_lm.AttentionModel, "gradient", gradient)
    monkeypatch.setattr(attention_lm, "averaged", averaged)
    tail = sum(1 + i % 3 for i in range(400))
    attention_lm.train_inside_words(known, name, own, np.ones(attention_lm.UNITS), head, tail)
    ids = {w: tuple(lexicon.ids_of([b" " + w.encode()])[1].tolist()) for w in [*rare, "often"]}
    assert all(len(ids[w]) <= attention_lm.INNER_WINDOW - 1 for w in rare)
    assert [sum(ids[w] in found for found in learnt) for w in rare] == [1] * 400
    for found in learnt:
        each = [(found[ids[w]], 1 + i % 3) for i, w in enumerate(rare) if ids[w] in found]
        assert np.allclose([by / n for by, n in each], each[0][0] / each[0][1])
    assert sum(seen) == 402


@pytest.mark.parametrize(("width", "overlap"), [(32, 8), (32, 0), (8, 4)])
def test_windows_score_each_target_once(width, overlap):
    sizes = np.array([0, 1, 31, 32, 33, 200])
    units = np.arange(sizes.sum())
    first, last, y, scored, owner = attention_lm.windows(units, units + 1000, sizes, width, overlap)
    assert np.bincount(owner, scored.sum(1)).tolist() == (sizes + 1).tolist()
    assert sorted(y[scored][y[scored] != attention_lm.END].tolist()) == units.tolist()
    seen = first[scored] != attention_lm.BEGIN
    assert (last[scored][seen] - first[scored][seen] == 1000).all() and (~seen).sum() == len(sizes)
    assert sorted(i for rows, w in attention_lm.by_width(scored, 2) for i in rows.tolist() if not scored[i, w:].any()) == list(range(len(scored)))


def test_model_gradient_causality_and_normalisation():
    rng = np.random.default_rng(0)
    model = attention_lm.AttentionModel()
    model.flat[:] = rng.normal(0, 0.2, len(model.flat))
    first, last, y = rng.integers(0, attention_lm.UNITS, (3, 2, attention_lm.WINDOW))
    scored = rng.random(first.shape) < 0.7
    g = model.gradient(first, last, y, scored)
    loss = lambda: -model.log10(first, last, y, scored).mean() * math.log(10)
    for at in np.argsort(-np.abs(g))[[0, 5, 50, 500]]:
        old = model.flat[at]
        model.flat[at] = old + 1e-2
        up = loss()
        model.flat[at] = old - 1e-2
        down = loss()
        model.flat[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4
    one = np.zeros_like(scored)
    one[0, 5] = True
    before = model.log10(first[:1], last[:1], y[:1], one[:1])[0]
    later = first[:1].copy()
    later[0, 6:] = 3
    assert abs(model.log10(later, last[:1], y[:1], one[:1])[0] - before) < 1e-5
    total = 0.0
    for unit in range(attention_lm.UNITS):
        y[0, 5] = unit
        total += 10 ** model.log10(first[:1], last[:1], y[:1], one[:1])[0]
    assert abs(total - 1) < 1e-3


def test_language_model_beats_counts_on_sequences(spark):
    """Words that always follow each other, and rare words from known parts, score above their counts."""
    rnd = random.Random(8)
    stems, ends = ["walk", "talk", "jump", "play", "work", "look"], ["ing", "ed", "er", "s"]
    rows = []
    for i in range(400):
        text = []
        while len(text) < 120:
            text += ["north", "south", "east", "west"] if rnd.random() < 0.5 else ["".join(rnd.choice(stems) for _ in range(3)) + rnd.choice(ends)]
        rows.append((i, " ".join(text)))
    got = as_rows(attention_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), VOCABULARY))
    held = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_language_model_merges_a_counted_word_once(spark):
    """Rounds of training and scoring take ids, units and scores of counted and frequent words as they were made; rare ones alone are merged."""
    vocabulary = bpe_transducer.Vocabulary(VOCABULARY)
    known = ["walking", "talked", "\u00fcbermut"]
    counts = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(known)] + [("", 9)], "word string, count long")
    lexicon = bpe_transducer.Lexicon.compile(vocabulary, [" " + w for w in known[:2]])
    name = bpe_transducer.distribute(lexicon, counts)
    got = {r["count"]: (r["tail"], r["ids"]) for r in attention_lm.encoded(counts, name, {b"walking": 5}).collect()}
    ids = [lexicon.ids_of([b" " + w.encode()])[1].tolist() for w in known]
    assert got == {5: (False, ids[0]), 6: (True, ids[1]), 7: (True, ids[2]), 9: (False, [])}
    first, inside = attention_lm.subword_counts(attention_lm.encoded(counts, name, {}), len(vocabulary.bytes_of))
    assert first.sum() == 5 + 6 + 7 and first[ids[2][0]] == 7 and inside.sum() == sum((5 + i) * (len(x) - 1) for i, x in enumerate(ids))

    own, share = attention_lm.units_of(first + inside)
    inner = attention_lm.AttentionModel()
    frequent = attention_lm.FrequentWords.of(counts, name, own, share, inner, 100)
    assert frequent.words == [w.encode() for w in known[::-1]] and np.allclose(frequent.terms, np.log10(np.array([8, 7, 6]) / 100))
    asked = []

    class Watched:
        def ids_of(self, words):
            asked.extend(words)
            return lexicon.ids_of(words)

    words = [w.encode() for w in [*known, "unseen", "walking", "unseen"]]
    plain, table = attention_lm.WordTable(lexicon, own, share, inner), attention_lm.WordTable(Watched(), own, share, inner, frequent, most=1)
    for _ in range(3):  # a memo that is over its limit begins anew with the frequent words
        at, other = plain.places(words), table.places([*words, "\u00df".encode(), b"b"])[: len(words)]
        assert np.array_equal(plain.first[at], table.first[other]) and np.array_equal(plain.last[at], table.last[other]) and np.allclose(plain.logs[at], table.logs[other], rtol=1e-5)
        assert np.isnan(table.terms[other]).tolist() == [False] * 3 + [True, False, True]
    assert asked == [b" unseen", " \u00df".encode(), b" b"] * 3


def test_merges_side_by_side_equal_the_heap(monkeypatch):
    """Blocks of any size give each word the ids that its own heap of pairs gives."""
    rnd = random.Random(4)
    lexicon = bpe_transducer.Lexicon.compile(bpe_transducer.Vocabulary(VOCABULARY), [])
    raw = [bytes(rnd.choice(b"aehinorst \xc3\xbc.,") for _ in range(rnd.randrange(1, 60))) for _ in range(300)] + [b"a" * n for n in (1, 2, 3, 33, 511, 512, 600)] + [b""]
    for cells in (1, 700, 200_000):
        monkeypatch.setattr(bpe_transducer, "STEP_CELLS", cells)
        counts, ids = lexicon.merge(raw)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [lexicon.merge_long(w).tolist() if w else [] for w in raw]
