"""Grouping of spelling variants: words one edit apart, and each word's much more frequent form.

Words are counted over all texts, and the frequent ones form a sorted vocabulary. Two words of
one edit share the first half of the shorter one or its last half, so each word goes to the lists
of its halves (and, as the longer one, of the halves of words one shorter); the lists of last
halves hold the words backwards. In a sorted list all words with a common beginning stand
together: a banded edit matrix of three diagonals is worked out once for the beginning, its last
row is used again for every word behind it (the LCPs of neighbours say where a new row is
needed), and a range whose beginning already has more than one edit is skipped whole. All
(word, range) rows of a chunk of words are advanced together as arrays.

A list with more words than LIST_WORDS is dealt into blocks by hash, and each block searched with
each: exact, in bounded memory, at a cost that grows with the square of such a list.

Defined results: a null text has no words; a null id counts as empty text in the checksum;
repeated rows count each; an empty table, or one without frequent words, gives an empty result;
other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import bounded_batches, pieces, release, small_side, spread, stash, text_or_empty

#: Letters of a word, in texts whose A-Z are lower-cased.
LETTERS = re.compile("[a-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")

#: Code points of a word, and its occurrences, at least.
MIN_LENGTH, MIN_COUNT = 6, 5
#: One code point is deleted from a run where this divides its checksum.
FAULT_EVERY = 199
#: A form is so many times as frequent as its variant, at least.
FORM_RATIO = 5

#: Words of a list that one task searches, and words that it searches them with at a time.
LIST_WORDS, CHUNK = 32_768, 16_384
#: Distinct words that a task holds while it counts, and characters of a text that it splits at a time.
HELD_WORDS, SPAN = 200_000, 1 << 20


def lowered(text: str) -> str:
    """text with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def runs_of_letters(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of letters of a text, in lists for spans that end where no run goes on."""
    begin = 0
    while begin < len(text):
        end = begin + SPAN
        if end < len(text):
            stop = NO_LETTER.search(text, end)
            end = stop.start() if stop else len(text)
        yield LETTERS.findall(lowered(text[begin:end]))
        begin = end


def damaged(run: str, seed: int) -> str:
    """The run, without one code point where FAULT_EVERY divides the checksum that goes on from seed."""
    h = zlib.crc32(run.encode("utf-8"), seed)
    if h % FAULT_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all whole texts, after one deletion in some runs, that are long and frequent enough."""
    slim = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in pieces(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc}:".encode("utf-8", "surrogatepass"))
                for span in runs_of_letters(text):
                    for word, n in Counter(x for x in span if len(x) >= min_length).items():
                        word = damaged(word, seed)
                        if len(word) >= min_length:
                            held[word] += n
            if len(held) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        release()

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Ranges:
    """The ranges of equal beginnings of a sorted list of distinct words, from the depth that all words of a group share.

    Words are rows of latin-1 bytes; a group is a run of words that share their first `half` bytes.
    """

    def __init__(self, words: list[bytes], half: np.ndarray, group: np.ndarray):
        self.at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=self.at[1:])
        self.data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        self.size = np.diff(self.at)
        new = np.ones(len(words), bool)
        new[1:] = group[1:] != group[:-1]
        lcp = half.copy()
        for i in range(1, len(words)):
            if not new[i]:
                a, b, k = words[i - 1], words[i], int(half[i])
                most = min(len(a), len(b))
                while k < most and a[k] == b[k]:
                    k += 1
                lcp[i] = k
        # a range of depth d begins at word i for each d with lcp[i] < d <= size[i]
        counts = self.size - lcp
        owner = np.repeat(np.arange(len(words)), counts)
        depth = spread(lcp + 1, counts)
        order = np.lexsort((owner, depth))
        self.owner, self.stride = owner[order], len(words) + 1
        self.key = depth[order] * self.stride + self.owner

    def char(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.data[self.at[word] + place]


def near_pairs(words: list[bytes], half: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of its range [first, last)) one edit apart, as two arrays of indices; both share their first half[first] bytes.

    words are sorted and distinct inside a group. Every entry is a query, a range of words with a
    common beginning of `depth` bytes, and the three values D[depth][depth-1 .. depth+1] of the
    matrix between the beginning and the query, where 2 stands for more than one edit.
    """
    ranges = Ranges(words, half, group)
    q_at = np.zeros(len(queries) + 1, np.int64)
    np.cumsum([len(w) for w in queries], out=q_at[1:])
    q_data = np.frombuffer(b"".join(queries) + b"\0\0\0", np.uint8)
    q_size = np.diff(q_at)
    found_q, found_w = [], []
    for start in range(0, len(queries), CHUNK):
        q = np.arange(start, min(start + CHUNK, len(queries)))
        low, high = first[q], last[q]
        some = low < high
        q, low, high = q[some], low[some], high[some]
        depth = half[low]
        below, same, above = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.where(q_size[q] > depth, 1, 2).astype(np.int8)
        while len(q):
            # a word that ends here is the first of its range, and is done
            ends = ranges.size[low] == depth
            gap = q_size[q] - depth
            value = np.where(gap == -1, below, np.where(gap == 0, same, np.where(gap == 1, above, 2)))
            hit = ends & (value == 1)
            found_q.append(q[hit])
            found_w.append(low[hit])
            begin = low + ends
            # the ranges of one byte more
            k0 = np.searchsorted(ranges.key, (depth + 1) * ranges.stride + begin)
            k1 = np.searchsorted(ranges.key, (depth + 1) * ranges.stride + high)
            counts = np.where(begin < high, k1 - k0, 0)
            parent = np.repeat(np.arange(len(q)), counts)
            child = spread(k0, counts)
            low2 = ranges.owner[child]
            final = np.cumsum(counts) - 1
            high2 = np.empty(len(child), np.int64)
            high2[:-1] = low2[1:]
            high2[final[counts > 0]] = high[counts > 0]
            q, depth, below, same, above = q[parent], depth[parent], below[parent], same[parent], above[parent]
            char = ranges.char(low2, depth)
            base, size = q_at[q] + depth, q_size[q]
            before = np.where(depth > 0, q_data[np.maximum(base - 1, 0)], 0)
            n0 = np.minimum(below + (before != char), same + 1)
            n1 = np.where(size > depth, np.minimum(np.minimum(same + (q_data[base] != char), above + 1), n0 + 1), 2)
            n2 = np.where(size > depth + 1, np.minimum(above + (q_data[np.minimum(base + 1, len(q_data) - 1)] != char), n1 + 1), 2)
            alive = np.flatnonzero(np.minimum(np.minimum(n0, n1), n2) <= 1)
            cap = lambda x: np.minimum(x[alive], 2).astype(np.int8)
            q, depth, low, high, below, same, above = q[alive], depth[alive] + 1, low2[alive], high2[alive], cap(n0), cap(n1), cap(n2)
    return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_w or [np.zeros(0, np.int64)])


def _halves(words: DataFrame, list_words: int) -> DataFrame:
    """A row for each list that a word goes to: (list, kind, spelled, n, asks, listed); kind is twice the shorter length, plus 1 where words are backwards."""
    length = F.length("word")
    shorter = F.explode(F.array(length, length - 1)).alias("m")
    each = words.select("word", "n", length.alias("length"), shorter)
    side = each.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
    h = F.expr("m div 2")
    spelled = F.when(F.col("back") == 1, F.reverse("word")).otherwise(F.col("word"))
    kept = F.when(F.col("back") == 1, F.col("m") - h).otherwise(h)
    rows = side.select(spelled.alias("spelled"), "n", (F.col("m") * 2 + F.col("back")).alias("kind"), (F.col("length") == F.col("m")).alias("asks"), kept.alias("_kept"))
    keyed = stash(rows.withColumn("list", F.xxhash64("kind", F.expr("substring(spelled, 1, _kept)"))).drop("_kept"))
    large = keyed.groupBy("list").agg(F.count("*").alias("_n")).where(F.col("_n") > list_words)
    large = small_side(stash(large.select(F.col("list").alias("_list"), F.ceil(F.col("_n") / list_words).cast("int").alias("_blocks"))))
    placed = keyed.join(large, F.col("list") == F.col("_list"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.hash("spelled"), F.col("_blocks"))
    # a large list becomes squares: the words of block a ask those of block b
    asking = F.when(F.col("asks"), F.expr("transform(sequence(0, _blocks - 1), x -> struct(_own as a, x as b, true as asks, x = _own as listed))"))
    hearing = F.expr("transform(sequence(0, _blocks - 1), x -> struct(x as a, _own as b, false as asks, true as listed))")
    both = F.when(F.col("asks"), F.concat(asking, F.expr("filter(transform(sequence(0, _blocks - 1), x -> struct(x as a, _own as b, false as asks, true as listed)), s -> s.a <> s.b)"))).otherwise(hearing)
    each = placed.withColumn("_own", own).withColumn("_square", F.explode(both))
    number = F.when(F.col("_blocks") == 1, F.col("list")).otherwise(F.xxhash64("list", "_square.a", "_square.b"))
    return each.select(number.alias("list"), "kind", "spelled", "n", "_square.asks", "_square.listed")


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """words(word, n), distinct, of code points up to U+00FF and two or more of them -> (word, other, other_n): all ordered pairs one inserted, deleted or replaced code point apart."""
    lists = bounded_batches(_halves(words, list_words))
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(rows: pa.Table) -> pa.RecordBatch:
        kind = rows.column("kind").to_numpy()
        text = [w.encode("latin-1") for w in rows.column("spelled").to_pylist()]
        counts, asks, listed = rows.column("n").to_numpy(), rows.column("asks").to_numpy(), rows.column("listed").to_numpy()
        half = np.where(kind % 2 == 1, kind // 2 - kind // 4, kind // 4).astype(np.int64)
        # rows come sorted by (list, kind, word): a group is what shares its list, kind and half, whatever its hash is
        key = rows.column("list").to_numpy()
        new = np.ones(len(text), bool)
        for i in range(1, len(text)):
            new[i] = key[i] != key[i - 1] or kind[i] != kind[i - 1] or text[i][: half[i]] != text[i - 1][: half[i]]
        group = np.cumsum(new) - 1
        ours, theirs = np.flatnonzero(listed), np.flatnonzero(asks)
        if not len(ours) or not len(theirs):
            return _pairs([], [], [])
        edge_low, edge_high = np.searchsorted(group[ours], group[theirs], side="left"), np.searchsorted(group[ours], group[theirs], side="right")
        a, b = near_pairs([text[i] for i in ours], half[ours], group[ours], edge_low, edge_high, [text[i] for i in theirs])
        a, b = theirs[a], ours[b]
        one, two, twos = [], [], []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = text[i], text[j]
            if kind[i] % 2:
                x, y = x[::-1], y[::-1]
                h = int(kind[i]) // 4
                if x[:h] == y[:h]:
                    continue  # met among the first halves
            one.append(x.decode("latin-1"))
            two.append(y.decode("latin-1"))
            twos.append(int(counts[j]))
            if len(x) != len(y):  # the longer word asks nothing here
                one.append(two[-1])
                two.append(one[-2])
                twos.append(int(counts[i]))
        return _pairs(one, two, twos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows > 2 * LIST_WORDS:
                table = pa.Table.from_batches(held)
                keys = table.column("list").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
                if whole:
                    yield found(table.slice(0, whole).combine_chunks())
                held, rows = table.slice(whole).to_batches(), len(keys) - whole
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())
        release()

    dealt = lists.repartition(n, "list").sortWithinPartitions("list", "kind", "spelled")
    return dealt.mapInArrow(run, "word string, other string, other_n long")


def _pairs(one: list[str], two: list[str], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(counts, pa.int64())], names=["word", "other", "other_n"])


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """forms(word, form) without circles -> (word, root): where following forms ends, by doubling; words with a form only."""
    now = stash(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        now = stash(now.join(small_side(ahead), F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_at").isNotNull().alias("_moved")))
        if not now.where("_moved").limit(1).count():
            return now.drop("_moved")
        now = now.drop("_moved")
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every frequent word; its form is the most frequent near word, the least of equals, if that is `ratio` times as frequent."""
    words = stash(vocabulary(docs, id_col, text_col, min_length, min_count))
    near = near_words(words, list_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    near = near.select(F.col("word").alias("_word"), "n_near", F.col("best.other").alias("other"), (-F.col("best.m")).alias("other_n"))
    formed = F.col("other_n") >= ratio * F.col("n")
    judged = stash(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n")))
    ends = roots(judged.where("form is not null")).select(F.col("word").alias("_word"), "root")
    return judged.join(small_side(stash(ends)), F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
