"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are read as characters, lower case, with every run of other signs as
one blank. An item of m characters within k edits of a region shares at least m + 1 - q - k*q
q-grams with it, on diagonals (position in the text minus position in the item) that differ by
at most k. Shared q-grams are counted in bands of diagonals that overlap by half, regions that
reach the bound are kept, and those are verified by banded alignment.

The benchmark goes to the tasks in blocks of at most `block_chars` characters (one pass over
the documents for each block), so what is sent never grows beyond that bound and one item.

Defined results: a null text or item matches nothing; an item of at most q characters, which has no q-gram
to spare, matches a text that is nothing but the item; where the bound would fall below one shared q-gram the edit budget is lowered
until it does not; repeated rows of an id give one row a pair; an empty table gives an empty
result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import BROADCAST_ROWS_BY_TEXTS, bounded_batches, mix, pieces, small_side, stash, text_or_empty

Q = 10
#: Edits allowed for each hundred characters of an item.
EDIT_PERCENT = 7
#: Characters of the benchmark that a pass sends to every task, at most.
BLOCK_CHARS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_SIZE = 0x3000


def _as_it_counts(code: int) -> int:
    c = chr(code)
    return (ord(c.lower()) if len(c.lower()) == 1 else code) if c.isalnum() else 32


def _table() -> np.ndarray:
    """Character codes as they count: lower case, 32 for what is no letter or digit."""
    return np.array([_as_it_counts(code) for code in range(_TABLE_SIZE)], np.uint32)


_CODES = _table()


def normal(text: str | None) -> np.ndarray:
    """The characters that count, as codes."""
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    high = x >= _TABLE_SIZE
    x = np.where(high, x, _CODES[np.minimum(x, _TABLE_SIZE - 1)])
    if high.any():
        found, at = np.unique(x[high], return_inverse=True)
        x[high] = np.array([_as_it_counts(c) for c in found.tolist()], np.uint32)[at]
    if not len(x):
        return x
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = x[keep]
    return x[int(x[0] == 32) : len(x) - int(len(x) > 1 and x[-1] == 32)]


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = x.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * _BASE + x[j : j + n]
    return mix(h)


class Benchmark:
    """A block of items: their q-grams with places, and the bounds of each item."""

    def __init__(self, ids: list, texts: list[str | None], q: int, percent: int):
        self.q = q
        self.ids, self.items, self.short = [], [], {}
        for i, text in zip(ids, texts, strict=True):
            x = normal(text)
            if len(x) > q:
                self.ids.append(i)
                self.items.append(x)
            elif len(x):
                self.short.setdefault(x.tobytes(), []).append((i, len(x)))
        m = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.minimum(m * percent // 100, (m - q) // q)
        self.shared = m + 1 - q - self.edits * q
        self.sizes = m
        codes = [grams(x, q) for x in self.items]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        self.item, self.place = item[order], place[order]
        self.bits = max(16, int(len(self.codes)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.codes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        # a region of any item covers at most `parts` windows, one of which holds its share of the bound
        self.window = int((m + self.edits).min(initial=1 << 30))
        parts = -(-(m + self.edits) // self.window) if len(m) else m
        self.least = int((-(-self.shared // np.maximum(parts, 1))).min(initial=1))
        self.reach = int((m + 2 * self.edits).max(initial=0))

    def candidates(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the regions that reach the bound."""
        codes = grams(x, self.q)
        if not len(codes) or not len(self.codes):
            return []
        at = np.flatnonzero(self.seen[(codes >> np.uint64(64 - self.bits)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        good = self.codes[where] == codes[at]
        at, where = at[good], where[good]
        if len(at) < self.least:
            return []
        # dense stretches: `least` hits within one window; only hits near one can be in a region
        last = at[self.least - 1 :] - at[: len(at) - self.least + 1] < self.window
        if not last.any():
            return []
        marks = np.zeros(len(codes) + 1, np.int64)
        starts = at[: len(last)][last]
        np.add.at(marks, np.maximum(starts - self.reach, 0), 1)
        np.add.at(marks, np.minimum(starts + self.window + self.reach, len(codes)), -1)
        near = np.cumsum(marks)[at] > 0
        at, where = at[near], where[near]
        counts = self.first[where + 1] - self.first[where]
        ends = np.cumsum(counts)
        posting = np.arange(ends[-1]) + np.repeat(self.first[where] - ends + counts, counts)
        item = self.item[posting]
        diagonal = np.repeat(at, counts) - self.place[posting]
        # bands twice as wide as the budget, half over each other: diagonals within k of each other share one
        wide = self.edits[item] + 1
        band = (diagonal + self.reach) // wide
        key = np.concatenate([item * (1 << 40) + band, item * (1 << 40) + band - 1])
        place = np.concatenate([self.place[posting]] * 2)
        # a place of the item counts once in a band
        keys, group = np.unique(key, return_inverse=True)
        once = np.unique(group * self.reach + place) // self.reach
        count = np.bincount(once, minlength=len(keys))
        out = []
        for k, n in zip(keys.tolist(), count.tolist(), strict=True):
            i = (k + (1 << 20)) >> 40
            b = k - (i << 40)
            if n >= self.shared[i]:
                w = int(self.edits[i]) + 1
                out.append((i, b * w - self.reach, (b + 2) * w - 1 - self.reach))
        return out

    def align(self, x: np.ndarray, item: int, low: int, high: int) -> tuple[int, int]:
        """(edits, end in the text) of the best alignment of the whole item to a region on these diagonals."""
        pattern, k = self.items[item], int(self.edits[item])
        m, width = len(pattern), high - low + 1 + 2 * k
        base = low - k
        text = np.full(m + width, 0xFFFFFFFF, np.uint32)
        a, b = max(base, 0), min(base + m + width, len(x))
        if a < b:
            text[a - base : b - base] = x[a:b]
        steps = np.arange(width)
        row = np.zeros(width, np.int64)
        for i in range(m):
            new = row + (text[i : i + width] != pattern[i])
            # leaving out a character of the item comes from the next diagonal, putting one in from the one before
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        end = int(row.argmin())
        return int(row[end]), base + end + m

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) for each item that occurs in the text; places count normal characters."""
        x = normal(text)
        best: dict[int, tuple[int, int]] = {}
        for item, low, high in self.candidates(x):
            edits, end = self.align(x, item, low, high)
            if edits <= self.edits[item] and (item not in best or edits < best[item][0]):
                best[item] = (edits, end)
        return [(i, e, max(0, end - int(self.sizes[i])), end) for i, (e, end) in sorted(best.items())]

    def alone(self, text: str | None) -> list[tuple]:
        """(id, characters) of the items of at most q characters that are all of a text: inside longer texts they prove nothing."""
        return self.short.get(normal(text).tobytes(), []) if self.short and text else []


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items dealt by a hash into blocks of about so many characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * total // block_chars) if total > block_chars else 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


_KNOWN: dict[str, Benchmark] = {}


def _known(name: str, ids: list, texts: list[str | None], q: int, percent: int) -> Benchmark:
    """A block's tables, made once in each Python worker."""
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = Benchmark(ids, texts, q, percent)
    return _KNOWN[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, percent: int = EDIT_PERCENT, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end): the items that occur in a document, with the best place of each."""
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kinds = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, edits int, start int, end int"
    out = None
    for block in _blocks(items, block_chars):
        rows = block.toArrow()
        item_type = rows.schema.field("item_id").type
        sent = slim.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, item_type=item_type) -> Iterator[pa.RecordBatch]:
            known = _known(*sent.value, q, percent)
            for part in pieces(batches, "text"):
                found, at = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for item, edits, start, end in known.matches(text):
                        found.append((known.ids[item], edits, start, end))
                        at.append(i)
                    for item, size in known.alone(text):
                        found.append((item, 0, 0, size))
                        at.append(i)
                columns = list(zip(*found, strict=True)) or [()] * 4
                arrays = [pa.array(columns[0], item_type), *(pa.array(c, pa.int32()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *arrays], names=["doc_id", "item_id", "edits", "start", "end"])

        part = slim.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("best")).select("doc_id", "item_id", "best.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item occurs."""
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = stash(found.select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(small_side(bad, BROADCAST_ROWS_BY_TEXTS), docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
