"""Site calling inside a row: window codes, scores and sites as array expressions, so that a changed sequence can be called again at once.

A window of k bases has a code in base 4 (A, C, G, T are 0 to 3; other signs make it null), and
a table of 4^k scores is an array that the code is looked up in. Nothing is joined or exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
_SWAP = {"A": "T", "C": "G", "G": "C", "T": "A"}

#: Bases of a window up to which its 4^k scores are one table.
MOST_K = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_array(values: Sequence[float]) -> Column:
    """A literal array of doubles (one string that the optimizer turns into an array once)."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def digits(seq: Column) -> Column:
    """The ranks of a sequence's bases; null for other signs."""
    return F.transform(F.split(seq, ""), lambda c: F.nullif(F.expr("0") + F.instr(F.lit(BASES), c), F.lit(0)) - 1)


def window_codes(ranks: Column, k: int) -> Column:
    """The code of each window of k bases, in order; an empty array where the sequence is shorter. ranks should be a column, or a value of `let`."""
    code = lambda i: sum((F.get(ranks, i + j) * 4 ** (k - 1 - j) for j in range(1, k)), F.get(ranks, i) * 4 ** (k - 1))
    return F.when(F.size(ranks) >= k, F.transform(F.sequence(F.lit(0), F.size(ranks) - k), code)).otherwise(F.array().cast("array<int>"))


def letters_of_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of sequences, one after the other, and where each begins, with the end; another sign than ASCII counts as one N, null as empty."""
    plain = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), "[^\\x00-\\x7F]", "N")
    ends = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64) if len(plain) else np.zeros(1, np.int64)
    data = np.frombuffer(plain.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def texts_of(letters: np.ndarray) -> pa.Array:
    """The rows of a matrix of ASCII bytes as texts."""
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32) * np.int32(letters.shape[1])), pa.py_buffer(letters.tobytes()))


def windows_of_batch(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all windows of k bases of a batch of sequences, one after the other, -1 for windows with other signs, and how many windows each sequence has; null has none."""
    return windows_of_letters(*letters_of_batch(texts), k)


def windows_of_letters(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(256, -1, np.int64)
    rank[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(len(BASES))
    ranks = rank[data]
    sizes = np.maximum(np.diff(ends) - (k - 1), 0)
    # where each window starts in the letters of the batch
    first = np.repeat(ends[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    codes, right = np.zeros(len(first), np.int64), np.ones(len(first), bool)
    for j in range(k):
        at = ranks[first + j]
        codes = codes * len(BASES) + at
        right &= at >= 0
    return np.where(right, codes, -1), sizes


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


@dataclass(frozen=True)
class Caller:
    """A table of 4^k window scores; windows strictly above the threshold are sites."""

    k: int
    scores: tuple[float, ...]
    above: float

    def __post_init__(self) -> None:
        if not 1 <= self.k <= MOST_K or len(self.scores) != 4**self.k:
            raise ValueError(f"a table of 4^k scores is needed, k up to {MOST_K}")

    def table(self) -> Column:
        return number_array(self.scores)

    def score(self, code: Column) -> Column:
        return F.get(self.table(), code)

    def sites(self, codes: Column) -> Column:
        """Where the windows start that are sites, in order."""
        hit = F.transform(codes, lambda c, i: F.when(self.score(c) > self.above, i))
        return F.filter(hit, lambda x: x.isNotNull())

    def codes_of(self, seq: Column) -> Column:
        return let(digits(seq), lambda d: window_codes(d, self.k))

    def sites_on_batches(self, seq: Column) -> Column:
        """As `sites_of`, by numpy on batches of rows; not for the inside of lambdas."""
        k, scores, above = self.k, np.array(self.scores), self.above

        @F.arrow_udf("array<int>")
        def sites(texts: pa.Array) -> pa.Array:
            codes, sizes = windows_of_batch(texts, k)
            hit = (codes >= 0) & (scores[codes] > above)
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            start = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[hit]
            return pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=len(sizes))), pa.array(start, pa.int32()))

        return sites(seq)

    def scores_on_batches(self, seq: Column) -> Column:
        """The score of each window in order, null for windows with other signs than bases, by numpy on batches of rows; not for the inside of lambdas."""
        k, scores = self.k, np.array(self.scores)

        @F.arrow_udf("array<double>")
        def found(texts: pa.Array) -> pa.Array:
            codes, sizes = windows_of_batch(texts, k)
            return pa.ListArray.from_arrays(_offsets(sizes), pa.array(scores[codes], pa.float64(), mask=codes < 0))

        return found(seq)

    def regions_on_batches(self, seq: Column, gap: int) -> Column:
        """K3's regions of high windows, (begin, end, n) as `regions` in the site operators has them with its centre at 0, by numpy on batches of rows; not for the inside of lambdas."""
        k, scores, above = self.k, np.array(self.scores), self.above

        @F.arrow_udf("array<struct<begin:int,end:int,n:int>>")
        def found(texts: pa.Array) -> pa.Array:
            codes, sizes = windows_of_batch(texts, k)
            begin = np.cumsum(sizes) - sizes
            high = np.flatnonzero((codes >= 0) & (scores[codes] > above))
            row = np.searchsorted(np.cumsum(sizes), high, side="right")
            first = np.ones(len(high), bool)
            first[1:] = (row[1:] != row[:-1]) | (high[1:] - high[:-1] > gap + 1)
            runs = np.flatnonzero(first)
            n = np.diff(np.append(runs, len(high)))
            start, last, row = high[runs], high[runs + n - 1], row[runs]
            # low windows behind each run, to the next one or the sequence's end
            end = begin[row] + sizes[row]
            if len(runs):
                same = row[1:] == row[:-1]
                end[:-1][same] = start[1:][same]
            low = end - 1 - last
            size = n + np.where(low > gap, gap, np.maximum(low - 1, 0))
            kept = n >= 2
            at = (start - begin[row])[kept]
            each = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (at, at + size[kept], n[kept])], ["begin", "end", "n"])
            return pa.ListArray.from_arrays(_offsets(np.bincount(row[kept], minlength=len(sizes))), each)

        return found(seq)

    def best_on_batches(self, seq: Column, low: Column, high: Column) -> Column:
        """(start, score) of the best window that starts from low to high, ties the first; null without one. By numpy on batches of rows."""
        k, scores = self.k, np.array(self.scores)

        @F.arrow_udf("struct<start:int,score:double>")
        def found(texts: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
            codes, sizes = windows_of_batch(texts, k)
            number = lambda x, empty: pc.fill_null(x.cast(pa.int64()), empty).to_numpy(zero_copy_only=False)
            lo, hi = np.maximum(number(lows, 0), 0), np.minimum(number(highs, -1), sizes - 1)
            some = np.flatnonzero(hi >= lo)
            width = (hi - lo + 1)[some]
            ahead = np.cumsum(width) - width
            start = np.repeat(lo[some] - ahead, width) + np.arange(width.sum())
            at = np.repeat((np.cumsum(sizes) - sizes)[some], width) + start
            value = np.where(codes[at] >= 0, scores[codes[at]], -np.inf)
            best, place, out = np.full(len(sizes), -np.inf), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
            if len(some):
                best[some] = np.maximum.reduceat(value, ahead)
                held = np.flatnonzero((codes[at] >= 0) & (value == np.repeat(best[some], width)))
                rows, first = np.unique(np.repeat(some, width)[held], return_index=True)
                place[rows], out[rows] = start[held[first]], True
            return pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(best)], ["start", "score"], mask=pa.array(~out))

        return found(seq, low, high)

    def weakest_change(self, seq: Column, target: Column, low: Column, high: Column, allowed: Column, change: float | None) -> Column:
        """4 * position + rank of the single-base change of I9 that takes the site at target away, or null; see `abolish_core`. On batches of rows."""
        k, scores, above = self.k, np.array(self.scores), self.above

        @F.arrow_udf("int")
        def found(texts: pa.Array, targets: pa.Array, lows: pa.Array, highs: pa.Array, alloweds: pa.Array) -> pa.Array:
            codes, sizes = windows_of_batch(texts, k)
            begin = np.cumsum(sizes) - sizes
            site = (codes >= 0) & (scores[codes] > above)
            number = lambda x: pc.fill_null(x.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            t = number(targets)
            rows = np.flatnonzero((t >= 0) & (t < sizes) & pc.is_valid(lows).to_numpy(zero_copy_only=False) & pc.is_valid(highs).to_numpy(zero_copy_only=False))
            rows = rows[site[begin[rows] + t[rows]]]
            free = np.zeros(len(codes), bool)
            parents, places = pc.list_parent_indices(alloweds).to_numpy(zero_copy_only=False), number(pc.list_flatten(alloweds))
            inside = (places >= 0) & (places < sizes[parents])
            free[begin[parents[inside]] + places[inside]] = True
            t, lo, hi, size, begin = t[rows], number(lows)[rows], number(highs)[rows], sizes[rows], begin[rows]
            own = codes[begin + t]
            least, best = np.full(len(rows), np.inf), np.full(len(rows), -1)
            for j in range(k):
                p, weight = t + j, 4 ** (k - 1 - j)
                for b in range(4):
                    delta = b - own // weight % 4
                    after = scores[own + delta * weight]
                    good = (after < scores[own]) & (after < least) & (p >= lo) & (p < hi)
                    # only windows over the position change
                    for back in range(k):
                        if back == j:
                            continue
                        w = p - back
                        there = (w >= 0) & (w < size)
                        at = begin + np.where(there, w, 0)
                        there &= codes[at] >= 0
                        new = scores[np.where(there, codes[at] + delta * 4 ** (k - 1 - back), 0)]
                        was, now, kept = there & site[at], there & (new > above), ~free[at]
                        good &= ~(now & ~was) & ~(was & ~now & kept)
                        if change is not None:
                            good &= ~(was & kept & (np.abs(new - scores[codes[at]]) > change))
                    least, best = np.where(good, after, least), np.where(good, 4 * p + b, best)
            out = np.full(len(sizes), -1)
            out[rows] = np.where(least <= above, best, -1)
            return pa.array(out, pa.int32(), mask=out < 0)

        return found(seq, target, low, high, allowed)

    def two_on_batches(self, seq: Column, original: Column, tolerance: float = 1e-9) -> Column:
        """(pos_1, pos_2, score_1, score_2) of a sequence's two sites, null if it has another number of them; by numpy on batches of rows.

        Where an original is given, it must have the same two sites, and one of their scores at most may differ by more than the tolerance.
        """
        k, scores, above = self.k, np.array(self.scores), self.above

        def pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes, sizes = windows_of_batch(texts, k)
            hits = np.flatnonzero((codes >= 0) & (scores[codes] > above))
            row = np.searchsorted(np.cumsum(sizes), hits, side="right")
            two = np.bincount(row, minlength=len(sizes)) == 2
            hits = hits[two[row]].reshape(-1, 2)
            place, value = np.zeros((len(sizes), 2), np.int64), np.zeros((len(sizes), 2))
            place[two], value[two] = hits - (np.cumsum(sizes) - sizes)[two, None], scores[codes[hits]]
            return two, place, value

        @F.arrow_udf("struct<pos_1:int,pos_2:int,score_1:double,score_2:double>")
        def found(texts: pa.Array, originals: pa.Array) -> pa.Array:
            two, place, value = pairs(texts)
            given = np.flatnonzero(two & pc.is_valid(originals).to_numpy(zero_copy_only=False))
            if len(given):
                # the originals of many rows are the same
                coded = originals.take(pa.array(given)).dictionary_encode()
                own = coded.indices.to_numpy()
                was, at, past = (x[own] for x in pairs(coded.dictionary))
                moved = (np.abs(value[given] - past) > tolerance).sum(1)
                two[given] = was & (at == place[given]).all(1) & (moved <= 1)
            columns = [*(pa.array(place[:, i], pa.int32()) for i in (0, 1)), *(pa.array(value[:, i]) for i in (0, 1))]
            return pa.StructArray.from_arrays(columns, ["pos_1", "pos_2", "score_1", "score_2"], mask=pa.array(~two))

        return found(seq, original)

    def sites_of(self, seq: Column) -> Column:
        return let(self.codes_of(seq), self.sites)


def added_weights(rows: Sequence[dict[str, float]], kmer: Sequence[str]) -> float:
    """The weights of a k-mer's bases, added from the left as SQL does (sum() would round otherwise)."""
    return reduce(add, (float(row[b]) for row, b in zip(rows, kmer, strict=True)), 0.0)


def matrix_caller(rows: Sequence[dict[str, float]], above: float) -> Caller:
    """A caller by the better strand of a weight matrix, the weights summed."""
    back = [{_SWAP[b]: w for b, w in row.items()} for row in reversed(rows)]
    return Caller(len(rows), tuple(max(added_weights(rows, kmer), added_weights(back, kmer)) for kmer in product(BASES, repeat=len(rows))), above)


def with_base(seq: Column, position: Column, rank: Column) -> Column:
    """seq with the base of one position (from 0) replaced by the one of a rank."""
    return F.concat(F.substring(seq, F.lit(1), position), F.substring(F.lit(BASES), rank + 1, F.lit(1)), F.substring(seq, position + 2, F.length(seq)))
