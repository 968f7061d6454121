"""Likeness of texts by matching blocks, on arrays of pairs."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np

#: Characters that a bit each stands for, at most, and pairs that are taken at a time.
MOST, STEP = 63, 4096


def _table(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points (texts, 64), filled up behind each end, and lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), 64), fill, np.uint32)
    out[np.arange(64) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, sizes


def _longest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, row, bit) of the longest diagonal of set bits in each column of words, of the first row and then the lowest bit that begins one; size 0 without any."""
    n = rows.shape[1]
    size, first, bit = (np.zeros(n, np.int64) for _ in range(3))
    live = np.flatnonzero(np.bitwise_or.reduce(rows, axis=0))
    every = starts = rows[:, live]
    length = 1
    while len(live):
        longer = np.zeros_like(starts)
        np.right_shift(starts[1:], np.uint64(1), out=longer[:-1])
        longer &= every
        on = np.bitwise_or.reduce(longer, axis=0) != 0
        done = np.flatnonzero(~on)
        if len(done):
            ended = starts[:, done]
            row = (ended != 0).argmax(axis=0)
            word = ended[row, np.arange(len(done))]
            size[live[done]], first[live[done]] = length, row
            bit[live[done]] = np.log2((word & (~word + np.uint64(1))).astype(np.float64)).astype(np.int64)
            live, every, longer = live[on], every[:, on], longer[:, on]
        starts = longer
        length += 1
    return size, first, bit


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair of texts of at most MOST characters."""
    (x, x_size), (y, y_size) = _table(a, 0xFFFFFFFF), _table(b, 0xFFFFFFFE)
    total, height = np.zeros(len(a), np.int64), int(x_size.max(initial=0))
    # a word for each character of a: where b has the same
    same = np.empty((height, len(a)), np.uint64)
    for i in range(height):
        same[i] = np.packbits(y == x[:, i : i + 1], axis=1, bitorder="little").view("<u8")[:, 0]
    pair, a_low, a_high, b_low, b_high = np.arange(len(a)), np.zeros(len(a), np.int64), x_size, np.zeros(len(a), np.int64), y_size
    one = np.uint64(1)
    while True:
        order = np.argsort(a_high - a_low, kind="stable")
        order = order[(a_high > a_low)[order] & (b_high > b_low)[order]]
        if not len(order):
            return total
        pair, a_low, a_high, b_low, b_high = (v[order] for v in (pair, a_low, a_high, b_low, b_high))
        found = []
        # ranges of like height together, so that few rows are empty
        for i in range(0, len(order), 1024):
            own = slice(i, i + 1024)
            place = np.arange(int((a_high[own] - a_low[own]).max()))[:, None] + a_low[own]
            inside = place < a_high[own]
            rows = same[np.where(inside, place, 0), pair[own]]
            rows &= np.where(inside, (one << b_high[own].astype(np.uint64)) - (one << b_low[own].astype(np.uint64)), np.uint64(0))
            found.append(_longest(rows))
        size, row, bit = (np.concatenate(v) for v in zip(*found, strict=True))
        total += np.bincount(pair, size, len(total)).astype(np.int64)
        hit = np.flatnonzero(size)
        pair, low, high, left, right = (v[hit] for v in (pair, a_low, a_high, b_low, b_high))
        begin, size, bit = low + row[hit], size[hit], bit[hit]
        pair, a_low, a_high, b_low, b_high = (np.concatenate(v) for v in ((pair, pair), (low, begin + size), (begin, high), (left, bit + size), (bit, right)))


def block_ratios(a: Sequence[str | None], b: Sequence[str | None]) -> list[float | None]:
    """Twice the characters of the matching blocks over those of both texts, as difflib's SequenceMatcher(None, a, b).ratio(); None beside a None.

    The longest common run is taken (the first of its length in a, then in b), then what lies before and behind it in
    both texts likewise. Texts of over MOST characters go to difflib.
    """
    out: list[float | None] = [None] * len(a)
    short = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        if len(x) <= MOST and len(y) <= MOST:
            short.append(i)
        else:
            out[i] = difflib.SequenceMatcher(None, x, y).ratio()
    for k in range(0, len(short), STEP):
        rows = short[k : k + STEP]
        for i, m in zip(rows, _matched([a[i] for i in rows], [b[i] for i in rows]).tolist(), strict=True):
            whole = len(a[i]) + len(b[i])
            out[i] = 2.0 * m / whole if whole else 1.0
    return out
