"""Column expressions on DNA sequences and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """P7."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


_BASES = np.frombuffer(b"ACGT", np.uint8)
_RANKS = np.full(256, 255, np.uint8)
_RANKS[_BASES] = np.arange(4)
#: First byte of a packed text that stands as it is; else it is how many bases fill the last byte up.
_PLAIN = 255


def _packed(text: str | None) -> bytes | None:
    if text is None:
        return None
    raw = text.encode()
    ranks = _RANKS[np.frombuffer(raw, np.uint8)]
    if (ranks > 3).any():
        return bytes([_PLAIN]) + raw
    fill = -len(ranks) % 4
    four = np.append(ranks, np.zeros(fill, np.uint8)).reshape(-1, 4)
    return bytes([fill]) + (four << np.array([6, 4, 2, 0], np.uint8)).sum(1, dtype=np.uint8).tobytes()


def packed(seq: Column) -> Column:
    """seq as bytes, four bases in one; texts with other signs than ACGT stand as they are."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([_packed(t) for t in texts.to_pylist()], pa.binary())

    return pack(seq)


def unpacked(packed: Column, turned: Column) -> Column:
    """The text of packed bases, or its reverse complement; by numpy on batches of rows."""

    @F.arrow_udf("string")
    def unpack(rows: pa.Array, turns: pa.Array) -> pa.Array:
        rows = rows.cast(pa.binary())
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64) if len(rows) else np.zeros(1, np.int64)
        data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
        there, turn = np.diff(ends) > 0, turns.to_numpy(zero_copy_only=False).astype(bool)
        kind = np.zeros(len(rows), np.int64)
        kind[there] = data[ends[:-1][there]]
        whole = there & (kind != _PLAIN)
        sizes = np.where(whole, (np.diff(ends) - 1) * 4 - kind, 0)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = np.repeat(turn, sizes)
        place = np.where(back, np.repeat(sizes, sizes) - 1 - place, place)
        ranks = data[np.repeat(ends[:-1] + 1, sizes) + place // 4] >> (6 - 2 * (place % 4)).astype(np.uint8) & 3
        letters = _BASES[np.where(back, 3 - ranks, ranks)]
        out = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(letters.tobytes()))
        if whole.all():
            return out
        texts = out.to_pylist()
        for i in np.flatnonzero(~whole).tolist():
            raw = rows[i].as_py()
            own = None if raw is None else raw[1:].decode()
            texts[i] = own if own is None or not turn[i] else own[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
        return pa.array(texts, pa.string())

    return unpack(packed, turned)


def differing_positions(a: Column, b: Column) -> Column:
    """Positions from 0 where two sequences of equal length differ."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.filter(F.transform(both, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())


def logit(p: Column) -> Column:
    """1 counts as 0.999."""
    p = F.when(p == 1, F.lit(0.999)).otherwise(p)
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low)


def coordinate(chrom: Column, start: Column, end: Column) -> Column:
    """P17."""
    return F.format_string("%s:%d-%d", chrom, start, end)


def relative_orientation(first: Column, second: Column, forward1: list[str], forward2: list[str]) -> Column:
    """P13: '+/+', '+/-', '-/+' or '-/-' from two core texts and the forms that count as forward; null where a core is in neither list."""

    def strand(core: Column, forward: list[str]) -> Column:
        return F.when(core.isin(forward), F.lit("+")).when(reverse_complement(core).isin(forward), F.lit("-"))

    a, b = strand(first, forward1), strand(second, forward2)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("/"), b))


def head_tail(orientation: Column) -> Column:
    """P13: '+/+' and '-/-' are HT/TH, '+/-' is HH, '-/+' is TT."""
    return F.when(orientation.isin("+/+", "-/-"), "HT/TH").when(orientation == "+/-", "HH").when(orientation == "-/+", "TT")
