"""Rank sums of replicate groups by numpy on batches of groups: the combinations of a group are made, ranked and left in its batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: The types whose values are combined, first plus second less third, and the one they are held against.
TYPES = ("m1", "m2", "m3", "wt")

RESULT = StructType([StructField("m", LongType()), StructField("n", LongType()), *(StructField(c, DoubleType()) for c in ("u", "ties", "median_two", "median_indiv", "m3"))])

#: Combinations that are ranked at once.
AT_ONCE = 1 << 20


def _medians(values: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The median of each row without its nulls, NaN above all numbers; NaN too where a row has none, see `_no_values`."""
    with np.errstate(all="ignore"):
        out = np.median(values, axis=1) if values.shape[1] else np.full(len(values), np.nan)
    for i in np.flatnonzero(null.any(axis=1) | np.isnan(values).any(axis=1)):
        held = np.sort(values[i][~null[i]])
        out[i] = (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2 if len(held) else np.nan
    return out


def _ordered(values: np.ndarray, null: np.ndarray) -> np.ndarray:
    """values as numbers that compare as in SQL: NaN above all numbers and null above NaN, each equal to itself."""
    odd = null | np.isnan(values)
    if not odd.any():
        return values
    distinct, place = np.unique(values[~odd], return_inverse=True)
    out = np.where(null, len(distinct) + 1.0, float(len(distinct)))
    out[~odd] = place
    return out


def _ranked(parts: list[np.ndarray], nulls: list[np.ndarray]) -> list[np.ndarray]:
    """The fields of RESULT, and which medians have no value, of groups with equally many values of each type."""
    a, b, c, two = parts
    rows = len(two)
    mix = lambda x, y, z: (x[:, :, None, None], y[:, None, :, None], z[:, None, None, :])
    x, y, z = mix(a, b, c)
    with np.errstate(all="ignore"):
        indiv = (x + y - z).reshape(rows, -1)
    x, y, z = mix(*nulls[:3])
    lost = (x | y | z).reshape(rows, -1)
    m, n = two.shape[1], indiv.shape[1]
    both = _ordered(np.concatenate([two, indiv], axis=1), np.concatenate([nulls[3], lost], axis=1))
    u = sum((both[:, i, None] > both[:, m:]).sum(axis=1) + (both[:, i, None] == both[:, m:]).sum(axis=1) / 2 for i in range(m))
    ordered = np.sort(both, axis=1)
    equal = np.ones(ordered.shape)
    for far in range(1, m + n):
        same = ordered[:, far:] == ordered[:, :-far]
        if not same.any():
            break
        equal[:, far:] += same
        equal[:, :-far] += same
    medians = [_medians(two, nulls[3]), _medians(indiv, lost), _medians(c, nulls[2])]
    none = [nulls[3].all(axis=1), lost.all(axis=1), nulls[2].all(axis=1)]
    return [np.full(rows, m), np.full(rows, n), u, (equal * equal - 1).sum(axis=1), *medians, *none]


@F.arrow_udf(RESULT)
def _sums_of_batch(cells: pa.Array) -> pa.Array:
    size = len(cells)
    row = pc.list_parent_indices(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(cells)
    kind, value = flat.field("t").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("v")
    null, value = value.is_null().to_numpy(zero_copy_only=False), pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
    by = np.argsort(row * len(TYPES) + kind, kind="stable")
    null, value = null[by], value[by]
    counts = np.bincount(row * len(TYPES) + kind, minlength=size * len(TYPES)).reshape(size, len(TYPES))
    starts = (np.cumsum(counts) - counts.ravel()).reshape(size, len(TYPES))
    out = [np.zeros(size, np.int64), np.zeros(size, np.int64), *(np.zeros(size) for _ in range(5)), *(np.ones(size, bool) for _ in range(3))]
    shapes, of = np.unique(counts, axis=0, return_inverse=True)
    for i, shape in enumerate(shapes):
        if not shape.all():
            continue
        members = np.flatnonzero(of.ravel() == i)
        step = max(1, AT_ONCE // int(shape[:3].prod() + shape[3]))
        for some in (members[j : j + step] for j in range(0, len(members), step)):
            at = [starts[some, t, None] + np.arange(shape[t]) for t in range(len(TYPES))]
            for column, found in zip(out, _ranked([value[x] for x in at], [null[x] for x in at]), strict=True):
                column[some] = found
    numbers, none = out[:7], [np.zeros(size, bool)] * 4 + out[7:]
    return pa.StructArray.from_arrays([pa.array(x, mask=gone) for x, gone in zip(numbers, none, strict=True)], ["m", "n", "u", "ties", "median_two", "median_indiv", "m3"])


def rank_sums_of(cells: Column) -> Column:
    """RESULT of a group's array of (t, v): the place of a type in TYPES and a value. m and n are 0 where a type is missing."""
    return _sums_of_batch(cells)
