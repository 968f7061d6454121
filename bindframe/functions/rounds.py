"""The rounds of I10 by numpy on batches of rows: every row takes its next step at once, and rows that are done leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from bindframe.functions.calling import BASES, Caller, windows_of_batch

#: What a row ends with.
RESULT = "struct<sequence:string,status:string,steps:int,positions:array<int>>"


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a batch of texts, one after the other, and where each text starts, with the end."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _window_codes(ranks: np.ndarray, k: int) -> np.ndarray:
    """The code of each window of k of the columns, -1 with a rank that is no base's."""
    n = ranks.shape[1] - k + 1
    parts = [ranks[:, j : j + n] for j in range(k)]
    codes = sum(part.astype(np.int64) * 4 ** (k - 1 - j) for j, part in enumerate(parts))
    return np.where(np.logical_and.reduce([part >= 0 for part in parts]), codes, -1)


def _steps(ranks: np.ndarray, blocked: np.ndarray, others: np.ndarray, caller: Caller, profile: Caller, flank: int, most: int, before: int, pause: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Changes ranks, the bases from `before` ahead of each row's site on, -1 beyond the sequence, until each row is done.

    blocked marks the profile's windows near the site that keep no distance from others, `others` says how many these are. Gives back the status (0: 'steps', 1:
    'abolished', 2: 'stuck') and the steps of each row, and the changes as (rows, columns, step) in order.
    """
    k, width, n = profile.k, caller.k, blocked.shape[1]
    table, scores = np.array(profile.scores), np.array(caller.scores)
    first = before - flank  # the column of the first window near the site
    centre = k // 2
    status, steps = np.zeros(len(ranks), np.int8), np.full(len(ranks), most, np.int32)
    at = np.arange(len(ranks))
    there, sites = np.ones(len(ranks), bool), others + 1
    taken = np.zeros((len(ranks), 0), np.int64)
    changes = []
    for step in range(most):
        live = np.flatnonzero(steps[at] == most) if step % pause == 0 else slice(None)
        if step % pause == 0:
            # done rows wait for this, so that the arrays are not copied in each step
            at, there, sites, taken = at[live], there[live], sites[live], taken[live]
        if not len(at):
            break
        going = steps[at] == most
        near = _window_codes(ranks[at, first : first + n + k - 1], k)
        marks = np.arange(n) * 4**k + near
        free = (near >= 0) & ~blocked[at]
        for i in range(taken.shape[1]):
            free &= marks != taken[:, i, None]
        value = np.where(free, table[near], -np.inf)
        pick = value.argmax(axis=1)
        row = np.arange(len(at))
        none = ~free.any(axis=1)
        ended = going & (none | ((value[row, pick] < profile.above) & ~there))
        status[at[ended]] = np.where(none & there, 2, 1)[ended]
        steps[at[ended]] = step
        going &= ~ended
        taken = np.concatenate([taken, marks[row, pick][:, None]], axis=1)
        go = np.flatnonzero(going)
        rows, code, column = at[go], near[go, pick[go]], first + pick[go] + centre
        old = ranks[rows, column]
        weight = 4 ** (k - 1 - centre)
        new = table[code[:, None] + (np.arange(4) - old[:, None]) * weight].argmin(axis=1).astype(ranks.dtype)
        # only windows over the position change
        around = column[:, None] + np.arange(-width + 1, width)
        bases = ranks[rows[:, None], around]
        called = lambda b: (lambda c: (c >= 0) & (scores[c] > caller.above))(_window_codes(b, width))
        was = called(bases)
        bases[:, width - 1] = new
        now = called(bases)
        own = before - (column - width + 1)  # the place of the site among these windows, if it is one
        reach = (own >= 0) & (own < width)
        still = np.where(reach, now[np.arange(len(go)), np.where(reach, own, 0)], there[go])
        total = sites[go] + now.sum(axis=1) - was.sum(axis=1)
        made = still | (total == others[rows])
        kept = go[made]
        there[kept], sites[kept] = still[made], total[made]
        ranks[rows[made], column[made]] = new[made]
        moved = made & (new != old)
        changes.append((rows[moved], column[moved], np.full(moved.sum(), step)))
    return status, steps, changes


def abolished_in_rounds(seq: Column, target: Column, caller: Caller, profile: Caller, barrier: int, flank: int, most: int, pause: int) -> Column:
    """What I10 makes of the site at target, as RESULT; null where no site starts there. See `abolish_site_rounds`."""

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array, targets: pa.Array) -> pa.Array:
        k, width = profile.k, caller.k
        texts = pc.fill_null(texts.cast(pa.string()), "")
        codes, sizes = windows_of_batch(texts, width)
        begin = np.cumsum(sizes) - sizes
        site = (codes >= 0) & (np.array(caller.scores)[codes] > caller.above)
        t = pc.fill_null(targets.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero((t >= 0) & (t < sizes))
        rows = rows[site[begin[rows] + t[rows]]]
        t = t[rows]
        points, starts = _code_points(texts)
        rank = np.full(256, -1, np.int8)
        rank[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(len(BASES))
        # the bases around each site that a step may read
        before, n = flank + width + k, max(width + 2 * flank - k + 1, 0)
        place = t[:, None] - before + np.arange(2 * before + width)
        size = np.diff(starts)[rows]
        inside = (place >= 0) & (place < size[:, None])
        held = points[starts[rows][:, None] + np.where(inside, place, 0)]
        ranks = np.where(inside & (held < 256), rank[np.minimum(held, 255)], -1).astype(np.int8)
        # windows whose centre keeps no distance from another site
        count = np.add.reduceat(np.append(site, False).astype(np.int64), np.minimum(begin, len(site))) if len(sizes) else sizes
        count = np.where(sizes > 0, count, 0)
        each = np.repeat(np.arange(len(rows)), count[rows])
        listed = np.flatnonzero(site)
        ahead = np.concatenate([[0], np.cumsum(count)])[rows]
        o = listed[ahead[each] + np.arange(len(each)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])] - begin[rows][each] if len(each) else np.zeros(0, np.int64)
        each, o = each[o != t[each]], o[o != t[each]]
        blocked = np.zeros((len(rows), n), bool)
        for p in range(n):
            middle = t[each] - flank + p + (k + 1) // 2
            blocked[each[(middle >= o - barrier) & (middle < o + width + barrier)], p] = True
        status, steps, changes = _steps(ranks, blocked, count[rows] - 1, caller, profile, flank, most, before, pause) if n else (np.full(len(rows), 2, np.int8), np.zeros(len(rows), np.int32), [])

        changed = points.copy()
        which, column, order = (np.concatenate([c[i] for c in changes]) if changes else np.zeros(0, np.int64) for i in range(3))
        # a sequence may be in the batch once for each of its sites, as rows of their own
        letters = np.frombuffer(BASES.encode(), np.uint8).astype(np.uint32)
        changed[starts[rows[which]] + t[which] - before + column] = letters[ranks[which, column]]
        text = changed.tobytes().decode("utf-32-le")
        out = [text[a:b] for a, b in zip(starts[rows], starts[rows + 1], strict=True)]
        by = np.lexsort((order, which))
        positions = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(rows)))]), pa.int32()), pa.array((t[which] - before + column)[by], pa.int32()))
        named = pa.array(["steps", "abolished", "stuck"]).take(pa.array(status))
        done = pa.StructArray.from_arrays([pa.array(out, pa.string()), named, pa.array(steps, pa.int32()), positions], ["sequence", "status", "steps", "positions"])
        index = np.full(len(sizes), -1)
        index[rows] = np.arange(len(rows))
        return done.take(pa.array(index, mask=index < 0))

    return found(seq, target)
