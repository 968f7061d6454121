"""Repair of the structure of conversations, with an audit of the cheapest edits.

A conversation is right if its role initials read `(s?(ua)+)?`. Rows may be kept, reroled or
deleted, and rows without a text inserted. Which edits are cheapest is found by a dynamic
program over four states (nothing yet, after s, after u, after a). Its paths share their
beginnings as linked nodes; equal costs are decided for the least audit by a search for the
longest common prefix of two paths, over ancestors at powers of two and rolling hashes, and a
hash that says "equal" is verified by the node itself.

Rows are range-partitioned by (conversation, turn), so a conversation of any length is cut into
segments of SEGMENT rows at most. Segments that lie inside a conversation are solved for every
state they can be entered in; what goes on is the 4 x 4 costs and how the paths to the four
exits compare. A conversation's few segment tables are folded, and then each segment is told its
entry and exit. States are looked at just after a row's own edit, so that no path is the
beginning of another of the same place, and the order of two paths never changes later.

Defined results: null ids, turns, roles and texts are handled as one space wherever they are
written out; a null id is a conversation of its own; null turns come first; rows of one turn go
by role and text; repeated rows are duplicates of the first; a role's initial is its first
character, so an empty or unknown role fits nowhere; an empty table gives an empty result; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bindframe.llm._common import bounded_batches, small_side, stash

NOT_BLANK = r"[^\x20\x09-\x0D]"

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Rows of one conversation that are solved together at most.
SEGMENT = 20_000

START, S, U, A = range(4)
#: The state that a kept row's initial leads to, and the one that an inserted or reroled row leads to.
KEEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
NEXT = {START: U, S: U, U: A, A: U}
ROLES = {U: "user", A: "assistant"}

_MASK = (1 << 61) - 1


class Paths:
    """Audits as linked nodes: node 0 is empty, every other one adds an edit to its parent. Equal audits are one node."""

    def __init__(self) -> None:
        self.char, self.depth, self.hash, self.up, self.made = [""], [0], [0], [[]], {}

    def add(self, parent: int, char: str) -> int:
        node = self.made.get((parent, char))
        if node is None:
            node = self.made[parent, char] = len(self.char)
            self.char.append(char)
            self.depth.append(self.depth[parent] + 1)
            self.hash.append((self.hash[parent] * 1_000_003 + ord(char)) % _MASK)
            above, k = [parent], 0
            while k < len(self.up[above[k]]):  # the ancestor 2^(k+1) steps above is 2^k above the one 2^k above
                above.append(self.up[above[k]][k])
                k += 1
            self.up.append(above)
        return node

    def at_depth(self, node: int, depth: int) -> int:
        while (more := self.depth[node] - depth) > 0:
            node = self.up[node][more.bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        return self.hash[a] == self.hash[b] and a == b  # the hash decides most, the node verifies

    def less(self, a: int, b: int) -> bool:
        """Whether a's audit is before b's in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.char[x] < self.char[y]

    def edits(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))


State = dict[int, tuple[int, int]]


def _offer(paths: Paths, into: State, state: int, cost: int, parent: int, char: str) -> None:
    now = into.get(state)
    if now is None or cost < now[0] or cost == now[0] and paths.less(paths.add(parent, char), now[1]):
        into[state] = cost, paths.add(parent, char)


def _inserted(paths: Paths, live: State) -> State:
    """live, and what insertions make of it; more than two in a row never pay."""
    out = dict(live)
    for _ in range(2):
        for state, (cost, node) in sorted(out.items()):
            _offer(paths, out, NEXT[state], cost + INSERT, node, "I")
    return out


def solve(initials: list[str], gone: list[bool], truncated: list[bool], entry: int, last: bool, paths: Paths) -> State:
    """The cheapest audits from an entry state to each exit state: state -> (cost, node). `last`: insertions may follow the last row."""
    live: State = {entry: (0, 0)}
    for initial, must_go, cut in zip(initials, gone, truncated, strict=True):
        new: State = {}
        for state, (cost, node) in _inserted(paths, live).items():
            _offer(paths, new, state, cost + DELETE, node, "D")
            if not must_go:
                if (kept := KEEP.get((state, initial))) is not None:
                    _offer(paths, new, kept, cost + cut * TRUNCATED, node, "K")
                _offer(paths, new, NEXT[state], cost + REROLE + cut * TRUNCATED, node, "R")
        live = new
    return _inserted(paths, live) if last else live


def ending(paths: Paths, live: State) -> int:
    """The state, of those that may end a conversation, with the cheapest and then least audit."""
    ends = [s for s in (START, A) if s in live]
    if len(ends) == 2 and (live[A][0] < live[START][0] or live[A][0] == live[START][0] and paths.less(live[A][1], live[START][1])):
        return A
    return ends[0]


class Table(NamedTuple):
    """What a segment between two cuts is to its conversation: costs[e][x], -1 where x cannot be reached, and the rank of the audit to x among those from e."""

    costs: list[list[int]]
    ranks: list[list[int]]


def table(initials: list[str], gone: list[bool], truncated: list[bool], first: bool, last: bool) -> Table:
    costs, ranks = [[-1] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
    for entry in (START,) if first else (START, S, U, A):
        paths = Paths()
        live = solve(initials, gone, truncated, entry, last, paths)
        for x, (cost, node) in live.items():
            costs[entry][x] = cost
            ranks[entry][x] = sum(paths.less(other, node) for y, (_, other) in live.items() if y != x)
    return Table(costs, ranks)


def fold(tables: list[Table]) -> list[tuple[int, int]]:
    """The entry and exit of each of a conversation's segments, in order."""
    live: dict[int, tuple[int, int]] = {START: (0, 0)}  # state -> cost, rank of its audit so far
    came: list[dict[int, int]] = []
    for t in tables:
        best: dict[int, tuple[int, int, int, int]] = {}
        for e, (cost, rank) in live.items():
            for x in range(4):
                if t.costs[e][x] >= 0:
                    best[x] = min(best.get(x, (1 << 62, 0, 0, 0)), (cost + t.costs[e][x], rank, t.ranks[e][x], e))
        order = {x: i for i, x in enumerate(sorted(best, key=lambda x: best[x][1:3]))}
        came.append({x: b[3] for x, b in best.items()})
        live = {x: (b[0], order[x]) for x, b in best.items()}
    x = min((s for s in (START, A) if s in live), key=lambda s: live[s])
    out = []
    for back in reversed(came):
        out.append((back[x], x))
        x = back[x]
    return out[::-1]


def as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults made by the checksum of `conv_id:turn`: rows dropped, emptied, without stops, repeated, reroled to user."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), as_text(role_col).alias("role"), as_text(text_col).alias("text"))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    marked = rows.withColumn("_kind", kind).where("_kind <> 0")
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _numbered(rows: DataFrame, segment: int) -> DataFrame:
    """Rows in the order of conversations, with the segment they lie in and their place in it; first and last mark a segment at whose border its partition is cut, or which is cut itself.

    A segment is a run of one conversation inside a partition, of `segment` rows at most.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    # the number parts repeated rows, so that they too lie over several partitions
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, runs, at = TaskContext.get().partitionId(), object(), -1, 0
        for batch in batches:
            seg, place = [], []
            for conv in batch.column("conv_id").to_pylist():
                if runs < 0 or conv != last or at == segment:
                    runs, at, last = runs + 1, 0, conv
                seg.append(part << 40 | runs)
                place.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seg, pa.int64()), pa.array(place, pa.int64())], names=[*batch.schema.names, "seg", "place"])

    schema = StructType([*dealt.schema, StructField("seg", LongType()), StructField("place", LongType())])
    return bounded_batches(dealt).mapInArrow(run, schema)


def _solved(rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn(seg, columns as lists) -> rows, for every segment; rows are dealt by segment, narrow, in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        held: dict[str, list] = {}
        out: list[tuple] = []
        for batch in batches:
            columns = batch.to_pydict()
            segs = np.array(columns["seg"])
            edges = [0, *(np.flatnonzero(segs[1:] != segs[:-1]) + 1).tolist(), len(segs)] if len(segs) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and held["seg"][0] != segs[i]:
                    out += fn(held)
                    held = {}
                for k, v in columns.items():
                    held.setdefault(k, []).extend(v[i:j])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), arrow)
                out = []
        if held:
            out += fn(held)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.repartition(n, "seg").sortWithinPartitions("seg", "place").mapInArrow(run, schema)


def _edits(held: dict[str, list], entry: int, exit: int | None, last: bool) -> list[tuple]:
    """(seg, place, edits) of a segment: what is inserted before each row and its own edit; after the last row what is inserted behind it."""
    paths = Paths()
    live = solve(held["initial"], held["gone"], held["truncated"], entry, last, paths)
    audit = paths.edits(live[ending(paths, live) if exit is None else exit][1])
    out, begin = [], 0
    seg, n = held["seg"][0], len(held["seg"])
    for i, char in enumerate(audit):
        if char != "I":
            out.append((seg, len(out), audit[begin : i + 1]))
            begin = i + 1
    if begin < len(audit):
        out[n - 1] = (seg, n - 1, out[n - 1][2] + audit[begin:])
    return out


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """rows(conv_id, turn, role, text) -> every row with its edit, and the inserted ones, in order of (conv_id, seg, place, step).

    (conv_id, seg, place, step, edit, fault, turn, old_role, role, text): edit is K, R, D or I; an
    inserted row has no turn, old_role or fault; a deleted row keeps its role and text, but is no
    part of the repaired conversation.
    """
    tail = F.regexp_extract("text", rf"({NOT_BLANK})[\x20\x09-\x0D]*\z", 1)
    named = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"))
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    placed = stash(_numbered(named, segment).withColumns({"_blank": tail == "", "_cut": ~tail.isin(".", "!", "?"), "_content": content}))

    slim = placed.select("conv_id", "seg", "place", F.substring("role", 1, 1).alias("initial"), "_blank", "_cut", "_content")
    seen = slim.where("not _blank").groupBy("conv_id", "_content").agg(F.min(F.struct("seg", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"), F.col("_content").alias("_k"), "first")
    seen = small_side(stash(seen))
    again = slim.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_content") == F.col("_k")), "left")
    duplicate = ~F.col("_blank") & F.col("first").isNotNull() & (F.struct("seg", "place") != F.col("first"))
    judged = again.withColumn("duplicate", F.coalesce(duplicate, F.lit(False)))
    fault = F.when(F.col("_blank"), "blank").when(F.col("duplicate"), "duplicate").when(F.col("_cut"), "truncated")
    flagged = stash(judged.select("conv_id", "seg", "place", "initial", fault.alias("fault")))

    # a conversation's segments, in order; only those of conversations with more than one are tied together
    segments = flagged.groupBy("seg").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n"))
    many = segments.groupBy("conv_id").agg(F.count("*").alias("k"), F.min("seg").alias("least"), F.max("seg").alias("most")).where("k > 1")
    tied = stash(segments.select("seg", F.col("conv_id").alias("_conv")).join(small_side(stash(many)), F.col("_conv").eqNullSafe(F.col("conv_id"))).select("seg", "conv_id", (F.col("seg") == F.col("least")).alias("first"), (F.col("seg") == F.col("most")).alias("last")))
    marks = small_side(tied.select(F.col("seg").alias("_seg"), "first", "last"))
    states = flagged.join(marks, F.col("seg") == F.col("_seg"), "left").select(
        "seg", "place", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"),
        F.col("_seg").isNotNull().alias("part"), F.coalesce("first", F.lit(True)).alias("first"), F.coalesce("last", F.lit(True)).alias("last"))
    edits = "seg long, place long, edits string"
    whole = _solved(states.where("not part"), lambda h: _edits(h, START, None, True), edits)

    def summed(h: dict[str, list]) -> list[tuple]:
        t = table(h["initial"], h["gone"], h["truncated"], h["first"][0], h["last"][0])
        return [(h["seg"][0], sum(t.costs, []), sum(t.ranks, []))]

    tables = _solved(states.where("part"), summed, "seg long, costs array<long>, ranks array<long>")

    def folded(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("seg", "costs", "ranks")), strict=True))
        cut = lambda flat: [flat[i : i + 4] for i in range(0, 16, 4)]
        ways = fold([Table(cut(c), cut(r)) for _, c, r in rows])
        return pa.table({"_seg": [r[0] for r in rows], "entry": pa.array([e for e, _ in ways], pa.int32()), "exit": pa.array([x for _, x in ways], pa.int32())})

    # as many rows of a conversation as it has segments, a few numbers each
    ways = tables.join(tied.select(F.col("seg").alias("_tied"), "conv_id"), F.col("seg") == F.col("_tied")).groupBy("conv_id").applyInArrow(folded, "_seg long, entry int, exit int")
    parts = states.where("part").join(small_side(stash(ways)), F.col("seg") == F.col("_seg")).select("seg", "place", "initial", "gone", "truncated", "last", "entry", "exit")
    cut = _solved(parts, lambda h: _edits(h, h["entry"][0], h["exit"][0], h["last"][0]), edits)
    return _applied(placed, flagged, stash(whole.unionByName(cut)))


def _applied(placed: DataFrame, flagged: DataFrame, edits: DataFrame) -> DataFrame:
    """Every row with its edits: narrow rows with edits and rows with texts are dealt by conversation together and read in order, in one shuffle of the texts."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders = flagged.join(edits.select(F.col("seg").alias("_s"), F.col("place").alias("_p"), "edits"), (F.col("seg") == F.col("_s")) & (F.col("place") == F.col("_p")))
    none = lambda name: F.lit(None).cast(placed.schema[name].dataType).alias(name)
    ours = orders.select("conv_id", "seg", "place", F.lit(0).alias("kind"), none("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "fault", "edits")
    texts = placed.select("conv_id", "seg", "place", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("edits"))
    key = [F.col("conv_id").asc_nulls_first(), F.col("seg"), F.col("place"), F.col("kind")]
    both = ours.unionByName(texts).repartition(n, "conv_id").sortWithinPartitions(*key)
    names = ["conv_id", "seg", "place", "step", "edit", "fault", "turn", "old_role", "role", "text"]
    ids, turns = (placed.schema[x].dataType.simpleString() for x in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fault, todo, state, conv, begun = None, "", START, None, False
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "place", "kind", "turn", "role", "text", "fault", "edits")), strict=True):
                if not begun or r[0] != conv:
                    conv, state, begun = r[0], START, True
                if r[3] == 0:
                    fault, todo = r[7], r[8]
                    continue
                for step, edit in enumerate(todo):
                    if edit == "I":
                        state = NEXT[state]
                        row = (*r[:3], step, "I", None, None, None, ROLES[state], "")
                    elif edit == "D":
                        row = (*r[:3], step, "D", fault, r[4], r[5], r[5], r[6])
                    else:
                        state = NEXT[state] if edit == "R" else KEEP[state, r[5][:1]]
                        row = (*r[:3], step, edit, fault, r[4], r[5], ROLES[state] if edit == "R" else r[5], r[6])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    schema = f"conv_id {ids}, seg long, place long, step int, edit string, fault string, turn {turns}, old_role string, role string, text string"
    types = _arrow_types(schema)
    return bounded_batches(both).mapInArrow(run, schema)


def _arrow_types(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).types


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summaries(repaired: DataFrame, original: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each original conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Reads the repaired rows as `repair` leaves them, dealt by conversation and in order, and holds
    of a conversation its running digest and its audit, a letter for each edit.
    """
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    schema = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    types = _arrow_types(schema)
    weight = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, edit, fault, turn, old, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "fault", "turn", "old_role", "role", "text")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.audit.append(edit)
                now.cost += weight[edit] + (TRUNCATED if fault == "truncated" and edit in "KR" else 0)
                if edit != "I":
                    now.faults[fault] = now.faults.get(fault, 0) + 1
                    now.see(turn, old[:1])
                if edit != "D":
                    now.sha.update(((b"\n" if now.lines else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass")))
                    now.lines += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types, strict=True)], names=names)

    found = bounded_batches(repaired).mapInArrow(run, schema).withColumnRenamed("conv_id", "_conv")
    ids = original.select(F.col(conv_col).alias("conv_id")).distinct()
    zeros = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTS}
    return ids.join(found.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


class _Digest:
    """What a summary holds of one conversation while its rows pass by."""

    def __init__(self, conv):
        self.conv, self.audit, self.cost, self.faults, self.sha, self.lines = conv, [], 0, {}, hashlib.sha256(), 0
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def see(self, turn, initial: str) -> None:
        if turn is not None and turn != self.turn:  # turns come in order
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.turns)
        return (self.conv, gaps, *(self.faults.get(f, 0) for f in ("blank", "duplicate", "truncated")), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())
