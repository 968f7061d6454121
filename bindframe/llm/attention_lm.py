"""Language-model scores by causal self-attention in numpy, on subword ids.

Subwords are the ids that the vocabulary's merges give for a blank and the word. The
1,599 most frequent ids and an end are units of the model; other ids share one unit
each with an id of like frequency, by their share of its counts. Counts of words and subwords come from
all training documents (crc32 of the id modulo 7 is not 2).

Two attention models of one kind split the chain of ids by masks. The first id of each word (or the
document's end) sees the words before it in its window, each through its first and last id. The
ids that follow in a word, and the word's end, see the ids of that word alone, so their
log-probabilities are made once for each distinct word. Both softmaxes have two levels, 40 classes
of 40 units of like frequency. Windows of words overlap; each id is scored once, in a window that
gives it at least the overlap as context.

Training is data-parallel and goes over all training documents: in each round every task takes
Adam steps on the windows of its part of a third of the documents, or of a third of the distinct words, each
weighted by its count, and Spark averages the weights, weighted by windows.

Words that are not frequent find their counts by a join on the word, so no table that grows
with the corpus is sent to the tasks.

Defined results: a null text counts as empty and has its end as only token; without training
documents every count is 0 (base scores are then 0, the smoothed share of nothing); repeated
rows are scored each for itself; an empty table gives an empty result; texts are read whole;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import bounded_batches, by_run, pieces, roomy_heap, small_side, spread, stash, text_or_empty, to_bytes
from bindframe.llm._folds import fold
from bindframe.llm.bpe_transducer import Lexicon, Vocabulary, distribute, most_frequent

HELD_FOLD, FOLDS = 2, 7
CLASSES, MEMBERS = 40, 40
UNITS = CLASSES * MEMBERS
END, BEGIN = UNITS - 1, UNITS
#: Words of a window and of the overlap of windows; the same for ids inside a word.
WINDOW, OVERLAP = 32, 8
INNER_WINDOW, INNER_OVERLAP = 8, 4
DIM, HIDDEN = 16, 32
#: Words whose counts are sent to every task, and words in the lexicon, at most.
FREQUENT_WORDS, LEXICON = 200_000, 40_000
#: Rounds among which the training documents are dealt, and windows that a task holds at a time.
ROUNDS, HELD = 3, 20_000
#: Steps that a task takes in a round at least, and windows in a step.
LEAST_STEPS, BATCH = 120, 128
#: Places of windows that are scored at a time.
PLACES = 4096
#: Words that are looked up first.
COMMON = 8_000
#: Words that every task draws from when it learns what is inside words.
HEAD_WORDS = 20_000


def words_of(text: str | None) -> list[bytes]:
    return to_bytes(text).lower().split()


def training_counts(slim: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, count) over the texts of (text); the end of a document is the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "count"])
            counts.clear()
            return batch

        for part in pieces(batches, "text"):
            for text in part.column("text").to_pylist():
                counts.update(words_of(text))
                counts[b""] += 1
            if len(counts) > flush:
                yield out()
        yield out()

    return slim.select("text").mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def encoded(counts: DataFrame, lexicon: str, head: dict[bytes, int]) -> DataFrame:
    """(count, tail, ids) of the counted words, so that the rounds don't merge them anew; tail: neither an end nor in head."""
    sent = counts.sparkSession.sparkContext.broadcast(frozenset(head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(lexicon)
        for batch in batches:
            words = [to_bytes(w) for w in batch.column("word").to_pylist()]
            n, ids = lex.ids_of([b" " + w if w else w for w in words])
            tail = [bool(w) and w not in sent.value for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("count"), pa.array(tail, pa.bool_()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))], names=["count", "tail", "ids"])

    return counts.select("word", "count").mapInArrow(run, "count long, tail boolean, ids array<int>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each row has, and all of them in order."""
    ids = batch.column("ids")
    return np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy()


def subword_counts(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id is the first of a word, and how often it is inside one, in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            n, ids = _lists(batch)
            inside = np.full(len(ids), size)
            inside[(np.cumsum(n) - n)[n > 0]] = 0
            # halves, since bincount adds in floating point
            high, low = np.divmod(np.repeat(batch.column("count").to_numpy(), n), 1 << 20)
            total += sum(np.bincount(ids + inside, half, 2 * size).astype(np.int64) * unit for half, unit in ((high, 1 << 20), (low, 1)) if half.any())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    out = np.zeros(2 * size, np.int64)
    for r in words.select("count", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out[:size], out[size:]


def units_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's unit, and the log10 of its share of the unit. The last unit is an end."""
    order = np.argsort(-counts, kind="stable")
    own = np.empty(len(counts), np.int64)
    single = min(UNITS - 1, len(counts))
    own[order[:single]] = np.arange(single)
    own[order[single:]] = UNITS // 2 + np.arange(len(counts) - single) % (UNITS // 2 - 1)
    total = np.bincount(own, counts + 0.1, UNITS)
    return own, np.log10((counts + 0.1) / total[own])


def _by_group(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(keys.astype(np.int16), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(keys, minlength=groups)))


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] += rows, where places may repeat."""
    order, edges = _by_group(at, len(table))
    found = np.flatnonzero(np.diff(edges))
    table[found] += np.add.reduceat(rows[order], edges[found])


#: Class and member of each unit; which places of a window see which, itself included.
_CLASS_OF, _MEMBER_OF = np.divmod(np.arange(UNITS), MEMBERS)
_BEFORE = np.tri(WINDOW, dtype=np.float32)


class AttentionModel:
    """Embeddings of two ids and a place, one causal attention head, one hidden layer, a softmax over classes and members."""

    SHAPES = {"first": (UNITS + 1, DIM), "last": (UNITS + 1, DIM), "place": (WINDOW, DIM), "query": (DIM, DIM), "key": (DIM, DIM), "value": (DIM, DIM), "mixed": (DIM, DIM), "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIM), "out": (DIM, CLASSES), "bias": (CLASSES,), "inner": (CLASSES, DIM, MEMBERS), "inner_bias": (CLASSES, MEMBERS)}

    def __init__(self, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(3)
            spread_of = {"first": 0.3, "last": 0.3, "place": 0.1, "w2": HIDDEN**-0.5} | dict.fromkeys(("b1", "bias", "out", "inner", "inner_bias"), 0.0)
            flat = np.concatenate([rng.normal(0, spread_of.get(n, DIM**-0.5), math.prod(s)) for n, s in self.SHAPES.items()])
        self.flat = np.array(flat, np.float32)
        self.p, at = {}, 0
        for name, shape in self.SHAPES.items():
            self.p[name] = self.flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        if counts is not None:  # starts as the unigram model
            table = (counts + 1e-3).reshape(CLASSES, MEMBERS)
            self.p["bias"][:] = np.log(table.sum(1) / table.sum())
            self.p["inner_bias"][:] = np.log(table / table.sum(1, keepdims=True))

    def _forward(self, first: np.ndarray, last: np.ndarray, target: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
        """All layers; rows are windows of one width. What lies above the attention is made at scored places alone, in order of the target's class.

        at: the scored places in that order; order: their rank among the scored places; edges: where each class begins.
        classes and members are exponentials of logits, not divided by their sums; so is a.
        """
        p, (n, width) = self.p, first.shape
        places = np.flatnonzero(scored)
        own = np.take(target, places)
        order, edges = _by_group(np.take(_CLASS_OF, own), CLASSES)
        at, own = np.take(places, order), np.take(own, order)
        group, member = np.take(_CLASS_OF, own), np.take(_MEMBER_OF, own)
        e = np.take(p["first"], first, axis=0)
        e += np.take(p["last"], last, axis=0)
        e += p["place"][:width]
        flat = e.reshape(-1, DIM)
        # query, key and value side by side, from one product
        qkv = (flat @ self._attention()).reshape(n, width, 3 * DIM)
        q, k, v = (qkv[..., i * DIM : (i + 1) * DIM] for i in range(3))
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, 40, out=a)
        np.exp(a, out=a)
        a *= _BEFORE[:width, :width]
        o = a @ v
        weight = a @ np.ones((width, 1), np.float32)
        o /= weight
        heads = np.take(o.reshape(-1, DIM), at, axis=0)
        y = heads @ p["mixed"]
        y += np.take(flat, at, axis=0)
        r = y @ p["w1"]
        r += p["b1"]
        np.maximum(r, 0, out=r)
        # the last column is one, so that products with it hold the bias and its gradient too
        z = np.ones((len(at), DIM + 1), np.float32)
        np.add(y, r @ p["w2"], out=z[:, :DIM])
        classes = z @ np.vstack([p["out"], p["bias"]])
        np.minimum(classes, 60, out=classes)
        rows = np.arange(len(at))
        logs = classes[rows, group]
        np.exp(classes, out=classes)
        sums = classes @ np.ones(CLASSES, np.float32)
        inner = np.concatenate([p["inner"], p["inner_bias"][:, None]], 1)
        members = np.empty((len(at), MEMBERS), np.float32)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            np.matmul(z[edges[c] : edges[c + 1]], inner[c], out=members[edges[c] : edges[c + 1]])
        np.minimum(members, 60, out=members)
        logs += members[rows, member]
        np.exp(members, out=members)
        inner_sums = members @ np.ones(MEMBERS, np.float32)
        logs -= np.log(sums) + np.log(inner_sums)
        attended = {"e": e, "flat": flat, "qkv": qkv, "q": q, "k": k, "v": v, "a": a, "o": o, "weight": weight}
        return attended | {"at": at, "order": order, "edges": edges, "rows": rows, "group": group, "member": member, "heads": heads, "y": y, "r": r, "z": z, "classes": classes, "sums": sums, "members": members, "inner_sums": inner_sums, "logs": logs}

    def _attention(self) -> np.ndarray:
        return np.hstack([self.p["query"] * np.float32(DIM**-0.5), self.p["key"], self.p["value"]])

    def log10(self, first: np.ndarray, last: np.ndarray, target: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """log10 P(target) at the scored places of windows, in order."""
        f = self._forward(first, last, target, scored)
        out = np.empty(len(f["at"]))
        out[f["order"]] = f["logs"]
        return out / math.log(10)

    def gradient(self, first: np.ndarray, last: np.ndarray, target: np.ndarray, scored: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Of the mean loss over the scored places, which count by the weights of their windows."""
        p, f = self.p, self._forward(first, last, target, scored)
        g = {name: np.zeros(self.SHAPES[name], np.float32) for name in ("first", "last", "place")}
        e, a, at, z, edges, rows = f["e"], f["a"], f["at"], f["z"], f["edges"], f["rows"]
        share = np.float32(1 / max(1, len(z)))
        if weight is not None:
            share = weight[at // first.shape[1]]
            share = (share / max(share.sum(), 1e-30)).astype(np.float32)
        d = f["classes"]
        d *= (share / f["sums"])[:, None]
        d[rows, f["group"]] -= share
        both = z.T @ d
        g["out"], g["bias"] = both[:DIM], both[DIM]
        m = f["members"]
        m *= (share / f["inner_sums"])[:, None]
        m[rows, f["member"]] -= share
        both, dz_inner = np.zeros((CLASSES, DIM + 1, MEMBERS), np.float32), np.empty((len(z), DIM), np.float32)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[c], edges[c + 1])
            np.matmul(z[own].T, m[own], out=both[c])
            np.matmul(m[own], p["inner"][c].T, out=dz_inner[own])
        g["inner"], g["inner_bias"] = both[:, :DIM], both[:, DIM]
        dz = d @ p["out"].T
        dz += dz_inner
        dr = dz @ p["w2"].T
        dr *= f["r"] > 0
        ones = np.ones(len(z), np.float32)
        g["w2"], g["w1"], g["b1"] = f["r"].T @ dz, f["y"].T @ dr, ones @ dr
        dz += dr @ p["w1"].T
        g["mixed"] = f["heads"].T @ dz
        # back to all places of the windows
        de, do = np.zeros((2, e.size // DIM, DIM), np.float32)
        de[at], do[at] = dz, dz @ p["mixed"].T
        do = do.reshape(e.shape)
        inside = (do * f["o"]) @ np.ones((DIM, 1), np.float32)
        inside /= f["weight"]
        do /= f["weight"]
        d_qkv = np.empty_like(f["qkv"])
        ds = do @ f["v"].transpose(0, 2, 1)
        ds -= inside
        ds *= a
        np.matmul(ds, f["k"], out=d_qkv[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=d_qkv[..., DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), do, out=d_qkv[..., 2 * DIM :])
        d_qkv = d_qkv.reshape(-1, 3 * DIM)
        de += d_qkv @ self._attention().T
        both = f["flat"].T @ d_qkv
        g["query"], g["key"], g["value"] = both[:, :DIM] * np.float32(DIM**-0.5), both[:, DIM : 2 * DIM], both[:, 2 * DIM :]
        g["place"][: first.shape[1]] = (np.ones(len(first), np.float32) @ de.reshape(len(first), -1)).reshape(e.shape[1:])
        _add_rows(g["first"], first.reshape(-1), de)
        _add_rows(g["last"], last.reshape(-1), de)
        return np.concatenate([g[n].reshape(-1) for n in self.SHAPES])


class Adam:
    """Steps of a model; moments stay between calls."""

    def __init__(self, model: AttentionModel, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.m, self.v, self.room = np.zeros_like(model.flat), np.zeros_like(model.flat), np.empty_like(model.flat)

    def take(self, g: np.ndarray) -> None:
        self.step += 1
        room = self.room
        np.subtract(g, self.m, out=room)
        room *= np.float32(0.1)
        self.m += room
        np.multiply(g, g, out=room)
        room -= self.v
        room *= np.float32(0.01)
        self.v += room
        np.multiply(self.v, np.float32(1 / (1 - 0.99**self.step)), out=room)
        np.sqrt(room, out=room)
        room += np.float32(1e-8)
        np.divide(self.m, room, out=room)
        room *= np.float32(self.rate / (1 - 0.9**self.step))
        self.model.flat -= room


def windows(first: np.ndarray, last: np.ndarray, sizes: np.ndarray, width: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over sequences given as one run, `sizes` of them each; every sequence has an end as its last target.

    Inputs are the units (first and last) of what stands before a target. Returns both inputs, targets,
    which places are scored (each target once), and each window's sequence.
    """
    targets = sizes + 1
    start = np.cumsum(targets) - targets
    y = np.full(int(targets.sum()), END, np.int64)
    inside = np.ones(len(y), bool)
    inside[start + sizes] = False
    y[inside] = first
    inputs = []
    for units in (first, last):
        x = np.full(len(y), BEGIN, np.int64)
        own = np.full(len(y), BEGIN, np.int64)
        own[inside] = units
        x[1:] = own[:-1]
        x[start] = BEGIN
        inputs.append(x)
    step = width - overlap
    n = 1 + np.maximum(0, -(-(targets - width) // step))
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = k[:, None] * step + np.arange(width)
    real = place < targets[owner][:, None]
    at = np.where(real, start[owner][:, None] + place, 0)
    scored = real & ((k[:, None] == 0) | (np.arange(width) >= overlap))
    return np.where(real, inputs[0][at], BEGIN), np.where(real, inputs[1][at], BEGIN), y[at], scored, owner


def by_width(scored: np.ndarray, most: int = 128) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of windows in blocks, and how many places their last scored one asks for: short windows are cut, not padded."""
    width = scored.shape[1] - scored[:, ::-1].argmax(1)
    order = np.argsort(-width, kind="stable")
    for i in range(0, len(order), most):
        rows = order[i : i + most]
        yield rows, int(width[rows[0]])


def window_logs(model: AttentionModel, found: tuple, size: int) -> np.ndarray:
    """The sum of log10 P over the scored places of each sequence."""
    first, last, y, scored, owner = found
    out = np.zeros(size)
    for rows, w in by_width(scored, max(1, PLACES // scored.shape[1])):
        own = scored[rows, :w]
        out += np.bincount(np.repeat(owner[rows], own.sum(1)), model.log10(first[rows, :w], last[rows, :w], y[rows, :w], own), size)
    return out


def inside_words(own: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple:
    """Windows over the ids of words; their first ids are given, so they are not scored."""
    units = own[ids]
    first, last, y, scored, owner = windows(units, units, counts, INNER_WINDOW, INNER_OVERLAP)
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    scored[new, 0] = False
    return first, last, y, scored, owner


_LEXICONS: dict[str, Lexicon] = {}


def _lexicon(name: str) -> Lexicon:
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon.load(SparkFiles.get(name))
    return _LEXICONS[name]


class FrequentWords:
    """What the tasks need of the frequent words, made once, in order of their counts: first and last unit, what their ids score, and their base terms."""

    def __init__(self, words: list[bytes], first: np.ndarray, last: np.ndarray, logs: np.ndarray, terms: np.ndarray):
        self.words, self.first, self.last, self.logs, self.terms = words, first, last, logs, terms

    @classmethod
    def of(cls, counts: DataFrame, lexicon: str, own: np.ndarray, share: np.ndarray, inner: AttentionModel, room: int) -> FrequentWords:
        sent = counts.sparkSession.sparkContext.broadcast((own, share, inner.flat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, share, inside = sent.value
            table = WordTable(_lexicon(lexicon), own, share, AttentionModel(inside))
            for batch in batches:
                at = table.places([to_bytes(w) for w in batch.column("word").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("count"), pa.array(table.first[at]), pa.array(table.last[at]), pa.array(table.logs[at])], names=["word", "count", "first", "last", "logs"])

        found = sorted(counts.where("word <> ''").select("word", "count").mapInArrow(run, "word string, count long, first long, last long, logs double").collect(), key=lambda r: (-r["count"], r["word"]))
        column = lambda name, kind: np.array([r[name] for r in found], kind)
        return cls([to_bytes(r["word"]) for r in found], column("first", np.int64), column("last", np.int64), column("logs", float), np.log10((column("count", float) + 1) / room))


class WordTable:
    """word -> its first and last unit, what its ids score and its base term (NaN where its count is not at hand): a bounded memo that begins with the frequent words."""

    def __init__(self, lexicon: Lexicon, own: np.ndarray, share: np.ndarray | None = None, inner: AttentionModel | None = None, frequent: FrequentWords | None = None, most: int = 500_000, most_bytes: int = 16_000_000):
        self.lexicon, self.own, self.share, self.inner = lexicon, own, share, inner
        self.frequent = frequent or FrequentWords([], *(np.zeros(0, kind) for kind in (np.int64, np.int64, float, float)))
        self.most, self.most_bytes = most, most_bytes
        # most words are found in this small part, which stays in the processor's cache
        self.common = dict(zip(self.frequent.words[:COMMON], range(COMMON), strict=False))
        self.reset()

    def reset(self) -> None:
        known = self.frequent
        self.memo: dict[bytes, int] = dict(zip(known.words, range(len(known.words)), strict=True))
        self.bytes = 0
        self.first, self.last, self.logs, self.terms = known.first, known.last, known.logs, known.terms

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) - len(self.frequent.words) > self.most or self.bytes > self.most_bytes:
            self.reset()
        at = np.fromiter(map(self.common.get, words, repeat(-1)), np.int64, len(words))
        others = np.flatnonzero(at < 0)
        at[others] = np.fromiter(map(self.memo.get, [words[i] for i in others.tolist()], repeat(-1)), np.int64, len(others))
        missing = others[at[others] < 0].tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            counts, ids = self.lexicon.ids_of([b" " + w for w in new])
            start, ends = len(self.memo), np.cumsum(counts)
            self.memo.update(zip(new, range(start, start + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            self.first = np.concatenate([self.first, self.own[ids[ends - counts]]])
            self.last = np.concatenate([self.last, self.own[ids[ends - 1]]])
            if self.inner is not None:
                own_share = np.add.reduceat(self.share[ids], ends - counts)
                self.logs = np.concatenate([self.logs, own_share + window_logs(self.inner, inside_words(self.own, counts, ids), len(new))])
                self.terms = np.concatenate([self.terms, np.full(len(new), math.nan)])
            at[missing] = [self.memo[words[i]] for i in missing]
        return at


def _per_text(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _blocks_of(model: AttentionModel, weight: float) -> pa.RecordBatch:
    cut = [model.flat[i : i + 4096].tobytes() for i in range(0, len(model.flat), 4096)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int64()), pa.array(cut, pa.binary()), pa.array([weight] * len(cut))], names=["block", "value", "weight"])


def averaged(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], model: AttentionModel) -> AttentionModel:
    """The weighted mean of the models that the tasks learn, added up block by block; the model itself if there are none."""

    def average(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            weights = group.column("weight").to_numpy()
            mean = sum(w * np.frombuffer(v, np.float32) for w, v in zip(weights, group.column("value").to_pylist(), strict=True)) / weights.sum()
            yield pa.RecordBatch.from_arrays([group.column("block").slice(0, 1), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["block", "value"])

    found = by_run(rows.mapInArrow(learn, "block long, value binary, weight double"), "block", average, "block long, value binary").collect()
    return AttentionModel(np.concatenate([np.frombuffer(bytes(r["value"]), np.float32) for r in sorted(found, key=lambda r: r["block"])])) if found else model


def train_on_texts(slim: DataFrame, lexicon: str, own: np.ndarray, unit_counts: np.ndarray, frequent: Broadcast[FrequentWords]) -> AttentionModel:
    """The model of first ids: each training document is learnt from in one of the rounds, in windows without overlap."""
    model = AttentionModel(counts=unit_counts)
    for number in range(ROUNDS):
        sent = slim.sparkSession.sparkContext.broadcast((model.flat, own))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            roomy_heap()
            local = AttentionModel(sent.value[0])
            steps, rng, table = Adam(local, 0.01 / (1 + number)), np.random.default_rng(number), WordTable(_lexicon(lexicon), sent.value[1], frequent=frequent.value)
            held: list[tuple] = []
            total = 0

            def train() -> None:
                first, last, y, scored = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                while True:
                    order = rng.permutation(len(first))
                    for i in range(0, len(order), BATCH):
                        rows = order[i : i + BATCH]
                        w = int((scored.shape[1] - scored[rows, ::-1].argmax(1)).max())
                        steps.take(local.gradient(first[rows, :w], last[rows, :w], y[rows, :w], scored[rows, :w]))
                    if total > len(order) or steps.step >= LEAST_STEPS:
                        return

            for part in pieces(batches, "text"):
                found = [words_of(t) for t in part.column("text").to_pylist()]
                at = table.places([w for ws in found for w in ws])
                held.append(windows(table.first[at], table.last[at], np.array([len(ws) for ws in found]), overlap=0)[:4])
                total += len(held[-1][0])
                if sum(len(h[0]) for h in held) >= HELD:
                    train()
            if held:
                train()
            if total:
                yield _blocks_of(local, float(total))

        part = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == number).select("text")
        model = averaged(part, learn, model)
    return model


def train_inside_words(words: DataFrame, lexicon: str, own: np.ndarray, unit_counts: np.ndarray, head: dict[bytes, int], tail: int) -> AttentionModel:
    """The model of what follows a word's first id: each word of (count, tail, ids) is learnt from in one of the rounds, weighted by its count.

    The most frequent words are drawn by their counts besides, in every task, since each has a row in one task alone.
    """
    model = AttentionModel(counts=unit_counts)
    for number in range(ROUNDS):
        sent = words.sparkSession.sparkContext.broadcast((model.flat, own, head))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            roomy_heap()
            flat, own, head = sent.value
            local = AttentionModel(flat)
            steps, rng = Adam(local, 0.01 / (1 + number)), np.random.default_rng(number)
            head_windows, head_counts = inside_words(own, *_lexicon(lexicon).ids_of([b" " + w for w in head])), np.array(list(head.values()), float)
            drawn = 0
            for batch in batches:
                n, ids = _lists(batch)
                rare, counts = batch.column("tail").to_numpy(zero_copy_only=False), batch.column("count").to_numpy()
                scale = max(1, int(counts[rare].sum())) / max(1, tail)
                weight = np.concatenate([np.where(n > 0, np.where(rare, counts, counts * scale), 0), head_counts * scale])
                if not weight.sum():
                    continue
                first, last, y, scored, owner = map(np.concatenate, zip(inside_words(own, n, ids), (*head_windows[:4], head_windows[4] + len(n)), strict=True))
                draws = len(n) + len(head) // 4
                draws = max(draws, LEAST_STEPS * BATCH if not drawn else 0)
                # the batch's own words as often as their counts ask for, once at least, and then by a smaller weight
                due = weight * (draws / weight.sum())
                times = np.where(due > 0, np.maximum(1, np.rint(due)), 0).astype(np.int64)[: len(n)]
                # the others evenly spread over their counts
                cut = np.cumsum(due[len(n) :])
                others = np.searchsorted(cut, np.arange(rng.random(), cut[-1], 1), side="right") if len(cut) else np.zeros(0, np.int64)
                picked = np.concatenate([np.repeat(np.arange(len(n)), times), len(n) + np.minimum(others, len(cut) - 1)])
                by = np.concatenate([np.repeat(due[: len(n)] / np.maximum(times, 1), times), np.ones(len(others))])
                order = rng.permutation(len(picked))
                starts = np.searchsorted(owner, np.arange(len(weight) + 1))
                for i in range(0, len(order), 4 * BATCH):
                    own_words = picked[order[i : i + 4 * BATCH]]
                    sizes = starts[own_words + 1] - starts[own_words]
                    rows = spread(starts[own_words], sizes)
                    w = int((scored.shape[1] - scored[rows, ::-1].argmax(1)).max())
                    steps.take(local.gradient(first[rows, :w], last[rows, :w], y[rows, :w], scored[rows, :w], np.repeat(by[order[i : i + 4 * BATCH]], sizes)))
                drawn += draws
            if drawn:
                yield _blocks_of(local, float(drawn))

        part = words.where(F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)) == number)
        model = averaged(part.select("count", "tail", "ids"), learn, model)
    return model


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    held = fold(F.col(id_col), FOLDS) == HELD_FOLD
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    context = slim.sparkSession.sparkContext
    train = slim.where(~F.col("held_out"))

    counts = stash(training_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    room = total + distinct + 1
    most = stash(most_frequent(counts, frequent))
    near = {to_bytes(r["word"]): r["count"] for r in most.collect()}
    # the end is looked up in every text, so its count is always at hand
    ends = (counts.where("word = ''").first() or {"count": 0})["count"]
    vocab = Vocabulary(vocabulary)
    common = sorted((w for w in near if w), key=lambda w: (-near[w], w))
    name = distribute(Lexicon.compile(vocab, [" " + w.decode("utf-8", "replace") for w in common[:LEXICON]]), docs)
    head = {w: near[w] for w in common[:HEAD_WORDS]}
    words = stash(encoded(counts, name, head))
    first_counts, inner_counts = subword_counts(words, len(vocab.bytes_of))
    own, share = units_of(first_counts + inner_counts)
    by_unit = lambda c, end: np.bincount(own, c, UNITS) + np.where(np.arange(UNITS) == END, end + 0.1, 0)
    inner = train_inside_words(words, name, own, by_unit(inner_counts, total - ends), head, total - ends - sum(head.values()))
    known = context.broadcast(FrequentWords.of(most, name, own, share, inner, room))
    model = train_on_texts(train, name, own, by_unit(first_counts, ends), known)
    end_term = math.log10((ends + 1) / room)
    sent = context.broadcast((model.flat, inner.flat, own, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        flat, inside, own, share = sent.value
        net, table = AttentionModel(flat), WordTable(_lexicon(name), own, share, AttentionModel(inside), known.value)
        for part in pieces(batches, "text"):
            found = [words_of(t) for t in part.column("text").to_pylist()]
            words = [w for ws in found for w in ws]
            sizes = [len(ws) for ws in found]
            at = table.places(words)
            terms = table.terms[at]
            rare = np.isnan(terms)
            logs = window_logs(net, windows(table.first[at], table.last[at], np.array(sizes)), len(found))
            ends_at = np.cumsum([0, *sizes])
            where = np.flatnonzero(rare)
            cuts = np.searchsorted(where, ends_at)
            rows = {
                "n_tokens": pa.array([s + 1 for s in sizes], pa.int64()),
                "known": pa.array(_per_text((~rare).astype(np.int64), sizes), pa.int64()),
                "base": pa.array(_per_text(np.where(rare, 0, terms), sizes), pa.float64()),
                "score": pa.array(logs + _per_text(table.logs[at], sizes), pa.float64()),
                "rare": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array([words[i].decode("utf-8", "replace") for i in where.tolist()], pa.string())),
            }
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("held_out"), *rows.values()], names=["row", "doc_id", "held_out", *rows])

    kind = slim.schema["doc_id"].dataType.simpleString()
    scanned = stash(slim.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<string>"))
    asked = scanned.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    answered = asked.join(counts, "word", "left")
    far = answered.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(room)))).alias("far_base"), F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("far_known"))
    out = scanned.drop("rare").join(small_side(stash(far)), "row", "left")
    n_known = F.col("known") + F.coalesce("far_known", F.lit(0)) + F.lit(int(ends > 0))
    return out.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("far_base", F.lit(0.0)) + F.lit(end_term)).alias("base_score"), "score")
