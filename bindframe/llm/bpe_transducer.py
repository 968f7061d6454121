"""BPE encoding and decoding with a transducer lexicon.

The frequent words of the corpus (counted over all documents by Spark) are encoded once and
compiled into a minimal acyclic automaton: words share prefixes and suffixes, and the numbers
on its edges add up to a word's rank, which points at its ids. The automaton is one file of
plain arrays that Spark distributes and every Python worker memory-maps. Words outside it are
merged exactly, many at once, by the ranks of the vocabulary's merges. Texts are read whole.

Defined results: a null text counts as empty (no ids, an empty decoded text); the text of a
special token becomes its id, as in the library; repeated rows are encoded each for itself;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import bounded_batches, pieces, roomy_heap, spread, stash, text_or_empty, to_bytes

#: Words that the lexicon holds, at most.
LEXICON_WORDS = 50_000

#: Bytes from which a pre-token is merged by itself, with a heap of its pairs.
LONG = 512

#: Bytes of words that are merged side by side.
STEP_CELLS = 200_000

#: The fixed pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPLIT = regex.compile(PATTERN)
_HIGH = regex.compile("[Ԁ-\U0010ffff]")


def _unassigned() -> regex.Pattern:
    """Code points that Python's Unicode tables do not know: there the libraries' letter classes may differ."""
    points = (c for c in range(0x500, 0x32000) if unicodedata.category(chr(c)) == "Cn")
    spans = []
    for _, g in groupby(enumerate(points), lambda x: x[1] - x[0]):
        span = [c for _, c in g]
        spans.append(f"\\U{span[0]:08x}-\\U{span[-1]:08x}")
    return regex.compile("[" + "".join(spans) + "\\U000323b0-\\U0010ffff]")


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        back = {c: b for b, c in letters.items()}
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.single = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, with ranks as sums over edges.

    edge_key: state * 256 + byte, sorted; edge_to: the next state; edge_add: the words before
    that edge in its state; final: whether a word ends in a state. State 0 is the start.
    """
    known: dict[tuple, int] = {}
    edges: list[dict[int, int]] = [{}]
    ends = [False]
    path: list[tuple[int, int, int]] = []  # (state, byte, next state) of the last word, not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            state, byte, child = path.pop()
            key = (ends[child], tuple(edges[child].items()))
            edges[state][byte] = known.setdefault(key, child)

    before = b""
    for word in words:
        common = next((i for i, (x, y) in enumerate(zip(before, word, strict=False)) if x != y), min(len(before), len(word)))
        share(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            edges.append({})
            ends.append(False)
            child = len(edges) - 1
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        ends[state] = True
        before = word
    share(0)
    order, place, counts = [], {}, {}
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            counts[state] = ends[state] + sum(counts[c] for c in edges[state].values())
        elif state not in place:
            place[state] = len(order)
            order.append(state)
            stack.append((state, True))
            stack += [(c, False) for c in edges[state].values()]
    key, to, add = [], [], []
    for state in order:
        total = int(ends[state])
        for byte, child in sorted(edges[state].items()):
            key.append(place[state] * 256 + byte)
            to.append(place[child])
            add.append(total)
            total += counts[child]
    return {"edge_key": np.array(key, np.int64), "edge_to": np.array(to, np.int32), "edge_add": np.array(add, np.int32), "final": np.array([ends[s] for s in order], np.uint8)}


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max(initial=1))), np.uint8)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, sizes


def _by_width(words: list[bytes]) -> Iterator[np.ndarray]:
    """Positions of words in blocks of like length, so that a few long ones don't widen every row."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        stop = int(np.searchsorted(sizes[order], max(8, 2 * sizes[order[start]]), side="right"))
        stop = min(max(stop, start + 1), start + max(1, 4_000_000 // int(sizes[order[stop - 1]] + 1)))
        yield order[start:stop]
        start = stop


class Lexicon:
    """The compiled file: automaton, the ids of its words, and what merging and decoding need."""

    NAMES = ("edge_key", "edge_to", "edge_add", "final", "ids_start", "ids", "single", "pair_key", "pair_rank", "rank_to", "token_start", "token_bytes")

    def __init__(self, arrays: dict[str, np.ndarray], special: dict[str, int], vocabulary: str = ""):
        self.a, self.special, self.vocabulary = arrays, special, vocabulary
        self.byte_ranks: np.ndarray | None = None
        self.n_tokens = len(arrays["token_start"]) - 1
        blob, starts = arrays["token_bytes"].tobytes(), arrays["token_start"].tolist()
        self.bytes_of = [blob[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @classmethod
    def compile(cls, vocabulary: Vocabulary, words: list[str]) -> Lexicon:
        key = vocabulary.left * len(vocabulary.bytes_of) + vocabulary.right
        order = np.argsort(key)
        tokens = np.cumsum([0, *map(len, vocabulary.bytes_of)])
        arrays = {"single": vocabulary.single, "pair_key": key[order], "pair_rank": order.astype(np.int32), "rank_to": vocabulary.made, "token_start": tokens.astype(np.int64), "token_bytes": np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)}
        arrays |= minimal_automaton([]) | {"ids_start": np.zeros(1, np.int64), "ids": np.zeros(0, np.int32)}
        plain = cls(arrays, vocabulary.special)
        raw = sorted({to_bytes(w) for w in words} - {b""})
        counts, ids = plain.merge(raw)
        return cls(arrays | minimal_automaton(raw) | {"ids_start": np.cumsum([0, *counts.tolist()]).astype(np.int64), "ids": ids}, vocabulary.special)

    def save(self, path: str) -> None:
        head, at = {}, 0
        for name in self.NAMES:
            head[name] = [str(self.a[name].dtype), len(self.a[name]), at]
            at += -(-self.a[name].nbytes // 8) * 8
        text = json.dumps({"arrays": head, "special": self.special}).encode()
        text += b" " * (-len(text) % 8)
        with open(path, "wb") as f:
            f.write(len(text).to_bytes(8, "little") + text)
            for name in self.NAMES:
                raw = np.ascontiguousarray(self.a[name]).tobytes()
                f.write(raw + b"\0" * (-len(raw) % 8))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(whole[:8].tobytes(), "little")
        head = json.loads(whole[8 : 8 + n].tobytes())
        arrays = {name: whole[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in head["arrays"].items()}
        return cls(arrays, head["special"])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the automaton, -1 for words that are not in it."""
        out = np.full(len(words), -1, np.int64)
        key = self.a["edge_key"]
        if not len(key):
            return out
        for rows in _by_width(words):
            block, sizes = _matrix([words[i] for i in rows])
            state, rank = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            alive = np.arange(len(rows))
            for column in range(block.shape[1]):
                alive = alive[sizes[alive] > column]
                want = state[alive] * 256 + block[alive, column]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                found = key[at] == want
                lost, alive, at = alive[~found], alive[found], at[found]
                state[lost] = -1
                state[alive] = self.a["edge_to"][at]
                rank[alive] += self.a["edge_add"][at]
            good = (state >= 0) & (sizes > 0)
            good[good] = self.a["final"][state[good]] > 0
            out[rows[good]] = rank[good]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: the number of ids of each, and all ids in order.

        In each round every word makes its best merge (lowest rank, then leftmost), until none has one.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        counts, flat, order = np.zeros(len(words), np.int64), [], []
        none = len(self.a["rank_to"])
        for i in (i for i, w in enumerate(words) if len(w) >= LONG):
            flat.append(self.merge_long(words[i]))
            counts[i] = len(flat[-1])
            order.append(np.array([i]))
        short = np.flatnonzero(np.fromiter((len(w) < LONG for w in words), bool, len(words)))
        for rows in _by_width([words[i] for i in short]):
            rows = short[rows]
            block, sizes = _matrix([words[i] for i in rows])
            step = max(1, STEP_CELLS // block.shape[1])
            for i in range(0, len(rows), step):
                ids = self._merge_block(block[i : i + step], sizes[i : i + step])
                real = ids >= 0
                counts[rows[i : i + step]] = real.sum(1)
                flat.append(ids[real])
            order.append(rows)
        order, flat = np.concatenate(order), np.concatenate(flat).astype(np.int32)
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return counts, flat[spread(first, counts)]

    def _merge_block(self, block: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of words (rows of bytes), each at the place of its first byte, -1 elsewhere.

        Places go down and words across, with a row of no places at the end. `best` holds a pair's rank and
        place in one number, so the least of a word's column is its next merge; merged places are linked over.
        """
        n, width = block.shape
        none = len(self.a["rank_to"])
        kind = np.int32 if none < 1 << 21 else np.int64
        out = np.full((n, width), -1, np.int32)
        words, places = np.arange(n), np.arange(width + 1)
        ids = np.full((width + 1, n), -1, np.int32)
        ids[:width] = np.where(places[:width, None] < sizes, self.a["single"][block.T], -1)
        right, left = (np.repeat(x.astype(np.int32)[:, None], n, 1) for x in (np.minimum(places + 1, width), places - 1))
        left[0] = width
        best = np.full((width + 1, n), none, kind)
        pairs = places[: width - 1, None] + 1 < sizes
        best[: width - 1][pairs] = self._byte_ranks()[block[:, :-1].T[pairs], block[:, 1:].T[pairs]]
        best *= LONG
        best += places.astype(kind)[:, None]
        while True:
            least = best.min(0)
            active = np.flatnonzero(least < none * LONG)
            if 2 * len(active) <= len(words):
                out[words] = ids[:width].T
                if not len(active):
                    return out
                words, least = words[active], least[active]
                ids, right, left, best = (x[:, active] for x in (ids, right, left, best))
                active = np.arange(len(words))
            least = least[active]
            at, made = least % LONG, self.a["rank_to"][least // LONG]
            gone = right[at, active]
            after, before = right[gone, active], left[at, active]
            ids[at, active], ids[gone, active] = made, -1
            right[at, active], left[after, active] = after, at
            ranks = self._pair_ranks(np.concatenate([made, ids[before, active]]), np.concatenate([ids[after, active], made])).astype(kind) * LONG
            best[gone, active] = none * LONG
            best[at, active], best[before, active] = ranks[: len(at)] + at.astype(kind), ranks[len(at) :] + before.astype(kind)
            best[width] = none * LONG

    def _byte_ranks(self) -> np.ndarray:
        """The rank of merging each two bytes."""
        if self.byte_ranks is None:
            first, second = np.divmod(np.arange(1 << 16), 256)
            self.byte_ranks = self._pair_ranks(self.a["single"][first].astype(np.int64), self.a["single"][second].astype(np.int64)).reshape(256, 256)
        return self.byte_ranks

    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact BPE of one long word: a heap of pairs (rank, place) over a linked list, n log n steps."""
        ids = self.a["single"][np.frombuffer(word, np.uint8)].astype(np.int64)
        n, none = len(ids), len(self.a["rank_to"])
        ranks = self._pair_ranks(ids[:-1], ids[1:])
        found = np.flatnonzero(ranks < none)
        heap = list(zip(ranks[found].tolist(), found.tolist(), strict=True))
        heapify(heap)
        own, pair = ids.tolist(), ranks.tolist()
        right, left, known = [*range(1, n), -1], list(range(-1, n - 1)), {}

        def look(i: int) -> None:
            """The rank of the pair that begins at i goes to the heap."""
            j = right[i]
            rank = none
            if j >= 0:
                key = own[i], own[j]
                rank = known.get(key)
                if rank is None:
                    rank = known[key] = int(self._pair_ranks(np.array([key[0]]), np.array([key[1]]))[0])
                if rank < none:
                    heappush(heap, (rank, i))
            if i < n - 1:
                pair[i] = rank

        while heap:
            rank, i = heappop(heap)
            if own[i] < 0 or right[i] < 0 or pair[i] != rank:
                continue
            j = right[i]
            own[i], own[j] = int(self.a["rank_to"][rank]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            look(i)
            if left[i] >= 0:
                look(left[i])
        return np.array([x for x in own if x >= 0], np.int64)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, elementwise; the number of ranks where there is no such merge."""
        out = np.full(a.shape, len(self.a["rank_to"]), np.int64)
        real = (a >= 0) & (b >= 0)
        want = a[real].astype(np.int64) * self.n_tokens + b[real]
        at = np.minimum(np.searchsorted(self.a["pair_key"], want), len(self.a["pair_key"]) - 1)
        out[real] = np.where(self.a["pair_key"][at] == want, self.a["pair_rank"][at], len(self.a["rank_to"]))
        return out

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in order: from the automaton, merged for the rest."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        ranks = self.ranks(words)
        starts = self.a["ids_start"]
        known = np.maximum(ranks, 0)
        counts = starts[known + 1] - starts[known] if len(starts) > 1 else np.zeros(len(words), np.int64)
        unseen = np.flatnonzero(ranks < 0)
        own_counts, own = self.merge([words[i] for i in unseen])
        first = np.where(ranks >= 0, starts[np.minimum(known, len(starts) - 1)], 0)
        counts = counts.copy()
        counts[unseen] = own_counts
        first[unseen] = len(self.a["ids"]) + np.cumsum(own_counts) - own_counts
        both = np.concatenate([self.a["ids"], own])
        return counts, both[spread(first, counts)]


class Encoder:
    """Encodes texts by a lexicon; keeps a memo of words, bounded in words and characters."""

    def __init__(self, lexicon: Lexicon, memo_words: int = 300_000, memo_chars: int = 16_000_000):
        self.lexicon, self.memo_words, self.memo_chars = lexicon, memo_words, memo_chars
        self.unassigned = _unassigned()
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.first, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if _HIGH.search(text) and self.unassigned.search(text):
            from tokenizers.pre_tokenizers import ByteLevel

            return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def units(self, text: str) -> list[str]:
        """Pre-tokens; special tokens stand as they are, after a NUL mark that no pre-token of them has."""
        split = self.lexicon.split_special
        if split is None or not any(s in text for s in self.lexicon.special):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(split.split(text)):
            out += ["\0special" + part] if i % 2 else self.words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids start (one more entry than texts)."""
        units: list[str] = []
        n_units = []
        for text in texts:
            found = self.units(text)
            units += found
            n_units.append(len(found))
        at = self.places(units)
        counts = self.counts[at]
        ids = self.ids[spread(self.first[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.concatenate([[0], np.cumsum(n_units)]).astype(np.int64)]

    def places(self, units: list[str]) -> np.ndarray:
        """Each unit's place in the memo (its ids are `counts` long from `first`), learnt where new."""
        if len(self.memo) > self.memo_words or self.chars > self.memo_chars:
            self.reset()
        at = np.fromiter(map(self.memo.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self.learn(list(dict.fromkeys(units[i] for i in missing)))
            at[missing] = [self.memo[units[i]] for i in missing]
        return at

    def learn(self, new: list[str]) -> None:
        """Put the ids of new units into the memo."""
        specials = [u for u in new if u.startswith("\0special") and u[8:] in self.lexicon.special]
        marks = set(specials)
        plain = [u for u in new if u not in marks]
        counts, ids = self.lexicon.ids_of([to_bytes(u) for u in plain])
        counts = np.concatenate([counts, np.ones(len(specials), np.int64)])
        ids = np.concatenate([ids, np.array([self.lexicon.special[u[8:]] for u in specials], np.int32)])
        start = len(self.memo)
        self.memo.update(zip([*plain, *specials], range(start, start + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.lexicon.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, count) of the white-space separated words of all texts; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "count"])
            counts.clear()
            return out

        for part in pieces(batches, "text"):
            for text in part.column("text").to_pylist():
                counts.update(to_bytes(text).split())
            if len(counts) > flush:
                yield rows()
        yield rows()

    return bounded_batches(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of counts(word, count) with the highest counts, at most `most`: a bounded set, so it may come to the driver.

    A histogram over count classes (eight to an octave) gives the lowest class down to which all
    words fit, so that no task has to send a list of its own best words.
    """
    classed = counts.withColumn("class", F.floor(F.log2("count") * 8).cast("int"))
    total, lowest = 0, 1 << 20
    for row in sorted(classed.groupBy("class").agg(F.count("*").alias("words")).collect(), reverse=True):
        total += row["words"]
        if total > most:
            break
        lowest = row["class"]
    return classed.where(F.col("class") >= lowest).drop("class")


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, at most `most`."""
    counts = stash(word_counts(docs, text_col).where("length(word) <= 64"))
    return sorted(r["word"] for r in most_frequent(counts, most).select("word").collect())


def distribute(lexicon: Lexicon, df: DataFrame) -> str:
    """Hand a lexicon's file to Spark, which brings it to every executor; returns the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    lexicon.save(path)
    df.sparkSession.sparkContext.addFile(path)
    return name


def build_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the lexicon for a corpus, hand its file to Spark, and return the file's name."""
    words: dict[str, None] = {}
    for word in frequent_words(docs, most, text_col):
        words.update(dict.fromkeys(_SPLIT.findall(" " + word)))
    return distribute(Lexicon.compile(Vocabulary(vocabulary), list(words)), docs)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This Python worker's encoder over a distributed lexicon file, memory-mapped once."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(Lexicon.load(SparkFiles.get(name)))
    return _ENCODERS[name]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """Encode and decode every text.

    Returns (doc_id, n_tokens, ids array<int>, decoded string), or with digests (doc_id,
    n_tokens, ids_sha256, decoded_sha256), hashed in the tasks so that ids need not leave them.
    """
    name = build_lexicon(docs, vocabulary, most, text_col)
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        coder = encoder(name)
        for part in pieces(batches, "text"):
            ids, starts = coder.encode(part.column("text").to_pylist())
            sizes = pa.array(np.diff(starts), pa.int64())
            spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            decoded = [coder.decode(ids[a:b]) for a, b in spans]
            if digests:
                raw = ids.astype("<u4")
                columns = [pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()), pa.array([hashlib.sha256(to_bytes(t)).hexdigest() for t in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
        coder.reset()

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))


