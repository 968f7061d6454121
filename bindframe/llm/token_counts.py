"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves are blocks of pre-tokens with
their characters and tokens, inner nodes hold the sums. An edit re-encodes the pre-tokens it
touches, from the one that holds the character before it to the first old border behind it at
which old and new pre-tokens meet again, and updates the sums above the blocks concerned.
Pre-tokens depend on nothing further away, so the count equals that of the edited text.

Defined results: a null text counts as empty; edits are in characters of the original text and
must not overlap (those of a null or empty list change nothing); repeated rows are counted
each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.llm._common import bounded_batches, pieces, roomy_heap, text_or_empty
from bindframe.llm.bpe_transducer import LEXICON_WORDS, Encoder, build_lexicon, encoder

Edit = tuple[int, int, str]

#: Pre-tokens in a leaf when the tree is made.
BLOCK = 64

#: Personal data that the cleaning edits redact.
EMAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+\d[\d ().-]{7,}\d")


def cleaning_edits(text: str) -> list[Edit]:
    """Redactions of mail addresses and phone numbers, and removals of lines that repeat an earlier one."""
    out: list[Edit] = []
    seen: set[str] = set()
    start = 0
    for line in text.split("\n"):
        end = start + len(line)
        if line in seen and line.strip():
            out.append((start, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            if "@" in line:
                out += [(start + m.start(), start + m.end(), "<email>") for m in EMAIL.finditer(line)]
            if "+" in line:
                out += [(start + m.start(), start + m.end(), "<phone>") for m in PHONE.finditer(line)]
        start = end + 1
    out.sort()
    return [e for i, e in enumerate(out) if i == 0 or e[0] >= out[i - 1][1]]


def apply_edits(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


class PretokenTree:
    """Blocks of pre-tokens under a tree of sums of characters and tokens.

    A block holds its own text, so an edit copies no more than the blocks it touches; blocks that no
    edit touches stay slices of the arrays they came from.
    """

    def __init__(self, text: str, coder: Encoder, units: list[str] | None = None, state: tuple[np.ndarray, np.ndarray] | None = None):
        """From the text; or, with `state`, from the sizes and tokens that an earlier tree of this text has saved."""
        self.coder, self.source = coder, text
        self.sizes, self.tokens_of = self.measure(text, units)[1:] if state is None else state
        n = max(1, -(-len(self.sizes) // BLOCK))
        self.leaves = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)
        if len(self.sizes):
            cuts = np.arange(0, len(self.sizes), BLOCK)
            self.sums[self.leaves : self.leaves + n] = np.stack([np.add.reduceat(self.sizes, cuts), np.add.reduceat(self.tokens_of, cuts)], 1)
        self.offsets = np.append(0, np.cumsum(self.sums[self.leaves :, 0]))
        level = self.leaves
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2
        self.made: dict[int, tuple[str, list[int], list[int]]] = {}
        self.reencoded = 0

    def measure(self, text: str, units: list[str] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Units of a text (found here if not given), their characters, and their tokens."""
        units = self.coder.units(text) if units is None else units
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        if sizes.sum() != len(text):  # special tokens stand behind a mark
            sizes -= 8 * np.fromiter((u.startswith("\0special") and u[8:] in self.coder.lexicon.special for u in units), np.int64, len(units))
        at = self.coder.places(units)
        return units, sizes, self.coder.counts[at]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.block(i)[0] for i in range(self.leaves))

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and tokens of all pre-tokens, from which a tree of the present text can be made again."""
        own = [self.block(i) for i in range(self.leaves)]
        return np.array([x for b in own for x in b[1]], np.int64), np.array([x for b in own for x in b[2]], np.int64)

    def block(self, i: int) -> tuple[str, list[int], list[int]]:
        """The text of a block, and the characters and tokens of its pre-tokens."""
        if i not in self.made:
            part = slice(i * BLOCK, (i + 1) * BLOCK)
            self.made[i] = self.source[self.offsets[i] : self.offsets[i + 1]], self.sizes[part].tolist(), self.tokens_of[part].tolist()
        return self.made[i]

    def find(self, position: int) -> tuple[int, int]:
        """The block that holds a character, and the characters before that block."""
        node, before = 1, 0
        while node < self.leaves:
            left = int(self.sums[2 * node, 0])
            if position < before + left:
                node = 2 * node
            else:
                before += left
                node = 2 * node + 1
        return node - self.leaves, before

    def _unit(self, position: int) -> tuple[int, int, int, int]:
        """The unit that holds a character: its block, its number there, its first character, and the block's."""
        block, before = self.find(position)
        at, i, sizes = before, 0, self.block(block)[1]
        while i < len(sizes) - 1 and at + sizes[i] <= position:
            at += sizes[i]
            i += 1
        return block, i, at, before

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end of the current text and re-encode around them."""
        length = int(self.sums[1, 0])
        first, i, begin, before = self._unit(max(start - 1, 0))
        if begin and length:
            # where a run of blanks is cut depends on what follows it
            earlier = self._unit(begin - 1)
            low = earlier[2] - earlier[3]
            if self.block(earlier[0])[0][low : begin - earlier[3]].isspace():
                first, i, begin, before = earlier
        reach = 64
        while True:
            # the blocks from `first` on that hold the edit and some characters behind it
            blocks, stop = [first], before + len(self.block(first)[0])
            while stop < min(length, end + reach):
                blocks.append(self.find(stop)[0])
                stop += len(self.block(blocks[-1])[0])
            old = "".join(self.block(x)[0] for x in blocks)[begin - before :]
            piece = old[: start - begin] + new + old[end - begin :]
            units, sizes, tokens = self.measure(piece)
            borders = np.append(0, np.cumsum(sizes)).tolist()
            # the last two units of a cut piece may go on behind it
            sure = len(units) if stop == length else max(0, len(units) - 2)
            known = {b: n for n, b in enumerate(borders[: sure + 1])}
            shift, k, met = len(new) - (end - start), before, None
            for x, block in enumerate(blocks):
                for unit, size in enumerate([0, *self.block(block)[1]]):
                    k += size
                    if k >= end and k >= begin and k + shift - begin in known:
                        met = known[k + shift - begin], x, unit
                        break
                if met:
                    break
            if met or stop == length:
                break
            reach *= 4
        n, x, unit = met or (len(units), len(blocks) - 1, len(self.block(blocks[-1])[1]))
        self.reencoded += borders[n]
        kept, tail = self.block(first), self.block(blocks[x])
        rest = sum(tail[1][:unit])
        touched = blocks[: x + 1]
        for block in touched:
            self.made[block] = "", [], []
        self.made[first] = kept[0][: begin - before] + piece[: borders[n]] + tail[0][rest:], kept[1][:i] + sizes[:n].tolist() + tail[1][unit:], kept[2][:i] + tokens[:n].tolist() + tail[2][unit:]
        for block in touched:
            self.sums[self.leaves + block] = sum(self.made[block][1]), sum(self.made[block][2])
        level = sorted({(self.leaves + block) // 2 for block in touched} - {0})
        while level:
            for node in level:
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            level = sorted({node // 2 for node in level} - {0})


def counts_after(text: str, edits: list[Edit], coder: Encoder, units: list[str] | None = None) -> tuple[int, int, int]:
    """Tokens before and after the edits, and characters that were encoded again."""
    if not edits:
        at = coder.places(coder.units(text) if units is None else units)
        total = int(coder.counts[at].sum())
        return total, total, 0
    tree = PretokenTree(text, coder, units)
    before, shift = tree.tokens, 0
    for start, end, new in sorted(edits):
        tree.replace(start + shift, end + shift, new)
        shift += len(new) - (end - start)
    return before, tree.tokens, tree.reencoded


def edited_counts(docs: DataFrame, vocabulary: str, edits_col: str | None = None, find_edits: Callable[[str], list[Edit]] = cleaning_edits, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_edits, n_tokens, n_tokens_edited, n_chars_reencoded), one row per input row.

    Edits come from a column array<struct<start:int, end:int, text:string>>, or are found in each text.
    """
    name = build_lexicon(docs, vocabulary, most, text_col)
    edits = F.lit(None).cast("array<struct<start:int,end:int,text:string>>") if edits_col is None else F.col(edits_col)
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), edits.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy_heap()
        coder = encoder(name)
        for part in pieces(batches, "text"):
            rows, texts = [], part.column("text").to_pylist()
            found = [coder.units(t) for t in texts]
            coder.places([u for units in found for u in units])  # what is new in the piece is learnt at once
            for text, units, given in zip(texts, found, part.column("edits").to_pylist(), strict=True):
                own = find_edits(text) if edits_col is None else sorted((e["start"], e["end"], e["text"] or "") for e in given or ())
                rows.append((len(own), *counts_after(text, own, coder, units)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_edits", "n_tokens", "n_tokens_edited", "n_chars_reencoded"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_edits long, n_tokens long, n_tokens_edited long, n_chars_reencoded long")
