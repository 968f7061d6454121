"""Quality rules with host-level verdicts.

Every text is measured whole, in the scan. Rule failures are counted by host (map-side
partial counts), each host's failure rates are shrunk with a beta prior that is fitted to
all hosts by moments, and the verdicts on hosts are joined back to the documents.

Defined results: a null text counts as empty (it fails the length rule); a null host has no
verdict of its own; repeated rows are measured and counted each for itself; an empty table
gives an empty result; other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bindframe.llm._common import bounded_batches, free_name, pieces, small_side, stash, text_or_empty, to_bytes

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50

#: Bytes that begin a UTF-8 code point.
NOT_CONTINUATION = bytes(range(0x80)) + bytes(range(0xC0, 0x100))

#: A rule takes a function that gives a measure's column, and returns the condition that a bad document meets.
Rule = Callable[[Callable[[str], Column]], Column]
RULES: dict[str, Rule] = {
    "short": lambda m: m("n_words") < MIN_WORDS,
    "repetitive": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
}

#: What a host is judged by: the rules for documents, and two that turn down no document by itself,
#: more than a symbol for each ten words, and more than a repeated line for each twenty.
HOST_RULES: dict[str, Rule] = RULES | {
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "repeated_lines": lambda m: 20 * m("n_dup_lines") > m("n_words"),
}

#: A host is turned down when one of its shrunk failure rates is above this: most of its documents fail.
HOST_LIMIT = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_TYPES = ", ".join(f"{name} long" for name in MEASURES)


def measure_text(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one UTF-8 text."""
    words = raw.split()
    n = len(words)
    packed = b"".join(words)
    chars = len(packed) - len(packed.translate(None, NOT_CONTINUATION))
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        marked = bytearray(n)
        for i, w in enumerate(windows):
            first = seen.setdefault(w, i)
            if first != i:
                marked[first : first + 3] = marked[i : i + 3] = b"\x01\x01\x01"
        repeated = sum(marked)
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row per input row."""
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [measure_text(to_bytes(t)) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "host", *MEASURES])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, host string, {_TYPES}")


def host_rates(measured: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """One row per host: n, and for each rule its failures and its rate shrunk to the prior.

    The prior of a rule is a beta distribution with the mean of all rows and the variance
    between hosts that is left after the binomial share is taken off; without such variance
    the rates shrink to the mean.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(c(F.col).cast("long")).alias(f"{r}_failed") for r, c in rules.items()))
    hosts = stash(hosts)
    parts = [F.sum("n").alias("rows"), F.count("*").alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    for r in rules:
        f = F.col(f"{r}_failed").cast("double")
        parts += [F.sum(f).alias(f"{r}_f"), F.sum(f * f / F.col("n")).alias(f"{r}_ff")]
    total = hosts.agg(*parts).first()
    out = [F.col("host"), F.col("n")]
    for r in rules:
        a, b = _prior(total["rows"] or 0, total["hosts"] or 0, total["squares"] or 0.0, total[f"{r}_f"] or 0.0, total[f"{r}_ff"] or 0.0)
        out += [F.col(f"{r}_failed"), ((F.col(f"{r}_failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"{r}_rate")]
    return hosts.select(*out)


def _prior(rows: float, hosts: float, squares: float, failed: float, failed_sq: float, most: float = 1e6) -> tuple[float, float]:
    """Beta parameters by moments from sums over hosts; failed_sq is the sum of failures squared over rows."""
    if not rows:
        return 0.5, 0.5
    mean = failed / rows
    spread = mean * (1 - mean)
    room = rows - squares / rows
    if spread <= 0 or room <= 0:
        return mean + 1e-9, 1 - mean + 1e-9
    between = (failed_sq - rows * mean * mean - (hosts - 1) * spread) / room
    strength = min(most, max(spread / between - 1, 1.0)) if between > 0 else most
    return mean * strength, (1 - mean) * strength


def _rules(rules: dict[str, Rule] | None, host_rules: dict[str, Rule] | None) -> tuple[dict[str, Rule], dict[str, Rule]]:
    """Rules for documents and for hosts; where none are given, RULES and HOST_RULES."""
    if host_rules is None:
        host_rules = HOST_RULES if rules is None else rules
    return RULES if rules is None else rules, host_rules


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, Rule] | None = None, host_limit: float = HOST_LIMIT, host_rules: dict[str, Rule] | None = None) -> DataFrame:
    """(doc_id, host, measures, base_failed, host_failed, kept), one row per input row. Rules of one's own judge hosts too, unless host_rules are given."""
    rules, host_rules = _rules(rules, host_rules)
    measured = stash(measures(docs, id_col, text_col, host_col))
    failed: Column = F.lit(False)
    for rule in rules.values():
        failed = failed | rule(F.col)
    rates = host_rates(measured, host_rules)
    bad: Column = F.lit(False)
    for r in host_rules:
        bad = bad | (F.col(f"{r}_rate") > host_limit)
    verdicts = small_side(stash(rates.where(bad).select("host", F.lit(True).alias("host_failed"))))
    out = measured.join(verdicts, "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose document and host pass. Takes the options of quality_rules.

    The document rules are decided on the row itself; only the host verdicts are joined.
    """
    text_col, host_col = options.get("text_col", "text"), options.get("host_col", "source")
    rules, host_rules = _rules(options.get("rules"), options.get("host_rules"))
    limit = options.get("host_limit", HOST_LIMIT)
    mark = free_name(docs.columns, "_measured")
    slim = bounded_batches(docs)
    kinds = StructType([*docs.schema.fields, *(StructField(f"{mark}{m}", LongType()) for m in MEASURES)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            rows = [measure_text(to_bytes(t)) for t in batch.column(text_col).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=kinds.names)

    rates = host_rates(stash(measures(docs, text_col=text_col, host_col=host_col, id_col=options.get("id_col", "doc_id"))), host_rules)
    bad: Column = F.lit(False)
    for r in host_rules:
        bad = bad | (F.col(f"{r}_rate") > limit)
    verdicts = small_side(stash(rates.where(bad).select(F.col("host").alias(f"{mark}_host"))))
    inner = slim.mapInArrow(measured, kinds)
    for rule in rules.values():
        inner = inner.where(~rule(lambda name: F.col(f"{mark}{name}")))
    kept = inner.join(verdicts, F.col(host_col).cast("string") == F.col(f"{mark}_host"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
