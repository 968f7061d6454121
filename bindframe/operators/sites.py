"""Site calling over sequence tables (key, sequence): windows, k-mer tables, weight matrices, runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from bindframe.functions.calling import BASES, MOST_K, Caller, added_weights, digits, let, letters_of_batch, number_array, texts_of, window_codes, windows_of_batch, windows_of_letters
from bindframe.functions.sequences import reverse_complement


def kmer_windows(df: DataFrame, k: int) -> DataFrame:
    """K1: (key, start, kmer) for each window, start from 0; none where the sequence is shorter."""
    starts = F.expr(f"explode(sequence(0, length(sequence) - {k}))")
    return df.where(F.length("sequence") >= k).select("key", "sequence", starts.alias("start")).select("key", "start", F.expr(f"substring(sequence, start + 1, {k})").alias("kmer"))


def kmer_counts(df: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of the windows of df(sequence), counted by their codes within each task; a k-mer has a row for each task that met it. k up to MOST_K."""
    if k > MOST_K:
        raise ValueError(f"k-mers are counted up to k = {MOST_K}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, others = np.zeros(4**k, np.int64), Counter()
        for batch in batches:
            texts = batch.column(0)
            codes, sizes = windows_of_batch(texts, k)
            total += np.bincount(codes[codes >= 0], minlength=4**k)
            odd = np.flatnonzero(codes < 0)
            if len(odd):
                # windows with other signs than bases
                rows = np.searchsorted(np.cumsum(sizes), odd, side="right")
                starts = odd - (np.cumsum(sizes) - sizes)[rows]
                others.update(texts[i].as_py()[j : j + k] for i, j in zip(rows.tolist(), starts.tolist(), strict=True))
        met = np.flatnonzero(total)
        kmers = ["".join(BASES[i >> 2 * (k - 1 - j) & 3] for j in range(k)) for i in met.tolist()]
        yield pa.RecordBatch.from_pydict({"kmer": pa.array([*kmers, *others], pa.string()), "n": pa.array([*total[met].tolist(), *others.values()], pa.int64())})

    return df.select("sequence").mapInArrow(count, "kmer string, n long")


def kmer_lookup(windows: DataFrame, scores: DataFrame, default: float | None = None) -> DataFrame:
    """Windows with their score(kmer, score); without a default those that the table lacks go. The table is one row a k-mer."""
    if default is None:
        return windows.join(F.broadcast(scores), "kmer")
    return windows.join(F.broadcast(scores), "kmer", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def escore_profile(df: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """K2: (key, position, start, kmer, score), position = start + (k + 1) div 2."""
    return kmer_lookup(kmer_windows(df, k), scores).select("key", (F.col("start") + (k + 1) // 2).alias("position"), "start", "kmer", "score")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, gap: int = 0, least: int = 1) -> DataFrame:
    """Runs of flagged rows; rows whose order is at most gap + 1 apart share one. (keys, first, last, n)"""
    by = W.partitionBy(*keys).orderBy(order)
    high = df.where(flag).withColumn("_new", F.coalesce((F.col(order) - F.lag(order).over(by) > gap + 1).cast("int"), F.lit(1)))
    marked = high.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def specific_regions(profile: DataFrame, cutoff: float, gap: int = 0) -> DataFrame:
    """K3: at least two windows strictly above the cutoff, with up to `gap` low ones between; escorelength adds the tail.

    With m low windows behind a region (to the next high one or the end), the tail is gap where m > gap, else max(m - 1, 0).
    """
    found = runs(profile, ["key"], "start", F.col("score") > cutoff, gap)
    ends = profile.groupBy("key").agg(F.max("start").alias("_end"))
    by = W.partitionBy("key").orderBy("first")
    low = F.coalesce(F.lead("first").over(by) - 1, F.col("_end")) - F.col("last")
    tail = F.when(low > gap, F.lit(gap)).otherwise(F.greatest(low - 1, F.lit(0)))
    return found.join(ends, "key").withColumn("escorelength", F.col("n") + tail).where("n >= 2").select("key", F.col("first").alias("startpos"), "escorelength", "n")


def regions(scores: Column, cutoff: Column, gap: Column, centre: int) -> Column:
    """K3 inside a row: the regions (begin, end) of a profile for any cutoff and gap.

    Highs at most gap + 1 apart share a region, two make one; begin is the position of its first high,
    and end goes behind it by the number of highs and the tail that `specific_regions` adds.
    """
    last = F.size(scores) - 1

    def from_highs(highs: Column) -> Column:
        numbers = F.filter(F.transform(highs, lambda h, i: F.when((i == 0) | (h - F.get(highs, i - 1) > gap + 1), i)), lambda x: x.isNotNull())

        def from_firsts(firsts: Column) -> Column:
            def one(i: Column, r: Column) -> Column:
                behind = F.coalesce(F.get(firsts, r + 1), F.size(highs))
                low = F.coalesce(F.get(highs, behind) - 1, last) - F.get(highs, behind - 1)
                n = behind - i
                begin = F.get(highs, i) + centre
                return F.struct(n.alias("n"), begin.alias("begin"), (begin + n + F.when(low > gap, gap).otherwise(F.greatest(low - 1, F.lit(0)))).alias("end"))

            return F.filter(F.transform(firsts, one), lambda x: x["n"] >= 2)

        return let(numbers, from_firsts)

    return let(F.filter(F.transform(scores, lambda s, i: F.when(s > cutoff, i)), lambda x: x.isNotNull()), from_highs)


def score_table(scores: DataFrame, k: int, default: float | None = None) -> tuple[float | None, ...]:
    """The 4^k scores of a k-mer table in the order of codes; k-mers it lacks get the default. The table is bounded by 4^k rows, k up to MOST_K."""
    if k > MOST_K:
        raise ValueError(f"tables of k-mers are read whole up to k = {MOST_K}")
    found = {r.kmer: r.score for r in scores.where(F.length("kmer") == k).where(F.col("kmer").rlike("^[ACGT]+$")).groupBy("kmer").agg(F.max("score").alias("score")).collect()}
    return tuple(found.get("".join(kmer), default) for kmer in product(BASES, repeat=k))


def region_scan(df: DataFrame, scores: DataFrame, k: int, cutoff: float, gap: int = 0) -> DataFrame:
    """K3 of K2 over whole sequences: (key, startpos, escorelength, n), every region found inside its row, without a window or a join.

    A table that lacks k-mers goes through `specific_regions`, since `escore_profile` has no window for them.
    """
    table = score_table(scores, k)
    if any(x is None for x in table):
        return specific_regions(escore_profile(df, scores, k), cutoff, gap)
    found = region_rows(df, Caller(k, table, cutoff), gap)
    return found.select("key", "startpos", "escorelength", "n")


def region_rows(df: DataFrame, caller: Caller, gap: int = 0) -> DataFrame:
    """df(sequence) with a row for each of K3's regions of the windows above the caller's threshold: startpos, escorelength, n. By numpy on batches of rows."""
    found = df.withColumn("_r", F.explode(caller.regions_on_batches(F.col("sequence"), gap)))
    return found.withColumns({"startpos": F.col("_r.begin"), "escorelength": (F.col("_r.end") - F.col("_r.begin")).cast("long"), "n": F.col("_r.n").cast("long")}).drop("_r")


def region_peaks(df: DataFrame, scores: DataFrame, k: int, cutoff: float, gap: int, matrix: Caller, reach: int = 3) -> DataFrame:
    """K13 on K3 and K4: (key, startpos, start, score), the best window of the matrix (better strand) in each region of df(key, sequence) or up to `reach` outside; ties take the first.

    Everything is done in the row of a region, which keeps its sequence. The table of scores must have all k-mers.
    """
    found = region_rows(df.select("key", "sequence"), Caller(k, score_table(scores, k), cutoff), gap)
    best = matrix.best_on_batches(F.col("sequence"), F.col("startpos") - reach, F.col("startpos") + F.col("escorelength") + reach)
    return found.select("key", "startpos", F.explode(F.array(best)).alias("_b")).where("_b is not null").select("key", "startpos", "_b.start", "_b.score")


def pwm_score(kmer: Column, rows: list[dict[str, float]], product: bool = False) -> Column:
    """Sum of the weights (or product of the probabilities) of a k-mer's bases; other signs than ACGT give null."""
    total: Column = F.lit(1.0 if product else 0.0)
    for i, row in enumerate(rows):
        base = F.substring(kmer, i + 1, 1)
        w: Column = F.lit(None).cast("double")
        for b, x in row.items():
            w = F.when(base == b, F.lit(float(x))).otherwise(w)
        total = total * w if product else total + w
    return total


def pwm_scan(df: DataFrame, rows: list[dict[str, float]], zero_threshold: bool = False, above: float | None = None) -> DataFrame:
    """K4: each window's better strand; a tie goes to -1; mid = (start + start + length) div 2. With zero_threshold only scores above 0, or strictly above any other number.

    The scores of all 4^n windows are a table that each window's code is looked up in, by numpy on batches of rows, up to MOST_K bases.
    """
    n = len(rows)
    swap = {"A": "T", "C": "G", "G": "C", "T": "A"}
    back = [{swap[b]: x for b, x in row.items()} for row in reversed(rows)]
    above = 0.0 if zero_threshold and above is None else above
    if n <= MOST_K:
        forward, reverse = (np.array([added_weights(way, kmer) for kmer in product(BASES, repeat=n)]) for way in (rows, back))
        best, side = np.maximum(forward, reverse), np.where(forward > reverse, 1, -1)
        called = np.ones(4**n, bool) if above is None else best > above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, ends = letters_of_batch(batch.column("sequence"))
                codes, sizes = windows_of_letters(data, ends, n)
                behind = np.cumsum(sizes)
                hits = np.flatnonzero((codes >= 0) & called[codes])
                for at in range(0, len(hits), 100_000):
                    window = hits[at : at + 100_000]
                    row, code = np.searchsorted(behind, window, side="right"), codes[window]
                    start = window - (behind - sizes)[row]
                    columns = {"key": batch.column("key").take(pa.array(row)), "start": pa.array(start, pa.int32()), "site": texts_of(data[(ends[row] + start)[:, None] + np.arange(n)]), "score": pa.array(best[code]), "orientation": pa.array(side[code], pa.int32()), "mid": pa.array(start + n // 2, pa.int64())}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        kinds = {"start": IntegerType(), "site": StringType(), "score": DoubleType(), "orientation": IntegerType(), "mid": LongType()}
        return df.select("key", "sequence").mapInArrow(run, StructType([df.schema["key"], *(StructField(name, kind) for name, kind in kinds.items())]))
    both = kmer_windows(df, n).withColumn("_f", pwm_score(F.col("kmer"), rows)).withColumn("_r", pwm_score(F.col("kmer"), back))
    scored = both.select("key", "start", F.col("kmer").alias("site"), F.greatest("_f", "_r").alias("score"), F.when(F.col("_f") > F.col("_r"), 1).otherwise(-1).alias("orientation"), F.expr(f"start + {n} div 2").alias("mid"))
    return scored.where("score is not null" if above is None else F.col("score") > above)


def core_windows(df: DataFrame, core: str, width: int) -> DataFrame:
    """K6: windows of `width` whose centre is the core, or its reverse complement (the window is then turned); palindromes give both.

    Windows with an N have no row; another sign than ASCII counts as one.
    """
    return windows_of_cores(df, [core], width).drop("model")


#: What bases turn into on the other strand; other signs stay.
_TURNED = np.arange(256, dtype=np.uint8)
_TURNED[list(b"ACGTacgt")] = list(b"TGCAtgca")


def windows_of_cores(df: DataFrame, cores: list[str], width: int) -> DataFrame:
    """(key, start, orientation, window, model): K6 for several cores in one pass over df(key, sequence), by numpy on batches of rows; model is the core's place in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = letters_of_batch(batch.column("sequence"))
            for model, core in enumerate(cores):
                own, at = np.frombuffer(core.encode(), np.uint8), (width - len(core)) // 2
                for orientation, wanted in ((1, own), (-1, _TURNED[own[::-1]])):
                    hit = np.ones(max(0, len(data) - len(core) + 1), bool)
                    for j, letter in enumerate(wanted):
                        hit &= data[j : j + len(hit)] == letter
                    first = np.flatnonzero(hit) - at
                    row = np.searchsorted(ends, first + at, side="right") - 1
                    inside = (first >= ends[row]) & (first + width <= ends[row + 1])
                    first, row = first[inside], row[inside]
                    letters = data[first[:, None] + np.arange(width)]
                    plain = ~(letters == ord("N")).any(1)
                    first, row, letters = first[plain], row[plain], letters[plain]
                    if len(row):
                        texts = texts_of(letters if orientation == 1 else _TURNED[letters[:, ::-1]])
                        columns = {"key": batch.column("key").take(pa.array(row)), "start": pa.array(first - ends[row], pa.int32()), "orientation": pa.array(np.full(len(row), orientation), pa.int32()), "window": texts, "model": pa.array(np.full(len(row), model), pa.int32())}
                        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = StructType([df.schema["key"], *(StructField(n, StringType() if n == "window" else IntegerType()) for n in ("start", "orientation", "window", "model"))])
    return df.select("key", "sequence").mapInArrow(run, schema)


def alignment_sites(df: DataFrame, align: DataFrame, k: int, core: tuple[int, int], centre: int, cutoff: float) -> DataFrame:
    """K9: runs of windows at consecutive positions of a k-mer alignment(kmer, kposition, score), on both strands.

    A run needs two windows at least, and must reach over the core's positions [end - k, start].
    Scores below the cutoff count as absent. Returns (key, core_start, core_end, site_pos, orientation).

    A run reaches over the core if the window at its first needed position has that position in
    the alignment, the next window the next one, and so on to the last. So each k-mer's needed
    positions are bits of a number, looked up by the k-mer's code inside the row.
    """
    need_from, need_to = sorted((core[1] - k, core[0]))
    # with one needed position, the one before it or behind it makes the run two long
    low, high = (need_from, need_to) if need_to > need_from else (need_from - 1, need_to + 1)
    bits = align.where((F.col("score") >= cutoff) & F.col("kposition").between(low, high)).select("kmer", F.expr(f"shiftleft(1L, cast(kposition - ({low}) as int))").alias("bit")).groupBy("kmer").agg(F.bit_or("bit").alias("score"))
    table = number_array(score_table(bits, k, 0.0)).cast("array<long>")

    def reached(codes: Column) -> Column:
        has = lambda i, p: F.coalesce(F.shiftright(F.get(table, F.get(codes, i)), p - low).bitwiseAND(1), F.lit(0)) == 1
        need = lambda i: reduce(lambda a, b: a & b, (has(i + (p - need_from), p) for p in range(need_from, need_to + 1)))
        run = need if need_to > need_from else lambda i: need(i) & (has(i - 1, low) | has(i + 1, high))
        return F.filter(F.transform(codes, lambda _, i: F.when(run(i), i)), lambda x: x.isNotNull())

    strand = lambda seq, o: F.transform(let(let(digits(seq), lambda d: window_codes(d, k)), reached), lambda i: F.struct(F.lit(o).alias("orientation"), (F.lit(need_from) - i).alias("line")))
    hits = F.concat(strand(F.col("sequence"), 1), strand(reverse_complement(F.col("sequence")), -1))
    found = df.where(F.length("sequence") >= k).select("key", F.length("sequence").alias("size"), F.explode(hits).alias("h")).select("key", "size", "h.*")
    start, end, pos = (F.lit(x) - F.col("line") for x in (*core, centre))
    flip = F.col("orientation") == -1
    return found.select("key", F.when(flip, F.col("size") - end).otherwise(start).alias("core_start"), F.when(flip, F.col("size") - start).otherwise(end).alias("core_end"), F.when(flip, F.col("size") - 1 - pos).otherwise(pos).alias("site_pos"), "orientation")


#: Bytes of a dense table of support vectors that every task may hold.
VECTOR_BYTES = 64_000_000


def _vector_parts(vectors: DataFrame) -> int:
    """In how many parts the support vectors are taken, so that a dense table of one has VECTOR_BYTES at most."""
    size = vectors.agg(F.count_distinct("sv_id").alias("n"), F.coalesce(F.max("idx"), F.lit(0)).alias("wide")).first()
    return max(1, -(-size["n"] * (size["wide"] + 1) * 8 // VECTOR_BYTES))


def _dense_vectors(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A dense table (index x vector) of one part of the support vectors, and their coefficients."""
    rows = vectors.select("sv_id", "coef", "idx", "val").collect()  # VECTOR_BYTES bounds it
    ids = {v: i for i, v in enumerate(sorted({r.sv_id for r in rows}))}
    dense, coef = np.zeros((max((r.idx for r in rows), default=0) + 1, len(ids))), np.zeros(len(ids))
    for r in rows:
        dense[r.idx, ids[r.sv_id]] += r.val
        coef[ids[r.sv_id]] = r.coef
    return dense, coef


def kernel_score(windows: DataFrame, vectors: DataFrame, gamma: float, rho: float, linear: bool = False, kmax: int = 3) -> DataFrame:
    """K7: (key, start, window) scored against support vectors(sv_id, coef, idx, val) by one-hot positional k-mers; logistic of the decision value.

    Distinct windows are scored once, in blocks against a dense table of the vectors. A model whose
    table would be larger than VECTOR_BYTES is taken in parts of so many vectors, whose sums are added.
    """
    own = windows.select("window").distinct()
    parts = _vector_parts(vectors)
    decided = None
    for part in range(parts):
        values = _kernel_values(*_dense_vectors(vectors.where(F.pmod(F.hash("sv_id"), F.lit(parts)) == part)), gamma, linear, kmax)

        def run(batches: Iterator[pa.RecordBatch], values=values) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("window"), pa.array(values(batch.column("window").to_pylist()))], names=["window", "value"])

        one = own.mapInArrow(run, "window string, value double")
        decided = one if decided is None else decided.unionByName(one)
    total = decided.groupBy("window").agg((F.sum("value") - rho).alias("value"))
    return windows.join(total, "window").withColumn("score", 1 / (1 + F.exp(-F.col("value")))).drop("value")


def kernel_scores_of_cores(df: DataFrame, models: Sequence[tuple], width: int, kmax: int = 3) -> DataFrame:
    """(key, start, orientation, window, model, score): K7 of the windows of each model's core; models are (core, vectors, gamma, rho, linear).

    Models whose vectors fit one table are scored in one pass over the sequences, without a shuffle or a join: a task scores each distinct window
    of a batch once. Windows with other signs than bases have no score and no row.
    """
    found = windows_of_cores(df, [m[0] for m in models], width)
    large = [i for i, m in enumerate(models) if _vector_parts(m[1]) > 1]
    small = {i: _kernel_values(*_dense_vectors(m[1]), m[2], m[4], kmax) for i, m in enumerate(models) if i not in large}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, value = batch.column("model").to_numpy(), np.full(batch.num_rows, np.nan)
            for i, values in small.items():
                rows = np.flatnonzero(of == i)
                coded = batch.column("window").take(pa.array(rows)).dictionary_encode()
                if len(rows):
                    value[rows] = values(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            yield batch.append_column("value", pa.array(value))

    schema = StructType([*found.schema, StructField("value", DoubleType())])
    rho = F.get(F.array(*(F.lit(float(m[3])) for m in models)), F.col("model"))
    out = found.where(F.col("model").isin(list(small))).mapInArrow(run, schema).withColumn("score", 1 / (1 + F.exp(rho - F.col("value")))).drop("value")
    for i in large:
        own = kernel_score(found.where(F.col("model") == i), *models[i][1:], kmax)
        out = out.unionByName(own)
    return out.where(~F.isnan("score"))


def _kernel_values(dense: np.ndarray, coef: np.ndarray, gamma: float, linear: bool, kmax: int, block: int = 512):
    """A function of texts: each window's sum of coefficient times kernel over the vectors of a dense table (index x vector)."""
    squares = (dense * dense).sum(0)

    def values_of(texts: list[str]) -> np.ndarray:
        values = np.zeros(len(texts))
        by_length: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            by_length.setdefault(len(text), []).append(i)
        for length, places in by_length.items():
            for at in range(0, len(places), block):
                some = places[at : at + block]
                ranks = np.array([[BASES.find(c) for c in texts[i]] for i in some], np.int64).reshape(len(some), length)
                index = _positional(ranks, kmax)
                dot = np.zeros((len(some), dense.shape[1]))
                for column in index.T:
                    inside = (column >= 0) & (column < len(dense))
                    dot[inside] += dense[column[inside]]
                kernel = dot if linear else np.exp(-gamma * (index.shape[1] + squares - 2 * dot))
                values[some] = np.where((ranks < 0).any(1), np.nan, kernel @ coef)  # other signs than ACGT have no score
        return values

    return values_of


def _positional(ranks: np.ndarray, kmax: int) -> np.ndarray:
    """F12 for windows of one length as base ranks: the indexes of each window's positional k-mers."""
    length, columns, offset = ranks.shape[1], [], 0
    for k in range(1, kmax + 1):
        for p in range(length - k + 1):
            code = np.zeros(len(ranks), np.int64)
            for i in range(k):
                code = code * 4 + ranks[:, p + i]
            columns.append(offset + p * 4**k + code + 1)
        offset += max(0, length - k + 1) * 4**k
    return np.stack(columns, 1) if columns else np.zeros((len(ranks), 0), np.int64)


def positional_index(df: DataFrame, col: str, kmax: int = 3) -> DataFrame:
    """(col, idx): index of each positional k-mer: those of smaller k come first, then position * 4^k + rank + 1."""
    parts = None
    for k in range(1, kmax + 1):
        offset = F.lit(0).cast("long")
        for j in range(1, k):
            offset = offset + (F.length(col) - j + 1) * 4**j
        rank = " + ".join(f"(locate(substring(w, {i + 1}, 1), 'ACGT') - 1) * {4 ** (k - 1 - i)}" for i in range(k))
        part = df.where(F.length(col) >= k).select(col, offset.alias("offset"), F.expr(f"posexplode(transform(sequence(0, length({col}) - {k}), i -> substring({col}, i + 1, {k})))").alias("p", "w"))
        part = part.select(col, (F.col("offset") + F.col("p") * 4**k + F.expr(rank) + 1).alias("idx"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def site_pairs(sites: DataFrame) -> DataFrame:
    """Sequences with exactly two sites(key, pos, score) as one row, in order of position; by sums of each key, so that no rows are sorted."""
    ends = [F.min("pos").alias("pos_1"), F.min_by("score", "pos").alias("score_1"), F.max("pos").alias("pos_2"), F.max_by("score", "pos").alias("score_2")]
    return sites.groupBy("key").agg(F.count("*").alias("_n"), *ends).where("_n = 2").drop("_n").withColumn("distance", F.col("pos_2") - F.col("pos_1"))


def single_site(sites: DataFrame) -> DataFrame:
    """Keys with exactly one site, and its position."""
    return sites.groupBy("key").agg(F.count("*").alias("_n"), F.min("pos").alias("pos")).where("_n = 1").drop("_n")


def factor_order(first: DataFrame, second: DataFrame) -> DataFrame:
    """K17: 'er' where the first factor's single site lies left of the second's, else 're'."""
    both = single_site(first).withColumnRenamed("pos", "pos_1").join(single_site(second).withColumnRenamed("pos", "pos_2"), "key")
    return both.withColumn("ori", F.when(F.col("pos_1") < F.col("pos_2"), "er").otherwise("re"))


def strong_weak_order(pairs: DataFrame) -> DataFrame:
    """P10: the site with the higher score becomes str, the other wk; a tie takes the left one."""
    left = F.col("score_1") >= F.col("score_2")
    pick = lambda c, a, b: F.when(left, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    return pairs.select("key", "distance", pick("pos", 1, 2).alias("site_str_pos"), pick("score", 1, 2).alias("site_str_score"), pick("pos", 2, 1).alias("site_wk_pos"), pick("score", 2, 1).alias("site_wk_score"))


def centred_pair(pairs: DataFrame, centre: float = 18, within: float = 3) -> DataFrame:
    """The mean of the two positions lies within so many bases of the centre."""
    return pairs.where(F.abs((F.col("pos_1") + F.col("pos_2")) / 2 - centre) <= within)


def site_summary(sites: DataFrame) -> DataFrame:
    """Sites, first and last position, span and best score of each sequence."""
    return sites.groupBy("key").agg(F.count("*").alias("n_sites"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), (F.max("pos") - F.min("pos")).alias("span"), F.max("score").alias("best"))


def core_centred_training(df: DataFrame, width: int, cores: list[str]) -> DataFrame:
    """(window, score): windows with a core in the centre and the median score of the sequences that hold them."""
    at = (width - len(cores[0])) // 2 + 1
    cut = kmer_windows(df.select(F.struct("key", "score").alias("key"), "sequence"), width).where(F.substring("kmer", at, len(cores[0])).isin(cores))
    return cut.groupBy(F.col("kmer").alias("window")).agg(F.median("key.score").alias("score"))


def match_sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sites of two callers at the same place."""
    return a.select("key", "pos", F.col("score").alias("score_a")).join(b.select("key", "pos", F.col("score").alias("score_b")), ["key", "pos"])


def sites_in_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """sites(key, pos, ..) that a region(key, startpos, escorelength) holds, each once."""
    s, r = sites.alias("s"), regions.alias("r")
    return s.join(r, (F.col("s.key") == F.col("r.key")) & F.col("s.pos").between(F.col("r.startpos"), F.col("r.startpos") + F.col("r.escorelength")), "left_semi")
