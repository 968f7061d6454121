"""Shapes along sequences, tests between labels, sites near flanks and in regions, selection of designed groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindframe.functions.sequences import reverse_complement
from bindframe.operators.curves import quantiles
from bindframe.operators.replicates import EXACT_BELOW, exact_greater, normal_tail, rank_test
from bindframe.operators.rows import SENTINEL, sub_select
from bindframe.operators.sites import alignment_sites, pwm_score, single_site
from bindframe.operators.tables import adjacent_similar, top_groups
from bindframe.sources.shared import saved

#: Parts of a group's value range, over which running totals go before they go over values.
BLOCKS = 1024


def expand_escores(short: DataFrame, k: int) -> DataFrame:
    """scores(kmer, score) of canonical k-mers for both strands: one row for each k-mer whose canonical form has a score."""
    back = short.select(reverse_complement(F.col("kmer")).alias("kmer"), "score").where(F.length("kmer") == k)
    return short.where(F.length("kmer") == k).select("kmer", "score").unionByName(back).distinct()


def genome_chunks(df: DataFrame, size: int) -> DataFrame:
    """(chr, chunk, bases): sequences(chr, seq) in chunks of one size."""
    return df.select("chr", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0))).alias("chunk", "bases"))


def fetch_sequences(intervals: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """intervals(name, chr, start_pos, end_pos, strand) with their bases; '-' is turned. What lies behind the end of chr is cut off."""
    asked = intervals.where("end_pos > start_pos and start_pos >= 0").withColumn("chunk", F.explode(F.expr(f"sequence(start_pos div {size}, (end_pos - 1) div {size})")))
    found = asked.withColumn("chunk", F.col("chunk").cast("int")).join(chunks, ["chr", "chunk"]).groupBy("name", "chr", "start_pos", "end_pos", "strand").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("_c"))
    text = F.substring(F.array_join(F.transform("_c", lambda x: x["bases"]), ""), F.expr(f"cast(start_pos % {size} + 1 as int)"), (F.col("end_pos") - F.col("start_pos")).cast("int"))
    cut = found.withColumn("_s", text).where("_s <> ''")
    return cut.select("name", "chr", "start_pos", "end_pos", "strand", F.when(F.col("strand") == "-", reverse_complement(F.col("_s"))).otherwise(F.col("_s")).alias("sequence"))


def call_sites_in_peaks(peaks: DataFrame, chunks: DataFrame, size: int, align: DataFrame, k: int, core: tuple[int, int], centre: int, cutoff: float) -> DataFrame:
    """K8: alignment sites of the bases of peaks, at genome positions: (name, chr, position, orientation)."""
    calls = alignment_sites(fetch_sequences(peaks, chunks, size).select(F.col("name").alias("key"), "sequence"), align, k, core, centre, cutoff)
    placed = calls.withColumnRenamed("key", "name").join(peaks, "name")
    return placed.select("name", "chr", (F.col("start_pos") + F.col("site_pos")).alias("position"), "orientation")


def align_to_site(df: DataFrame) -> DataFrame:
    """Each sequence shifted so that its site 1 stands at the most frequent position (the smallest of equals), filled with bases from a hash of its key."""
    modal = df.groupBy("pos_1").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "pos_1").limit(1).select(F.col("pos_1").alias("_to"))
    shift = F.expr("cast(_to - pos_1 as int)")
    fill = F.translate(F.expr("repeat(md5(key), 1 + cast(abs(_to - pos_1) as int) div 32)"), "0123456789abcdef", "ACGTACGTACGTACGT")
    right = F.concat(F.substring(fill, F.lit(1), shift), F.substring("sequence", F.lit(1), F.length("sequence") - shift))
    left = F.concat(F.substring("sequence", 1 - shift, F.length("sequence")), F.substring(fill, F.lit(1), -shift))
    return df.join(F.broadcast(modal)).select("key", F.col("_to").alias("pos_1"), F.when(shift >= 0, right).otherwise(left).alias("sequence"))


def alignment_pwm_sites(calls: DataFrame, df: DataFrame, pwm: list[dict[str, float]], flank: int) -> DataFrame:
    """calls(key, core_start, ..) with the matrix score and strand at the core; where one site's window is cut short, its whole sequence gives none."""
    window = F.substring("sequence", (F.col("core_start") - flank + 1).cast("int"), F.lit(len(pwm)))
    held = calls.join(df.select("key", "sequence"), "key").withColumn("_w", window)
    held = held.withColumn("_whole", F.min((F.col("core_start") >= flank) & (F.length("_w") == len(pwm))).over(W.partitionBy("key"))).where("_whole")
    forward, back = pwm_score(F.col("_w"), pwm), pwm_score(reverse_complement(F.col("_w")), pwm)
    return held.select("key", "core_start", "orientation", F.greatest(forward, back).alias("score"), F.when(forward > back + 1e-9, "+").otherwise("-").alias("strand"))


def sites_with_flanks(df: DataFrame, caller: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """sites(key, pos, score) called on head + sequence + tail, at positions of the sequence; those in the flanks go."""
    joined = caller(df.select("key", F.concat("head", "sequence", "tail").alias("sequence")))
    sizes = df.select("key", F.length("head").alias("_n"), F.length("sequence").alias("_size"))
    return joined.join(sizes, "key").withColumn("pos", F.col("pos") - F.col("_n")).where("pos >= 0 and pos < _size").select("key", "pos", "score")


def peak_in_region(regions: DataFrame, scan: DataFrame, reach: int = 3) -> DataFrame:
    """The best window(key, start, score) of each region(key, startpos, escorelength), up to `reach` outside; ties take the first."""
    near = regions.select("key", "startpos", "escorelength").join(scan.select("key", "start", "score"), "key").where(F.col("start").between(F.col("startpos") - reach, F.col("startpos") + F.col("escorelength") + reach))
    return near.groupBy("key", "startpos").agg(F.min(F.struct((-F.col("score")).alias("s"), "start")).alias("b")).select("key", "startpos", "b.start", (-F.col("b.s")).alias("score"))


def valid_pairs(pairs: DataFrame, profile: DataFrame, low: float, near: int = 10, far: int = 20) -> DataFrame:
    """Pairs of sites `near` to `far` apart with a profile score below `low` between them."""
    p, q = pairs.where(F.col("distance").between(near, far)).alias("p"), profile.where(F.col("score") < low).alias("q")
    return p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("q.position") > F.col("p.pos_1")) & (F.col("q.position") < F.col("p.pos_2")), "left_semi")


def shape_bands(df: DataFrame) -> DataFrame:
    """Quartiles of shapes(label, shape, values) at each position; gaps (nulls) do not count."""
    cells = df.select("label", "shape", F.posexplode("values").alias("position", "value"))
    return quantiles(cells, ["shape", "position", "label"], "value", {"low": 0.25, "median": 0.5, "high": 0.75})


def value_rank_test(df: DataFrame, keys: list[str], first: str, second: str, times: str | None = None) -> DataFrame:
    """Mann-Whitney of few large groups (keys, kind, value): (keys, m, n, u, p_greater, p_less): exact below 50 values a side without ties, else by the normal approximation with tie and continuity correction.

    Rows are counted by value first; running totals go over blocks of the value range, then within
    them, so that no group is one task. p is 1 where all values are equal. Null values do not count.
    `times` names a column for how many rows one stands; what is counted by value is written once.
    """
    own = df.where(F.col("kind").isin(first, second) & F.col("value").isNotNull())
    n = F.lit(1) if times is None else F.col(times)
    counts = saved(own.groupBy(*keys, "value").agg(F.sum(F.when(F.col("kind") == first, n).otherwise(0)).cast("long").alias("_a"), F.sum(n).cast("long").alias("_t")))
    ends = counts.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    block = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * BLOCKS)).otherwise(F.lit(0))
    blocked = counts.join(ends, keys).withColumn("_block", block).drop("_low", "_high")
    sizes = blocked.groupBy(*keys, "_block").agg(F.sum("_t").alias("_s"))
    before = sizes.select(*keys, "_block", (F.sum("_s").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_s")).alias("_before"))
    inner = W.partitionBy(*keys, "_block").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = blocked.join(before, [*keys, "_block"]).withColumn("_r", F.col("_before") + F.sum("_t").over(inner) - (F.col("_t") - 1) / 2)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("_a").alias("m"), (F.sum("_t") - F.sum("_a")).alias("n"), F.sum(F.col("_a") * F.col("_r")).alias("_sum"), F.sum(t * (t * t - 1)).alias("_ties"))
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    total, u = m + n, F.col("_sum") - m * (m + 1) / 2
    sigma = F.sqrt(m * n / 12 * (total + 1 - F.col("_ties") / (total * (total - 1))))
    tail = lambda x: F.when(sigma > 0, normal_tail((x - m * n / 2 - 0.5) / F.nullif(sigma, F.lit(0.0)))).otherwise(1.0)
    exact = (F.col("_ties") == 0) & (F.col("m") < EXACT_BELOW) & (F.col("n") < EXACT_BELOW)
    held = sums.where("m > 0 and n > 0")
    out = lambda rows, p: rows.select(*keys, "m", "n", u.alias("u"), p(u).alias("p_greater"), p(m * n - u).alias("p_less"))
    return out(held.where(~exact), tail).unionByName(out(held.where(exact), lambda x: exact_greater("m", "n", x)))


def shape_difference(df: DataFrame, first: str, second: str) -> DataFrame:
    """The rank test between two labels at each position of shapes(label, shape, values); positions where some row has a gap are left out."""
    cells = df.where(F.col("label").isin(first, second)).select(F.col("label").alias("kind"), "shape", F.posexplode("values").alias("position", "value"))
    # counted in one pass, since both what has gaps and the test read them
    counts = saved(cells.groupBy("shape", "position", "kind", "value").agg(F.count("*").alias("_times")))
    # one row a position at most
    gaps = counts.where("value is null").select("shape", "position").distinct()
    return value_rank_test(counts.join(F.broadcast(gaps), ["shape", "position"], "left_anti"), ["shape", "position"], first, second, "_times")


def group_tests(df: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """For each column and pair of labels the smaller one-sided p of the rank test."""
    ways = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in combinations(labels, 2)])
    cells = df.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("c"))
    held = cells.select("label", "c.*", F.explode(F.filter(ways, lambda w: (w["first"] == F.col("label")) | (w["second"] == F.col("label")))).alias("w"))
    kinds = held.select("column", "w.*", "value", F.when(F.col("label") == F.col("w.first"), "a").otherwise("b").alias("kind"))
    return value_rank_test(kinds, ["column", "first", "second"], "a", "b").select("column", "first", "second", "m", "n", F.least("p_greater", "p_less").alias("p"))


def threshold_search(df: DataFrame, a: str, b: str, cuts: list[float]) -> DataFrame:
    """For all pairs of cut-offs how many rows are on the same side of both.

    Rows are counted once by the places of their two values among the cut-offs; pairs are made from these counts.
    """
    cuts = sorted(cuts)
    every = F.array(*map(F.lit, cuts))
    place = lambda c: F.size(F.filter(every, lambda x: x <= F.col(c)))
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(place(a).alias("i"), place(b).alias("j")).agg(F.count("*").alias("_n"))
    steps = F.sequence(F.lit(0), F.lit(len(cuts) - 1))
    spread = cells.withColumn("x", F.explode(steps)).withColumn("y", F.explode(steps))
    same = (F.col("i") <= F.col("x")) == (F.col("j") <= F.col("y"))
    out = spread.groupBy("x", "y").agg(F.sum(F.when(same, F.col("_n")).otherwise(0)).alias("agree"), F.sum("_n").alias("n"))
    return out.select(F.get(every, F.col("x")).alias("cut_a"), F.get(every, F.col("y")).alias("cut_b"), "agree", (100 * F.col("agree") / F.col("n")).alias("percent"))


def coop_label_chambers(first: DataFrame, second: DataFrame, cutoff: DataFrame, p_cut: float = 0.06) -> DataFrame:
    """The second chamber against the first for each (name, ori): cooperative or anticooperative by the rank test, else independent.

    fail_cutoff where the second chamber's median is below the cut-off; cutoff is one row.
    """
    kind = lambda d, k: d.select("name", "ori", F.lit(k).alias("kind"), F.col("intensity").alias("value"))
    values, keys = kind(first, "indiv").unionByName(kind(second, "two")), ["name", "ori"]
    of = lambda k: F.median(F.when(F.col("kind") == k, F.col("value")))
    medians = values.groupBy(*keys).agg(of("indiv").alias("median_first"), of("two").alias("median_second"))
    up, down = (rank_test(values, keys, side).select(*keys, F.col("p").alias(f"p_{side}")) for side in ("greater", "less"))
    joined = medians.join(up, keys).join(down, keys).join(F.broadcast(cutoff))
    label = F.when(F.col("median_second") < F.col("cutoff"), "fail_cutoff").when(F.col("p_greater") < p_cut, "cooperative").when(F.col("p_less") < p_cut, "anticooperative").otherwise("independent")
    return joined.select(*keys, "median_first", "median_second", "p_greater", "p_less", label.alias("label"))


def confidence_change(values: DataFrame, keys: list[str]) -> DataFrame:
    """P of the rank test and the difference of medians of (keys, kind two/indiv, value)."""
    of = lambda k: F.median(F.when(F.col("kind") == k, F.col("value")))
    return rank_test(values, keys).select(*keys, "p").join(values.groupBy(*keys).agg((of("two") - of("indiv")).alias("difference")), keys)


def validate_array(df: DataFrame, sites: DataFrame, primer: str, expected: Column) -> DataFrame:
    """Rows (id, key, sequence) of the ids whose every row has the expected number of sites(key) and holds the primer."""
    counts = sites.groupBy("key").agg(F.count("*").alias("_n"))
    good = (F.coalesce("_n", F.lit(0)) == expected) & F.col("sequence").contains(primer)
    ids = df.join(counts, "key", "left").groupBy("id").agg(F.bool_and(good).alias("_good")).where("_good").select("id")
    return df.join(ids, "id", "left_semi")


def clean_controls(df: DataFrame, caller: Callable[[DataFrame], DataFrame], primer: str, n: int) -> DataFrame:
    """N sequences, in the order of a hash, in which a caller that reads both strands finds no site once the primer is behind them."""
    sites = caller(df.select("key", F.concat("sequence", F.lit(primer)).alias("sequence")))
    return df.join(sites.select("key"), "key", "left_anti").orderBy(F.md5("key"), "key").limit(n)


def centred_factor_pairs(first: DataFrame, second: DataFrame, centre: float = 18, within: float = 3) -> DataFrame:
    """Sequences with one site of each factor whose middle is near the centre."""
    both = single_site(first).withColumnRenamed("pos", "pos_1").join(single_site(second).withColumnRenamed("pos", "pos_2"), "key")
    return both.where(F.abs((F.col("pos_1") + F.col("pos_2")) / 2 - centre) <= within)


def variant_type(df: DataFrame, key: str) -> DataFrame:
    """I22: 'shorter', 'to_right', 'to_left' or 'original' by positions against the first name of the key; in orientation o2 right and left change places."""
    base = df.groupBy(key).agg(F.min_by(F.struct("pos_1", "pos_2"), "name").alias("_b"))
    moved = (F.col("pos_1") - F.col("_b.pos_1")) * F.when(F.col("ori") == "o2", -1).otherwise(1)
    kind = F.when(F.col("pos_2") - F.col("pos_1") < F.col("_b.pos_2") - F.col("_b.pos_1"), "shorter").when(moved > 0, "to_right").when(moved < 0, "to_left").otherwise("original")
    return df.join(base, key).withColumn("variant", kind).drop("_b")


def select_positive_controls(df: DataFrame, key: str, a: str, b: str, high: float, m: int, n: int, seed: str = "seed") -> DataFrame:
    """Rows on which both models are confident: m groups in a hashed order, n rows of each."""
    sure = df.where((F.col(a) >= high) & (F.col(b) >= high))
    groups = sure.select(key).distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(m)
    held = sure.join(F.broadcast(groups), key, "left_semi")
    return held.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), "name"))))).where(F.col("_r") <= n).drop("_r")


def select_disagreements(df: DataFrame, key: str, a: str, b: str, score: str, m: int, n: int) -> DataFrame:
    """The m groups with the largest difference between two models; of each the wild type, both ends and n of the middle."""
    return sub_select(top_groups(df.withColumn("difference", F.abs(F.col(a) - F.col(b))), key, "difference", m), key, "name", score, n)


def select_largest_range(df: DataFrame, key: str, order: str, score: str, m: int, n: int) -> DataFrame:
    """M groups by the range of their scores, those whose label shifts along an order first; of each the wild type, both ends and n of the middle."""
    place = F.struct(order, "name")
    groups = df.groupBy(key).agg((F.min_by("label", place) != F.max_by("label", place)).alias("_shift"), (F.max(score) - F.min(score)).alias("_range"))
    return sub_select(df.join(F.broadcast(groups.orderBy(F.desc("_shift"), F.desc("_range"), key).limit(m).select(key)), key, "left_semi"), key, "name", score, n)


def select_affinity_change(df: DataFrame, key: str, score: str, side: Column, m: int) -> DataFrame:
    """The m groups in which the smallest change of score flips the prediction, and that change."""
    flips = adjacent_similar(df, key, score, float("inf"), side)
    return flips.groupBy(key).agg(F.min(F.col("next") - F.col(score)).alias("change")).orderBy("change", key).limit(m)


def filter_mutants(df: DataFrame, key: str, score: str, least: float, tol: float) -> DataFrame:
    """Mutants with another label than the wild type (first name), a probability of at least `least` and a score within tol of it, and the wild types of groups that keep some."""
    base = df.groupBy(key).agg(F.min("name").alias("_wild"), F.min_by(F.struct("label", F.col(score).alias("s")), "name").alias("_b"))
    held = df.join(base, key).where((F.col("name") == F.col("_wild")) | ((F.col("label") != F.col("_b.label")) & (F.col("probability") >= least) & (F.abs(F.col(score) - F.col("_b.s")) <= tol)))
    return held.withColumn("_n", F.count("*").over(W.partitionBy(key))).where("_n > 1").drop("_n", "_wild", "_b")


def probe_training(scored: DataFrame, pairs: DataFrame, cut: float) -> DataFrame:
    """One row a distinct sequence with a centred pair: the median score of its probes, their number and its label."""
    held = scored.join(pairs.select("key", "pos_1", "pos_2"), "key")
    rows = held.groupBy("sequence", "pos_1", "pos_2").agg(F.median("score").alias("score"), F.count("*").alias("n"))
    return rows.withColumn("label", (F.col("score") >= cut).cast("int"))


def flank_shape(df: DataFrame, core: int, n: int) -> DataFrame:
    """shape values(key, values, pos_1, pos_2) beside both cores, outer and inner, from the core outwards; SENTINEL for gaps and beyond the ends."""
    ways = {"outer_1": lambda i: F.col("pos_1") - i, "inner_1": lambda i: F.col("pos_1") + core - 1 + i, "inner_2": lambda i: F.col("pos_2") - i, "outer_2": lambda i: F.col("pos_2") + core - 1 + i}
    return df.select("key", *[F.coalesce(F.get("values", at(i).cast("int")), F.lit(float(SENTINEL))).alias(f"{name}_{i}") for name, at in ways.items() for i in range(1, n + 1)])


def linker_shape_summary(df: DataFrame, core: int) -> DataFrame:
    """F8: mean, greatest and least shape value between the cores, gaps left out; null where none is left."""
    found = df.where(F.col("pos_2") - F.col("pos_1") > core).withColumn("_v", F.filter(F.slice("values", (F.col("pos_1") + core + 1).cast("int"), (F.col("pos_2") - F.col("pos_1") - core).cast("int")), lambda x: x.isNotNull()))
    mean = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("_v"), F.lit(0))
    return found.select("key", mean.alias("mean"), F.array_max("_v").alias("most"), F.array_min("_v").alias("least"))


def linker_positional(df: DataFrame, core: int, n: int) -> DataFrame:
    """(key, side, place, base): up to n bases of the linker from its centre to the right and to the left."""
    spread = df.where(F.col("pos_2") - F.col("pos_1") > core).withColumn("_mid", F.expr(f"pos_1 + {core} + (pos_2 - pos_1 - {core}) div 2")).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ways = F.array(F.struct(F.lit("right").alias("side"), (F.col("_mid") + F.col("place")).alias("at")), F.struct(F.lit("left").alias("side"), (F.col("_mid") - 1 - F.col("place")).alias("at")))
    cells = spread.withColumn("w", F.explode(ways)).where((F.col("w.at") >= F.col("pos_1") + core) & (F.col("w.at") < F.col("pos_2")))
    return cells.select("key", "w.side", "place", F.substring("sequence", (F.col("w.at") + 1).cast("int"), F.lit(1)).alias("base"))


def feature_table(df: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]], spec: list[str], key: str = "name", label: str = "label") -> DataFrame:
    """the features that spec names, each a frame by the key, side by side with the label."""
    return reduce(lambda a, b: a.join(b, key), [builders[name](df) for name in spec], df.select(key, label))


def predicted_vs_measured(df: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    """Out-of-fold predictions of a line of y on x: squared correlation, mean squared error and rows; one row.

    Each fold's line comes from the sums of all folds less its own, so the table is read once for all of them.
    """
    # sums go over centred values, so that they do not cancel
    means = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    held = df.join(F.broadcast(means)).select(F.col(fold).alias("_f"), (F.col(x) - F.col("_mx")).alias("_x"), (F.col(y) - F.col("_my")).alias("_y")).where("_x is not null and _y is not null")
    terms = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "xy": F.col("_x") * F.col("_y")}
    own = held.groupBy("_f").agg(*[F.sum(t).alias(f"_o{k}") for k, t in terms.items()])
    rest = own.select("_f", *[(F.sum(f"_o{k}").over(W.partitionBy()) - F.col(f"_o{k}")).alias(k) for k in terms])
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0))
    lines = rest.where("n > 0").select("_f", slope.alias("_a"), ((F.col("y") - slope * F.col("x")) / F.col("n")).alias("_b"))
    out = held.join(F.broadcast(lines), "_f").withColumn("_p", F.col("_a") * F.col("_x") + F.col("_b"))
    return out.agg((F.corr("_p", "_y") * F.corr("_p", "_y")).alias("r2"), F.avg((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("mse"), F.count("*").alias("n"))
