"""Interval tables (chr, start_pos, end_pos): overlap, containment and nearest joins, and what is counted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindframe.operators.curves import quantiles

#: Width of a bin, near the usual length of a peak.
BIN = 512


def resize_peaks(peaks: DataFrame, length: int, mode: str = "summit") -> DataFrame:
    """[mid - span, mid + span - 1] around the summit or the centre, span = length div 2; mode all keeps the ends."""
    if mode == "all":
        return peaks
    mid = F.col("start_pos") + F.col("summit") if mode == "summit" else F.expr("(start_pos + end_pos) div 2")
    span = length // 2
    return peaks.withColumn("_mid", mid).withColumn("start_pos", F.col("_mid") - span).withColumn("end_pos", F.col("_mid") + span - 1).drop("_mid")


def allowed_chromosomes(df: DataFrame, names: list[str]) -> DataFrame:
    """P2."""
    return df.where(F.col("chr").isin(names))


def min_peak_length(df: DataFrame, least: int) -> DataFrame:
    """Distinct peaks of a least length."""
    return df.where(F.col("end_pos") - F.col("start_pos") >= least).distinct()


def _suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select("chr", *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c != "chr"])


def interval_join(a: DataFrame, b: DataFrame, mode: str = "any", width: int = BIN, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pairs of closed intervals that share a base ('any'), or with a inside b ('within').

    Both sides are dealt to fixed bins, so the join has an equal key; a pair is kept in the
    bin of its later start alone. For 'within' the contained side needs only its first bin.
    """
    x, y = suffixes
    a, b = _suffixed(a, x), _suffixed(b, y)
    sa, ea, sb, eb = (F.col(f"{c}{s}") for s in suffixes for c in ("start_pos", "end_pos"))

    def bins(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))

    if mode == "within":
        left, right = a.withColumn("_bin", F.floor(sa / width)), b.withColumn("_bin", bins(sb, eb))
        return left.join(right, ["chr", "_bin"]).where((sb <= sa) & (ea <= eb)).drop("_bin")
    left, right = a.withColumn("_bin", bins(sa, ea)), b.withColumn("_bin", bins(sb, eb))
    first = F.col("_bin") == F.greatest(F.floor(sa / width), F.floor(sb / width))
    return left.join(right, ["chr", "_bin"]).where(first & (sb <= ea) & (sa <= eb)).drop("_bin")


def overlapping_peaks(p1: DataFrame, p2: DataFrame) -> DataFrame:
    """Pairs of peaks that overlap."""
    return interval_join(p1, p2, suffixes=("_1", "_2"))


def nearest_join(a: DataFrame, b: DataFrame, width: int = 20_000) -> DataFrame:
    """For every row of a(chr, pos, ..) the closest position of b(chr, pos); ties take the lower one.

    Rows are ordered within a bin of a chromosome; over the borders a bin gets the last
    position before it and the first behind it, so no task needs a whole chromosome.
    """
    marks = b.select("chr", F.col("pos").alias("near")).distinct().withColumn("_bin", F.floor(F.col("near") / width))
    ends = marks.groupBy("chr", "_bin").agg(F.min("near").alias("_lo"), F.max("near").alias("_hi"))
    own = a.withColumn("_bin", F.floor(F.col("pos") / width))
    bins = ends.select("chr", "_bin").union(own.select("chr", "_bin")).distinct().join(ends, ["chr", "_bin"], "left")
    # what is ahead is looked for in turned order, since a frame to the end of a partition is gone through anew for every row
    by = lambda *order: W.partitionBy("chr").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    carried = bins.select("chr", "_bin", F.last("_hi", True).over(by("_bin")).alias("_before"), F.last("_lo", True).over(by(F.desc("_bin"))).alias("_after"))
    both = own.withColumn("near", F.lit(None).cast("long")).withColumn("_own", F.lit(1)).unionByName(marks.withColumn("pos", F.col("near")).withColumn("_own", F.lit(0)), allowMissingColumns=True)
    order = lambda *order: W.partitionBy("chr", "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    low = F.last("near", True).over(order("pos", "_own"))
    high = F.last("near", True).over(order(F.desc("pos"), "_own"))
    seen = both.withColumn("_low", low).withColumn("_high", high).where("_own = 1").join(carried, ["chr", "_bin"], "left")
    below, above = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    pick = F.when(above.isNull() | (F.col("pos") - below <= above - F.col("pos")), below).otherwise(above)
    return seen.withColumn("near", pick).withColumn("distance", F.abs(F.col("near") - F.col("pos"))).select(*a.columns, "near", "distance")


def closest_sites(s1: DataFrame, s2: DataFrame) -> DataFrame:
    """For every site of s1 the site of s2 with the closest mid-point (rounded down)."""
    mid = F.expr("(start_pos + end_pos) div 2")
    return nearest_join(s1.withColumn("pos", mid), s2.select("chr", mid.alias("pos"))).withColumnRenamed("pos", "mid_1").withColumnRenamed("near", "mid_2")


def _in_bins(df: DataFrame, width: int) -> DataFrame:
    """df in each bin that its interval touches: with `_bin` and the part inside, `_from` and `_to` (0 to width, both ends closed)."""
    dealt = df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor(F.col("end_pos") / width))))
    return dealt.withColumns({"_from": F.greatest(F.col("start_pos") - F.col("_bin") * width, F.lit(0)), "_to": F.least(F.col("end_pos") - F.col("_bin") * width, F.lit(width))})


#: Sums at a position of a bin: values and values times place that begin and end there, and intervals (n) and those with a value (v)
#: that begin there, came into the bin, and end there.
_SUMS = ("b", "bx", "e", "ex", *(f"{kind}_{what}" for kind in ("n", "v") for what in ("own", "in", "out")))


def overlap_totals(a: DataFrame, b: DataFrame, value: Column | None = None, width: int = BIN) -> DataFrame:
    """(chr, start_pos, end_pos, n, v, area) of the distinct intervals of a that share a base with one of b: how many they share one with, how many
    of these have a value, and the sum of (clipped end - clipped start) * value, null without any.

    No pair is made. What b has in a bin is added up by position first, so a bin holds `width` + 1 rows of it at most; running
    sums inside the bin then answer for the ends of each interval of a. They start at 0 in every bin, so a sum loses no more
    digits than the bin's own. Rows that running sums can't hold (ends before starts, values that are no finite number) go through `interval_join`.
    """
    keys = ["chr", "start_pos", "end_pos"]
    own = a.select(*keys).distinct()
    other = b.select(*keys, (F.lit(0.0) if value is None else value).alias("_w")).where("chr is not null and start_pos is not null and end_pos is not null")
    plain = F.coalesce(~F.isnan(F.col("_w").cast("double")) & (F.abs(F.col("_w").cast("double")) < float("inf")), F.lit(True)) & (F.col("start_pos") <= F.col("end_pos"))
    ordered = F.col("start_pos") <= F.col("end_pos")

    held, w, zero = _in_bins(other.where(plain), width), F.coalesce(F.col("_w"), F.lit(0)), F.lit(0)
    begins, leaves = F.floor(F.col("start_pos") / width) == F.col("_bin"), F.floor(F.col("end_pos") / width) == F.col("_bin")
    counts = lambda *flags: [(F.when(has, flag.cast("long")).otherwise(F.lit(0)) if flag is not None else F.lit(0).cast("long")) for has in (F.lit(True), F.col("_w").isNotNull()) for flag in flags]
    point = lambda at, *sums: F.struct(F.col(at).alias("_at"), *(x.alias(n) for x, n in zip(sums, _SUMS, strict=True)))
    points = F.array(point("_from", w, w * F.col("_from"), w * 0, w * F.col("_from") * 0, *counts(begins, ~begins, None)), point("_to", w * 0, w * F.col("_to") * 0, w, w * F.col("_to"), *counts(None, None, leaves)))
    marks = held.select("chr", "_bin", F.explode(points).alias("_p")).select("chr", "_bin", "_p.*").groupBy("chr", "_bin", "_at").agg(*(F.sum(n).alias(n) for n in _SUMS))

    asked = _in_bins(own.where(ordered), width)
    ends = asked.select(*keys, "_bin", (F.floor(F.col("start_pos") / width) == F.col("_bin")).alias("_first"), F.explode(F.array(F.struct(F.col("_from").alias("_at"), F.lit(-1).alias("_side")), F.struct(F.col("_to").alias("_at"), F.lit(1).alias("_side")))).alias("_p")).select(*keys, "_bin", "_first", "_p.*")
    both = ends.unionByName(marks, allowMissingColumns=True)
    upto = W.partitionBy("chr", "_bin").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("chr", "_bin").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    total = lambda n, over=upto: F.coalesce(F.sum(n).over(over), zero)
    area = F.col("_at") * (total("b") - total("e")) - total("bx") + total("ex")
    # the place `width` is the next bin's, whose own beginnings count there
    reached = {k: F.when(F.col("_side") == 1, F.when(F.col("_at") < width, total(f"{k}_own")).otherwise(total(f"{k}_own", before)) + F.when(F.col("_first"), total(f"{k}_in")).otherwise(zero)).otherwise(F.when(F.col("_first"), -total(f"{k}_out", before)).otherwise(zero)) for k in ("n", "v")}
    summed = both.select(*keys, "_side", area.alias("_area"), *(c.alias(f"_{k}") for k, c in reached.items())).where("_side is not null")
    found = summed.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_v").alias("v"), F.sum(F.col("_side") * F.col("_area")).alias("area")).where("n > 0")

    odd = interval_join(own, other.where(~plain)).unionByName(interval_join(own.where(~ordered), other.where(plain)))
    clipped = F.least("end_pos_a", "end_pos_b") - F.greatest("start_pos_a", "start_pos_b")
    rest = odd.groupBy("chr", F.col("start_pos_a").alias("start_pos"), F.col("end_pos_a").alias("end_pos")).agg(F.count("*").alias("n"), F.count("_w_b").alias("v"), F.sum(clipped * F.col("_w_b")).alias("area"))
    every = found.withColumn("area", F.when(F.col("v") > 0, F.col("area"))).unionByName(rest)
    return every.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("area").alias("area"))


def _contained(sites: DataFrame, peaks: DataFrame, width: int = BIN) -> DataFrame:
    """The distinct (chr, start_pos, end_pos) of sites that lie inside a peak: by the farthest end of the peaks that began, bin by bin."""
    keys = ["chr", "start_pos", "end_pos"]
    far = _in_bins(peaks.select(*keys).where("start_pos <= end_pos"), width).groupBy("chr", "_bin", F.col("_from").alias("_at")).agg(F.max("end_pos").alias("_far"))
    own = sites.select(*keys).distinct().withColumn("_bin", F.floor(F.col("start_pos") / width)).withColumn("_at", F.col("start_pos") - F.col("_bin") * width)
    by = W.partitionBy("chr", "_bin").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    reach = own.unionByName(far, allowMissingColumns=True).withColumn("_reach", F.max("_far").over(by)).where("start_pos is not null")
    return reach.where("start_pos <= end_pos and end_pos <= _reach").select(*keys)


def heterotypic_pairs(p1: DataFrame, p2: DataFrame, s1: DataFrame, s2: DataFrame, least: int, most: int) -> DataFrame:
    """Neighbouring sites of two factors in overlapping peaks, from either side, strictly between two distances.

    No pair of peaks is made: a peak counts if it overlaps any of the other factor.
    """

    def inside(sites: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
        return _contained(sites, overlap_totals(own, other)).select("chr", F.expr("(start_pos + end_pos) div 2").alias("pos")).distinct()

    a, b = inside(s1, p1, p2), inside(s2, p2, p1)
    there = nearest_join(a, b).select("chr", F.col("pos").alias("mid_1"), F.col("near").alias("mid_2"), "distance")
    back = nearest_join(b, a).select("chr", F.col("near").alias("mid_1"), F.col("pos").alias("mid_2"), "distance")
    return there.union(back).where((F.col("distance") > least) & (F.col("distance") < most)).distinct()


def pileup_area(peaks: DataFrame, pileup: DataFrame, log: bool = False) -> DataFrame:
    """A1: sum over overlaps of (clipped end - clipped start) * value for each peak, as often as the peak is there; no one is added to a width."""
    keys = ["chr", "start_pos", "end_pos"]
    times = peaks.groupBy(*keys).agg(F.count("*").alias("_times"))
    out = overlap_totals(peaks, pileup, F.col("pileup")).join(times, keys).select(*keys, (F.col("area") * F.col("_times")).alias("area"))
    return out.withColumn("area", F.log(F.col("area") + 1)) if log else out


def site_count(peaks: DataFrame, sites: DataFrame, zeros: bool = False) -> DataFrame:
    """A2: overlapping sites of each peak; peaks with none are left out, or 0."""
    keys = ["chr", "start_pos", "end_pos"]
    found = overlap_totals(peaks, sites).select(*keys, F.col("n").alias("n_sites"))
    return peaks.select(*keys).distinct().join(found, keys, "left").fillna(0, ["n_sites"]) if zeros else found


def consecutive_sites(peaks: DataFrame, sites: DataFrame, most: float | None = None) -> DataFrame:
    """Neighbouring sites in a peak, with the distance of their mid-points (half bases possible)."""
    inside = interval_join(sites.select("chr", "start_pos", "end_pos").distinct(), peaks.select("chr", "start_pos", "end_pos").distinct(), "within", suffixes=("", "_p"))
    by = W.partitionBy("chr", "start_pos_p", "end_pos_p").orderBy("start_pos", "end_pos")
    mid = (F.col("start_pos") + F.col("end_pos")) / 2
    out = inside.withColumn("prev_start", F.lag("start_pos").over(by)).withColumn("distance", mid - F.lag(mid).over(by)).where("prev_start is not null")
    return out if most is None else out.where(F.col("distance") <= most)


def uncovered_peaks(open_peaks: DataFrame, bound: DataFrame) -> DataFrame:
    """Open-chromatin peaks that no bound peak overlaps."""
    keys = ["chr", "start_pos", "end_pos"]
    return open_peaks.join(overlap_totals(open_peaks, bound).select(*keys), keys, "left_anti")


def genomic_rank(chromosomes: list[str]) -> Column:
    """A chromosome's place in the given order."""
    return F.coalesce(*[F.when(F.col("chr") == c, F.lit(i)) for i, c in enumerate(chromosomes)])


def replicate_correlation(peaks: DataFrame, r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Squared correlation of the log areas of two replicates over the peaks that both have."""
    keys = ["chr", "start_pos", "end_pos"]
    both = pileup_area(peaks, r1, log=True).withColumnRenamed("area", "x").join(pileup_area(peaks, r2, log=True).withColumnRenamed("area", "y"), keys)
    return both.agg((F.corr("x", "y") * F.corr("x", "y")).alias("r2"), F.count("*").alias("n"))


def pileup_by_site_count(peaks: DataFrame, pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """Quartiles of the area by sites in the peak, and over all."""
    joined = pileup_area(peaks, pileup).join(site_count(peaks, sites, zeros=True), ["chr", "start_pos", "end_pos"])
    every = joined.select(F.col("n_sites").cast("string").alias("sites"), "area").union(joined.select(F.lit("all"), "area"))
    return quantiles(every, ["sites"], "area", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "n")


def peak_length_profile(before: DataFrame, after: DataFrame, width: int) -> DataFrame:
    """How many peaks of each length class there are before and after a filter."""
    tagged = before.select(F.lit("before").alias("step"), "start_pos", "end_pos").union(after.select(F.lit("after"), "start_pos", "end_pos"))
    return tagged.groupBy("step", F.expr(f"(end_pos - start_pos) div {width} * {width}").alias("length_from")).agg(F.count("*").alias("n"))


def candidate_probes(peaks: DataFrame, sites: DataFrame, least: int = 4, most: int = 24, length: int = 36, flank: int = 10) -> DataFrame:
    """Windows of `length` bases centred on neighbouring site pairs at an inclusive distance, with flanks (coordinates)."""
    found = consecutive_sites(peaks, sites).where(F.col("distance").between(least, most))
    mid1, mid2 = F.expr("(start_pos + end_pos) / 2 - distance"), F.expr("(start_pos + end_pos) / 2")
    start = F.floor((mid1 + mid2) / 2).cast("long") - length // 2
    cut = found.select("chr", F.col("start_pos_p").alias("peak_start"), F.col("end_pos_p").alias("peak_end"), "distance", start.alias("seq_start"))
    return cut.select("*", (F.col("seq_start") + length).alias("seq_end"), (F.col("seq_start") - flank).alias("left_start"), (F.col("seq_start") + length + flank).alias("right_end"))
