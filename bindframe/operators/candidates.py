"""Candidate probes over several peak lengths and site counts, and sites called by kernel models of several cores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindframe.operators.curves import score_steps
from bindframe.operators.intervals import candidate_probes, resize_peaks, site_count
from bindframe.operators.rows import with_dense_ids
from bindframe.operators.sites import kernel_scores_of_cores


def all_candidate_probes(peaks: DataFrame, sites: DataFrame, lengths: Sequence[int], counts: Sequence[int], least: int, most: int, length: int = 36, flank: int = 10) -> DataFrame:
    """I1 over peaks(chr, start_pos, end_pos, summit) of each length around their summits, of those that hold one of the site counts.

    (key, chr, peak_start, peak_end, peaklen, sites_in_peak, distance, seq_start, seq_end, left_start, right_end, mid_1, mid_2);
    mid_1 and mid_2 are places in the probe, from 1, rounded down. Peaks of different lengths differ in their ends, so all
    lengths go through one join with the sites. keys number the rows by a hash.
    """
    sized = reduce(DataFrame.unionByName, (resize_peaks(peaks, n).select("chr", "start_pos", "end_pos") for n in lengths)).distinct()
    chosen = site_count(sized, sites).where(F.col("n_sites").isin(list(counts)))
    found = candidate_probes(chosen, sites, least, most, length, flank)
    counted = chosen.select("chr", F.col("start_pos").alias("peak_start"), F.col("end_pos").alias("peak_end"), F.col("n_sites").alias("sites_in_peak"))
    rows = found.join(counted, ["chr", "peak_start", "peak_end"]).withColumn("peaklen", F.col("peak_end") - F.col("peak_start") + 1)
    # the pair's middle is what the probe is centred on
    middle = F.col("seq_start") + length // 2
    rows = rows.withColumn("mid_1", (F.floor(middle - F.col("distance") / 2) - F.col("seq_start") + 1).cast("long")).withColumn("mid_2", (F.floor(middle + F.col("distance") / 2) - F.col("seq_start") + 1).cast("long"))
    named = rows.withColumn("_name", F.concat_ws(":", "chr", "peak_start", "peak_end", "seq_start", "distance")).distinct()
    return with_dense_ids(named, "_name").withColumn("key", F.concat(F.lit("sequence"), "id")).drop("_name", "id")


class Kernel(NamedTuple):
    """A model of windows with one core in the centre: support vectors(sv_id, coef, idx, val), and its parameters."""

    core: str
    vectors: DataFrame
    gamma: float
    rho: float
    linear: bool = False


def kernel_sites(df: DataFrame, models: Sequence[Kernel], width: int, threshold: float) -> DataFrame:
    """K7 whole: (key, site_start, core_start, core_mid, core, score) of the windows that any model scores strictly above the threshold.

    A window is turned where it holds the reverse of a core; a core that is its own reverse is scored on both
    strands, and the better one counts. core_mid lies half the core behind its start, rounded up. All models go over the sequences in one pass.
    """
    scored = kernel_scores_of_cores(df, models, width).where(F.col("score") > threshold)
    best = scored.groupBy("key", "start", "model").agg(F.max("score").alias("score"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("model"))
    start = F.col("start") + pick([(width - len(m.core)) // 2 for m in models])
    return best.select("key", F.col("start").alias("site_start"), start.alias("core_start"), (start + pick([(len(m.core) + 1) // 2 for m in models])).alias("core_mid"), pick([m.core for m in models]).alias("core"), "score")


def best_cut(df: DataFrame, positive: str, score: str) -> DataFrame:
    """M8 for either direction: the single cut with the best accuracy, and whether positive rows lie above it (score >= cut) or below; ties take the highest cut, then above. One row."""
    steps = score_steps(df, [], score, F.col("label") == positive)
    whole = F.col("tp") + F.col("tn")
    above = (F.col("cp") + F.col("tn") - F.col("cn")) / whole
    ways = F.array(F.struct(above.alias("accuracy"), F.col("score").alias("cut"), F.lit(True).alias("above")), F.struct((1 - above).alias("accuracy"), F.col("score").alias("cut"), F.lit(False).alias("above")))
    return steps.select(F.explode(ways).alias("w")).agg(F.max("w").alias("w")).select("w.cut", "w.above", "w.accuracy")
