"""Interval queries."""

from __future__ import annotations

from bindframe.operators import intervals as op
from bindframe.sources import views as v

OVER = "a.chr = b.chr AND b.start_pos <= a.end_pos AND a.start_pos <= b.end_pos"
IN = "a.chr = b.chr AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos"
RESIZED = "resized AS (SELECT chr, start_pos + summit - 100 AS start_pos, start_pos + summit + 99 AS end_pos, score FROM peaks)"
AREA = f"area AS (SELECT a.chr, a.start_pos, a.end_pos, sum((least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) * b.pileup) AS area FROM resized a JOIN pileup b ON {OVER} GROUP BY ALL)"


def _resized(s, d):
    return op.resize_peaks(v.peaks(s, d), 200)


def _half(df, n):
    return df.where(f"start_pos % 2 = {n}")


def _mids(df):
    return df.selectExpr("chr", "(start_pos + end_pos) div 2 as pos").distinct()


QUERIES = {
    "p1_resize_peaks": lambda s, d: _resized(s, d).select("chr", "start_pos", "end_pos", "score"),
    "p2_allowed_chromosomes": lambda s, d: op.allowed_chromosomes(v.peaks(s, d), ["chr1", "chr2", "chrX"]),
    "p3_min_peak_length": lambda s, d: op.min_peak_length(v.peaks(s, d).select("chr", "start_pos", "end_pos"), 200),
    "j1_interval_join_any": lambda s, d: op.interval_join(v.peaks(s, d).select("chr", "start_pos", "end_pos"), v.pileup(s, d)),
    "j2_interval_join_within": lambda s, d: op.interval_join(v.sites(s, d), v.peaks(s, d).select("chr", "start_pos", "end_pos"), "within"),
    "j3_overlapping_peaks": lambda s, d: op.overlapping_peaks(_half(v.peaks(s, d), 0).select("chr", "start_pos", "end_pos"), _half(v.peaks(s, d), 1).select("chr", "start_pos", "end_pos")),
    "j4_nearest_join": lambda s, d: op.nearest_join(v.peaks(s, d).selectExpr("chr", "start_pos as pos"), _mids(v.sites(s, d))),
    "j5_closest_sites": lambda s, d: op.closest_sites(v.sites(s, d), v.sites(s, d, 41)).select("chr", "start_pos", "mid_1", "mid_2", "distance"),
    "j6_heterotypic_pairs": lambda s, d: op.heterotypic_pairs(_half(v.peaks(s, d), 0), _half(v.peaks(s, d), 1), v.sites(s, d), v.sites(s, d, 41), 3, 40),
    "j18_uncovered_peaks": lambda s, d: op.uncovered_peaks(v.peaks(s, d).select("chr", "start_pos", "end_pos"), v.sites(s, d)),
    "a1_pileup_area": lambda s, d: op.pileup_area(_resized(s, d), v.pileup(s, d)),
    "a2_site_count": lambda s, d: op.site_count(v.peaks(s, d), v.sites(s, d)),
    "a2_site_count_zeros": lambda s, d: op.site_count(v.peaks(s, d), v.sites(s, d), zeros=True),
    "a14_replicate_correlation": lambda s, d: op.replicate_correlation(_resized(s, d), v.pileup(s, d).where("pileup <= 25"), v.pileup(s, d).where("pileup > 25")),
    "a15_pileup_by_site_count": lambda s, d: op.pileup_by_site_count(_resized(s, d), v.pileup(s, d), v.sites(s, d)),
    "a16_peak_length_profile": lambda s, d: op.peak_length_profile(v.peaks(s, d), op.min_peak_length(v.peaks(s, d), 150), 25),
    "w1_consecutive_sites": lambda s, d: op.consecutive_sites(v.peaks(s, d), v.sites(s, d)).select("chr", "start_pos_p", "end_pos_p", "prev_start", "start_pos", "distance"),
    "t1_genomic_sort": lambda s, d: v.peaks(s, d).withColumn("chr_rank", op.genomic_rank(v.CHROMOSOMES)).orderBy("chr_rank", "start_pos", "end_pos").select("chr", "chr_rank", "start_pos", "end_pos"),
    "i1_probe_windows": lambda s, d: op.candidate_probes(v.peaks(s, d), v.sites(s, d), 4, 100),
}

_NEAREST = "(SELECT min_by({b}.pos, abs({b}.pos - {a}.pos) * 10000000 + {b}.pos) FROM {b} WHERE {b}.chr = {a}.chr)"

ORACLE_SQL = {
    "p1_resize_peaks": f"{v.with_views('peaks')}, {RESIZED} SELECT * FROM resized",
    "p2_allowed_chromosomes": f"{v.with_views('peaks')} SELECT * FROM peaks WHERE chr IN ('chr1', 'chr2', 'chrX')",
    "p3_min_peak_length": f"{v.with_views('peaks')} SELECT DISTINCT chr, start_pos, end_pos FROM peaks WHERE end_pos - start_pos >= 200",
    "j1_interval_join_any": f"{v.with_views('peaks', 'pileup')} SELECT a.chr, a.start_pos AS start_pos_a, a.end_pos AS end_pos_a, b.start_pos AS start_pos_b, b.end_pos AS end_pos_b, b.pileup AS pileup_b FROM peaks a JOIN pileup b ON {OVER}",
    "j2_interval_join_within": f"{v.with_views('peaks', 'sites')} SELECT a.chr, a.start_pos AS start_pos_a, a.end_pos AS end_pos_a, b.start_pos AS start_pos_b, b.end_pos AS end_pos_b FROM sites a JOIN peaks b ON {IN}",
    "j3_overlapping_peaks": f"{v.with_views('peaks')} SELECT a.chr, a.start_pos AS start_pos_1, a.end_pos AS end_pos_1, b.start_pos AS start_pos_2, b.end_pos AS end_pos_2 FROM peaks a JOIN peaks b ON {OVER} WHERE a.start_pos % 2 = 0 AND b.start_pos % 2 = 1",
    "j4_nearest_join": f"{v.with_views('peaks', 'sites')}, m AS (SELECT DISTINCT chr, (start_pos + end_pos) // 2 AS pos FROM sites), p AS (SELECT chr, start_pos AS pos FROM peaks), r AS (SELECT chr, pos, {_NEAREST.format(a='p', b='m')} AS near FROM p) SELECT chr, pos, near, abs(near - pos) AS distance FROM r",
    "j5_closest_sites": f"{v.with_views('sites', 'sites2')}, m AS (SELECT DISTINCT chr, (start_pos + end_pos) // 2 AS pos FROM sites2), p AS (SELECT chr, start_pos, (start_pos + end_pos) // 2 AS pos FROM sites), r AS (SELECT chr, start_pos, pos, {_NEAREST.format(a='p', b='m')} AS near FROM p) SELECT chr, start_pos, pos AS mid_1, near AS mid_2, abs(near - pos) AS distance FROM r",
    "j6_heterotypic_pairs": f"""{v.with_views('peaks', 'sites', 'sites2')},
o AS (SELECT a.chr, a.start_pos AS s1, a.end_pos AS e1, b.start_pos AS s2, b.end_pos AS e2 FROM peaks a JOIN peaks b ON {OVER} WHERE a.start_pos % 2 = 0 AND b.start_pos % 2 = 1),
x AS (SELECT DISTINCT s.chr, (start_pos + end_pos) // 2 AS pos FROM sites s JOIN o ON s.chr = o.chr AND s1 <= start_pos AND end_pos <= e1),
y AS (SELECT DISTINCT s.chr, (start_pos + end_pos) // 2 AS pos FROM sites2 s JOIN o ON s.chr = o.chr AND s2 <= start_pos AND end_pos <= e2),
t AS (SELECT chr, pos AS mid_1, {_NEAREST.format(a='x', b='y')} AS mid_2 FROM x UNION SELECT chr, {_NEAREST.format(a='y', b='x')}, pos FROM y)
SELECT *, abs(mid_1 - mid_2) AS distance FROM t WHERE abs(mid_1 - mid_2) > 3 AND abs(mid_1 - mid_2) < 40""",
    "j18_uncovered_peaks": f"{v.with_views('peaks', 'sites')} SELECT chr, start_pos, end_pos FROM peaks a WHERE NOT EXISTS (SELECT 1 FROM sites b WHERE {OVER})",
    "a1_pileup_area": f"{v.with_views('peaks', 'pileup')}, {RESIZED}, {AREA} SELECT * FROM area",
    "a2_site_count": f"{v.with_views('peaks', 'sites')} SELECT a.chr, a.start_pos, a.end_pos, count(*) AS n_sites FROM (SELECT DISTINCT chr, start_pos, end_pos FROM peaks) a JOIN sites b ON {OVER} GROUP BY ALL",
    "a2_site_count_zeros": f"{v.with_views('peaks', 'sites')} SELECT a.chr, a.start_pos, a.end_pos, count(b.chr) AS n_sites FROM (SELECT DISTINCT chr, start_pos, end_pos FROM peaks) a LEFT JOIN sites b ON {OVER} GROUP BY ALL",
    "a14_replicate_correlation": f"{v.with_views('peaks', 'pileup')}, {RESIZED}, x AS (SELECT a.chr, a.start_pos, a.end_pos, ln(1 + sum((least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) * b.pileup)) AS x FROM resized a JOIN pileup b ON {OVER} WHERE pileup <= 25 GROUP BY ALL), y AS (SELECT a.chr, a.start_pos, a.end_pos, ln(1 + sum((least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) * b.pileup)) AS y FROM resized a JOIN pileup b ON {OVER} WHERE pileup > 25 GROUP BY ALL) SELECT corr(x, y) ^ 2 AS r2, count(*) AS n FROM x JOIN y USING (chr, start_pos, end_pos)",
    "a15_pileup_by_site_count": f"{v.with_views('peaks', 'pileup', 'sites')}, {RESIZED}, {AREA}, n AS (SELECT a.chr, a.start_pos, a.end_pos, count(b.chr) AS n_sites FROM (SELECT DISTINCT chr, start_pos, end_pos FROM resized) a LEFT JOIN sites b ON {OVER} GROUP BY ALL), j AS (SELECT n_sites, area FROM area JOIN n USING (chr, start_pos, end_pos)), e AS (SELECT n_sites::VARCHAR AS sites, area FROM j UNION ALL SELECT 'all', area FROM j) SELECT sites, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.5) AS median, quantile_cont(area, 0.75) AS q3, count(*) AS n FROM e GROUP BY 1",
    "a16_peak_length_profile": f"{v.with_views('peaks')} SELECT 'before' AS step, (end_pos - start_pos) // 25 * 25 AS length_from, count(*) AS n FROM peaks GROUP BY ALL UNION ALL SELECT 'after', (end_pos - start_pos) // 25 * 25, count(*) FROM (SELECT DISTINCT * FROM peaks WHERE end_pos - start_pos >= 150) GROUP BY ALL",
    "w1_consecutive_sites": f"{v.with_views('peaks', 'sites')}, i AS (SELECT DISTINCT b.chr, b.start_pos AS start_pos_p, b.end_pos AS end_pos_p, a.start_pos, a.end_pos FROM sites a JOIN peaks b ON {IN}), l AS (SELECT *, lag(start_pos) OVER w AS prev_start, (start_pos + end_pos) / 2 - lag((start_pos + end_pos) / 2) OVER w AS distance FROM i WINDOW w AS (PARTITION BY chr, start_pos_p, end_pos_p ORDER BY start_pos, end_pos)) SELECT chr, start_pos_p, end_pos_p, prev_start, start_pos, distance FROM l WHERE prev_start IS NOT NULL",
    "t1_genomic_sort": f"{v.with_views('peaks')} SELECT chr, CAST(substr(chr, 4) AS INT) - 1 AS chr_rank, start_pos, end_pos FROM peaks",
    "i1_probe_windows": f"{v.with_views('peaks', 'sites')}, i AS (SELECT DISTINCT b.chr, b.start_pos AS peak_start, b.end_pos AS peak_end, a.start_pos, a.end_pos FROM sites a JOIN peaks b ON {IN}), l AS (SELECT *, (start_pos + end_pos) / 2 AS m2, lag((start_pos + end_pos) / 2) OVER (PARTITION BY chr, peak_start, peak_end ORDER BY start_pos, end_pos) AS m1 FROM i), c AS (SELECT chr, peak_start, peak_end, m2 - m1 AS distance, floor((m1 + m2) / 2)::BIGINT - 18 AS seq_start FROM l WHERE m2 - m1 BETWEEN 4 AND 100) SELECT *, seq_start + 36 AS seq_end, seq_start - 10 AS left_start, seq_start + 46 AS right_end FROM c",
}
