"""Queries of the mutation operators that call sites again, over whole texts read as bases in probes of 36."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.functions.calling import Caller, matrix_caller
from bindframe.operators import design
from bindframe.operators import mutation as op
from bindframe.plans.sites import PWM
from bindframe.plans.tables import _OVER, CORES, PRIMER, TWO, _pairs
from bindframe.plans.tables import ORACLE_SQL as TABLES_SQL
from bindframe.sources import views as v

#: Sites are windows whose better strand scores above 3.
SITES = matrix_caller(PWM, 3.0)
#: Scores of all 4-mers by formula (as in the site queries), and what counts as high.
PROFILE = Caller(4, tuple((i * 37 % 101) / 101.0 - 0.5 for i in range(256)), 0.3)
#: Fixed weights beside the core of the short matrix, log-odds by base.
LEFT = [{"A": 0.5, "C": -0.2, "G": 0.1, "T": -0.6}, {"A": 0.3, "C": 0.6, "G": -0.9, "T": -0.1}]
RIGHT = [{"A": -0.4, "C": 0.2, "G": 0.7, "T": -0.8}, {"A": 0.1, "C": -0.5, "G": 0.4, "T": 0.2}]
WIDE = [*LEFT, *PWM, *RIGHT]
WEAK = (2.95, 5.55)
MIDDLE = (-0.35, 0.4)
CUTOFFS, GAPS = [0.3, 0.2, 0.1], [0, 1]


def _targets(s: SparkSession, d: str) -> DataFrame:
    """Each called site of each sequence as a target."""
    return op.with_sites(v.sequences(s, d), SITES).select("key", "sequence", F.explode("sites").alias("target"))


def _with_originals(changed: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return changed.join(v.sequences(s, d).select("key", F.col("sequence").alias("original")), "key")


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("positions", F.array_join("positions", ","))


QUERIES = {
    "i3_core_called": lambda s, d: op.still_called(design.mutate_core(_pairs(s, d), CORES), SITES),
    "i4_flank_called": lambda s, d: op.one_site_changed(_with_originals(design.mutate_flank(_pairs(s, d), 4, 2), s, d), SITES, F.col("original")).drop("original"),
    "i5_distance_called": lambda s, d: op.still_called(design.mutate_distance(_pairs(s, d), 4, 4), SITES),
    "i6_orientation_called": lambda s, d: op.still_called(design.mutate_orientation(_pairs(s, d), 4), SITES),
    "i9_abolish_called": lambda s, d: op.abolish_core(_targets(s, d), SITES, 0.5).where("abolished is not null").select("key", "target", "abolished"),
    "i10_abolish_rounds": lambda s, d: _text(op.abolish_site_rounds(_targets(s, d), SITES, PROFILE)),
    "i11_variant_sets": lambda s, d: op.variant_sets(v.sequences(s, d), SITES),
    "i11_variant_sets_by_rounds": lambda s, d: op.variant_sets_by_rounds(v.sequences(s, d), SITES, PROFILE),
    "i12_clean_junction": lambda s, d: op.clean_junction(v.sequences(s, d), PRIMER, SITES),
    "i18_check_probe_set": lambda s, d: op.check_probe_set(op.variant_sets(v.sequences(s, d), SITES), PROFILE, 4, CUTOFFS, GAPS),
    "i20_weaken_sites": lambda s, d: op.weaken_sites(op.with_sites(v.sequences(s, d), SITES).where(F.size("sites") == 2).select("key", "sequence", F.get("sites", F.lit(0)).alias("site_1"), F.get("sites", F.lit(1)).alias("site_2")), WIDE, 4, PROFILE, *WEAK, MIDDLE),
}

_NUMBERS = lambda values: "[" + ", ".join(f"{x!r}::DOUBLE" for x in values) + "]"
#: One row: e, the profile's scores; p, the better strand of the matrix.
_TAB = f"tab AS (SELECT {_NUMBERS(PROFILE.scores)} AS e, {_NUMBERS(SITES.scores)} AS p)"
_D = lambda seq: f"[instr('ACGT', ch) - 1 FOR ch IN string_split({seq}, '')]"
_C = lambda d: f"[{d}[i+1]*64 + {d}[i+2]*16 + {d}[i+3]*4 + {d}[i+4] FOR i IN range(0, len({d}) - 3)]"
_S = lambda c: f"[i FOR i IN range(0, len({c})) IF p[{c}[i+1]+1] > 3]"


def _called(source: str, seq: str, name: str, n: int) -> str:
    """CTEs that add to `source` the ranks d<n>, codes c<n> and sites s<n> of a sequence; the last is `name`."""
    return f"{name}_d AS (SELECT *, {_D(seq)} AS d{n} FROM {source}), {name}_c AS (SELECT *, {_C(f'd{n}')} AS c{n} FROM {name}_d), {name} AS (SELECT x.*, {_S(f'c{n}')} AS s{n} FROM {name}_c x, tab)"


_BASE = f"sequences_ok AS (SELECT * FROM sequences WHERE sequence <> ''), {_called('sequences_ok', 'sequence', 'called', 0)}"


def _cut_sql(source: str, name: str, seq: str, target: str, out: str, change: float | None, low: str = "0", high: str | None = None, allowed: str | None = None) -> str:
    """CTEs of I9 on a column of `source` (with a unique column rid): `name` has all its columns and the sequence `out` without the target, or null."""
    others = f"[i FOR i IN s IF i <> {target}" + (f" AND NOT list_contains({allowed}, i)]" if allowed else "]")
    altered = f" AND len([i FOR i IN others IF abs(p[n[i+1]+1] - p[c[i+1]+1]) > {change}]) = 0" if change is not None else ""
    return f"""
{name}_0 AS (SELECT rid, {seq} AS q, {target} AS target, {low} AS lo, {high or f'length({seq})'} AS hi{f', {allowed} AS {allowed}' if allowed else ''} FROM {source} WHERE {target} IS NOT NULL),
{name}_1 AS (SELECT *, {_D('q')} AS d FROM {name}_0), {name}_2 AS (SELECT *, {_C('d')} AS c FROM {name}_1), {name}_3 AS (SELECT x.*, {_S('c')} AS s FROM {name}_2 x, tab),
{name}_4 AS (SELECT *, target + o AS place, {others.replace(target, 'target') if not allowed else others.replace(f'i <> {target}', 'i <> target')} AS others FROM {name}_3, range(0, 4) r(o), range(0, 4) b(b) WHERE target + o >= lo AND target + o < hi AND list_contains(s, target)),
{name}_5 AS (SELECT *, [c[w+1] + CASE WHEN w <= place AND place < w + 4 THEN (b - d[place+1]) * (4 ** (3 - (place - w)))::BIGINT ELSE 0 END FOR w IN range(0, len(c))] AS n FROM {name}_4),
{name}_6 AS (SELECT x.*, {_S('n')} AS t, p[n[target+1]+1] AS after FROM {name}_5 x, tab WHERE p[n[target+1]+1] < p[c[target+1]+1]),
{name}_7 AS (SELECT x.* FROM {name}_6 x, tab WHERE len([i FOR i IN t IF i <> target AND NOT list_contains(s, i)]) = 0 AND len([i FOR i IN others IF NOT list_contains(t, i)]) = 0{altered}
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY after, place, b) = 1),
{name} AS (SELECT o.*, CASE WHEN after <= 3 THEN substr(q, 1, place::INT) || substr('ACGT', b::INT + 1, 1) || substr(q, place::INT + 2) END AS {out} FROM {source} o LEFT JOIN (SELECT rid AS rid_, q, place, b, after FROM {name}_7) z ON o.rid = z.rid_)"""


def _rounds_sql(source: str, name: str) -> str:
    """CTEs of I10 on (key, target, sequence) of `source`, which call sites again; `name` has the finished rows."""
    return f"""
{_called(source, 'sequence', f'{name}_b', 8)},
{name}_st AS (
  SELECT key, target, sequence, [o FOR o IN s8 IF o <> target] AS others, true AS there, []::BIGINT[] AS taken, []::BIGINT[] AS positions, 0 AS steps, NULL::VARCHAR AS status FROM {name}_b WHERE list_contains(s8, target)
  UNION ALL
  SELECT key, target, CASE WHEN fin IS NOT NULL OR back THEN sequence ELSE new END, others, CASE WHEN fin IS NOT NULL OR back THEN there ELSE still END,
         CASE WHEN fin IS NOT NULL THEN taken ELSE list_append(taken, mark) END, CASE WHEN fin IS NULL AND NOT back AND new <> sequence THEN list_append(positions, place) ELSE positions END,
         CASE WHEN fin IS NOT NULL THEN steps ELSE steps + 1 END, fin
  FROM (SELECT *, CASE WHEN pick IS NULL THEN CASE WHEN there THEN 'stuck' ELSE 'abolished' END WHEN pick.s < 0.3 AND NOT there THEN 'abolished' END AS fin,
               list_contains(ns, target) AS still, NOT coalesce(list_contains(ns, target), false) AND len(ns) <> len(others) AS back
        FROM (SELECT y.*, [i FOR i IN range(0, len(nc)) IF p[nc[i+1]+1] > 3] AS ns
        FROM (SELECT *, {_C('nd')} AS nc FROM (SELECT *, {_D('new')} AS nd FROM (
          SELECT *, substr(sequence, 1, place::INT) || substr('ACGT', base::INT + 1, 1) || substr(sequence, place::INT + 2) AS new, wat * 256 + c[wat+1] AS mark
          FROM (SELECT z.*, list_min([{{'s': e[c[wat+1] + (b - d[place+1])*4 + 1], 'b': b}} FOR b IN [0, 1, 2, 3]]).b AS base
          FROM (SELECT *, -pick.b AS wat, 2 - pick.b AS place
          FROM (SELECT x.*, list_max([{{'s': e[c[i+1]+1], 'b': -i}} FOR i IN free]) AS pick
          FROM (SELECT *, [i FOR i IN range(greatest(0, target - 4), least(len(d) - 4, target + 4) + 1) IF NOT list_contains(taken, i * 256 + c[i+1]) AND len([o FOR o IN others IF i + 2 >= o - 1 AND i + 2 < o + 5]) = 0] AS free
          FROM (SELECT *, {_C('d')} AS c FROM (SELECT *, {_D('sequence')} AS d FROM {name}_st WHERE status IS NULL))) x, tab)) z, tab))) ) y, tab))
), {name} AS (SELECT * FROM {name}_st WHERE status IS NOT NULL)"""


def _level(b: str, own: str, order: list[int], places: list[int]) -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN {b}[{j + 1}] <> {own}[{places[j] + 1}] THEN {n + 1} ELSE 0 END" for n, j in enumerate(order)) + ")"


def _weak_sql(source: str, name: str, seq: str, site: str, out: str, left: bool) -> str:
    """CTEs of I20 for one site: every flank is written out and judged."""
    swap = {"A": "T", "C": "G", "G": "C", "T": "A"}
    back = [{b: row[swap[b]] for b in "ACGT"} for row in reversed(WIDE)]
    flat = lambda rows: _NUMBERS([row[b] for row in rows for b in "ACGT"])
    score = lambda arr: f"greatest(list_sum([fw[{arr}[i+1] + 4*i + 1] FOR i IN range(0, 8)]), list_sum([bw[{arr}[i+1] + 4*i + 1] FOR i IN range(0, 8)]))"
    order = [1, 0, 2, 3] if left else [2, 3, 1, 0]
    level = _level("b", "own", order, [0, 1, 6, 7])
    inside = lambda i: f"e[nc[{i}+1]+1] >= {MIDDLE[0]} AND e[nc[{i}+1]+1] < {MIDDLE[1]}"
    return f"""
{name}_0 AS (SELECT rid, {seq} AS q, {site} AS target, {_D(seq)} AS d FROM {source}),
{name}_1 AS (SELECT *, [d[i] FOR i IN range(target - 1, target + 7)] AS own FROM {name}_0 WHERE target >= 2 AND target + 6 <= len(d)),
{name}_w AS (SELECT {flat(WIDE)} AS fw, {flat(back)} AS bw),
{name}_2 AS (SELECT *, {score('own')} AS now FROM {name}_1, {name}_w),
{name}_3 AS (SELECT *, [f // 64, f // 16 % 4, f // 4 % 4, f % 4] AS b FROM {name}_2, range(0, 256) g(f) WHERE now >= {WEAK[1]}),
{name}_4 AS (SELECT *, [b[1], b[2], own[3], own[4], own[5], own[6], b[3], b[4]] AS wide FROM {name}_3),
{name}_5 AS (SELECT *, list_concat(list_concat(d[1:target-2], wide), d[target+7:]) AS nd FROM {name}_4 WHERE {score('wide')} > {WEAK[0]} AND {score('wide')} < {WEAK[1]}),
{name}_6 AS (SELECT *, {_C('nd')} AS nc FROM {name}_5),
{name}_7 AS (SELECT x.* FROM {name}_6 x, tab WHERE len([i FOR i IN range(greatest(0, target - 2), target + 1) IF {inside('i')} AND {inside('(i+1)')}]) > 0
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {level}, f) = 1),
{name} AS (SELECT o.*, list_aggregate([substr('ACGT', x::INT + 1, 1) FOR x IN nd], 'string_agg', '') AS {out} FROM {source} o JOIN (SELECT rid AS rid_, nd FROM {name}_7) z ON o.rid = z.rid_)"""


_SEQ = v.with_views("sequences")
_REC = _SEQ.replace("WITH ", "WITH RECURSIVE ", 1)
_PAIR = "pair AS (SELECT key AS rid, key, sequence AS wt, s0[1] AS site_1, s0[2] AS site_2 FROM called WHERE len(s0) = 2)"
_VARIANTS = f"""{_PAIR}, {_cut_sql('pair', 'cut1', 'wt', 'site_1', 'm1', None)}, ok1 AS (SELECT * FROM cut1 WHERE m1 IS NOT NULL),
{_cut_sql('ok1', 'cut2', 'wt', 'site_2', 'm2', None)}, ok2 AS (SELECT * FROM cut2 WHERE m2 IS NOT NULL), {_cut_sql('ok2', 'cut3', 'm1', 'site_2', 'm3', None)}, ok3 AS (SELECT * FROM cut3 WHERE m3 IS NOT NULL)"""
_VERIFIED = f"{_called('ok3', 'm1', 'v1', 1)}, {_called('v1', 'm2', 'v2', 2)}, {_called('v2', 'm3', 'v3', 3)}, sets AS (SELECT key, wt, m1, m2, m3, site_1, site_2 FROM v3 WHERE s1 = [site_2] AND s2 = [site_1] AND len(s3) = 0)"
_RC = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _second(name: str, test: str) -> str:
    """A query of the table plans, kept where the sites of its sequence, called again, pass a test."""
    inner = TABLES_SQL[name]
    return f"WITH {_TAB}, found AS ({inner}), {_called('found', 'sequence', 'again', 1)} SELECT * EXCLUDE (d1, c1, s1) FROM again WHERE {test}"


def _junction(source: str, name: str, turned: str) -> str:
    """CTEs that abolish the first site across the border on one strand; `name` has (rid, key, old, new)."""
    whole = f"{turned} || '{PRIMER}'"
    back = lambda x: x if turned == "new" else _RC(x)
    return f"""{name}_q AS (SELECT *, {whole} AS whole, length(new) AS size FROM {source}), {_called(f'{name}_q', 'whole', f'{name}_s', 5)},
{name}_t AS (SELECT rid, key, old, new, whole, size, [i FOR i IN s5 IF i < size AND i + 4 > size] AS across FROM {name}_s), {name}_u AS (SELECT *, across[1] AS site FROM {name}_t),
{_cut_sql(f'{name}_u', f'{name}_v', 'whole', 'site', 'cut', None, '0', 'size', 'across')},
{name} AS (SELECT rid, key, old, coalesce({back('substr(cut, 1, size::INT)')}, new) AS new FROM {name}_v)"""


def _region_sql() -> str:
    """CTEs from sets to ok(key, cutoff, gap, o): the pairs that a set passes, by gaps and islands for each pair of parameters."""
    pairs = ", ".join(f"({o}, {g}, {c}::DOUBLE)" for o, (g, c) in enumerate(product(GAPS, CUTOFFS)))
    return f"""
four AS (SELECT key, site_1, site_2, unnest(['wt', 'm1', 'm2', 'm3']) AS kind, unnest([wt, m1, m2, m3]) AS sequence FROM sets),
prof AS (SELECT key, kind, sequence, i AS start, e[c[i+1]+1] AS score FROM (SELECT *, unnest(range(0, len(c))) AS i FROM (SELECT *, {_C('d')} AS c FROM (SELECT *, {_D('sequence')} AS d FROM four))), tab),
prm AS (SELECT * FROM (VALUES {pairs}) t(o, gap, cutoff)),
hi AS (SELECT key, kind, o, gap, start, start - lag(start) OVER (PARTITION BY key, kind, o ORDER BY start) AS dist FROM prof JOIN prm ON score > cutoff),
isl AS (SELECT *, sum(CASE WHEN dist IS NULL OR dist > gap + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key, kind, o ORDER BY start) AS run FROM hi),
rg AS (SELECT key, kind, o, gap, min(start) AS first, max(start) AS last, count(*) AS n FROM isl GROUP BY key, kind, o, gap, run),
fin AS (SELECT key, kind, max(start) AS final FROM prof GROUP BY ALL),
tl AS (SELECT rg.*, coalesce(lead(first) OVER (PARTITION BY rg.key, rg.kind, o ORDER BY first) - 1, final) - last AS low FROM rg JOIN fin USING (key, kind)),
re AS (SELECT key, kind, o, first + 2 AS b, first + 2 + n + CASE WHEN low > gap THEN gap ELSE greatest(low - 1, 0) END AS z FROM tl WHERE n >= 2),
li AS (SELECT key, kind, o, list({{'b': b, 'z': z}} ORDER BY b) AS l FROM re GROUP BY ALL),
al AS (SELECT four.key, kind, site_1, site_2, prm.o, gap, cutoff, coalesce(l, []) AS l FROM four CROSS JOIN prm LEFT JOIN li USING (key, kind, o)),
ju AS (SELECT *, CASE kind WHEN 'wt' THEN len(l) = 2 AND l[1].b <= site_1 + 4 AND site_1 <= l[1].z AND l[2].b <= site_2 + 4 AND site_2 <= l[2].z
         WHEN 'm1' THEN len(l) = 1 AND l[1].b <= site_2 + 4 AND site_2 <= l[1].z WHEN 'm2' THEN len(l) = 1 AND l[1].b <= site_1 + 4 AND site_1 <= l[1].z ELSE len(l) = 0 END AS good FROM al),
ok AS (SELECT key, cutoff, gap, o FROM ju GROUP BY ALL HAVING bool_and(coalesce(good, false)))"""


ORACLE_SQL = {
    "i3_core_called": _second("i3_mutate_core", "len(s1) = 2"),
    "i4_flank_called": f"WITH {_TAB}, found AS ({TABLES_SQL['i4_mutate_flank']}), orig AS ({TWO} SELECT key, sequence AS original FROM two), both_of AS (SELECT found.*, original FROM found JOIN orig USING (key)), {_called('both_of', 'sequence', 'again', 1)}, {_called('again', 'original', 'past', 2)} SELECT key, site, position, base, sequence FROM past, tab WHERE len(s2) = 2 AND s1 = s2 AND len([i FOR i IN s2 IF abs(p[c1[i+1]+1] - p[c2[i+1]+1]) > 1e-9]) <= 1",
    "i5_distance_called": _second("i5_mutate_distance", "len(s1) = 2"),
    "i6_orientation_called": _second("i6_mutate_orientation", "len(s1) = 2"),
    "i9_abolish_called": f"{_SEQ}, {_TAB}, {_BASE}, tg AS (SELECT key || ':' || target AS rid, key, sequence, target FROM (SELECT key, sequence, unnest(s0) AS target FROM called)), {_cut_sql('tg', 'cut', 'sequence', 'target', 'abolished', 0.5)} SELECT key, target, abolished FROM cut WHERE abolished IS NOT NULL",
    "i10_abolish_rounds": f"{_REC}, {_TAB}, {_BASE}, tg AS (SELECT key, sequence, unnest(s0) AS target FROM called), {_rounds_sql('tg', 'fin')} SELECT key, target, sequence, status, steps, array_to_string(positions, ',') AS positions FROM fin",
    "i11_variant_sets": f"{_SEQ}, {_TAB}, {_BASE}, {_VARIANTS}, {_VERIFIED} SELECT * FROM sets",
    "i11_variant_sets_by_rounds": f"""{_REC}, {_TAB}, {_BASE}, {_PAIR}, tg AS (SELECT key, wt AS sequence, site_1 AS target FROM pair UNION ALL SELECT key, wt, site_2 FROM pair), {_rounds_sql('tg', 'fa')},
ma AS (SELECT pair.key, wt, site_1, site_2, a.sequence AS m1, b.sequence AS m2 FROM pair JOIN fa a ON a.key = pair.key AND a.target = site_1 AND a.status = 'abolished' JOIN fa b ON b.key = pair.key AND b.target = site_2 AND b.status = 'abolished'),
tg2 AS (SELECT key, m1 AS sequence, site_2 AS target FROM ma), {_rounds_sql('tg2', 'fb')}, ok3 AS (SELECT ma.*, fb.sequence AS m3 FROM ma JOIN fb ON fb.key = ma.key AND fb.status = 'abolished'), {_VERIFIED} SELECT * FROM sets""",
    "i12_clean_junction": f"""{_SEQ}, {_TAB}, {_BASE}, start AS (SELECT key AS rid, key, sequence AS old, sequence AS new FROM sequences_ok), {_junction('start', 'fwd', 'new')}, {_junction('fwd', 'rev', _RC('new'))},
wh AS (SELECT *, new || '{PRIMER}' AS f, {_RC('new')} || '{PRIMER}' AS r, length(new) AS n FROM rev), {_called('wh', 'f', 'j1', 1)}, {_called('j1', 'r', 'j2', 2)}, {_called('j2', 'old', 'j3', 3)}, {_called('j3', 'new', 'j4', 4)},
jd AS (SELECT *, len([i FOR i IN s1 IF i < n AND i + 4 > n]) = 0 AND len([i FOR i IN s2 IF i < n AND i + 4 > n]) = 0 AND s3 = s4 AS clean FROM j4)
SELECT key, old, CASE WHEN clean THEN new END AS new, CASE WHEN NOT clean THEN 'dropped' WHEN new = old THEN 'clean' ELSE 'repaired' END AS status FROM jd""",
    "i18_check_probe_set": f"{_SEQ}, {_TAB}, {_BASE}, {_VARIANTS}, {_VERIFIED}, {_region_sql()} SELECT key, cutoff, gap FROM ok WHERE key IN (SELECT key FROM sets WHERE len(list_distinct([wt, m1, m2, m3])) = 4) QUALIFY row_number() OVER (PARTITION BY key ORDER BY o) = 1",
    "i20_weaken_sites": f"{_SEQ}, {_TAB}, {_BASE}, {_PAIR}, {_weak_sql('pair', 'wa', 'wt', 'site_1', 'weak_1', True)}, {_weak_sql('wa', 'wb', 'wt', 'site_2', 'weak_2', False)}, {_weak_sql('wb', 'wc', 'weak_1', 'site_2', 'weak_12', False)} SELECT key, weak_1, weak_2, weak_12 FROM wc WHERE weak_1 <> wt AND weak_2 <> wt AND weak_12 <> weak_1",
}
