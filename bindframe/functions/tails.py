"""Tails of distributions: log gamma, Student's t, and the hypergeometric sum of Fisher's test as column expressions; incomplete beta in numpy on batches of rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bindframe.functions.calling import let

#: Steps of the continued fraction; it settles in about the square root of its larger parameter.
STEPS = 400
#: A denominator that comes to 0 is replaced by this.
TINY = 1e-300
#: Standard deviations on either side of the mode beyond which a hypergeometric term is 0 as a double.
REACH = 40


def log_gamma[V: (Column, np.ndarray)](x: V, log: Callable[[V], V] = F.log) -> V:
    """ln of gamma(x) for x > 0: the asymptotic series at x + 10, and the recurrence down from there."""
    y = x + 10.0
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi)
    power = y
    # B(2n) / (2n (2n - 1)) of the Bernoulli numbers
    for n, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730), 1):
        series = series + (b / (2 * n * (2 * n - 1))) / power
        power = power * y * y
    product = x
    for i in range(1, 10):
        product = product * (x + float(i))
    return series - log(product)


def _log_gamma_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of gamma(a + b) / gamma(a); by its series where a is so large that the difference of two logs would lose digits."""
    series = b * np.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)
    return np.where((a > 1e6) & (b < 1e3), series, log_gamma(a + b, np.log) - log_gamma(a, np.log))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function from the front; a row goes on until a step leaves it as it is, STEPS at most."""
    safe = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    out = np.empty_like(x)
    at = np.arange(len(x))
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, STEPS + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / safe(1 + even * d), safe(1 + even / c)
        near = h * c * d
        d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
        new = near * c * d
        going = ~((np.abs(near - h) <= 1e-16 * np.abs(h)) & (np.abs(new - near) <= 1e-16 * np.abs(h))) & ~np.isnan(new)
        h = new
        if not going.all():
            out[at[~going]] = h[~going]
            at, a, b, x, c, d, h = (v[going] for v in (at, a, b, x, c, d, h))
        if not len(at):
            break
    out[at] = h
    return out


@F.pandas_udf(DoubleType())
def _beta_of_batch(a: pd.Series, b: pd.Series, x: pd.Series, rest: pd.Series) -> pd.Series:
    a, b, x, rest = (v.to_numpy("float64", na_value=np.nan) for v in (a, b, x, rest))
    with np.errstate(all="ignore"):
        turn = x >= (a + 1) / (a + b + 2)
        p, q, near, far = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, rest, x), np.where(turn, x, rest)
        large, small = np.maximum(p, q), np.minimum(p, q)
        front = np.exp(_log_gamma_step(large, small) - log_gamma(small, np.log) + p * np.log(near) + q * np.where(near < 0.5, np.log1p(-near), np.log(far)))
        tail = front * _fraction(p, q, near) / p
        value = np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, np.where(turn, 1 - tail, tail)))
    return pd.Series(value).where(~np.isnan(x), None)


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 <= x <= 1, by the fraction on the side where it settles fast.

    rest is 1 - x, for callers that know it to more digits than x leaves. Null or NaN gives null.
    """
    return _beta_of_batch(a, b, x, 1 - x if rest is None else rest)


def t_p(t: Column, dof: Column, side: str = "two") -> Column:
    """The p value of a t statistic: 'two' sides, 'greater' or 'less'. Beyond 1e9 degrees of freedom p no longer changes in its ninth digit, so they count as 1e9."""
    dof = F.least(dof, F.lit(1e9))
    both = incomplete_beta(dof / 2, F.lit(0.5), dof / (dof + t * t), t * t / (dof + t * t))
    if side == "two":
        return both
    upper = t if side == "greater" else -t
    return F.when(upper >= 0, both / 2).otherwise(1 - both / 2)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The two-sided p value of Fisher's exact test on a 2 x 2 table: the sum of all tables as likely as this one or less.

    Tables farther than REACH standard deviations from the mode have a likelihood of 0 in doubles and are left out, so the
    sum has terms in proportion to the root of the counts.
    """
    row, column, n = a + b, a + c, a + b + c + d
    fact = lambda x: log_gamma(x + 1.0)

    def with_fixed(v: Column) -> Column:
        r, k, n, at = v["r"], v["k"], v["n"], v["a"]
        ln = lambda x: v["const"] - fact(x) - fact(r - x) - fact(k - x) - fact(n - r - k + x)
        spread = F.sqrt(r * k * (n - r) * (n - k) / F.greatest(n * n * (n - 1), F.lit(1.0))) * REACH + 50
        mode = F.floor((r + 1) * (k + 1) / (n + 2))
        low, high = F.greatest(F.lit(0.0), r + k - n, mode - spread).cast("long"), F.least(r, k, mode + spread).cast("long")
        return let(ln(at), lambda own: F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, x: let(ln(x.cast("double")), lambda w: acc + F.when(w <= own + 1e-7, F.exp(w)).otherwise(F.lit(0.0)))))

    const = fact(row) + fact(n - row) + fact(column) + fact(n - column) - fact(n)
    fixed = F.struct(row.alias("r"), column.alias("k"), n.alias("n"), a.alias("a"), const.alias("const"))
    return F.least(F.lit(1.0), let(fixed, with_fixed))
