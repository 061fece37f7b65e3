"""Interval arithmetic: bounds as Columns rounded to twelve places."""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

from pyspark.sql import Column, functions as F

PLACES = 12


def z_value(level: float = 0.95) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return f


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1 - x) / b


@cache
def t_value(df: int, level: float = 0.95) -> float:
    """Two-sided Student-t quantile: the bracket doubles until it holds the quantile, then it is bisected."""
    lo, hi = 0.0, 1.0
    while beta_share(df / 2, 0.5, df / (df + hi * hi)) > 1 - level:
        lo, hi = hi, 2 * hi
    while lo < (mid := (lo + hi) / 2) < hi:
        tail = beta_share(df / 2, 0.5, df / (df + mid * mid))
        lo, hi = (mid, hi) if tail > 1 - level else (lo, mid)
    return (lo + hi) / 2


#: Degrees of freedom whose quantiles are a table of literals; beyond, five terms of the expansion are exact to about 1e-13.
T_TABLE = 200


def t_column(df: Column, level: float = 0.95) -> Column:
    """Two-sided Student-t quantile by degrees of freedom; NULL below one. No rows are read for it."""
    z = z_value(level)
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160, (27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / 368640]
    far = F.lit(z)
    for i, t in enumerate(terms, 1):
        far = far + F.lit(t) / F.pow(df.cast("double"), F.lit(float(i)))
    near = F.array(*[F.lit(t_value(n, level)) for n in range(1, T_TABLE + 1)])
    return F.when(df < 1, None).when(df <= T_TABLE, F.try_element_at(near, df.cast("int"))).otherwise(far)


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Bounds of a proportion, clamped to [0, 1]; NULL without rows."""
    z = F.lit(z_value(level))
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    mid, half = (p + z * z / (2 * m)) / (1 + z * z / m), z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), mid - half), PLACES)), F.when(n > 0, F.round(F.least(F.lit(1.0), mid + half), PLACES))


def rule_of_three(n: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(3.0) / n), PLACES)
