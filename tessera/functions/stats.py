"""Tail probabilities and quantiles for small results, and their pandas UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            f *= step
        if abs(step - 1) < 1e-15:
            break
    return front * f


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(q: float, df: float) -> float:
    """Value that T stays below with probability q, by bisection."""
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def _each(f, *cols: pd.Series) -> pd.Series:
    ok = np.logical_and.reduce([c.notna() for c in cols])
    out = np.full(len(cols[0]), np.nan)
    out[ok] = [f(*v) for v in zip(*[c[ok] for c in cols], strict=True)]
    return pd.Series(out).astype("Float64").mask(~pd.Series(ok))


@pandas_udf(DoubleType())
def p_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: 2 * t_sf(abs(a), b) if b > 0 else math.nan, t, df)


@pandas_udf(DoubleType())
def p_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: t_sf(a, b) if b > 0 else math.nan, t, df)


@pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: f_sf(a, b, c) if c > 0 else math.nan, f, d1, d2)


@pandas_udf(DoubleType())
def t_critical(q: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: t_quantile(a, b) if b > 0 else math.nan, q, df)


@pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return _each(lambda a: NormalDist().inv_cdf(a) if 0 < a < 1 else math.nan, p)
