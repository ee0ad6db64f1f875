"""Tail probabilities for rows that are already aggregated.

Spark has no incomplete beta function; these vectorised helpers see one row per
group, never the data.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lgamma(v: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(t) for t in v])


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by the continued fraction, on whole arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    m = ok & (x > 0) & (x < 1)
    if not m.any():
        return out
    flip = x[m] > (a[m] + 1) / (a[m] + b[m] + 2)
    p = np.where(flip, b[m], a[m])
    q = np.where(flip, a[m], b[m])
    z = np.where(flip, 1 - x[m], x[m])
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for k in range(1, 10_000):
        even = k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h *= d * c
        odd = -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        step = d * c
        h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    out[m] = np.where(flip, 1 - front * h, front * h)
    return out


@F.pandas_udf(DoubleType())
def beta_cdf(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    v = regularised_beta(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float))
    return pd.Series(v).where(~np.isnan(v), None)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with ``df`` degrees of freedom."""
    d = df.cast("double")
    return F.when(df > 0, beta_cdf(d / 2, F.lit(0.5), d / (d + t * t)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation coefficient over n pairs."""
    df = n - 2
    x = F.greatest(F.lit(0.0), 1 - r * r)
    return F.when((df > 0) & r.isNotNull(), beta_cdf(df.cast("double") / 2, F.lit(0.5), x))


def binomial_upper(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair trials."""
    kk, nn = k.cast("double"), n.cast("double")
    return F.when(kk <= 0, 1.0).otherwise(beta_cdf(kk, nn - kk + 1, F.lit(0.5)))
