"""Student's t distribution for p-values and intervals, in numpy, called on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, np.where(low, x, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN where t or df is unknown or df is not positive."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = ~np.isnan(t) & (df > 0)
    out = np.full(t.shape, np.nan)
    if ok.any():
        inf = np.isinf(t[ok])
        x = df[ok] / (df[ok] + np.where(inf, 0, t[ok]) ** 2)
        out[ok] = np.where(inf, 0.0, incomplete_beta(df[ok] / 2, np.full(ok.sum(), 0.5), x))
    return out


def quantile(p: float, df: np.ndarray) -> np.ndarray:
    """t with P(T <= t) = p, for p of 0.5 or more, by bisection."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(200):
        mid = (low + high) / 2
        above = 1 - two_sided(mid, df) / 2 < p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.where(df > 0, (low + high) / 2, np.nan)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    p = two_sided(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
    return pd.Series(p).where(~np.isnan(p), None)


@F.pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    q = quantile(0.975, df.to_numpy(float, na_value=np.nan))
    return pd.Series(q).where(~np.isnan(q), None)
