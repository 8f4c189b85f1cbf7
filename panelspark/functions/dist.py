"""Tail probabilities and published critical values.

Even-degree chi-square tails and piecewise tables are Spark expressions; the t, F and normal tails are vectorised
pandas UDFs that see only aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b): modified Lentz evaluation of the continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tiny = 1e-300

    def safe(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    with np.errstate(all="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z)
                       + (_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float)) / p
        c = np.ones_like(z)
        d = 1.0 / safe(1.0 - (p + q) * z / (p + 1.0))
        h = d.copy()
        for m in range(1, 400):
            even = m * (q - m) * z / ((p + 2 * m - 1.0) * (p + 2 * m))
            d = 1.0 / safe(1.0 + even * d)
            c = safe(1.0 + even / c)
            h = h * d * c
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1.0))
            d = 1.0 / safe(1.0 + odd * d)
            c = safe(1.0 + odd / c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        tail = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1.0 - tail, tail)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))


def f_tail(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f <= 0, 1.0, beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.maximum(f, 0))))


def normal_two_sided(z) -> np.ndarray:
    return np.asarray([math.erfc(abs(v) / math.sqrt(2.0)) if v == v else np.nan for v in np.asarray(z, float)])


def _nulls(values, *inputs) -> pd.Series:
    """Null wherever an input is null or the result is not a number."""
    bad = np.zeros(len(values), bool)
    for s in inputs:
        bad |= pd.isna(s).to_numpy()
    bad |= ~np.isfinite(values)
    return pd.Series([None if b else float(v) for v, b in zip(values, bad)], dtype=object)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    safe = df.where(df > 0)
    return _nulls(t_two_sided(t.fillna(0), safe.fillna(1)), t, safe)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution, computed directly and not as a difference from one."""
    s1, s2 = d1.where(d1 > 0), d2.where(d2 > 0)
    return _nulls(f_tail(f.fillna(1), s1.fillna(1), s2.fillna(1)), f, s1, s2)


@F.pandas_udf(T.DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return _nulls(normal_two_sided(z.fillna(0)), z)


def chi2_sf(x: Column, df: int) -> Column:
    """Upper chi-square tail for even degrees of freedom: a finite sum."""
    if df % 2:
        raise ValueError("even degrees of freedom only")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(df // 2 - 1)) if df > 2 else F.array().cast("array<int>"),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct((acc["term"] * x / 2 / i).alias("term"),
                                (acc["total"] + acc["term"] * x / 2 / i).alias("total")),
        lambda acc: acc["total"])
    return F.exp(-x / 2) * terms


# MacKinnon (1994, 2010) response surfaces for one series.
ADF_CRIT = {
    "c": {"1": (-3.43035, -6.5393, -16.786, -79.433), "5": (-2.86154, -2.8903, -4.234, -40.040),
          "10": (-2.56677, -1.5384, -2.809, 0.0)},
    "ct": {"1": (-3.95877, -9.0531, -28.428, -134.155), "5": (-3.41049, -4.3904, -9.036, -45.374),
           "10": (-3.12705, -2.5856, -3.925, -22.380)},
}
ADF_P_SMALL = {"c": (2.1659, 1.4412, 0.038269), "ct": (3.2512, 1.6047, 0.049588)}
ADF_P_LARGE = {"c": (1.7339, 0.93202, -0.12745, -0.010368), "ct": (2.5261, 0.61654, -0.37956, -0.060285)}
ADF_TAU_STAR = {"c": -1.61, "ct": -2.89}
ADF_TAU_MIN = {"c": -18.83, "ct": -16.18}
ADF_TAU_MAX = {"c": 2.74, "ct": 0.70}
# KPSS (1992) quantiles at p = 0.10, 0.05, 0.025, 0.01.
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_CRIT = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def _poly(x: Column, coefs) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefs):
        out = out * x + F.lit(float(c))
    return out


def _normal_cdf(z: pd.Series) -> np.ndarray:
    return np.asarray([0.5 * math.erfc(-v / math.sqrt(2.0)) if v == v else np.nan for v in z.to_numpy(float)])


@F.pandas_udf(T.DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    return _nulls(_normal_cdf(z), z)


def adf_pvalue(stat: Column, spec: Column) -> Column:
    """Approximate p-value of a unit-root t statistic."""
    out = F.lit(None).cast("double")
    score = F.lit(None).cast("double")
    for s in ("c", "ct"):
        z = F.when(stat <= ADF_TAU_STAR[s], _poly(stat, ADF_P_SMALL[s])).otherwise(_poly(stat, ADF_P_LARGE[s]))
        score = F.when(spec == s, z).otherwise(score)
    cdf = norm_cdf(score)
    for s in ("c", "ct"):
        out = F.when(spec == s, F.when(stat > ADF_TAU_MAX[s], 1.0).when(stat < ADF_TAU_MIN[s], 0.0).otherwise(cdf)).otherwise(out)
    return F.when(stat.isNotNull(), out)


def adf_crit(spec: Column, nobs: Column, level: str) -> Column:
    x = 1.0 / nobs
    return F.when(spec == "c", _poly(x, ADF_CRIT["c"][level])).when(spec == "ct", _poly(x, ADF_CRIT["ct"][level]))


def kpss_pvalue(stat: Column, spec: Column) -> Column:
    """Piecewise linear between the tabulated quantiles, clamped at the ends."""
    out = F.lit(None).cast("double")
    for s, crit in KPSS_CRIT.items():
        p = F.when(stat <= crit[0], KPSS_P[0]).when(stat >= crit[-1], KPSS_P[-1])
        for (c0, c1), (p0, p1) in zip(zip(crit, crit[1:]), zip(KPSS_P, KPSS_P[1:])):
            p = p.when(stat <= c1, p0 + (stat - c0) * ((p1 - p0) / (c1 - c0)))
        out = F.when(spec == s, p).otherwise(out)
    return F.when(stat.isNotNull(), out)


def kpss_clamped(stat: Column, spec: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for s, crit in KPSS_CRIT.items():
        out = F.when(spec == s, (stat < crit[0]) | (stat > crit[-1])).otherwise(out)
    return out


def kpss_crit(spec: Column, level: str) -> Column:
    i = {"10": 0, "5": 1, "2.5": 2, "1": 3}[level]
    return F.when(spec == "c", KPSS_CRIT["c"][i]).when(spec == "ct", KPSS_CRIT["ct"][i])
