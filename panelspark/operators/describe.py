"""Descriptive statistics, correlation, simple regressions, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dist import chi2_sf, t_sf
from panelspark.functions.series import sliding


def first_at(value: Column, ts: str = "ts") -> Column:
    """Order for max_by: larger value first, earlier date on ties."""
    return F.struct(value, -F.unix_date(ts))


def series_summary(df: DataFrame, value: str, keys: Sequence[str] = ("entity",), upper: float = 2.0) -> DataFrame:
    """Moments, dated extremes, and counts below zero and above ``upper``."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min_value"), F.max_by("ts", first_at(-v)).alias("min_date"),
        F.max(value).alias("max_value"), F.max_by("ts", first_at(v)).alias("max_date"),
        F.count_if(v < 0).alias("n_negative"), F.count_if(v > upper).alias("n_above"))


def terminal_index(indexed: DataFrame, keys: Sequence[str] = ("entity", "indicator")) -> DataFrame:
    known = F.when(F.col("index_value").isNotNull(), F.col("ts"))
    last = F.max_by("index_value", known)
    return indexed.groupBy(*keys).agg(last.alias("index_terminal"), (last - 100.0).alias("cumulative_pct"))


def in_periods(df: DataFrame, periods: Sequence[Sequence]) -> DataFrame:
    """Each row once per labelled period that contains it."""
    hits = F.array_compact(F.array(*[F.when(F.col("ts").between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in periods]))
    return df.withColumn("period", F.explode(hits))


def period_summary(df: DataFrame, value: str, periods, keys=("entity",), upper: float = 2.0) -> DataFrame:
    v = F.col(value)
    return in_periods(df.filter(v.isNotNull()), periods).groupBy(*keys, "period").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.count_if(v < 0).alias("n_negative"), F.count_if(v > upper).alias("n_above"))


def peer_gap(df: DataFrame, value: str) -> DataFrame:
    """Value minus the mean of all other entities, only on dates where every entity is known.

    The peers' mean comes from the date's total, so no entity is paired with another.
    """
    entities = df.agg(F.count_distinct("entity").alias("_all"))
    per_day = df.filter(F.col(value).isNotNull()).groupBy("ts").agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    full = per_day.join(entities, F.col("_n") == F.col("_all"))
    return df.join(full, "ts").select("entity", "ts", (F.col(value) - (F.col("_sum") - F.col(value)) / (F.col("_n") - 1)).alias("gap"))


def corr_matrix(df: DataFrame, columns: Sequence[str], keys=("entity",)) -> DataFrame:
    """Pearson correlations of the jointly known rows, long, one aggregate for the whole matrix."""
    known = df.na.drop("any", subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    agg = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"_{a}__{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"),
                               (F.lit(1.0) if a == b else F.col(f"_{a}__{b}" if (a, b) in pairs else f"_{b}__{a}")).alias("r"))
                      for a in columns for b in columns])
    return agg.select(*keys, "n", F.explode(cells).alias("_p")).select(*keys, "_p.row", "_p.col", "_p.r", "n")


def cross_lag_corr(df: DataFrame, target: str, others: Sequence[str], lags=(0, 1, 3, 6, 12), keys=("entity",)) -> DataFrame:
    """corr(target_t, x_{t-k}) on the pairwise known rows."""
    wide = sliding(df, keys, lambda w: {f"_{x}_{k}": F.lag(x, k).over(w) if k else F.col(x) for x in others for k in lags},
                   back=max(lags), keep=[*keys, "ts", target])
    both = {(x, k): F.col(target).isNotNull() & F.col(f"_{x}_{k}").isNotNull() for x in others for k in lags}
    agg = wide.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(x).alias("indicator"), F.lit(k).cast("bigint").alias("lag"), F.corr(target, f"_{x}_{k}").alias("r"),
                 F.count_if(both[x, k]).alias("n")) for x in others for k in lags]).alias("_a"))
    return agg.select(*keys, F.explode("_a").alias("_p")).select(*keys, "_p.*")


def argmax_lag(corr: DataFrame, keys=("entity", "indicator")) -> DataFrame:
    """Lag with the largest absolute correlation; the shorter lag on ties."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag")))
    return corr.filter(F.col("r").isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.lag", "_b.r")


def sign_label(r: Column, threshold: float = 0.10) -> Column:
    return F.when(r < -threshold, "negative").when(r > threshold, "positive").otherwise("near-zero")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.10, ".").otherwise("")


def _ols_columns(n, sxx, syy, sxy, mx, my) -> dict[str, Column]:
    slope = sxy / sxx
    rss = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    s2 = F.try_divide(rss, n - 2)
    se = F.sqrt(s2 / sxx)
    return {"n": n, "intercept": my - slope * mx, "slope": slope, "se_intercept": F.sqrt(s2 * (1.0 / n + mx * mx / sxx)),
            "se_slope": se, "r2": sxy * sxy / (sxx * syy), "t_slope": F.try_divide(slope, se)}


def ols_by_period(df: DataFrame, y: str, x: str, periods: Sequence[Sequence], keys=("entity",)) -> DataFrame:
    """y on a constant and x in each labelled period; fewer than 3 rows or no variation gives no row."""
    rows = in_periods(df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()), periods)
    sums = rows.groupBy(*keys, "period").agg(
        F.regr_count(y, x).alias("_n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"), F.regr_avgx(y, x).alias("_mx"), F.regr_avgy(y, x).alias("_my"))
    kept = sums.filter((F.col("_n") >= 3) & (F.col("_sxx") > 1e-12) & (F.col("_syy") > 1e-12))
    cols = _ols_columns(*[F.col(f"_{c}") for c in ("n", "sxx", "syy", "sxy", "mx", "my")])
    out = kept.select(*keys, "period", *[c.alias(k) for k, c in cols.items()])
    return out.withColumn("p_slope", t_sf("t_slope", (F.col("n") - 2).cast("double")))


def rolling_ols(df: DataFrame, y: str, x: str, window: int = 60, keys=("entity",)) -> DataFrame:
    """The same regression on the last ``window`` rows, right aligned."""
    def build(w):
        f = w.rowsBetween(-(window - 1), 0)
        return {"_n": F.regr_count(y, x).over(f), "_sxx": F.regr_sxx(y, x).over(f), "_syy": F.regr_syy(y, x).over(f),
                "_sxy": F.regr_sxy(y, x).over(f), "_mx": F.regr_avgx(y, x).over(f), "_my": F.regr_avgy(y, x).over(f)}

    sums = sliding(df, keys, build, back=window - 1, keep=[*keys, "ts"])
    kept = sums.filter((F.col("_n") == window) & (F.col("_sxx") > 1e-12) & (F.col("_syy") > 1e-12))
    cols = _ols_columns(*[F.col(f"_{c}") for c in ("n", "sxx", "syy", "sxy", "mx", "my")])
    out = kept.select(*keys, F.col("ts").alias("window_end"), *[c.alias(k) for k, c in cols.items()])
    return out.withColumn("p_slope", t_sf("t_slope", (F.col("n") - 2).cast("double")))


def latest_per_entity(df: DataFrame, order: str, keys=("entity",)) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_b")).select(*keys, "_b.*")


def acf(df: DataFrame, value: str, max_lag: int = 40, keys=("entity",), unit: str = "month") -> DataFrame:
    """Biased sample autocorrelation with its white-noise band."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, "ts", value)
    means = known.groupBy(*keys).agg(F.avg(value).alias("_m"))
    dev = known.join(means, list(keys)).select(*keys, "ts", (F.col(value) - F.col("_m")).alias("_d"))
    wide = sliding(dev, keys, lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)}, back=max_lag, unit=unit)
    sums = wide.groupBy(*keys).agg(F.count("_d").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_c0"), F.array(
        *[F.sum(F.col("_d") * F.col(f"_l{k}")) for k in range(1, max_lag + 1)]).alias("_c"))
    out = sums.select(*keys, "n", "_c0", F.posexplode(F.concat(F.array("_c0"), "_c")).alias("lag", "_ck"))
    out = out.filter(F.col("_ck").isNotNull() & (F.col("_c0") > 0))
    return out.select(*keys, "n", F.col("lag").cast("bigint").alias("lag"), (F.col("_ck") / F.col("_c0")).alias("acf"),
                      (1.96 / F.sqrt("n")).alias("band")).withColumn("significant", F.abs("acf") > F.col("band"))


def partial_from_acf(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion; ``r`` starts with r_0 = 1."""
    out = np.empty(len(r))
    out[0] = 1.0
    phi = np.zeros(0)
    for k in range(1, len(r)):
        denom = 1.0 - phi @ r[1:k]
        last = (r[k] - phi @ r[k - 1:0:-1]) / denom if denom != 0 else np.nan
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _pacf(acfs: pd.Series) -> pd.Series:
    return acfs.map(lambda a: partial_from_acf(np.asarray(a, float)).tolist())


def pacf(acf_rows: DataFrame, keys=("entity",)) -> DataFrame:
    """Partial autocorrelations from the rows of ``acf``; per key one array of max_lag + 1 numbers."""
    packed = acf_rows.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("_a"))
    out = packed.select(*keys, "n", F.posexplode(_pacf("_a")).alias("lag", "pacf"))
    return out.select(*keys, "n", F.col("lag").cast("bigint").alias("lag"), "pacf").withColumn(
        "significant", F.abs("pacf") > 1.96 / F.sqrt("n"))


def ljung_box(acf_rows: DataFrame, lags=(12, 24, 36), keys=("entity",)) -> DataFrame:
    """n(n+2) * sum r_k^2/(n-k) with its chi-square tail, for even lag counts."""
    n = F.col("n")
    term = F.try_divide(F.col("acf") * F.col("acf"), n - F.col("lag"))
    agg = acf_rows.filter(F.col("lag") >= 1).groupBy(*keys).agg(F.first("n").alias("n"), F.array(*[
        F.struct(F.lit(m).cast("bigint").alias("lags"), F.sum(F.when(F.col("lag") <= m, term)).alias("s"), F.max("lag").alias("mx")) for m in lags]).alias("_a"))
    out = agg.select(*keys, "n", F.explode("_a").alias("_p")).filter(F.col("_p.mx") >= F.col("_p.lags")).select(
        *keys, "n", "_p.lags", (n * (n + 2) * F.col("_p.s")).alias("q"))
    p = F.lit(None).cast("double")
    for m in lags:
        p = F.when(F.col("lags") == m, chi2_sf(F.col("q"), m)).otherwise(p)
    return out.withColumn("p_value", p).withColumn("reject", F.col("p_value") < 0.05)


def arma_hint(acf_rows: DataFrame, pacf_rows: DataFrame, keys=("entity",)) -> DataFrame:
    """Order suggestion from the number of significant lags 1-5 and 6-12."""
    def count(df, a, b, name):
        return F.count_if(F.col("significant") & F.col("lag").between(a, b)).alias(name)

    a = acf_rows.groupBy(*keys).agg(count(acf_rows, 1, 5, "q_cand"), count(acf_rows, 6, 12, "_al"))
    p = pacf_rows.groupBy(*keys).agg(count(pacf_rows, 1, 5, "p_cand"), count(pacf_rows, 6, 12, "_pl"))
    both = a.join(p, list(keys))
    hint = (F.when((F.col("p_cand") > 0) & (F.col("_al") >= 3), F.format_string("AR(%d)", "p_cand"))
            .when((F.col("q_cand") > 0) & (F.col("_pl") >= 3), F.format_string("MA(%d)", "q_cand"))
            .when((F.col("p_cand") > 0) & (F.col("q_cand") > 0), F.format_string("ARMA(%d,%d)", "p_cand", "q_cand"))
            .otherwise("white noise"))
    return both.select(*keys, "p_cand", "q_cand", hint.alias("hint"))


def rolling_abs_mean(df: DataFrame, value: str, window: int = 12, keys=("entity",)) -> DataFrame:
    def build(w):
        f = w.rowsBetween(-(window - 1), 0)
        return {"rolling_abs_mean": F.when(F.count(value).over(f) == window, F.avg(F.abs(value)).over(f))}
    return sliding(df, keys, build, back=window - 1)


def heatmap_pivot(long: DataFrame, row: str, col: str, value: str, order: Sequence[str]) -> DataFrame:
    """Matrix with a fixed column order; cells hold the first value."""
    return long.groupBy(row).pivot(col, list(order)).agg(F.first(value))


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


