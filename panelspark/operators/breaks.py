"""Structural breaks: Chow tests, robust variants, coefficient shifts, sup-Wald scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dist import f_sf, norm_sf
from panelspark.functions.series import period_index, sliding
from panelspark.functions.solve import least_squares, none_if_nan, scaled_inverse, unpack
from panelspark.operators.audit import month_distance
from panelspark.operators.clean import all_known
from panelspark.operators.expanding import SPAN, expanding
from panelspark.operators.gram import add_arrays, gram, prefix_gram, with_const
from panelspark.schema import attach

# Asymptotic critical values of sup-F by trimming share and number of restrictions (Andrews 1993, Table I),
# as (10%, 5%, 1%).
SUP_F_CRIT = {
    0.05: [(7.63, 9.31, 13.00), (10.44, 12.41, 16.45), (12.86, 14.94, 19.17), (15.00, 17.13, 21.42), (17.00, 19.39, 23.74),
           (18.91, 21.36, 25.87), (20.78, 23.26, 27.93)],
    0.10: [(7.37, 9.03, 12.45), (10.10, 12.02, 15.78), (12.42, 14.50, 18.44), (14.43, 16.57, 20.62), (16.44, 18.82, 23.04),
           (18.31, 20.72, 25.12), (20.17, 22.60, 27.14)],
    0.15: [(7.17, 8.85, 12.16), (9.84, 11.79, 15.32), (12.17, 14.17, 17.90), (14.21, 16.31, 20.26), (16.19, 18.48, 22.53),
           (18.12, 20.52, 24.67), (20.02, 22.52, 26.75)],
    0.20: [(6.94, 8.56, 11.69), (9.65, 11.54, 14.96), (11.90, 13.84, 17.41), (13.99, 16.06, 19.93), (15.90, 18.24, 22.23),
           (17.80, 20.27, 24.33), (19.71, 22.26, 26.33)],
    0.25: [(6.74, 8.33, 11.38), (9.38, 11.22, 14.70), (11.69, 13.61, 16.98), (13.73, 15.75, 19.52), (15.67, 17.97, 21.85),
           (17.52, 19.91, 23.88), (19.41, 21.93, 25.93)],
}
HAC_LAGS = 4
FAMILY = 12

CHOW = T.StructType([T.StructField("F", T.DoubleType()), T.StructField("rss_restricted", T.DoubleType()),
                     T.StructField("rss_unrestricted", T.DoubleType())])


def _chow(pre: Column, total: Column, m: int) -> Column:
    """F from the sums before the break and the sums of all rows; the last column is the response."""
    k = m - 1

    @F.pandas_udf(CHOW)
    def stat(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ga, gb = unpack(a.tolist(), m), unpack(b.tolist(), m)
        xs = list(range(k))
        n = gb[:, 0, 0]
        restricted = least_squares(gb, xs, k)[1]
        free = least_squares(ga, xs, k)[1] + least_squares(gb - ga, xs, k)[1]
        with np.errstate(all="ignore"):
            f = ((restricted - free) / k) / (free / (n - 2 * k))
        small = (ga[:, 0, 0] <= k) | (n - ga[:, 0, 0] <= k)
        f = np.where(small, np.nan, f)
        return pd.DataFrame({"F": pd.Series([none_if_nan(v) for v in f], dtype=object),
                             "rss_restricted": np.where(small, np.nan, restricted), "rss_unrestricted": np.where(small, np.nan, free)})

    return stat(pre, total)


def _usable(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return with_const(df.filter(all_known([y, *xs]))).select(*keys, "ts", "const", *xs, y)


def chow_classical(df: DataFrame, y: str, xs: Sequence[str], breaks: Sequence[Sequence], keys=("entity",)) -> DataFrame:
    """Chow F with equal error variance. Rows are read once: sums per segment between breaks, combined per break."""
    columns = ["const", *xs, y]
    m, k = len(columns), len(columns) - 1
    days = sorted(d for _, d in breaks)
    rows = _usable(df, y, xs, keys)
    segment = sum(((F.col("ts") >= F.lit(d)).cast("bigint") for d in days[1:]), (F.col("ts") >= F.lit(days[0])).cast("bigint"))
    parts = gram(rows.withColumn("_seg", segment), [*keys, "_seg"], columns)
    fan = attach(parts, [(n, d, days.index(d) + 1) for n, d in breaks], ["break_name", "break_date", "_at"])
    size = m * (m + 1) // 2
    sums = fan.groupBy(*keys, "break_name", "break_date").agg(
        add_arrays("g", size, "_seg < _at").alias("_pre"), add_arrays("g", size).alias("_all"))
    out = sums.withColumn("_c", _chow(F.col("_pre"), F.col("_all"), m)).withColumn("n_total", F.col("_all")[0].cast("bigint")) \
        .withColumn("n_pre", F.col("_pre")[0].cast("bigint"))
    return _finish(out.select(*keys, "break_name", "break_date", F.col("_c.F").alias("F"), F.nanvl("_c.rss_restricted", F.lit(None)).alias("rss_restricted"),
                              F.nanvl("_c.rss_unrestricted", F.lit(None)).alias("rss_unrestricted"), "n_total", "n_pre"), k)


def _finish(df: DataFrame, k: int, nuisance: int = 0) -> DataFrame:
    """Degrees of freedom, p-value and error text common to the Chow variants."""
    df2 = F.greatest(F.lit(0), F.col("n_total") - 2 * k - nuisance)
    small = (F.col("n_pre") <= k) | (F.col("n_total") - F.col("n_pre") <= k)
    out = df.withColumn("n_post", F.col("n_total") - F.col("n_pre")).withColumn("df_num", F.lit(k).cast("bigint")).withColumn("df_denom", df2.cast("bigint"))
    out = out.withColumn("F", F.when(~small, F.col("F")))
    return out.withColumn("p_value", f_sf("F", F.col("df_num").cast("double"), F.col("df_denom").cast("double"))).withColumn(
        "error", F.when(small, F.format_string("sub-sample too small (pre=%d, post=%d)", "n_pre", "n_post")))


def _moment_pairs(k: int) -> list[tuple[int, int]]:
    """Column pairs of the products v = (x_a x_c, x_a y); column k is the response."""
    return [(a, c) for a in range(k) for c in range(a, k)] + [(a, k) for a in range(k)]


def _moment_rows(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], lags: int, nuisance: Sequence | None = None):
    """Usable rows for ``_products``: columns (constant, xs, period dummy, response) with their lags and the rows around each row.

    Returns (rows with a period number ``_tag`` and ``near``, names of the lagged columns, means and deviations per key). xs and response are
    standardised per key, which changes no joint test of all coefficients and keeps sums of fourth powers exact.
    """
    names = [*xs, y]
    rows = df.filter(all_known(names)).select(*keys, "ts", *names)
    stats = rows.groupBy(*keys).agg(*[f(c).alias(f"_{o}_{c}") for c in names for o, f in (("m", F.avg), ("s", F.stddev_pop))])
    stats = stats.select(*keys, F.array(*[F.col(f"_m_{c}") for c in names]).alias("mean"),
                         F.array(*[F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in names]).alias("sd"))
    period = [] if nuisance is None else [F.col("ts").between(F.lit(nuisance[0]), F.lit(nuisance[1])).cast("double").alias("_period")]
    columns = ["const", *xs, *(["_period"] if period else []), y]
    scaled = rows.join(stats, list(keys)).select(*keys, "ts", F.lit(1.0).alias("const"), *period,
                                                 *[((F.col(c) - F.col("mean")[i]) / F.col("sd")[i]).alias(c) for i, c in enumerate(names)])

    def build(w):
        out = {f"_l{lag}_{c}": F.lag(c, lag, 0.0).over(w) for lag in range(1, lags + 1) for c in columns}
        return out | {f"_a{at}_{c}": F.lead(c, at, 0.0).over(w) for at in range(1, lags) for c in columns}

    ready = sliding(scaled, keys, build, back=lags, ahead=lags).withColumn("_tag", period_index("ts"))
    lagged = [*columns, *[f"_l{lag}_{c}" for lag in range(1, lags + 1) for c in columns]]
    around = [*[f"_l{lag}_{c}" for lag in range(lags, 0, -1) for c in columns], *columns, *[f"_a{at}_{c}" for at in range(1, lags) for c in columns]]
    return ready.withColumn("near", F.array(*around)), lagged, stats


def _products(k: int, lags: int):
    """Products v of every row and those of the rows 0 to ``lags`` before it."""
    first, second = zip(*_moment_pairs(k))

    def factors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.reshape(len(x), lags + 1, k + 1)
        v = x[:, :, list(first)] * x[:, :, list(second)]
        return v[:, 0], v.reshape(len(x), (lags + 1) * len(first))

    return factors


def _inverse_or_nan(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        out = np.full(a.shape, np.nan)
        for i, m in enumerate(a):
            if np.isfinite(m).all() and np.linalg.matrix_rank(m) == len(m):
                out[i] = np.linalg.inv(m)
        return out


def _hac_at(before: np.ndarray, total: np.ndarray, near: np.ndarray, k: int, lags: int, pre: np.ndarray, post: np.ndarray):
    """Coefficients (r, d) and their Newey-West covariance (r, d, d) at each of r dates.

    ``before`` (r, size, size * (lags + 1)) and ``total`` hold sums of v_t v_{t-l}' for all lags l, ``near`` (r, 2 lags, k + 1) the rows around
    each date. A row's regressors are ``pre`` or ``post`` (d, k) times its k columns, by its side of the date. Scores are linear in v, so
    every autocovariance of the scores follows from the sums. Pairs that straddle the date come from the nearby rows.
    """
    pairs = _moment_pairs(k)
    index = {p: i for i, p in enumerate(pairs)}
    size = len(pairs)
    square, right = [[index[min(i, j), max(i, j)] for j in range(k)] for i in range(k)], [index[i, k] for i in range(k)]
    own, to = (before, total - before), (pre, post)
    sums = [o[:, 0, :size] for o in own]
    inv = scaled_inverse(sum(m @ s[:, square] @ m.T for m, s in zip(to, sums)))
    beta = (inv @ sum(m @ s[:, right, None] for m, s in zip(to, sums)))[:, :, 0]
    lift = []
    for m in to:
        gamma = beta @ m
        up = np.zeros((len(before), k, size))
        for i in range(k):
            up[:, i, right[i]] = 1.0
            for j in range(k):
                up[:, i, square[i][j]] -= gamma[:, j]
        lift.append(m @ up)
    around = near[:, :, [a for a, _ in pairs]] * near[:, :, [c for _, c in pairs]]       # v of rows -lags .. lags - 1
    meat = np.zeros((len(before), len(pre), len(pre)))
    for lag in range(lags + 1):
        block = slice(lag * size, (lag + 1) * size)
        straddle = around[:, lags:lags + lag].transpose(0, 2, 1) @ around[:, lags - lag:lags]
        g = lift[0] @ own[0][:, :, block] @ lift[0].transpose(0, 2, 1)
        g += lift[1] @ (own[1][:, :, block] - straddle) @ lift[1].transpose(0, 2, 1)
        if lag:
            g += lift[1] @ straddle @ lift[0].transpose(0, 2, 1)
            g = (1 - lag / (lags + 1)) * (g + g.transpose(0, 2, 1))
        meat += g
    return beta, inv @ meat @ inv


def _wald(beta: np.ndarray, cov: np.ndarray, tested: slice) -> np.ndarray:
    """Wald statistic of 'the tested coefficients are zero' by their number; NaN if the covariance is singular."""
    b, v = beta[:, tested], cov[:, tested, tested]
    return np.einsum("bi,bij,bj->b", b, _inverse_or_nan(v), b) / b.shape[1]


def _shifted(k: int, nuisance: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (k columns, the same after the date, nuisance columns) from the columns of a row before and after the date."""
    pre, post = np.zeros((2 * k + nuisance, k + nuisance)), np.zeros((2 * k + nuisance, k + nuisance))
    for m in (pre, post):
        m[:k, :k] = np.eye(k)
        m[2 * k:, k:] = np.eye(nuisance)
    post[k:2 * k, :k] = np.eye(k)
    return pre, post


def _near_rows(frame: pd.DataFrame, lags: int, k: int) -> np.ndarray:
    return np.stack([np.zeros((2 * lags, k + 1)) if v is None else np.asarray(v, float).reshape(2 * lags, k + 1) for v in frame["near"]]) \
        if len(frame) else np.zeros((0, 2 * lags, k + 1))


def _at_breaks(df: DataFrame, y: str, xs: Sequence[str], breaks: Sequence[Sequence], lags: int, keys: Sequence[str], fields, solve, nuisance=None) -> DataFrame:
    """(keys, break_name, break_date, fields): ``solve`` on the sums before each break. History is read once, whatever the number of breaks."""
    keys = list(keys)
    ready, lagged, stats = _moment_rows(df, y, xs, keys, lags, nuisance)
    k = 1 + len(xs) + (nuisance is not None)
    firsts = ready.groupBy(*keys).agg(*[F.min_by("near", F.when(F.col("ts") >= F.lit(d), F.col("ts"))).alias(f"_n{i}") for i, (_, d) in enumerate(breaks)])
    named = [F.struct(F.lit(n).alias("break_name"), F.lit(d).cast("date").alias("break_date"), period_index(F.date_sub(F.lit(d), 1)).alias("_tag"), F.col(f"_n{i}").alias("near"))
             for i, (n, d) in enumerate(breaks)]
    targets = firsts.select(*keys, F.explode(F.array(*named)).alias("_p")).select(*keys, "_p.*").join(stats, keys)
    head = [T.StructField("break_name", T.StringType()), T.StructField("break_date", T.DateType())]
    return expanding(ready, keys, lagged, [_products(k, lags)], "_tag", targets, [*head, *fields], solve)


def chow_hac(df: DataFrame, y: str, xs: Sequence[str], breaks: Sequence[Sequence], lags: int = HAC_LAGS, nuisance: Sequence | None = None,
             keys=("entity",)) -> DataFrame:
    """Chow test as a Wald test on dummy interactions with a Newey-West covariance; no row is repeated per break.

    ``nuisance`` (start, end) adds a period dummy that is estimated but not tested; its coefficient is reported.
    """
    k, extra = 1 + len(xs), int(nuisance is not None)
    pre, post = _shifted(k, extra)

    def solve(sums, totals, frame):
        n_pre = sums[0][:, 0, 0]
        beta, cov = _hac_at(sums[0], totals[0], _near_rows(frame, lags, k + extra), k + extra, lags, pre, post)
        out = frame[["break_name", "break_date"]].copy()
        out["F"] = pd.Series([none_if_nan(v) for v in _wald(beta, cov, slice(k, 2 * k))], dtype=object, index=out.index)
        out["n_total"], out["n_pre"] = int(round(totals[0][0, 0])), np.round(n_pre).astype(np.int64)
        if extra:
            sd = np.array([v[-1] for v in frame["sd"]])
            out["period_coef"], out["period_se"] = beta[:, -1] * sd, np.sqrt(cov[:, -1, -1]) * sd
        return out

    fields = [T.StructField("F", T.DoubleType()), T.StructField("n_total", T.LongType()), T.StructField("n_pre", T.LongType()),
              *[T.StructField(c, T.DoubleType()) for c in ("period_coef", "period_se")[:2 * extra]]]
    return _finish(_at_breaks(df, y, xs, breaks, lags, keys, fields, solve, nuisance), k, extra)


def coef_shift(df: DataFrame, y: str, xs: Sequence[str], breaks: Sequence[Sequence], lags: int = HAC_LAGS, keys=("entity",)) -> DataFrame:
    """Each coefficient before and after each break, with robust errors, difference and z statistic, from the same sums as ``chow_hac``."""
    base = ["const", *xs]
    k = len(base)

    def raw(beta, cov, frame):
        """Coefficients and errors in the units of the data."""
        mean, sd = (np.stack([np.asarray(v, float) for v in frame[c]]) for c in ("mean", "sd"))
        back = np.zeros((len(frame), k, k))
        back[:, 0, 0] = sd[:, -1]
        for j in range(1, k):
            back[:, j, j] = sd[:, -1] / sd[:, j - 1]
            back[:, 0, j] = -mean[:, j - 1] * back[:, j, j]
        coef = (back @ beta[:, :, None])[:, :, 0]
        coef[:, 0] += mean[:, -1]
        return coef, np.sqrt(np.einsum("bij,bjk,bik->bi", back, cov, back))

    def solve(sums, totals, frame):
        n = {"pre": sums[0][:, 0, 0], "post": totals[0][0, 0] - sums[0][:, 0, 0]}
        near, out = _near_rows(frame, lags, k), []
        enough = (n["pre"] > k) & (n["post"] > k)
        frame, near, sums = frame[enough], near[enough], sums[0][enough]
        if not len(frame):
            return pd.DataFrame(columns=[f.name for f in [*head, *fields]])
        sides = {s: raw(*_hac_at(sums, totals[0], near, k, lags, np.eye(k) * (s == "pre"), np.eye(k) * (s == "post")), frame) for s in n}
        for j, name in enumerate(base):
            part = frame[["break_name", "break_date"]].copy()
            part["variable"] = name
            for s in n:
                part[f"coef_{s}"], part[f"se_{s}"], part[f"n_{s}"] = sides[s][0][:, j], sides[s][1][:, j], np.round(n[s][enough]).astype(np.int64)
            out.append(part)
        return pd.concat(out)

    head = [T.StructField("break_name", T.StringType()), T.StructField("break_date", T.DateType())]
    fields = [T.StructField("variable", T.StringType()), *[T.StructField(f"{c}_{s}", T.LongType() if c == "n" else T.DoubleType()) for s in ("pre", "post") for c in ("coef", "se", "n")]]
    wide = _at_breaks(df, y, xs, breaks, lags, keys, fields, solve)
    se = F.sqrt(F.col("se_pre") * F.col("se_pre") + F.col("se_post") * F.col("se_post"))
    delta = F.col("coef_post") - F.col("coef_pre")
    out = wide.withColumn("delta", delta).withColumn("se_delta", se).withColumn("z_stat", F.when(se > 0, delta / se))
    return out.withColumn("p_value", norm_sf("z_stat"))


def dominant_driver(shifts: DataFrame, tests: DataFrame, alpha: float = 0.05, family: int = FAMILY, keys=("entity",)) -> DataFrame:
    """Coefficient with the largest |z| per break; null driver where the break does not survive the family-wise level."""
    by = [*keys, "break_name"]
    top = shifts.filter(F.col("z_stat").isNotNull()).groupBy(*by).agg(
        F.max_by("variable", F.struct(F.abs("z_stat"), F.col("variable"))).alias("_top"), F.max(F.abs("z_stat")).alias("max_abs_z"))
    kept = tests.select(*by, (F.coalesce(F.col("p_value") < alpha / family, F.lit(False))).alias("survives"))
    out = top.join(kept, by)
    return out.select(*by, F.when(F.col("survives"), F.col("_top")).alias("driver"), "max_abs_z", "survives",
                      F.coalesce(F.col("survives") & (F.col("_top") != "const"), F.lit(False)).alias("generates_interaction"))


def bonferroni(variants: Sequence[tuple[str, DataFrame]], alpha: float = 0.05, family: int = FAMILY, keys=("entity",)) -> DataFrame:
    out = None
    for name, df in variants:
        part = df.select(F.lit(name).alias("variant"), *keys, "break_name", "break_date", "F", "p_value", "n_total", "n_pre", "n_post")
        out = part if out is None else out.unionByName(part)
    p = F.col("p_value")
    return out.withColumn("alpha_family", F.lit(alpha / family)).withColumn("reject_nominal", F.coalesce(p < alpha, F.lit(False))).withColumn(
        "reject_family", F.coalesce(p < alpha / family, F.lit(False)))


def concordance(stacked: DataFrame, a: str, b: str, keys=("entity",)) -> DataFrame:
    """How often two variants agree at the nominal level."""
    by = [*keys, "break_name"]
    left = stacked.filter(F.col("variant") == a).select(*by, F.col("reject_nominal").alias("_a"))
    right = stacked.filter(F.col("variant") == b).select(*by, F.col("reject_nominal").alias("_b"))
    return left.join(right, by).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("_a") == F.col("_b")).alias("n_agree")).select(
        F.lit(f"{a}-{b}").alias("pair"), "n_cells", "n_agree")


def sup_wald_scan(df: DataFrame, y: str, xs: Sequence[str], pi0: float = 0.15, keys=("entity",)) -> DataFrame:
    """Chow F at every admissible break date, from running sums: the part after a date is total minus the part before."""
    columns = ["const", *xs, y]
    m, k = len(columns), len(columns) - 1
    size = m * (m + 1) // 2
    rows = _usable(df, y, xs, keys)
    total = gram(rows, keys, columns).withColumnRenamed("g", "_all")
    upto = prefix_gram(rows, keys, columns)
    own = [f"`{columns[i]}` * `{columns[j]}`" for i in range(m) for j in range(i, m)]
    before = upto.select(*keys, "ts", F.expr("array(" + ", ".join(f"g[{p}] - {own[p]}" for p in range(size)) + ")").alias("_pre"))
    scan = before.join(total, list(keys))
    n, i = F.col("_all")[0], F.col("_pre")[0]
    scan = scan.filter((i >= F.ceil(pi0 * n)) & (i <= F.floor((1 - pi0) * n)))
    return scan.select(*keys, F.col("ts").alias("candidate_date"), F.round(i).cast("bigint").alias("n_pre"), F.round(n).cast("bigint").alias("n_total"),
                       _chow(F.col("_pre"), F.col("_all"), m)["F"].alias("wald_f"))


def robust_sup_wald_scan(df: DataFrame, y: str, xs: Sequence[str], pi0: float = 0.15, lags: int = HAC_LAGS, keys=("entity",), span: int = SPAN) -> DataFrame:
    """The Newey-West Wald F of ``chow_hac`` at every admissible date, in time linear in the series' length.

    No row is repeated per candidate: sums of moment products over blocks, and inside a block over its rows, give both sides of every date.
    """
    ready, lagged, _ = _moment_rows(df, y, xs, list(keys), lags)
    k = 1 + len(xs)
    pre, post = _shifted(k)
    dates = ready.select(*keys, (F.col("_tag") - 1).alias("_tag"), F.col("ts").alias("candidate_date"), "near")

    def solve(sums, totals, frame):
        n_pre, n = sums[0][:, 0, 0], totals[0][0, 0]
        keep = (n_pre >= np.ceil(pi0 * n)) & (n_pre <= np.floor((1 - pi0) * n))
        frame, before, n_pre = frame[keep], sums[0][keep], n_pre[keep]
        f = _wald(*_hac_at(before, totals[0], _near_rows(frame, lags, k), k, lags, pre, post), slice(k, 2 * k)) if len(frame) else np.zeros(0)
        f = np.where(np.minimum(n_pre, n - n_pre) > k, f, np.nan)
        return pd.DataFrame({"candidate_date": frame["candidate_date"], "n_pre": np.round(n_pre).astype(np.int64), "n_total": int(round(n)),
                             "wald_f": pd.Series([none_if_nan(v) for v in f], dtype=object, index=frame.index)})

    fields = [T.StructField("candidate_date", ready.schema["ts"].dataType), T.StructField("n_pre", T.LongType()), T.StructField("n_total", T.LongType()),
              T.StructField("wald_f", T.DoubleType())]
    return expanding(ready, keys, lagged, [_products(k, lags)], "_tag", dates, fields, solve, span)


def scan_summary(scan: DataFrame, k: int, pi0: float = 0.15, keys=("entity",)) -> DataFrame:
    """Sup, average and exponential statistics of a scan, first date of the maximum, critical values and verdict."""
    w = F.col("wald_f")
    head = scan.groupBy(*keys).agg(
        F.max("wald_f").alias("sup_w"), F.max_by("candidate_date", F.struct(w, -F.unix_date("candidate_date"))).alias("argmax_date"),
        F.avg("wald_f").alias("avg_w"), F.count("wald_f").alias("n_candidates"), F.min("candidate_date").alias("window_start"),
        F.max("candidate_date").alias("window_end"))
    tail = scan.join(head.select(*keys, F.col("sup_w").alias("_top")), list(keys)).groupBy(*keys).agg(
        (F.max("_top") / 2 + F.ln(F.avg(F.exp((w - F.col("_top")) / 2)))).alias("exp_w"))
    crit = SUP_F_CRIT.get(pi0, [])
    c10, c5, c1 = crit[k - 1] if 0 < k <= len(crit) else (None, None, None)
    lit = [F.lit(c).cast("double") for c in (c10, c5, c1)]
    verdict = (F.when(F.col("sup_w").isNull(), "error").when(lit[1].isNull(), "no_crit_available").when(F.col("sup_w") > lit[2], "reject @ 1%")
               .when(F.col("sup_w") > lit[1], "reject @ 5%").when(F.col("sup_w") > lit[0], "reject @ 10%").otherwise("fail to reject"))
    return head.join(tail, list(keys)).select(
        *keys, F.lit(pi0).alias("pi0"), F.lit(k).cast("bigint").alias("k"), "sup_w", "argmax_date", "avg_w", "exp_w", lit[0].alias("crit_10"),
        lit[1].alias("crit_5"), lit[2].alias("crit_1"), verdict.alias("verdict"), "n_candidates", "window_start", "window_end")


def align_to_known(summary: DataFrame, breaks: Sequence[Sequence], date: str = "argmax_date", tolerance: int = 6) -> DataFrame:
    """Distance in months to each known break, and the closest one by days (first named wins ties)."""
    cols, best = [], []
    for i, (name, day) in enumerate(breaks):
        months = F.abs(month_distance(F.col(date), F.lit(day)))
        cols += [months.alias(f"months_to_{name}"), (months <= tolerance).alias(f"aligned_{name}")]
        best.append(F.struct(F.abs(F.datediff(F.col(date), F.lit(day))).alias("days"), F.lit(i).alias("i"), F.lit(name).alias("name"), months.alias("months")))
    nearest = F.array_min(F.array(*best))
    any_known = F.lit(False)
    for name, _ in breaks:
        any_known = any_known | F.col(f"aligned_{name}")
    return summary.select("*", *cols, nearest["name"].alias("closest_break"), nearest["months"].alias("months_to_closest")).withColumn("aligned_to_any", any_known)


def top_candidates(scan: DataFrame, breaks: Sequence[Sequence], n: int = 3, keys=("entity",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("wald_f"), "candidate_date")
    top = scan.filter(F.col("wald_f").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return align_to_known(top, breaks, "candidate_date").select(*keys, "rank", "candidate_date", "wald_f", "closest_break", "months_to_closest")


def trim_sensitivity(a: DataFrame, b: DataFrame, keys=("entity",)) -> DataFrame:
    """Two scan summaries side by side."""
    def named(df, s):
        return df.select(*keys, F.col("sup_w").alias(f"sup_w_{s}"), F.col("argmax_date").alias(f"argmax_{s}"), F.col("verdict").alias(f"verdict_{s}"))
    out = named(a, "1").join(named(b, "2"), list(keys))
    return out.withColumn("same_argmax", F.col("argmax_1") == F.col("argmax_2")).withColumn("same_verdict", F.col("verdict_1") == F.col("verdict_2"))


def nearest_scan_date(scan: DataFrame, breaks: Sequence[Sequence], keys=("entity",)) -> DataFrame:
    """Scan value at each break date, or at the nearest candidate (the earlier one on ties); one aggregate for all breaks."""
    def pick(day):
        return F.min_by(F.struct("candidate_date", "wald_f"), F.struct(F.abs(F.datediff("candidate_date", F.lit(day))), F.col("candidate_date")))
    agg = scan.groupBy(*keys).agg(F.array(*[F.struct(F.lit(n).alias("break_name"), F.lit(d).alias("break_date"), pick(d).alias("b")) for n, d in breaks]).alias("_a"))
    out = agg.select(*keys, F.explode("_a").alias("_p"))
    return out.select(*keys, "_p.break_name", "_p.break_date", F.col("_p.b.candidate_date").alias("scan_date"), F.col("_p.b.wald_f").alias("wald_f"),
                      (F.col("_p.b.candidate_date") == F.col("_p.break_date")).alias("exact"))


def window_coverage(scan: DataFrame, breaks: Sequence[Sequence], keys=("entity",)) -> DataFrame:
    bounds = scan.groupBy(*keys).agg(F.min("candidate_date").alias("window_start"), F.max("candidate_date").alias("window_end"))
    out = attach(bounds, [(n, d) for n, d in breaks], ["break_name", "break_date"])
    return out.withColumn("inside", F.col("break_date").between(F.col("window_start"), F.col("window_end")))

