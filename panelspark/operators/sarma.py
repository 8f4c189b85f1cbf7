"""Seasonal ARMA layer: order grids over many series by two-stage least squares (Hannan-Rissanen).

Stage one fits a long autoregression and takes its residuals; stage two regresses the series on its own lags and on
lagged residuals. Seasonal terms enter additively at multiples of the season. Every order of the grid is a sub-block of
one Gram matrix per (series, seasonal differencing), so the series are read once, whatever the size of the grid.
Estimates are not maximum likelihood: compare information criteria only with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dist import chi2_sf
from panelspark.functions.series import period_index, sliding
from panelspark.functions.solve import least_squares, unpack
from panelspark.operators import describe
from panelspark.operators.clean import all_known
from panelspark.operators.expanding import SPAN, expanding, moments
from panelspark.operators.gram import gram, ols, per_row
from panelspark.operators.transform import all_transforms

KEY = ("variant_id",)
P_MAX, Q_MAX, SP_MAX, SQ_MAX = 4, 4, 2, 2
ACCEPT = 2.0
METRICS = ("aic", "bic", "hqic")


def variants(long: DataFrame, forms: Sequence[str]) -> DataFrame:
    """(variant_id, ts, y): every (entity, form) as its own series. Input (entity, indicator, ts, value) of one indicator."""
    return all_transforms(long, forms).select(F.concat_ws("_", "entity", "form").alias("variant_id"), "ts", F.col("value").alias("y"))


def order_grid(series: DataFrame, season: int, p=P_MAX, q=Q_MAX, sp=SP_MAX, sq=SQ_MAX, sd=1, d: int = 0) -> DataFrame:
    """All orders for every series."""
    def upto(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n)).cast("array<bigint>"))
    out = series.select(*KEY).distinct()
    for name, n in (("_p", p), ("_q", q), ("_sp", sp), ("_sq", sq), ("_sd", sd)):
        out = out.withColumn(name, upto(n))
    return out.select(*KEY, F.col("_p").alias("p"), F.lit(d).cast("bigint").alias("d"), F.col("_q").alias("q"), F.col("_sp").alias("P_s"), F.col("_sd").alias("D_s"), F.col("_sq").alias("Q_s"),
                      F.lit(season).cast("bigint").alias("s")).withColumn("n_params", F.col("p") + F.col("q") + F.col("P_s") + F.col("Q_s") + 1)


def order_string(prefix: str = "") -> Column:
    """(p,d,q)(P,D,Q,s) as text; seasonal columns carry the suffix _s because column names ignore case."""
    return F.format_string("(%d,%d,%d)(%d,%d,%d,%d)", *[F.col(prefix + c) for c in ("p", "d", "q", "P_s", "D_s", "Q_s", "s")])


def parse_order(text: str) -> list[Column]:
    pattern = r"\((\d+),(\d+),(\d+)\)\((\d+),(\d+),(\d+),(\d+)\)"
    return [F.regexp_extract(text, pattern, i).cast("bigint").alias(c) for i, c in enumerate(("p", "d", "q", "P_s", "D_s", "Q_s", "s"), 1)]


def _differenced(series: DataFrame, season: int, unit: str) -> DataFrame:
    """(variant_id, D_s, ts, y, w, base): w is y or its seasonal difference, base what a forecast of w lacks to y."""
    both = sliding(series, KEY, lambda w: {"_back": F.lag("y", season).over(w)}, back=season, unit=unit)
    forms = F.array(F.struct(F.lit(0).cast("bigint").alias("D_s"), F.col("y").alias("w"), F.lit(0.0).alias("base")),
                    F.struct(F.lit(1).cast("bigint").alias("D_s"), (F.col("y") - F.col("_back")).alias("w"), F.col("_back").alias("base")))
    return both.select(*KEY, "ts", "y", F.explode(forms).alias("_p")).select(*KEY, "_p.D_s", "ts", "y", "_p.w", "_p.base")


def _stage_one(series: DataFrame, season: int, long_lag: int, unit: str) -> DataFrame:
    """(variant_id, D_s, ts, y, w, e): e is the residual of a long autoregression of w."""
    by = [*KEY, "D_s"]
    names = [f"_w{k}" for k in range(1, long_lag + 1)]
    lagged = sliding(_differenced(series, season, unit), by, lambda w: {f"_w{k}": F.lag("w", k).over(w) for k in range(1, long_lag + 1)}, back=long_lag, unit=unit)
    rows = lagged.filter(all_known(["w", *names])).withColumn("_one", F.lit(1.0))
    m = long_lag + 2
    fit = gram(rows, by, ["_one", *names, "w"]).select(*by, ols(F.col("g"), m, range(m - 1), m - 1)["beta"].alias("_b"))
    fitted = F.aggregate(F.zip_with(F.array("_one", *names), "_b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(fit, by).select(*by, "ts", "y", "w", (F.col("w") - fitted).alias("e"))


def _lag_list(season: int, short: int, seasonal: int) -> list[int]:
    return [*range(1, short + 1), *[season * k for k in range(1, seasonal + 1)]]


def _stage_two(one: DataFrame, season: int, unit: str, p=P_MAX, q=Q_MAX, sp=SP_MAX, sq=SQ_MAX) -> tuple[DataFrame, list[str]]:
    """Rows with every lag any order of the grid may use, on one common sample."""
    if season <= max(p, q):
        raise ValueError("the season must be longer than the short orders")
    ar, ma = _lag_list(season, p, sp), _lag_list(season, q, sq)
    by = [*KEY, "D_s"]
    rows = sliding(one, by, lambda w: {**{f"_a{k}": F.lag("w", k).over(w) for k in ar}, **{f"_m{k}": F.lag("e", k).over(w) for k in ma}}, back=max(*ar, *ma), unit=unit)
    names = [*[f"_a{k}" for k in ar], *[f"_m{k}" for k in ma]]
    return rows.filter(all_known(names)).withColumn("_one", F.lit(1.0)), names


def _picked(p, q, sp, sq, p_max, q_max, sp_max) -> list[int]:
    """Positions of an order's regressors in [1, short AR, seasonal AR, short MA, seasonal MA]."""
    a, s, m, t = 1, 1 + p_max, 1 + p_max + sp_max, 1 + p_max + sp_max + q_max
    return [0, *range(a, a + p), *range(s, s + sp), *range(m, m + q), *range(t, t + sq)]


GRID = [*[T.StructField(c, T.LongType()) for c in ("p", "d", "q", "P_s", "Q_s", "s", "n_params", "n_obs")], *[T.StructField(c, T.DoubleType()) for c in ("llf", *METRICS)],
        T.StructField("converged", T.BooleanType()), T.StructField("error", T.StringType())]


def fit_order_grid(series: DataFrame, season: int, long_lag: int, unit: str = "month", p=P_MAX, q=Q_MAX, sp=SP_MAX, sq=SQ_MAX) -> DataFrame:
    """Criteria of every order for every series; a fit that fails says so in ``error`` and never stops the job."""
    rows, names = _stage_two(_stage_one(series, season, long_lag, unit), season, unit, p, q, sp, sq)
    g = gram(rows, [*KEY, "D_s"], ["_one", *names, "w"])
    m = len(names) + 2

    def fit_all(packed):
        full = unpack([packed], m)
        n = full[0, 0, 0]
        for a in range(p + 1):
            for b in range(q + 1):
                for c in range(sp + 1):
                    for e in range(sq + 1):
                        xs = _picked(a, b, c, e, p, q, sp)
                        k = a + b + c + e + 1
                        head = (a, 0, b, c, e, season, k, int(round(n)))
                        rss = least_squares(full, xs, m - 1)[1][0] if n > len(xs) else 0.0
                        if rss <= 0:
                            yield (*head, None, None, None, None, False, "too few rows or no residual variation")
                            continue
                        llf = -n / 2 * (np.log(2 * np.pi * rss / n) + 1)
                        yield (*head, float(llf), float(-2 * llf + 2 * k), float(-2 * llf + np.log(n) * k), float(-2 * llf + 2 * np.log(np.log(n)) * k), True, None)

    return per_row(g, [*KEY, "D_s"], GRID, fit_all)


def order_residuals(series: DataFrame, orders: DataFrame, season: int, long_lag: int, unit: str = "month", p=P_MAX, q=Q_MAX, sp=SP_MAX, sq=SQ_MAX) -> DataFrame:
    """(variant_id, ts, e): in-sample residuals of one order per series, on the common sample of the order grid."""
    rows, names = _stage_two(_stage_one(series, season, long_lag, unit), season, unit, p, q, sp, sq)
    by, columns = [*KEY, "D_s"], ["_one", *names]
    rows = rows.join(orders.select(*by, "p", "q", "P_s", "Q_s"), by)
    m = len(columns) + 1
    g = gram(rows, [*by, "p", "q", "P_s", "Q_s"], [*columns, "w"])

    def fit(a, b, c, e, packed):
        xs = _picked(a, b, c, e, p, q, sp)
        beta = np.zeros(m - 1)
        beta[xs] = least_squares(unpack([packed], m), xs, m - 1)[0][0]
        yield (beta.tolist(),)

    beta = per_row(g, by, [T.StructField("_b", T.ArrayType(T.DoubleType()))], fit)
    value = F.aggregate(F.zip_with(F.array(*columns), "_b", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(beta, by).select(*KEY, "ts", (F.col("w") - value).alias("e"))


def _best(metric: str) -> Column:
    """Smallest metric among converged fits (any fit if none converged), fewer parameters on ties."""
    rank = F.struct(~F.col("converged"), F.col(metric), F.col("n_params"), "p", "d", "q", "P_s", "D_s", "Q_s")
    return F.min_by(F.struct(order_string().alias("order"), F.col(metric).alias("value"), "p", "d", "q", "P_s", "D_s", "Q_s", "s"), F.when(F.col(metric).isNotNull(), rank))


def select_order(grid: DataFrame, keys=KEY) -> DataFrame:
    """Best order by every criterion, agreement flags, and counts; one partial-aggregating pass."""
    agg = grid.groupBy(*keys).agg(*[_best(m).alias(f"_{m}") for m in METRICS], F.count_if("converged").alias("n_converged"), F.count(F.lit(1)).alias("n_total"))
    return agg.select(*keys, *[c for m in METRICS for c in (F.col(f"_{m}.order").alias(f"{m}_order"), F.col(f"_{m}.value").alias(f"{m}_value"))],
                      (F.col("_aic.order") == F.col("_bic.order")).alias("aic_bic_agree"), (F.col("_aic.order") == F.col("_hqic.order")).alias("aic_hqic_agree"), "n_converged", "n_total")


def residual_diagnostics(resid: DataFrame, keys=KEY, lags=(12, 24), arch_lags: int = 12, ts: str = "ts", unit: str = "month") -> DataFrame:
    """Moments, Jarque-Bera, ARCH-LM and Ljung-Box of residuals (keys, ts, e)."""
    n = F.count("e")
    moments = resid.groupBy(*keys).agg(n.alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurt_excess"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt_excess") * F.col("kurt_excess") / 4)
    moments = moments.withColumn("jb", jb).withColumn("jb_p", F.exp(-jb / 2))
    lb = describe.ljung_box(describe.acf(resid, "e", max(lags), keys, unit), lags, keys)
    wide = lb.groupBy(*keys).agg(*[F.max(F.when(F.col("lags") == m, F.col(c))).alias(f"lb{m}_{o}") for m in lags for c, o in (("q", "stat"), ("p_value", "p"))])
    names = [f"_s{k}" for k in range(1, arch_lags + 1)]
    squares = resid.select(*keys, ts, (F.col("e") * F.col("e")).alias("_s"))
    rows = sliding(squares, keys, lambda w: {f"_s{k}": F.lag("_s", k).over(w) for k in range(1, arch_lags + 1)}, back=arch_lags, unit=unit).filter(all_known(names)).withColumn("_one", F.lit(1.0))
    m = arch_lags + 2
    g = gram(rows, keys, ["_one", *names, "_s"]).withColumn("_f", ols(F.col("g"), m, range(m - 1), m - 1))
    size = m * (m + 1) // 2
    tss = F.col("g")[size - 1] - F.col("g")[m - 1] * F.col("g")[m - 1] / F.col("g")[0]
    arch = g.select(*keys, (F.col("g")[0] * (1 - F.try_divide(F.col("_f.rss"), tss))).alias("arch_lm")).withColumn("arch_p", chi2_sf(F.col("arch_lm"), arch_lags))
    return moments.join(wide, list(keys), "left").join(arch, list(keys), "left")


def expanding_one_step(series: DataFrame, orders: DataFrame, season: int, long_lag: int, first_target, unit: str = "month", p=P_MAX, q=Q_MAX, sp=SP_MAX, sq=SQ_MAX,
                       span: int = SPAN) -> DataFrame:
    """One-step forecasts of every date from ``first_target`` on, each from a refit of both stages on strictly earlier rows.

    ``orders`` (variant_id, p, q, P_s, D_s, Q_s). Residuals are linear in lags of the series, so what stage two regresses on is T v, with v the
    constant and all lags either stage needs and T made of stage one's coefficients. One sum of v v' over history serves both: at
    every date stage one is fitted on it, and T (sum of v v') T' is the matrix of stage two. Rows with a gap among the lags of v take part in
    stage one only. A date without enough earlier rows gives no forecast.
    """
    if season <= max(p, q):
        raise ValueError("the season must be longer than the short orders")
    ar, ma = _lag_list(season, p, sp), _lag_list(season, q, sq)
    long = list(range(1, long_lag + 1)) if ma else []
    used = sorted({*ar, *long, *ma, *[j + i for j in ma for i in long]})
    by, place = [*KEY, "D_s"], {lag: i + 1 for i, lag in enumerate(used)}
    rows = _differenced(series, season, unit).join(orders.select(*by), by, "left_semi")
    rows = sliding(rows, by, lambda w: {f"_w{k}": F.lag("w", k).over(w) for k in used}, back=max([1, *used]), unit=unit)
    names = [f"_w{k}" for k in used]
    rows = rows.withColumn("_tag", period_index("ts", unit))
    targets = rows.filter((F.col("ts") >= F.lit(first_target)) & all_known([*names, "w"])).select(
        *by, (F.col("_tag") - 1).alias("_tag"), "ts", "y", "base", F.array(F.lit(1.0), *names).alias("v"))
    targets = targets.join(orders.select(*by, "p", "q", "P_s", "Q_s"), by, "left")  # each has one, see above

    def solve(sums, totals, frame):
        a, b, c, e = (int(frame[o].iloc[0]) for o in ("p", "q", "P_s", "Q_s"))
        mine = [*range(1, a + 1), *[season * k for k in range(1, c + 1)]]
        noise = [*range(1, b + 1), *[season * k for k in range(1, e + 1)]]
        width, wide = len(used) + 2, 1 + len(mine) + len(noise)
        t = np.zeros((len(frame), wide + 1, width))
        t[:, 0, 0] = t[:, wide, width - 1] = 1.0
        for i, lag in enumerate(mine, 1):
            t[:, i, place[lag]] = 1.0
        if noise:
            phi = least_squares(sums[1], list(range(len(long) + 1)), len(long) + 1)[0]
            for i, lag in enumerate(noise, 1 + len(mine)):
                t[:, i, place[lag]] = 1.0
                t[:, i, 0] = -phi[:, 0]
                for k in long:
                    t[:, i, place[lag + k]] -= phi[:, k]
        full = t @ sums[0] @ t.transpose(0, 2, 1)
        n = sums[0][:, 0, 0]
        beta = least_squares(full, list(range(wide)), wide)[0]
        v = np.stack([np.asarray(x, float) for x in frame["v"]])
        z = np.einsum("bij,bj->bi", t[:, :wide, :-1], v)
        out = pd.DataFrame({"ts": frame["ts"], "actual": frame["y"], "predicted": frame["base"] + (z * beta).sum(axis=1), "n_train": np.round(n).astype(np.int64)})
        return out[n > wide]

    factors = [moments(range(len(names) + 1)), *([moments([*range(len(long)), len(names)])] if ma else [])]
    fields = [rows.schema["ts"], T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType()), T.StructField("n_train", T.LongType())]
    out = expanding(rows, by, [*names, "w"], factors, "_tag", targets, fields, solve, span)
    return out.select(*KEY, "ts", "actual", "predicted", (F.col("actual") - F.col("predicted")).alias("residual"), "n_train")


def boundary_verdict(fits: DataFrame, keys=KEY, accept: float = ACCEPT) -> DataFrame:
    """Best neighbour against the original order: accept the original unless the neighbour gains ``accept`` AIC.

    ``fits`` is a grid table with ``is_original``. Unconverged neighbours count only if no neighbour converged.
    """
    agg = fits.groupBy(*keys).agg(
        F.max(F.when(F.col("is_original"), F.struct("aic", order_string().alias("o")))).alias("_o"),
        F.min_by(F.struct("aic", order_string().alias("o")), F.when(~F.col("is_original") & F.col("aic").isNotNull(), F.struct(~F.col("converged"), F.col("aic"), order_string()))).alias("_e"),
        F.count_if(~F.col("is_original") & F.col("converged")).alias("n_extensions_converged"))
    delta = F.col("_e.aic") - F.col("_o.aic")
    return agg.select(*keys, F.col("_o.o").alias("original_order"), F.col("_o.aic").alias("original_aic"), F.col("_e.o").alias("extension_order"), F.col("_e.aic").alias("extension_aic"),
                      delta.alias("delta_aic"), F.when(delta <= -accept, "extend").otherwise("accept").alias("verdict"), "n_extensions_converged")


def with_deltas(fits: DataFrame, keys=KEY) -> DataFrame:
    """Every fit's AIC distance from the original order."""
    own = fits.filter("is_original").groupBy(*keys).agg(F.min("aic").alias("_o"))
    return fits.join(own, list(keys)).withColumn("delta_aic", F.col("aic") - F.col("_o")).drop("_o")


def grid_union_reselect(old: DataFrame, new: DataFrame, keys=KEY) -> DataFrame:
    """Selection over two grids together, against the old selection."""
    common = [c for c in old.columns if c in new.columns]
    union = old.select(*common).unionByName(new.select(*common))
    before = select_order(old, keys).select(*keys, F.col("aic_order").alias("old_order"), F.col("aic_value").alias("old_aic"))
    out = select_order(union, keys).join(before, list(keys))
    return out.withColumn("delta_aic", F.col("aic_value") - F.col("old_aic")).withColumn("changed", F.col("aic_order") != F.col("old_order"))


def ic_slice(grid: DataFrame, metric: str = "aic", keys=KEY, q: int = Q_MAX) -> DataFrame:
    """p x q matrix of a criterion at the seasonal order of the best fit."""
    best = grid.groupBy(*keys).agg(_best(metric).alias("_b")).select(*keys, F.col("_b.P_s").alias("P_s"), F.col("_b.D_s").alias("D_s"), F.col("_b.Q_s").alias("Q_s"))
    cut = grid.join(best, [*keys, "P_s", "D_s", "Q_s"])
    wide = cut.groupBy(*keys, "p").pivot("q", list(range(q + 1))).agg(F.min(metric))
    return wide.select(*keys, "p", *[F.col(str(i)).alias(f"q{i}") for i in range(q + 1)])


def saturation_check(a: DataFrame, b: DataFrame, errors_a: DataFrame, errors_b: DataFrame, keys=KEY, gain: float = ACCEPT, tolerance: float = 0.01) -> DataFrame:
    """Does a richer stage that fits better in sample also forecast better? Selections and error tables of two stages.

    Saturated: the criterion gains at least ``gain`` while the error falls by less than the share ``tolerance``.
    """
    s = a.select(*keys, F.col("aic_value").alias("aic_a")).join(b.select(*keys, F.col("aic_value").alias("aic_b")), list(keys))
    e = errors_a.select(*keys, F.col("rmse").alias("rmse_a")).join(errors_b.select(*keys, F.col("rmse").alias("rmse_b")), list(keys))
    out = s.join(e, list(keys)).withColumn("delta_aic", F.col("aic_b") - F.col("aic_a")).withColumn("delta_rmse", F.col("rmse_b") - F.col("rmse_a"))
    return out.withColumn("saturated", (F.col("delta_aic") <= -gain) & (F.col("delta_rmse") > -tolerance * F.col("rmse_a")))

