"""Vector autoregression per key: order choice, fit, diagnostics, causality, impulse responses, walk-forward.

A fitted model is one row: coefficient, covariance and inverse matrices as arrays. Regressors are ordered constant,
lag 1 of every variable, lag 2 of every variable, ..., exogenous columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dist import f_sf, norm_sf
from panelspark.functions.series import period_index, sliding
from panelspark.functions.solve import none_if_nan, scaled_inverse, unpack
from panelspark.operators import describe
from panelspark.operators.clean import all_known
from panelspark.operators.expanding import SPAN, expanding, moments
from panelspark.operators.gram import DOUBLES, gram, per_row

CRITERIA = ("aic", "bic", "hqic", "fpe")
#: Keys whose replicate sums a task holds before it hands them on.
HELD_BANDS = 16


def regressors(endog: Sequence[str], p: int, exog: Sequence[str] = ()) -> list[str]:
    return ["const", *[f"{c}_L{k}" for k in range(1, p + 1) for c in endog], *exog]


def design(panel: DataFrame, endog: Sequence[str], p: int, exog: Sequence[str] = (), keys=("entity",)) -> DataFrame:
    """Jointly known rows with all lags; input is dense."""
    lagged = sliding(panel, keys, lambda w: {f"{c}_L{k}": F.lag(c, k).over(w) for k in range(1, p + 1) for c in endog}, back=max(p, 1),
                     keep=[*keys, "ts", *endog, *exog])
    names = [n for n in regressors(endog, p, exog) if n != "const"]
    return lagged.filter(all_known([*endog, *names])).withColumn("const", F.lit(1.0))


def _solve(g: np.ndarray, k: int, used: Sequence[int]):
    """Coefficients (k x n), inverse of X'X and residual cross products, for the regressors ``used``."""
    used = list(used)
    a, r, yy = g[np.ix_(used, used)], g[np.ix_(used, range(k, len(g)))], g[k:, k:]
    inv = scaled_inverse(a[None])[0]
    b = inv @ r
    s = yy - b.T @ r
    return b, inv, (s + s.T) / 2


def _information(s: np.ndarray, nobs: float, k: int):
    """Log-likelihood and criteria from residual cross products."""
    n = len(s)
    sign, ld = np.linalg.slogdet(s / nobs)
    if sign <= 0 or nobs <= k:
        return [None] * 5
    free = k * n
    return [float(v) for v in (-(nobs * n / 2) * np.log(2 * np.pi) - nobs / 2 * (ld + n), ld + 2 * free / nobs, ld + np.log(nobs) * free / nobs,
                               ld + 2 * np.log(np.log(nobs)) * free / nobs, ((nobs + k) / (nobs - k)) ** n * np.exp(ld))]


def lag_selection(panel: DataFrame, endog: Sequence[str], maxlag: int = 12, keys=("entity",)) -> DataFrame:
    """All criteria for lags 0 to ``maxlag`` on one common sample, with the lag each criterion selects."""
    rows = design(panel, endog, maxlag, (), keys)
    names = regressors(endog, maxlag)
    k, n = len(names), len(endog)
    g = gram(rows, keys, [*names, *endog])

    def score(packed):
        full = unpack([packed], k + n)[0]
        for p in range(maxlag + 1):
            used = range(1 + p * n)
            yield (p, int(round(full[0, 0])), *_information(_solve(full, k, used)[2], full[0, 0], len(used))[1:])

    fields = [T.StructField("lag", T.LongType()), T.StructField("n_obs", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in CRITERIA]]
    return flag_selected(per_row(g, keys, fields, score), keys)


def flag_selected(table: DataFrame, keys=("entity",)) -> DataFrame:
    """Mark the smallest value of every criterion, the shorter lag on ties; a key has maxlag + 1 rows."""
    w = Window.partitionBy(*keys)
    return table.select("*", *[(F.min_by("lag", F.struct(F.col(c), F.col("lag"))).over(w) == F.col("lag")).alias(f"selected_{c}") for c in CRITERIA])


def lag_extension(table: DataFrame, baseline: int, threshold: float = -2.0, keys=("entity",)) -> DataFrame:
    """What lags beyond ``baseline`` would gain by AIC, and whether the baseline stands. One aggregate per key.

    If the best lag up to the baseline is the baseline itself, the search has hit its boundary.
    """
    aic = F.col("aic")
    ext, inner = F.col("lag") > baseline, F.col("lag") <= baseline
    agg = table.groupBy(*keys).agg(
        F.max(F.when(F.col("lag") == baseline, aic)).alias("baseline_aic"), F.min_by("lag", F.when(ext, aic)).alias("extension_argmin"), F.min(F.when(ext, aic)).alias("extension_min_aic"),
        F.min_by("lag", F.when(inner, aic)).alias("_inner"), F.min_by("lag", aic).alias("_all"), F.max("lag").alias("maxlag"))
    delta = F.col("extension_min_aic") - F.col("baseline_aic")
    hit = F.col("_inner") == baseline
    verdict = (F.when(~hit & (F.col("_all") <= baseline), "interior_min_confirmed").when(~hit & (delta <= threshold), "interior_min_shifted_to_extension")
               .when(~hit, "interior_min_stable").when(delta <= threshold, "extend_further").otherwise("accept_boundary"))
    return agg.select(*keys, "baseline_aic", "extension_argmin", "extension_min_aic", delta.alias("delta_min"), hit.alias("boundary_hit"), "maxlag", verdict.alias("verdict"))


def lag_deltas(table: DataFrame, baseline: int, keys=("entity",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    return table.select(*keys, "lag", *[(F.col(c) - F.max(F.when(F.col("lag") == baseline, F.col(c))).over(w)).alias(f"{c}_delta") for c in CRITERIA], (F.col("lag") > baseline).alias("extension"))


MODEL = [T.StructField("n_obs", T.LongType()), T.StructField("n_reg", T.LongType()), T.StructField("coefs", DOUBLES), T.StructField("sigma", DOUBLES), T.StructField("inv", DOUBLES),
         *[T.StructField(c, T.DoubleType()) for c in ("loglik", *CRITERIA)]]


def _model(packed, k: int, n: int):
    full = unpack([packed], k + n)[0]
    nobs = full[0, 0]
    b, inv, s = _solve(full, k, range(k))
    dof = max(nobs - k, 1.0)
    return (int(round(nobs)), k, b.ravel().tolist(), (s / dof).ravel().tolist(), inv.ravel().tolist(), *_information(s, nobs, k))


def fit(panel: DataFrame, endog: Sequence[str], p: int, exog: Sequence[str] = (), keys=("entity",)) -> DataFrame:
    """One model row per key, from one Gram."""
    names = regressors(endog, p, exog)
    k, n = len(names), len(endog)
    g = gram(design(panel, endog, p, exog, keys), keys, [*names, *endog])
    return per_row(g, keys, MODEL, lambda packed: iter([_model(packed, k, n)]))


def coef_table(models: DataFrame, endog: Sequence[str], p: int, exog: Sequence[str] = (), keys=("entity",)) -> DataFrame:
    """Long coefficients with standard errors, normal p-values and bands."""
    names = regressors(endog, p, exog)
    k, n = len(names), len(endog)
    cells = F.array(*[F.struct(F.lit(e).alias("equation"), F.lit(x).alias("regressor"), F.col("coefs")[j * n + i].alias("coef"),
                               F.sqrt(F.col("sigma")[i * n + i] * F.col("inv")[j * k + j]).alias("std_err")) for i, e in enumerate(endog) for j, x in enumerate(names)])
    out = models.select(*keys, F.explode(cells).alias("_p")).select(*keys, "_p.*")
    out = out.withColumn("t_stat", F.try_divide("coef", "std_err")).withColumn("p_value", norm_sf("t_stat"))
    return out.withColumn("ci_lo", F.col("coef") - 1.96 * F.col("std_err")).withColumn("ci_hi", F.col("coef") + 1.96 * F.col("std_err")).withColumn(
        "significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def residuals(panel: DataFrame, models: DataFrame, endog: Sequence[str], p: int, exog: Sequence[str] = (), keys=("entity",)) -> DataFrame:
    """(keys, equation, ts, e): in-sample residuals in long form."""
    names = regressors(endog, p, exog)
    n = len(endog)
    # one array of coefficients per equation, made once per key
    own = [F.array(*[F.col("coefs")[j * n + i] for j in range(len(names))]).alias(f"_b{i}") for i in range(n)]
    rows = design(panel, endog, p, exog, keys).withColumn("_x", F.array(*names)).join(models.select(*keys, *own), list(keys))

    def fitted(i):
        return F.aggregate(F.zip_with("_x", f"_b{i}", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    cells = F.array(*[F.struct(F.lit(c).alias("equation"), (F.col(c) - fitted(i)).alias("e")) for i, c in enumerate(endog)])
    return rows.select(*keys, "ts", F.explode(cells).alias("_p")).select(*keys, "_p.equation", "ts", "_p.e")


def equation_diagnostics(resid: DataFrame, lags=(12, 24), keys=("entity",)) -> DataFrame:
    """Residual moments and Ljung-Box tests per equation."""
    by = [*keys, "equation"]
    stats = resid.groupBy(*by).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.min("e").alias("min_value"), F.max("e").alias("max_value"))
    lb = describe.ljung_box(describe.acf(resid, "e", max(lags), by), lags, by)
    wide = lb.groupBy(*by).agg(*[F.max(F.when(F.col("lags") == m, F.col(c))).alias(f"lb{m}_{o}") for m in lags for c, o in (("q", "stat"), ("p_value", "p"), ("reject", "reject"))])
    return stats.join(wide, by)


def stability(models: DataFrame, endog: Sequence[str], p: int, keys=("entity",)) -> DataFrame:
    """Roots of the reversed characteristic polynomial, largest modulus first; stable if all lie outside the unit circle."""
    n = len(endog)

    def roots(coefs):
        a = np.asarray(coefs, float).reshape(-1, n)[1:1 + n * p]
        companion = np.zeros((n * p, n * p))
        companion[:n] = a.T
        companion[n:, :-n] = np.eye(n * (p - 1))
        eig = np.linalg.eigvals(companion)
        inv = sorted((1.0 / v for v in eig if abs(v) > 1e-12), key=lambda v: (-abs(v), v.real, v.imag))
        stable = bool(np.all(np.abs(eig) < 1.0))
        for i, v in enumerate(inv):
            yield i, float(v.real), float(v.imag), stable

    fields = [T.StructField("root_index", T.LongType()), T.StructField("root_real", T.DoubleType()), T.StructField("root_imag", T.DoubleType()), T.StructField("is_stable", T.BooleanType())]
    return per_row(models.select(*keys, "coefs"), keys, fields, roots).withColumn("modulus", F.hypot("root_real", "root_imag"))


def fit_summary(models: DataFrame, roots: DataFrame, diagnostics: DataFrame, exog: Sequence[str], keys=("entity",)) -> DataFrame:
    r = roots.groupBy(*keys).agg(F.min("modulus").alias("min_root"), F.bool_and("is_stable").alias("is_stable"))
    d = diagnostics.groupBy(*keys).agg(F.bool_or("lb12_reject").alias("any_reject"))
    return models.select(*keys, "n_obs", "n_reg", "loglik", "aic", "bic", "hqic").join(r, list(keys)).join(d, list(keys)).withColumn(
        "n_exog", F.lit(len(exog)).cast("bigint")).withColumn("exog", F.lit(";".join(exog)))


def whiteness_compare(a: DataFrame, b: DataFrame, lags=(12, 24), keys=("entity",)) -> DataFrame:
    """Ljung-Box p-values of two fits of the same equations side by side."""
    by = [*keys, "equation"]
    cols = [f"lb{m}_p" for m in lags]
    out = a.select(*by, *[F.col(c).alias(f"{c}_1") for c in cols]).join(b.select(*by, *[F.col(c).alias(f"{c}_2") for c in cols]), by)
    for m in lags:
        out = out.withColumn(f"delta_{m}", F.col(f"lb{m}_p_2") - F.col(f"lb{m}_p_1")).withColumn(f"improved_{m}", (F.col(f"lb{m}_p_1") < 0.05) & (F.col(f"lb{m}_p_2") >= 0.05))
    return out


def granger_matrix(models: DataFrame, endog: Sequence[str], p: int, keys=("entity",)) -> DataFrame:
    """F test that all lags of one variable are zero in another's equation, for every ordered pair; nulls on the diagonal."""
    n = len(endog)
    names = list(endog)

    def tests(coefs, sigma, inv, nobs, k):
        b = np.asarray(coefs, float).reshape(k, n)
        s, v = np.asarray(sigma, float).reshape(n, n), np.asarray(inv, float).reshape(k, k)
        for c in range(n):
            at = [1 + lag * n + c for lag in range(p)]
            for e in range(n):
                stat = None
                if c != e:
                    try:
                        stat = none_if_nan(b[at, e] @ np.linalg.solve(s[e, e] * v[np.ix_(at, at)], b[at, e]) / p)
                    except np.linalg.LinAlgError:
                        stat = None
                yield names[c], names[e], stat, p, n * (nobs - k), c == e

    fields = [T.StructField("causer", T.StringType()), T.StructField("caused", T.StringType()), T.StructField("f_stat", T.DoubleType()), T.StructField("df1", T.LongType()),
              T.StructField("df2", T.LongType()), T.StructField("diagonal", T.BooleanType())]
    out = per_row(models.select(*keys, "coefs", "sigma", "inv", "n_obs", "n_reg"), keys, fields, tests)
    out = out.withColumn("p_value", f_sf("f_stat", F.col("df1").cast("double"), F.col("df2").cast("double")))
    return out.withColumn("sig_5", F.coalesce(F.col("p_value") < 0.05, F.lit(False))).withColumn("sig_1", F.coalesce(F.col("p_value") < 0.01, F.lit(False)))


def granger_target(matrix: DataFrame, target: str) -> DataFrame:
    return matrix.filter((F.col("caused") == target) & ~F.col("diagonal")).withColumn("label", F.concat_ws(" -> ", "causer", "caused"))


def granger_summary(matrix: DataFrame, keys=("entity",)) -> DataFrame:
    return matrix.filter(~F.col("diagonal")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if("sig_5").alias("n_sig_5"), F.count_if("sig_1").alias("n_sig_1"),
        F.round(100.0 * F.count_if("sig_5") / F.count(F.lit(1)), 1).alias("pct_sig_5"))


def _responses(b: np.ndarray, s: np.ndarray, n: int, p: int, horizon: int) -> np.ndarray:
    """Orthogonalised responses, (horizon + 1) x response x shock."""
    a = [b[1 + i * n:1 + (i + 1) * n].T for i in range(p)]
    phi = [np.eye(n)]
    for h in range(1, horizon + 1):
        phi.append(sum(phi[h - i - 1] @ a[i] for i in range(min(p, h))))
    return np.stack(phi) @ np.linalg.cholesky(s)


IRF = [T.StructField("horizon", T.LongType()), T.StructField("response", T.StringType()), T.StructField("shock", T.StringType()), T.StructField("irf", T.DoubleType())]


def _irf_rows(endog, p, horizon):
    n, names = len(endog), list(endog)

    def rows(coefs, sigma):
        try:
            out = _responses(np.asarray(coefs, float).reshape(-1, n), np.asarray(sigma, float).reshape(n, n), n, p, horizon)
        except np.linalg.LinAlgError:
            return
        for h in range(horizon + 1):
            for i in range(n):
                for j in range(n):
                    yield h, names[i], names[j], float(out[h, i, j])

    return rows


def irf(models: DataFrame, endog: Sequence[str], p: int, horizon: int = 24, keys=("entity",)) -> DataFrame:
    """Orthogonalised impulse responses (Cholesky in the given order) and their running sums."""
    out = per_row(models.select(*keys, "coefs", "sigma"), keys, IRF, _irf_rows(endog, p, horizon))
    w = Window.partitionBy(*keys, "response", "shock").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative", F.sum("irf").over(w))


def irf_bands(panel: DataFrame, endog: Sequence[str], p: int, exog: Sequence[str] = (), horizon: int = 24, replicates: int = 200, keys=("entity",), seed: int = 7) -> DataFrame:
    """95% bands from a fixed-design wild bootstrap, with the point responses.

    A replicate flips the sign of whole residual rows, so its coefficients differ from the estimate by
    inv(X'X) X'(e*sign). Those cross products are summed over rows in the map tasks for all replicates at once, into one packed row per
    task and key; one more row per key adds them up and gives all responses of all replicates as one stack. Signs come from a
    hash of key, date and replicate, so that a recomputed task gives the same numbers.
    """
    keys, names, endog = list(keys), regressors(endog, p, exog), list(endog)
    k, n = len(names), len(endog)
    models = fit(panel, endog, p, exog, keys)
    rows = design(panel, endog, p, exog, keys).withColumn("_seed", F.xxhash64(*keys, "ts", F.lit(seed))).join(models.select(*keys, "coefs"), keys)
    key_fields = [rows.schema[c] for c in keys]

    def cross(batches):
        reps, held = np.arange(replicates, dtype=np.uint64), {}

        def flush():
            return pd.DataFrame([(*key, c.tobytes()) for key, c in held.items()], columns=[*keys, "c"])

        for batch in batches:
            x, y = batch[names].to_numpy(float), batch[endog].to_numpy(float)
            with np.errstate(over="ignore"):
                mixed = (batch["_seed"].to_numpy(np.int64).view(np.uint64)[:, None] ^ (reps * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            sign = np.where((mixed >> np.uint64(63)).astype(bool), 1.0, -1.0)
            for key, at in batch.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                e = y[at] - x[at] @ np.asarray(batch["coefs"].iloc[at[0]], float).reshape(k, n)
                # X' diag(sign) e for all replicates is one product: (sign of replicate) times (x times e of every row)
                part = sign[at].T @ (x[at][:, :, None] * e[:, None, :]).reshape(len(at), -1)
                held[key] = held[key] + part if key in held else part
                if len(held) > HELD_BANDS:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    parts = rows.select(*keys, *dict.fromkeys([*names, *endog]), "_seed", "coefs").mapInPandas(cross, T.StructType([*key_fields, T.StructField("c", T.BinaryType())]))
    band = [*IRF[:3], T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]

    def respond(group, model):
        out = group.iloc[:0][keys]
        if len(group) and len(model):
            one = model.iloc[0]
            total = np.sum([np.frombuffer(c) for c in group["c"]], axis=0).reshape(replicates, k, n)
            v = np.asarray(one["inv"], float).reshape(k, k)
            b = np.asarray(one["coefs"], float).reshape(k, n) + v @ total
            s = np.asarray(one["sigma"], float).reshape(n, n) - total.transpose(0, 2, 1) @ v @ total / max(one["n_obs"] - one["n_reg"], 1)
            found = []
            for b_, s_ in zip(b, s):
                try:
                    found.append(_responses(b_, s_, n, p, horizon))
                except np.linalg.LinAlgError:  # a replicate without a positive definite covariance has no responses
                    continue
            low, high = np.quantile(found, [0.025, 0.975], axis=0) if found else np.full((2, horizon + 1, n, n), np.nan)
            h, i, j = (a.ravel() for a in np.indices(low.shape))
            out = pd.DataFrame({**{c: one[c] for c in keys}, "horizon": h, "response": np.array(endog, object)[i], "shock": np.array(endog, object)[j],
                                "lower": low.ravel(), "upper": high.ravel()})
        return out.reindex(columns=[*keys, *[f.name for f in band]])

    facts = models.select(*keys, "coefs", "sigma", "inv", "n_obs", "n_reg")
    bands = parts.groupBy(*keys).cogroup(facts.groupBy(*keys)).applyInPandas(respond, T.StructType([*key_fields, *band]))
    return irf(models, endog, p, horizon, keys).join(bands, [*keys, "horizon", "response", "shock"])


def irf_peak(bands: DataFrame, target: str, keys=("entity",)) -> DataFrame:
    """Largest response of the target to every shock after impact, the smallest, and how often the band excludes zero."""
    rows = bands.filter((F.col("response") == target) & (F.col("horizon") >= 1))
    order = F.struct(F.abs("irf"), -F.col("horizon"))
    agg = rows.groupBy(*keys, "shock").agg(
        F.max_by(F.struct("horizon", "irf"), order).alias("_p"), F.min_by(F.struct("horizon", "irf"), F.struct("irf", "horizon")).alias("_t"),
        F.avg(F.when((F.col("lower") > 0) | (F.col("upper") < 0), 1.0).otherwise(0.0)).alias("share_excluding_zero"))
    return agg.select(*keys, "shock", F.col("_p.horizon").alias("peak_horizon"), F.col("_p.irf").alias("peak"), F.col("_t.horizon").alias("trough_horizon"), F.col("_t.irf").alias("trough"), "share_excluding_zero")


def fevd(irf_rows: DataFrame, keys=("entity",)) -> DataFrame:
    """Share of the forecast error variance of every response due to every shock; horizon h sums responses 0 to h-1."""
    sq = F.col("irf") * F.col("irf")
    upto = Window.partitionBy(*keys, "response", "shock").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys, "response", "horizon")
    own = irf_rows.select(*keys, "response", "shock", "horizon", F.sum(sq).over(upto).alias("_c"))
    share = F.coalesce(F.try_divide(F.col("_c"), F.sum("_c").over(total)), F.lit(0.0))
    return own.select(*keys, "response", "shock", (F.col("horizon") + 1).alias("horizon"), share.alias("share"))


def fevd_target(shares: DataFrame, target: str, horizons=(1, 3, 6, 12, 24)) -> DataFrame:
    return shares.filter((F.col("response") == target) & F.col("horizon").isin(list(horizons)))


def fevd_top(shares: DataFrame, n: int = 3, keys=("entity",)) -> DataFrame:
    w = Window.partitionBy(*keys, "horizon").orderBy(F.desc("share"), "shock")
    return shares.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def fevd_wide(shares: DataFrame, endog: Sequence[str], keys=("entity",)) -> DataFrame:
    wide = shares.groupBy(*keys, "horizon").pivot("shock", list(endog)).agg(F.first("share"))
    return wide.withColumn("total", sum((F.col(c) for c in endog[1:]), F.col(endog[0])))


def origins(panel: DataFrame, columns: Sequence[str], start, hmax: int, keys=("entity",)) -> DataFrame:
    """Dates from ``start`` on whose longest horizon is still inside the jointly known sample."""
    known = panel.filter(all_known(columns)).select(*keys, "ts")
    ends = known.groupBy(*keys).agg(F.max("ts").alias("_end"))
    return known.join(ends, list(keys)).filter((F.col("ts") >= F.lit(start)) & (F.add_months("ts", hmax) <= F.col("_end"))).select(*keys, F.col("ts").alias("origin_date"))


def future_exog(origin_rows: DataFrame, panel: DataFrame, exog: Sequence[str], hmax: int, keys=("entity",)) -> DataFrame:
    """Exogenous rows at origin + 1 to h; an origin that lacks any of them is dropped whole."""
    steps = origin_rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(hmax)))).withColumn("ts", F.add_months("origin_date", F.col("step")))
    joined = steps.join(panel.filter(all_known(exog)).select(*keys, "ts", *exog), [*keys, "ts"])
    w = Window.partitionBy(*keys, "origin_date")
    return joined.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == hmax).select(*keys, "origin_date", F.col("step").cast("bigint").alias("step"), "ts", *exog)


FORECAST = [T.StructField("variable", T.StringType()), T.StructField("h", T.LongType()), T.StructField("forecast", T.DoubleType())]


def walk_forward(panel: DataFrame, endog: Sequence[str], p: int, exog: Sequence[str], start, horizons: Sequence[int], keys=("entity",), span: int = SPAN) -> DataFrame:
    """Expanding refit at every origin, iterated to the longest horizon; all entities and origins in one job.

    History is summed block by block; each origin brings its last p values and the exogenous values of its forecast months.
    Origins with fewer than 5p + 10 rows are skipped.
    """
    keys, endog, exog, hmax = list(keys), list(endog), list(exog), max(horizons)
    names = regressors(endog, p, exog)
    k, n = len(names), len(endog)
    rows = design(panel, endog, p, exog, keys).withColumn("_tag", period_index("ts"))

    def around(w):
        out = {f"_s{i}_{j}": F.lag(c, i).over(w) if i else F.col(c) for i in range(p) for j, c in enumerate(endog)}
        out |= {f"_f{h}_{j}": F.lead(c, h).over(w) for h in range(1, hmax + 1) for j, c in enumerate(exog)}
        return out | {f"_a{h}_{j}": F.lead(c, h).over(w) for h in horizons for j, c in enumerate(endog)}

    near = sliding(panel, keys, around, back=p, ahead=hmax, keep=[*keys, "ts"])
    state = [f"_s{i}_{j}" for i in range(p) for j in range(n)]
    future = [f"_f{h}_{j}" for h in range(1, hmax + 1) for j in range(len(exog))]
    actual = [f"_a{h}_{j}" for h in horizons for j in range(n)]
    starts = near.filter((F.col("ts") >= F.lit(start)) & all_known([*state, *future, *actual])).select(
        *keys, "ts", F.array(*state).alias("state"), (F.array(*future) if future else F.array().cast("array<double>")).alias("future"), F.array(*actual).alias("actual"))
    starts = starts.withColumn("_tag", period_index("ts"))
    hs = list(horizons)

    def forecast(sums, totals, frame):
        enough = sums[0][:, 0, 0] >= 5 * p + 10
        g, frame = sums[0][enough], frame[enough]
        inv = scaled_inverse(g[:, :k, :k])
        b = inv @ g[:, :k, k:]
        past = np.stack([np.asarray(v, float).reshape(p, n) for v in frame["state"]]) if len(frame) else np.zeros((0, p, n))
        ahead = np.stack([np.asarray(v, float).reshape(hmax, len(exog)) for v in frame["future"]]) if len(frame) else np.zeros((0, hmax, len(exog)))
        seen = np.stack([np.asarray(v, float).reshape(len(hs), n) for v in frame["actual"]]) if len(frame) else np.zeros((0, len(hs), n))
        out = []
        for h in range(1, hmax + 1):
            x = np.concatenate([np.ones((len(frame), 1)), past.reshape(len(frame), -1), ahead[:, h - 1]], axis=1)
            y = np.einsum("bk,bkn->bn", x, b)
            past = np.concatenate([y[:, None], past[:, :-1]], axis=1)
            if h in hs:
                out += [pd.DataFrame({"origin_date": frame["ts"], "variable": name, "h": h, "forecast": y[:, j], "actual": seen[:, hs.index(h), j]})
                        for j, name in enumerate(endog)]
        return pd.concat(out)

    fields = [T.StructField("origin_date", T.DateType()), *FORECAST, T.StructField("actual", T.DoubleType())]
    columns = [*names[1:], *endog]
    out = expanding(rows, keys, columns, [moments(range(len(columns)))], "_tag", starts, fields, forecast, span)
    return out.withColumn("target_date", F.add_months("origin_date", F.col("h").cast("int")))


def oos_metrics(forecasts: DataFrame, scale: DataFrame, by=("entity", "variable", "h"), on=("entity",)) -> DataFrame:
    """Errors as forecast minus actual, the sign this layer uses."""
    e = F.col("forecast") - F.col("actual")
    agg = forecasts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))
    return agg.join(scale, list(on)).select(*agg.columns, F.try_divide("mae", "scale").alias("mase"))


def robust_metrics(forecasts: DataFrame, scale: DataFrame, by=("entity", "variable", "h"), on=("entity",), trim: float = 0.05) -> DataFrame:
    """Median-based and two-sided trimmed error measures; a group holds one error per origin."""
    rows = forecasts.withColumn("_a", F.abs(F.col("forecast") - F.col("actual")))
    cuts = rows.groupBy(*by).agg(F.percentile("_a", F.array(F.lit(trim), F.lit(0.5), F.lit(1 - trim))).alias("_q"))
    a = F.col("_a")
    kept = F.when((a >= F.col("_q")[0]) & (a <= F.col("_q")[2]), a)
    agg = rows.join(cuts, list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(a * a)).alias("rmse"), F.avg(a).alias("mae"), F.first(F.col("_q")[1]).alias("medae"),
                                                     F.sqrt(F.avg(kept * kept)).alias("rmse_trimmed"), F.avg(kept).alias("mae_trimmed"))
    return agg.join(scale, list(on)).select(*agg.columns, F.try_divide("mae", "scale").alias("mase"), F.try_divide("medae", "scale").alias("medase"), F.try_divide("rmse", "mae").alias("rmse_to_mae"))


def worst_origins(forecasts: DataFrame, n: int = 5, by=("entity", "variable", "h")) -> DataFrame:
    """Largest absolute errors per group; Spark limits the ranks before the shuffle."""
    rows = forecasts.withColumn("abs_error", F.abs(F.col("forecast") - F.col("actual")))
    w = Window.partitionBy(*by).orderBy(F.desc("abs_error"), "origin_date")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(*by, "rank", "origin_date", "abs_error")

