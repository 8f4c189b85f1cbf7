"""Unit-root and stationarity tests for many series at once, and the rule tables that choose a transform."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dist import adf_crit, adf_pvalue, kpss_clamped, kpss_crit, kpss_pvalue
from panelspark.functions.series import SPAN, running
from panelspark.functions.solve import least_squares
from panelspark.operators.transform import PAIR, all_transforms
from panelspark.schema import attach

GOOD = "Stationary"
BAD = "Non-stationary"
CONFLICT = "Trend-stationary (conflict)"
UNSURE = "Inconclusive"
ERROR = "Error"
ALPHA = 0.05
SMALL, VERY_SMALL, MINIMUM = 50, 30, 10


def schwert_lag(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(12.0 * F.pow(n / 100.0, F.lit(0.25)))).cast("bigint")


def _numbered(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Known values with their position ``_pos`` (from 1) in the series: a gap closes up, as if the nulls were not there."""
    known = df.filter(F.col("value").isNotNull())
    return running(known, keys, {"_pos": F.lit(1).cast("bigint")}, unit=unit)


ADF = [T.StructField("n_obs", T.LongType()), T.StructField("spec", T.StringType()), T.StructField("adf_maxlag", T.LongType()),
       T.StructField("adf_stat", T.DoubleType()), T.StructField("adf_usedlag", T.LongType()), T.StructField("adf_nobs", T.LongType()), T.StructField("adf_error", T.StringType())]


def nested_rss(gram: np.ndarray, xs: Sequence[int], y: int) -> np.ndarray:
    """Residual sums of squares of ``y`` on the first 1, 2, ... of the columns ``xs``: all from one Cholesky factor.

    With L L' = X'X and L c = X'y, each further column takes c squared off the sum. A matrix without full rank is solved column by column.
    """
    xs = list(xs)
    a, r = gram[np.ix_(xs, xs)], gram[xs, y]
    d = np.sqrt(np.diag(a))
    d = np.where(d > 0, d, 1.0)
    try:
        low = np.linalg.cholesky(a / np.outer(d, d))
        if np.diag(low).min() < 1e-5:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        return np.array([least_squares(gram[None], xs[:i + 1], y)[1][0] for i in range(len(xs))])
    c = np.linalg.solve(low, r / d)
    return np.maximum(gram[y, y] - np.cumsum(c * c), 0.0)


def _choose_and_refit(common: np.ndarray, early: np.ndarray, positions: np.ndarray, maxlag: int, spec: str):
    """Lag by AIC on the common sample, then the statistic on the chosen lag's own longer sample.

    ``early`` holds the rows that not all orders can use, with their ``positions`` in the series.
    """
    terms = [0, 1] if spec == "ct" else [0]
    n = common[0, 0]
    if n <= 0:
        return None, -1, -1, "no rows left after lags"
    xs = [*terms, 2, *range(4, 4 + maxlag)]
    rss = nested_rss(common, xs, 3)[len(terms):]
    used, best = 0, np.inf
    for p, value in enumerate(rss):
        k = len(terms) + 1 + p
        if n <= k:
            break
        aic = n * (np.log(2 * np.pi * value / n) + 1) + 2 * k if value > 0 else np.inf
        if aic < best:
            used, best = p, aic
    more = early[positions >= used + 2]
    own = common + more.T @ more
    xs = xs[:len(terms) + 1 + used]
    beta, rss, inv = least_squares(own[None], xs, 3)
    nobs, at = own[0, 0], len(terms)
    var = rss[0] / (nobs - len(xs)) * inv[0, at, at] if nobs > len(xs) else np.nan
    if not var > 0:
        return None, used, int(nobs), "no residual variation"
    return float(beta[0, at] / np.sqrt(var)), used, int(round(nobs)), None


def adf(df: DataFrame, keys: Sequence[str], unit: str = "month", maxlag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic per key. Input (keys, ts, value, spec); ``spec`` is 'c' or 'ct', null values are dropped.

    ``maxlag`` is the longest lag order tried; by default it follows from the length of the series. One pass: a block of positions adds
    up the rows that every order can use and hands on the few earlier rows as they are, so that the chosen order can be refitted on its
    longer sample without reading the series again. One row per block goes to the key, which adds up and tests. Each block also gets the rows
    before it that the key's own longest lag reaches.
    """
    keys = list(keys)
    numbered = _numbered(df, keys, unit)
    longest = schwert_lag(F.col("n_obs")) if maxlag is None else F.lit(maxlag).cast("bigint")
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.first("spec").alias("spec")).withColumn("maxlag", longest)
    at, reach = F.col("_pos") - 1, F.col("maxlag") + 1
    block = F.floor(at / SPAN)
    following = F.when(reach > SPAN, F.raise_error(F.lit("lags reach beyond a block")).cast("bigint")).when(at % SPAN >= SPAN - reach, block + 1)
    rows = numbered.select(*keys, "_pos", "value").join(sizes, keys).withColumn("_blk", F.explode(F.array_compact(F.array(block, following))))
    key_fields = [df.schema[k] for k in keys]
    facts = ["n_obs", "spec", "maxlag"]
    part = [T.StructField("n_obs", T.LongType()), T.StructField("spec", T.StringType()), T.StructField("maxlag", T.LongType()),
            *[T.StructField(c, T.BinaryType()) for c in ("common", "early", "positions")]]

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_pos")
        v, pos, lags, own = block["value"].to_numpy(float), block["_pos"].to_numpy(), int(block["maxlag"].iloc[0]), int(block["_blk"].iloc[0])
        z = np.zeros((len(v), 4 + lags))
        z[:, 0], z[:, 1] = 1.0, pos
        step = np.diff(v)
        z[1:, 2], z[1:, 3] = v[:-1], step
        for j in range(1, min(lags, len(v) - 2) + 1):
            z[j + 1:, 3 + j] = step[:-j]
        mine = ((pos - 1) // SPAN == own) & (pos >= 2)
        common, early = z[mine & (pos >= lags + 2)], mine & (pos < lags + 2)
        out = block.iloc[:1][[*keys, *facts]].copy()
        out["common"], out["early"] = [(common.T @ common).tobytes()], [z[early].tobytes()]
        out["positions"] = [pos[early].astype(np.int64).tobytes()]
        return out

    def test(parts: pd.DataFrame) -> pd.DataFrame:
        n, spec, lags = (parts[c].iloc[0] for c in facts)
        n, lags = int(n), int(lags)
        if n < MINIMUM:
            found = (None, -1, -1, "n < 10")
        elif lags > n // 2 - len(spec) - 1:
            found = (None, -1, -1, "maxlag too large for the sample")
        else:
            m = 4 + lags
            common = sum(np.frombuffer(c).reshape(m, m) for c in parts["common"])
            early = np.concatenate([np.frombuffer(c).reshape(-1, m) for c in parts["early"]])
            found = _choose_and_refit(common, early, np.concatenate([np.frombuffer(c, np.int64) for c in parts["positions"]]), lags, spec)
        out = parts.iloc[:1][keys].copy()
        for name, value in zip([f.name for f in ADF], (n, spec, lags, *found)):
            out[name] = pd.Series([value], index=out.index, dtype=object if name == "adf_error" else None)
        out["adf_stat"] = out["adf_stat"].astype(float)
        return out

    blocks = rows.groupBy(*keys, "_blk").applyInPandas(reduce, T.StructType([*key_fields, *part]))
    out = blocks.groupBy(*keys).applyInPandas(test, T.StructType([*key_fields, *ADF]))
    out = out.withColumn("adf_stat", F.nanvl("adf_stat", F.lit(None).cast("double")))
    out = out.select(*keys, "spec", "n_obs", "adf_stat", "adf_usedlag", "adf_nobs", "adf_maxlag", "adf_error")
    out = out.withColumn("adf_pvalue", adf_pvalue(F.col("adf_stat"), F.col("spec")))
    ok = F.col("adf_stat").isNotNull()
    return out.select("*", *[F.when(ok, adf_crit(F.col("spec"), F.col("adf_nobs"), lv)).alias(f"adf_crit_{lv}") for lv in ("1", "5", "10")])


def kpss(df: DataFrame, keys: Sequence[str], lags: int | None = None, unit: str = "month") -> DataFrame:
    """KPSS statistic per key with a Bartlett long-run variance; ``lags=None`` chooses the bandwidth from the data. Nulls are dropped.

    The long-run variance uses the identity  sum of Bartlett-weighted autocovariances = sum of squared moving sums of
    length lags+1 / (n * (lags+1)),  so any bandwidth costs one equi-join of the partial sums with themselves.
    """
    keys = list(keys)
    known = _numbered(df, keys, unit)
    fit = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_my"), F.avg("_pos").alias("_mi"),
                                   F.regr_slope("value", F.col("_pos").cast("double")).alias("_b"), F.first("spec").alias("spec"))
    line = F.col("_my") + F.when(F.col("spec") == "ct", F.coalesce("_b", F.lit(0.0)) * (F.col("_pos") - F.col("_mi"))).otherwise(F.lit(0.0))
    resid = known.drop("spec").join(fit, keys).select(*keys, "n", "spec", F.col("_pos").alias("_t"), (F.col("value") - line).alias("_e"))
    if lags is None:
        # products with each of the first n^(2/9) lags, by position
        most = F.floor(F.pow("n", F.lit(2.0 / 9.0))).cast("int")
        fan = resid.select(*keys, "n", "_t", "_e", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), most))).alias("_k"))
        back = resid.select(*keys, F.col("_t").alias("_s"), F.col("_e").alias("_e0"))
        lagged = fan.withColumn("_s", F.col("_t") - F.col("_k")).join(back, [*keys, "_s"])
        prod = F.col("_e") * F.col("_e0") / F.col("n")
        auto = lagged.groupBy(*keys).agg(F.sum(F.when(F.col("_k") == 0, prod).otherwise(2.0 * prod)).alias("_s0"),
                                         F.sum(2.0 * F.col("_k") * prod).alias("_s1"), F.first("n").alias("n"))
        ratio = F.try_divide(F.col("_s1"), F.col("_s0"))
        width = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(F.col("n"), F.lit(1.0 / 3.0)))
        auto = auto.select(*keys, F.least(F.coalesce(width, F.lit(0)), F.col("n") - 1).cast("bigint").alias("_lags"))
    else:
        auto = fit.select(*keys, F.least(F.lit(lags), F.col("n") - 1).cast("bigint").alias("_lags"))
    sums = running(resid, keys, {"_S": F.col("_e")}, ts="_t", unit="index").join(auto, keys)
    width = F.col("_lags") + 1
    here = sums.select(*keys, "_t", "_S", "n", "spec", "_lags")
    earlier = sums.select(*keys, (F.col("_t") + width).alias("_t"), F.col("_S").alias("_S0"))
    both = here.join(earlier, [*keys, "_t"], "left")
    step = F.col("_S") - F.coalesce("_S0", F.lit(0.0))
    after = F.when((F.col("_t") >= F.col("n") + 1 - width) & (F.col("_t") < F.col("n")), F.col("_S") * F.col("_S")).otherwise(F.lit(0.0))
    agg = both.groupBy(*keys).agg(F.first("n").alias("n"), F.first("spec").alias("spec"), F.first("_lags").alias("kpss_lags"),
                                  F.sum(F.col("_S") * F.col("_S")).alias("_eta"), F.sum(step * step + after).alias("_m2"))
    lrv = F.col("_m2") / (F.col("n") * (F.col("kpss_lags") + 1))
    out = agg.withColumn("kpss_stat", F.when(F.col("n") >= MINIMUM, F.try_divide(F.col("_eta") / (F.col("n") * F.col("n")), lrv)))
    stat, spec = F.col("kpss_stat"), F.col("spec")
    return out.select(*keys, "kpss_stat", kpss_pvalue(stat, spec).alias("kpss_pvalue"), F.when(stat.isNotNull(), F.col("kpss_lags")).otherwise(-1).alias("kpss_lags"),
                      *[kpss_crit(spec, lv).alias(f"kpss_crit_{lv}") for lv in ("1", "5", "10")],
                      F.coalesce(kpss_clamped(stat, spec), F.lit(False)).alias("kpss_clamped"), F.when(stat.isNull(), "n < 10 or no variation").alias("kpss_error"))


def classify_quadrant(adf_p: Column, kpss_p: Column, alpha: float = ALPHA) -> Column:
    a, k = adf_p < alpha, kpss_p < alpha
    return (F.when(adf_p.isNull() | kpss_p.isNull(), ERROR).when(a & ~k, GOOD).when(~a & k, BAD).when(a & k, CONFLICT).otherwise(UNSURE))


def test_series(df: DataFrame, keys: Sequence[str], alpha: float = ALPHA, unit: str = "month") -> DataFrame:
    """Both tests with the same deterministic terms, and their joint class. Input (keys, ts, value, spec)."""
    out = adf(df, keys, unit).join(kpss(df, keys, None, unit), list(keys))
    return out.withColumn("class", classify_quadrant(F.col("adf_pvalue"), F.col("kpss_pvalue"), alpha)).withColumn(
        "small_sample", F.col("n_obs") < SMALL).withColumn("very_small", F.col("n_obs") < VERY_SMALL)


def level_spec(long: DataFrame, trending: Sequence[str]) -> DataFrame:
    return long.withColumn("spec", F.when(F.col("indicator").isin(list(trending)), "ct").otherwise("c"))


def test_panel(long: DataFrame, trending: Sequence[str] = ()) -> DataFrame:
    """Every level series with the default terms of its indicator."""
    return test_series(level_spec(long, trending), PAIR)


def test_grid(long: DataFrame, forms: Sequence[str], trending: Sequence[str] = (), split=None) -> DataFrame:
    """Every series under every form, and with ``split`` also on both sides of it, as one job.

    Forms are transform names plus 'level_ct' (the level with trend terms). Key: (entity, indicator, form, subperiod).
    The rule tables below are all read off this grid, so nothing is tested twice.
    """
    named = [f for f in forms if f != "level_ct"]
    tf = all_transforms(long, named)
    default = F.when((F.col("form") == "level") & F.col("indicator").isin(list(trending)), "ct").otherwise("c")
    tf = tf.withColumn("spec", default)
    if "level_ct" in forms:
        both = F.array(F.struct(F.col("form"), F.col("spec")), F.when(F.col("form") == "level", F.struct(F.lit("level_ct").alias("form"), F.lit("ct").alias("spec"))))
        tf = tf.select(*PAIR, "ts", "value", F.explode(F.array_compact(both)).alias("_v")).select(*PAIR, "_v.form", "ts", "value", "_v.spec")
    tf = tf.withColumn("subperiod", F.lit("full")) if split is None else subperiods(tf, split)
    return test_series(tf, [*PAIR, "form", "subperiod"])


def _with_classes(tests: DataFrame, forms: Sequence[str]) -> DataFrame:
    """Class of other forms of the same series beside each row; the group is the handful of forms of one series."""
    w = Window.partitionBy(*PAIR)
    full = F.col("subperiod") == "full"
    return tests.select("*", *[F.max(F.when(full & (F.col("form") == f), F.col("class"))).over(w).alias(f"_{f}") for f in forms])


def differencing_ladder(grid: DataFrame) -> DataFrame:
    """Of flagged level series the first difference; the second only where the first did not resolve."""
    rows = _with_classes(grid, ["level", "first_diff"])
    flagged = F.col("_level").isin(BAD, UNSURE)
    second = flagged & (F.col("_first_diff") != GOOD)
    keep = ((F.col("form") == "first_diff") & flagged) | ((F.col("form") == "second_diff") & second)
    return rows.filter(keep & (F.col("subperiod") == "full")).select(*grid.columns)


def conflict_retest(grid: DataFrame) -> DataFrame:
    """Series whose level is in conflict: level, level with trend and first difference side by side."""
    rows = _with_classes(grid, ["level"])
    keep = (F.col("_level") == CONFLICT) & F.col("form").isin("level", "level_ct", "first_diff") & (F.col("subperiod") == "full")
    return rows.filter(keep).select(*grid.columns)


def subperiods(df: DataFrame, split, pre: str = "pre", post: str = "post") -> DataFrame:
    """Every row in the full sample and in its side of the split."""
    return df.withColumn("subperiod", F.explode(F.array(F.lit("full"), F.when(F.col("ts") < F.lit(split), pre).otherwise(post))))


def subperiod_tests(transformed: DataFrame, split, keys: Sequence[str] = (*PAIR, "form")) -> DataFrame:
    """Tests on the full, earlier and later sample. Input (keys, ts, value, spec)."""
    parts = subperiods(transformed.filter(F.col("value").isNotNull()), split)
    window = parts.groupBy(*keys, "subperiod").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return test_series(parts, [*keys, "subperiod"]).join(window, [*keys, "subperiod"])


def break_window_tests(transformed: DataFrame, breaks: Sequence[Sequence], keys: Sequence[str] = (*PAIR, "form")) -> DataFrame:
    fan = attach(transformed.filter(F.col("value").isNotNull()), [(n, d) for n, d in breaks], ["break_name", "break_date"])
    fan = fan.withColumn("window", F.when(F.col("ts") < F.col("break_date"), "pre_break").otherwise("post_break"))
    return test_series(fan, [*keys, "break_name", "window"])


def class_counts(tests: DataFrame) -> DataFrame:
    return tests.groupBy("class").agg(F.count(F.lit(1)).alias("n_series"))


def _class_of(form: str | Column, subperiod: str = "full") -> Column:
    return F.max(F.when((F.col("form") == form) & (F.col("subperiod") == subperiod), F.col("class")))


def draft_transform(target: Column, level: Column, first: Column, second: Column, ct: Column, yoy: Column, logd: Column) -> Column:
    """Recommended transform from the classes of a series' forms.

    Target: yearly growth, log change, first difference, in that order of preference. Others: keep a stationary
    level; a conflict prefers the first difference to a trend; flagged levels are differenced until they resolve.
    """
    caveat = F.lit("first_diff_with_caveat")
    for_target = (F.when(yoy == GOOD, "yoy_pct").when(logd == GOOD, "log_diff_pct").when(first == GOOD, "first_diff").otherwise("yoy_pct_with_caveat"))
    conflict = F.when(first == GOOD, "first_diff").when(ct == GOOD, "level_ct").otherwise(caveat)
    flagged = F.when(first == GOOD, "first_diff").when(second == GOOD, "second_diff").otherwise(caveat)
    others = (F.when(level == GOOD, "level").when(level == CONFLICT, conflict).when(level.isin(BAD, UNSURE), flagged).otherwise("unknown"))
    return F.when(target, for_target).otherwise(others)


def draft_class(recommended: Column, level: Column, first: Column, second: Column, ct: Column, yoy: Column, logd: Column) -> Column:
    """Class of the recommended form."""
    return (F.when(recommended.isin("yoy_pct", "yoy_pct_with_caveat"), yoy).when(recommended == "log_diff_pct", logd)
            .when(recommended.isin("first_diff", "first_diff_with_caveat"), first).when(recommended == "second_diff", second)
            .when(recommended == "level_ct", ct).otherwise(level))


def registry_draft(grid: DataFrame, target: str) -> DataFrame:
    names = ("level", "first_diff", "second_diff", "level_ct", "yoy_pct", "log_diff_pct")
    wide = grid.groupBy(*PAIR).agg(*[_class_of(f).alias(f) for f in names])
    args = [F.col(c) for c in names]
    out = wide.withColumn("recommended", draft_transform(F.col("indicator") == target, *args))
    return out.select(*PAIR, F.col("level").alias("level_class"), "recommended", draft_class(F.col("recommended"), *args).alias("recommended_class"))


def decide_target_form(df: DataFrame) -> DataFrame:
    """Form and decision code of the target from its classes: columns full_yoy, full_log, full_diff, pre_yoy, post_yoy.

    Rules in order: stationary yearly growth; stationary log change; yearly growth that is stationary on both sides of
    the split only; stationary first difference; log change in conflict; yearly growth in conflict; otherwise yearly
    growth with a regime dummy.
    """
    y, lg, d, pre, post = (F.coalesce(F.col(c), F.lit(ERROR)) for c in ("full_yoy", "full_log", "full_diff", "pre_yoy", "post_yoy"))
    rules = [
        (y == GOOD, "yoy_pct", "YOY_STATIONARY"),
        (lg == GOOD, "log_diff_pct", "LOGDIFF_STATIONARY"),
        ((y == BAD) & (pre == GOOD) & (post == GOOD), "yoy_pct_with_regime_dummy", "YOY_REGIME_SHIFT"),
        (d == GOOD, "first_diff", "FIRSTDIFF_FALLBACK"),
        (lg == CONFLICT, "log_diff_pct_with_caveat", "LOGDIFF_CONFLICT"),
        (y == CONFLICT, "yoy_pct_with_caveat", "YOY_CONFLICT"),
    ]
    form, code = F.lit("yoy_pct_with_regime_dummy"), F.lit("REQUIRES_REGIME_DUMMY")
    for cond, f, c in reversed(rules):
        form, code = F.when(cond, f).otherwise(form), F.when(cond, c).otherwise(code)
    return df.withColumn("form", form).withColumn("decision_code", code)


def target_classes(grid: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Class pivot that ``decide_target_form`` needs; the grid must hold the sub-periods."""
    return grid.groupBy(*keys).agg(_class_of("yoy_pct").alias("full_yoy"), _class_of("log_diff_pct").alias("full_log"), _class_of("first_diff").alias("full_diff"),
                                   _class_of("yoy_pct", "pre").alias("pre_yoy"), _class_of("yoy_pct", "post").alias("post_yoy"))


def final_registry(grid: DataFrame, provisional: DataFrame, target: str) -> DataFrame:
    """Final transform, test form, decision code and regime flag per series, from one grid with sub-periods.

    ``provisional`` (entity, indicator, form) names the form whose sub-period classes decide the regime flag.
    """
    prov = grid.join(provisional.select(*PAIR, F.col("form").alias("_prov")), list(PAIR))
    own = F.col("_prov")
    wide = prov.groupBy(*PAIR).agg(
        F.first("_prov").alias("_form"), _class_of("level").alias("level_class"), _class_of("level_ct").alias("_ct"), _class_of("first_diff").alias("_fd"),
        *[_class_of(own, s).alias(f"{s}_class") for s in ("full", "pre", "post")],
        _class_of("yoy_pct").alias("full_yoy"), _class_of("log_diff_pct").alias("full_log"), _class_of("first_diff").alias("full_diff"),
        _class_of("yoy_pct", "pre").alias("pre_yoy"), _class_of("yoy_pct", "post").alias("post_yoy"))
    df = decide_target_form(wide).withColumnRenamed("form", "_tform").withColumnRenamed("decision_code", "_tcode")
    is_target, lv = F.col("indicator") == target, F.col("level_class")
    full = F.when(F.col("_form") == "first_diff", F.col("full_class")).otherwise(F.lit("Unknown"))
    # (condition, form, code) in order of precedence for all indicators but the target
    rules = [
        (lv == GOOD, "level", "LEVEL_STATIONARY"),
        ((lv == CONFLICT) & (F.col("_fd") == GOOD), "first_diff", "CONFLICT_RESOLVED_BY_FIRSTDIFF"),
        ((lv == CONFLICT) & (F.col("_ct") == GOOD), "level_with_linear_trend", "CONFLICT_TREND_STATIONARY"),
        (lv == CONFLICT, "first_diff_with_caveat", "CONFLICT_UNRESOLVED"),
        (full == GOOD, "first_diff", "I1_STANDARD"),
        (full == CONFLICT, "first_diff_with_caveat", "I1_WITH_CONFLICT"),
    ]
    form, code = F.lit("first_diff_with_caveat"), F.lit("I1_UNRESOLVED")
    for cond, f, c in reversed(rules):
        form, code = F.when(cond, f).otherwise(form), F.when(cond, c).otherwise(code)
    form, code = F.when(is_target, F.col("_tform")).otherwise(form), F.when(is_target, F.col("_tcode")).otherwise(code)
    pre, post = F.coalesce("pre_class", F.lit(ERROR)), F.coalesce("post_class", F.lit(ERROR))
    shift = ((pre == GOOD) & (post == GOOD) & (F.coalesce("full_class", F.lit(ERROR)) != GOOD)) | code.isin("YOY_REGIME_SHIFT", "REQUIRES_REGIME_DUMMY")
    return df.select(*PAIR, "level_class", F.col("full_class").alias("form_class"), form.alias("form"), F.when(is_target, "yoy_pct").otherwise(form).alias("break_test_form"),
                     code.alias("decision_code"), pre.alias("pre_class"), post.alias("post_class"), shift.alias("regime_shift"))
