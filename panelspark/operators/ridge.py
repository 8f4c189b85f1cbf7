"""Ridge regression per key from sufficient statistics: fits, cross-validation, walk-forward, coefficient reports.

Features are standardised with the population deviation of the training rows; a constant feature gets coefficient
zero; the intercept is not penalised.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.series import period_index, running, sliding
from panelspark.functions.solve import none_if_nan, unpack
from panelspark.operators.clean import all_known
from panelspark.operators.features import CATEGORIES
from panelspark.operators.expanding import SPAN, expanding, moments
from panelspark.operators.gram import gram, per_row
from panelspark.schema import attach

FOLDS = 5
MIN_TRAIN = 20


def solve_ridge(g: np.ndarray, alpha: float):
    """Standardised coefficients, means, deviations and response mean from the Gram of [1, x..., y]."""
    n = g[0, 0]
    mean, ym = g[0, 1:-1] / n, g[0, -1] / n
    square = np.diag(g)[1:-1] / n
    var = square - mean * mean
    live = var > 1e-12 * np.maximum(square, 1e-300)
    sd = np.where(live, np.sqrt(np.where(live, var, 1.0)), 1.0)
    a = (g[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    r = (g[1:-1, -1] - n * mean * ym) / sd
    w = np.zeros(len(mean))
    if live.any():
        w[live] = np.linalg.solve(a[np.ix_(live, live)] + alpha * np.eye(live.sum()), r[live])
    return w, mean, sd, ym


def mean_square_error(g: np.ndarray, w, mean, sd, ym) -> float:
    """Mean squared error of a fitted model on the rows behind ``g``, without reading them again."""
    slope = w / sd
    full = np.concatenate([[ym - slope @ mean], slope])
    xx, xy = g[:-1, :-1], g[:-1, -1]
    return float((g[-1, -1] - 2 * full @ xy + full @ xx @ full) / g[0, 0])


def _rows(df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str], *extra: str) -> DataFrame:
    return df.filter(all_known([*xs, y])).withColumn("_one", F.lit(1.0)).select(*keys, *extra, "_one", *xs, y)


def ridge_fit(df: DataFrame, xs: Sequence[str], y: str, alpha: float | str, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """(keys, feature, coef, n): ``alpha`` is a number or the name of a column that is constant per key."""
    xs = list(xs)
    rows = _rows(df, xs, y, keys, *([alpha] if isinstance(alpha, str) else []))
    by = [*keys, alpha] if isinstance(alpha, str) else list(keys)
    g = gram(rows, by, ["_one", *xs, y])
    g = g.withColumnRenamed(alpha, "alpha") if isinstance(alpha, str) else g.withColumn("alpha", F.lit(float(alpha)))
    m = len(xs) + 2

    def fit(packed, a):
        w, _, _, ym = solve_ridge(unpack([packed], m)[0], a)
        n = int(round(packed[0]))
        for name, v in zip(xs, w):
            yield name, float(v), float(ym), n

    fields = [T.StructField("feature", T.StringType()), T.StructField("coef", T.DoubleType()), T.StructField("intercept", T.DoubleType()), T.StructField("n", T.LongType())]
    return per_row(g.select(*keys, "g", "alpha"), keys, fields, fit)


def number_rows(df: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Row number and row count per key, in date order; counted inside blocks of the calendar and over block totals."""
    numbered = running(df, keys, {"_rn": F.lit(1).cast("bigint")})
    return numbered.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys))


def fold_block(rn: Column, n: Column, folds: int = FOLDS) -> Column:
    """0 for rows that only ever train, i for the validation rows of fold i. Fold i trains on blocks 0 to i-1."""
    size = F.floor(n / (folds + 1))
    start = n - folds * size
    return F.when(rn <= start, F.lit(0)).otherwise(F.floor((rn - start - 1) / size) + 1).cast("bigint")


def time_series_folds(df: DataFrame, keys: Sequence[str] = ("entity",), folds: int = FOLDS) -> DataFrame:
    """Window and size of the training and validation part of every fold."""
    blocks = number_rows(df, keys).withColumn("_b", fold_block(F.col("_rn"), F.col("_n"), folds))
    parts = blocks.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("ts").alias("_s"), F.max("ts").alias("_e"))
    fan = attach(parts, [(i,) for i in range(1, folds + 1)], ["fold"])
    train, val = F.col("_b") < F.col("fold"), F.col("_b") == F.col("fold")
    return fan.groupBy(*keys, "fold").agg(
        F.sum(F.when(train, F.col("_c"))).alias("n_train"), F.sum(F.when(val, F.col("_c"))).alias("n_val"), F.min(F.when(train, F.col("_s"))).alias("train_start"),
        F.max(F.when(train, F.col("_e"))).alias("train_end"), F.min(F.when(val, F.col("_s"))).alias("val_start"), F.max(F.when(val, F.col("_e"))).alias("val_end"))


def fold_grams(df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str] = ("entity",), folds: int = FOLDS, h: int = 0) -> DataFrame:
    """(keys, blocks): the Gram of every fold block; rows are read once for all folds and penalties.

    ``h`` shifts the response ahead. ``h=0`` uses the same month's response, which rolling features of the response
    already contain; use ``h>=1`` for an honest error.
    """
    known = df
    target = y
    if h:
        known = sliding(df.select(*keys, "ts", *xs, *([y] if y not in xs else [])), keys, lambda w: {"_ahead": F.lead(y, h).over(w)}, ahead=h)
        target = "_ahead"
    rows = number_rows(known.filter(all_known([*xs, target])).select(*keys, "ts", *xs, *([target] if target not in xs else [])), keys)
    rows = rows.withColumn("_b", fold_block(F.col("_rn"), F.col("_n"), folds)).withColumn("_one", F.lit(1.0)).withColumn("_y", F.col(target))
    g = gram(rows, [*keys, "_b"], ["_one", *xs, "_y"])
    return g.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", "g"))), lambda s: s["g"]).alias("blocks"))


def alpha_cv(df: DataFrame, xs: Sequence[str], y: str, alphas: Sequence[float], keys=("entity",), folds: int = FOLDS, h: int = 0) -> DataFrame:
    """Training and validation error of every penalty in every fold, from the fold Grams alone."""
    m, grid = len(xs) + 2, [float(a) for a in alphas]

    def score(blocks):
        b = unpack(list(blocks), m)
        upto = np.cumsum(b, axis=0)
        for a in grid:
            for i in range(1, len(b)):
                model = solve_ridge(upto[i - 1], a)
                yield (a, i, int(round(upto[i - 1][0, 0])), int(round(b[i][0, 0])), none_if_nan(mean_square_error(upto[i - 1], *model)),
                       none_if_nan(mean_square_error(b[i], *model)))

    fields = [T.StructField("alpha", T.DoubleType()), T.StructField("fold", T.LongType()), T.StructField("n_train", T.LongType()), T.StructField("n_val", T.LongType()),
              T.StructField("train_mse", T.DoubleType()), T.StructField("val_mse", T.DoubleType())]
    return per_row(fold_grams(df, xs, y, keys, folds, h), keys, fields, score)


def select_alpha(scores: DataFrame, keys=("entity",), folds: int = FOLDS) -> DataFrame:
    """Best mean validation error, largest penalty within one standard error of it, and where in the grid they lie."""
    per = scores.groupBy(*keys, "alpha").agg(F.avg("val_mse").alias("_m"), (F.stddev_samp("val_mse") / F.sqrt(F.lit(float(folds)))).alias("_se"))
    packed = per.groupBy(*keys).agg(F.min_by(F.struct("alpha", "_m", "_se"), F.struct("_m", "alpha")).alias("_best"), F.min("alpha").alias("_lo"), F.max("alpha").alias("_hi"),
                                    F.collect_list(F.struct("alpha", "_m")).alias("_all"))
    limit = F.col("_best._m") + F.col("_best._se")
    one_se = F.array_max(F.transform(F.filter("_all", lambda s: s["_m"] <= limit), lambda s: s["alpha"]))
    best = F.col("_best.alpha")
    where = F.when(best == F.col("_lo"), "lower").when(best == F.col("_hi"), "upper").otherwise("interior")
    return packed.select(*keys, best.alias("alpha"), F.col("_best._m").alias("cv_mse"), F.col("_best._se").alias("cv_se"), one_se.alias("alpha_1se"), where.alias("boundary"))


def intercept_bound(df: DataFrame, y: str, keys=("entity",), folds: int = FOLDS) -> DataFrame:
    """Mean over folds of the error of predicting the training mean: the limit of an infinite penalty."""
    blocks = number_rows(df.filter(F.col(y).isNotNull()), keys).withColumn("_b", fold_block(F.col("_rn"), F.col("_n"), folds))
    sums = blocks.groupBy(*keys, "_b").agg(F.count(y).alias("c"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    fan = attach(sums, [(i,) for i in range(1, folds + 1)], ["fold"])
    train, val = F.col("_b") < F.col("fold"), F.col("_b") == F.col("fold")

    def part(cond, c):
        return F.sum(F.when(cond, F.col(c)))

    per = fan.groupBy(*keys, "fold").agg((part(train, "s") / part(train, "c")).alias("mu"), part(val, "c").alias("c"), part(val, "s").alias("s"), part(val, "q").alias("q"))
    mse = (F.col("q") - 2 * F.col("mu") * F.col("s") + F.col("c") * F.col("mu") * F.col("mu")) / F.col("c")
    return per.groupBy(*keys).agg(F.avg(mse).alias("intercept_mse"))


def fold_coefs(df: DataFrame, xs: Sequence[str], y: str, alpha: DataFrame | float, keys=("entity",), folds: int = FOLDS, h: int = 0) -> DataFrame:
    """(keys, feature, fold, coef) with fold 0 for the whole training sample."""
    m, names = len(xs) + 2, list(xs)
    blocks = fold_grams(df, xs, y, keys, folds, h)
    blocks = blocks.withColumn("alpha", F.lit(float(alpha))) if not isinstance(alpha, DataFrame) else blocks.join(alpha.select(*keys, "alpha"), list(keys))

    def fit(packed, a):
        upto = np.cumsum(unpack(list(packed), m), axis=0)
        for fold in range(len(upto)):
            g = upto[-1] if fold == 0 else upto[fold - 1]
            for name, v in zip(names, solve_ridge(g, a)[0]):
                yield name, fold, float(v)

    return per_row(blocks.select(*keys, "blocks", "alpha"), keys, [T.StructField("feature", T.StringType()), T.StructField("fold", T.LongType()), T.StructField("coef", T.DoubleType())], fit)


def coef_stability(coefs: DataFrame, keys=("entity",)) -> DataFrame:
    """Full-sample coefficient against its fold distribution: spread, sign agreement, rank by size."""
    full = F.max(F.when(F.col("fold") == 0, F.col("coef")))
    in_fold = F.when(F.col("fold") > 0, F.col("coef"))
    signs = F.collect_list(F.when(F.col("fold") > 0, F.signum("coef")))
    agg = coefs.groupBy(*keys, "feature").agg(full.alias("coef"), F.avg(in_fold).alias("fold_mean"), F.stddev_samp(in_fold).alias("fold_sd"), F.min(in_fold).alias("fold_min"),
                                              F.max(in_fold).alias("fold_max"), signs.alias("_s"))
    same = F.size(F.filter("_s", lambda s: s == F.signum("coef")))
    out = agg.select(*keys, "feature", "coef", "fold_mean", "fold_sd", "fold_min", "fold_max", same.cast("bigint").alias("n_same_sign"), (same == F.size("_s")).alias("sign_stable"))
    return out.withColumn("rank_abs", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("coef")), "feature")))


def top_features(coefs: DataFrame, n: int = 10, keys=("entity",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("coef")), "feature")
    return coefs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(*keys, "rank", "feature", "coef")


def category_contribution(coefs: DataFrame, keys=("entity",)) -> DataFrame:
    """Weight of each feature category; ``coefs`` has a category column. Empty categories show zeros."""
    size = F.abs("coef")
    agg = coefs.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("sum_abs"), F.avg(size).alias("mean_abs"), F.max(size).alias("max_abs"),
                                               F.max_by("feature", F.struct(size, F.col("feature"))).alias("top_feature"))
    every = coefs.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return every.join(agg, [*keys, "category"], "left").na.fill(0, ["n", "sum_abs", "mean_abs", "max_abs"])


def magnitude_summary(stability: DataFrame, baseline, key: str = "entity") -> DataFrame:
    """Size of the coefficients per entity and relative to a baseline entity."""
    size = F.abs("coef")
    agg = stability.groupBy(key).agg(F.max(size).alias("max_abs"), F.avg(size).alias("mean_abs"), F.sum(size).alias("sum_abs"), F.percentile(size, F.lit(0.5)).alias("median_abs"),
                                     F.count_if("sign_stable").alias("n_stable"))
    several = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("the baseline has several rows")).cast("double"))
    base = agg.filter(F.col(key) == baseline).agg(several.otherwise(F.max("max_abs")).alias("_b"))  # one row
    return agg.join(F.broadcast(base)).withColumn("ratio_to_baseline", F.try_divide("max_abs", "_b")).drop("_b")


FORECAST_FIELDS = [T.StructField("origin_date", T.DateType()), T.StructField("y_true", T.DoubleType()), T.StructField("y_naive", T.DoubleType()),
                   T.StructField("n_train", T.LongType()), T.StructField("y_pred", T.DoubleType())]


def direct_walk_forward(df: DataFrame, xs: Sequence[str], y: str, alpha: DataFrame | float, start, horizons: Sequence[int], keys=("entity",), minimum: int = MIN_TRAIN,
                        span: int = SPAN) -> DataFrame:
    """Direct h-step forecasts with a refit at every origin; history is summed block by block.

    A row trains the response h months later, so it first counts at origin = row + h. ``alpha`` is a number or a table (keys, alpha).
    Origins with fewer than ``minimum`` rows, or without a penalty, have no forecast.
    """
    keys, xs, hmax = list(keys), list(xs), max(horizons)
    value = y if y not in xs else "_own"
    dense = df.select(*keys, "ts", *xs, F.col(y).alias("_own") if y in xs else F.col(y))
    ahead = sliding(dense, keys, lambda w: {f"_z{h}": F.lead(value, h).over(w) for h in horizons}, ahead=hmax)
    bounds = dense.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max("ts").alias("_end"))
    steps = F.explode(F.array(*[F.struct(F.lit(h).cast("bigint").alias("h"), F.col(f"_z{h}").alias("z")) for h in horizons]))
    fan = ahead.filter(all_known(xs)).withColumn("_p", steps).select(
        *keys, "ts", F.col("_p.h").alias("h"), F.col("_p.z").alias("_z"), F.col(value).alias("_now"), *xs)
    rows = fan.filter(F.col("_z").isNotNull()).withColumn("_tag", period_index("ts") + F.col("h"))
    origins = fan.filter(F.col("ts") >= F.lit(start)).join(bounds, keys).filter(F.col("ts") <= F.add_months("_end", -hmax)).select(
        *keys, "h", period_index("ts").alias("_tag"), F.col("ts").alias("origin_date"), F.col("_z").alias("y_true"), F.col("_now").alias("y_naive"), F.array(*xs).alias("x"))
    # a left join, so that the question which blocks have origins needs no penalty
    origins = origins.withColumn("alpha", F.lit(float(alpha))) if not isinstance(alpha, DataFrame) else origins.join(alpha.select(*keys, "alpha"), keys, "left")

    def predict(sums, totals, frame):
        found = []
        for g, x, a in zip(sums[0], frame["x"], frame["alpha"]):
            if g[0, 0] < minimum or a is None or np.isnan(a):
                found.append(None)
                continue
            w, mean, sd, ym = solve_ridge(g, a)
            found.append(float(ym + ((np.asarray(x, float) - mean) / sd) @ w))
        out = frame[["origin_date", "y_true", "y_naive"]].copy()
        out["n_train"] = np.round(sums[0][:, 0, 0]).astype(np.int64)
        out["y_pred"] = pd.Series(found, dtype=object, index=out.index)
        return out

    out = expanding(rows, [*keys, "h"], [*xs, "_z"], [moments(range(len(xs) + 1))], "_tag", origins, FORECAST_FIELDS, predict, span)
    return out.withColumn("target_date", F.add_months("origin_date", F.col("h").cast("int")))


def direct_metrics(forecasts: DataFrame, scale: DataFrame, keys=("entity",)) -> DataFrame:
    """Errors (actual minus forecast) per horizon, against the naive forecast and in units of the naive scale."""
    rows = forecasts.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    e, ne = F.col("y_true") - F.col("y_pred"), F.col("y_true") - F.col("y_naive")
    agg = rows.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n_origins"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
                                       F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"), F.sqrt(F.avg(ne * ne)).alias("naive_rmse"), F.avg(F.abs(ne)).alias("naive_mae"))
    return agg.join(scale, list(keys)).select(*agg.columns, F.try_divide("rmse", "naive_rmse").alias("rmse_ratio"), F.try_divide("mae", "scale").alias("mase"))


def layer_compare(a: DataFrame, b: DataFrame, names: tuple[str, str], keys=("entity", "h"), tolerance: float = 1e-9) -> DataFrame:
    """MASE of two layers per key: difference, improvement in percent, winner."""
    x = a.select(*keys, F.col("mase").alias("mase_1"))
    out = x.join(b.select(*keys, F.col("mase").alias("mase_2")), list(keys))
    delta = F.col("mase_2") - F.col("mase_1")
    return out.withColumn("delta", delta).withColumn("improvement_pct", F.try_divide(-100.0 * delta, F.col("mase_1"))).withColumn(
        "winner", F.when(F.abs(delta) <= tolerance, "tie").when(delta < 0, names[1]).otherwise(names[0]))


def entity_scorecard(selection: DataFrame, top: DataFrame, metrics: DataFrame, horizons: Sequence[int], key: str = "entity") -> DataFrame:
    """One wide row per entity: penalty, three leading features, error ratio per horizon, horizons that beat naive."""
    lead = top.filter(F.col("rank") <= 3).groupBy(key).pivot("rank", [1, 2, 3]).agg(F.first("feature"))
    lead = lead.select(key, *[F.col(str(i)).alias(f"top_{i}") for i in (1, 2, 3)])
    per_h = metrics.groupBy(key).agg(*[F.max(F.when(F.col("h") == h, F.col("rmse_ratio"))).alias(f"ratio_h{h}") for h in horizons], F.count_if(F.col("rmse_ratio") < 1).alias("n_beats_naive"))
    return selection.select(key, "alpha", "boundary").join(lead, key).join(per_h, key)


def lens_audit(coefs: DataFrame, feature: str, pattern: str, top: int = 5, key: str = "entity") -> DataFrame:
    """Is a named feature among the leading ones, a base feature, negative; and which leading ones match a pattern."""
    ranked = top_features(coefs, top, (key,)).join(coefs.select(key, "feature", "category"), [key, "feature"])
    in_top = ranked.groupBy(key).agg(
        F.bool_or(F.col("feature") == feature).alias("in_top"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("feature").rlike(pattern), F.col("feature")))), ",").alias("matching"))
    own = coefs.filter(F.col("feature") == feature).select(key, (F.col("category") == "base").alias("is_base"), (F.col("coef") < 0).alias("negative"), F.col("coef"))
    return in_top.join(own, key, "left").withColumn("passes", F.col("in_top") & F.col("is_base") & F.col("negative"))


def heterogeneity(selection: DataFrame, top: DataFrame, pattern: str, key: str = "entity") -> DataFrame:
    """Spread of the chosen penalties with the entities at both ends (one row), beside every entity whose leading features match.

    One row per matching entity, by name; without any a single row with a null entity.
    """
    spread = selection.agg(F.max("alpha").alias("alpha_max"), F.min("alpha").alias("alpha_min"), F.max_by(key, F.struct(F.col("alpha"), F.col(key))).alias("entity_max"),
                           F.min_by(key, F.struct(F.col("alpha"), F.col(key))).alias("entity_min"))
    spread = spread.withColumn("ratio", F.try_divide("alpha_max", "alpha_min")).withColumn("_one", F.lit(True))
    hits = top.filter(F.col("feature").rlike(pattern)).groupBy(F.col(key).alias("matching_entity")).agg(F.count(F.lit(1)).alias("n_matching")).withColumn("_one", F.lit(True))
    return spread.join(hits, "_one", "left").drop("_one").na.fill(0, ["n_matching"])
