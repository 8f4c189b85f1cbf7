"""Feature matrices: lags, rolling moments, regime dummies, interactions, and their checks.

Everything that looks back is computed in one window stage. Inputs are dense panels.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.series import sliding
from panelspark.operators.audit import nulls_leading_only
from panelspark.operators.clean import all_known, assemble_wide
from panelspark.operators.transform import apply_transform
from panelspark.functions.reshape import to_long

LAGS = (1, 3, 6, 12)
WINDOWS = (3, 12)
CATEGORIES = ("base", "lag", "rolling", "split", "period", "interaction")


def lag_columns(columns: Sequence[str], w, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags}


def rolling_columns(columns: Sequence[str], w, windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    """Mean and sample deviation over the last k rows including the current one; null unless all k are known."""
    out = {}
    for c in columns:
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            full = F.count(c).over(frame) == k
            out[f"{c}_roll{k}_mean"] = F.when(full, F.avg(c).over(frame))
            out[f"{c}_roll{k}_std"] = F.when(full, F.stddev_samp(c).over(frame))
    return out


def split_columns(breaks: Sequence[Sequence], ts: str = "ts") -> dict[str, Column]:
    return {f"D_{name}": (F.col(ts) >= F.lit(day)).cast("double") for name, day in breaks}


def period_columns(periods: Sequence[Sequence], ts: str = "ts") -> dict[str, Column]:
    return {f"P_{name}": F.col(ts).between(F.lit(a), F.lit(b)).cast("double") for name, a, b in periods}


def interaction_pairs(spec_rows: Sequence[Sequence]) -> list[tuple[str, str]]:
    """(driver, break) pairs of a regime specification; 'const' and missing drivers interact with nothing."""
    return sorted({(d, b) for _, b, d in spec_rows if d not in (None, "const")})


def attach_drivers(df: DataFrame, spec: DataFrame, breaks: Sequence[Sequence], key: str = "entity") -> DataFrame:
    """``spec`` (entity, break_name, driver) as one driver column per break."""
    wide = spec.groupBy(key).pivot("break_name", [b for b, _ in breaks]).agg(F.first("driver"))
    wide = wide.select(key, *[F.col(b).alias(f"_driver_{b}") for b, _ in breaks])
    return df.join(wide, key, "left")


def interaction_columns(pairs: Sequence[tuple[str, str]], breaks: Sequence[Sequence]) -> dict[str, Column]:
    """Split dummy times driver where the entity's specification names that driver, else constant zero.

    A constant column gets coefficient zero in every model here, which equals the column being absent. A null driver
    gives null.
    """
    split = split_columns(breaks)
    return {f"{d}_x_D_{b}": F.when(F.col(f"_driver_{b}") == d, split[f"D_{b}"] * F.col(d)).otherwise(F.lit(0.0))
            for d, b in pairs}


def lag_matrix(panel: DataFrame, columns, lags=LAGS, keys=("entity",)) -> DataFrame:
    return sliding(panel, keys, lambda w: lag_columns(columns, w, lags), back=max(lags), keep=[*keys, "ts"])


def rolling_matrix(panel: DataFrame, columns, windows=WINDOWS, keys=("entity",)) -> DataFrame:
    return sliding(panel, keys, lambda w: rolling_columns(columns, w, windows), back=max(windows), keep=[*keys, "ts"])


def regime_matrix(panel: DataFrame, breaks, periods, spec: DataFrame, pairs, keep=("entity", "ts")) -> DataFrame:
    named = {**split_columns(breaks), **period_columns(periods), **interaction_columns(pairs, breaks)}
    return attach_drivers(panel, spec, breaks).select(*keep, *[c.alias(n) for n, c in named.items()])


def feature_matrix(panel: DataFrame, columns: Sequence[str], breaks, periods, spec: DataFrame, pairs,
                   lags=LAGS, windows=WINDOWS, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Base, lag, rolling and regime columns of every entity in one window stage."""
    driven = attach_drivers(panel, spec, breaks)
    regime = {**split_columns(breaks), **period_columns(periods), **interaction_columns(pairs, breaks)}
    return sliding(driven, keys, lambda w: {**lag_columns(columns, w, lags), **rolling_columns(columns, w, windows), **regime},
                   back=max(*lags, *windows), keep=[*keys, "ts", *columns])


def form_matrices(long: DataFrame, registry: DataFrame, columns: Sequence[str], breaks, periods, spec: DataFrame, pairs,
                  lags=LAGS, windows=WINDOWS) -> DataFrame:
    """Feature matrices of several variants of a registry (variant, entity, indicator, form) in one pass, keyed by ``variant``.

    ``long`` (entity, indicator, ts, value) is read once; every feature of an entity is built from the forms of its variant.
    """
    shaped = apply_transform(long, registry, keys=("variant", "entity", "indicator"))
    wide = assemble_wide(shaped, columns, ("variant", "entity", "ts"))
    return feature_matrix(wide, columns, breaks, periods, spec, pairs, lags, windows, ("variant", "entity"))


def feature_names(columns, breaks, periods, pairs, lags=LAGS, windows=WINDOWS) -> list[str]:
    return [*columns, *[f"{c}_lag{k}" for c in columns for k in lags],
            *[f"{c}_roll{k}_{s}" for c in columns for k in windows for s in ("mean", "std")],
            *[f"D_{b}" for b, _ in breaks], *[f"P_{p[0]}" for p in periods], *[f"{d}_x_D_{b}" for d, b in pairs]]


def classify_feature(name: Column) -> Column:
    """Category from the column name; interactions are tested first because they contain a split name."""
    return (F.when(name.rlike("_x_"), "interaction").when(name.rlike("(^|_)D_[A-Za-z0-9_]+$"), "split")
            .when(name.rlike("(^|_)P_"), "period").when(name.rlike("_lag\\d+$"), "lag")
            .when(name.rlike("_roll\\d+_(mean|std)$"), "rolling").otherwise("base"))


def classify_feature_by_substring(name: Column) -> Column:
    """The second published ordering: substring tests, period before split, rolling before lag."""
    return (F.when(name.contains("_x_D_"), "interaction").when(name.rlike("(^|_)P_"), "period")
            .when(name.rlike("(^|_)D_"), "split")
            .when(name.contains("_roll") & (name.contains("_mean") | name.contains("_std")), "rolling")
            .when(name.rlike("_lag[0-9]+$"), "lag").otherwise("base"))


def feature_profile(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Known values per (entity, feature) and whether the feature carries anything for the entity."""
    return to_long(features, names).groupBy("entity", F.col("indicator").alias("feature")).agg(
        F.count("value").alias("n_known"), F.bool_or(F.coalesce(F.col("value") != 0, F.lit(False))).alias("present")
    ).withColumn("category", classify_feature(F.col("feature")))


def category_counts(profile: DataFrame) -> DataFrame:
    return profile.filter("present").groupBy("entity").pivot("category", list(CATEGORIES)).agg(
        F.count(F.lit(1))).na.fill(0)


def joint_valid_summary(features: DataFrame, names: Sequence[str]) -> DataFrame:
    whole = all_known(names)
    nulls = sum((F.col(c).isNull().cast("bigint") for c in names[1:]), F.col(names[0]).isNull().cast("bigint"))
    return features.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(names)).cast("bigint").alias("n_columns"),
        F.min(F.when(whole, F.col("ts"))).alias("first_joint"), F.max(F.when(whole, F.col("ts"))).alias("last_joint"),
        F.count_if(whole).alias("n_joint"), F.sum(nulls).alias("n_nulls"))


def endog_exog(features: DataFrame, endog: Sequence[str], exog: Sequence[str], keys=("entity", "ts")) -> DataFrame:
    """Jointly known rows of the endogenous columns in the given order, then the exogenous ones."""
    return features.select(*keys, *endog, *exog).filter(all_known([*endog, *exog]))


def regime_names(breaks, periods, pairs) -> list[str]:
    return [f"D_{b}" for b, _ in breaks] + [f"P_{p[0]}" for p in periods] + [f"{d}_x_D_{b}" for d, b in pairs]


def head_tail(panel: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """First and last ``n`` rows per entity in long form. Ranks are limited before the shuffle by Spark itself."""
    head = panel.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("ts")))
    tail = panel.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts"))))
    both = head.filter(F.col("rank") <= n).withColumn("position", F.lit("head")).unionByName(
        tail.filter(F.col("rank") <= n).withColumn("position", F.lit("tail")))
    return both.unpivot(["entity", "position", "rank", "ts"], list(columns), "column_name", "value")


def lag_self_check(features: DataFrame, columns: Sequence[str], lags=LAGS) -> DataFrame:
    """Each lag column must start exactly k months after its source, and have no null after that."""
    names = [f"{c}_lag{k}" for c in columns for k in lags]
    found = nulls_leading_only(to_long(features, names)).select(
        "entity", F.col("indicator").alias("column_name"), F.regexp_extract("indicator", "^(.*)_lag(\\d+)$", 1).alias("source"),
        F.regexp_extract("indicator", "^(.*)_lag(\\d+)$", 2).cast("bigint").alias("k"), "first_valid", "leading_only")
    base = nulls_leading_only(to_long(features, columns)).select("entity", F.col("indicator").alias("source"),
                                                                 F.col("first_valid").alias("source_first"))
    out = found.join(base, ["entity", "source"])
    want = F.add_months("source_first", F.col("k").cast("int"))
    return out.select("entity", "column_name", "source", "k", "source_first", want.alias("expected_first"), "first_valid",
                      (want == F.col("first_valid")).alias("matches"), "leading_only")


def rolling_self_check(features: DataFrame, columns: Sequence[str], windows=WINDOWS, tol: float = 1e-10) -> DataFrame:
    """The first known rolling value must equal a direct reduction of the first k source values, k-1 rows later."""
    base = nulls_leading_only(to_long(features, columns)).select("entity", F.col("indicator").alias("source"), F.col("first_valid").alias("source_first"))
    source = to_long(features, columns).select("entity", F.col("indicator").alias("source"), "ts", "value").join(base, ["entity", "source"])
    checks = F.explode(F.array(*[F.lit(k).cast("bigint") for k in windows]))
    direct = source.withColumn("k", checks).filter(
        F.col("ts") < F.add_months("source_first", F.col("k").cast("int"))).groupBy("entity", "source", "k", "source_first").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.max("ts").alias("expected_first"))
    direct = direct.select("entity", "source", "k", "expected_first", F.explode(F.array(
        F.struct(F.lit("mean").alias("stat"), F.col("m").alias("direct")), F.struct(F.lit("std").alias("stat"), F.col("s").alias("direct")))).alias("p")) \
        .select("entity", F.concat("source", F.lit("_roll"), "k", F.lit("_"), "p.stat").alias("column_name"), "expected_first", "p.direct")
    names = [f"{c}_roll{k}_{s}" for c in columns for k in windows for s in ("mean", "std")]
    rolled = to_long(features, names).select("entity", F.col("indicator").alias("column_name"), "ts", "value").filter(F.col("value").isNotNull())
    firsts = rolled.groupBy("entity", "column_name").agg(F.min("ts").alias("first_valid"), F.min_by("value", "ts").alias("value"))
    return direct.join(firsts, ["entity", "column_name"]).select(
        "entity", "column_name", "expected_first", "first_valid", "value", "direct",
        ((F.col("first_valid") == F.col("expected_first")) & (F.abs(F.col("value") - F.col("direct")) <= tol)).alias("matches"))


def dummy_self_check(features: DataFrame, breaks, periods) -> DataFrame:
    """Dummy value at, before and after its dates, and its number of ones, against the definition."""
    def at(c, day):
        return F.max(F.when(F.col("ts") == day, F.col(c)))

    rows = []
    for name, day in breaks:
        c, d = f"D_{name}", F.lit(day)
        rows.append(F.struct(F.lit(c).alias("dummy"), at(c, d).alias("at_start"), at(c, F.add_months(d, -1)).alias("before"),
                             F.max_by(c, "ts").alias("at_end"), F.lit(None).cast("double").alias("after"),
                             F.count_if(F.col("ts") >= d).alias("expected_ones"), F.count_if(F.col(c) == 1).alias("found_ones")))
    for name, a, b in periods:
        c = f"P_{name}"
        rows.append(F.struct(F.lit(c).alias("dummy"), at(c, F.lit(a)).alias("at_start"), at(c, F.add_months(F.lit(a), -1)).alias("before"),
                             at(c, F.lit(b)).alias("at_end"), at(c, F.add_months(F.lit(b), 1)).alias("after"),
                             F.count_if(F.col("ts").between(F.lit(a), F.lit(b))).alias("expected_ones"), F.count_if(F.col(c) == 1).alias("found_ones")))
    out = features.groupBy("entity").agg(F.array(*rows).alias("_r")).select("entity", F.explode("_r").alias("_p")).select("entity", "_p.*")
    ok = (F.col("at_start") == 1) & (F.col("at_end") == 1) & (F.coalesce("before", F.lit(0.0)) == 0) & (F.coalesce("after", F.lit(0.0)) == 0)
    return out.withColumn("matches", F.coalesce(ok & (F.col("expected_ones") == F.col("found_ones")), F.lit(False)))


def interaction_self_check(features: DataFrame, spec: DataFrame, breaks, pairs) -> DataFrame:
    """Rows where an interaction differs from split times driver (or from zero where not specified)."""
    driven = attach_drivers(features, spec, breaks)
    bad = [F.count_if(~F.col(f"{d}_x_D_{b}").eqNullSafe(
        F.when(F.col(f"_driver_{b}") == d, F.col(f"D_{b}") * F.col(d)).otherwise(F.lit(0.0)))).alias(f"{d}_x_D_{b}") for d, b in pairs]
    return driven.groupBy("entity").agg(*bad)


def split_summary(features: DataFrame, names: Sequence[str], target: str, train_end, test_start,
                  keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Joint-valid rows and the target's distribution in the training and the test part."""
    rows = features.filter(all_known(names))
    aggs = [F.count(F.lit(1)).alias("n_joint"), F.min("ts").alias("first_joint"), F.max("ts").alias("last_joint")]
    for part, cond in (("train", F.col("ts") <= F.lit(train_end)), ("test", F.col("ts") >= F.lit(test_start))):
        y = F.when(cond, F.col(target))
        aggs += [F.count(y).alias(f"{part}_n"), F.avg(y).alias(f"{part}_mean"), F.stddev_samp(y).alias(f"{part}_std"),
                 F.min(y).alias(f"{part}_min"), F.max(y).alias(f"{part}_max")]
    return rows.groupBy(*keys).agg(*aggs)


def train_rows(features: DataFrame, names: Sequence[str], train_end) -> DataFrame:
    """Training part; the date filter comes first so that it reaches the scan."""
    return features.filter(F.col("ts") <= F.lit(train_end)).filter(all_known(names))


def test_rows(features: DataFrame, names: Sequence[str], test_start) -> DataFrame:
    return features.filter(F.col("ts") >= F.lit(test_start)).filter(all_known(names))


def indicator_of(column: str) -> str:
    """Source indicator of a feature name."""
    return re.sub(r"(_lag\d+|_roll\d+_(mean|std)|_x_D_.*)$", "", column)
