"""Forecast evaluation: error measures and paired Diebold-Mariano comparison of layers.

All cells of a comparison are one aggregate. Errors are always recomputed as actual minus forecast; stored error
columns differ in sign between layers. Negative statistics mean that the first layer is better.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dist import t_sf
from panelspark.functions.guards import provided
from panelspark.functions.series import running, sliding
from panelspark.schema import attach

CELL = ("entity", "form", "h", "layer_1", "layer_2")
ALPHA, STRICT = 0.05, 0.01
MIN_PAIRS = 30
ZERO = 1e-8


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def mae(e: Column) -> Column:
    return F.avg(F.abs(e))


def naive_scale(df: DataFrame, value: str, train_end, period: int = 1, keys=("entity",)) -> DataFrame:
    """Mean absolute difference over ``period`` steps in the training part."""
    diffs = sliding(df.filter(F.col("ts") <= F.lit(train_end)), keys, lambda w: {"_d": F.abs(F.col(value) - F.lag(value, period).over(w))}, back=period)
    return diffs.groupBy(*keys).agg(F.avg("_d").alias("scale"))


def mase(errors: DataFrame, scale: DataFrame, by: Sequence[str], on: Sequence[str] = ("entity",)) -> DataFrame:
    """Mean absolute error over the naive scale; a scale that is missing or not positive is an error."""
    sums = errors.groupBy(*by).agg(F.count("e").alias("n"), mae(F.col("e")).alias("mae"))
    joined = sums.join(scale, list(on), "left")
    good = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("naive scale must be positive")).cast("double"))
    return joined.withColumn("mase", F.col("mae") / good)


def hln_factor(n: Column, h: Column) -> Column:
    """Small-sample factor of Harvey, Leybourne and Newbold; an invalid pair is an error."""
    inside = (n + 1 - 2 * h + h * (h - 1) / n) / n
    return F.when((n > 0) & (h >= 1) & (inside > 0), F.sqrt(inside)).otherwise(F.raise_error(F.lit("invalid sample size and horizon")).cast("double"))


def loss_differential(e1: Column, e2: Column, loss: str = "squared") -> Column:
    if loss == "squared":
        return e1 * e1 - e2 * e2
    if loss == "absolute":
        return F.abs(e1) - F.abs(e2)
    raise ValueError(f"unknown loss {loss!r}")


def errors(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("e", F.col("y_true") - F.col("y_pred"))


def pairs_of(layers: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(layers) for b in layers[i + 1:]]


def align_matched(forecasts: DataFrame, pairs: Sequence[tuple[str, str]], tolerance: float = 1e-6, guard: bool = True) -> DataFrame:
    """Errors of two layers on the same target, for all pairs at once.

    The layers of one (entity, form, h, target) are brought side by side by one aggregate instead of a join per pair. The query fails if
    layers disagree on the actual value, if a layer has several forecasts of one target, or (with ``guard``) if no target has forecasts of a pair.
    """
    layers = sorted({x for p in pairs for x in p})
    side = forecasts.groupBy("entity", "form", "h", "target_date").agg(*[c for i, x in enumerate(layers) for c in (
        F.max(F.when(F.col("layer") == x, F.struct("y_true", "y_pred"))).alias(f"_{i}"), F.count_if(F.col("layer") == x).alias(f"_k{i}"))])

    def one(i: int, layer: str) -> Column:
        several = F.raise_error(F.concat(F.lit(f"several forecasts of layer {layer} for "), F.concat_ws(" ", "entity", "form", "h", "target_date")))
        return F.when(F.col(f"_k{i}") > 1, several.cast(side.schema[f"_{i}"].dataType)).otherwise(F.col(f"_{i}"))

    side = side.select("entity", "form", "h", "target_date", *[one(i, x).alias(f"_{i}") for i, x in enumerate(layers)])
    at = {x: F.col(f"_{i}") for i, x in enumerate(layers)}
    both = F.array_compact(F.array(*[F.when(at[a].isNotNull() & at[b].isNotNull(), F.struct(
        F.lit(a).alias("layer_1"), F.lit(b).alias("layer_2"), at[a].alias("f1"), at[b].alias("f2"))) for a, b in pairs]))
    rows = side.select("entity", "form", "h", "target_date", F.explode(both).alias("p"))
    gap = F.abs(F.col("p.f1.y_true") - F.col("p.f2.y_true"))
    y = F.when(gap > tolerance, F.raise_error(F.lit("layers disagree on the actual value")).cast("double")).otherwise(F.col("p.f1.y_true"))
    out = rows.select("entity", "form", "h", "p.layer_1", "p.layer_2", "target_date", y.alias("y_true"),
                      (y - F.col("p.f1.y_pred")).alias("e1"), (y - F.col("p.f2.y_pred")).alias("e2"))
    return provided(out, "any pair of layers") if guard else out


def _lagged(rows: DataFrame, d: str, by: Sequence[str], max_h: int) -> DataFrame:
    """Lags of ``d`` by position in a cell: a missing target closes up. Cells are worked through in blocks of dates, then of positions."""
    numbered = running(rows, by, {"_pos": F.lit(1).cast("bigint")}, ts="target_date")
    lagged = sliding(numbered, by, lambda w: {f"_d{k}": F.lag(d, k).over(w) for k in range(1, max_h)}, back=max(1, max_h - 1), ts="_pos", unit="index")
    return lagged.drop("_pos")


def _autocov_sums(d: str, max_h: int) -> list[Column]:
    out = [F.sum(F.col(d) * F.col(d)).alias("_s0")]
    for k in range(1, max_h):
        lagged = F.col(f"_d{k}")
        out += [F.sum(F.col(d) * lagged).alias(f"_s{k}"), F.sum(F.when(lagged.isNotNull(), F.col(d) + lagged)).alias(f"_t{k}"), F.count(lagged).alias(f"_c{k}")]
    return out


def _lrv(n: Column, m: Column, h: Column, max_h: int) -> Column:
    """Bartlett combination with h-1 lags; centring is done on the sums, so the mean needs no pass of its own.

    ``max_h`` must be the largest horizon at least: it fixes the number of sums, and a longer one is an error.
    """
    guard = F.when(h > max_h, F.raise_error(F.concat(F.lit("horizon beyond max_h: "), h.cast("string"))).cast("double")).otherwise(F.lit(0.0))
    total = F.col("_s0") - n * m * m + guard
    for k in range(1, max_h):
        g = F.coalesce(F.col(f"_s{k}") - m * F.col(f"_t{k}") + F.col(f"_c{k}") * m * m, F.lit(0.0))
        total = total + F.when(h > k, 2 * (1 - k / h) * g).otherwise(F.lit(0.0))
    return total / n


def newey_west(aligned: DataFrame, d: str = "d", max_h: int = 12) -> DataFrame:
    """Long-run variance of ``d`` per cell with h-1 lags, all terms divided by T."""
    rows = _lagged(aligned.select(*CELL, "target_date", d), d, CELL, max_h)
    sums = rows.groupBy(*CELL).agg(F.count(d).alias("n"), F.avg(d).alias("_m"), *_autocov_sums(d, max_h))
    return sums.select(*CELL, "n", _lrv(F.col("n"), F.col("_m"), F.col("h"), max_h).alias("lrv"))


def _dm(n: Column, h: Column, mean: Column, variance: Column, zero: Column) -> Column:
    """Statistic from mean and variance of the loss differential: too few rows, then identical losses, then variance."""
    return F.when(n <= h, F.lit(None)).when(zero, F.lit(0.0)).when(variance > 0, mean / F.sqrt(variance / n) * hln_factor(n, h))


def dm_tests(aligned: DataFrame, max_h: int = 12) -> DataFrame:
    """Standard, long-run-variance and absolute-loss Diebold-Mariano tests of every cell in one aggregate."""
    e1, e2 = F.col("e1"), F.col("e2")
    rows = aligned.select(*CELL, "target_date", loss_differential(e1, e2).alias("d"), loss_differential(e1, e2, "absolute").alias("da"))
    rows = _lagged(rows, "d", CELL, max_h)
    cells = rows.groupBy(*CELL).agg(
        F.count("d").alias("n_paired"), F.avg("d").alias("d_mean_squared"), F.avg("da").alias("d_mean_absolute"), F.var_samp("d").alias("_v"),
        F.var_samp("da").alias("_va"), F.bool_and(F.abs("d") <= ZERO).alias("_z"), F.bool_and(F.abs("da") <= ZERO).alias("_za"), *_autocov_sums("d", max_h))
    n, h, m = F.col("n_paired"), F.col("h"), F.col("d_mean_squared")
    lrv = _lrv(n, m, h, max_h)
    out = cells.select(*CELL, "n_paired", "d_mean_squared", "d_mean_absolute", lrv.alias("lrv"), _dm(n, h, m, F.col("_v"), F.col("_z")).alias("dm_standard"),
                       _dm(n, h, m, lrv, F.col("_z")).alias("dm_hac"), _dm(n, h, F.col("d_mean_absolute"), F.col("_va"), F.col("_za")).alias("dm_robust"))
    df = (n - 1).cast("double")
    return out.select("*", *[t_sf(f"dm_{v}", df).alias(f"p_{v}") for v in ("standard", "hac", "robust")])


def winner(stat: Column, p: Column, layer_1: Column, layer_2: Column, alpha: float = ALPHA) -> Column:
    return F.when(stat.isNull() | p.isNull(), "undefined").when(p >= alpha, "tie").when(stat < 0, layer_1).otherwise(layer_2)


def cell_manifest(entities: DataFrame, one_step: Sequence[tuple[str, str]], multi_step: tuple[str, str], horizons: Sequence[int], form: str,
                  extra: Sequence[Sequence] = ()) -> DataFrame:
    """Cells in scope: all one-step pairs and one multi-step pair per entity, plus ``extra`` (entity, form, h, layer_1, layer_2, scope)."""
    plan = [(form, 1, a, b, "primary_h1") for a, b in one_step] + [(form, h, *multi_step, "primary_multi") for h in horizons if h != 1]
    names = ["form", "h", "layer_1", "layer_2", "scope"]
    cells = attach(entities.select("entity").distinct(), plan, names).withColumn("primary", F.lit(True))
    if extra:
        more = entities.sparkSession.range(1).transform(lambda d: attach(d, extra, ["entity", *names])).drop("id").withColumn("primary", F.lit(False))
        cells = cells.unionByName(more)
    return cells


def cell_coverage(manifest: DataFrame, forecasts: DataFrame, pairs: Sequence[tuple[str, str]], minimum: int = MIN_PAIRS) -> DataFrame:
    """Rows per layer and matched rows for every cell, and whether the cell can be tested."""
    per_layer = forecasts.groupBy("entity", "form", "h", "layer").agg(F.count(F.lit(1)).alias("n"))
    matched = align_matched(forecasts, pairs, guard=False).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_paired"))
    one = per_layer.select("entity", "form", "h", F.col("layer").alias("layer_1"), F.col("n").alias("n_layer_1"))
    two = per_layer.select("entity", "form", "h", F.col("layer").alias("layer_2"), F.col("n").alias("n_layer_2"))
    out = manifest.join(one, ["entity", "form", "h", "layer_1"], "left").join(two, ["entity", "form", "h", "layer_2"], "left").join(matched, list(CELL), "left")
    out = out.na.fill(0, ["n_layer_1", "n_layer_2", "n_paired"])
    status = (F.when((F.col("n_layer_1") == 0) | (F.col("n_layer_2") == 0), "MISSING").when(F.col("n_paired") == 0, "ERROR: no common targets")
              .when(F.col("n_paired") < minimum, "UNDERPOWERED").otherwise("OK"))
    return out.withColumn("status", status)


def dm_battery(forecasts: DataFrame, manifest: DataFrame, pairs: Sequence[tuple[str, str]], minimum: int = MIN_PAIRS, max_h: int = 12) -> DataFrame:
    """All three tests for every testable cell of the manifest, with winners, flags and agreement; ``cell_coverage`` tells of the others."""
    tests = dm_tests(align_matched(forecasts, pairs, guard=False), max_h).filter(F.col("n_paired") >= minimum)
    out = manifest.join(tests, list(CELL))
    for v in ("standard", "hac", "robust"):
        out = out.withColumn(f"winner_{v}", winner(F.col(f"dm_{v}"), F.col(f"p_{v}"), F.col("layer_1"), F.col("layer_2")))
        out = out.withColumn(f"sig_{v}", F.coalesce(F.col(f"p_{v}") < ALPHA, F.lit(False)))
    out = out.withColumn("sig_standard_strict", F.coalesce(F.col("p_standard") < STRICT, F.lit(False)))
    agree = (F.col("winner_standard") == F.col("winner_hac")) & (F.col("winner_standard") == F.col("winner_robust"))
    return out.withColumn("agreement", agree).drop("lrv")


def battery_summary(battery: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Counts by pair, entity, horizon, scope and overall in one pass."""
    df = battery.withColumn("pair", F.concat_ws("-", "layer_1", "layer_2")).withColumn("horizon", F.col("h").cast("string"))
    sets = df.groupingSets([["pair"], ["entity"], ["horizon"], ["scope"], []], "pair", "entity", "horizon", "scope")
    out = sets.agg(
        F.grouping_id("pair", "entity", "horizon", "scope").alias("_g"), F.count(F.lit(1)).alias("n_cells"),
        *[F.count_if(F.col(c)).alias(f"n_{c}") for c in ("sig_standard_strict", "sig_standard", "sig_hac", "sig_robust")],
        *[F.count_if(F.col("winner_standard") == x).alias(f"wins_{x}") for x in layers],
        F.count_if(F.col("winner_standard") == "tie").alias("ties"), F.count_if(F.col("winner_standard") == "undefined").alias("undefined"),
        F.avg(F.col("agreement").cast("double")).alias("agreement_rate"))
    kind = F.when(F.col("pair").isNotNull(), "pair").when(F.col("entity").isNotNull(), "entity").when(F.col("horizon").isNotNull(), "horizon") \
        .when(F.col("scope").isNotNull(), "scope").otherwise("overall")
    value = F.coalesce("pair", "entity", "horizon", "scope", F.lit("all"))
    return out.select(kind.alias("grouping"), value.alias("value"), *[c for c in out.columns if c not in ("pair", "entity", "horizon", "scope", "_g")])


def exclude_origins(forecasts: DataFrame, origins: Sequence) -> DataFrame:
    """Forecasts made at the listed origins removed. The list is short, so it is a predicate that reaches the scan."""
    return forecasts.filter(~F.col("origin_date").isin(list(origins)))


def exclusion_counts(forecasts: DataFrame, origins: Sequence) -> DataFrame:
    return forecasts.groupBy("entity", "form", "h", "layer").agg(F.count_if(F.col("origin_date").isin(list(origins))).alias("n_excluded"))


def trimmed_battery(forecasts: DataFrame, manifest: DataFrame, pairs, origins, minimum: int = MIN_PAIRS) -> DataFrame:
    """The battery without some origins, with the number of forecasts each layer lost."""
    lost = exclusion_counts(forecasts, origins)
    base = dm_battery(exclude_origins(forecasts, origins), manifest, pairs, minimum)
    for i in ("1", "2"):
        side = lost.select("entity", "form", "h", F.col("layer").alias(f"layer_{i}"), F.col("n_excluded").alias(f"n_excluded_{i}"))
        base = base.join(side, ["entity", "form", "h", f"layer_{i}"], "left")
    return base


def verdict_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Winner changes between two batteries."""
    b = before.select(*CELL, *[F.col(f"winner_{v}").alias(f"{v}_before") for v in ("standard", "hac", "robust")])
    a = after.select(*CELL, F.col("n_paired").alias("n_after"), *[F.col(f"winner_{v}").alias(f"{v}_after") for v in ("standard", "hac", "robust")])
    out = b.join(a, list(CELL))
    for v in ("standard", "hac", "robust"):
        same = F.col(f"{v}_before") == F.col(f"{v}_after")
        out = out.withColumn(f"flip_{v}", ~same).withColumn(f"change_{v}", F.when(same, "no change").otherwise(F.concat_ws(" → ", f"{v}_before", f"{v}_after")))
    return out.withColumn("any_flip", F.col("flip_standard") | F.col("flip_hac") | F.col("flip_robust"))


def tags(rules: Sequence[tuple[str, Column]]) -> Column:
    """Sorted, comma-joined names of the rules that hold."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))), ",")


def origin_integrity(forecasts: DataFrame, a: str, b: str) -> DataFrame:
    """Origins of two layers per entity: sizes, common, one-sided, equal; and the horizons present."""
    flags = forecasts.filter(F.col("layer").isin(a, b)).groupBy("entity", "origin_date").agg(
        F.bool_or(F.col("layer") == a).alias("_a"), F.bool_or(F.col("layer") == b).alias("_b"), F.collect_set("h").alias("_h"))
    out = flags.groupBy("entity").agg(
        F.count_if("_a").alias("n_a"), F.count_if("_b").alias("n_b"), F.count_if(F.col("_a") & F.col("_b")).alias("n_common"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("n_only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("n_only_b"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_h")))), ",").alias("horizons"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def divergent_cells(battery: DataFrame) -> DataFrame:
    """No difference in squared loss, but one in absolute loss."""
    return battery.filter((F.col("winner_standard") == "tie") & F.col("sig_robust"))


def window_errors(forecasts: DataFrame, windows: Sequence[Sequence], by: Sequence[str], date: str = "target_date") -> DataFrame:
    """n, RMSE, MAE and bias (actual minus forecast) in the full sample and in named date windows."""
    hits = F.array_compact(F.array(F.lit("full"), *[F.when(F.col(date).between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in windows]))
    return errors(forecasts).withColumn("window", F.explode(hits)).groupBy(*by, "window").agg(
        F.count("e").alias("n"), rmse(F.col("e")).alias("rmse"), mae(F.col("e")).alias("mae"), F.avg("e").alias("bias"))

