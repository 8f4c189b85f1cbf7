"""Benchmark forecasts (naive, seasonal naive, drift, mean of a year) in the unified schema.

They stand in for model layers where a comparison must be checkable in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numbers import fixed
from panelspark.functions.series import period_index, sliding
from panelspark.operators.clean import densify, yoy
from panelspark.plans.panels import FIRST_ORIGIN, HORIZONS, TARGET, Tables, region_panel

ALT_ENTITY = "AFRICA"
SKEYS = ("entity", "form")
LAYERS = ("naive", "snaive", "drift", "mean12")


def target_series(panel: DataFrame) -> DataFrame:
    """(entity, form, ts, y): the target level of every entity and one entity's yearly growth as second form."""
    dense = densify(panel.select("entity", "ts", TARGET))
    both = sliding(dense, ["entity"], lambda w: {"g": yoy(TARGET, w)}, back=12)
    forms = F.array(F.struct(F.lit("level").alias("form"), F.col(TARGET).alias("y")),
                    F.when(F.col("entity") == ALT_ENTITY, F.struct(F.lit("yoy_pct").alias("form"), F.col("g").alias("y"))))
    return both.select("entity", "ts", F.explode(F.array_compact(forms)).alias("p")).select(
        "entity", "p.form", "ts", "p.y").filter(F.col("y").isNotNull())


def benchmark_forecasts(series: DataFrame, horizons=HORIZONS, first_origin=FIRST_ORIGIN) -> DataFrame:
    """All four layers at every origin and horizon with a known target: one window stage, then a fixed fan-out."""
    hmax = max(horizons)

    def build(w):
        year = w.rowsBetween(-11, 0)
        out = {f"_lead{h}": F.lead("y", h).over(w) for h in horizons}
        out |= {f"_season{h}": F.lag("y", 12 - h).over(w) for h in horizons}
        out["_mean"] = F.when(F.count("y").over(year) == 12, fixed(F.avg("y").over(year)))
        return out

    first = series.groupBy(*SKEYS).agg(F.min_by("y", "ts").alias("_y0"), F.min(period_index("ts")).alias("_i0"))
    rows = sliding(series, SKEYS, build, back=12, ahead=hmax).join(first, list(SKEYS))
    steps = period_index("ts") - F.col("_i0")
    per_h = []
    for h in horizons:
        drift = F.col("y") + h * (F.col("y") - F.col("_y0")) / F.when(steps > 0, steps)
        for layer, pred in (("naive", F.col("y")), ("snaive", F.col(f"_season{h}")), ("drift", fixed(drift)),
                            ("mean12", F.col("_mean"))):
            per_h.append(F.struct(F.lit(layer).alias("layer"), F.lit(h).cast("bigint").alias("h"),
                                  F.add_months("ts", h).alias("target_date"), F.col(f"_lead{h}").alias("y_true"),
                                  pred.alias("y_pred")))
    out = rows.filter(F.col("ts") >= F.lit(first_origin)).select(
        "entity", "form", F.col("ts").alias("origin_date"), F.explode(F.array(*per_h)).alias("p"))
    return out.select("p.layer", "entity", "form", "p.h", "origin_date", "p.target_date", "p.y_true", "p.y_pred").filter(
        F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def forecasts(t: Tables) -> DataFrame:
    return benchmark_forecasts(target_series(region_panel(t)))
