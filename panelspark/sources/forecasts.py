"""Adapters that bring the forecasts of three model layers into one schema (``schema.FORECAST``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.guards import provided
from panelspark.schema import FORECAST, lookup, require_columns

#: What two forecasts must have in common to be compared.
CELL = ("entity", "form", "h", "target_date")


def _mapped(column: str, what: str, key: str) -> Column:
    return F.coalesce(F.col(column), F.raise_error(F.concat(F.lit(f"unknown {what} "), F.col(key))).cast("string"))


def _unified(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FORECAST])


def mixed_date(c: str) -> Column:
    """Date from text that is either a date or a timestamp."""
    c = F.col(c).cast("string")
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def adapt_univariate(df: DataFrame, variants: Sequence[Sequence], layer: str = "univariate") -> DataFrame:
    """(variant_id, date, actual, predicted) one-step forecasts; ``variants`` holds (variant_id, entity, form)."""
    require_columns(df, ["variant_id", "date", "actual", "predicted"])
    known = lookup(df, variants, ["variant_id", "_entity", "_form"], ["variant_id"])
    return _unified(known.select(
        F.lit(layer).alias("layer"), _mapped("_entity", "variant", "variant_id").alias("entity"), F.col("_form").alias("form"),
        F.lit(1).alias("h"), F.add_months(mixed_date("date"), -1).alias("origin_date"), mixed_date("date").alias("target_date"),
        F.col("actual").alias("y_true"), F.col("predicted").alias("y_pred")))


def adapt_multivariate(df: DataFrame, target: str, form: str, layer: str = "multivariate", guard: bool = True) -> DataFrame:
    """(entity, variable, h, origin_date, target_date, actual, forecast); only the target's rows are kept.

    A target without rows makes the query fail; without ``guard`` that is left to ``unify_forecasts``.
    """
    require_columns(df, ["entity", "variable", "h", "origin_date", "target_date", "actual", "forecast"])
    out = _unified(df.filter(F.col("variable") == target).select(
        F.lit(layer).alias("layer"), "entity", F.lit(form).alias("form"), "h", "origin_date", "target_date",
        F.col("actual").alias("y_true"), F.col("forecast").alias("y_pred")))
    return provided(out, f"target {target}", by=CELL) if guard else out


def adapt_direct(df: DataFrame, labels: Sequence[Sequence], layer: str = "direct") -> DataFrame:
    """(entity, form_label, h, origin_date, target_date, actual, forecast); ``labels`` holds (form_label, form)."""
    require_columns(df, ["entity", "form_label", "h", "origin_date", "target_date", "actual", "forecast"])
    known = lookup(df, labels, ["form_label", "_form"], ["form_label"])
    return _unified(known.select(
        F.lit(layer).alias("layer"), "entity", _mapped("_form", "form", "form_label").alias("form"), "h", "origin_date",
        "target_date", F.col("actual").alias("y_true"), F.col("forecast").alias("y_pred")))


def unify_forecasts(*layers: DataFrame, names: Sequence[str] = (), expected: Mapping[str, int] | None = None) -> DataFrame:
    """All layers in one table, dealt by the columns that comparisons group by.

    The query fails if there is no row, if a layer of ``names`` has none, or if a layer of ``expected`` has another number of rows (as counted
    when its forecasts were made).
    """
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df)

    def rows(layer: str) -> Column:
        return F.count_if(F.col("layer") == layer)

    checks = [(rows(n) > 0, f"layer {n} has no rows") for n in names]
    checks += [(rows(n) == k, F.concat(F.lit(f"layer {n} should have {k} rows and has "), rows(n).cast("string"))) for n, k in (expected or {}).items()]
    return provided(out, "any layer", checks, CELL)
