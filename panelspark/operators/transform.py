"""Series transforms and their dispatch by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.series import sliding
from panelspark.operators.clean import all_known, assemble_wide, yoy

PAIR = ("entity", "indicator")


def first_diff(v: str, w: WindowSpec) -> Column:
    return F.col(v) - F.lag(v, 1).over(w)


def second_diff(v: str, w: WindowSpec) -> Column:
    return F.col(v) - 2 * F.lag(v, 1).over(w) + F.lag(v, 2).over(w)


def yoy_pct(v: str, w: WindowSpec, periods: int = 12) -> Column:
    return yoy(v, w, periods)


def log_diff_pct(v: str, w: WindowSpec) -> Column:
    """100 * ln(x_t / x_{t-1}); null where either value is not positive."""
    now, before = F.col(v), F.lag(v, 1).over(w)
    return F.when((now > 0) & (before > 0), 100.0 * F.ln(now / before))


#: The extension point: transform name -> (column function, rows it looks back).
TRANSFORMS: dict[str, tuple[Callable[[str, WindowSpec], Column], int]] = {
    "level": (lambda v, w: F.col(v), 0),
    "first_diff": (first_diff, 1),
    "second_diff": (second_diff, 2),
    "yoy_pct": (yoy_pct, 12),
    "log_diff_pct": (log_diff_pct, 1),
}


def strip_suffix(form: str | Column) -> Column:
    """Base transform of an annotated registry value."""
    form = F.col(form) if isinstance(form, str) else form
    return F.when(form == "level_with_linear_trend", "level").otherwise(
        F.regexp_replace(form, "(_with_regime_dummy|_with_caveat)$", ""))


def test_spec(base: Column, indicator: Column, trending: Sequence[str]) -> Column:
    """Deterministic terms of the unit-root tests: trend only for the level of a trending indicator."""
    return F.when((base == "level") & indicator.isin(list(trending)), "ct").otherwise("c")


def apply_transform(long: DataFrame, registry: DataFrame, trending: Sequence[str] = (), form: str = "form",
                    keys: Sequence[str] = PAIR) -> DataFrame:
    """Transform every series by its registry entry; adds ``spec`` for the tests. Unknown names are an error.

    ``long`` must be dense; ``registry`` is one row per series and is joined on those keys that ``long`` has. Further keys, such as a variant
    of the registry, make a series of their own for each of their values.
    """
    named = long.join(registry.select(*keys, strip_suffix(form).alias("_base")), [k for k in keys if k in long.columns])

    def build(w):
        value = F.raise_error(F.concat(F.lit("unknown transform "), F.col("_base"))).cast("double")
        for name, (fn, _) in TRANSFORMS.items():
            value = F.when(F.col("_base") == name, fn("value", w)).otherwise(value)
        return {"_value": value}

    back = max(b for _, b in TRANSFORMS.values())
    out = sliding(named, keys, build, back=back)
    return out.select(*keys, F.col("_base").alias("form"), test_spec(F.col("_base"), F.col("indicator"), trending).alias("spec"),
                      "ts", F.col("_value").alias("value"))


def all_transforms(long: DataFrame, forms: Sequence[str], keys: Sequence[str] = PAIR) -> DataFrame:
    """Each series under each named transform, long, nulls dropped."""
    back = max(TRANSFORMS[f][1] for f in forms)
    wide = sliding(long, keys, lambda w: {f"_f_{f}": TRANSFORMS[f][0]("value", w) for f in forms}, back=back)
    packed = F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"_f_{f}").alias("value")) for f in forms])
    return wide.select(*keys, "ts", F.explode(packed).alias("_p")).select(
        *keys, "_p.form", "ts", "_p.value").filter(F.col("value").isNotNull())


def transform_panel(long: DataFrame, registry: DataFrame, indicators: Sequence[str], form: str = "form") -> DataFrame:
    """Wide transformed panel; leading nulls stay."""
    return assemble_wide(apply_transform(long, registry, form=form), indicators)


def joint_valid(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    return panel.filter(all_known(columns))


def rebase_index(long: DataFrame, base_date, keys: Sequence[str] = PAIR) -> DataFrame:
    """Index with 100 at ``base_date``, or at the first known value where that date is absent."""
    v = F.col("value")
    base = long.groupBy(*keys).agg(F.coalesce(
        F.max(F.when(F.col("ts") == F.lit(base_date), v)),
        F.min_by("value", F.when(v.isNotNull(), F.col("ts")))).alias("_base"))
    return long.join(base, list(keys)).select(
        *keys, "ts", "value", F.try_divide(100.0 * v, F.col("_base")).alias("index_value"))
