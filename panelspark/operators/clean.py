"""Calendar alignment, gap handling, unit and frequency harmonisation (one row per entity and period)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.series import SPAN, carry, period_index, sliding
from panelspark.schema import lookup

KEYS = ("entity",)


def month_start(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trunc(c.cast("date"), "MM")


def period_start(idx: Column, unit: str) -> Column:
    """Inverse of ``period_index``."""
    if unit == "month":
        return F.make_date(F.floor(idx / 12).cast("int"), (F.pmod(idx, F.lit(12)) + 1).cast("int"), F.lit(1))
    if unit == "day":
        return F.date_from_unix_date(idx.cast("int"))
    if unit == "hour":
        return F.timestamp_seconds(idx * 3600)
    raise ValueError(f"unknown unit {unit!r}")


def calendar(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", unit: str = "month") -> DataFrame:
    """Every period between the first and last row of each key.

    Generated block by block, spread over tasks, so that a very long calendar is neither one array nor one task. The
    bounds refer to the value columns (a condition that always holds), so that this branch and the one it is joined to
    need the same columns and share one scan of the facts.
    """
    values = [c for c in df.columns if c not in (*keys, ts)]
    rows = F.count_if(F.greatest(*[F.col(c).isNotNull() for c in values]) if len(values) > 1 else F.col(values[0]).isNotNull()) if values else F.count(F.lit(1))
    bounds = df.groupBy(*keys).agg(F.min(period_index(ts, unit)).alias("_lo"), F.max(period_index(ts, unit)).alias("_hi"),
                                   rows.alias("_rows")).filter(F.col("_rows") >= 0)
    first, last = F.floor(F.col("_lo") / SPAN), F.floor(F.col("_hi") / SPAN)
    blocks = bounds.withColumn("_b", F.explode(F.sequence(first, last))).repartition(*keys, "_b")
    lo = F.greatest(F.col("_lo"), F.col("_b") * SPAN)
    hi = F.least(F.col("_hi"), F.col("_b") * SPAN + SPAN - 1)
    return blocks.withColumn("_i", F.explode(F.sequence(lo, hi))).select(
        *keys, period_start(F.col("_i"), unit).alias(ts))


def densify(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", unit: str = "month") -> DataFrame:
    """Insert the missing periods with null values. Rows without key or date have no place in a calendar."""
    placed = df.filter(all_known([*keys, ts]))
    return calendar(placed, keys, ts, unit).join(placed, [*keys, ts], "left").select(*df.columns)


def _neighbours(df, value, keys, ts, unit):
    """Last known and next known value with their period numbers, on every row."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), period_index(ts, unit).alias("i")))
    out = carry(df, keys, known, "_prev", True, ts, unit)
    return carry(out, keys, known, "_next", False, ts, unit)


def null_runs(df: DataFrame, value: str, keys: Sequence[str] = KEYS, ts: str = "ts", unit: str = "month") -> DataFrame:
    """Runs of nulls: start, end, length, and whether leading, internal or trailing.

    All nulls of one run share the same last known period, which is therefore the run's identity.
    """
    around = _neighbours(df.select(*keys, ts, value), value, keys, ts, unit).filter(F.col(value).isNull())
    return around.groupBy(*keys, F.col("_prev.i").alias("_run")).agg(
        F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count(F.lit(1)).alias("length"),
        F.when(F.max("_prev.i").isNull(), "leading").when(F.max("_next.i").isNull(), "trailing")
        .otherwise("internal").alias("kind")).drop("_run")


def fill_short_gaps(df: DataFrame, value: str, max_gap: int | None, keys: Sequence[str] = KEYS, ts: str = "ts",
                    unit: str = "month", strict: bool = True, name: str | None = None) -> DataFrame:
    """Linear interpolation inside gaps of at most ``max_gap`` nulls (``None``: any length).

    ``strict=False`` reproduces the historical behaviour: nothing happens unless at least one internal gap is short
    enough, and then the first ``max_gap`` nulls of every internal gap are filled, also of longer ones.
    """
    name = name or value
    around = _neighbours(df, value, keys, ts, unit)
    i, i0, i1 = period_index(ts, unit), F.col("_prev.i"), F.col("_next.i")
    v0, v1 = F.col("_prev.v"), F.col("_next.v")
    inside = F.col(value).isNull() & i0.isNotNull() & i1.isNotNull()
    line = v0 + (v1 - v0) * (i - i0) / (i1 - i0)
    columns = [c for c in df.columns if c != name]
    if max_gap is None:
        fill = inside
    elif strict:
        fill = inside & (i1 - i0 - 1 <= max_gap)
    else:
        short = around.groupBy(*keys).agg(
            F.max(F.when(inside & (i1 - i0 - 1 <= max_gap), 1).otherwise(0)).alias("_short"))
        around = around.join(short, list(keys))
        fill = inside & (i - i0 <= max_gap) & (F.col("_short") == 1)
    return around.select(*columns, F.when(fill, line).otherwise(F.col(value)).alias(name))


def forward_fill(df: DataFrame, value: str, keys: Sequence[str] = KEYS, ts: str = "ts", unit: str = "month",
                 name: str | None = None) -> DataFrame:
    name = name or value
    out = carry(df, keys, F.col(value), "_filled", True, ts, unit)
    return out.select(*[c for c in df.columns if c != name], F.col("_filled").alias(name))


def yoy(value: str, window, periods: int = 12) -> Column:
    return 100.0 * (F.try_divide(F.col(value), F.lag(value, periods).over(window)) - 1.0)


def compounded(value: str, window, periods: int = 12) -> Column:
    """Growth over ``periods`` steps from one-step growth in percent; null unless all steps are known."""
    frame = window.rowsBetween(-(periods - 1), 0)
    step = F.ln(F.when(F.col(value) > -100.0, 1.0 + F.col(value) / 100.0))
    return F.when(F.count(step).over(frame) == periods, 100.0 * (F.exp(F.sum(step).over(frame)) - 1.0))


def level_to_yoy(df: DataFrame, value: str, name: str, keys: Sequence[str] = KEYS, periods: int = 12) -> DataFrame:
    return sliding(df, keys, lambda w: {name: yoy(value, w, periods)}, back=periods)


def growth_to_yoy(df: DataFrame, value: str, name: str, keys: Sequence[str] = KEYS, periods: int = 12) -> DataFrame:
    return sliding(df, keys, lambda w: {name: compounded(value, w, periods)}, back=periods)


def harmonise_units(df: DataFrame, units: Mapping[str, str], value: str = "value", key: str = "entity",
                    keys: Sequence[str] = KEYS, name: str = "yoy") -> DataFrame:
    """Year-on-year growth whatever unit the entity publishes ('level' or 'mom_pct'); other units are an error."""
    tagged = lookup(df, list(units.items()), [key, "_unit"], [key])
    tagged = tagged.withColumn("_unit", F.coalesce("_unit", F.lit("missing")))
    return sliding(tagged, keys, lambda w: {name: F.when(F.col("_unit") == "level", yoy(value, w))
                   .when(F.col("_unit") == "mom_pct", compounded(value, w))
                   .otherwise(F.raise_error(F.concat(F.lit("unknown unit "), "_unit")).cast("double"))},
                   back=12).drop("_unit")


def quarterly_to_monthly_yoy(df: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quarterly levels onto the month grid by interpolation, then year-on-year growth."""
    monthly = fill_short_gaps(densify(df, keys), value, None, keys)
    return level_to_yoy(monthly, value, f"{value}_yoy", keys)


def assemble_wide(long: DataFrame, indicators: Sequence[str], keys: Sequence[str] = ("entity", "ts")) -> DataFrame:
    """One column per indicator, dates aligned by outer join semantics."""
    return long.groupBy(*keys).pivot("indicator", list(indicators)).agg(F.first("value", ignorenulls=True))


def all_known(columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def trim_effective_window(df: DataFrame, columns: Sequence[str], start, open_ended: Sequence[str] = (),
                          key: str = "entity", ts: str = "ts") -> DataFrame:
    """From ``start`` to the last fully known row of the entity; entities in ``open_ended`` keep their tail.

    An entity without any fully known row is an error.
    """
    late = df.filter(F.col(ts) >= F.lit(start))
    last = late.groupBy(key).agg(F.max(F.when(all_known(columns), F.col(ts))).alias("_last"))
    keep_tail = F.col(key).isin(list(open_ended)) if open_ended else F.lit(False)
    last = last.withColumn("_last", F.when(F.col("_last").isNull() & ~keep_tail, F.raise_error(
        F.concat(F.lit("no complete row for "), F.col(key))).cast("date")).otherwise(F.col("_last")))
    return late.join(last, key).filter(keep_tail | (F.col(ts) <= F.col("_last"))).select(*df.columns)


def build_panel(series: DataFrame, indicators: Sequence[str], start, units: Mapping[str, str] | None = None,
                max_gap: int = 3, open_ended: Sequence[str] = ()) -> DataFrame:
    """Raw long series to a clean panel: month starts, dense calendar, short gaps, units, wide form, trim.

    ``units`` maps indicators to 'level' or 'mom_pct' when they are to become year-on-year growth.
    """
    pair = ("entity", "indicator")
    monthly = series.withColumn("ts", month_start("ts")).groupBy(*pair, "ts").agg(
        F.avg("value").alias("value"))
    filled = fill_short_gaps(densify(monthly, pair), "value", max_gap, pair)
    if units:
        known = lookup(filled, list(units.items()), ["indicator", "_unit"], ["indicator"])
        filled = sliding(known, pair, lambda w: {"_out": F.when(F.col("_unit") == "level", yoy("value", w))
                         .when(F.col("_unit") == "mom_pct", compounded("value", w))
                         .otherwise(F.col("value"))}, back=12).select(*pair, "ts", F.col("_out").alias("value"))
    wide = assemble_wide(filled, indicators)
    return trim_effective_window(wide, indicators, start, open_ended)
