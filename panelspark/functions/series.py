"""Ordered computation inside an entity, safe for one very long series.

``sliding`` serves every expression that looks a bounded number of periods back or ahead, ``running`` cumulative
sums, ``carry`` the last (or next) known value. All three cut an entity's calendar into blocks of ``span`` periods
so that the unit of work is (entity, block) and never a whole entity; block borders are handled exactly, by copying
the few border rows or by adding the totals of earlier blocks. The input must be dense (one row per period, see
``clean.densify``), so that a row shift is a calendar shift.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Periods per block. 80 years of months; 40 days of hours.
SPAN = 960


def period_index(ts: str | Column, unit: str = "month") -> Column:
    """Number of the period that ``ts`` lies in, counted from a fixed point."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if unit == "month":
        return (F.year(c) * 12 + F.month(c) - 1).cast("bigint")
    if unit == "day":
        return F.unix_date(c.cast("date")).cast("bigint")
    if unit == "hour":
        return F.floor(F.unix_timestamp(c.cast("timestamp")) / 3600).cast("bigint")
    if unit == "index":
        return c.cast("bigint")
    raise ValueError(f"unknown unit {unit!r}")


def _block(idx: Column, span: int) -> Column:
    return F.floor(idx / F.lit(span)).cast("bigint")


def sliding(df: DataFrame, keys: Sequence[str], build: Callable[[WindowSpec], Mapping[str, Column]],
            back: int = 0, ahead: int = 0, ts: str = "ts", unit: str = "month", span: int = SPAN,
            keep: Sequence[str] | None = None) -> DataFrame:
    """Add the columns ``build(window)`` returns; they may look ``back`` and ``ahead`` periods, not further.

    Rows near a block border are also sent to the neighbouring block as context and dropped afterwards.
    """
    span = max(span, back, ahead, 1)
    idx = period_index(ts, unit)
    own = _block(idx, span)
    reach = [own]
    if back:
        reach.append(_block(idx + back, span))
    if ahead:
        reach.append(_block(idx - ahead, span))
    blocked = df.withColumn("_own", own).withColumn("_blk", F.explode(F.array_distinct(F.array(*reach))))
    window = Window.partitionBy(*keys, "_blk").orderBy(ts)
    added = build(window)
    columns = list(keep) if keep is not None else [c for c in df.columns if c not in added]
    out = blocked.select(*columns, *[e.alias(n) for n, e in added.items()],
                         (F.col("_own") == F.col("_blk")).alias("_mine"))
    return out.filter("_mine").drop("_mine")


def running(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], ts: str = "ts",
            unit: str = "month", span: int = SPAN) -> DataFrame:
    """Inclusive cumulative sums over the whole history, in two levels: inside a block, then over blocks."""
    blocked = df.withColumn("_blk", _block(period_index(ts, unit), span))
    for name, expr in sums.items():
        blocked = blocked.withColumn(f"_x_{name}", expr)
    inside = Window.partitionBy(*keys, "_blk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_blk").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_k_blk"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = blocked.select(
        *df.columns, "_blk", *[F.sum(f"_x_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_blk") == F.col("_k_blk")]
    on = same[0]
    for cond in same[1:]:
        on = on & cond
    return local.join(offsets, on).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def carry(df: DataFrame, keys: Sequence[str], value: Column, name: str, forward: bool = True,
          ts: str = "ts", unit: str = "month", span: int = SPAN) -> DataFrame:
    """Last non-null ``value`` at or before the row (``forward``), or the next one at or after it."""
    blocked = df.withColumn("_blk", _block(period_index(ts, unit), span)).withColumn("_v", value)
    if forward:
        inside = Window.partitionBy(*keys, "_blk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        edge, near, far = F.max_by, F.last("_v", ignorenulls=True), F.last("_e", ignorenulls=True)
    else:
        inside = Window.partitionBy(*keys, "_blk").orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
        across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
        edge, near, far = F.min_by, F.first("_v", ignorenulls=True), F.first("_e", ignorenulls=True)
    at = F.when(F.col("_v").isNotNull(), F.col(ts))
    ends = blocked.groupBy(*keys, "_blk").agg(edge("_v", at).alias("_e"))
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_k_blk"),
                       far.over(across).alias("_far"))
    local = blocked.select(*df.columns, "_blk", near.over(inside).alias("_near"))
    on = F.col("_blk") == F.col("_k_blk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(ends, on).select(*df.columns, F.coalesce("_near", "_far").alias(name))
