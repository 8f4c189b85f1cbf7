"""Conditions on whole tables that are checked while the plan runs, without an action of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def provided(df: DataFrame, what: str, checks: Sequence[tuple[Column, str | Column]] = (), by: Sequence[str] = ()) -> DataFrame:
    """The same rows, provided that there are any and that all ``checks`` (aggregate condition, message) hold; else the query fails.

    The verdict is an aggregate that adds no row and fails where a condition does not hold. It is computed from the exchange that ``by`` asks for,
    or from one that ``df`` already has: whole rows take part in it, so both branches read the same exchange and sources are scanned once.
    """
    dealt = df
    if by:
        dealt = df.select(F.struct(*df.columns).alias("_row")).repartition(*[F.col("_row")[c] for c in by])
        df = dealt.select("_row.*")
        any_row = F.max(F.xxhash64("_row"))
        checked = dealt.select("_row", "_row.*")
    else:
        any_row, checked = F.max(F.xxhash64(*df.columns)), df
    verdict = F.lit(True)
    for ok, message in reversed([(any_row.isNotNull(), f"no rows for {what}"), *checks]):
        message = F.lit(message) if isinstance(message, str) else message
        verdict = F.when(F.coalesce(ok, F.lit(False)), verdict).otherwise(F.raise_error(message).cast("boolean"))
    none = checked.agg(verdict.alias("_provided")).where(~F.col("_provided"))
    return df.union(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
