"""Sinks: partitioned panels, append-only logs, replacement by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_panel(panel: DataFrame, path: str, digits: int = 6) -> None:
    """One folder per entity, values rounded. Range partitioning keeps files few and splits a hot entity by time."""
    rounded = panel.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                             else F.col(f.name) for f in panel.schema])
    rounded.repartitionByRange("entity", "ts").write.mode("overwrite").partitionBy("entity").parquet(path)


def write_series_files(long: DataFrame, path: str) -> None:
    """CSV files in one folder per series."""
    long.select("entity", "indicator", "ts", "value").write.mode("overwrite").option("header", True) \
        .partitionBy("entity", "indicator").csv(path)


def append_audit_log(rows: DataFrame, path: str, logged_at) -> None:
    rows.withColumn("logged_at", F.lit(logged_at)).write.mode("append").parquet(path)


def upsert_by_key(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` without the keys that ``new`` brings, plus ``new``; missing columns become null."""
    kept = base.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*base.columns)
