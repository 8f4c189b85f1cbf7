"""Table shapes and ingestion rules shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_LONG = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("ts", T.DateType()),
    T.StructField("value", T.DoubleType()),
])

FORECAST = T.StructType([
    T.StructField("layer", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("h", T.LongType()),
    T.StructField("origin_date", T.DateType()),
    T.StructField("target_date", T.DateType()),
    T.StructField("y_true", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
])

#: Dimension tables are joined by broadcast only up to this many bytes of literal rows.
DIMENSION_ROW_LIMIT = 10_000


class MissingColumns(ValueError):
    """Raised before planning when an input lacks columns an operator needs."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; present {df.columns}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """First name of ``candidates`` that the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise MissingColumns(f"none of {list(candidates)}; present {df.columns}")


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN never enters the engine: float columns get NULL instead."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wanted = floats if columns is None else floats & set(columns)
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns
    ])


def literal_rows(rows: Sequence[Sequence], names: Sequence[str]):
    """An array-of-structs column from a short Python list.

    ``explode``-ing it attaches a small parameter list to every row without a join.
    """
    if len(rows) > DIMENSION_ROW_LIMIT:
        raise ValueError("parameter list too long; pass a table and join it")
    return F.array(*[
        F.struct(*[_lit(v).alias(n) for v, n in zip(row, names)]) for row in rows
    ])


def _lit(value):
    import datetime

    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("bigint")
    if isinstance(value, float):
        return F.lit(value).cast("double")
    if isinstance(value, datetime.date):
        return F.lit(value).cast("date")
    return F.lit(value)


def attach(df: DataFrame, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """Every input row once per entry of a short parameter list (fan-out by a fixed factor)."""
    return df.withColumn("_p", F.explode(literal_rows(rows, names))).select(
        *df.columns, *[F.col(f"_p.{n}").alias(n) for n in names])


def lookup(df: DataFrame, rows: Sequence[Sequence], names: Sequence[str], on: Sequence[str],
           how: str = "left") -> DataFrame:
    """Join a dimension given as a short Python list; its size is proven by ``literal_rows``."""
    spark = df.sparkSession
    dim = spark.range(1).select(F.explode(literal_rows(rows, names)).alias("_p")).select("_p.*")
    return df.join(F.broadcast(dim), list(on), how)
