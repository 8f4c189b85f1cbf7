"""Registry of named queries and, where SQL can express them, the equivalent SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelspark.plans import oracle
from panelspark.plans.panels import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, 64-bit integers, timestamps as text."""
    scale = 10 ** digits
    out = []
    for f in df.schema:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            e = f"cast(floor(cast({c} as double) * {scale}D + 0.5D) as double) / {scale}D + 0.0D"
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            e = f"cast({c} as bigint)"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            e = f"date_format({c}, 'yyyy-MM-dd HH:mm')"
        else:
            e = c
        out.append(f"{e} as {c}")
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(Tables(spark, sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle.with_ctes(sql)
        return fn

    return register
