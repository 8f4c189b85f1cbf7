"""Panels derived from order, line-item and event tables, and the stand-in dates used with them.

Fact rows are aggregated with map-side partial sums before any shuffle, so a hot entity costs no more than a cold
one; what is left is one row per (entity, period).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.numbers import fixed

INDICATORS = ("REVENUE", "ORDERS", "URGENT", "BALANCE", "AVGVAL")
TARGET = "REVENUE"
BREAKS = (("B1", dt.date(1997, 7, 1)), ("B2", dt.date(1998, 9, 1)), ("B3", dt.date(2000, 3, 1)))
PERIODS = (("P1", dt.date(1997, 7, 1), dt.date(1998, 6, 1)), ("P2", dt.date(2000, 3, 1), dt.date(2000, 9, 1)))
TRAIN_END = dt.date(1999, 12, 1)
TEST_START = dt.date(2000, 1, 1)
FIRST_ORIGIN = dt.date(1997, 1, 1)
HORIZONS = (1, 3, 6, 12)
TODAY = dt.date(2001, 12, 1)
EXCLUDED = (dt.date(2000, 3, 1), dt.date(2000, 4, 1))
ENTITIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


class Tables:
    """The given tables of one directory, read lazily."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        setattr(self, name, df)
        return df


def money(c: str | Column) -> Column:
    """Exact sum of a money column: order of summation cannot change it."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def order_panel(t: Tables, level: str = "region") -> DataFrame:
    """(entity, month) panel of orders; ``level`` is 'region' or 'nation'.

    Orders are first summed by customer and month, so that all joins to dimensions run on aggregated rows.
    """
    by_customer = t.orders.select(
        "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("ts"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("urgent")).groupBy("o_custkey", "ts").agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).alias("n"), F.sum("urgent").alias("urgent"))
    joined = by_customer.join(t.customer.select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("bal")),
                              F.col("o_custkey") == F.col("c_custkey"))
    by_nation = joined.groupBy("c_nationkey", "ts").agg(F.sum("price").alias("price"), F.sum("n").alias("n"), F.sum("urgent").alias("urgent"),
                                                        F.sum(F.col("bal") * F.col("n").cast("decimal(18,0)")).alias("bal"))
    named = by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    if level == "region":
        named = named.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = "r_name" if level == "region" else "n_name"
    return named.groupBy(F.col(name).alias("entity"), "ts").agg(
        fixed(F.sum("price").cast("double") / 1e6, 4).alias("REVENUE"),
        F.sum("n").cast("double").alias("ORDERS"),
        fixed(100.0 * F.sum("urgent") / F.sum("n"), 4).alias("URGENT"),
        fixed(F.sum("bal").cast("double") / F.sum("n") / 1e3, 4).alias("BALANCE"),
        fixed(F.sum("price").cast("double") / F.sum("n") / 1e4, 4).alias("AVGVAL"))


def region_panel(t: Tables) -> DataFrame:
    return order_panel(t, "region")


def nation_panel(t: Tables) -> DataFrame:
    return order_panel(t, "nation")


def event_panel(t: Tables) -> DataFrame:
    """(event type, hour) panel: number of events and mean value; hours without events are absent."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    return t.events.select(F.col("event_type").alias("entity"), hour, "value").groupBy("entity", "ts").agg(
        F.count(F.lit(1)).cast("double").alias("EVENTS"),
        fixed(money("value") / F.count(F.lit(1)), 4).alias("AVGVALUE"))


def ship_panel(t: Tables) -> DataFrame:
    """(supplier nation, ship month) panel of line items."""
    items = t.lineitem.select(
        "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("ts"),
        F.col("l_quantity").cast("decimal(18,2)").alias("q"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("p"),
        F.col("l_discount").cast("decimal(18,2)").alias("d"))
    part = items.groupBy("l_suppkey", "ts").agg(F.sum("q").alias("q"), F.sum("p").alias("p"),
                                                F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"))
    named = part.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")) \
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.col("n_name").alias("entity"), "ts").agg(
        F.sum("q").cast("double").alias("QUANTITY"),
        fixed(F.sum("p").cast("double") / 1e6, 4).alias("PRICE"),
        fixed(100.0 * F.sum("d").cast("double") / F.sum("n"), 4).alias("DISCOUNT"))

