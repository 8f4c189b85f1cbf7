"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round each node joins its smallest neighbour and the graph shrinks to the joined nodes, so rounds grow with the
    logarithm of a path's length. Rounds are written to the shared folder; nothing but edge counts reaches the driver.
    """
    edges = saved(edges.select("a", "b").where("a <> b").distinct())
    total = None
    while edges.take(1):
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        joined = saved(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
        if total is None:
            total = joined
        else:  # nodes of this round are components of the one before
            total = saved(total.select("node", F.col("component").alias("_c")).join(
                joined.select(F.col("node").alias("_c"), F.col("component").alias("_next")), "_c", "left")
                .select("node", F.coalesce("_next", "_c").alias("component")))
        to_a, to_b = (joined.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in "ab")
        edges = saved(edges.join(to_a, "a").join(to_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total
