"""Tables in the shared folder, and exact ranks without a window over a whole group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import shared_folder

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders that ``saved`` has written in this process since they were last discarded.
WRITTEN: list[str] = []


def saved(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The same rows, written to the shared folder: later steps neither repeat the work nor see another row order.

    The folder's name is added to ``scope``, whose owner discards it, or else to ``WRITTEN``.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    (WRITTEN if scope is None else scope).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Sequence[str]) -> None:
    """Deletes folders that ``saved`` wrote; what reads them must have been written elsewhere."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, carry: Sequence[str], **columns: Column) -> DataFrame:
    """``df`` written once with a fixed place (``pid``, ``pos``) for every row.

    The columns to hand on travel as one struct ``row``, so no name can clash with a working column.
    """
    place = F.monotonically_increasing_id()
    return saved(df.select(
        F.struct(*[df[c] for c in carry]).alias("row"), *[c.alias(n) for n, c in columns.items()],
        F.shiftright(place, 33).alias("pid"), place.bitwiseAND((1 << 33) - 1).alias("pos")))


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """The carried columns and the added ones, which replace carried ones of the same name."""
    carried = [c for c in df.schema["row"].dataType.names if c not in added]
    return df.select(*[F.col("row")[c].alias(c) for c in carried], *added)


def range_bits(rows: int, groups: int = 1, per_range: int = 1_000_000) -> int:
    """Into how many hash ranges (as a power of two) a group is cut so that a range stays near ``per_range`` rows."""
    return max(6, math.ceil(math.log2(max(1.0, rows / max(1, groups) / per_range))))


def ranked(df: DataFrame, keys: Sequence[str], order: Column, ties: Sequence[str], name: str, bits: int = 6) -> DataFrame:
    """Adds each row's gapless rank from 0 within ``keys`` (not null) by a 64-bit hash, ties by ``ties``.

    A group is cut into ranges of the hash: ranks are counted inside ranges and shifted by the counts of the ranges before.
    No task holds a whole group, however many rows share a key.
    """
    df = df.withColumn("_h", order).withColumn("_range", F.shiftrightunsigned("_h", 64 - bits))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*keys, "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_range").orderBy("_h", *ties)
    return (df.withColumn("_n", F.row_number().over(inside))
            .join(shift.drop("count"), [*keys, "_range"])
            .withColumn(name, (F.col("_n") - 1 + F.col("_before")).cast("long"))
            .drop("_h", "_range", "_n", "_before"))
