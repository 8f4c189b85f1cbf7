"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn first, exactly as a uniform permutation would deal them
(a multivariate hypergeometric draw with fixed row and column sums). Then every partition permutes its rows and cuts them by
its row of the matrix, rows are exchanged, and every shard permutes what it got.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.tables import numbered, range_bits, ranked, saved, unpacked

#: Partitions whose matrix rows are drawn together. The driver draws for blocks of partitions only.
BLOCK = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw for populations of any size: weights around the mode by the ratio of neighbouring terms.

    Terms beyond 12 standard deviations (below 1e-30 in sum) are left out.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = 12 * (draws * (good / total) * (bad / total)) ** 0.5 + 30
    low, high = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(low, high, dtype=float)
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def deal(rng: np.random.Generator, columns: Sequence[int], draws: int) -> list[int]:
    """How a uniform sample of ``draws`` rows falls on shards that still take ``columns`` rows."""
    out, left = [], sum(columns)
    for c in columns:
        out.append(hypergeometric(rng, c, left - c, draws))
        left, draws = left - c, draws - out[-1]
    return out


def matrix(rows: Sequence[int], columns: Sequence[int], seed: Sequence[int]) -> list[list[int]]:
    """Communication matrix with the given row and column sums."""
    rng, left, out = np.random.default_rng(list(seed)), list(columns), []
    for n in rows:
        out.append(deal(rng, left, n))
        left = [a - b for a, b in zip(left, out[-1])]
    return out


def shard(docs: DataFrame, carry: Sequence[str], shards: int = 40, seed: int = 20) -> DataFrame:
    """``carry`` columns of every row with ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by one row at most (law ``rows``); every assignment with these sizes is equally likely. The same table in
    the same partitions and the same seed give the same result. Nulls, repeated rows and any texts are rows like others, an
    empty table gives an empty result, carried columns named ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    rows = numbered(docs, carry)
    sizes = saved(rows.groupBy("pid").count().withColumn("block", F.col("pid").cast("long") / BLOCK).withColumn(
        "block", F.floor("block")))
    blocks = sorted((r["block"], r["n"]) for r in sizes.groupBy("block").agg(F.sum("count").alias("n")).collect())
    total = sum(n for _, n in blocks)
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = matrix([n for _, n in blocks], targets, (seed, 0))
    quota = spark.createDataFrame([(b, q) for (b, _), q in zip(blocks, dealt)], "block long, quota array<long>")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        cells = matrix(group["count"].tolist(), [int(x) for x in group["quota"].iloc[0]], (seed, 1, int(group["block"].iloc[0])))
        return pd.DataFrame({"pid": group["pid"], "ends": [np.cumsum(x).tolist() for x in cells]})

    cuts = saved(sizes.join(quota, "block").groupBy("block").applyInPandas(draw, "pid long, ends array<long>"))
    # local permutation: a partition is one scan split, so its rows are bounded
    local = Window.partitionBy("pid").orderBy(F.xxhash64(F.lit(seed), "pid", "pos"), "pos")
    placed = (rows.select("pid", "pos").withColumn("_n", F.row_number().over(local)).join(cuts, "pid")
              .select("pid", "pos", F.size(F.filter("ends", lambda e: e < F.col("_n"))).alias("shard")))
    placed = ranked(placed, ["shard"], F.xxhash64(F.lit(seed + 1), "pid", "pos"), ["pid", "pos"], "slot",
                    range_bits(total, shards))
    return unpacked(rows.join(placed, ["pid", "pos"]), "shard", "slot")
