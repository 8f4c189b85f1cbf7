"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Per source, the counts alone decide how many documents of each length are taken: an even
share of every length first, then a seeded fill, and for what is left of the budget a bounded knapsack over the lengths
that still have documents. Documents are then picked by a seeded hash among those of the same length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import WORD, numbered, range_bits, ranked, saved, unpacked

#: Budget left to the knapsack, in words. It bounds the table of reachable sums, not what is taken.
KNAPSACK = 1 << 16


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, cap: float) -> dict[str | None, float]:
    """Target of each source: weights by code point order (null last) repeat; what exceeds ``cap`` times a source is shared anew."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > cap * size[s]}
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        out |= {s: float(cap * size[s]) for s in full}
        open_ -= full
        left -= sum(out[s] for s in full)
    return out


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray | None = None) -> np.ndarray:
    """How many of each size reach the largest sum up to ``budget`` (bounded subset sum; sizes over 0, tried in ``order``)."""
    items, owner = [], []
    for i in range(len(sizes)) if order is None else order.tolist():
        size = int(sizes[i])
        count, step = min(int(counts[i]), budget // size), 1
        while count > 0:  # powers of two and a rest give every number of copies
            n = min(step, count)
            items.append(n * size)
            owner.append((i, n))
            count, step = count - n, step * 2
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    last = np.full(budget + 1, -1, np.int64)
    for j, w in enumerate(items):
        if w <= budget:
            new = reached[:budget + 1 - w] & ~reached[w:]
            last[w:][new] = j
            reached[w:] |= new
            if reached[budget]:
                break
    taken = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = owner[last[at]]
        taken[i] += n
        at -= items[last[at]]
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int, window: int = KNAPSACK) -> np.ndarray:
    """Documents to take of each size so that their sizes sum up to ``budget`` or little below."""
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    if budget <= 0:
        return taken
    taken = np.where(sizes > 0, (counts * (budget / total)).astype(np.int64), 0)
    left = budget - int((taken * sizes).sum())
    rng = np.random.default_rng(seed)
    for i in rng.permutation(len(sizes)):
        if sizes[i] > 0 and left > window:
            n = min(int(counts[i] - taken[i]), (left - window) // int(sizes[i]))
            taken[i] += n
            left -= n * int(sizes[i])
    some = np.flatnonzero((sizes > 0) & (sizes <= left) & (counts > taken))
    if left > 0 and len(some):
        taken[some] += knapsack(sizes[some], (counts - taken)[some], left, rng.permutation(len(some)))
    return taken


def mix(docs: DataFrame, carry: Sequence[str], key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 10) -> DataFrame:
    """``carry`` columns of every row with ``size``, ``source_size``, ``target`` (of its source), ``copies`` and ``taken`` (words).

    A null text has size 0, null is a source of its own, repeated rows are rows of their own. A source whose target is below its
    size gives a part of its documents once; otherwise it gives all once and a part twice. One row per source passes the driver.
    Reruns agree: picks depend on key and seed, and on the place in the table only between rows of equal keys.
    """
    if cap != 2:
        raise ValueError("a document is taken twice at most")
    spark = docs.sparkSession
    name = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = numbered(docs, carry, origin=name, key=F.xxhash64(F.lit(seed), F.col(key)),
                    size=F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    lengths = saved(rows.groupBy("origin", "size").count())
    sums = [(r[0], r[1], r[2]) for r in lengths.groupBy("origin").agg(F.sum(F.col("size") * F.col("count")), F.sum("count")).collect()]
    goal = targets([(None if s == "n" else s[1:], n) for s, n, _ in sums], weights, share, cap)
    goals = [(s, n, float(goal[None if s == "n" else s[1:]])) for s, n, _ in sums]
    goals = spark.createDataFrame(goals, "origin string, source_size long, target double")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        have, want = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        base = int(want >= have)
        more = fit(group["size"].to_numpy(), group["count"].to_numpy(), int(want + 1e-6) - base * have, seed)
        return pd.DataFrame({"origin": group["origin"], "size": group["size"], "base": base, "more": more})

    plan = lengths.join(goals, "origin").groupBy("origin").applyInPandas(choose, "origin string, size long, base long, more long")
    plan = saved(plan.join(goals, "origin"))
    picked = ranked(rows.select("pid", "pos", "origin", "size", "key"), ["origin", "size"], F.col("key"), ["pid", "pos"], "_rank",
                    range_bits(sum(n for _, _, n in sums), 1))
    picked = (picked.join(plan, ["origin", "size"])
              .withColumn("copies", F.col("base") + (F.col("_rank") < F.col("more")).cast("long"))
              .withColumn("taken", F.col("copies") * F.col("size"))
              .select("pid", "pos", "size", "source_size", "target", "copies", "taken"))
    return unpacked(rows.select("pid", "pos", "row").join(picked, ["pid", "pos"]), "size", "source_size", "target", "copies", "taken")
