"""Refits at many dates from sums over history, block by block.

The unit of work is (key, block of ``span`` periods). Rows are shuffled once, by key and block. Three steps use that shuffle: every block's
products are summed, blocks before are added up per key (one row per block, whatever the number of rows or dates), and each block adds up
its own rows and solves all its dates as one stack of matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Periods of one block.
SPAN = 64

#: Values of rows (n x columns, NaN where unknown) to two matrices whose product is summed over rows.
Factors = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def moments(at: Sequence[int]) -> Factors:
    """Products of [1, columns ``at``] over the rows that know all of them."""
    at = list(at)

    def factors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = x[:, at]
        known = ~np.isnan(own).any(axis=1)
        own = np.concatenate([known[:, None].astype(float), np.where(known[:, None], own, 0.0)], axis=1)
        return own, own

    return factors


def _stack(values: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, width))


def _added(factors: Sequence[Factors], x: np.ndarray) -> list[np.ndarray]:
    return [a.T @ b for a, b in (f(x) for f in factors)]


def _blocks(tag: str, span: int) -> Column:
    return F.floor(F.col(tag) / F.lit(span)).cast("bigint")


def expanding(df: DataFrame, keys: Sequence[str], columns: Sequence[str], factors: Sequence[Factors], tag: str, at: DataFrame,
              fields: Sequence[T.StructField], solve: Callable[[list[np.ndarray], list[np.ndarray], pd.DataFrame], pd.DataFrame],
              span: int = SPAN) -> DataFrame:
    """(keys, fields): what ``solve`` makes of the rows of ``at`` (keys, tag and more) and the sums over all rows of ``df`` whose tag is not larger.

    Tags are whole numbers. ``solve(sums, totals, targets)`` gets the targets of one block in the order of their tags, for each of ``factors`` a
    stack of sums, one matrix per target, and the sum over all rows of the key. A target before all rows gets zeros.
    """
    keys, columns, factors = list(keys), list(columns), list(factors)
    key_fields = [df.schema[k] for k in keys]
    sums_schema = T.StructType([*key_fields, T.StructField("_blk", T.LongType()), T.StructField("_s", T.BinaryType())])
    # names of their own, as rows and targets may come from one table
    rows = df.select(*[F.col(k).alias(k) for k in keys], _blocks(tag, span).alias("_blk"), F.col(tag).cast("bigint").alias("_tag"),
                     F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    carried = [c for c in at.columns if c not in (*keys, tag)]
    asked = at.select(*keys, _blocks(tag, span).alias("_blk"), F.col(tag).cast("bigint").alias("_tag"), *carried)
    shapes = [(a.shape[1], b.shape[1]) for a, b in (f(np.zeros((0, len(columns)))) for f in factors)]
    size = sum(a * b for a, b in shapes)

    def pack(parts: list[np.ndarray]) -> bytes:
        return np.concatenate([p.ravel() for p in parts]).tobytes()

    def unpack(flat: np.ndarray) -> list[np.ndarray]:
        out, start = [], 0
        for a, b in shapes:
            out.append(flat[start:start + a * b].reshape(a, b))
            start += a * b
        return out

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1][[*keys, "_blk"]].copy()
        out["_s"] = [pack(_added(factors, _stack(group["_x"], len(columns))))]
        return out

    def before(parts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """The sums before each wanted block, and over all blocks."""
        parts = parts.sort_values("_blk")
        sums = np.stack([np.frombuffer(s) for s in parts["_s"]]) if len(parts) else np.zeros((0, size))
        upto = np.concatenate([np.zeros((1, size)), np.cumsum(sums, axis=0)])
        at = np.searchsorted(parts["_blk"].to_numpy(), wanted["_blk"].to_numpy())
        out = wanted[[*keys, "_blk"]].copy()
        out["_s"] = [upto[i].tobytes() + upto[-1].tobytes() for i in at]
        return out

    def block(own: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        known = targets["_s"].notna()
        targets, sums = targets[~known].sort_values("_tag", kind="stable"), targets.loc[known, "_s"]
        names = [*keys, *[f.name for f in fields]]
        if not len(targets):
            return pd.DataFrame(columns=names)
        start = np.frombuffer(sums.iloc[0]) if len(sums) else np.zeros(2 * size)
        own = own.sort_values("_tag", kind="stable")
        dates, which = np.unique(targets["_tag"].to_numpy(), return_inverse=True)
        edges = np.searchsorted(own["_tag"].to_numpy(), dates, "right")
        x = _stack(own["_x"], len(columns))
        stacks = []
        for f, begin in zip(factors, unpack(start[:size])):
            a, b = f(x)
            steps = [a[i:j].T @ b[i:j] for i, j in zip([0, *edges[:-1]], edges)]
            stacks.append((begin + np.cumsum(steps, axis=0))[which])
        out = solve(stacks, unpack(start[size:]), targets.drop(columns=["_blk", "_tag", "_s"]).reset_index(drop=True))
        for k in keys:
            out[k] = targets[k].iloc[0]
        return out[names]

    by = [*keys, "_blk"]
    parts = rows.groupBy(*by).applyInPandas(total, sums_schema)
    wanted = asked.select(*by).distinct()
    sums = parts.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(before, sums_schema)
    both = asked.withColumn("_s", F.lit(None).cast("binary")).unionByName(sums, allowMissingColumns=True)
    return rows.groupBy(*by).cogroup(both.groupBy(*by)).applyInPandas(block, T.StructType([*key_fields, *fields]))
