"""Sufficient statistics: sums of products per key, from which every regression here is solved.

Rows are only ever aggregated by Spark; what reaches Python solvers is one packed matrix per key, whose size depends
on the number of columns and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.series import SPAN, running, sliding
from panelspark.functions.solve import least_squares, triangle, unpack

#: More columns than this are reduced by numpy inside the map task instead of by generated SQL sums.
NARROW = 9
#: Partial matrices a task holds before it hands them on; bounds task memory for many keys.
HELD = 512

DOUBLES = T.ArrayType(T.DoubleType())


def packed_cells(pos: str = "pos", value: str = "v") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value])


def add_arrays(column: str, size: int, when: str | None = None) -> Column:
    """Element-wise sum of short arrays as an aggregate."""
    item = f"{column}[{{0}}]" if when is None else f"if({when}, {column}[{{0}}], NULL)"
    return F.expr("array(" + ", ".join(f"coalesce(sum({item.format(p)}), 0D)" for p in range(size)) + ")")


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, g): packed sums of products of ``columns`` per key. Inputs must not be null."""
    m = len(columns)
    if m <= NARROW:
        sums = ", ".join(f"sum(`{columns[i]}` * `{columns[j]}`)" for i, j in triangle(m))
        return df.groupBy(*keys).agg(F.expr(f"array({sums})").alias("g"))
    return _gram_wide(df, keys, columns)


def _partials(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One packed partial matrix per key and task (map-side combine), so a hot key shuffles no more than a cold one."""
    keys, columns = list(keys), list(columns)
    upper = np.triu_indices(len(columns))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("g", DOUBLES)])

    def flush(held):
        rows = [(*k, m[upper].tolist()) for k, m in held.items()]
        return pd.DataFrame(rows, columns=[*keys, "g"])

    def reduce(batches):
        held: dict = {}
        for batch in batches:
            x = batch[columns].to_numpy(float)
            for key, rows in batch.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                part = x[rows].T @ x[rows]
                held[key] = held[key] + part if key in held else part
                if len(held) > HELD:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    return df.select(*keys, *columns).mapInPandas(reduce, schema)


def _gram_wide(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    cells = _partials(df, keys, columns).select(*keys, F.posexplode("g").alias("pos", "v"))
    summed = cells.groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    return summed.groupBy(*keys).agg(packed_cells().alias("g"))


def prefix_gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts", unit: str = "month",
                span: int = SPAN) -> DataFrame:
    """Every row with the packed sums of all rows up to and including it. For few columns."""
    m = len(columns)
    names = [f"_g{p}" for p in range(m * (m + 1) // 2)]
    sums = {n: F.col(columns[i]) * F.col(columns[j]) for n, (i, j) in zip(names, triangle(m))}
    out = running(df, keys, sums, ts, unit, span)
    return out.select(*df.columns, F.array(*names).alias("g"))


OLS = T.StructType([T.StructField("beta", DOUBLES), T.StructField("rss", T.DoubleType()), T.StructField("inv", DOUBLES)])


def ols(g: Column, m: int, xs: Sequence[int], y: int) -> Column:
    """Least squares of column ``y`` on columns ``xs`` of a packed Gram: struct(beta, rss, inv row by row)."""
    xs = list(xs)

    @F.pandas_udf(OLS)
    def fit(packed: pd.Series) -> pd.DataFrame:
        beta, rss, inv = least_squares(unpack(packed.tolist(), m), xs, y)
        return pd.DataFrame({"beta": list(beta), "rss": rss, "inv": [v.ravel() for v in inv]})

    return fit(g)



def hac_fit(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], lags: int = 4, ts: str = "ts",
            unit: str = "month") -> DataFrame:
    """Least squares per key with a Newey-West covariance (no small-sample factor).

    Returns (keys, n, beta, rss, cov). Pass one: Gram and coefficients. Pass two: scores z = x * residual with their
    lags, whose Gram holds every autocovariance needed. ``xs`` must hold its own constant.
    """
    k = len(xs)
    own = df.select(*keys, ts, *xs, y)
    first = gram(own.withColumn("_one", F.lit(1.0)), keys, ["_one", *xs, y]).withColumn(
        "_f", ols(F.col("g"), k + 2, range(1, k + 1), k + 1))
    fits = first.select(*keys, F.col("g")[0].cast("bigint").alias("n"), F.col("_f.beta").alias("beta"), F.col("_f.rss").alias("rss"), F.col("_f.inv").alias("_inv"))
    residual = F.col(y) - sum((F.col("beta")[i] * F.col(x) for i, x in enumerate(xs[1:], 1)), F.col("beta")[0] * F.col(xs[0]))
    scored = own.join(fits.select(*keys, "beta"), list(keys)).select(
        *keys, ts, *[(F.col(x) * residual).alias(f"_z{i}") for i, x in enumerate(xs)])
    z = [f"_z{i}" for i in range(k)]
    lagged = sliding(scored, keys, lambda w: {f"{c}_{lag}": F.lag(c, lag, 0.0).over(w)
                                              for lag in range(1, lags + 1) for c in z}, back=lags, ts=ts, unit=unit)
    columns = [*z, *[f"{c}_{lag}" for lag in range(1, lags + 1) for c in z]]
    meat = gram(lagged, keys, columns).withColumnRenamed("g", "_meat")
    size = len(columns)

    @F.pandas_udf(DOUBLES)
    def sandwich(inv: pd.Series, packed: pd.Series) -> pd.Series:
        bread = np.stack([np.asarray(v, float).reshape(k, k) for v in inv])
        full = unpack(packed.tolist(), size)
        s = full[:, :k, :k].copy()
        for lag in range(1, lags + 1):
            block = full[:, :k, lag * k:(lag + 1) * k]
            s += (1 - lag / (lags + 1)) * (block + block.transpose(0, 2, 1))
        cov = bread @ s @ bread
        return pd.Series([c.ravel() for c in cov])

    return fits.join(meat, list(keys)).select(*keys, "n", "beta", "rss", sandwich("_inv", "_meat").alias("cov"))


def per_row(df: DataFrame, keys: Sequence[str], extra: Sequence[T.StructField], fn: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """Apply a small solver to every aggregated row; it may give several output rows. No shuffle."""
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], *extra])
    names = [f.name for f in schema]
    rest = [c for c in df.columns if c not in keys]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch[[*keys, *rest]].itertuples(index=False, name=None):
                out += [(*row[:len(keys)], *values) for values in fn(*row[len(keys):])]
            yield pd.DataFrame(out, columns=names)

    return df.select(*keys, *rest).mapInPandas(run, schema)


def explode_names(df: DataFrame, names: Sequence[str], keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays by column position to rows with the column's name."""
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), *[F.col(a)[i].alias(a) for a in arrays]) for i, n in enumerate(names)])
    return df.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*")


def with_const(df: DataFrame, name: str = "const") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


__all__ = ["add_arrays", "explode_names", "gram", "hac_fit", "ols", "per_row", "prefix_gram", "with_const"]
