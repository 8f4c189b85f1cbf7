"""Audit of how sources of one language differ in their terms.

Terms of a shard are never built as strings: pointers to their starts in the Arrow buffers are sorted (``pointers.multikey_sort``), and a
run of equal terms gives its document frequency and its count in every source at once. Only these rows of counts are shuffled.

A language keeps the terms of ``least`` documents or more. Sources are compared by blocks of terms: a block holds the counts of all
sources for some terms and adds one row of absolute differences per pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.pointers import multikey_sort
from panelspark.llm.tables import saved
from panelspark.llm.words import LOWER, slices, spans

#: Documents a term must be in, smoothing, scale of shares, and ranks of the part ``term``.
LEAST, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that one sort takes, cells (term, source) of one block and sources of one side, about.
SHARD, BLOCK, SIDE = 8 << 20, 1 << 20, 512
#: ASCII letters and everything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def runs(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of texts whose ``group`` is given: one row per term and group."""
    starts, ends = spans(LETTER[data], bounds)
    low = LOWER[data]
    order, new = multikey_sort(low, starts, ends)
    if not len(order):
        return pa.array([], pa.binary()), *[np.zeros(0, np.int64)] * 3
    owner = (np.searchsorted(bounds, starts, "right") - 1)[order]
    run = np.cumsum(new) - 1
    groups = int(group.max()) + 1
    cell = run * groups + group[owner]
    # the sort is stable, so a document's occurrences stand together in a run
    once = np.ones(len(order), bool)
    once[1:] = new[1:] | (owner[1:] != owner[:-1])
    cells, at, count = np.unique(cell, return_inverse=True, return_counts=True)
    docs = np.bincount(at[once], minlength=len(cells))
    first = order[np.flatnonzero(new)][cells // groups]
    a, size = starts[first], (ends - starts)[first]
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(a - edge[:-1], size) + np.arange(edge[-1])
    terms = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(low[place])])
    return terms.cast(pa.binary()), cells % groups, count, docs


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group; nulls count as ''."""
    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"),
                       F.col(text).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            l, s = (batch.column(i).dictionary_encode() for i in (0, 1))
            code = l.indices.to_numpy().astype(np.int64) * len(s.dictionary) + s.indices.to_numpy()
            known, group = np.unique(code, return_inverse=True)
            for first, end, data, bounds in slices(batch.column(2), SHARD):
                terms, g, n, k = runs(data, bounds, group[first:end])
                at = known[g]
                for i in range(0, len(g), 50_000):
                    own = at[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [l.dictionary.take(pa.array(own // len(s.dictionary))), s.dictionary.take(pa.array(own % len(s.dictionary))),
                         terms.slice(i, 50_000), pa.array(n[i:i + 50_000]), pa.array(k[i:i + 50_000])], ["lang", "source", "term", "n", "docs"])

    found = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact beyond 64 bits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * ({n} + {SMOOTH})) div ({total} + {SMOOTH} * {terms})")


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same as ``share`` in long division by thousands: no product leaves 64 bits."""
    below = total + SMOOTH * terms
    rest, out = n + SMOOTH, np.zeros(np.broadcast(n, total).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP,
          block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source.

    ``pair``: every other source of the language by the sum of absolute differences of all kept terms' shares. ``term``: the ``top`` kept
    terms of the group whose share exceeds the language's most. Null text, lang and source count as ''; groups without terms have
    zero counts; a repeated row is a document of its own; ties rank by item; an empty table gives no rows.
    """
    table = saved(counts(docs, text, lang, source))
    kept = saved(table.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
                 .select("lang", "term", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    cells = saved(table.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    groups = saved(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]))

    found = (cells.join(groups, ["lang", "source"])
             .select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
             .where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    apart = pairs(cells, groups, block, side).withColumn("rank", F.row_number().over(best))
    return (apart.withColumn("part", F.lit("pair")).unionByName(found.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", "rank"))


def pairs(cells: DataFrame, groups: DataFrame, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """(lang, source, item, value): both directions of every pair of sources of a language.

    Sources are dealt to sides of about ``side``, and two sides at a time meet; terms are dealt to so many blocks that one has about
    ``block`` cells. So no task grows with the number of sources or terms.
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("k"), F.max("terms").alias("v"))
    sizes = sizes.select("lang", F.ceil(F.col("k") / side).cast("int").alias("sides"),
                         F.greatest(F.lit(1), F.ceil(F.col("v") * F.least("k", F.lit(2 * side)) / block)).cast("int").alias("cuts"))

    def met(rows: DataFrame) -> DataFrame:
        """Each row once for every side that its own meets, itself included."""
        rows = rows.join(sizes, "lang").withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        return rows.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))

    left = met(cells).select("lang", F.pmod(F.xxhash64("term"), F.col("cuts")).cast("int").alias("cut"), "x", "y", "source", "term", "n")
    right = met(groups).select("lang", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "x", "y", "source", "side", "total", "terms")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        names = b["source"].combine_chunks()
        order = names.cast(pa.binary()).to_pylist()
        rank = sorted(range(len(order)), key=order.__getitem__)
        names, total, own = names.take(pa.array(rank, pa.int64())), b["total"].to_numpy()[rank], b["side"].to_numpy()[rank]
        x, y = np.triu_indices(len(names), 1)
        if b["x"][0] != b["y"][0]:
            x, y = x[own[x] != own[y]], y[own[x] != own[y]]
        value, seen, all_ = np.zeros(len(x), np.int64), 0, int(b["terms"][0].as_py())
        none = shares(np.zeros(len(names), np.int64), np.maximum(total, 0 if all_ else 1), all_)
        if len(a):
            terms, of = (a[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
            at = {name: i for i, name in enumerate(names.to_pylist())}
            row = np.array([at[name] for name in of.dictionary.to_pylist()])[of.indices.to_numpy()]
            n = np.zeros((len(names), len(terms.dictionary)), np.int64)
            n[row, terms.indices.to_numpy()] = a["n"].to_numpy()
            seen, p = n.shape[1], shares(n, total[:, None], all_)
            edges = np.searchsorted(x, np.arange(len(names) + 1))
            for i in range(len(names)):
                value[edges[i]:edges[i + 1]] = np.abs(p[y[edges[i]:edges[i + 1]]] - p[i]).sum(axis=1)
        return pa.table([pa.repeat(b["lang"][0], len(x)), names.take(pa.array(x)), names.take(pa.array(y)), pa.array(value),
                         pa.array(np.full(len(x), all_)), pa.array(np.full(len(x), seen)), pa.array(np.abs(none[x] - none[y]))],
                        ["lang", "source", "item", "value", "terms", "seen", "apart"])

    keys = ["lang", "cut", "x", "y"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "lang string, source string, item string, value long, terms long, seen long, apart long")
    # terms that neither side of a pair has differ as well, if totals do
    value = F.sum("value") + (F.max("terms") - F.sum("seen")) * F.max("apart")
    once = saved(found.groupBy("lang", "source", "item").agg(value.alias("value")))
    return once.union(once.select("lang", "item", "source", "value"))
