"""Substring dedup with an FM-index per shard.

A word is removed if it lies in a window of 13 words that also starts in a document with a smaller id. Shards go by content: the
smallest 5-word hash inside a window is its anchor, so equal windows have equal anchors, and runs of windows with one anchor form a
segment that goes to the anchor's shard. Anchors of one document only are dropped before. In a shard the distinct segments
are indexed, and streamed through the index by backward search: where the matching statistic reaches a window's length,
the range of the suffixes names all segments that hold the window, and the smallest document among them decides.

Anchors with very many distinct segments (a common phrase in ever new surroundings) are cut into single windows, each its
own anchor, so no shard has to hold all of them.
"""

from __future__ import annotations


import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.fmindex import FMIndex, smallest
from panelspark.llm.retrieval import BROADCAST, flat, offered, present
from panelspark.llm.tables import saved
from panelspark.llm.words import shingles, slices, utf8, words

WINDOW, GRAM = 13, 5
#: Words that one index holds, about.
SHARD = 500_000
#: Ids of cut documents that are sent to all tasks; for more, all texts are joined by a shuffle.
TOUCHED = 1_000_000
#: Distinct segments of one anchor that stay together.
HOT = 20_000


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Smallest hash of a run of ``gram`` words inside the window that starts at each word."""
    g = shingles(hashes, gram)
    width = window - gram + 1
    if len(g) < width:
        return np.zeros(0, np.uint64)
    best, have = g, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def _anchors(batch: pa.RecordBatch, window: int, gram: int):
    """(first row, bytes, words, text of each window, word each window starts at, its anchor) of runs of texts."""
    for first, _, data, bounds in slices(batch.column(1)):
        w = words(data, bounds)
        a = anchors(w.hashes, window, gram)
        owner = np.repeat(np.arange(len(w)), w.counts())
        at = np.flatnonzero(owner[:len(a)] == owner[window - 1:window - 1 + len(a)])
        yield first, data, w, owner[at], at, a[at]


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD,
            hot: int = HOT, broadcast: int = BROADCAST) -> DataFrame:
    """(id, starts): word numbers at which removed windows start, for keys that have any."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, owner, _, a in _anchors(batch, window, gram):
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + owner[new])), flat([a[new]])], ["id", "token"])

    def tokens() -> DataFrame:
        return source.mapInArrow(emit, f"id {kind}, token long")

    shared = saved(tokens().groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("token"))
    rows, known = offered(source, tokens, shared, broadcast)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, w, owner, at, a in _anchors(batch, window, gram):
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(a)))
                if batch.column(2).null_count == batch.num_rows:  # one list for all rows
                    keep = present(a[begin], known(None))
                else:
                    own = {i: known(batch.column(2)[first + i]) for i in np.unique(owner).tolist()}
                    keep = np.array([bool(present(a[b:b + 1], own[o])[0]) for b, o in zip(begin.tolist(), owner[begin].tolist())], bool)
                begin, size = begin[keep], size[keep]
                raw = data.tobytes()
                spots = at[begin]
                bodies = [b" ".join(raw[i:j].split()) for i, j in zip(w.starts[spots].tolist(), w.ends[spots + size + window - 2].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + owner[begin])), flat([a[begin]]), pa.array(spots - w.at[owner[begin]]),
                     pa.array(size.astype(np.int64)), pa.array(bodies, pa.binary())], ["id", "anchor", "start", "size", "body"])

    cuts = rows.select("id", "text", "own").mapInArrow(cut, f"id {kind}, anchor long, start long, size long, body binary")
    cuts = cuts.withColumn("seg", F.xxhash64("body"))
    where = saved(cuts.select("id", "anchor", "seg", "start"))
    distinct = saved(cuts.groupBy("anchor", "seg").agg(F.first("body").alias("body"), F.first("size").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")))

    words_held = distinct.agg(F.sum(F.col("size") + window - 1)).first()[0] or 0
    crowded = saved(distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    calm = distinct.join(crowded, "anchor", "left_anti")
    found = _search(calm, kind, window, words_held, shard).select("anchor", "seg", "lows")
    if crowded.take(1):
        parts = F.split(F.col("body").cast("string"), " ")
        single = (distinct.join(crowded, "anchor").select("anchor", "seg", "low", "high", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.col("size").cast("int")), lambda i: F.array_join(F.slice(parts, i, window), " "))).alias("at", "body"))
            .withColumn("body", F.col("body").cast("binary")).withColumn("own", F.xxhash64("body")))
        once = single.groupBy("own").agg(F.first("body").alias("body"), F.min("low").alias("low"), F.max("high").alias("high"))
        low = _search(once.select(F.col("own").alias("anchor"), F.col("own").alias("seg"), "body", F.lit(1).cast("long").alias("size"), "low", "high"), kind, window, words_held * window, shard)
        least = F.coalesce("least", "high")  # left out: nothing to lose
        back = single.join(low.select(F.col("seg").alias("own"), F.col("lows")[0].alias("least")), "own", "left").groupBy("anchor", "seg").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", least.alias("least")))), lambda x: x["least"]).alias("lows"))
        found = found.union(back)
    hits = F.filter(F.transform("lows", lambda x, i: F.when(x < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull())
    return (where.join(found, ["anchor", "seg"]).select("id", hits.alias("starts")).where(F.size("starts") > 0)
            .groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))


def _search(segments: DataFrame, kind: str, window: int, total: int, shard: int) -> DataFrame:
    """(anchor, seg, ``lows``): for each window of a segment the smallest document that holds it. Segments that no document can
    lose a word to are left out."""
    shards = max(1, math.ceil(total / shard))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        data, bounds = utf8(pa.array(group["body"], pa.binary()))
        w = words(data[bounds[0]:], bounds - bounds[0])
        # word numbers from 1, a 0 behind each segment
        text = np.zeros(len(w.hashes) + len(w), np.int64)
        spot = np.arange(len(w.hashes)) + np.repeat(np.arange(len(w)), w.counts())
        text[spot] = np.unique(w.hashes, return_inverse=True)[1] + 1
        owner = np.zeros(len(text), np.int64)
        owner[spot] = np.repeat(np.arange(len(w)), w.counts())
        index = FMIndex(text, window + 1)
        low_of = group["low"].to_numpy()
        ranked = low_of[owner[index.order]]
        size = group["size"].to_numpy()
        starts = (w.at[:-1] + np.arange(len(w)))
        ends = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + window
        least = np.zeros(len(ends), low_of.dtype)
        low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for i in range(0, len(ends), 1 << 17):
            length, low[i:i + (1 << 17)], high[i:i + (1 << 17)] = index.statistics(text, ends[i:i + (1 << 17)], window)
            assert (length == window).all()  # a segment's own windows are in the index
        least = smallest(ranked, low, high) if len(ends) else least
        lows = np.split(least, np.cumsum(size)[:-1])
        useful = np.minimum.reduceat(least, np.cumsum(size) - size) < group["high"].to_numpy()
        out = pd.DataFrame({"anchor": group["anchor"], "seg": group["seg"], "lows": lows})
        return out[useful]

    segments = segments.select("anchor", "seg", "body", "size", "low", "high")
    return saved(segments.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards))).applyInPandas(search, f"anchor long, seg long, lows array<{kind}>"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Key, ``n_words``, ``removed`` (intervals of word numbers, ends excluded), ``n_removed``, ``kept`` (words joined by blanks) per row.

    Windows are judged on the input. Null and blank texts have no words. Rows of one key count as one document, rows with a
    null key are neither searched nor cut. Repeats inside one document stay.
    """
    kind = docs.schema[key].dataType.simpleString()
    starts = saved(removed(docs, key, text, window, **options))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    touched = starts.select("id")
    if touched.count() <= TOUCHED:  # texts that stay whole needn't be shuffled
        touched = F.broadcast(touched)
        rows = rows.join(touched, "id", "left_anti").withColumn("starts", F.lit(None).cast("array<long>")).union(
            rows.join(touched, "id", "left_semi").join(starts, "id"))
    else:
        rows = rows.join(starts, "id", "left")
    rows = rows.select("id", "text", "starts")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                n, gone, kept = [], [], []
                for raw, s in zip(part.column(1).to_pylist(), part.column(2)):
                    w = (raw or b"").split()
                    out = np.zeros(len(w) + 1, np.int64)
                    if s.is_valid:
                        at = np.array(s.as_py(), np.int64)
                        np.add.at(out, at, 1)
                        np.add.at(out, at + window, -1)
                    mark = np.cumsum(out)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                    n.append(len(w))
                    gone.append(edge.reshape(-1, 2).tolist())
                    kept.append(b" ".join([x for x, m in zip(w, mark.tolist()) if not m]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                    ["id", "n_words", "removed", "kept"])

    done = rows.mapInArrow(apply, f"id {kind}, n_words long, removed array<array<long>>, kept binary")
    count = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return done.select(F.col("id").alias(key), "n_words", "removed", count.alias("n_removed"), F.col("kept").cast("string").alias("kept"))
