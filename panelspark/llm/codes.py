"""Product codes of vectors: k-means per part with adaptive distance bounds, in whole numbers throughout.

A vector is cut into equal parts; every part has a codebook, and a part's code is the index of its nearest entry. Codebooks are
fitted by rounds of assignment and averaging over all vectors. Between rounds each part keeps its ``near`` closest entries, a
lower bound on the distance of each, in order, and one outer bound for all others (Drake and Hamerly). When entries move, bounds
shrink by as much; entries whose bound stays above the exact distance to the present entry are not looked at. What bounds leave open
is decided by exact integer distances, ties by the lower index, so the result is that of a full search.

The state travels with the vector: a round reads one table in the shared folder and writes the next. How many entries are kept is
chosen anew from how deep the last round had to look. Only codebooks and one row of sums per entry reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import discard, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Closest entries that are kept at first and at least.
NEAR, FEWEST = 16, 2
#: Components stop here, so that squared distances of a part stay 64-bit numbers.
LIMIT = 1 << 28
#: Largest distance that half a float can hold; a lower bound may always be lowered.
_HALF = np.float32(65504)


def whole(column: pa.Array, scale: int = SCALE) -> list[bytes | None]:
    """floor(scale * x) of each vector as 16-bit or, if one doesn't fit, 32-bit numbers; None for nulls and non-finite components."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    fine = np.isfinite(x)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.floor(x * scale), -LIMIT, LIMIT)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    usable = (lengths > 0) & (bad[at[1:]] == bad[at[:-1]])
    small = x.copy()
    small[~fine] = 0
    out: list[bytes | None] = []
    for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), usable.tolist()):
        v = small[a:b]
        out.append(v.astype(np.int16 if np.abs(v).max() < 1 << 15 else np.int32).tobytes() if ok else None)
    return out


def numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch as rows of 64-bit numbers."""
    out = np.empty((len(column), dims), np.int64)
    for i, v in enumerate(column):
        data = v.as_buffer()
        out[i] = np.frombuffer(data, np.int16 if data.size == 2 * dims else np.int32)
    return out


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``entries`` (matching in all but the last axis)."""
    d = x - entries
    return (d * d).sum(axis=-1)


def full(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every entry."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:  # exact as floats
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T).astype(np.int64)
    return np.concatenate([_exact(x[i:i + 64, None, :], book[None]) for i in range(0, len(x), 64)])


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 1e-12) + 1e-9


def _below(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(squared.astype(np.float64)) * (1 - 1e-12) - 1e-9, 0)


def _halved(low: np.ndarray) -> np.ndarray:
    """Bounds in two bytes, never larger than they were."""
    low = np.minimum(np.maximum(low, 0), _HALF)
    h = low.astype(np.float16)
    return np.where(h.astype(np.float64) > low, np.nextafter(h, np.float16(-np.inf)), h).astype(np.float16)


def search(x: np.ndarray, book: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(closest entries in order, lower bounds with the outer one last, squared distance to the closest) by a full search."""
    d = full(x, book)
    if near + 1 < len(book) and d.max(initial=0) < 1 << 54:  # distance and index in one number
        ranks = np.partition((d << 8) | np.arange(len(book)), near, axis=1)[:, :near + 1]
        order = np.sort(ranks, axis=1) & 255
    else:
        order = np.argsort(d, axis=1, kind="stable")[:, :near + 1]
    low = _below(np.take_along_axis(d, order, 1))
    if low.shape[1] <= near:  # nothing is left outside
        low = np.concatenate([low, np.full((len(x), 1), np.inf)], axis=1)
    return order[:, :near], low, d[np.arange(len(x)), order[:, 0]]


def advance(x: np.ndarray, book: np.ndarray, drift: np.ndarray, ids: np.ndarray, low: np.ndarray, near: int):
    """The same three after entries moved by at most ``drift``, and how many entries each row had to look at (near + 1: all)."""
    ids, low = ids.copy(), low.astype(np.float64)
    low[:, :-1] -= drift[ids]
    low[:, -1] -= drift.max()
    if ids.shape[1] > near:
        low = np.concatenate([low[:, :near], low[:, near:].min(axis=1, keepdims=True)], axis=1)
        ids = ids[:, :near]
    # a bound holds for its entry and for all that follow
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    best = _exact(x, book[ids[:, 0]])
    sure = _above(best)[:, None] < low[:, 1:]
    depth = np.where(sure.any(axis=1), sure.argmax(axis=1) + 1, ids.shape[1] + 1)
    low[:, 0] = _below(best)
    some = np.flatnonzero((depth > 1) & (depth <= ids.shape[1]))
    if len(some):
        d = _exact(x[some, None, :], book[ids[some]])
        open_ = np.arange(ids.shape[1]) < depth[some, None]
        order = np.lexsort((ids[some], np.where(open_, d, np.iinfo(np.int64).max)), axis=-1)
        # what stays closed keeps its place
        order = np.where(open_, order, np.arange(ids.shape[1]))
        low[some, :-1] = np.where(open_, np.take_along_axis(_below(d), order, 1), low[some, :-1])
        ids[some] = np.take_along_axis(ids[some], order, 1)
        best[some] = np.take_along_axis(d, order, 1)[:, 0]
    every = np.flatnonzero(depth > ids.shape[1])
    if len(every):
        a, b, best[every] = search(x[every], book, ids.shape[1])
        ids[every], low[every] = a, b
    return ids, low, best, np.minimum(depth, near + 1)


def _round(rows: DataFrame, books: np.ndarray, drift: np.ndarray | None, near: int) -> DataFrame:
    """Every part assigned to its nearest entry; ``drift`` is None where no bounds are known yet."""
    parts, _, width = books.shape
    dims = parts * width
    sent = rows.sparkSession.sparkContext.broadcast((books, drift))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = sent.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = numbers(batch.column(1), dims)
            ids, low, error, depth = [], [], np.zeros(n, np.int64), np.zeros(n, np.int64)
            if drift is not None:
                old = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, parts, -1)
                was = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float16).reshape(n, parts, -1)
            for p in range(parts):
                x = v[:, p * width:(p + 1) * width]
                if drift is None:
                    i, b, d = search(x, books[p], near)
                else:
                    i, b, d, deep = advance(x, books[p], drift[p], old[:, p].astype(np.int64), was[:, p], near)
                    depth = np.maximum(depth, deep)
                ids.append(i.astype(np.uint8))
                low.append(_halved(b))
                error += d
            ids, low = np.stack(ids, axis=1), np.stack(low, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _blobs(ids), _blobs(low), _blobs(ids[:, :, 0]), pa.array(error), pa.array(depth)],
                ["row", "v", "ids", "low", "code", "error", "depth"])

    state = ["row", "v"] if drift is None else ["row", "v", "ids", "low"]
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select(*state).mapInArrow(
        assign, f"row {kind}, v binary, ids binary, low binary, code binary, error long, depth long")


def _blobs(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of an array."""
    data = np.ascontiguousarray(rows)
    width = data[0].nbytes
    bounds = np.arange(0, (len(data) + 1) * width, width, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())


def _means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Floors of the componentwise means of each entry's parts; entries without parts stay."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = numbers(batch.column(0), parts * width)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(total[p], code[:, p], v[:, p * width:(p + 1) * width])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e])] + [pa.array(total[p, e, i]) for i in range(width)],
                                         ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    names = ["n", *[f"s{i}" for i in range(width)]]
    sums = rows.select("v", "code").mapInArrow(add, "part long, entry long, " + ", ".join(f"{c} long" for c in names))
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names[1:]]
    return out


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: Sequence[str] = (), parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, near: int = NEAR) -> tuple[DataFrame, np.ndarray]:
    """(a struct ``row`` of key and carried columns, ``code`` of two hex digits a part, ``error``; codebooks [part, entry, component]).

    Codebooks start as the parts of the vectors with the smallest keys (null last, then by components). Null and empty vectors, those
    with a null or non-finite component, and those of another length than the first are left out. Repeated rows count each. Components
    are floor(1024 x), those beyond ``LIMIT`` stand at it. An empty table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.struct(F.col(key), *[F.col(c) for c in carry if c != key]).alias("row"), F.col(vector).alias("v"))
    kind = rows.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = pa.array(whole(batch.column(1)), pa.binary())
            n = pc.list_value_length(batch.column(1)).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), v, n], ["row", "v", "dims"]).filter(v.is_valid())

    made: list[str] = []
    state = saved(rows.mapInArrow(cut, f"row {kind}, v binary, dims int"), made)
    first = state.orderBy(F.col("row")[key].asc_nulls_last(), F.hex("v")).limit(entries).collect()
    if not first:
        return state.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    dims = first[0]["dims"]
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    state = state.where(F.col("dims") == dims)
    first = state.orderBy(F.col("row")[key].asc_nulls_last(), F.hex("v")).limit(entries).select("v").toArrow()["v"].combine_chunks()
    books = np.ascontiguousarray(numbers(first, dims).reshape(len(first), parts, -1).transpose(1, 0, 2))
    near, drift = min(near, books.shape[1]), None  # the first round knows no bounds
    for _ in range(rounds):
        state = saved(_round(state, books, drift, near), made)
        if drift is not None:
            near = adapted(near, {r["depth"]: r["count"] for r in state.groupBy("depth").count().collect()})
        moved = _means(state, books)
        drift, books = _above(_exact(moved, books)), moved
        discard(spark, made[:-1])
        del made[:-1]
    state = saved(_round(state, books, drift, near))
    discard(spark, made)
    return state.select("row", F.lower(F.hex("code")).alias("code"), "error"), books


def adapted(near: int, depths: dict[int, int]) -> int:
    """How many entries to keep: as many as 99 of 100 rows had to look at."""
    total, seen = sum(depths.values()), 0
    for depth in sorted(depths):
        seen += depths[depth]
        if seen * 100 >= total * 99:
            return max(min(FEWEST, near), min(near, depth))
    return near


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
