"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of benchmark words, written as `` w1 w2 ... w10 `` with a blank on both sides; texts are written the same
way. Shift tables over blocks of bytes say how far the search may jump; where the shift is 0, the bucket of the block's hash
holds the patterns that may end there, and bytes are compared. Many cursors move through a slice of texts at once, so a
step of the search is a numpy operation over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import WRITTEN, discard, saved

WINDOW = 10
#: Patterns in one set of tables. More patterns make more sets, each in a pass of its own, so tasks hold one set only.
PATTERNS = 50_000
#: Bytes of text searched at once, and bytes between two cursors.
CHUNK, LANE = 1 << 22, 2048

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def spell(text: str | bytes | None) -> bytes:
    """Lower-case words (letters, digits, all beyond ASCII) with single blanks between them and no others."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return b" ".join(raw.translate(_TABLE).split())


def windows(spelled: bytes, size: int = WINDOW) -> list[bytes]:
    """All runs of ``size`` words; the whole sequence if there are fewer, nothing if there are none."""
    w = spelled.split()
    return [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


@dataclass
class Tables:
    """Shift table and suffix buckets of patterns of similar length."""

    least: int
    block: int
    bits: int
    shift: np.ndarray
    buckets: dict[int, list[tuple[int, bytes]]]

    @classmethod
    def build(cls, patterns: list[tuple[int, bytes]]) -> "Tables":
        least = min(len(p) for _, p in patterns)
        block = min(6, max(2, least // 3))
        bits = min(26, max(16, int(np.ceil(np.log2(8 * len(patterns) * least)))))
        heads = np.frombuffer(b"".join(p[:least] for _, p in patterns) + bytes(8), np.uint8)
        shift = np.full(1 << bits, least - block + 1, np.int32)
        first = np.arange(len(patterns)) * least
        for end in range(block, least + 1):  # nearer ends overwrite farther ones
            shift[_hash(heads, first + end, block, bits)] = least - end
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for h, pattern in zip(_hash(heads, first + least, block, bits).tolist(), patterns):
            buckets.setdefault(h, []).append(pattern)
        return cls(least, block, bits, shift, buckets)

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Positions just behind blocks of shift 0. ``data`` has 8 spare bytes at the end."""
        size = len(data) - 8
        at = np.arange(self.least, size + 1, LANE)
        end = np.minimum(at + LANE, size + 1)
        found = []
        while len(at):
            s = self.shift[_hash(data, at, self.block, self.bits)]
            if (hit := s == 0).any():
                found.append(at[hit])
            at = at + np.maximum(s, 1)
            if not (go := at < end).all():
                at, end = at[go], end[go]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, pattern id, pattern) of every occurrence."""
        ends = self.candidates(data)
        for end, h in zip(ends.tolist(), _hash(data, ends, self.block, self.bits).tolist()):
            start = end - self.least
            for key, p in self.buckets.get(h, ()):
                if raw.startswith(p, start):
                    yield start, key, p


def _hash(data: np.ndarray, end: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Hash of the ``block`` bytes before each position."""
    view = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    value = view[end - block] & np.uint64((1 << (8 * block)) - 1)
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def build(patterns: list[tuple[int, bytes]]) -> list[Tables]:
    """Tables by class of length, so that one short pattern doesn't shorten all jumps."""
    classes: dict[int, list[tuple[int, bytes]]] = {}
    for key, p in patterns:
        p = b" " + p + b" "
        classes.setdefault(sum(len(p) >= n for n in (8, 16, 32, 48)), []).append((key, p))
    return [Tables.build(c) for c in classes.values()]


def search(texts: list[bytes], tables: list[Tables]) -> tuple[list[np.ndarray], list[list[int]]]:
    """Per spelled text: which word numbers are hit, and which patterns occur."""
    raw = b"\n".join(b" " + t + b" " for t in texts) + bytes(8)
    data = np.frombuffer(raw, np.uint8)
    first = np.cumsum([0] + [len(t) + 3 for t in texts])
    found: dict[int, list[tuple[int, int, bytes]]] = {}
    for t in tables:
        for m in t.matches(data, raw):
            found.setdefault(int(np.searchsorted(first, m[0], "right")) - 1, []).append(m)
    hits, keys = [np.zeros(0, np.int32)] * len(texts), [[] for _ in texts]
    for i, ms in found.items():
        blanks = np.flatnonzero(data[first[i]:first[i + 1] - 1] == 32)
        mark = np.zeros(len(blanks), bool)
        for word, p in zip(np.searchsorted(blanks, [m[0] - first[i] for m in ms]).tolist(), (m[2] for m in ms)):
            mark[word:word + p.count(b" ") - 1] = True
        hits[i], keys[i] = np.flatnonzero(mark).astype(np.int32), sorted({m[1] for m in ms})
    return hits, keys


def _searched(column: pa.Array, tables: list[Tables]) -> Iterator[tuple[list[bytes], list[np.ndarray], list[list[int]]]]:
    """Spelled texts of a column, about ``CHUNK`` bytes at a time, and what ``search`` finds in them."""
    waiting, size = [], 0
    for i, raw in enumerate(column):
        waiting.append(spell(raw.as_py()))
        size += len(waiting[-1])
        if size >= CHUNK or i == len(column) - 1:
            yield waiting, *search(waiting, tables)
            waiting, size = [], 0


def _uid(key: str, text: str) -> tuple:
    return F.xxhash64(F.col(key)).alias("u1"), F.xxhash64(F.lit(1), F.col(text)).alias("u2")


def _scan(docs: DataFrame, key: str, text: str, patterns: list[tuple[int, bytes]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build(shared.value)
        for batch in batches:
            counts, hits, keys = [], [], []
            for texts, h, k in _searched(batch.column(3), tables):
                counts += [t.count(b" ") + 1 if t else 0 for t in texts]
                hits += h
                keys += k
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "u1", "u2", "n_words", "hits", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), *_uid(key, text), F.col(text).cast("binary").alias("text")).mapInArrow(
        scan, f"id {kind}, u1 long, u2 long, n_words long, hits array<int>, keys array<long>")


def item_windows(items: DataFrame, item: str, text: str, size: int = WINDOW) -> DataFrame:
    """Table (key, item, pattern) of the windows of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in dict.fromkeys(windows(spell(t), size))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([p for _, p in out], pa.binary())], ["item", "pattern"])

    cut_ = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary")).mapInArrow(cut, "item string, pattern binary")
    return cut_.select(F.xxhash64("pattern").alias("key"), "item", "pattern")


def _sets(cuts: DataFrame, patterns: int) -> Iterator[list[tuple[int, bytes]]]:
    """Distinct (key, pattern) of ``cuts`` in sets of about ``patterns``; one empty set if there are none."""
    distinct = cuts.select("key", "pattern").distinct()
    sets = max(1, -(-distinct.count() // patterns))
    for s in range(sets):
        yield [(r["key"], bytes(r["pattern"])) for r in distinct.where(F.pmod("key", F.lit(sets)) == s).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", size: int = WINDOW, patterns: int = PATTERNS) -> DataFrame:
    """One row per document: key, ``n_words``, ``hits`` (numbers of hit words), ``items`` (sorted), and hashes ``u1``, ``u2`` of the row.

    Null and empty texts have no words and aren't hit. Repeated rows give repeated rows. Items without words match nothing, an
    empty benchmark hits nothing, equal windows of several items count for each of them.
    """
    cuts = saved(item_windows(benchmark, item, item_text, size))
    parts = [_scan(docs, key, text, own) for own in _sets(cuts, patterns)]
    found = parts[0]
    for more in parts[1:]:  # equal rows have equal finds
        more = more.where(F.size("keys") > 0).dropDuplicates(["u1", "u2"]).select("u1", "u2", F.col("hits").alias("h"), F.col("keys").alias("k"))
        found = found.join(more, ["u1", "u2"], "left").select(
            "id", "u1", "u2", "n_words", F.array_union("hits", F.coalesce("h", F.array().cast("array<int>"))).alias("hits"),
            F.array_union("keys", F.coalesce("k", F.array().cast("array<long>"))).alias("keys"))
    found = saved(found)
    named = (found.where(F.size("keys") > 0).select("u1", "u2", F.explode("keys").alias("key")).distinct()
             .join(cuts.select("key", "item"), "key").groupBy("u1", "u2")
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    return found.join(named, ["u1", "u2"], "left").select(
        F.col("id").alias(key), "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "u1", "u2")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", size: int = WINDOW, patterns: int = PATTERNS) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs. They stay where they are, so ``key`` may be anything; further sets search what is left."""
    spark, written = docs.sparkSession, []
    for i, own in enumerate(_sets(saved(item_windows(benchmark, item, item_text, size)), patterns)):
        if i:
            before, written = written, []
            docs = saved(docs, written)
            discard(spark, before)
        docs = docs.where(~_hit(spark.sparkContext.broadcast(own))(F.col(text).cast("binary")))
    WRITTEN.extend(written)
    return docs


def _hit(shared: Broadcast) -> Callable[[Column], Column]:
    """Whether a pattern occurs in a text; never in null."""

    @F.arrow_udf("boolean")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = build(shared.value)
        for column in batches:
            yield pa.array([bool(k) for _, _, keys in _searched(column, tables) for k in keys], pa.bool_())

    return hit
