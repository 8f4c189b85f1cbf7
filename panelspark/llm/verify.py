"""Exact check of candidate sets in cells. Sets travel once for every block of partners, not once for every pair."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import saved

#: Sets that sit together, bytes of sets of a seat and of a task, and pairs that are compared at once, about.
SIDE, SEAT, LOAD, PAIRS = 512, 4 << 20, 8 << 20, 1 << 15
#: Bytes of sets that are handed to Python at once, about. A group is held whole on both sides, on its way even twice.
HANDED = 1 << 20


def need(size_a, size_b, share: tuple[int, int]):
    """Smallest overlap of linked sets: overlap / (a + b - overlap) >= p / q."""
    p, q = share
    return -((-p * (size_a + size_b)) // (p + q))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common tokens of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def seated(members: DataFrame, side: int = SIDE, limit: int = SEAT) -> DataFrame:
    """(id, seat) of ``members`` (id, n, meet): sets that meet at one token sit together, ``side`` at a time.

    ``meet`` holds a few smallest hashes of a set; it sits at the one that most sets have. Where a set sits decides only what travels with it.
    """
    spread = members.select("id", "n", F.explode("meet").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("k"))
    at = spread.join(counts, "token").groupBy("id", "n").agg(F.max(F.struct("k", "token"))["token"].alias("family"))
    cuts = at.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / side), F.ceil(F.sum("n") * 8 / limit)).cast("int").alias("cuts"))
    return at.join(cuts, "family").select("id", F.xxhash64("family", F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("seat"))


class Forest:
    """Components of what is linked so far."""

    def __init__(self, labels: list):
        self.up = {x: x for x in labels}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y) -> None:
        self.up[self.root(x)] = self.root(y)


class Cells:
    """Collects (x, y, id): both rows of pairs in the cell of their seats, once each. Held as one number per entry."""

    HELD = 1 << 21

    def __init__(self, seat: np.ndarray, ids: np.ndarray):
        self.seats, self.seat = np.unique(seat, return_inverse=True)
        self.id, self.ids = pd.factorize(ids)
        self.found, self.held = [], 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.seat[p], self.seat[q]
        cell = (np.minimum(a, b) * len(self.seats) + np.maximum(a, b)) * len(self.ids)
        self.found.append(np.unique(np.concatenate([cell + self.id[p], cell + self.id[q]])))
        self.held += len(self.found[-1])
        if self.held > self.HELD:
            self.found = [np.unique(np.concatenate(self.found))]
            self.held = len(self.found[0])

    def frame(self) -> pd.DataFrame:
        if not self.found:
            return pd.DataFrame(columns=["x", "y", "id"])
        cell, row = np.divmod(np.unique(np.concatenate(self.found)), len(self.ids))
        x, y = np.divmod(cell, len(self.seats))
        return pd.DataFrame({"x": self.seats[x], "y": self.seats[y], "id": self.ids[row]})


def links_in_cells(ends: DataFrame, members: DataFrame, near: Callable, share: tuple[int, int], load: int = HANDED) -> DataFrame:
    """(a, b): links between sets of two seats, as many as join what they join.

    ``ends`` has the sets (x, y, id) of every pair of seats that have a candidate there, once each, ``members`` id, seat, cluster, n, point and
    body (a sorted set as bytes). In a cell all pairs of different clusters that ``near(points, sizes, rows, rows)`` lets pass are
    verified on whole sets, unless links found before connect them. Pairs never leave the task; only links that join components do.
    """
    kind = members.schema["id"].dataType.simpleString()
    ends = ends.select(F.xxhash64("x", "y").alias("cell"), "id")
    size = ends.join(members.select("id", "n"), "id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(size * 8 / load))
    sent = ends.join(members.select("seat", "id", "cluster", "point", "body"), "id")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, cell in group.groupby("cell", sort=False):
            cell = cell.sort_values(["cluster", "id"])
            sets = [np.frombuffer(b, np.uint64) for b in cell["body"]]
            sizes, points = np.array([len(b) for b in sets]), list(cell["point"])
            ids, cluster, seat = cell["id"].tolist(), cell["cluster"].tolist(), cell["seat"].to_numpy()
            code = pd.factorize(cell["cluster"])[0]
            forest, apart = Forest(cluster), len(set(seat.tolist())) == 2
            left = np.flatnonzero(seat == seat[0]) if apart else np.arange(len(ids))
            right = np.flatnonzero(seat != seat[0]) if apart else np.arange(len(ids))
            step = max(1, PAIRS // max(1, len(right)))
            for i in range(0, len(left), step):
                p, q = (v.ravel() for v in np.meshgrid(left[i:i + step], right, indexing="ij"))
                ok = (code[p] != code[q]) & (apart | (p < q))
                p, q = p[ok], q[ok]
                least = need(sizes[p], sizes[q], share)
                ok = least <= np.minimum(sizes[p], sizes[q])
                p, q = p[ok], q[ok]
                ok = near(points, sizes, p, q) if len(p) else np.zeros(0, bool)
                for x, y in zip(p[ok].tolist(), q[ok].tolist()):
                    if forest.root(cluster[x]) != forest.root(cluster[y]) and overlap(sets[x], sets[y]) >= need(len(sets[x]), len(sets[y]), share):
                        forest.join(cluster[x], cluster[y])
                        found.append((ids[x], ids[y]))
        return pd.DataFrame(found, columns=["a", "b"])

    return saved(sent.groupBy(F.pmod("cell", F.lit(shards))).applyInPandas(check, f"a {kind}, b {kind}"))


def made(texts: DataFrame, sets, kind: str) -> DataFrame:
    """(id, size, body) of (id, text) by ``sets`` (batch, column) -> (row, set)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bodies, held = [], [], 0

            def done():
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([ids, pa.array([len(b) // 8 for b in bodies], pa.int64()), pa.array(bodies, pa.binary())], ["id", "size", "body"])

            for i, s in sets(batch, 1):
                rows.append(i)
                bodies.append(s.tobytes())
                held += s.nbytes
                if held > LOAD:
                    yield done()
                    rows, bodies, held = [], [], 0
            yield done()

    return texts.select("id", "text").mapInArrow(build, f"id {kind}, size long, body binary")
