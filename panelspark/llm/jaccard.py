"""Exact Jaccard join of shingle sets with count-vector R-trees.

Tokens (shingle hashes) fall into groups by hash; the counts of a set per group are a point. The sum of coordinate minima of two
points bounds the overlap of their sets, and that of a point and the maxima of an R-tree node bounds the overlap with all sets
below it. Pairs that survive the bound are verified on the sets.

No tree holds all sets: two sets with similarity t or more share a token among the first (1 - t) n + 1 of each in any one order, so
trees are built per such token. The order is by rarity: a table of counts over hashed tokens, of fixed size, gives every token a class,
and tokens are numbered by class first. What many sets share comes last and rarely lands in a prefix. Steps:

1. Equal sets become one class. Prefix tokens of one class only can't link anything and are dropped.
2. Near copies are joined first: classes meet at their two smallest hashes, in blocks; a tree of leaders finds those worth verifying.
   Every class that matches is linked to the leader; others become leaders.
3. All other links run between clusters. Tokens that are still shared by several clusters get trees over all their classes. A pair
   of different clusters that survives the bounds is not reported itself: sets sit together in blocks, and the pair of seats is. Each pair of
   seats is one cell, where points bound and sets are verified, until what can be joined is. This step loses no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.graph import components
from panelspark.llm.retrieval import BROADCAST, flat, offered, present
from panelspark.llm.tables import discard, saved
from panelspark.llm.verify import Cells, links_in_cells, made, need, overlap, seated
from panelspark.llm.words import mix, shingles, slices, words

#: Coordinates of a point. Fixed: more of them bound closer and cost more.
GROUPS = 64
#: Share of the prefix that must be shared for a set to be kept at hand; others are made again from the text if a pair needs them.
DENSE = 0.05
#: Counters of the table of token counts and counters of one row of it.
TABLE, STRIPE = 1 << 21, 1 << 15
#: Smallest hashes of a set, at which it may meet others; near copies are looked for at the first ``NEAR`` of them.
MEET, NEAR = 4, 2
#: Sets that one tree holds, about. Tokens with more are cut into blocks.
BLOCK = 2000
#: Bytes of sets that meet in one block, about.
BYTES = 32 << 20
#: Sizes of linked sets are at most one band apart (4/3 and a little).
BAND = 1.334
#: Up to so many ids go to all tasks, so that rows with their sets are picked where they are; more are joined by a shuffle.
SENT = 2_000_000
#: A coordinate that is this large stands for any count from there on.
_TOP = np.iinfo(np.uint16).max


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; the whole sequence if there are fewer words; empty without words."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(shingles(hashes, min(k, len(hashes))))


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Classes of rarity by counts, 0 to 63, two for every doubling."""
    return np.minimum(63, 2 * np.log2(1.0 + counts)).astype(np.uint8)


def by_rarity(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The same set as sorted numbers: class, then hash."""
    kind = classes[(tokens % np.uint64(len(classes))).astype(np.int64)].astype(np.uint64)
    return np.sort((kind << np.uint64(58)) | (tokens >> np.uint64(6)))


def prefix(size: int, share: tuple[int, int]) -> int:
    """So many of the smallest tokens hold one of any set that is similar enough."""
    p, q = share
    return size - -((-p * size) // q) + 1 if size else 0


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts per token group, up to 16 bits; see ``bound`` for larger ones."""
    c = np.bincount((tokens % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return np.minimum(c, _TOP).astype(np.uint16)


def bound(a: np.ndarray, b: np.ndarray, full: bool) -> np.ndarray:
    """Largest overlap that points allow: any, where both have a coordinate at the limit (``full`` unless there are none)."""
    least = np.minimum(a, b)
    most = least.sum(axis=-1, dtype=np.int64)
    return np.where((least == _TOP).any(axis=-1), np.iinfo(np.int64).max, most) if full else most


def print_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(mix(tokens ^ np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (0x51ED27, 0xA0761D64))


class CountTree:
    """R-tree over points, packed by size and then by the coordinates that differ most.

    ``few`` and ``rest`` bound an overlap as well: by the smaller ``few`` of two sets plus the larger ``rest``; at the leaves, plus the
    ``rest`` of the set with the smaller ``end``.
    """

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, few: np.ndarray, rest: np.ndarray, end: np.ndarray):
        spread = np.argsort(-points.astype(float).var(axis=0), kind="stable")[:3] if len(points) else []
        self.order = np.lexsort((*[points[:, d] for d in spread], (np.log(np.maximum(sizes, 1)) * 12).astype(int)))
        self.end = end[self.order]
        self.full = bool((points == _TOP).any())
        self.levels = [(points[self.order], sizes[self.order], few[self.order], rest[self.order])]
        while len(self.levels[-1][1]) > self.FAN:
            p, s, f, r = self.levels[-1]
            at = np.arange(0, len(s), self.FAN)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(s, at), np.maximum.reduceat(f, at), np.maximum.reduceat(r, at)))

    def pairs(self, points, sizes, few, rest, end, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, point of the tree) wherever the bounds allow a link."""
        top = len(self.levels[-1][1])
        q, node = np.repeat(np.arange(len(sizes)), top), np.tile(np.arange(top), len(sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s, f, r = self.levels[depth]
            keep = np.zeros(len(q), bool)
            for i in range(0, len(q), 1 << 15):
                a, b = q[i:i + (1 << 15)], node[i:i + (1 << 15)]
                least = need(sizes[a], s[b], share)
                beyond = np.maximum(rest[a], r[b]) if depth else np.where(end[a] <= self.end[b], rest[a], r[b])
                ok = np.minimum(few[a], f[b]) + beyond >= least
                ok[ok] = bound(points[a[ok]], p[b[ok]], self.full) >= least[ok]
                keep[i:i + (1 << 15)] = ok
            q, node = q[keep], node[keep]
            if depth:
                below = len(self.levels[depth - 1][1])
                q = np.repeat(q, self.FAN)
                node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node]


def _tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, data, bounds in slices(batch.column(column)):
        w = words(data, bounds, lower=True)
        for i in range(len(w)):
            yield first + i, shingle_set(w.of(i), k)


def _cut(rows: DataFrame, keys: list[str], block: int, sent: int = SENT) -> DataFrame:
    """Adds ``cut``: into how many blocks the rows of a key go, by their number and the bytes of their sets of ``n`` tokens.

    A row that is alone at its key meets nothing and is left out where it is, if the keys of several rows can go to all tasks. Else only
    keys with several blocks, which are few, are joined, so that rows with their sets need no shuffle of their own for it.
    """
    size = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    cut = F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("s") * 8 / BYTES)).cast("int")
    several = saved(size.where("k > 1").select(*keys, cut.alias("cut")))
    if several.count() <= sent:
        return rows.join(F.broadcast(several), keys)
    large = several.where("cut > 1")
    return rows.join(large, keys, "left").withColumn("cut", F.coalesce("cut", F.lit(1)))


def _shards(rows: DataFrame, block: int) -> int:
    return max(1, math.ceil(rows.count() / block))


def token_classes(stripes: DataFrame) -> np.ndarray:
    """Classes of all counters from rows (part, counts) of the tasks, added in two levels. Only the table reaches the driver.

    A task counts up to 255 in a byte, which is frequent enough for any order.
    """
    def add(batches: Iterator[pa.RecordBatch], narrow: bool) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in batches:
            for c in batch.column(1):
                c = np.frombuffer(c.as_buffer(), np.uint8 if narrow else np.int64).astype(np.int64)
                total, part = (c, batch.column(0)[0]) if total is None else (total + c, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    def level(rows: DataFrame, fan: int, narrow: bool) -> DataFrame:
        keys = ["part", F.pmod(F.xxhash64("counts"), F.lit(fan))]
        return rows.groupBy(*keys).applyInArrow(lambda group: pa.Table.from_batches(add(iter(group.to_batches()), narrow)), "part int, counts binary")

    fan = max(1, math.ceil(stripes.count() / (TABLE // STRIPE) / 256))
    rows = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in level(level(stripes, fan, True), 1, False).collect()}
    return classes_of(np.concatenate([rows.get(i, np.zeros(STRIPE, np.int64)) for i in range(TABLE // STRIPE)]))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, share: tuple[int, int] = (3, 4), block: int = BLOCK,
         broadcast: int = BROADCAST) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (smallest key reachable by links) of every row.

    Sets link when overlap / union >= share. Null, empty and blank texts have no shingles and link with nothing, equal texts always
    link, rows of one key are one document, a null key takes part by its text and has itself no id to give.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = _tokens(docs, key, text)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "f1", "f2", "part", "counts"]
        table, held, waiting, id_kind = np.zeros(TABLE, np.int64), [], 0, pa.null()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            sizes, prints = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            for i, s in _sets(batch, 1, k):
                sizes[i], prints[i] = len(s), print_of(s)
                held.append((s % np.uint64(TABLE)).astype(np.int64))
                waiting += len(s)
                if waiting > TABLE // 4:
                    table += np.bincount(np.concatenate(held), minlength=TABLE)
                    held, waiting = [], 0
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *none], names)
        if held:
            table += np.bincount(np.concatenate(held), minlength=TABLE)
        if table.any():
            parts, none = TABLE // STRIPE, pa.nulls(TABLE // STRIPE, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(parts, id_kind), none, none, none, pa.array(range(parts), pa.int32()),
                                              pa.array([c.tobytes() for c in np.minimum(table, 255).astype(np.uint8).reshape(parts, -1)], pa.binary())], names)

    spark, counted, found = source.sparkSession, [], []
    both = saved(source.mapInArrow(describe, f"id {kind}, n long, f1 long, f2 long, part int, counts binary"), counted)
    rows = saved(both.where("part is null").select("id", "n", "f1", "f2"))
    rarity = spark.sparkContext.broadcast(token_classes(both.where("part is not null").select("part", "counts")))
    discard(spark, counted)
    classes = saved(rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")))

    def ranked_sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
        for i, s in _sets(batch, column, k):
            yield i, by_rarity(s, rarity.value)

    sent = min(broadcast, SENT)
    reps = classes.select(F.col("rep").alias("id")).distinct()
    copies = saved(rows.where("n > 0 and id is not null").select("id").distinct().join(reps, "id", "left_anti"))
    picked = copies.count() <= sent
    own = source.where("id is not null").join(F.broadcast(copies), "id", "left_anti") if picked else source

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([flat(out)] + [flat(owners)] * (not picked), ["token"] + ["f1"] * (not picked))

        for batch in batches:
            out, owners, held = [], [], 0
            for _, s in _sets(batch, 1, k):
                r = by_rarity(s, rarity.value)
                out.append(r[:prefix(len(r), share)])
                if not picked:
                    owners.append(np.full(len(out[-1]), print_of(s)[0], np.int64))
                held += len(out[-1])
                if held > 1 << 18:
                    yield done()
                    out, owners, held = [], [], 0
            yield done()

    if picked:  # one row stands for a class, so tokens need not travel with it
        shared = own.mapInArrow(emit, "token long").groupBy("token").count().where("count > 1").select("token")
    else:
        tokens = own.mapInArrow(emit, "token long, f1 long")
        shared = tokens.groupBy("token").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("token")
    shared = saved(shared, found)

    held = _members(own, shared, kind, ranked_sets, share, broadcast)
    members = saved(held if picked else held.where("id is not null").join(reps, "id", "left_semi"))
    discard(spark, found)

    near = saved(_near(members.where("body is not null"), kind, share, block, _leaders))
    label = clustered(members, near)
    far = _far(members, label, source, kind, ranked_sets, share, block, sent)
    reach = components(near.union(far))
    return (rows.join(classes, ["f1", "f2", "n"], "left").join(reach.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")))


def clustered(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) of all members: the component by the edges, or the id itself."""
    first = components(edges).select(F.col("node").alias("id"), "component")
    return saved(members.select("id").join(first, "id", "left").select("id", F.coalesce("component", "id").alias("cluster")))


def _members(source, shared, kind, sets, share, broadcast) -> DataFrame:
    """Rows with a shared prefix token: id, n, length and end of the prefix, point, those tokens, two hashes to meet at, and the set
    itself where enough are shared (few others are ever verified)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in sets(batch, 1):
                s = s[:prefix(len(s), share)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(s)), flat([s])], ["id", "token"])

    source, known = offered(source, lambda: source.mapInArrow(emit, f"id {kind}, token long"), shared, broadcast)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, s in sets(batch, 1):
                head = s[:prefix(len(s), share)]
                own = head[present(head, known(batch.column(2)[i]))]
                if len(own):
                    body = s.tobytes() if len(own) >= DENSE * len(head) else None
                    meet = np.sort(mix(s))[:MEET].view(np.int64).tolist()
                    out.append((batch.column(0)[i].as_py(), len(s), len(head), int(head[-1] >> np.uint64(1)), point(s).tobytes(), body,
                                own.view(np.int64).tolist(), meet))
                    size += 8 * len(s)
                if len(out) >= 500 or size > BYTES:
                    yield _batch(out, batch.schema.field(0).type)
                    out, size = [], 0
            yield _batch(out, batch.schema.field(0).type)

    return source.mapInArrow(build, f"id {kind}, n long, p long, end long, point binary, body binary, tokens array<long>, meet array<long>")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), longs, longs]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                      ["id", "n", "p", "end", "point", "body", "tokens", "meet"])


def _groups(values: np.ndarray) -> Iterator[slice]:
    """Runs of equal values of a sorted array."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(values)]):
        yield slice(a, b)


def _near(members: DataFrame, kind: str, share, block: int, leaders) -> DataFrame:
    """Verified links of classes to leaders of their blocks; not all links, see step 3. ``members`` has id, n, point, body and meet."""
    rows = members.select("id", "n", "point", "body", F.explode(F.slice("meet", 1, NEAR)).alias("token"))
    rows = _cut(rows, ["token"], block).withColumn("block", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    size = members.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    shards = max(1, math.ceil(size["k"] / (block // 2 or 1)), math.ceil(size["s"] * 8 / BYTES * 4))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["token", "block", "id"])
        edges = []
        mark = group[["token", "block"]].ne(group[["token", "block"]].shift()).any(axis=1).cumsum().to_numpy()
        for g in _groups(mark):
            part = group.iloc[g]
            if len(part) > 1:
                edges += leaders(part["id"].tolist(), [np.frombuffer(b, np.uint64) for b in part["body"]], part["point"].tolist(), share)
        return pd.DataFrame(edges, columns=["a", "b"])

    return rows.drop("n", "cut").groupBy(F.pmod(F.xxhash64("token", "block"), F.lit(shards))).applyInPandas(cluster, f"a {kind}, b {kind}")


def _leaders(ids: list, sets: list[np.ndarray], points: list[bytes], share) -> list[tuple]:
    """Each set is verified against the leaders that the tree finds for it; one that matches none becomes a leader."""
    points = np.stack([np.frombuffer(b, np.uint16) for b in points])
    sizes, full = np.array([len(s) for s in sets]), bool((points == _TOP).any())
    none, edges, leaders, tree, fresh = np.zeros(len(sets), np.int64), [], [], None, []
    for i in range(len(ids)):
        near = list(fresh)
        if tree is not None:
            near += [leaders[j] for j in tree.pairs(points[i:i + 1], sizes[i:i + 1], sizes[i:i + 1], none[:1], none[:1], share)[1].tolist()]
        matched = False
        for j in near:
            least = need(sizes[i], sizes[j], share)
            if bound(points[i], points[j], full) >= least and overlap(sets[i], sets[j]) >= least:
                edges.append((ids[j], ids[i]))
                matched = True
        if not matched:
            fresh.append(i)
            if len(fresh) >= CountTree.FAN:
                leaders += fresh
                fresh = []
                tree = CountTree(points[leaders], sizes[leaders], sizes[leaders], none[leaders], none[leaders])
    return edges


def in_cells(rows: DataFrame) -> DataFrame:
    """Rows of a key cut into ``cut`` sides, once for every side they meet: cell (x, y) holds sides x and y, ``side`` tells which."""
    rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    return rows.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other", "cut")


def at_home(live: DataFrame, block: int) -> DataFrame:
    """Adds ``home`` to tokens (token, low, k, cut): those of one smallest cluster ``low`` meet in one task, as many as ``2 * block`` rows hold.

    Sets that share many tokens are then reported by few tasks instead of by every task that has one of the tokens.
    """
    per_cell = F.when(F.col("cut") > 1, 2 / F.col("cut")).otherwise(1.0)
    large = live.groupBy("low", "cut").agg(F.ceil(F.sum("k") * per_cell / (2 * block)).alias("pieces")).where("pieces > 1")
    piece = F.pmod(F.xxhash64("token"), F.coalesce("pieces", F.lit(1)))
    return live.join(large, ["low", "cut"], "left").withColumn("home", F.xxhash64("low", "cut", piece)).drop("pieces")


def search(group: pd.DataFrame, share: tuple[int, int]) -> pd.DataFrame:
    """(x, y, id): sets of different clusters that the trees let pass, in the cells of their seats."""
    group = group.sort_values(["token", "band", "x", "y", "id"])
    mark = group[["token", "band", "x", "y"]].ne(group[["token", "band", "x", "y"]].shift()).any(axis=1).cumsum().to_numpy()
    points = np.stack([np.frombuffer(b, np.uint16) for b in group["point"]])
    ids, sizes, few, rest, end, cluster, own, side, seat, x, y = (
        group[c].to_numpy() for c in ("id", "n", "few", "rest", "end", "cluster", "own", "side", "seat", "x", "y"))
    found = Cells(seat, ids)
    for g in _groups(mark):
        if g.stop - g.start < 2 or (cluster[g] == cluster[g.start]).all() or not own[g].any():
            continue
        rows, apart = np.arange(g.start, g.stop), x[g.start] != y[g.start]
        left = rows[side[g] == x[g.start]] if apart else rows[own[g]]
        right = rows[side[g] == y[g.start]] if apart else rows
        if not len(left) or not len(right):
            continue
        tree = CountTree(points[right], sizes[right], few[right], rest[right], end[right])
        for i in range(0, len(left), 256):
            at = left[i:i + 256]
            q, t = tree.pairs(points[at], sizes[at], few[at], rest[at], end[at], share)
            q, t = at[q], right[t]
            ok = (cluster[q] != cluster[t]) & (own[q] | own[t])
            if not apart:
                ok &= ~own[t] | (q < t)
            q, t = q[ok], t[ok]
            if len(q):
                found.add(q, t)
    return found.frame()


def _allowed(share: tuple[int, int]):
    """Whether points allow a link of rows p and q."""
    def near(points: list[bytes], sizes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        c = np.stack([np.frombuffer(b, np.uint16) for b in points])
        return bound(c[p], c[q], bool((c == _TOP).any())) >= need(sizes[p], sizes[q], share)

    return near


def _far(members: DataFrame, label: DataFrame, source: DataFrame, kind: str, sets, share, block: int, sent: int = SENT) -> DataFrame:
    """All links between sets of different clusters."""
    spark, opened, met = members.sparkSession, [], []
    rows = members.select("id", "n", "tokens").join(label, "id").select("id", "n", "cluster", F.explode("tokens").alias("token"))
    open_ = rows.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("token")
    rows = saved(rows.join(open_, "token"), opened)
    # a set shares no more tokens with another cluster than it has open ones; ids that come twice count theirs twice
    few = rows.groupBy("id").agg(F.count("*").alias("few"))
    facts = saved(members.join(few, "id").join(seated(members.join(few, "id").select("id", "n", "meet")), "id")
                  .select("id", "n", (F.col("n") - F.col("p")).alias("rest"), "end", "point", "few", "seat"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    # a set meets its own band, and as the smaller one the next
    rows = rows.withColumn("own", band)
    stats = rows.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).groupBy("token", "band").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("k"),
                                              F.max((F.col("own") == F.col("band")).cast("int")).alias("any"))
    # tokens of one band and cluster only drop out
    live = saved(stats.where("low <> high and any = 1").select("token", "band", "low", "k", F.ceil(F.col("k") / block).cast("int").alias("cut")), opened)
    rows = rows.join(at_home(live, block), "token").where("band = own or band = own + 1")
    rows = saved(rows.select("id", "cluster", "token", "band", "cut", "home", (F.col("own") == F.col("band")).alias("own")), met)
    discard(spark, opened)
    rows = in_cells(rows)
    shards = _shards(rows, 2 * block)
    cells = rows.join(facts, "id").groupBy(F.pmod(F.xxhash64("home", "x", "y"), F.lit(shards))).applyInPandas(
        lambda group: search(group, share), f"x long, y long, id {kind}")
    cells = saved(cells.distinct())
    discard(spark, met)
    bodies = members.where("body is not null").select("id", "body")
    needed = saved(facts.join(cells.select("id").distinct(), "id").join(label, "id").select("id", "seat", "cluster", "n", "point"))
    if needed.count() <= sent:
        bodies = bodies.join(F.broadcast(needed.select("id")), "id", "left_semi")
    lacking = needed.select("id").join(bodies.select("id"), "id", "left_anti")
    if lacking.take(1):
        bodies = bodies.union(made(source.join(lacking, "id").dropDuplicates(["id"]), sets, kind).select("id", "body"))
    return links_in_cells(cells, needed.join(bodies, "id"), _allowed(share), share)
