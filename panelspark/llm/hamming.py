"""Near-duplicate detection by a multi-index Hamming join of MinHash signatures.

The signature of a shingle set holds the lowest byte of each of ``CHUNKS * WIDTH`` minima; signatures of sets with similarity s differ in
a share 1 - s of their bytes, about. They are cut into chunks. By the pigeonhole principle two signatures with at most
``CHUNKS * (ERRORS + 1) - 1`` different bytes have a chunk with at most ``ERRORS`` of them, so every chunk is indexed under each choice
of bytes that may differ (those are left out, the others must be equal): all pairs under that distance meet. Pairs beyond it that
meet all the same are not thrown away. A pair at similarity 0.8 is missed only if none of the 16 chunks of 6 bytes has
fewer than 2 errors: with probability 4e-8.

1. Equal sets become one class with one signature; nothing after that works on copies.
2. Chunk keys of one class only can't link anything and are dropped. Sets are made for classes with a key left.
3. Near copies are joined first: classes meet at their two smallest minima, in blocks, and are verified against leaders.
4. Classes of different clusters that share a key are compared by their sizes, their counts per token group, which bound the overlap,
   and their signatures, where the first chunk and choice are that they share, and nowhere else. Those under ``FAR`` differences are not
   reported pair by pair: classes sit together in blocks, and the pair of seats is. Each pair of seats is one cell, where signatures are
   compared and sets verified, until what can be joined is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.graph import components
from panelspark.llm.jaccard import _TOP, BLOCK, MEET, _groups, _near, _sets, _shards, _tokens, at_home, bound, clustered, in_cells, point, print_of
from panelspark.llm.retrieval import BROADCAST, offered, present
from panelspark.llm.tables import saved
from panelspark.llm.verify import Cells, links_in_cells, need, overlap, seated
from panelspark.llm.words import mix

CHUNKS, WIDTH, ERRORS = 16, 6, 1
#: Differences of 96 bytes that a pair may have to be verified; similarity 0.8 has 19 on average, 46 once in 10**10.
FAR = 46
#: Shingles that are hashed at once.
PIECE = 1 << 13
#: Hashes of texts (8 bytes each) that go to all tasks, to find those whose sets are needed; for more, texts are joined by a shuffle.
SENT = 4_000_000
#: Bytes of sets that one batch holds.
PART = 4 << 20

_SEEDS = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
#: Kept bytes of a chunk for every choice of those that may differ.
_CHOICES = np.array([[i not in gone for i in range(WIDTH)] for gone in combinations(range(WIDTH), ERRORS)])


def minima(tokens: np.ndarray) -> np.ndarray:
    """Smallest hash of a set under each of the hash functions."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    for i in range(0, len(tokens), PIECE):
        h = (tokens[i:i + PIECE, None] ^ _SEEDS) * _SEEDS
        h ^= h >> np.uint64(32)
        low = np.minimum(low, h.min(axis=0))
    return low


def signature(low: np.ndarray) -> np.ndarray:
    return mix(low).astype(np.uint8)


def keys(signatures: np.ndarray) -> np.ndarray:
    """Key of every chunk and choice, [row, chunk * choices + choice]."""
    chunks = signatures.reshape(-1, CHUNKS, 1, WIDTH).astype(np.uint64)
    kept = chunks * _CHOICES
    packed = np.zeros(kept.shape[:3], np.uint64)
    for i in range(WIDTH):
        packed = (packed << np.uint64(8)) | kept[..., i]
    place = np.arange(CHUNKS * len(_CHOICES), dtype=np.uint64).reshape(CHUNKS, -1)
    return mix(packed * np.uint64(0x9E3779B97F4A7C15) + mix(place + np.uint64(1))).reshape(len(signatures), -1)


def meetings(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differences, number of the first key they share or -1) of rows of two arrays of signatures."""
    same = (x == y).reshape(-1, CHUNKS, WIDTH)
    wrong = WIDTH - same.sum(axis=2)
    near = wrong <= ERRORS
    chunk = near.argmax(axis=1)
    own = same[np.arange(len(same)), chunk]
    # a choice fits where all kept bytes are equal
    choice = (own[:, None, :] | ~_CHOICES).all(axis=2).argmax(axis=1)
    return wrong.sum(axis=1), np.where(near.any(axis=1), chunk * len(_CHOICES) + choice, -1)


def _leaders(ids: list, sets: list[np.ndarray], signatures: list[bytes], share) -> list[tuple]:
    """Each set is verified against leaders with a near signature; one that matches none becomes a leader."""
    s, edges, leaders = np.stack([np.frombuffer(b, np.uint8) for b in signatures]), [], []
    held = np.empty_like(s)
    for i in range(len(ids)):
        near = np.flatnonzero((held[:len(leaders)] != s[i]).sum(axis=1) <= FAR).tolist()
        matched = False
        for j in near:
            j = leaders[j]
            if overlap(sets[i], sets[j]) >= need(len(sets[i]), len(sets[j]), share):
                edges.append((ids[j], ids[i]))
                matched = True
        if not matched:
            held[len(leaders)] = s[i]
            leaders.append(i)
    return edges


def search(group: pd.DataFrame, share: tuple[int, int] | None = None) -> pd.DataFrame:
    """(x, y, id): classes of different clusters under ``FAR`` differences, in the cells of their seats, each pair where its first shared key is.

    With ``share``, pairs whose sizes ``n`` or counts ``point`` exclude a link are left out, which loses none.
    """
    group = group.sort_values(["token", "x", "y", "cluster", "id"])
    mark = group[["token", "x", "y"]].ne(group[["token", "x", "y"]].shift()).any(axis=1).cumsum().to_numpy()
    s = np.stack([np.frombuffer(b, np.uint8) for b in group["sig"]])
    ids, cluster, side, seat, x, y, token = (group[c].to_numpy() for c in ("id", "cluster", "side", "seat", "x", "y", "token"))
    found = Cells(seat, ids)
    if share:
        sizes, points = group["n"].to_numpy(), np.stack([np.frombuffer(b, np.uint16) for b in group["point"]])
        full = bool((points == _TOP).any())

    def linkable(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = need(sizes[p], sizes[q], share)
        ok = least <= np.minimum(sizes[p], sizes[q])
        p, q, least = p[ok], q[ok], least[ok]
        ok = bound(points[p], points[q], full) >= least
        return p[ok], q[ok]

    def compare(a: np.ndarray, b: np.ndarray, key: int):
        """All rows of ``a`` with all rows of ``b``; their clusters differ unless told apart below."""
        step = max(1, (1 << 15) // max(1, len(b)))
        for i in range(0, len(a), step):
            p = np.repeat(a[i:i + step], len(b))
            q = np.tile(b, len(a[i:i + step]))
            ok = cluster[p] != cluster[q]
            p, q = p[ok], q[ok]
            if share and len(p):
                p, q = linkable(p, q)
            if not len(p):
                continue
            far, first = meetings(s[p], s[q])
            ok = np.flatnonzero((far <= FAR) & (first >= 0))
            p, q, first = p[ok], q[ok], first[ok]
            if len(p):
                here = keys(s[p])[np.arange(len(p)), first].view(np.int64) == key
                if here.any():
                    found.add(p[here], q[here])

    for g in _groups(mark):
        rows = np.arange(g.start, g.stop)
        if len(rows) < 2 or (cluster[g] == cluster[g.start]).all():
            continue
        if x[g.start] != y[g.start]:
            compare(rows[side[g] == x[g.start]], rows[side[g] == y[g.start]], token[g.start])
            continue
        for c in _groups(cluster[g]):  # rows of a cluster stand together and meet those of later ones
            compare(rows[c], rows[c.stop:], token[g.start])
    return found.frame()


def _close(signatures: list[bytes], sizes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether signatures of rows p and q are under ``FAR`` differences apart."""
    s = np.stack([np.frombuffer(b, np.uint8) for b in signatures])
    return (s[p] != s[q]).sum(axis=1) <= FAR


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, share: tuple[int, int] = (4, 5), block: int = BLOCK,
                broadcast: int = BROADCAST, sent: int = SENT) -> DataFrame:
    """Key, ``n_shingles``, ``component_id`` (smallest key reachable by links) and ``kept`` (it is its own) of every row.

    Sets of k-word shingles link when overlap / union >= share, as verified on whole sets. Null, empty and blank texts have no shingles
    and link with nothing, equal texts always link. Rows of one key are one document, with the links of all its texts. A null key
    takes part by its text, gives no id and is not kept.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = _tokens(docs, key, text).withColumn("hash", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            marks, meet = [None] * batch.num_rows, [None] * batch.num_rows
            for i, s in _sets(batch, 1, k):
                sizes[i], prints[i] = len(s), print_of(s)[0]
                if len(s):
                    low = minima(s)
                    marks[i], meet[i] = signature(low).tobytes(), mix(low[:MEET] ^ _SEEDS[:MEET]).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(prints), pa.array(marks, pa.binary()),
                 pa.array(meet, pa.list_(pa.int64())), batch.column(2)], ["key", "n", "id", "sig", "meet", "hash"])

    # a class is known by a 64-bit hash of its set
    rows = saved(source.mapInArrow(describe, f"key {kind}, n long, id long, sig binary, meet array<long>, hash long"))
    classes = saved(rows.where("n > 0").groupBy("id").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("meet").alias("meet"),
                                                              F.min("hash").alias("hash")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                all_ = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), all_.shape[1])), pa.array(all_.ravel().view(np.int64))],
                                                 ["id", "token"])

    found = classes.select("id", "sig").mapInArrow(emit, "id long, token long")
    shared = saved(found.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("token"))
    marks, known = offered(classes.select("id", "sig"), lambda: found, shared, broadcast)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            all_ = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            if batch.column(2).null_count == batch.num_rows:  # all rows look for the same keys
                own = present(all_.ravel(), known(None)).reshape(all_.shape)
            else:
                own = np.stack([present(row, known(batch.column(2)[i])) for i, row in enumerate(all_)])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[own.nonzero()[0]]), pa.array(all_[own].view(np.int64))], ["id", "token"])

    held = saved(marks.select("id", "sig", "own").mapInArrow(hold, "id long, token long"))
    members = classes.join(held.select("id").distinct(), "id")
    members = saved(members.join(_bodies(source, members.select("hash"), k, sent), "id").select("id", "n", "sig", "meet", "counts", "body"))

    near = saved(_near(members.withColumnRenamed("sig", "point"), "long", share, block, _leaders))
    label = clustered(members, near)
    met = held.join(label, "id")
    stats = met.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("k"))
    live = at_home(stats.where("low <> high").select("token", "low", "k", F.ceil(F.col("k") / block).cast("int").alias("cut")), block)
    met = saved(in_cells(met.join(live.drop("low", "k"), "token")))
    at = saved(seated(members))
    facts = members.select("id", "n", "sig", F.col("counts").alias("point"))
    cells = saved(met.join(facts, "id").join(at, "id").groupBy(F.pmod(F.xxhash64("home", "x", "y"), F.lit(_shards(met, 2 * block))))
                  .applyInPandas(lambda group: search(group, share), "x long, y long, id long").distinct())
    needed = members.join(at, "id").join(label, "id").join(cells.select("id").distinct(), "id").select("id", "seat", "cluster", "n", F.col("sig").alias("point"), "body")
    far = links_in_cells(cells, needed, _close, share)
    # texts of one key belong together
    again = rows.where("n > 0 and key is not null").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct("id").alias("k"))
    several = again.where("k > 1").select("key", "a")
    same = rows.join(several, "key").where("n > 0").select("a", F.col("id").alias("b"))
    reach = components(near.union(far).union(same))
    named = rows.where("n > 0").join(reach.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("key").alias("least"))
    of_class = saved(named.select("id", "component").distinct().join(least, "component").select("id", "least"))
    out = rows.join(of_class.withColumn("_some", F.lit(True)), "id", "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("least")), F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def _bodies(source: DataFrame, wanted: DataFrame, k: int, sent: int) -> DataFrame:
    """(id, body, counts per group) of the classes whose texts have a hash in ``wanted``, each once. One Python step, as each has workers of its own."""
    hashes = None
    if wanted.count() <= sent:
        hashes = source.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["hash"].to_numpy().view(np.uint64)))
    else:
        source = source.join(wanted, "hash", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            if hashes is not None:
                texts = texts.filter(pa.array(present(batch.column(0).to_numpy().view(np.uint64), hashes.value)))
            ids, bodies, counts, held = [], [], [], 0
            for _, s in _sets(pa.RecordBatch.from_arrays([texts], ["text"]), 0, k):
                ids.append(print_of(s)[0])
                bodies.append(s.tobytes())
                counts.append(point(s).tobytes())
                held += s.nbytes
                if held > PART:
                    yield _bodies_batch(ids, bodies, counts)
                    ids, bodies, counts, held = [], [], [], 0
            yield _bodies_batch(ids, bodies, counts)

    return source.select("hash", "text").mapInArrow(build, "id long, body binary, counts binary").dropDuplicates(["id"])


def _bodies_batch(ids: list, bodies: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary()), pa.array(counts, pa.binary())], ["id", "body", "counts"])
