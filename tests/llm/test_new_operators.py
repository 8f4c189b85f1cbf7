"""Source divergence and vector codes: brute force on small fixtures with odd rows."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import codes, divergence, hamming, jaccard, lm, queries, verify
from panelspark.llm.jaccard import in_cells
from panelspark.llm.pointers import multikey_sort
from panelspark.llm.words import spans
from tests.llm.test_operators import SCHEMA, corpus, low

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("cached", [4, 1 << 16])
def test_pointer_sort(cached):
    rng = random.Random(3)
    terms = ["".join(rng.choice("aäb") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 30)))) for _ in range(3000)]
    terms += ["a" * n for n in (7, 8, 9, 15, 16, 17, 300)] * 3
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    starts, ends = spans(data != 32, np.array([0, len(data)]))
    order, new = multikey_sort(data, starts, ends, cached)
    assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i].encode(), i))
    got = [terms[i] for i in order]
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]
    assert [len(x) for x in multikey_sort(data, starts[:0], ends[:0])] == [0, 0]


def brute_audit(rows, least, top):
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    found = [(l, s, collections.Counter(TERM.findall(low(t)))) for t, l, s in rows]
    out = []
    for lang in {l for _, l, _ in rows}:
        docs, all_ = collections.Counter(), collections.Counter()
        by = {s: collections.Counter() for _, l, s in rows if l == lang}
        for l, s, c in found:
            if l == lang:
                docs.update(c.keys())
                by[s] += c
                all_ += c
        kept = [t for t, n in docs.items() if n >= least]

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        for s in by:
            pairs = [(o, sum(abs(p(by[s], t) - p(by[o], t)) for t in kept)) for o in by if o != s]
            terms = [(t, p(by[s], t) - p(all_, t)) for t in kept if by[s][t] and p(by[s], t) > p(all_, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i + 1) for i, x in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"least": 3, "top": 7}, {"least": 2, "top": 4, "block": 60, "side": 2}])
def test_audit_against_brute_force(spark, options):
    rows = corpus()
    rows += [(100 + i, f"Größe term{'abc'[i % 3]} {'x' * (i % 20)} École", "en", f"s{i % 5}", 0, "r", 7, -1, "h", "c") for i in range(60)]
    rows += [(200, "123 ...", "en", "letterless", 0, "r", 7, -1, "h", "c"), (201, None, "xx", "a", 0, "r", 7, -1, "h", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("t"), "n": F.lit(3), "p": F.lit(1)}).repartition(3, "doc_id")
    got = sorted(tuple(r) for r in divergence.audit(docs, **options).collect())
    want = brute_audit([r[1:4] for r in rows], options.get("least", 30), options.get("top", 50))
    assert got == want
    assert divergence.audit(docs.limit(0), **options).count() == 0


def test_shares_are_exact():
    n, total = np.array([0, 3, 10**15]), np.array([7, 10**6, 10**15 + 9])
    want = [1 + 10**9 * (a + 5) // (b + 5 * 11) for a, b in zip(n.tolist(), total.tolist())]
    assert divergence.shares(n, total, 11).tolist() == want


def brute_codes(rows, parts, entries, rounds):
    kept = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for i in range(rounds + 1):
        best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if i == rounds:
            break
        for p in range(parts):
            own = collections.defaultdict(list)
            for c, b in zip(cut, best):
                own[b[p][1]].append(c[p])
            for e, xs in own.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
    return sorted(((k, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b)) for (k, _), b in zip(kept, best)), key=str), books


@pytest.mark.parametrize("scale, entries, near", [(1, 8, 3), (1, 20, 16), (0.002, 8, 2), (40, 8, 4), (5000, 6, 2)])
def test_codes_against_brute_force(spark, scale, entries, near):
    rng = random.Random(entries)
    rows = [(rng.randrange(10**6), [scale * rng.choice((-1, 0.3, 1, 2)) * rng.random() for _ in range(8)]) for _ in range(300)]
    rows += rows[:5] * 3  # repeated rows and ties
    rows += [(None, rows[7][1]), (1, None), (2, [None] * 8), (3, [math.nan] * 8), (4, [math.inf] * 8), (5, [])]
    given = [(k, v, i % 3 or None, "x", "y", 5) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int, row string, v string, error int").repartition(3)
    found, books = codes.compress(df, carry=["label", "v"], entries=entries, near=near)
    want, wanted = brute_codes(rows, 4, entries, 4)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in found.select("row.*", "code", "error").collect()), key=str) == want
    assert books.tolist() == wanted


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    found, books = codes.compress(spark.createDataFrame([], kind))
    assert found.count() == 0 and books.size == 0
    few, books = codes.compress(spark.createDataFrame([(2, [1.0] * 4, 1), (1, [-0.0001] * 4, 1), (3, [1.0] * 3, 1), (4, [1e30] * 4, 1)], kind))
    assert books[:, :, 0].tolist() == [[-1, 1024, codes.LIMIT]] * 4  # floors go down, the third has another length, the last stands at the limit
    assert {r["row"]["vec_id"]: (r["code"], r["error"]) for r in few.collect()} == {1: ("00000000", 0), 2: ("01010101", 0), 4: ("02020202", 0)}
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 5, 1)], kind))


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (40, 16))
    x = centres[rng.integers(0, 40, 2000)] + rng.integers(-300, 300, (2000, 16))
    book = x[:64].copy()
    ids, low, _ = codes.search(x, book, 16)
    looked = []
    for _ in range(4):
        own = ids[:, 0]
        moved = np.stack([x[own == e].sum(axis=0) // max(1, (own == e).sum()) if (own == e).any() else book[e] for e in range(64)])
        drift, book = codes._above(codes._exact(moved, book)), moved
        ids, low, best, depth = codes.advance(x, book, drift, ids, codes._halved(low), ids.shape[1])
        d = codes.full(x, book)
        assert (ids[:, 0] == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        looked.append((depth > 16).mean())
    assert looked[-1] < 0.2 and codes.adapted(16, {1: 990, 5: 9, 17: 1}) == 2


def test_labels_and_digest_of_the_query(spark, tmp_path):
    rows = [(i, [float(i % 7 + j) for j in range(4)], (None, 1, 2)[i % 3]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    want, books = brute_codes([(k, v) for k, v, _ in rows], 4, 256, 4)
    label, by = {k: l for k, _, l in rows}, collections.Counter()
    for k, _, e in want:
        by[label[k]] += e
    digest = codes.digest(np.array(books))
    assert sorted(tuple(r) for r in got) == sorted((k, c, e, by[label[k]], digest) for k, c, e in want)


def signatures(rng, n, wrong):
    x = rng.integers(0, 256, (n, hamming.CHUNKS * hamming.WIDTH), np.uint8)
    y = x.copy()
    for row in y:
        at = rng.choice(len(row), wrong, replace=False)
        row[at] += rng.integers(1, 256, wrong).astype(np.uint8)
    return x, y


def test_every_pair_under_the_distance_meets():
    rng = np.random.default_rng(2)
    for wrong in (0, 1, 12, hamming.CHUNKS * (hamming.ERRORS + 1) - 1):
        x, y = signatures(rng, 300, wrong)
        shared = hamming.keys(x) == hamming.keys(y)
        assert shared.any(axis=1).all()
        far, first = hamming.meetings(x, y)
        assert (far == wrong).all() and (first == shared.argmax(axis=1)).all()
    x, y = signatures(rng, 300, 60)
    shared, (_, first) = hamming.keys(x) == hamming.keys(y), hamming.meetings(x, y)
    assert (np.where(shared.any(axis=1), shared.argmax(axis=1), -1) == first).all()


def test_pairs_of_seats_hold_all_near_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, hamming.CHUNKS * hamming.WIDTH, np.uint8)
    rows = []
    for i in range(60):
        s = base.copy()
        s[rng.choice(len(s), 12 + i % 30, replace=False)] = rng.integers(0, 256, 12 + i % 30)
        rows.append((i, s))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and i % 7 != j % 7 and (a != b).sum() <= hamming.FAR
            and hamming.meetings(a[None], b[None])[1][0] >= 0}
    held = [(i, int(t), i % 7, 3, i, s.tobytes()) for i, s in rows for t in hamming.keys(s[None])[0].view(np.int64)]
    cells = in_cells(spark.createDataFrame(held, "id long, token long, cluster long, cut int, seat long, sig binary")).toPandas()
    got = hamming.search(cells)
    assert sorted(zip(got["x"], got["y"], got["id"])) == sorted((i, j, k) for i, j in want for k in (i, j)) and 50 < len(want) < 1700


def test_search_leaves_out_pairs_that_sizes_or_counts_exclude(spark):
    rng = np.random.default_rng(6)
    base = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.concatenate([base[:60 + i], rng.integers(1, 1 << 60, 40 - i % 40).astype(np.uint64)])) for i in range(41)]
    mark = hamming.signature(hamming.minima(base))
    rows = [(i, int(t), i, 2, i, mark.tobytes(), len(s), jaccard.point(s).tobytes()) for i, s in enumerate(sets) for t in hamming.keys(mark[None])[0].view(np.int64)]
    cells = in_cells(spark.createDataFrame(rows, "id long, token long, cluster long, cut int, seat long, sig binary, n long, point binary")).toPandas()
    found = {share: {(x, y) for x, y in hamming.search(cells, share)[["x", "y"]].itertuples(index=False)} for share in (None, (4, 5))}
    links = {(i, j) for j in range(41) for i in range(j) if verify.overlap(sets[i], sets[j]) >= verify.need(len(sets[i]), len(sets[j]), (4, 5))}
    assert len(found[None]) == 820 and links <= found[4, 5] and len(links) > 30 and len(found[4, 5]) < 600


def test_gradients_are_added_in_blocks_and_single_columns_are_those_of_the_whole():
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 400, (3, 2000)) ** 2 // 400
    rows[:, :300] = 7
    gradient, weights, past = rng.normal(size=(2000, 33)).astype(np.float32), rng.normal(size=(400, 33)).astype(np.float32), np.zeros(400, np.float32)
    want = np.zeros((400, 33))
    for r in rows:
        np.add.at(want, r, gradient)
    order = np.argsort(rows.ravel(), kind="stable")
    flat = rows.ravel()[order]
    start = np.flatnonzero(np.diff(flat, prepend=-1))
    got = np.zeros((400, 33))
    for some, g in lm._sums(gradient, order % 2000, start):
        got[flat[start[some]]] += g
    assert np.allclose(got, want, atol=1e-3)
    before = weights.copy()
    lm._step(weights, past, rows, gradient)
    squares = (want ** 2).sum(axis=1) / 33
    assert np.allclose(past, squares, rtol=1e-3) and np.allclose(weights, before - want * (lm.STEP / np.sqrt(squares + 1e-3))[:, None], atol=1e-4)
    offset, at, only = rng.normal(size=(5, 33)).astype(np.float32), rng.integers(0, 5, 2000), rng.integers(0, 33, 2000)
    whole = lm._chances(offset, at, weights, rows)
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-5) and (lm._chances(offset, at, weights, rows, only) == whole[np.arange(2000), only]).all()
    factors = np.exp(np.maximum(offset, -80)), np.exp(weights)
    assert np.allclose(lm._quotients(factors[0], at, factors[1], rows, only), whole[np.arange(2000), only], rtol=1e-4)
    assert np.allclose(lm._quotients(factors[0][at[0]], None, factors[1], rows, only), lm._chances(offset[at[0]], None, weights, rows, only), rtol=1e-4)


def test_hashes_are_found_and_counted_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for n in (1, 2, 300, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        keys[n // 2:] |= np.uint64(0xFFF) << np.uint64(52)  # many with the same first bits
        keys = np.unique(keys)
        asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 2000, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = lm.positions(keys, lm.marks(keys), asked)
        assert ((keys[at] == asked) == np.isin(asked, keys)).all()
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = sorted(np.unique(np.concatenate([lm.tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len(t or "")]))[0] for t in texts]).view(np.int64), return_counts=True)[1].tolist())
    for held in (1 << 20, 64):
        monkeypatch.setattr(lm, "COUNTED", held)
        assert sorted(r["n"] for r in lm.count_tokens(df).collect()) == want


def test_rows_alone_at_their_key_do_not_travel(spark):
    rows = spark.createDataFrame([(i, 10, t) for t, n in ((1, 1), (2, 2), (3, 5), (4, 1)) for i in range(n)], "id long, n long, token long")
    cut = {name: sorted(tuple(r) for r in jaccard._cut(rows, ["token"], 2, sent).select("token", "id", "cut").collect()) for name, sent in (("some", 2), ("all", 1))}
    met = [(2, 0, 1), (2, 1, 1), *[(3, i, 3) for i in range(5)]]
    assert cut["some"] == met and cut["all"] == sorted([(1, 0, 1), *met, (4, 0, 1)])


def test_tokens_travel_alone_and_spent_tables_go(spark, monkeypatch):
    """Classes are told apart by one row each, and what no later step reads leaves the shared folder before the join ends."""
    made, real = [], jaccard.saved

    def saved(rows, scope=None):
        plan, out = rows._jdf.queryExecution().executedPlan().toString(), real(rows, scope)
        made.append((rows.columns, plan, out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard, "saved", saved)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:77]), " ".join(base[8:]), "a b c d e f", "a b c d e f", "x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.link(df).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6)]
    assert all("f1" not in plan for columns, plan, _ in made if columns == ["token"])
    gone = [set(columns) for columns, _, files in made if files and not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)]
    assert {"token"} in gone and any("counts" in columns for columns in gone)


def brute_links(rows, k, share):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    ids, reach = sorted(sets), {i: i for i in sets}

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * share[1] >= share[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                reach[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, number, words, edits, first):
    base = [f"v{rng.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(number):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"y{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("options", [{}, {"block": 3, "broadcast": 0, "sent": 0}])
def test_hamming_join_against_brute_force(spark, options):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in corpus()]
    rows += family(rng, 60, 120, 12, 1000) + family(rng, 40, 40, 6, 2000) + family(rng, 30, 12, 3, 3000)
    df = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], "doc_id long, text string, sig string, n int, token string").repartition(3)
    got = hamming.deduplicate(df, **options).collect()
    want = brute_links(rows, 2, (4, 5))
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hamming_join_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert hamming.deduplicate(spark.createDataFrame([], kind)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + " more"), (5, text + " more"), (7, "a b c d"), (7, text), (8, "A b\nc d"), (9, None), (None, None)]
    got = hamming.deduplicate(spark.createDataFrame(rows, kind)).collect()
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    # the two texts of 7 join the groups of both
    assert found == sorted([(None, 5, False), (None, 5, False), (5, 5, True), (7, 5, False), (7, 5, False), (8, 5, False), (9, 9, True),
                            (None, None, False)], key=str)


def test_a_hot_token_is_searched_by_pairs_of_seats(spark):
    """Tokens that many hold, over several blocks: no link is lost, and what is reported are seats and not pairs."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = [common[:40 + i % 21] + [f"u{rng.randrange(10**9)}" for _ in range(i % 25)] for i in range(60)]
    rows = []
    for i, w in enumerate(texts):
        s = jaccard.by_rarity(jaccard.shingle_set(np.array([zlib.crc32(x.encode()) for x in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.zeros(16, np.uint8))
        rows.append((i, s, s[:jaccard.prefix(len(s), (3, 4))]))
    seen = collections.Counter(t for *_, head in rows for t in head.view(np.int64).tolist())

    def reported(seat):
        held = []
        for i, s, head in rows:
            own = [t for t in head.view(np.int64).tolist() if seen[t] > 1]
            held += [(i, i, t, 1, True, 3, len(s), len(own), len(s) - len(head), int(head[-1] >> np.uint64(1)), jaccard.point(s).tobytes(), seat(i)) for t in own]
        cells = in_cells(spark.createDataFrame(held, "id long, cluster long, token long, band int, own boolean, cut int, n long, few long, rest long, end long, "
                                                     "point binary, seat long")).toPandas()
        got = jaccard.search(cells, (3, 4))
        return list(zip(got["x"], got["y"], got["id"]))

    linked = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and jaccard.overlap(a, b) >= jaccard.need(len(a), len(b), (3, 4))}
    pairs = reported(lambda i: i)
    assert len(pairs) == len(set(pairs)) and linked and {(i, j, k) for i, j in linked for k in (i, j)} <= set(pairs)
    assert len(reported(lambda i: i % 2)) <= 60 + 60  # every set once with its own seat and once with the other


def test_sets_with_many_common_tokens_are_reported_once_a_task(spark):
    """Tokens of one smallest cluster meet in one task as far as they fit, so that a pair isn't reported by each of its tokens."""
    kind = "token long, low long, k long, cut int"
    rows = [(t, 1, 10, 1) for t in range(200)] + [(t, t, 10, 1) for t in range(200, 220)] + [(t, 1, 400, 2) for t in range(220, 224)]
    live = spark.createDataFrame(rows, kind)
    far = jaccard.at_home(live, 1000).collect()
    assert {r["token"]: (r["low"], r["k"], r["cut"]) for r in far} == {r[0]: r[1:] for r in rows}
    assert len({r["home"] for r in far if r["token"] < 200}) == 1 and len({r["home"] for r in far}) == 22
    near = jaccard.at_home(live, 100).collect()
    load = collections.Counter()
    for r in near:
        load[r["home"]] += r["k"] * (2 / r["cut"] if r["cut"] > 1 else 1)
    assert len({r["home"] for r in near if r["token"] < 200}) == 10 and max(load.values()) <= 1600

    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, hamming.CHUNKS * hamming.WIDTH, np.uint8)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(len(s), 20, replace=False)] = rng.integers(0, 256, 20)
        sets.append(s)
    held = [(i, int(t), i, i % 3, s.tobytes()) for i, s in enumerate(sets) for t in hamming.keys(s[None])[0].view(np.int64)]
    met = spark.createDataFrame(held, "id long, token long, cluster long, seat long, sig binary")
    stats = met.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("k")).where("low <> high")
    live = jaccard.at_home(stats.withColumn("cut", F.lit(1)), 2000).select("token", "home", "cut")
    cells = in_cells(met.join(live, "token")).toPandas()
    told = {name: [tuple(r) for _, g in cells.groupby(name) for r in hamming.search(g).itertuples(index=False)] for name in ("token", "home")}
    assert set(told["token"]) == set(told["home"]) and len(told["home"]) * 3 < len(told["token"]) * 2


@pytest.mark.parametrize("side, load", [(2, 200), (512, 1 << 20)])
def test_links_in_cells_join_what_is_linked(spark, side, load):
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(60), rng.randrange(20, 40))) for _ in range(30)]
    for i in range(30):
        s = set(sets[i % 5]) - {rng.randrange(60)}
        sets.append(sorted(s))
    rows = [(i, i % 50, len(s), np.array(s, np.uint64).tobytes(), [i % 3, 5, 6]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, cluster long, n long, body binary, meet array<long>")
    at = verify.seated(df, side)
    members = df.join(at, "id").withColumn("point", F.col("body"))
    seats = [r[0] for r in at.select("seat").distinct().collect()]
    assert len(seats) == (1 if side == 512 else 30) or side == 2
    own = {r.id: r.seat for r in at.collect()}
    cells = spark.createDataFrame([(a, b, i) for a in seats for b in seats if a <= b for i, c in own.items() if c in (a, b)], "x long, y long, id long")
    got = [(r.a, r.b) for r in verify.links_in_cells(cells, members, lambda points, sizes, p, q: np.ones(len(p), bool), (3, 4), load).collect()]
    reach = list(range(60))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    def components(links):
        reach[:] = range(60)
        for i in range(60):  # rows of one cluster are linked already
            reach[root(i)] = root(i % 50)
        for a, b in links:
            reach[root(a)] = root(b)
        return {frozenset(i for i in range(60) if root(i) == c) for c in map(root, range(60))}

    true = [(i, j) for i in range(60) for j in range(i) if len(set(sets[i]) & set(sets[j])) * 4 >= 3 * len(set(sets[i]) | set(sets[j]))]
    assert set(got) | {(b, a) for a, b in got} <= set(true) | {(b, a) for a, b in true}
    assert components(got) == components(true)


def test_counts_are_added_over_tasks(spark):
    parts = jaccard.TABLE // jaccard.STRIPE
    one = np.zeros(jaccard.TABLE, np.uint8)
    one[5], one[-1] = 3, 100
    rows = [(i, c.tobytes()) for i, c in enumerate(one.reshape(parts, -1))] * 3
    got = jaccard.token_classes(spark.createDataFrame(rows, "part int, counts binary"))
    assert got.tolist() == jaccard.classes_of(3 * one.astype(int)).tolist()
    assert jaccard.token_classes(spark.createDataFrame([], "part int, counts binary")).sum() == 0
