"""The training-data operators on small fixtures: odd rows, and brute force where SQL can't say what is right."""

from __future__ import annotations

import collections
import random
import re


import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, jaccard, langid, licenses, lm, mixing, quality, sharding, substrings, tokens, words
from panelspark.llm.fmindex import FMIndex, smallest
from panelspark.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, size long, hits string, component string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Near and exact copies, shared passages, null, empty and blank texts, repeated rows, one huge text."""
    rng = random.Random(1)
    rows, base, passage = [], prose(rng, 90), prose(rng, 30)
    for i in range(60):
        kind = i % 6
        text = prose(rng, rng.randrange(1, 120))
        if kind == 1:
            w = base.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "x"
            text = " ".join(w)
        elif kind == 2:
            text = f"{text}\n{passage} {prose(rng, 20)}"
        elif kind == 3:
            text = base.upper().replace(" ", "\t\n")
        rows.append((i, text, ("en", "de", None)[i % 3], ("a", "b", None, "ä")[i % 4]))
    rows += [(60, None, "en", "a"), (61, "", None, None), (62, " \n\t", "en", "a"), (63, "one", "en", "a"), (63, "one", "en", "a"),
             (64, prose(rng, 30000, 20000), "en", "a"), (65, "naïve Éa école", "fr", "b"), (66, "...!!", "en", "b")]
    return [(i, t, lang, s, len(t or ""), "r", 7, -1, "h", "c") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    seen = {}
    for first, end, data, bounds in words.slices(pa.array(texts, pa.string()), 4000):
        w = words.words(data, bounds, lower=True)
        for i in range(end - first):
            want = WORDS.findall(low(texts[first + i] or ""))
            got = w.of(i).tolist()
            assert len(got) == len(want)
            for h, x in zip(got, want):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_license_windows(spark):
    filler = " ".join(f"f{i}" for i in range(5000))
    mit = dict(licenses.TEMPLATES)["MIT-text"]
    half = " ".join(mit.split()[:len(mit.split()) // 2])
    rows = [(1, f"{filler} {mit} {filler}", 0), (2, half, 0), (3, None, 0), (4, "", 0), (5, "RELEASED under\nthe MIT-License!", 0), (5, "x", 0),
            (6, filler[:22000] + mit.replace("copy", "kopy"), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(df).collect()}
    assert set(got) == {(1, "MIT-text"), (5, "MIT"), (6, "MIT-text")}
    assert got[1, "MIT-text"]["containment"] == 1.0 and 0.75 <= got[6, "MIT-text"]["containment"] < 1
    assert licenses.scan(df.where("false")).count() == 0


def test_shards_are_exact_and_uniform(docs, none, rows):
    got = sharding.shard(docs, docs.columns, 7).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(rows)
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    assert got == sharding.shard(docs, docs.columns, 7).collect()
    assert sharding.shard(none, none.columns, 7).count() == 0
    rng = np.random.default_rng(0)
    draws = np.array([sharding.deal(rng, [30, 20, 10], 12) for _ in range(4000)])
    assert (draws.sum(1) == 12).all() and np.allclose(draws.mean(0), [6, 4, 2], atol=0.1)
    assert abs(draws[:, 0].var() - 12 * 0.5 * 0.5 * 48 / 59) < 0.15
    huge = sharding.hypergeometric(rng, 6 * 10 ** 10, 4 * 10 ** 10, 10 ** 9)
    assert abs(huge - 6 * 10 ** 8) < 10 ** 6
    cells = np.array(sharding.matrix([5, 0, 9], [5, 5, 4], (1,)))
    assert cells.sum(1).tolist() == [5, 0, 9] and cells.sum(0).tolist() == [5, 5, 4]


def test_language_model_scores(spark, none):
    rng = random.Random(3)
    rows = []
    for i in range(300):  # two languages: a word tells much about the next
        side = i % 2
        rows.append((i, " ".join(f"{'AB'[side]}{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 90)))))
    rows += [(300, None), (301, ""), (302, "unseen words here"), (302, "unseen words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 10 == 0
    got = lm.score(df, held).collect()
    want = {i: WORDS.findall(low(t or "")) + [None] for i, t in rows}
    counts = collections.Counter(w for i, t in rows if i % 10 for w in WORDS.findall(low(t or "")) + [None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        t = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert r["held_out"] == (r["doc_id"] % 10 == 0)
    test = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test) + 0.1 * sum(r["n_tokens"] for r in test)
    assert lm.score(none, held).count() == 0
    unknown = lm.score(df, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in unknown)


def test_model_is_a_distribution(spark):
    df = spark.createDataFrame([(i, "a b c a b d e a " * 3) for i in range(20)], "doc_id long, text string")
    counts = lm.count_tokens(df)
    model = lm.train(df, lm.start(df, counts, "text", 2), workers=2)
    one = np.full(len(model.words), words.mix(np.array([5], np.uint64))[0])
    inside = 10 ** model.log10(model.words, one, one)
    outside = 10 ** model.log10(np.array([12345], np.uint64), one[:1], one[:1])
    assert inside.sum() + outside[0] == pytest.approx(1.0, abs=1e-4)


def test_words_outside_the_classes_have_features(spark, monkeypatch):
    """A tree of digits tells them apart by their contexts, leaves by their counts, and all together stay a distribution."""
    rng = random.Random(6)
    text = lambda: " ".join(f"{'abc'[i % 3]}{rng.randrange(1400)} follow{i % 3}" for i in range(60))
    rows = [(i, text()) for i in range(200)] + [(201, "a0 never"), (202, "a0 never never again never"), (203, "a0 follow0"), (204, "b0 follow0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    counts = lm.count_tokens(df.where("doc_id < 200"))
    table = {np.int64(r["word"]).view(np.uint64): r["n"] for r in counts.collect()}
    model = lm.start(df.where("doc_id < 200"), counts, "text", 2)
    every, n = np.array(list(table), np.uint64), np.array(list(table.values()))
    context = np.full(len(every), every[0])

    def logs(m):
        outside = m.ids(every) < 0
        return m.log10(every, context, context) + np.where(outside, m.outside_log10(every, context, context) + np.log10(n + lm.ADD) - m.rest_log, 0.0)

    assert (model.ids(every) < 0).sum() > 1000
    assert 10 ** logs(model) == pytest.approx((n + lm.ADD) / (n.sum() + lm.ADD * (len(n) + 1)), rel=1e-4)
    done = lm.train(df.where("doc_id < 200"), model, workers=2)
    assert np.abs(done.weights_tree).max() > 0 and np.abs(model.weights_tree).max() == 0
    share = 10 ** done.log10(np.array([12345], np.uint64), context[:1], context[:1])[0]
    assert (10 ** logs(done)).sum() == pytest.approx(1 - share * lm.ADD / 10 ** done.rest_log, abs=1e-4)
    monkeypatch.setattr(lm, "HEAD", 2500)  # most words are joined
    few = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") > 200, workers=2).collect()}
    monkeypatch.setattr(lm, "HEAD", 1 << 18)
    all_ = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") > 200, workers=2).collect()}
    assert all(few[i][c] == pytest.approx(all_[i][c], rel=1e-6) for i in few for c in ("score", "base_score", "n_known"))
    assert all_[202]["n_known"] <= 2 and np.isfinite(all_[202]["score"])


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        size = min(10, len(v))
        wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if wins else 0):
            if tuple(w[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("patterns", [50_000, 9])
def test_decontamination_against_brute_force(spark, docs, none, rows, patterns):
    base = rows[1][1].split()
    items = [(1, " ".join(base[20:45])), (2, "W1, w2"), (3, None), (4, ""), (10, " ".join(base[30:50])), (5, "école"), (6, "w7"), (7, "zz " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, patterns=patterns).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r["n_words"], sorted(r["hits"]), r["items"]) == brute_hits(text[r["doc_id"]], items), r["doc_id"]
    if patterns > 9:
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(not r["hits"] for r in got)
        assert decontaminate.decontaminate(none, bench).count() == 0
        assert decontaminate.decontaminate(docs, bench.where("false")).where(F.size("hits") > 0).count() == 0


def test_clean_leaves_rows_where_they_are(spark, docs, none, rows):
    base = rows[1][1].split()
    items = [(1, " ".join(base[20:45])), (2, "W1, w2"), (3, None), (4, ""), (5, "école"), (6, "w7"), (7, "zz " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = sorted(i for i, t, *_ in rows if not brute_hits(t, items)[1])
    assert 0 < len(left) < len(rows)
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))  # null ids and repeated texts are rows like others
    for patterns in (50_000, 9):
        kept = decontaminate.clean(docs, bench, patterns=patterns)
        plan, given = (df._jdf.queryExecution().executedPlan().toString() for df in (kept, docs))
        assert "Join" not in plan and plan.count("Exchange") <= given.count("Exchange")
        assert sorted(r["doc_id"] for r in kept.collect()) == left and kept.columns == docs.columns
        assert decontaminate.clean(twice, bench, patterns=patterns).where("doc_id is null").count() == len(left)
    assert decontaminate.clean(none, bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == len(rows)


def test_language_id(spark, docs, none):
    rng = random.Random(5)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmñé"}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 60)))
    rows = [(i, text(kinds[k]), k if i % 7 else None) for i, k in enumerate(list(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !", "bb"), (903, text("abcde") * 900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    want = {i: list(kinds)[i % 3] for i in range(180)} | {903: "aa"}
    assert sum(got[i]["lang_pred"] == k for i, k in want.items()) >= 0.97 * len(want)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(df.where("false"))).collect()} == {"und"}


def test_token_counts_equal_the_library(spark, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    pieces = ["the", " of", "\n\n", "  ", "é", "naïve", "<|endoftext|>", "1234", "'s", "'", "!!", "日本語", "\t", "\x1c", "\xa0", "x" * 50, " ", "don't"]
    texts = [None, "", "a"] + ["".join(rng.choice(pieces) for _ in range(n)) for n in (1, 10, 300, 2000, 9000)] + ["z" * 3000, " " * 3000]
    for t in texts[3:]:
        for chunk, overlap in ((50, 4), (400, 20)):
            assert tokens.count_long(tok, t, chunk, overlap) == len(tok.encode(t, add_special_tokens=False).ids)
    got = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert tokens.token_counts(none, path).count() == 0


def test_parts_of_texts_are_encoded_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, asked = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []

    class Asked:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tok.encode_batch_fast(texts, **options)

    rng = random.Random(5)
    pieces = ["the", " of", " the", "\n\n", "  ", " ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "é", "!!", "'s", "<|endoftext|>", "12", "日本", "x" * 70]
    texts = ["", " ", "a "] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for limit in (1 << 19, 5, 0):
        known = {}
        assert tokens.count(Asked(), texts, known, limit) == want and tokens.count(Asked(), texts[::-1], known, limit) == want[::-1]
        assert len(known) <= limit and all(len(p) <= tokens.LONGEST for p in known)
    asked.clear()
    known = {}
    for _ in range(3):
        tokens.count(Asked(), ["the cat saw the cat", "and the cat ran"] * 50, known)
    assert sorted(asked) == sorted(["the", " cat", " saw", " the", "and", " ran"])


def test_quality_counts_and_outliers(spark, none):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(60, 200), 5000), "en", "a") for i in range(200)]
    rows += [(200 + i, " ".join(f"{w}###" for w in prose(rng, 80, 5000).split()), "en", "a") for i in range(5)]
    rows += [(300, None, "en", "a"), (301, "a b c a b c " * 30, "en", "a"), (302, "same line\nsame line\n\n \n other # line\nsame line", None, None),
             (303, prose(rng, 100, 5000), None, "z"), (303, prose(rng, 100, 5000), None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judge(df, ["doc_id"]).collect()
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for r in got:
        if r["doc_id"] == 303:
            continue
        t = texts[r["doc_id"]][0] or ""
        w = WORDS.findall(t)
        tri = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        assert tuple(r[s] for s in quality.STATS) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in range(200, 205))
    assert not kept[300] and not kept[301] and not kept[302] and kept[303]
    assert quality.judge(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("limit", [quality.GROUPS, 3])
def test_small_groups_are_judged(spark, limit):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(60, 200), 5000), ("en", "de")[i % 2], f"s{i % 30}") for i in range(200)]
    junk = " ".join(f"{w}###" for w in prose(rng, 80, 5000).split())
    rows += [(200, junk, "en", "s0"), (201, junk, "de", "s1"), (202, junk, "en", "alone"), (203, junk, "xx", "alone")]
    rows += [(None, prose(rng, 100, 5000), "de", None) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judge(df, ["doc_id"], limit=limit).collect()
    assert len(got) == len(rows) and not any(r["base_failed"] or r["distance"] is None for r in got)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in [*range(200), None]) and not any(kept[i] for i in range(200, 204))


def test_minimum_covariance_ignores_a_quarter():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (320, 4)), rng.normal(12, 0.1, (80, 4))])
    mean, cov = quality.search(x, 0)
    assert np.abs(mean).max() < 0.3 and np.abs(np.diag(cov) - 1).max() < 0.5


@pytest.mark.parametrize("options", [{}, {"broadcast": 0, "shard": 300}, {"hot": 1}])
def test_substring_dedup_against_brute_force(spark, docs, none, rows, options):
    got = substrings.dedup(docs, **options).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        w = WORDS.findall(r[1] or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), r[0])
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = WORDS.findall(text[r["doc_id"]] or "")
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < r["doc_id"] for j in range(i, i + 13)}
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    if not options:
        assert sum(r["n_removed"] for r in got) > 300 and substrings.dedup(none).count() == 0


def test_fm_index_finds_what_is_there():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 300), 0)
    index, values = FMIndex(text, 9), rng.integers(0, 1000, 301)
    ends = np.arange(1, 301)
    length, lo, hi = index.statistics(text, ends, 8)
    assert (length == np.minimum(ends, 8)).all()
    for e in range(8, 301, 7):
        spots = [i for i in range(293) if (text[i:i + 8] == text[e - 8:e]).all()]
        assert sorted(index.order[lo[e - 1]:hi[e - 1]].tolist()) == spots
    full = length == 8
    low_of = smallest(values[index.order], lo[full], hi[full])
    assert low_of.tolist() == [values[index.order[a:b]].min() for a, b in zip(lo[full], hi[full])]


def brute_components(rows):
    sets = {}
    for r in rows:
        w = WORDS.findall(low(r[1] or ""))
        k = min(5, len(w))
        sets.setdefault(r[0], {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def chains(n, seed):
    """Texts in which each is similar to the next only, some exactly at the threshold."""
    rng = random.Random(seed)
    rows, w = [], [f"v{rng.randrange(10 ** 6)}" for _ in range(60)]
    for i in range(n):
        if i % 9 == 0:
            w = [f"v{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(6, 90))]
        w = w[rng.randrange(0, max(1, len(w) // 7)):] + [f"v{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(0, max(1, len(w) // 7)))]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"broadcast": 0, "block": 3}])
def test_jaccard_join_against_brute_force(spark, docs, none, rows, options):
    for own in (rows, chains(120, 1)):
        df = docs if own is rows else spark.createDataFrame(own, "doc_id long, text string").repartition(3)
        want = brute_components(own)
        got = jaccard.link(df, **options).collect()
        assert len(got) == len(own)
        for r in got:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    if not options:
        assert jaccard.link(none).count() == 0


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_copies_and_null_keys_however_rows_are_picked(spark, monkeypatch, sent):
    """Ids that go to all tasks and ids joined by a shuffle pick the same rows, and links to sets of copies stay."""
    monkeypatch.setattr(jaccard, "SENT", sent)
    base = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(base), " ".join(base[:57]), " ".join(base[:53])
    rows = [(None, text), (None, near), (3, text), (4, text), (5, near), (5, "x y z"), (6, "x y z"), (7, near), (8, other), (9, None), (10, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans = []
    real = jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda rows, scope=None: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real(rows, scope))
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.link(df).collect()), key=str)
    assert any("BuildRight, LeftAnti" in p or "LeftAnti, BuildRight" in p for p in plans if "FlatMap" not in p and "MapInArrow" in p) == (sent > 0)
    assert [x for x in got if x[0] is not None] == sorted([(3, 3), (4, 3), (5, 3), (5, 3), (6, 3), (7, 3), (8, 3), (9, 9), (10, 10)], key=str)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (400, jaccard.GROUPS)).astype(np.uint16)
    points[200:] = np.maximum(points[:200].astype(int) - rng.integers(0, 2, (200, jaccard.GROUPS)), 0)
    sizes = points.sum(1).astype(np.int64)
    none = np.zeros(400, np.int64)
    q, t = jaccard.CountTree(points, sizes, sizes, none, none).pairs(points, sizes, sizes, none, none, (3, 4))
    bound = np.minimum(points[:, None], points).sum(2, dtype=np.int64)
    want = bound >= jaccard.need(sizes[:, None], sizes, (3, 4))
    got = np.zeros((400, 400), bool)
    got[q, t] = True
    assert (got == want).all()


@pytest.mark.parametrize("top", [4, 8, 12])
def test_no_link_is_lost_at_the_largest_counts(monkeypatch, top):
    monkeypatch.setattr(jaccard, "_TOP", top)
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        s = rng.integers(0, 2 ** 63, 640, dtype=np.uint64)
        sets += [np.sort(s), np.sort(np.append(s[20:], rng.integers(0, 2 ** 63, 20, dtype=np.uint64)))]
    points, sizes = np.stack([jaccard.point(s) for s in sets]), np.array([len(s) for s in sets])
    assert points.max() == top
    none = np.zeros(len(sets), np.int64)
    q, t = jaccard.CountTree(points, sizes, sizes, none, none).pairs(points, sizes, sizes, none, none, (3, 4))
    assert {(i, i ^ 1) for i in range(len(sets))} <= set(zip(q.tolist(), t.tolist()))
    assert {(i, i + 1) for i in range(0, len(sets), 2)} == set(jaccard._leaders(list(range(len(sets))), sets, [p.tobytes() for p in points], (3, 4)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (205, 201), (206, 205)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 201: 201, 205: 201, 206: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_meets_targets(spark, docs, none, rows):
    got = mixing.mix(docs, ["doc_id", "source", "size"]).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == size[r["source"]] and r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    huge = next(r[3] for r in rows if r[0] == 64)  # one text holds most of this source
    assert all(t - taken[s] <= 2 for s, t in target.items() if s != huge) and all(taken[s] <= t + 1e-6 for s, t in target.items())
    assert all(t <= 2 * size[s] + 1e-6 for s, t in target.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2), ["doc_id", "source", "size"]).collect()))
    assert mixing.mix(none, ["doc_id"]).count() == 0
    shares = mixing.targets([("b", 100), ("a", 1000), (None, 1000)], (3, 1, 2), 1.5, 2)
    assert shares == pytest.approx({"b": 200.0, "a": 1770.0, None: 1180.0})


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes, counts = rng.integers(2, 40, 5), rng.integers(0, 4, 5)
        budget = int(rng.integers(1, 120))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + int(s) * k for x in sums for k in range(c + 1)}
        best = max(x for x in sums if x <= budget)
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken <= counts).all() and int((taken * sizes).sum()) == best
        taken = mixing.fit(sizes, counts, budget, 1)  # fixes an even share first, so it may end a little lower
        assert (taken <= counts).all() and best - 40 < int((taken * sizes).sum()) <= best


