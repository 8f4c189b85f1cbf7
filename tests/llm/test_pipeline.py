"""The pipeline on the smallest tables: what each stage keeps, against plain Python where the rule is plain."""

import collections
import re

import numpy as np

import corpus_pipeline
from panelspark.llm import jaccard, verify
from panelspark.llm.tables import saved
from tests.llm.test_operators import brute_components, brute_hits

ROOT = "/root/testdata/sf0.001"


def test_stages_keep_what_their_rules_say(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, rows = docs.columns, {}
    rows["input"] = docs.collect()
    for name, work in corpus_pipeline.STAGES:
        docs = saved(work(spark, docs, ROOT))
        rows[name] = docs.collect()
        assert docs.columns[:len(columns)] == columns and (name == "sharding" or docs.columns == columns)
    ids = {k: collections.Counter(r["doc_id"] for r in v) for k, v in rows.items()}
    assert set(ids["language"]) == {r["doc_id"] for r in rows["input"] if any(c.isalpha() for c in r["text"] or "")}
    own = brute_components([(r["doc_id"], r["text"]) for r in rows["language"]])
    assert set(ids["near_duplicates"]) == {i for i, (_, c) in own.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    assert set(ids["decontamination"]) == {r["doc_id"] for r in rows["near_duplicates"] if not brute_hits(r["text"], items)[1]}
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(ids["mixing"].values()) <= 2
    assert ids["sharding"] == ids["mixing"]
    sizes = collections.Counter(r["shard"] for r in rows["sharding"])
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_near_duplicates_leave_texts_where_they_are(spark, monkeypatch):
    """Ids that go are few enough for every task, so that whole rows need no shuffle; more of them are joined, with the same result."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (2, base), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sent in (0, jaccard.SENT):
        monkeypatch.setattr(jaccard, "SENT", sent)
        kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 3, 4, None]
    assert "hashpartitioning" not in plan and "LeftAnti, BuildRight" in plan


def test_sets_are_handed_over_in_small_groups(spark, monkeypatch):
    plans, real = [], verify.saved
    monkeypatch.setattr(verify, "saved", lambda rows: plans.append(rows._jdf.queryExecution().analyzed().toString()) or real(rows))
    body = np.arange(1 << 16, dtype=np.uint64)
    members = spark.createDataFrame([(i, i, i, len(body), b"", body.tobytes()) for i in range(8)], "id long, seat long, cluster long, n long, point binary, body binary")
    ends = spark.createDataFrame([(x, x + 1, i) for x in range(0, 8, 2) for i in (x, x + 1)], "x long, y long, id long")
    found = verify.links_in_cells(ends, members, lambda points, sizes, p, q: np.ones(len(p), bool), (3, 4))
    assert sorted(tuple(sorted(r)) for r in found.collect()) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert int(re.search(r"pmod\(cell#\d+L, cast\((\d+) as bigint\)|pmod\(cell#\d+L, (\d+)", plans[0]).expand(r"\1\2")) >= 4
