"""The registered queries: naming, coverage, and a sample run against DuckDB."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

ROOT = "/root/testdata/sf0.01"
SECTIONS = {"a": 16, "b": 22, "c": 9, "d": 19, "e": 16, "f": 15, "g": 15, "h": 12, "i": 22, "j": 15, "k": 21, "l": 7}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_operator_is_registered():
    names = {m.groups() for m in (re.match(r"([a-l])(\d\d)_", n) for n in queries()) if m}
    for letter, last in SECTIONS.items():
        missing = [i for i in range(1, last + 1) if (letter, f"{i:02d}") not in names and (letter, i) != ("d", 12)]
        assert not missing, (letter, missing)
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["a16_upsert_by_key", "b02_densify_calendar", "b04_fill_short_gaps_quirk", "c03_yoy_pct", "h04_select_order", "l04_broken_anchors", "f04_classify_quadrant"])
def test_sample_against_sql(spark, duck, name):
    got = queries()[name](spark, ROOT)
    cols = sorted(got.columns)
    rel = duck.sql(oracle_sql()[name])
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want


def test_flagship_runs(spark):
    df = entry(spark)
    assert "dm_standard" in df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["k14_dm_battery", "d07_feature_matrix", "g02_chow_hac", "i19_var_walk_forward"])
def test_facts_are_scanned_once_and_nothing_is_crossed(spark, name):
    df = queries()[name](spark, ROOT)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[o_", plan)) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["k07_newey_west_lrv", "k10_dm_robust", "j02_time_series_folds", "j03_alpha_cv", "j05_intercept_bound", "j06_coef_stability_all_features"])
def test_series_are_windowed_by_block(spark, name):
    df = queries()[name](spark, ROOT)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    # ranks of the features of one fitted model are the only windows without blocks
    assert windows and all("_blk" in w or "feature" in w for w in windows)
