"""Readers, adapters and sinks on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.schema import MissingColumns, literal_rows, nan_to_null
from panelspark.sources import forecasts, readers, sinks, textfiles


def test_read_series_and_missing_column(spark, tmp_path):
    (tmp_path / "USA_CPI.csv").write_text("date,USA_CPI\n2000-01-01,1.5\n2000-02-01,\n")
    rows = readers.read_series(spark, str(tmp_path / "USA_CPI.csv"), "USA_CPI").orderBy("ts").collect()
    assert [(r.ts, r.value) for r in rows] == [(dt.date(2000, 1, 1), 1.5), (dt.date(2000, 2, 1), None)]
    with pytest.raises(MissingColumns, match="USA_GDP"):
        readers.read_series(spark, str(tmp_path / "USA_CPI.csv"), "USA_GDP")


def test_read_all_series_keys_from_file_names(spark, tmp_path):
    for name in ("USA_CPI", "UK_POLICY_RATE"):
        (tmp_path / f"{name}.csv").write_text("date,x\n2000-01-01,1\n")
    got = {(r.entity, r.indicator) for r in readers.read_all_series(spark, str(tmp_path)).collect()}
    assert got == {("USA", "CPI"), ("UK", "POLICY_RATE")}


def test_messy_file_in_another_encoding(spark, tmp_path):
    text = '消費者物価\n作成日,2024\n時間軸(月次),総合指数\n2001年1月,"1,234.5"\n2001年2月,-\n2001年3月,...\n1999年1月,7\nfoo,3\n2001-04,8\n200105,9\n'
    (tmp_path / "x.csv").write_bytes(text.encode("cp932"))
    lines = readers.messy_lines(spark, str(tmp_path / "x.csv"))
    rows = readers.ingest_messy(lines, ["時間軸"], ["総合"], dt.date(2000, 1, 1)).orderBy("ts").collect()
    assert [(r.ts.month, r.value) for r in rows] == [(1, 1234.5), (4, 8.0), (5, 9.0)]


def test_unknown_variant_is_an_error(spark):
    df = spark.createDataFrame([("v1", "2000-01-01", 1.0, 2.0), ("v1", "2000-02-01 00:00:00", 1.0, 2.0)], "variant_id string, date string, actual double, predicted double")
    rows = forecasts.adapt_univariate(df, [("v1", "A", "f")]).orderBy("target_date").collect()
    assert [r.origin_date for r in rows] == [dt.date(1999, 12, 1), dt.date(2000, 1, 1)]
    with pytest.raises(Exception, match="unknown variant"):
        forecasts.adapt_univariate(df, [("other", "A", "f")]).collect()


def test_panel_round_trip_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2000, 1, 1), 1.23456789), ("B", dt.date(2000, 1, 1), 2.0)], "entity string, ts date, X double")
    sinks.write_panel(df, str(tmp_path / "p"))
    back = readers.read_panel(spark, str(tmp_path / "p"), ["A"])
    assert [r.X for r in back.collect()] == [1.234568]
    new = spark.createDataFrame([("A", dt.date(2001, 1, 1))], "entity string, ts date")
    rows = sinks.upsert_by_key(df, new, ["entity"]).orderBy("entity").collect()
    assert [(r.entity, r.ts.year, r.X) for r in rows] == [("A", 2001, None), ("B", 2000, 2.0)]
    for day in (1, 2):
        sinks.append_audit_log(new, str(tmp_path / "log"), dt.date(2024, 1, day))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_nan_becomes_null_and_lists_are_bounded(spark):
    assert nan_to_null(spark.range(1).select(F.lit(float("nan")).alias("x"))).first().x is None
    with pytest.raises(ValueError):
        literal_rows([(i,) for i in range(10_001)], ["a"])


def test_guards_of_adapters(spark):
    rows = [("a", "REVENUE", 1, dt.date(2000, 1, 1), dt.date(2000, 2, 1), 1.0, 2.0), ("a", "ORDERS", 1, dt.date(2000, 1, 1), dt.date(2000, 2, 1), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "entity string, variable string, h int, origin_date date, target_date date, actual double, forecast double")
    assert forecasts.adapt_multivariate(df, "REVENUE", "level").count() == 1
    with pytest.raises(Exception, match="no rows for target PRICE"):
        forecasts.adapt_multivariate(df, "PRICE", "level").collect()
    one, two = (forecasts.adapt_multivariate(df, "REVENUE", "level", x, guard=False) for x in ("one", "two"))
    assert forecasts.unify_forecasts(one, two, names=["one", "two"], expected={"one": 1}).count() == 2
    with pytest.raises(Exception, match="layer two has no rows"):
        forecasts.unify_forecasts(one, two.limit(0), names=["one", "two"]).collect()
    with pytest.raises(Exception, match="layer two should have 2 rows and has 1"):
        forecasts.unify_forecasts(one, two, expected={"two": 2}).collect()
    with pytest.raises(Exception, match="no rows for any layer"):
        forecasts.unify_forecasts(one.limit(0), two.limit(0)).collect()


def test_guards_scan_sources_once(spark, tmp_path):
    rows = [("a", "REVENUE", 1, dt.date(2000, 1, 1), dt.date(2000, 2, 1), 1.0, float(i)) for i in range(20)]
    spark.createDataFrame(rows, "entity string, variable string, h int, origin_date date, target_date date, actual double, forecast double").write.parquet(str(tmp_path / "f"))
    out = forecasts.adapt_multivariate(spark.read.parquet(str(tmp_path / "f")), "REVENUE", "level")
    assert out.count() == 20
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1


def written(folder, name, text, encoding):
    (folder / name).write_bytes(text.encode(encoding))


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_every_line_is_read_once(spark, tmp_path, size):
    lines = [f"{i}月,\"{'あ' * (i % 9)}\"" + ("\r" if i % 3 else "") for i in range(120)] + ["", "end without line end"]
    written(tmp_path, "sjis.csv", "\n".join(lines), "cp932")
    written(tmp_path, "_SUCCESS", "no data", "ascii")
    size = max(size, 7)  # few enough tasks
    rows = textfiles.read_lines(spark, str(tmp_path), range_bytes=size).orderBy("line_no").collect()
    assert [r.text for r in rows] == [x.removesuffix("\r") for x in lines]
    raw = textfiles.raw_lines(spark, str(tmp_path), size)
    assert raw.rdd.getNumPartitions() == -(-len("\n".join(lines).encode("cp932")) // size)


def test_encodings_and_files_that_none_fits(spark, tmp_path):
    texts = {"utf-8-sig": "Größe,値\n1,2\n", "cp932": "消費者物価\n2001年1月,1\n", "cp1252": "caf\xe9,na\xefve \xff\n"}
    for name, text in texts.items():
        written(tmp_path, f"{name}.csv", text, name)
    rows = textfiles.read_lines(spark, str(tmp_path), range_bytes=5).collect()
    for name, text in texts.items():
        got = [r.text for r in sorted(rows, key=lambda r: r.line_no) if r.file.endswith(f"{name}.csv")]
        assert got == text.split("\n")[:-1]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert textfiles.read_lines(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "odd.csv").write_bytes(b"\x81\x8d\x8f\x90\x9d\xff\n")
    with pytest.raises(Exception, match="no encoding fits"):
        textfiles.read_lines(spark, str(tmp_path / "odd.csv"), ["utf-8", "cp932"]).collect()


def test_messy_file_by_ranges(spark, tmp_path):
    body = "".join(f"{2000 + i // 12}年{i % 12 + 1}月,\"1,{i:03d}.5\"\n" for i in range(240))
    written(tmp_path, "x.csv", "消費者物価\n作成日,2024\n時間軸(月次),総合指数\n" + body, "cp932")
    lines = textfiles.read_lines(spark, str(tmp_path / "x.csv"), range_bytes=500)
    rows = readers.ingest_messy(lines, ["時間軸"], ["総合"], dt.date(2001, 1, 1)).orderBy("ts").collect()
    assert len(rows) == 228 and [r.value for r in rows] == [1000.5 + i for i in range(12, 240)]
