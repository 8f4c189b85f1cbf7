"""Block-wise windows must equal plain windows, whatever the block length."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.series import carry, running, sliding
from panelspark.operators import clean


def months(n, start=1990):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e, n in (("a", 50), ("b", 17), ("c", 1)):
        for t in months(n):
            v = float(rng.normal()) if rng.random() > 0.3 else None
            rows.append((e, t, v))
    return spark.createDataFrame(rows, "entity string, ts date, v double")


def collect(df, *cols):
    return sorted((tuple(r[c] for c in ("entity", "ts", *cols)) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("span", [1, 5, 7, 960])
def test_sliding(panel, span):
    w = Window.partitionBy("entity").orderBy("ts")
    def build(x):
        return {"l": F.lag("v", 3).over(x), "f": F.lead("v", 2).over(x), "m": F.avg("v").over(x.rowsBetween(-3, 0))}
    got = collect(sliding(panel, ["entity"], build, back=3, ahead=2, span=span), "l", "f", "m")
    want = collect(panel.select("*", *[c.alias(n) for n, c in build(w).items()]), "l", "f", "m")
    assert got == want


@pytest.mark.parametrize("span", [1, 5, 960])
def test_running_and_carry(panel, span):
    w = Window.partitionBy("entity").orderBy("ts")
    got = collect(running(panel, ["entity"], {"s": F.coalesce("v", F.lit(0.0))}, span=span), "s")
    want = collect(panel.withColumn("s", F.sum(F.coalesce("v", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))), "s")
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want])
    for forward, frame, fn in ((True, (Window.unboundedPreceding, 0), F.last), (False, (0, Window.unboundedFollowing), F.first)):
        a = collect(carry(panel, ["entity"], F.col("v"), "c", forward, span=span), "c")
        b = collect(panel.withColumn("c", fn("v", ignorenulls=True).over(w.rowsBetween(*frame))), "c")
        assert a == b


def series(spark, values):
    return spark.createDataFrame([("a", t, v) for t, v in zip(months(len(values)), values)], "entity string, ts date, v double")


def filled(df):
    return [r.v for r in df.orderBy("ts").collect()]


def test_gap_filling_strict_and_quirk(spark):
    values = [1.0, None, 3.0, None, None, None, None, 8.0, None]
    df = series(spark, values)
    assert filled(clean.fill_short_gaps(df, "v", 2)) == [1, 2, 3, None, None, None, None, 8, None]
    assert filled(clean.fill_short_gaps(df, "v", 2, strict=False)) == [1, 2, 3, 4, 5, None, None, 8, None]
    lone = series(spark, [3.0, None, None, None, None, 8.0])
    assert filled(clean.fill_short_gaps(lone, "v", 2, strict=False)) == [3, None, None, None, None, 8]
    assert filled(clean.fill_short_gaps(df, "v", None)) == [1, 2, 3, 4, 5, 6, 7, 8, None]


def test_null_runs_types(spark):
    runs = clean.null_runs(series(spark, [None, 1.0, None, None, 2.0, None]), "v").orderBy("run_start").collect()
    assert [(r.kind, r.length) for r in runs] == [("leading", 1), ("internal", 2), ("trailing", 1)]


def test_densify_long_calendar_is_generated_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clean, "SPAN", 4)
    df = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1.0), ("a", dt.date(2001, 3, 1), 2.0)], "entity string, ts date, v double")
    out = clean.densify(df).orderBy("ts").toPandas()
    assert list(out.ts) == months(15, 2000) and out.v.notna().sum() == 2


def test_harmonise_unknown_unit_is_an_error(spark):
    df = series(spark, [1.0] * 14).withColumnRenamed("v", "value")
    with pytest.raises(Exception, match="unknown unit"):
        clean.harmonise_units(df, {"a": "index"}).collect()
    assert isinstance(clean.harmonise_units(df, {"a": "level"}).toPandas(), pd.DataFrame)
