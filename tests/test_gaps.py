"""Gaps, long series and long horizons against direct computation on the array without nulls."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluate, stationarity
from tests.test_models import direct_adf, direct_kpss


def month(i):
    return dt.date(1985 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(7)
    series = {}
    for name, n, holes, first in (("long", 300, [], 0), ("short", 40, [], 0), ("start", 76, [0, 1], 120), ("inside", 76, [20, 21, 50, 51], 120),
                                  ("border", 76, [56, 57, 58, 59], 120), ("two blocks", 1100, [3, 955, 957, 958, 1000], 0)):
        v = np.cumsum(rng.normal(size=n)) * 0.3 + rng.normal(size=n)
        series[name] = [(name, month(first + i), None if i in holes else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame([r for s in series.values() for r in s], "entity string, ts date, value double")
    return series, df


@pytest.mark.parametrize("spec", ["c", "ct"])
def test_unit_root_tests_close_gaps(gappy, spec):
    series, df = gappy
    got = {r.entity: r for r in stationarity.test_series(df.withColumn("spec", F.lit(spec)), ["entity"]).collect()}
    for name, rows in series.items():
        v = np.array([x for _, _, x in rows if x is not None])
        stat, lag, nobs = direct_adf(v, spec)
        assert (got[name].adf_usedlag, got[name].adf_nobs) == (lag, nobs) and got[name].adf_stat == pytest.approx(stat, rel=1e-6)
        k, lags = direct_kpss(v, spec)
        assert got[name].kpss_lags == lags and got[name].kpss_stat == pytest.approx(k, rel=1e-8)
