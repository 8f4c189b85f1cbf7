"""Recorded values that results must equal."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import dist
from panelspark.operators import breaks, describe, evaluate, stationarity, transform
from panelspark.operators.sarma import boundary_verdict, order_string, select_order


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


@pytest.mark.parametrize("t,df,p", [(2.5288739993691145, 57, 0.0142351623104295), (4.168096267047295, 57, 0.000105540648936), (0.3718053572813856, 57, 0.7114164169616028)])
def test_t_tail(t, df, p):
    assert dist.t_two_sided([t], [df])[0] == pytest.approx(p, rel=1e-10)


@pytest.mark.parametrize("f,d1,d2,p", [(9.693155711180635, 5, 276, 1.5275736675590682e-08), (33.67273005315921, 5, 276, 8.41426071765765e-27),
                                       (1.5645248025509235, 5, 287, 0.1700820030647), (1.7862700228294557, 12, 1025, 0.0459217446249911)])
def test_f_tail(f, d1, d2, p):
    assert dist.f_tail([f], [d1], [d2])[0] == pytest.approx(p, rel=1e-9)
    assert dist.f_tail([19.95037364846259], [5], [276])[0] < 1e-15


def test_normal_and_chi2(spark):
    assert dist.normal_two_sided([-4.058885638253069])[0] == pytest.approx(4.930745248299395e-05, rel=1e-10)
    assert dist.normal_two_sided([1.2471608840283703])[0] == pytest.approx(0.2123385123085692, rel=1e-10)
    assert one(spark, x=67.3003).select(dist.chi2_sf(F.col("x"), 12)).first()[0] == pytest.approx(1.021158013832758e-09, rel=1e-9)
    assert one(spark, x=50.25179295869294).select(F.exp(-F.col("x") / 2)).first()[0] == pytest.approx(1.2245085056244382e-11, rel=1e-10)


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (1.0, 0.0)], "t double, df double")
    got = [r[0] for r in df.select(dist.t_sf("t", "df")).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None


@pytest.mark.parametrize("stat,spec,p", [(-2.7088869158945093, "c", 0.0725130290791158), (-2.954080131557924, "c", 0.0394109948839663), (-3.577583321459864, "c", 0.0062043346781192),
                                         (-1.6055161977720307, "c", 0.4808219659440571), (-1.0456304112177417, "ct", 0.937651987978216)])
def test_adf_p(spark, stat, spec, p):
    assert one(spark, s=stat, k=spec).select(dist.adf_pvalue(F.col("s"), F.col("k"))).first()[0] == pytest.approx(p, rel=1e-9)


def test_adf_critical_values(spark):
    for spec, nobs, want in (("ct", 282, (-3.991236650658296, -3.4261744436988733, -3.136269148454581)), ("c", 292, (-3.4529449243622383, -2.871489553425686, -2.572071437887033))):
        got = one(spark, k=spec, n=nobs).select(*[dist.adf_crit(F.col("k"), F.col("n"), lv) for lv in ("1", "5", "10")]).first()
        assert np.allclose(got, want, rtol=1e-12)


def test_kpss_p_and_schwert(spark):
    row = one(spark, a=0.5494997245718586, b=0.0791220186869062, c=2.3541818373875545, k="c", n=298)
    p = row.select(*[dist.kpss_pvalue(F.col(x), F.col("k")) for x in "abc"], *[dist.kpss_clamped(F.col(x), F.col("k")) for x in "abc"], stationarity.schwert_lag(F.col("n"))).first()
    assert p[0] == pytest.approx(0.0305180800513832, rel=1e-10) and p[1] == 0.10 and p[2] == 0.01
    assert list(p[3:6]) == [False, True, True] and p[6] == 15


def test_pacf_recursion():
    assert describe.partial_from_acf(np.array([1, 0.19049, -0.00289]))[2] == pytest.approx(-0.04065, abs=5e-6)


def test_chow_f_from_residual_sums():
    assert ((485.4022067476403 - 412.8971926056802) / 5) / (412.8971926056802 / 276) == pytest.approx(9.693155711180635, rel=1e-12)


def test_quadrants(spark):
    df = spark.createDataFrame([(0.01, 0.10), (0.3, 0.01), (0.01, 0.01), (0.3, 0.1), (None, 0.1)], "a double, k double")
    got = [r[0] for r in df.select(stationarity.classify_quadrant(F.col("a"), F.col("k"))).collect()]
    assert got == ["Stationary", "Non-stationary", "Trend-stationary (conflict)", "Inconclusive", "Error"]


def test_target_form_rules(spark):
    good, bad, mixed = "Stationary", "Non-stationary", "Trend-stationary (conflict)"
    rows = [(good, bad, bad, bad, bad), (bad, good, bad, bad, bad), (bad, bad, good, good, good), (bad, bad, good, bad, good), (mixed, mixed, bad, bad, bad), (mixed, bad, bad, bad, bad), (bad, bad, bad, bad, bad)]
    df = spark.createDataFrame(rows, "full_yoy string, full_log string, full_diff string, pre_yoy string, post_yoy string").coalesce(1)
    got = [r.form for r in stationarity.decide_target_form(df).collect()]
    assert got == ["yoy_pct", "log_diff_pct", "yoy_pct_with_regime_dummy", "first_diff", "log_diff_pct_with_caveat", "yoy_pct_with_caveat", "yoy_pct_with_regime_dummy"]


def test_strip_suffix_and_unknown_transform(spark):
    df = spark.createDataFrame([("yoy_pct_with_regime_dummy",), ("first_diff_with_caveat",), ("level_with_linear_trend",), ("level",)], "f string")
    assert [r[0] for r in df.select(transform.strip_suffix("f")).collect()] == ["yoy_pct", "first_diff", "level", "level"]
    long = spark.createDataFrame([("a", "X", dt.date(2000, 1, 1), 1.0)], "entity string, indicator string, ts date, value double")
    with pytest.raises(Exception, match="unknown transform"):
        transform.apply_transform(long, spark.createDataFrame([("a", "X", "cube")], "entity string, indicator string, form string")).collect()


def test_hln_rmse_and_mase(spark):
    n = one(spark, a=58, b=100, h1=1, h3=3)
    got = n.select(evaluate.hln_factor(F.col("a"), F.col("h1")), evaluate.hln_factor(F.col("b"), F.col("h3"))).first()
    assert got[0] == pytest.approx(math.sqrt(57 / 58)) and got[1] == pytest.approx(math.sqrt((101 - 6 + 6 / 100) / 100))
    toy = spark.createDataFrame(list(zip((1.0, 2.0, 3.0, 4.0, 5.0), (1.1, 1.9, 3.2, 3.8, 5.1))), "y_true double, y_pred double").withColumn("entity", F.lit("a"))
    e = evaluate.errors(toy)
    assert e.select(evaluate.rmse(F.col("e")), evaluate.mae(F.col("e"))).first()[:] == pytest.approx((math.sqrt(0.022), 0.14))
    scale = spark.createDataFrame([("a", 0.5)], "entity string, scale double")
    assert evaluate.mase(e, scale, ["entity"]).first().mase == pytest.approx(0.28)
    with pytest.raises(Exception, match="positive"):
        evaluate.mase(e, scale.withColumn("scale", F.lit(0.0)), ["entity"]).collect()


def test_winner_labels(spark):
    df = spark.createDataFrame([(-2.5, 0.014), (2.5, 0.014), (2.5, 0.5), (None, None)], "s double, p double")
    got = [r[0] for r in df.select(evaluate.winner(F.col("s"), F.col("p"), F.lit("one"), F.lit("two"))).collect()]
    assert got == ["one", "two", "tie", "undefined"]


def test_cell_manifest_has_25_cells(spark):
    ents = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "entity string")
    pairs = [("u", "v"), ("u", "r"), ("v", "r")]
    cells = evaluate.cell_manifest(ents, pairs, ("v", "r"), (1, 3, 6, 12), "primary", [("A", "secondary", 1, "u", "r", "second_form")])
    counts = {r.scope: r["count"] for r in cells.groupBy("scope").count().collect()}
    assert counts == {"primary_h1": 12, "primary_multi": 12, "second_form": 1}


def test_order_selection_prefers_converged_then_fewer_parameters(spark):
    rows = [("x", 0, 0, 3, 0, 0, 2, 12, 6, 340.0, 1.0, 1.0, True), ("x", 0, 0, 4, 2, 0, 3, 12, 10, 329.6, 2.0, 2.0, True), ("x", 1, 0, 0, 0, 0, 0, 12, 2, 329.6, 3.0, 3.0, True), ("x", 4, 0, 4, 0, 0, 0, 12, 9, 100.0, 9.0, 9.0, False)]
    grid = spark.createDataFrame(rows, "variant_id string, p long, d long, q long, P_s long, D_s long, Q_s long, s long, n_params long, aic double, bic double, hqic double, converged boolean")
    got = select_order(grid).first()
    assert got.aic_order == "(1,0,0)(0,0,0,12)" and got.bic_order == "(0,0,3)(0,0,2,12)" and not got.aic_bic_agree and got.n_converged == 3
    fits = grid.withColumn("is_original", F.col("q") == 3).withColumn("text", order_string())
    verdict = boundary_verdict(fits).first()
    assert verdict.verdict == "extend" and verdict.delta_aic == pytest.approx(-10.4)


def test_sup_wald_critical_values():
    assert breaks.SUP_F_CRIT[0.15][4] == (16.19, 18.48, 22.53) and breaks.SUP_F_CRIT[0.10][0] == (7.37, 9.03, 12.45)
    assert all(len(v) == 7 for v in breaks.SUP_F_CRIT.values())
