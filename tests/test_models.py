"""Model operators against direct numpy computation on small generated panels."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import breaks, evaluate, ridge, sarma, stationarity, var
from panelspark.operators.gram import gram, hac_fit


def months(n, start=1990):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    out = []
    for k, e in enumerate(("a", "b")):
        n = 90
        x1, x2 = rng.normal(size=n).cumsum() * 0.3, rng.normal(size=n)
        u = np.zeros(n)
        for t in range(1, n):
            u[t] = 0.4 * u[t - 1] + rng.normal()
        y = 1 + k + 0.5 * x1 - 0.8 * x2 + np.where(np.arange(n) >= 45, 1.5 * x2, 0) + u
        out.append(pd.DataFrame({"entity": e, "ts": months(n), "y": y, "x1": x1, "x2": x2}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def panel(spark, frame):
    return spark.createDataFrame(frame, "entity string, ts date, y double, x1 double, x2 double")


def direct_hac(x, y, lags=4):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    z = x * (y - x @ b)[:, None]
    s = z.T @ z
    for k in range(1, lags + 1):
        c = z[k:].T @ z[:-k]
        s += (1 - k / (lags + 1)) * (c + c.T)
    inv = np.linalg.inv(x.T @ x)
    return b, inv @ s @ inv


def chow_wald(d, at):
    x = np.column_stack([np.ones(len(d)), d.x1, d.x2])
    post = (np.arange(len(d)) >= at)[:, None]
    b, v = direct_hac(np.hstack([x, x * post]), d.y.to_numpy())
    return b[3:] @ np.linalg.solve(v[3:, 3:], b[3:]) / 3


def test_gram_forms_agree(spark, panel):
    cols = ["y", "x1", "x2"]
    narrow = {r.entity: r.g for r in gram(panel, ["entity"], cols).collect()}
    many = panel.select("*", *[(F.col("x1") * i + F.col("x2")).alias(f"w{i}") for i in range(9)])
    wide = {r.entity: r.g for r in gram(many, ["entity"], [*cols, *[f"w{i}" for i in range(9)]]).collect()}
    for e, g in narrow.items():
        assert np.allclose(g[:3], wide[e][:3])


def test_hac_and_chow(panel, frame):
    got = {r.entity: r for r in hac_fit(panel.withColumn("const", F.lit(1.0)), ["entity"], "y", ["const", "x1", "x2"]).collect()}
    day = months(90)[45]
    wald = {r.entity: r.F for r in breaks.chow_hac(panel, "y", ["x1", "x2"], [("B", day)]).collect()}
    for e, d in frame.groupby("entity"):
        b, v = direct_hac(np.column_stack([np.ones(len(d)), d.x1, d.x2]), d.y.to_numpy())
        assert np.allclose(got[e].beta, b) and np.allclose(np.reshape(got[e].cov, (3, 3)), v)
        assert wald[e] == pytest.approx(chow_wald(d, 45), rel=1e-8)


def test_coef_shift(panel, frame):
    day = months(90)[45]
    rows = {(r.entity, r.variable): r for r in breaks.coef_shift(panel, "y", ["x1", "x2"], [("B", day)]).collect()}
    for e, d in frame.groupby("entity"):
        x = np.column_stack([np.ones(len(d)), d.x1, d.x2])
        (b0, v0), (b1, v1) = direct_hac(x[:45], d.y.to_numpy()[:45]), direct_hac(x[45:], d.y.to_numpy()[45:])
        r = rows[e, "x2"]
        assert r.delta == pytest.approx(b1[2] - b0[2]) and r.se_delta == pytest.approx(np.hypot(v0[2, 2] ** 0.5, v1[2, 2] ** 0.5))


def test_small_side_has_error_and_nulls(panel):
    row = breaks.chow_classical(panel, "y", ["x1", "x2"], [("B", months(90)[2])]).first()
    assert row.F is None and row.p_value is None and "too small" in row.error


def test_scan_equals_direct_chow(panel, frame):
    scan = {(r.entity, r.candidate_date): r.wald_f for r in breaks.sup_wald_scan(panel, "y", ["x1", "x2"]).collect()}
    for e, d in frame.groupby("entity"):
        x, y = np.column_stack([np.ones(len(d)), d.x1, d.x2]), d.y.to_numpy()
        def rss(i, j):
            return np.linalg.lstsq(x[i:j], y[i:j], rcond=None)[1][0]
        lo, hi = int(np.ceil(0.15 * 90)), int(np.floor(0.85 * 90))
        assert sum(1 for k in scan if k[0] == e) == hi - lo + 1
        for at in (lo, 45, hi):
            free = rss(0, at) + rss(at, 90)
            assert scan[e, months(90)[at]] == pytest.approx(((rss(0, 90) - free) / 3) / (free / 84), rel=1e-8)


@pytest.mark.parametrize("xs", [["x1"], ["x1", "x2"]])
def test_robust_scan_equals_wald_at_every_date(panel, frame, xs):
    scan = {(r.entity, r.candidate_date): r.wald_f for r in breaks.robust_sup_wald_scan(panel, "y", xs).collect()}
    assert len(scan) == 2 * (int(np.floor(0.85 * 90)) - int(np.ceil(0.15 * 90)) + 1)
    k = len(xs) + 1
    for e, d in frame.groupby("entity"):
        x = np.column_stack([np.ones(len(d)), d[xs]])
        for at in range(14, 77):
            post = (np.arange(90) >= at)[:, None]
            b, v = direct_hac(np.hstack([x, x * post]), d.y.to_numpy())
            assert scan[e, months(90)[at]] == pytest.approx(b[k:] @ np.linalg.solve(v[k:, k:], b[k:]) / k, rel=1e-6)


def direct_adf(v, spec):
    n = len(v)
    maxlag = max(1, int(np.floor(12 * (n / 100) ** 0.25)))
    dv = np.diff(v)

    def run(p, cut):
        t = np.arange(cut, len(dv))
        cols = [np.ones(len(t))] + ([t + 2.0] if spec == "ct" else []) + [v[t]] + [dv[t - j] for j in range(1, p + 1)]
        x = np.column_stack(cols)
        b, *_ = np.linalg.lstsq(x, dv[t], rcond=None)
        e = dv[t] - x @ b
        return x, b, e

    best = min(range(maxlag + 1), key=lambda p: (lambda x, b, e: len(e) * (np.log(2 * np.pi * e @ e / len(e)) + 1) + 2 * x.shape[1])(*run(p, maxlag)))
    x, b, e = run(best, best)
    at = 2 if spec == "ct" else 1
    return b[at] / np.sqrt(e @ e / (len(e) - x.shape[1]) * np.linalg.inv(x.T @ x)[at, at]), best, len(e)


def direct_kpss(v, spec):
    n = len(v)
    t = np.arange(n)
    e = v - (np.polyval(np.polyfit(t, v, 1), t) if spec == "ct" else v.mean())
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cov + 1):
        p = e[i:] @ e[:-i] / (n / 2)
        s0, s1 = s0 + p, s1 + i * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = e @ e
    for i in range(1, lags + 1):
        lrv += 2 * (e[i:] @ e[:-i]) * (1 - i / (lags + 1))
    return (np.cumsum(e) ** 2).sum() / n ** 2 / (lrv / n), lags


@pytest.mark.parametrize("spec", ["c", "ct"])
def test_unit_root_tests_equal_direct_computation(spark, frame, spec):
    long = frame.melt(["entity", "ts"], ["y", "x1", "x2"], "indicator", "value")
    over = frame.assign(indicator="dd", value=frame.groupby("entity").x2.diff().diff())[["entity", "ts", "indicator", "value"]].dropna()
    long = pd.concat([long, over])
    df = spark.createDataFrame(long[["entity", "indicator", "ts", "value"]], "entity string, indicator string, ts date, value double").withColumn("spec", F.lit(spec))
    got = {(r.entity, r.indicator): r for r in stationarity.test_series(df, ["entity", "indicator"]).collect()}
    assert len(got) == 8
    for (e, i), d in long.groupby(["entity", "indicator"]):
        v = d.sort_values("ts").value.to_numpy()
        stat, lag, nobs = direct_adf(v, spec)
        r = got[e, i]
        assert (r.adf_usedlag, r.adf_nobs) == (lag, nobs) and r.adf_stat == pytest.approx(stat, rel=1e-6)
        k, lags = direct_kpss(v, spec)
        assert r.kpss_lags == lags and r.kpss_stat == pytest.approx(k, rel=1e-8)


def test_short_series_is_an_error_row(spark):
    df = spark.createDataFrame([("a", t, float(i % 3)) for i, t in enumerate(months(8))], "entity string, ts date, value double").withColumn("spec", F.lit("c"))
    row = stationarity.test_series(df, ["entity"]).first()
    assert row["class"] == "Error" and row.adf_stat is None and row.small_sample and row.very_small


def direct_ridge(x, y, a):
    m, s = x.mean(0), x.std(0)
    live = s > 1e-9
    s = np.where(live, s, 1.0)
    z = (x - m) / s
    w = np.zeros(x.shape[1])
    w[live] = np.linalg.solve(z[:, live].T @ z[:, live] + a * np.eye(live.sum()), z[:, live].T @ (y - y.mean()))
    return w, m, s, y.mean()


def test_ridge_fit_constant_column_and_cv(spark, panel, frame):
    xs = ["x1", "x2", "k"]
    df = panel.withColumn("k", F.lit(2.0))
    got = {(r.entity, r.feature): r.coef for r in ridge.ridge_fit(df, xs, "y", 3.0).collect()}
    cv = {(r.entity, r.alpha, r.fold): r for r in ridge.alpha_cv(df, xs, "y", [0.1, 10.0]).collect()}
    for e, d in frame.groupby("entity"):
        x, y = np.column_stack([d.x1, d.x2, np.full(90, 2.0)]), d.y.to_numpy()
        w = direct_ridge(x, y, 3.0)[0]
        assert np.allclose([got[e, c] for c in xs], w) and got[e, "k"] == 0.0
        for a in (0.1, 10.0):
            for i in range(1, 6):
                cut = 90 - (6 - i) * 15
                w, m, s, b = direct_ridge(x[:cut], y[:cut], a)
                val = y[cut:cut + 15] - (b + ((x[cut:cut + 15] - m) / s) @ w)
                r = cv[e, a, i]
                assert (r.n_train, r.n_val) == (cut, 15) and r.val_mse == pytest.approx((val ** 2).mean(), rel=1e-8)


def test_fold_sizes_for_215_rows(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in months(215, 1980)], "entity string, ts date, v double")
    rows = ridge.time_series_folds(df).orderBy("fold").collect()
    assert [(r.n_train, r.n_val) for r in rows] == [(40, 35), (75, 35), (110, 35), (145, 35), (180, 35)]


def test_direct_walk_forward(panel, frame):
    start = months(90)[60]
    got = {(r.entity, r.h, r.origin_date): r for r in ridge.direct_walk_forward(panel, ["x1", "x2"], "y", 2.0, start, (1, 6)).collect()}
    assert len(got) == 2 * 2 * (90 - 6 - 60)
    for e, d in frame.groupby("entity"):
        x, y = d[["x1", "x2"]].to_numpy(), d.y.to_numpy()
        for h in (1, 6):
            for o in (60, 75, 83):
                last = o - h + 1
                w, m, s, b = direct_ridge(x[:last], y[h:last + h], 2.0)
                r = got[e, h, months(90)[o]]
                assert r.n_train == last and r.y_pred == pytest.approx(b + ((x[o] - m) / s) @ w, rel=1e-8)
                assert r.y_true == pytest.approx(y[o + h]) and r.y_naive == pytest.approx(y[o])


def direct_var(v, p, exog=None):
    rows = [np.concatenate([[1.0], *[v[t - k] for k in range(1, p + 1)], *( [exog[t]] if exog is not None else [])]) for t in range(p, len(v))]
    x = np.array(rows)
    b, *_ = np.linalg.lstsq(x, v[p:], rcond=None)
    return x, b


def test_var_fit_walk_forward_and_lags(panel, frame):
    endog, p = ["y", "x1"], 2
    models = {r.entity: r for r in var.fit(panel, endog, p, ["x2"]).collect()}
    start = months(90)[70]
    walk = {(r.entity, r.variable, r.h, r.origin_date): r for r in var.walk_forward(panel, endog, p, ["x2"], start, (1, 3)).collect()}
    table = {(r.entity, r.lag): r for r in var.lag_selection(panel, endog, 4).collect()}
    for e, d in frame.groupby("entity"):
        v, ex = d[endog].to_numpy(), d[["x2"]].to_numpy()
        x, b = direct_var(v, p, ex)
        m = models[e]
        assert np.allclose(np.reshape(m.coefs, (6, 2)), b)
        r = v[p:] - x @ b
        assert np.abs(x.T @ r).max() < 1e-6 and np.allclose(np.reshape(m.sigma, (2, 2)), r.T @ r / (88 - 6))
        for o in (70, 80):
            _, bo = direct_var(v[:o + 1], p, ex[:o + 1])
            hist = [v[o - 1], v[o]]
            for h in range(1, 4):
                hist.append(np.concatenate([[1.0], hist[-1], hist[-2], ex[o + h]]) @ bo)
            got = walk[e, "y", 3, months(90)[o]]
            assert got.forecast == pytest.approx(hist[-1][0], rel=1e-8) and got.actual == pytest.approx(v[o + 3, 0])
        for lag in range(5):
            xl = np.array([np.concatenate([[1.0], *[v[t - k] for k in range(1, lag + 1)]]) for t in range(4, 90)])
            bl, *_ = np.linalg.lstsq(xl, v[4:], rcond=None)
            s = (v[4:] - xl @ bl).T @ (v[4:] - xl @ bl) / 86
            assert table[e, lag].aic == pytest.approx(np.linalg.slogdet(s)[1] + 2 * xl.shape[1] * 2 / 86, rel=1e-9)
        assert sum(table[e, lag].selected_bic for lag in range(5)) == 1


def test_irf_fevd_granger_and_bands(spark, panel):
    endog, p = ["y", "x1", "x2"], 1
    models = var.fit(panel, endog, p)
    m = {r.entity: r for r in models.collect()}
    rows = var.irf(models, endog, p, 12).toPandas()
    for e, d in rows.groupby("entity"):
        b = np.reshape(m[e].coefs, (4, 3))
        chol = np.linalg.cholesky(np.reshape(m[e].sigma, (3, 3)))
        want = np.linalg.matrix_power(b[1:].T, 5) @ chol
        got = d[d.horizon == 5].pivot(index="response", columns="shock", values="irf").loc[endog, endog].to_numpy()
        assert np.allclose(got, want)
    shares = var.fevd(var.irf(models, endog, p, 12)).groupBy("entity", "response", "horizon").agg(F.sum("share").alias("s")).toPandas()
    assert np.allclose(shares.s, 1.0)
    g = var.granger_matrix(models, endog, p).toPandas()
    assert len(g) == 18 and g[g.diagonal].f_stat.isna().all() and (g[~g.diagonal].df2 == 3 * (89 - 4)).all()
    a = var.irf_bands(panel, endog, p, (), 4, 60).toPandas().sort_values(["entity", "horizon", "response", "shock"]).reset_index(drop=True)
    again = var.irf_bands(panel.repartition(3), endog, p, (), 4, 60).toPandas().sort_values(["entity", "horizon", "response", "shock"]).reset_index(drop=True)
    assert np.allclose(a.lower, again.lower) and (a.lower <= a.upper).all()
    diag = a[(a.horizon == 0) & (a.response == a.shock)]
    assert ((diag.lower <= diag.irf * 1.05) & (diag.upper >= diag.irf * 0.8)).all()


def test_order_grid_sub_blocks_and_expanding_forecasts(spark):
    rng = np.random.default_rng(5)
    n, season = 160, 4
    y = np.zeros(n)
    e = rng.normal(size=n)
    for t in range(1, n):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    df = spark.createDataFrame([("v", t, float(v)) for t, v in zip(months(n), y)], "variant_id string, ts date, y double")
    grid = {(r.p, r.q, r.P_s, r.D_s, r.Q_s): r for r in sarma.fit_order_grid(df, season, 6, p=3, q=3).collect()}
    assert len(grid) == 288 and all(r.converged for r in grid.values())
    x = np.column_stack([np.ones(n - 6), *[y[6 - k:n - k] for k in range(1, 7)]])
    b, *_ = np.linalg.lstsq(x, y[6:], rcond=None)
    res = np.concatenate([np.full(6, np.nan), y[6:] - x @ b])
    first = 6 + 8
    cols = np.column_stack([np.ones(n - first), y[first - 1:n - 1], y[first - 4:n - 4], res[first - 1:n - 1]])
    b2, *_ = np.linalg.lstsq(cols, y[first:], rcond=None)
    rss = ((y[first:] - cols @ b2) ** 2).sum()
    llf = -(n - first) / 2 * (np.log(2 * np.pi * rss / (n - first)) + 1)
    assert grid[1, 1, 1, 0, 0].llf == pytest.approx(llf, rel=1e-9) and grid[1, 1, 1, 0, 0].n_params == 4
    orders = spark.createDataFrame([("v", 1, 0, 0, 0, 0)], "variant_id string, p long, q long, P_s long, D_s long, Q_s long")
    walk = {r.ts: r for r in sarma.expanding_one_step(df, orders, season, 6, months(n)[120], p=3, q=3).collect()}
    assert len(walk) == 40
    for t in (120, 150):
        c = np.column_stack([np.ones(t - first), y[first - 1:t - 1]])
        bb, *_ = np.linalg.lstsq(c, y[first:t], rcond=None)
        assert walk[months(n)[t]].predicted == pytest.approx(bb @ [1, y[t - 1]], rel=1e-8)


def forecasts(spark, pred, h=1):
    n = len(next(iter(pred.values())))
    rng = np.random.default_rng(9)
    y = rng.normal(size=n)
    rows = [(k, "a", "f", h, t, t, float(y[i]), float(y[i] - p[i])) for k, p in pred.items() for i, t in enumerate(months(n))]
    return spark.createDataFrame(rows, "layer string, entity string, form string, h long, origin_date date, target_date date, y_true double, y_pred double")


def test_dm_properties(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=100), rng.normal(size=100) * 2.5
    same = evaluate.dm_tests(evaluate.align_matched(forecasts(spark, {"one": a, "two": a}), [("one", "two")])).first()
    assert (same.dm_standard, same.p_standard, same.dm_robust) == (0.0, 1.0, 0.0)
    r = evaluate.dm_tests(evaluate.align_matched(forecasts(spark, {"one": a, "two": b}), [("one", "two")])).first()
    assert r.dm_standard < -2
    assert r.dm_hac / r.dm_standard == pytest.approx(np.sqrt(100 / 99))
    d = a ** 2 - b ** 2
    h3 = evaluate.dm_tests(evaluate.align_matched(forecasts(spark, {"one": a, "two": b}, 3), [("one", "two")])).first()
    c = d - d.mean()
    lrv = (c @ c + 2 * (2 / 3) * (c[1:] @ c[:-1]) + 2 * (1 / 3) * (c[2:] @ c[:-2])) / 100
    assert h3.lrv == pytest.approx(lrv)
    few = evaluate.dm_tests(evaluate.align_matched(forecasts(spark, {"one": a[:3], "two": b[:3]}, 3), [("one", "two")])).first()
    assert few.dm_standard is None and few.p_standard is None


def test_layers_that_disagree_on_the_actual_are_an_error(spark):
    df = forecasts(spark, {"one": np.ones(5), "two": np.zeros(5)}).withColumn("y_true", F.when(F.col("layer") == "two", F.col("y_true") + 0.1).otherwise(F.col("y_true")))
    with pytest.raises(Exception, match="disagree"):
        evaluate.align_matched(df, [("one", "two")]).collect()


def refit_both_stages(y, t, p, q, sp, sq, sd, season, long_lag, grid):
    """Forecast of y[t] from both stages fitted on rows before t; NaN marks gaps."""
    w = y.copy()
    if sd:
        w = np.concatenate([np.full(season, np.nan), y[season:] - y[:-season]])

    def lags(z, ks, at):
        return np.array([z[at - k] if at >= k else np.nan for k in ks])

    long = range(1, long_lag + 1)
    ar, ma = [*range(1, grid[0] + 1), *[season * k for k in range(1, grid[2] + 1)]], [*range(1, grid[1] + 1), *[season * k for k in range(1, grid[3] + 1)]]
    one = [i for i in range(len(w)) if not np.isnan([w[i], *lags(w, long, i)]).any()]
    x = np.array([[1.0, *lags(w, long, i)] for i in one if i < t])
    phi = np.linalg.lstsq(x, w[[i for i in one if i < t]], rcond=None)[0]
    e = np.full(len(w), np.nan)
    for i in one:
        e[i] = w[i] - phi @ [1.0, *lags(w, long, i)]
    two = [i for i in range(len(w)) if not np.isnan([w[i], *lags(w, long, i), *lags(w, ar, i), *lags(e, ma, i)]).any()]
    own = [*range(1, p + 1), *[season * k for k in range(1, sp + 1)]], [*range(1, q + 1), *[season * k for k in range(1, sq + 1)]]

    def row(i):
        return [1.0, *lags(w, own[0], i), *lags(e, own[1], i)]

    train = [i for i in two if i < t]
    if t not in two or len(train) <= len(row(t)):
        return None
    beta = np.linalg.lstsq(np.array([row(i) for i in train]), w[train], rcond=None)[0]
    return beta @ row(t) + (y[t - season] if sd else 0.0), len(train)


@pytest.mark.parametrize("span", [7, 64])
def test_both_stages_are_refitted_at_every_origin(spark, span):
    rng = np.random.default_rng(8)
    n, season, long_lag, grid = 130, 4, 5, (2, 2, 1, 1)
    orders = {"a": (1, 1, 0, 0, 0), "b": (2, 0, 1, 0, 1), "c": (1, 2, 1, 1, 1)}
    series, rows = {}, []
    for name in orders:
        y, e = np.zeros(n), rng.normal(size=n)
        for t in range(1, n):
            y[t] = 0.5 * y[t - 1] + e[t] + 0.4 * e[t - 1] + 0.02 * t
        if name == "c":
            y[[40, 41, 90]] = np.nan  # gaps before and after the first target
        series[name] = y
        rows += [(name, d, None if np.isnan(v) else float(v)) for d, v in zip(months(n), y)]
    df = spark.createDataFrame(rows, "variant_id string, ts date, y double")
    # columns of an order: p, q, seasonal p, seasonal q, seasonal difference
    table = spark.createDataFrame([(k, *v) for k, v in orders.items()], "variant_id string, p long, q long, P_s long, Q_s long, D_s long")
    got = {(r.variant_id, r.ts): r for r in sarma.expanding_one_step(df, table, season, long_lag, months(n)[80], "month", *grid, span=span).collect()}
    checked = 0
    for name, (p, q, sp, sq, sd) in orders.items():
        for t in range(80, n):
            want = refit_both_stages(series[name], t, p, q, sp, sq, sd, season, long_lag, grid)
            if want is None:
                assert (name, months(n)[t]) not in got
                continue
            r = got[name, months(n)[t]]
            assert r.predicted == pytest.approx(want[0], rel=1e-6, abs=1e-8) and r.n_train == want[1] and r.actual == pytest.approx(series[name][t])
            checked += 1
    assert checked == len(got) > 110


def test_expanding_sums_follow_blocks_and_not_rows(spark):
    from panelspark.operators.expanding import expanding, moments
    from pyspark.sql import types as T

    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("tag"), (F.col("id") % 7).cast("double").alias("x"))
    at = df.filter("tag % 10 < 2").select("k", "tag", F.col("tag").alias("again"))

    def solve(sums, totals, frame):
        return pd.DataFrame({"again": frame["again"], "n": sums[0][:, 0, 0], "s": sums[0][:, 0, 1], "q": sums[0][:, 1, 1], "all": totals[0][0, 1]})

    fields = [T.StructField("again", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("n", "s", "q", "all")]]
    out = expanding(df, ["k"], ["x"], [moments([0])], "tag", at, fields, solve, span=32)
    rows = out.collect()
    x = np.arange(1000) % 7
    assert len(rows) == 200
    for r in rows:
        own = x[np.arange(r.k, r.again + 1, 2)]
        assert (r.n, r.s, r.q, r["all"]) == (len(own), own.sum(), (own ** 2).sum(), x[r.k::2].sum())
    # one exchange carries the rows; the sums that go from blocks to keys are one row per block
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FlatMapGroupsInPandas") == 1 and "ReusedExchange" in plan and "posexplode" not in plan


def test_order_residuals_are_those_of_the_fit(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=120).cumsum()
    df = spark.createDataFrame([("v", t, float(v)) for t, v in zip(months(120), y)], "variant_id string, ts date, y double")
    orders = spark.createDataFrame([("v", 2, 0, 0, 0, 0)], "variant_id string, p long, q long, P_s long, D_s long, Q_s long")
    got = sarma.order_residuals(df, orders, 4, 6, p=3, q=3).orderBy("ts").collect()
    first = 6 + 8
    x = np.column_stack([np.ones(120 - first), y[first - 1:119], y[first - 2:118]])
    b, *_ = np.linalg.lstsq(x, y[first:], rcond=None)
    assert np.allclose([r.e for r in got], y[first:] - x @ b)


def test_bands_with_exogenous_columns_equal_a_loop(spark, panel, frame):
    endog, p, horizon, reps = ["y", "x1"], 1, 3, 40
    got = var.irf_bands(panel, endog, p, ["x2"], horizon, reps).toPandas()
    seeds = {(r.entity, r.ts): r.s for r in panel.select("entity", "ts", F.xxhash64("entity", "ts", F.lit(7)).alias("s")).collect()}
    for e, d in frame.groupby("entity"):
        v, ex = d[endog].to_numpy(), d[["x2"]].to_numpy()
        x, b = direct_var(v, p, ex)
        r = v[p:] - x @ b
        draws = []
        for rep in range(reps):
            sign = []
            for ts in d.ts.iloc[p:]:
                m = (np.uint64(seeds[e, ts] & (2 ** 64 - 1)) ^ np.uint64(rep * 0x9E3779B97F4A7C15 & (2 ** 64 - 1)))
                m = int(m) * 0xBF58476D1CE4E5B9 & (2 ** 64 - 1)
                m = (m ^ (m >> 31)) * 0x94D049BB133111EB & (2 ** 64 - 1)
                sign.append(1.0 if m >> 63 else -1.0)
            ystar = x @ b + r * np.array(sign)[:, None]
            bs, *_ = np.linalg.lstsq(x, ystar, rcond=None)
            es = ystar - x @ bs
            chol = np.linalg.cholesky(es.T @ es / (len(x) - x.shape[1]))
            draws.append([np.linalg.matrix_power(bs[1:3].T, h) @ chol for h in range(horizon + 1)])
        low, high = np.quantile(draws, [0.025, 0.975], axis=0)
        for row in got[got.entity == e].itertuples():
            i, j = endog.index(row.response), endog.index(row.shock)
            assert row.lower == pytest.approx(low[row.horizon, i, j], abs=1e-8) and row.upper == pytest.approx(high[row.horizon, i, j], abs=1e-8)


def test_matching_guards(spark):
    a, b = np.ones(40), np.zeros(40)
    df = forecasts(spark, {"one": a, "two": b})
    assert evaluate.align_matched(df, [("one", "two")]).count() == 40
    with pytest.raises(Exception, match="several forecasts of layer one"):
        evaluate.align_matched(df.union(df.filter("layer = 'one'").limit(1)), [("one", "two")]).collect()
    with pytest.raises(Exception, match="no rows for any pair"):
        evaluate.align_matched(df, [("one", "three")]).collect()


def test_chow_with_a_period_dummy(panel, frame):
    day, period = months(90)[45], (months(90)[20], months(90)[50])
    rows = {r.entity: r for r in breaks.chow_hac(panel, "y", ["x1", "x2"], [("B", day), ("late", dt.date(2050, 1, 1))], nuisance=period).collect() if r.break_name == "B"}
    for e, d in frame.groupby("entity"):
        x = np.column_stack([np.ones(90), d.x1, d.x2])
        inside = ((np.arange(90) >= 20) & (np.arange(90) <= 50)).astype(float)[:, None]
        b, v = direct_hac(np.hstack([x, x * (np.arange(90) >= 45)[:, None], inside]), d.y.to_numpy())
        r = rows[e]
        assert r.F == pytest.approx(b[3:6] @ np.linalg.solve(v[3:6, 3:6], b[3:6]) / 3, rel=1e-7)
        assert r.period_coef == pytest.approx(b[6], rel=1e-7) and r.period_se == pytest.approx(v[6, 6] ** 0.5, rel=1e-7)
        assert (r.n_total, r.n_pre, r.df_denom) == (90, 45, 90 - 7)


def test_breaks_beyond_the_data_are_small_samples(panel):
    rows = breaks.chow_hac(panel, "y", ["x1"], [("early", dt.date(1900, 1, 1)), ("late", dt.date(2050, 1, 1)), ("B", months(90)[45])]).collect()
    for r in rows:
        assert (r.F is None) == (r.break_name != "B") == ("too small" in (r.error or ""))
    assert {r.break_name for r in breaks.coef_shift(panel, "y", ["x1"], [("late", dt.date(2050, 1, 1)), ("B", months(90)[45])]).collect()} == {"B"}


@pytest.mark.parametrize("rank", ["full", "lost"])
def test_nested_sums_of_one_factor(rank):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6))
    if rank == "lost":
        x[:, 4] = 2 * x[:, 1]
    z = np.column_stack([x, rng.normal(size=50)])
    got = stationarity.nested_rss(z.T @ z, range(6), 6)
    want = [((z[:, 6] - x[:, :i] @ np.linalg.lstsq(x[:, :i], z[:, 6], rcond=None)[0]) ** 2).sum() for i in range(1, 7)]
    assert np.allclose(got, want)


def test_adf_with_a_given_longest_lag(spark, frame):
    df = spark.createDataFrame(frame[["entity", "ts", "y"]], "entity string, ts date, value double").withColumn("spec", F.lit("c"))
    rows = {r.entity: r for r in stationarity.adf(df, ["entity"], maxlag=0).collect()}
    for e, d in frame.groupby("entity"):
        v = d.y.to_numpy()
        x = np.column_stack([np.ones(89), v[:-1]])
        b, *_ = np.linalg.lstsq(x, np.diff(v), rcond=None)
        r = np.diff(v) - x @ b
        assert rows[e].adf_stat == pytest.approx(b[1] / np.sqrt(r @ r / 87 * np.linalg.inv(x.T @ x)[1, 1])) and rows[e].adf_usedlag == 0
