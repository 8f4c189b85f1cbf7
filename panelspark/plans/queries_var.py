"""Registered queries: vector-autoregression layer.

With one variable and one lag the model is a simple regression, which SQL can check end to end; those runs are
registered beside the five-variable ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import var
from panelspark.operators.clean import densify
from panelspark.operators.features import regime_matrix
from panelspark.plans.catalog import query
from panelspark.plans.oracle import chi2_even, define, r
from panelspark.plans.panels import BREAKS, HORIZONS, INDICATORS, PERIODS, TARGET, TEST_START, region_panel
from panelspark.plans.queries_evaluate import scale
from panelspark.plans.queries_features import EXOG, PAIRS, base, spec
from panelspark.plans.standins import forecasts

ENDOG = list(INDICATORS)
P = 2
MAXLAG = 6
H = 24


def panel(t):
    return base(t)


def with_exog(t):
    return regime_matrix(base(t), BREAKS, PERIODS, spec(t), PAIRS, keep=("entity", "ts", *INDICATORS))


def level(t):
    return densify(region_panel(t).select("entity", "ts", TARGET))


def model(t, p=P):
    return var.fit(with_exog(t), ENDOG, p, EXOG)


def ar(t):
    return var.fit(level(t), [TARGET], 1)


define("arr", "SELECT entity, ts, REVENUE AS y, lag(REVENUE) OVER w AS x, row_number() OVER w - 1 AS rn FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts)")
define("arm", "SELECT entity, count(*) AS n, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss, regr_syy(y, x) AS tss, regr_sxx(y, x) AS sxx, sum(x * x) AS xx FROM arr WHERE x IS NOT NULL GROUP BY 1")
define("aric", " UNION ALL ".join(
    f"SELECT entity, {p} AS lag, n, ln({s} / n) + 2.0 * {k} / n AS aic, ln({s} / n) + ln(n) * {k} / n AS bic, ln({s} / n) + 2 * ln(ln(n)) * {k} / n AS hqic, (n + {k})::DOUBLE / (n - {k}) * ({s} / n) AS fpe FROM arm" for p, s, k in ((0, "tss", 1), (1, "rss", 2))))
_ic = ", ".join(f"{r(c)} AS {c}" for c in var.CRITERIA)
_sel = ", ".join(f"arg_min(lag, {c}) OVER (PARTITION BY entity) = lag AS selected_{c}" for c in var.CRITERIA)
query("i01_var_lag_selection_one_variable", f"SELECT entity, CAST(lag AS BIGINT) AS lag, n AS n_obs, {_ic}, {_sel} FROM aric")(lambda t: var.lag_selection(level(t), [TARGET], 1))


def table(t):
    return var.lag_selection(panel(t), ENDOG, MAXLAG)


query("i01_var_lag_selection")(table)
query("i02_lag_extension")(lambda t: var.lag_extension(table(t), 3))
query("i02_lag_deltas")(lambda t: var.lag_deltas(table(t), 3))
query("i03_var_fit")(lambda t: model(t).drop("inv"))
query("i03_var_fit_one_variable", f"SELECT entity, n AS n_obs, {r('c')} AS intercept, {r('phi')} AS phi, {r('rss / (n - 2)')} AS sigma, {r('-(n / 2.0) * ln(2 * pi()) - n / 2.0 * (ln(rss / n) + 1)')} AS loglik FROM arm")(
    lambda t: ar(t).select("entity", "n_obs", F.col("coefs")[0].alias("intercept"), F.col("coefs")[1].alias("phi"), F.col("sigma")[0].alias("sigma"), "loglik"))
query("i04_coef_table")(lambda t: var.coef_table(model(t), ENDOG, P, EXOG))
_se = "sqrt(rss / (n - 2) / sxx)"
query("i04_coef_table_one_variable", f"SELECT entity, 'REVENUE' AS equation, 'REVENUE_L1' AS regressor, {r('phi')} AS coef, {r(_se)} AS std_err, {r(f'phi / {_se}')} AS t_stat, {r(f'phi - 1.96 * {_se}')} AS ci_lo, {r(f'phi + 1.96 * {_se}')} AS ci_hi FROM arm")(
    lambda t: var.coef_table(ar(t), [TARGET], 1).filter("regressor <> 'const'").drop("p_value", "significant"))
query("i05_equation_diagnostics")(lambda t: var.equation_diagnostics(var.residuals(with_exog(t), model(t), ENDOG, P, EXOG)))
define("are", "SELECT entity, ts, rn, y - c - phi * x AS e FROM arr JOIN arm USING (entity) WHERE x IS NOT NULL")
define("areq", "SELECT a.entity, m, any_value(q.n) AS n, any_value(q.n) * (any_value(q.n) + 2) * sum(g * g / (q.n - k)) AS q FROM (SELECT a.entity, k, sum(a.e * b.e) / any_value(s) AS g FROM are a JOIN are b ON a.entity = b.entity JOIN range(1, 25) k(k) ON a.rn = b.rn + k "
       "JOIN (SELECT entity AS e0, sum(e * e) AS s FROM are GROUP BY 1) ON e0 = a.entity GROUP BY 1, 2) a JOIN (VALUES (12), (24)) v(m) ON k <= m JOIN arm q ON q.entity = a.entity GROUP BY 1, 2")
_lb = ", ".join(f"{r(f'max(CASE WHEN m = {m} THEN q END)')} AS lb{m}_stat, {r(f'max(CASE WHEN m = {m} THEN ' + chi2_even('q', m) + ' END)')} AS lb{m}_p, max(CASE WHEN m = {m} THEN {chi2_even('q', m)} END) < 0.05 AS lb{m}_reject" for m in (12, 24))
query("i05_equation_diagnostics_one_variable", f"SELECT * FROM (SELECT entity, 'REVENUE' AS equation, count(*) AS n, {r('avg(e)')} AS mean, {r('stddev_samp(e)')} AS sd, {r('min(e)')} AS min_value, {r('max(e)')} AS max_value FROM are GROUP BY 1) JOIN (SELECT entity, {_lb} FROM areq GROUP BY 1) USING (entity)")(
    lambda t: var.equation_diagnostics(var.residuals(level(t), ar(t), [TARGET], 1)))
query("i06_stability")(lambda t: var.stability(model(t), ENDOG, P))
query("i06_stability_one_variable", f"SELECT entity, CAST(0 AS BIGINT) AS root_index, {r('1 / phi')} AS root_real, 0.0::DOUBLE AS root_imag, abs(phi) < 1 AS is_stable, {r('abs(1 / phi)')} AS modulus FROM arm")(lambda t: var.stability(ar(t), [TARGET], 1))
query("i07_fit_summary")(lambda t: var.fit_summary(model(t), var.stability(model(t), ENDOG, P), var.equation_diagnostics(var.residuals(with_exog(t), model(t), ENDOG, P, EXOG)), EXOG))
query("i08_whiteness_compare")(lambda t: var.whiteness_compare(var.equation_diagnostics(var.residuals(with_exog(t), model(t, 1), ENDOG, 1, EXOG)), var.equation_diagnostics(var.residuals(with_exog(t), model(t), ENDOG, P, EXOG))))


def granger(t):
    return var.granger_matrix(model(t), ENDOG, P)


query("i09_granger_matrix")(granger)
query("i10_granger_target_panel")(lambda t: var.granger_target(granger(t), TARGET))
query("i11_granger_summary")(lambda t: var.granger_summary(granger(t)))
query("i12_irf_orthogonal")(lambda t: var.irf(model(t), ENDOG, P, H))
query("i12_irf_one_variable", f"SELECT entity, CAST(h AS BIGINT) AS horizon, 'REVENUE' AS response, 'REVENUE' AS shock, {r('sqrt(rss / (n - 2)) * pow(phi, h)')} AS irf, {r('sqrt(rss / (n - 2)) * (1 - pow(phi, h + 1)) / (1 - phi)')} AS cumulative FROM arm CROSS JOIN range(0, 25) k(h)")(
    lambda t: var.irf(ar(t), [TARGET], 1, H))


def bands(t):
    return var.irf_bands(with_exog(t), ENDOG, P, EXOG, H, 200)


query("i13_irf_bands")(bands)
query("i14_irf_peak")(lambda t: var.irf_peak(bands(t), TARGET))


def shares(t):
    return var.fevd(var.irf(model(t), ENDOG, P, H))


query("i15_fevd")(shares)
query("i16_fevd_target_panel")(lambda t: var.fevd_target(shares(t), TARGET))
query("i16_fevd_top")(lambda t: var.fevd_top(var.fevd_target(shares(t), TARGET)))
query("i16_fevd_summary")(lambda t: var.fevd_wide(var.fevd_target(shares(t), TARGET), ENDOG))
JOINT = " AND ".join(f"{c} IS NOT NULL" for c in INDICATORS)
define("orig", f"SELECT entity, ts AS origin_date FROM tpanel o WHERE {JOINT} AND ts >= DATE '{TEST_START}' AND ts + INTERVAL 12 MONTH <= (SELECT max(ts) FROM tpanel e WHERE e.entity = o.entity AND {JOINT})")
query("i17_origins", "SELECT * FROM orig")(lambda t: var.origins(panel(t), INDICATORS, TEST_START, 12))
_ex = ", ".join(f"{r(c)} AS {c}" for c in EXOG)
query("i18_future_exog", f"SELECT o.entity, origin_date, CAST(s AS BIGINT) AS step, ts, {_ex} FROM orig o CROSS JOIN range(1, 13) k(s) JOIN fmat f ON f.entity = o.entity AND f.ts = CAST(origin_date + to_months(CAST(s AS INTEGER)) AS DATE)")(
    lambda t: var.future_exog(var.origins(panel(t), INDICATORS, TEST_START, 12), with_exog(t), EXOG, 12))
query("i19_var_walk_forward")(lambda t: var.walk_forward(with_exog(t), ENDOG, P, EXOG, TEST_START, HORIZONS))
define("arw", "SELECT entity, ts, y, count(*) OVER w AS n, regr_slope(y, x) OVER w AS phi, regr_intercept(y, x) OVER w AS c FROM arr WHERE x IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING)")
query("i19_var_walk_forward_one_variable", f"SELECT a.entity, a.ts AS origin_date, 'REVENUE' AS variable, CAST(h AS BIGINT) AS h, {r('c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * a.y')} AS forecast, b.REVENUE AS actual, b.ts AS target_date FROM arw a CROSS JOIN (VALUES (1), (3), (6), (12)) v(h) "
      f"JOIN panel b ON b.entity = a.entity AND b.ts = CAST(a.ts + to_months(h) AS DATE) WHERE a.ts >= DATE '{TEST_START}' AND a.ts <= (SELECT max(ts) FROM panel e WHERE e.entity = a.entity) - INTERVAL 12 MONTH AND n >= 15")(lambda t: var.walk_forward(level(t), [TARGET], 1, [], TEST_START, HORIZONS))


def stand_in(t):
    f = forecasts(t).filter("form = 'level'")
    return f.select("entity", F.col("layer").alias("variable"), "h", "origin_date", F.col("y_pred").alias("forecast"), F.col("y_true").alias("actual"))


define("sif", "SELECT entity, layer AS variable, h, origin_date, y_pred - y_true AS e, abs(y_pred - y_true) AS a FROM fc WHERE form = 'level'")
query("i20_oos_metrics", f"SELECT entity, variable, h, count(*) AS n, {r('sqrt(avg(e * e))')} AS rmse, {r('avg(a)')} AS mae, {r('avg(e)')} AS bias, {r('avg(a) / any_value(scale)')} AS mase FROM sif JOIN nscale USING (entity) GROUP BY ALL")(lambda t: var.oos_metrics(stand_in(t), scale(t)))
define("siq", "SELECT entity, variable, h, quantile_cont(a, 0.05) AS lo, quantile_cont(a, 0.5) AS mid, quantile_cont(a, 0.95) AS hi FROM sif GROUP BY ALL")
_k = "CASE WHEN a >= lo - 1e-12 AND a <= hi + 1e-12 THEN a END"
query("i21_robust_metrics", f"SELECT entity, variable, h, count(*) AS n, {r('sqrt(avg(a * a))')} AS rmse, {r('avg(a)')} AS mae, {r('any_value(mid)')} AS medae, {r(f'sqrt(avg(pow({_k}, 2)))')} AS rmse_trimmed, {r(f'avg({_k})')} AS mae_trimmed, {r('avg(a) / any_value(scale)')} AS mase, "
      f"{r('any_value(mid) / any_value(scale)')} AS medase, {r('sqrt(avg(a * a)) / avg(a)')} AS rmse_to_mae FROM sif JOIN siq USING (entity, variable, h) JOIN nscale USING (entity) GROUP BY ALL")(lambda t: var.robust_metrics(stand_in(t), scale(t)))
query("i22_worst_origins", f"SELECT entity, variable, h, rank, origin_date, {r('a')} AS abs_error FROM (SELECT *, row_number() OVER (PARTITION BY entity, variable, h ORDER BY a DESC, origin_date) AS rank FROM sif) WHERE rank <= 5")(lambda t: var.worst_origins(stand_in(t)))
