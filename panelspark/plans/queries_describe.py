"""Registered queries: descriptive statistics and exploratory analysis."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.functions.series import sliding
from panelspark.operators import describe, transform
from panelspark.operators.clean import densify, yoy
from panelspark.plans.catalog import query
from panelspark.plans.oracle import chi2_even, define, r, t_two_sided
from panelspark.plans.panels import INDICATORS, PERIODS, TARGET, region_panel
from panelspark.plans.queries_transforms import dense_long, transformed

define("py", "SELECT entity, ts, REVENUE, ORDERS, URGENT, BALANCE, AVGVAL, 100.0 * (REVENUE / lag(REVENUE, 12) OVER (PARTITION BY entity ORDER BY ts) - 1) AS yoy FROM panel")
define("pyn", "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM py WHERE yoy IS NOT NULL")


def growth(t):
    """Panel with the target's yearly growth; rows without growth are dropped."""
    out = sliding(densify(region_panel(t)), ["entity"], lambda w: {"yoy": yoy(TARGET, w)}, back=12)
    return out.filter(F.col("yoy").isNotNull())


STATS = (f"CAST(count(yoy) AS BIGINT) AS n, {r('avg(yoy)')} AS mean, {r('stddev_samp(yoy)')} AS sd, {r('min(yoy)')} AS min_value, {{}}{r('max(yoy)')} AS max_value, {{}}"
         "CAST(count(CASE WHEN yoy < 0 THEN 1 END) AS BIGINT) AS n_negative, CAST(count(CASE WHEN yoy > 2 THEN 1 END) AS BIGINT) AS n_above")


@query("e01_series_summary", "SELECT a.*, b.index_terminal, b.cumulative_pct FROM (SELECT entity, " + STATS.format("arg_min(ts, yoy) AS min_date, ", "arg_max(ts, yoy) AS max_date, ") +
       f" FROM pyn GROUP BY 1) a JOIN (SELECT entity, {r('100.0 * arg_max(REVENUE, ts) / arg_min(REVENUE, ts)')} AS index_terminal, {r('100.0 * arg_max(REVENUE, ts) / arg_min(REVENUE, ts) - 100')} AS cumulative_pct "
       "FROM panel GROUP BY 1) b USING (entity)")
def e01(t):
    level = dense_long(t).filter(F.col("indicator") == TARGET)
    index = describe.terminal_index(transform.rebase_index(level, dt.date(1995, 1, 1)), ("entity",))
    return describe.series_summary(growth(t), "yoy").join(index, "entity")


_per = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)
query("e02_period_summary", "SELECT entity, period, " + STATS.format("", "") + f" FROM pyn JOIN (VALUES {_per}) p(period, a, b) ON ts BETWEEN a AND b GROUP BY 1, 2")(
    lambda t: describe.period_summary(growth(t), "yoy", PERIODS))

define("pgap", "SELECT a.entity, a.ts, any_value(a.yoy) - avg(b.yoy) AS gap FROM pyn a JOIN pyn b ON a.ts = b.ts AND a.entity <> b.entity GROUP BY 1, 2 HAVING count(*) = 4")
query("e03_peer_gap", f"SELECT entity, CAST(count(*) AS BIGINT) AS n, {r('avg(gap)')} AS mean, {r('stddev_samp(gap)')} AS sd, {r('min(gap)')} AS min_value, arg_min(ts, gap) AS min_date, "
      f"{r('max(gap)')} AS max_value, arg_max(ts, gap) AS max_date, CAST(count(CASE WHEN gap < 0 THEN 1 END) AS BIGINT) AS n_negative, CAST(count(CASE WHEN gap > 0 THEN 1 END) AS BIGINT) AS n_above FROM pgap GROUP BY 1")(
    lambda t: describe.series_summary(describe.peer_gap(growth(t), "yoy"), "gap", upper=0.0))

JOINT = " AND ".join(f"{c} IS NOT NULL" for c in INDICATORS)
_cells = " UNION ALL ".join(f"SELECT entity, '{a}' AS row, '{b}' AS col, " + ("1.0::DOUBLE" if a == b else r(f"corr({a}, {b})")) + f" AS r, CAST(count(*) AS BIGINT) AS n FROM tpanel WHERE {JOINT} GROUP BY 1"
                            for a in INDICATORS for b in INDICATORS)
query("e04_corr_matrix", _cells)(lambda t: describe.corr_matrix(transformed(t), INDICATORS))

OTHERS = ("ORDERS", "URGENT", "BALANCE", "AVGVAL")
define("clag", " UNION ALL ".join(f"SELECT a.entity, '{x}' AS indicator, {k} AS lag, corr(a.REVENUE, b.{x}) AS r, count(CASE WHEN a.REVENUE IS NOT NULL AND b.{x} IS NOT NULL THEN 1 END) AS n FROM tpanel a LEFT JOIN tpanel b ON a.entity = b.entity "
                                  f"AND b.ts = CAST(a.ts - INTERVAL {k} MONTH AS DATE) GROUP BY 1" for x in OTHERS for k in (0, 1, 3, 6, 12)))
query("e05_cross_lag_corr", f"SELECT entity, indicator, CAST(lag AS BIGINT) AS lag, {r('r')} AS r, CAST(n AS BIGINT) AS n FROM clag")(
    lambda t: describe.cross_lag_corr(transformed(t), TARGET, OTHERS))
query("e06_argmax_lag", f"SELECT entity, indicator, CAST(lag AS BIGINT) AS lag, {r('r')} AS r FROM clag QUALIFY row_number() OVER (PARTITION BY entity, indicator ORDER BY abs(r) DESC, lag) = 1")(
    lambda t: describe.argmax_lag(describe.cross_lag_corr(transformed(t), TARGET, OTHERS)))

define("clagt", "SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS tt FROM clag")


@query("e07_sign_label", f"SELECT entity, indicator, CAST(lag AS BIGINT) AS lag, CASE WHEN r < -0.1 THEN 'negative' WHEN r > 0.1 THEN 'positive' ELSE 'near-zero' END AS sign, {r('p')} AS p_value, "
       f"CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.10 THEN '.' ELSE '' END AS stars FROM (SELECT *, {t_two_sided('tt', '(n - 2)')} AS p FROM clagt)")
def e07(t):
    from panelspark.functions.dist import t_sf
    c = describe.cross_lag_corr(transformed(t), TARGET, OTHERS)
    p = t_sf(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))), (F.col("n") - 2).cast("double"))
    return c.withColumn("p_value", p).select("entity", "indicator", "lag", describe.sign_label(F.col("r")).alias("sign"), "p_value", describe.stars(F.col("p_value")).alias("stars"))


def ols_sql(source: str, key: str, p: bool = True) -> str:
    inner = (f"SELECT {key}, n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, greatest(syy - sxy * sxy / sxx, 0) / (n - 2) AS s2, sxx, mx, sxy * sxy / (sxx * syy) AS r2 FROM ({source}) WHERE sxx > 1e-12 AND syy > 1e-12")
    tt = "(slope / sqrt(s2 / sxx))"
    return (f"SELECT {key}, CAST(n AS BIGINT) AS n, {r('intercept')} AS intercept, {r('slope')} AS slope, {r('sqrt(s2 * (1.0 / n + mx * mx / sxx))')} AS se_intercept, {r('sqrt(s2 / sxx)')} AS se_slope, {r('r2')} AS r2, "
            f"{r(tt)} AS t_slope, {r(t_two_sided(tt, '(n - 2)'))} AS p_slope FROM ({inner})")


OLS_PERIODS = (("full", dt.date(1990, 1, 1), dt.date(2010, 1, 1)), ("pre", dt.date(1990, 1, 1), dt.date(1998, 8, 31)), ("post", dt.date(1998, 9, 1), dt.date(2010, 1, 1)))
_oper = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in OLS_PERIODS)
REGR = "regr_count(yoy, URGENT){0} AS n, regr_sxx(yoy, URGENT){0} AS sxx, regr_syy(yoy, URGENT){0} AS syy, regr_sxy(yoy, URGENT){0} AS sxy, regr_avgx(yoy, URGENT){0} AS mx, regr_avgy(yoy, URGENT){0} AS my"
query("e08_ols_simple_by_period", ols_sql(f"SELECT entity, period, {REGR.format('')} FROM pyn JOIN (VALUES {_oper}) p(period, a, b) ON ts BETWEEN a AND b GROUP BY 1, 2", "entity, period"))(
    lambda t: describe.ols_by_period(growth(t), "yoy", "URGENT", OLS_PERIODS))
ROLL = f"SELECT entity, ts AS window_end, {REGR.format(' OVER w')} FROM pyn WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 59 PRECEDING) QUALIFY rn >= 60"
query("e09_rolling_ols", ols_sql(ROLL, "entity, window_end"))(lambda t: describe.rolling_ols(growth(t), "yoy", "URGENT"))
query("e10_latest_per_entity", ols_sql(ROLL + " AND rn = n", "entity, window_end"))(
    lambda t: describe.latest_per_entity(describe.rolling_ols(growth(t), "yoy", "URGENT"), "window_end"))

define("acfr", "SELECT a.entity, k.k AS lag, any_value(a.n) AS n, sum(a.d * b.d) / any_value(c0) AS acf FROM (SELECT *, yoy - avg(yoy) OVER p AS d FROM pyn WINDOW p AS (PARTITION BY entity)) a "
       "JOIN (SELECT *, yoy - avg(yoy) OVER p AS d FROM pyn WINDOW p AS (PARTITION BY entity)) b ON a.entity = b.entity JOIN range(0, 41) k(k) ON a.rn = b.rn + k.k "
       "JOIN (SELECT entity AS e0, var_pop(yoy) * count(*) AS c0 FROM pyn GROUP BY 1) ON e0 = a.entity GROUP BY 1, 2")


def acf_rows(t):
    return describe.acf(growth(t), "yoy")


query("e11_acf", f"SELECT entity, CAST(n AS BIGINT) AS n, CAST(lag AS BIGINT) AS lag, {r('acf')} AS acf, {r('1.96 / sqrt(n)')} AS band, abs(acf) > 1.96 / sqrt(n) AS significant FROM acfr")(acf_rows)
# Durbin-Levinson as a recursion over lags, on the list of autocorrelations
DL = """WITH RECURSIVE rr AS (SELECT entity, any_value(n) AS n, list(acf ORDER BY lag) AS a FROM acfr GROUP BY 1),
dl AS (SELECT entity, n, a, 1 AS k, [a[2]] AS phi, a[2] AS v FROM rr UNION ALL
 SELECT entity, n, a, k + 1, list_concat(list_transform(range(1, k + 1), lambda i: phi[i] - last * phi[k + 1 - i]), [last]), last FROM (
  SELECT *, (a[k + 2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * a[k + 2 - i]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * a[i + 1]))) AS last FROM dl WHERE k < 40)),
pac AS (SELECT entity, n, 0 AS lag, 1.0::DOUBLE AS v FROM rr UNION ALL SELECT entity, n, k, v FROM dl) """
HINT = """SELECT entity, CAST(p AS BIGINT) AS p_cand, CAST(q AS BIGINT) AS q_cand, CASE WHEN p > 0 AND al >= 3 THEN 'AR(' || p || ')' WHEN q > 0 AND pl >= 3 THEN 'MA(' || q || ')' WHEN p > 0 AND q > 0 THEN 'ARMA(' || p || ',' || q || ')' ELSE 'white noise' END AS hint
FROM (SELECT entity, count(CASE WHEN abs(v) > 1.96 / sqrt(n) AND lag BETWEEN 1 AND 5 THEN 1 END) AS p, count(CASE WHEN abs(v) > 1.96 / sqrt(n) AND lag BETWEEN 6 AND 12 THEN 1 END) AS pl FROM pac GROUP BY 1)
JOIN (SELECT entity, count(CASE WHEN abs(acf) > 1.96 / sqrt(n) AND lag BETWEEN 1 AND 5 THEN 1 END) AS q, count(CASE WHEN abs(acf) > 1.96 / sqrt(n) AND lag BETWEEN 6 AND 12 THEN 1 END) AS al FROM acfr GROUP BY 1) USING (entity)"""
query("e12_pacf", DL + f"SELECT entity, CAST(n AS BIGINT) AS n, CAST(lag AS BIGINT) AS lag, {r('v')} AS pacf, abs(v) > 1.96 / sqrt(n) AS significant FROM pac")(lambda t: describe.pacf(acf_rows(t)))
define("lbq", "SELECT entity, any_value(n) AS n, m, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM acfr JOIN (VALUES (12), (24), (36)) v(m) ON lag BETWEEN 1 AND m GROUP BY entity, m")
_lbp = "CASE m WHEN 12 THEN " + chi2_even("q", 12) + " WHEN 24 THEN " + chi2_even("q", 24) + " ELSE " + chi2_even("q", 36) + " END"
query("e13_ljung_box", f"SELECT entity, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS lags, {r('q')} AS q, {r(_lbp)} AS p_value, {_lbp} < 0.05 AS reject FROM lbq")(
    lambda t: describe.ljung_box(acf_rows(t)))
query("e14_arma_hint", DL + HINT)(lambda t: describe.arma_hint(acf_rows(t), describe.pacf(acf_rows(t))))
query("e15_rolling_abs_mean", f"SELECT entity, ts, {r('CASE WHEN rn >= 12 THEN avg(abs(yoy)) OVER (PARTITION BY entity ORDER BY ts ROWS 11 PRECEDING) END')} AS rolling_abs_mean FROM pyn")(
    lambda t: describe.rolling_abs_mean(growth(t), "yoy").select("entity", "ts", "rolling_abs_mean"))
query("e16_heatmap_pivot", "SELECT entity, " + ", ".join(f"max(CASE WHEN indicator = '{c}' AND lag = 3 THEN {r('-log10(' + t_two_sided('tt', '(n - 2)') + ')')} END) AS {c}" for c in OTHERS) + " FROM clagt GROUP BY 1")(
    lambda t: describe.heatmap_pivot(e07(t).filter(F.col("lag") == 3).select("entity", "indicator", describe.neg_log10(F.col("p_value")).alias("v")), "entity", "indicator", "v", OTHERS))
