"""Registered queries: seasonal ARMA layer on the hourly event series (season 24).

Selection and verdict rules are also run on a grid table read off the events themselves, which SQL can check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.functions.series import sliding
from panelspark.operators import evaluate as ev
from panelspark.operators import sarma
from panelspark.operators.clean import forward_fill
from panelspark.plans.catalog import query
from panelspark.plans.oracle import chi2_even, define, r
from panelspark.plans.queries_clean import hours
from panelspark.plans.standins import forecasts

SEASON, LONG = 24, 26
FIRST = dt.datetime(2024, 1, 25)


def series(t):
    """Events per hour and type as level and first difference; empty hours filled forward."""
    dense = forward_fill(hours(t), "EVENTS", unit="hour").select("entity", "ts", F.col("EVENTS").alias("value"))
    both = sliding(dense, ["entity"], lambda w: {"diff": F.col("value") - F.lag("value", 1).over(w)}, back=1, unit="hour")
    forms = F.array(F.struct(F.lit("level").alias("form"), F.col("value").alias("y")), F.struct(F.lit("first_diff").alias("form"), F.col("diff").alias("y")))
    return both.select(F.col("entity"), "ts", F.explode(forms).alias("p")).select(F.concat_ws("_", "entity", "p.form").alias("variant_id"), "ts", F.col("p.y").alias("y")).filter(F.col("y").isNotNull())


define("hser", "SELECT entity || '_' || form AS variant_id, ts, y FROM (SELECT entity, 'level' AS form, ts, v0 AS y FROM eneigh UNION ALL SELECT entity, 'first_diff', ts, v0 - lag(v0) OVER (PARTITION BY entity ORDER BY ts) FROM eneigh) WHERE y IS NOT NULL")
query("h01_variants", f"SELECT variant_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, {r('y')} AS y FROM hser")(series)
query("h02_order_grid", "SELECT v.variant_id, p, CAST(0 AS BIGINT) AS d, q, a AS P_s, b AS D_s, c AS Q_s, CAST(24 AS BIGINT) AS s, p + q + a + c + 1 AS n_params FROM (SELECT DISTINCT variant_id FROM hser) v CROSS JOIN range(0, 5) x(p) CROSS JOIN range(0, 5) y(q) CROSS JOIN range(0, 3) z(a) "
      "CROSS JOIN range(0, 2) u(b) CROSS JOIN range(0, 3) w(c)")(lambda t: sarma.order_grid(series(t), SEASON))


def grid(t):
    """All orders on the training part; no order search sees the first target or what follows."""
    return sarma.fit_order_grid(series(t).filter(F.col("ts") < F.lit(FIRST)), SEASON, LONG, "hour")


def pick(g):
    sel = sarma.select_order(g)
    return sel, sel.select("variant_id", *sarma.parse_order("aic_order"))


def fitted(t):
    """Residuals of the selected order of every series on its training part."""
    past = series(t).filter(F.col("ts") < F.lit(FIRST))
    return sarma.order_residuals(past, pick(grid(t))[1], SEASON, LONG, "hour")


query("h03_fit_order_grid")(grid)
query("h04_select_order_fitted")(lambda t: pick(grid(t))[0])

# grid rows read off the events: order from the id, criteria from the value
define("sgrid", "SELECT event_type AS variant_id, event_id % 5 AS p, 0 AS d, event_id // 5 % 5 AS q, event_id // 25 % 3 AS P_s, event_id // 75 % 2 AS D_s, event_id // 150 % 3 AS Q_s, 24 AS s, event_id % 5 + event_id // 5 % 5 + event_id // 25 % 3 + event_id // 150 % 3 + 1 AS n_params, value AS aic, "
       "value + 0.5 * (event_id % 5) AS bic, value + 0.25 * (event_id // 5 % 5) AS hqic, event_id % 7 <> 0 AS converged, event_id % 11 = 3 AS is_original FROM events")
define("sord", "SELECT *, printf('(%d,%d,%d)(%d,%d,%d,%d)', p, d, q, P_s, D_s, Q_s, s) AS o FROM sgrid")


def table_grid(t):
    i = F.col("event_id")
    p, q, sp, sd, sq = i % 5, F.floor(i / 5) % 5, F.floor(i / 25) % 3, F.floor(i / 75) % 2, F.floor(i / 150) % 3
    return t.events.select(F.col("event_type").alias("variant_id"), p.alias("p"), F.lit(0).cast("bigint").alias("d"), q.alias("q"), sp.alias("P_s"), sd.alias("D_s"), sq.alias("Q_s"), F.lit(24).cast("bigint").alias("s"),
                           (p + q + sp + sq + 1).alias("n_params"), F.col("value").alias("aic"), (F.col("value") + 0.5 * p).alias("bic"), (F.col("value") + 0.25 * q).alias("hqic"),
                           (i % 7 != 0).alias("converged"), (i % 11 == 3).alias("is_original"))


def best_sql(m, src="sord"):
    return f"SELECT variant_id AS v_{m}, o AS {m}_order, {m} AS {m}_value FROM {src} QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY converged DESC, {m}, n_params, p, d, q, P_s, D_s, Q_s) = 1"


def select_sql(src="sord"):
    return (f"SELECT variant_id, aic_order, {r('aic_value')} AS aic_value, bic_order, {r('bic_value')} AS bic_value, hqic_order, {r('hqic_value')} AS hqic_value, aic_order = bic_order AS aic_bic_agree, aic_order = hqic_order AS aic_hqic_agree, n_converged, n_total FROM "
            f"(SELECT variant_id, count(CASE WHEN converged THEN 1 END) AS n_converged, count(*) AS n_total FROM {src} GROUP BY 1) JOIN ({best_sql('aic', src)}) ON v_aic = variant_id JOIN ({best_sql('bic', src)}) ON v_bic = variant_id JOIN ({best_sql('hqic', src)}) ON v_hqic = variant_id")


query("h04_select_order", select_sql())(lambda t: sarma.select_order(table_grid(t)))
query("h05_order_string", "SELECT variant_id, p, q, o AS text, P_s AS parsed_seasonal, CAST(s AS BIGINT) AS parsed_season FROM sord")(
    lambda t: table_grid(t).withColumn("text", sarma.order_string()).select("variant_id", "p", "q", "text", *sarma.parse_order("text")[3:4], *sarma.parse_order("text")[6:]).withColumnsRenamed({"P_s": "parsed_seasonal", "s": "parsed_season"}))


def errors(t):
    f = forecasts(t).filter("layer = 'drift' AND h = 1 AND form = 'level'")
    return f.select(F.concat_ws("_", "entity", "layer").alias("variant_id"), F.col("target_date").alias("ts"), (F.col("y_true") - F.col("y_pred")).alias("e"))


define("herr", "SELECT entity || '_' || layer AS variant_id, target_date AS ts, e, row_number() OVER (PARTITION BY entity ORDER BY target_date) AS rn, e - avg(e) OVER (PARTITION BY entity) AS c FROM fce WHERE layer = 'drift' AND h = 1 AND form = 'level'")
define("hmom", "SELECT variant_id, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS sd, avg(c * c * c) / pow(avg(c * c), 1.5) AS skew, avg(c * c * c * c) / pow(avg(c * c), 2) - 3 AS kurt_excess FROM herr GROUP BY 1")
define("hjb", "SELECT *, n / 6.0 * (skew * skew + kurt_excess * kurt_excess / 4) AS jb FROM hmom")
define("hlb", "SELECT a.variant_id, m, any_value(q.n) * (any_value(q.n) + 2) * sum(g * g / (q.n - k)) AS q FROM (SELECT a.variant_id, k, sum(a.c * b.c) / any_value(s) AS g FROM herr a JOIN herr b ON a.variant_id = b.variant_id JOIN range(1, 25) k(k) ON a.rn = b.rn + k JOIN (SELECT variant_id AS v0, sum(c * c) AS s FROM herr GROUP BY 1) "
       "ON v0 = a.variant_id GROUP BY 1, 2) a JOIN (VALUES (12), (24)) v(m) ON k <= m JOIN hmom q ON q.variant_id = a.variant_id GROUP BY 1, 2")
_lb = ", ".join(f"{r(f'max(CASE WHEN m = {m} THEN q END)')} AS lb{m}_stat, {r(f'max(CASE WHEN m = {m} THEN ' + chi2_even('q', m) + ' END)')} AS lb{m}_p" for m in (12, 24))
# two lags: the share that a regression on two columns explains has a closed form in correlations
define("harch", "SELECT variant_id, count(*) AS n, corr(s, s1) AS a, corr(s, s2) AS b, corr(s1, s2) AS c FROM (SELECT variant_id, e * e AS s, lag(e * e) OVER w AS s1, lag(e * e, 2) OVER w AS s2 FROM herr "
       "WINDOW w AS (PARTITION BY variant_id ORDER BY ts)) WHERE s2 IS NOT NULL GROUP BY 1")
_arch = "n * (a * a + b * b - 2 * a * b * c) / (1 - c * c)"
query("h06_residual_diagnostics", "SELECT * FROM (SELECT variant_id, n, " + ", ".join(f"{r(c)} AS {c}" for c in ("mean", "sd", "skew", "kurt_excess", "jb")) + f", {r('exp(-jb / 2)')} AS jb_p FROM hjb) JOIN (SELECT variant_id, {_lb} FROM hlb GROUP BY 1) USING (variant_id) "
      f"JOIN (SELECT variant_id, {r(_arch)} AS arch_lm, {r(f'exp(-{_arch} / 2)')} AS arch_p FROM harch) USING (variant_id)")(
    lambda t: sarma.residual_diagnostics(errors(t), arch_lags=2))
query("h06_residual_diagnostics_hourly")(lambda t: sarma.residual_diagnostics(fitted(t), unit="hour"))


def walk(t, orders):
    return sarma.expanding_one_step(series(t), orders, SEASON, LONG, FIRST, "hour")


query("h07_expanding_one_step")(lambda t: walk(t, pick(grid(t))[1]))
# one lag and no noise term: a simple regression over all earlier rows at every date
define("hlag", "SELECT variant_id, ts, y, lag(y) OVER (PARTITION BY variant_id ORDER BY ts) AS x FROM hser")
define("hwalk", "SELECT variant_id, ts, y, x, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM hlag WHERE x IS NOT NULL WINDOW w AS (PARTITION BY variant_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def one_lag(t):
    s = series(t)
    orders = s.select("variant_id").distinct().select("variant_id", *[F.lit(v).cast("bigint").alias(c) for c, v in (("p", 1), ("q", 0), ("P_s", 0), ("D_s", 0), ("Q_s", 0))])
    return sarma.expanding_one_step(s, orders, SEASON, LONG, FIRST, "hour", 1, 0, 0, 0)


query("h07_expanding_one_step_one_variable", f"SELECT variant_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, {r('y')} AS actual, {r('a + b * x')} AS predicted, {r('y - a - b * x')} AS residual, n AS n_train FROM hwalk WHERE ts >= TIMESTAMP '{FIRST}'")(one_lag)
query("h09_boundary_verdict", f"SELECT variant_id, oo AS original_order, oa AS original_aic, eo AS extension_order, ea AS extension_aic, {r('ea - oa')} AS delta_aic, CASE WHEN ea - oa <= -2 THEN 'extend' ELSE 'accept' END AS verdict, n_extensions_converged FROM (SELECT variant_id, count(CASE WHEN NOT is_original AND converged THEN 1 END) AS n_extensions_converged "
      "FROM sord GROUP BY 1) JOIN (SELECT variant_id AS v1, o AS oo, aic AS oa FROM sord WHERE is_original QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY aic DESC, o DESC) = 1) ON v1 = variant_id JOIN (SELECT variant_id AS v2, o AS eo, aic AS ea FROM sord WHERE NOT is_original QUALIFY row_number() "
      "OVER (PARTITION BY variant_id ORDER BY converged DESC, aic, o) = 1) ON v2 = variant_id")(lambda t: sarma.boundary_verdict(table_grid(t)))
query("h09_boundary_deltas", f"SELECT variant_id, o AS text, aic, {r('aic - min(CASE WHEN is_original THEN aic END) OVER (PARTITION BY variant_id)')} AS delta_aic FROM sord")(
    lambda t: sarma.with_deltas(table_grid(t)).select("variant_id", sarma.order_string().alias("text"), "aic", "delta_aic"))
define("sold", "SELECT * FROM sord WHERE q <= 2")
query("h10_grid_union_reselect", f"SELECT s.*, b.aic_order AS old_order, b.aic_value AS old_aic, {r('s.aic_value - b.aic_value')} AS delta_aic, s.aic_order <> b.aic_order AS changed FROM ({select_sql()}) s JOIN ({best_sql('aic', 'sold')}) b ON b.v_aic = s.variant_id")(
    lambda t: sarma.grid_union_reselect(table_grid(t).filter("q <= 2"), table_grid(t).filter("q > 2")))
query("h11_ic_slice", "SELECT g.variant_id, g.p, " + ", ".join(f"min(CASE WHEN g.q = {i} THEN g.aic END) AS q{i}" for i in range(5)) + " FROM sord g JOIN (SELECT * FROM sord QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY converged DESC, aic, n_params, p, d, q, P_s, D_s, Q_s) = 1) b ON b.variant_id = g.variant_id AND b.P_s = g.P_s AND b.D_s = g.D_s AND b.Q_s = g.Q_s GROUP BY 1, 2")(
    lambda t: sarma.ic_slice(table_grid(t)))


@query("h12_saturation_check")
def h12(t):
    full = grid(t)
    (sa, oa), (sb, ob) = pick(full.filter("q <= 2")), pick(full)

    def rmse(o):
        return walk(t, o).groupBy("variant_id").agg(ev.rmse(F.col("residual")).alias("rmse"))

    return sarma.saturation_check(sa, sb, rmse(oa), rmse(ob))
