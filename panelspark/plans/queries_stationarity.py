"""Registered queries: stationarity tests and transform selection.

The p-values come from published response surfaces (normal tail), which SQL lacks; the KPSS statistic with a fixed
bandwidth, the lag rule and the rule tables are checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import dist
from panelspark.operators import stationarity as st
from panelspark.operators.clean import densify, forward_fill
from panelspark.operators.transform import apply_transform, strip_suffix
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r
from panelspark.plans.panels import BREAKS, INDICATORS, TARGET, nation_panel
from panelspark.functions.reshape import to_long
from panelspark.plans.queries_clean import hours
from panelspark.plans.queries_transforms import dense_long, registry_forms

TREND = (TARGET,)
SPLIT = BREAKS[1][1]
PAIR = ["entity", "indicator"]
ALL_FORMS = ["level", "first_diff", "second_diff", "yoy_pct", "log_diff_pct"]

query("f01_schwert_maxlag", "SELECT entity, indicator, CAST(count(*) AS BIGINT) AS n_obs, CAST(greatest(1, floor(12 * pow(count(*) / 100.0, 0.25))) AS BIGINT) AS maxlag FROM "
      "(UNPIVOT npanel ON REVENUE, ORDERS, URGENT, BALANCE, AVGVAL INTO NAME indicator VALUE value) GROUP BY 1, 2")(
    lambda t: to_long(nation_panel(t), INDICATORS).groupBy(*PAIR).agg(F.count("value").alias("n_obs")).withColumn("maxlag", st.schwert_lag(F.col("n_obs"))))


def leveled(t):
    return st.level_spec(dense_long(t), TREND)


query("f02_adf_test")(lambda t: st.adf(leveled(t), PAIR))
# without lags the statistic is that of a simple regression, with one lag that of a regression on two columns, which SQL can do
define("flev", "SELECT entity, indicator, ts, value, value - lag(value) OVER w AS y, lag(value) OVER w AS x1, lag(value) OVER w - lag(value, 2) OVER w AS x2, count(*) OVER (PARTITION BY entity, indicator) AS n_obs FROM plong WINDOW w AS (PARTITION BY entity, indicator ORDER BY ts)")
define("flag0", "SELECT entity, indicator, any_value(n_obs) AS n_obs, count(*) AS n, regr_slope(y, x1) / sqrt((regr_syy(y, x1) - regr_sxy(y, x1) * regr_sxy(y, x1) / regr_sxx(y, x1)) / (count(*) - 2) / regr_sxx(y, x1)) AS stat FROM flev WHERE x1 IS NOT NULL GROUP BY 1, 2")
define("flag1", "SELECT *, (b * sy1 - c * sy2) / (a * b - c * c) AS b1, (a * sy2 - c * sy1) / (a * b - c * c) AS b2, syy - sy1 * sy1 / a AS rss0, syy - (sy1 * (b * sy1 - c * sy2) + sy2 * (a * sy2 - c * sy1)) / (a * b - c * c) AS rss1 FROM "
       "(SELECT entity, indicator, count(*) AS n, regr_sxx(y, x1) AS a, regr_sxx(y, x2) AS b, regr_sxy(x2, x1) AS c, regr_sxy(y, x1) AS sy1, regr_sxy(y, x2) AS sy2, regr_syy(y, x1) AS syy FROM flev WHERE x2 IS NOT NULL GROUP BY 1, 2)")
_one = "n * (ln(2 * pi() * rss1 / n) + 1) + 6 < n * (ln(2 * pi() * rss0 / n) + 1) + 4"


def _crit(level):
    c = ", ".join(str(v) for v in dist.ADF_CRIT["c"][level])
    return f"list_sum(list_transform(list_zip([{c}], [1, 1.0 / adf_nobs, pow(1.0 / adf_nobs, 2), pow(1.0 / adf_nobs, 3)]), lambda z: z[1] * z[2]))"


def adf_sql(maxlag):
    source = ("SELECT entity, indicator, n_obs, stat AS s, CAST(0 AS BIGINT) AS adf_usedlag, n AS adf_nobs FROM flag0" if maxlag == 0 else
              f"SELECT z.entity, z.indicator, n_obs, CASE WHEN used = 1 THEN stat1 ELSE stat END AS s, CAST(used AS BIGINT) AS adf_usedlag, CASE WHEN used = 1 THEN o.n ELSE z.n END AS adf_nobs FROM flag0 z JOIN "
              f"(SELECT *, CASE WHEN {_one} THEN 1 ELSE 0 END AS used, b1 / sqrt(rss1 / (n - 3) * b / (a * b - c * c)) AS stat1 FROM flag1) o ON o.entity = z.entity AND o.indicator = z.indicator")
    crit = ", ".join(f"{r(_crit(lv))} AS adf_crit_{lv}" for lv in ("1", "5", "10"))
    return f"SELECT entity, indicator, n_obs, {r('s')} AS adf_stat, adf_usedlag, adf_nobs, CAST({maxlag} AS BIGINT) AS adf_maxlag, {crit} FROM ({source})"


for _k in (0, 1):
    query(f"f02_adf_test_maxlag_{_k}", adf_sql(_k))(
        lambda t, k=_k: st.adf(dense_long(t).withColumn("spec", F.lit("c")), PAIR, maxlag=k).drop("spec", "adf_error", "adf_pvalue"))

define("kres", "SELECT entity, indicator, ts, n, t, CASE WHEN indicator = 'REVENUE' THEN value - (my + b * (t - (n + 1) / 2.0)) ELSE value - my END AS e FROM (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY entity, indicator ORDER BY ts) AS t, "
       "avg(value) OVER p AS my FROM plong WINDOW p AS (PARTITION BY entity, indicator)) JOIN (SELECT entity AS e1, indicator AS i1, regr_slope(value, t) AS b FROM (SELECT *, row_number() OVER (PARTITION BY entity, indicator ORDER BY ts) AS t FROM plong) GROUP BY 1, 2) "
       "ON e1 = entity AND i1 = indicator")
_lag = " + ".join(f"2 * (1 - {k} / 5.0::DOUBLE) * sum(e * e{k})" for k in range(1, 5))
define("kstat", "SELECT entity, indicator, any_value(n) AS n, (sum(s * s) / (any_value(n) * any_value(n))) / ((sum(e * e) + " + _lag + ") / any_value(n)) AS stat FROM (SELECT *, sum(e) OVER w AS s, " +
       ", ".join(f"coalesce(lag(e, {k}) OVER w, 0) AS e{k}" for k in range(1, 5)) + " FROM kres WINDOW w AS (PARTITION BY entity, indicator ORDER BY ts)) GROUP BY 1, 2")


def _piecewise(crit):
    ps = (0.10, 0.05, 0.025, 0.01)
    out = f"CASE WHEN stat <= {crit[0]} THEN 0.10 WHEN stat >= {crit[3]} THEN 0.01"
    for i in range(3):
        out += f" WHEN stat <= {crit[i + 1]} THEN {ps[i]} + (stat - {crit[i]}) * ({ps[i + 1]} - {ps[i]})::DOUBLE / ({crit[i + 1]} - {crit[i]})::DOUBLE"
    return out + " END"


_c, _ct = (0.347, 0.463, 0.574, 0.739), (0.119, 0.146, 0.176, 0.216)
query("f03_kpss_test", f"SELECT entity, indicator, {r('stat')} AS kpss_stat, {r(f'CASE WHEN indicator = {chr(39)}REVENUE{chr(39)} THEN {_piecewise(_ct)} ELSE {_piecewise(_c)} END')} AS kpss_pvalue, CAST(4 AS BIGINT) AS kpss_lags, "
      f"CASE WHEN indicator = 'REVENUE' THEN stat < {_ct[0]} OR stat > {_ct[3]} ELSE stat < {_c[0]} OR stat > {_c[3]} END AS kpss_clamped FROM kstat")(
    lambda t: st.kpss(leveled(t), PAIR, 4).select(*PAIR, "kpss_stat", "kpss_pvalue", "kpss_lags", "kpss_clamped"))
query("f03_kpss_test_auto_bandwidth")(lambda t: st.kpss(leveled(t), PAIR, None))

def _quadrant(a, k):
    return f"CASE WHEN {a} < 0.05 AND NOT {k} < 0.05 THEN 'Stationary' WHEN NOT {a} < 0.05 AND {k} < 0.05 THEN 'Non-stationary' WHEN {a} < 0.05 THEN 'Trend-stationary (conflict)' ELSE 'Inconclusive' END"


@query("f04_classify_quadrant", "SELECT o_orderkey, " + _quadrant("(o_orderkey % 97 / 1000.0)", "(o_custkey % 89 / 1000.0)") + " AS class FROM orders")
def f04(t):
    """The rule applied to two scores in [0, 0.1) taken from keys, so that all quadrants occur."""
    return t.orders.select("o_orderkey", st.classify_quadrant(F.col("o_orderkey") % 97 / 1000.0, F.col("o_custkey") % 89 / 1000.0).alias("class"))


def panel_tests(t):
    return st.test_panel(dense_long(t), TREND)


def grid(t, forms, split=None):
    return st.test_grid(dense_long(t), forms, TREND, split)


def target_grid(t, forms, split=None):
    return st.test_grid(dense_long(t).filter(F.col("indicator") == TARGET), forms, TREND, split)


def provisional(t):
    """Each series under its registered form, with test terms."""
    return apply_transform(dense_long(t), registry_forms(t), TREND)


def hourly(t):
    """Events per hour and type, empty hours filled forward."""
    return forward_fill(hours(t), "EVENTS", unit="hour").select("entity", "ts", F.col("EVENTS").alias("value"), F.lit("c").alias("spec"))


def provisional_forms(t):
    return registry_forms(t).select("entity", "indicator", strip_suffix("form").alias("form"))


query("f05_test_series")(lambda t: st.test_series(hourly(t), ["entity"], unit="hour"))
query("f06_test_panel")(panel_tests)
query("f07_differencing_ladder")(lambda t: st.differencing_ladder(grid(t, ["level", "first_diff", "second_diff"])))
query("f08_conflict_retest")(lambda t: st.conflict_retest(st.test_grid(to_long(densify(nation_panel(t)), INDICATORS), ["level", "level_ct", "first_diff"], TREND, None)))
query("f09_transform_comparison")(lambda t: target_grid(t, ["level", "first_diff", "yoy_pct", "log_diff_pct"]))
query("f10_registry_draft")(lambda t: st.registry_draft(grid(t, [*ALL_FORMS, "level_ct"]), TARGET))
query("f11_subperiod_tests")(lambda t: st.subperiod_tests(provisional(t), SPLIT))
query("f12_decide_target_form")(lambda t: st.decide_target_form(st.target_classes(target_grid(t, ["first_diff", "yoy_pct", "log_diff_pct"], SPLIT))))
query("f13_final_registry")(lambda t: st.final_registry(grid(t, [*ALL_FORMS, "level_ct"], SPLIT), provisional_forms(t), TARGET))
query("f14_break_window_tests")(lambda t: st.break_window_tests(provisional(t), BREAKS))
query("f15_class_counts")(lambda t: st.class_counts(panel_tests(t)))
