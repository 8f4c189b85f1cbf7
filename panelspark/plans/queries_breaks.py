"""Registered queries: structural breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import breaks
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r
from panelspark.plans.panels import BREAKS, PERIODS
from panelspark.plans.queries_describe import growth

ONE = ("URGENT",)
ALL = ("ORDERS", "URGENT", "BALANCE", "AVGVAL")
_b = ", ".join(f"('{n}', DATE '{d}')" for n, d in BREAKS)


def rss(f=""):
    return f"(regr_syy(yoy, URGENT){f} - regr_sxy(yoy, URGENT){f} * regr_sxy(yoy, URGENT){f} / regr_sxx(yoy, URGENT){f})"


FILT = " FILTER (WHERE ts {} d)"
define("chowc", f"""SELECT entity, break_name, d AS break_date, count(*) AS n_total, count(CASE WHEN ts < d THEN 1 END) AS n_pre, {rss()} AS rr,
 {rss(FILT.format('<'))} + {rss(FILT.format('>='))} AS ru FROM pyn CROSS JOIN (VALUES {_b}) b(break_name, d) GROUP BY 1, 2, 3""")
define("chowf", "SELECT *, ((rr - ru) / 2) / (ru / (n_total - 4)) AS F FROM chowc")


def classical(t):
    return breaks.chow_classical(growth(t), "yoy", ONE, BREAKS)


query("g01_chow_classical", f"SELECT entity, break_name, break_date, {r('F')} AS F, {r('rr')} AS rss_restricted, {r('ru')} AS rss_unrestricted, CAST(n_total AS BIGINT) AS n_total, CAST(n_pre AS BIGINT) AS n_pre, "
      f"CAST(n_total - n_pre AS BIGINT) AS n_post, CAST(2 AS BIGINT) AS df_num, CAST(n_total - 4 AS BIGINT) AS df_denom, {r('pow(1 + 2 * F / (n_total - 4), -(n_total - 4) / 2.0)')} AS p_value, CAST(NULL AS VARCHAR) AS error FROM chowf")(classical)
query("g01_chow_classical_all_regressors")(lambda t: breaks.chow_classical(growth(t), "yoy", ALL, BREAKS))
query("g02_chow_hac")(lambda t: breaks.chow_hac(growth(t), "yoy", ALL, BREAKS))

# one regressor: each side is a simple regression; h is a row's share in the difference of the two coefficient pairs, its sign by side
define("bside", f"SELECT p.entity, break_name, d, ts, yoy AS y, URGENT AS x, CASE WHEN ts < d THEN 'pre' ELSE 'post' END AS side FROM pyn p CROSS JOIN (VALUES {_b}) b(break_name, d)")
define("bfit", "SELECT entity, break_name, d, side, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM bside GROUP BY ALL")
define("bh", "SELECT *, e * (1.0 / n - mx * (x - mx) / sxx) AS g0, e * (x - mx) / sxx AS g1 FROM (SELECT s.*, f.n, f.b, f.a, f.sxx, f.mx, s.y - f.a - f.b * s.x AS e FROM bside s JOIN bfit f USING (entity, break_name, d, side))")
define("bhl", "SELECT *, " + ", ".join(f"coalesce(lag(s * g{i}, {k}) OVER w, 0) AS h{i}_{k}, coalesce(lag(g{i}, {k}) OVER v, 0) AS o{i}_{k}" for i in (0, 1) for k in range(1, 5)) + " FROM (SELECT *, CASE WHEN side = 'post' THEN 1 ELSE -1 END AS s FROM bh) "
       "WINDOW w AS (PARTITION BY entity, break_name ORDER BY ts), v AS (PARTITION BY entity, break_name, side ORDER BY ts)")


def _v(i, j, p="h", own="s * "):
    """Newey-West sum of products of two components."""
    return f"(sum(g{i} * g{j})" + "".join(f" + (1 - {k} / 5.0::DOUBLE) * sum({own}g{i} * {p}{j}_{k} + {own}g{j} * {p}{i}_{k})" for k in range(1, 5)) + ")"


define("bvar", f"SELECT entity, break_name, d, {_v(0, 0)} AS v00, {_v(0, 1)} AS v01, {_v(1, 1)} AS v11 FROM bhl GROUP BY ALL")
define("bwald", "SELECT v.entity, v.break_name, v.d AS break_date, p.n AS n_pre, q.n AS n_post, ((q.a - p.a) * ((q.a - p.a) * v11 - (q.b - p.b) * v01) + (q.b - p.b) * ((q.b - p.b) * v00 - (q.a - p.a) * v01)) / (v00 * v11 - v01 * v01) / 2 AS F "
       "FROM bvar v JOIN bfit p ON p.entity = v.entity AND p.break_name = v.break_name AND p.side = 'pre' JOIN bfit q ON q.entity = v.entity AND q.break_name = v.break_name AND q.side = 'post'")
_p2 = "pow(1 + 2 * F / (n_pre + n_post - 4), -(n_pre + n_post - 4) / 2.0)"
define("bse", f"SELECT entity, break_name, d, side, sqrt({_v(0, 0, 'o', '')}) AS se0, sqrt({_v(1, 1, 'o', '')}) AS se1 FROM bhl GROUP BY ALL")
define("bcoef", "SELECT entity, break_name, d, side, n, unnest([{'variable': 'const', 'coef': a, 'se': se0}, {'variable': 'URGENT', 'coef': b, 'se': se1}], recursive := true) FROM bfit JOIN bse USING (entity, break_name, d, side)")
define("bshift", "SELECT p.entity, p.break_name, p.d AS break_date, p.variable, p.coef AS coef_pre, p.se AS se_pre, p.n AS n_pre, q.coef AS coef_post, q.se AS se_post, q.n AS n_post, q.coef - p.coef AS delta, sqrt(p.se * p.se + q.se * q.se) AS se_delta "
       "FROM bcoef p JOIN bcoef q ON p.entity = q.entity AND p.break_name = q.break_name AND p.variable = q.variable AND p.side = 'pre' AND q.side = 'post'")


def hac_one(t):
    return breaks.chow_hac(growth(t), "yoy", ONE, BREAKS)


def shift_one(t):
    return breaks.coef_shift(growth(t), "yoy", ONE, BREAKS)


query("g02_chow_hac_one_regressor", f"SELECT entity, break_name, break_date, {r('F')} AS F, CAST(n_pre + n_post AS BIGINT) AS n_total, CAST(n_pre AS BIGINT) AS n_pre, CAST(n_post AS BIGINT) AS n_post, CAST(2 AS BIGINT) AS df_num, CAST(n_pre + n_post - 4 AS BIGINT) AS df_denom, "
      f"{r(_p2)} AS p_value, CAST(NULL AS VARCHAR) AS error FROM bwald")(hac_one)
_sh = ", ".join(f"{r(c)} AS {c}" for c in ("coef_pre", "se_pre", "coef_post", "se_post", "delta", "se_delta", "z_stat"))
query("g04_coef_shift_one_regressor", f"SELECT entity, break_name, break_date, variable, n_pre, n_post, {_sh} FROM (SELECT *, delta / se_delta AS z_stat FROM bshift)")(lambda t: shift_one(t).drop("p_value"))
query("g05_dominant_driver_one_regressor", f"SELECT entity, break_name, CASE WHEN survives THEN top END AS driver, {r('z')} AS max_abs_z, survives, survives AND top <> 'const' AS generates_interaction FROM (SELECT s.entity, s.break_name, arg_max(variable, abs(delta / se_delta)) AS top, "
      f"max(abs(delta / se_delta)) AS z, any_value({_p2.replace('n_pre', 'w.n_pre').replace('n_post', 'w.n_post')} < 0.05 / 12) AS survives FROM bshift s JOIN bwald w USING (entity, break_name) GROUP BY 1, 2)")(lambda t: breaks.dominant_driver(shift_one(t), hac_one(t)))
query("g08_wald_at_break_one_regressor", f"SELECT entity, break_name, break_date, {r('F')} AS wald_f FROM bwald")(lambda t: hac_one(t).select("entity", "break_name", "break_date", F.col("F").alias("wald_f")))
query("g03_chow_with_nuisance")(lambda t: breaks.chow_hac(growth(t), "yoy", ALL, BREAKS, nuisance=PERIODS[0][1:]))
query("g04_coef_shift")(lambda t: breaks.coef_shift(growth(t), "yoy", ALL, BREAKS))
query("g05_dominant_driver")(lambda t: breaks.dominant_driver(breaks.coef_shift(growth(t), "yoy", ALL, BREAKS), breaks.chow_hac(growth(t), "yoy", ALL, BREAKS)))


def both(t):
    return breaks.bonferroni([("classical", classical(t)), ("hac", hac_one(t))])


_c2 = "pow(1 + 2 * F / (n_total - 4), -(n_total - 4) / 2.0)"
define("bstack", f"SELECT 'classical' AS variant, entity, break_name, break_date, F, {_c2} AS p_value, n_total, n_pre, n_total - n_pre AS n_post FROM chowf UNION ALL SELECT 'hac', entity, break_name, break_date, F, {_p2}, n_pre + n_post, n_pre, n_post FROM bwald")
query("g06_bonferroni_two_variants", f"SELECT variant, entity, break_name, break_date, {r('F')} AS F, {r('p_value')} AS p_value, CAST(n_total AS BIGINT) AS n_total, CAST(n_pre AS BIGINT) AS n_pre, CAST(n_post AS BIGINT) AS n_post, {r('0.05 / 12')} AS alpha_family, "
      "p_value < 0.05 AS reject_nominal, p_value < 0.05 / 12 AS reject_family FROM bstack")(both)
query("g07_concordance_two_variants", "SELECT 'classical-hac' AS pair, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(CASE WHEN (a.p_value < 0.05) = (b.p_value < 0.05) THEN 1 END) AS BIGINT) AS n_agree FROM bstack a JOIN bstack b USING (entity, break_name) "
      "WHERE a.variant = 'classical' AND b.variant = 'hac'")(lambda t: breaks.concordance(both(t), "classical", "hac"))


def stacked(t):
    return breaks.bonferroni([("classical", classical(t)), ("hac", hac_one(t)),
                              ("hac_period", breaks.chow_hac(growth(t), "yoy", ONE, BREAKS, nuisance=PERIODS[0][1:]))])


query("g06_bonferroni")(stacked)
query("g07_concordance")(lambda t: breaks.concordance(stacked(t), "classical", "hac"))


@query("g08_wald_at_break")
def g08(t):
    return breaks.chow_hac(growth(t), "yoy", ALL, BREAKS).select("entity", "break_name", "break_date", F.col("F").alias("wald_f"))


PRE = " OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
POST = " OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
ALLW = " OVER (PARTITION BY entity)"


def scan_sql(pi0):
    return (f"SELECT entity, ts AS candidate_date, rn - 1 AS n_pre, n AS n_total, ((rr - ru) / 2) / (ru / (n - 4)) AS wald_f FROM (SELECT entity, ts, rn, n, {rss(ALLW)} AS rr, {rss(PRE)} + {rss(POST)} AS ru FROM pyn) "
            f"WHERE rn - 1 BETWEEN ceil({pi0} * n) AND floor((1 - {pi0}::DOUBLE) * n)")


define("scan15", scan_sql(0.15))
define("scan10", scan_sql(0.10))


def scan(t, pi0=0.15):
    return breaks.sup_wald_scan(growth(t), "yoy", ONE, pi0)


query("g09_sup_wald_scan", f"SELECT entity, candidate_date, CAST(n_pre AS BIGINT) AS n_pre, CAST(n_total AS BIGINT) AS n_total, {r('wald_f')} AS wald_f FROM scan15")(scan)
query("g09_sup_wald_scan_all_regressors")(lambda t: breaks.sup_wald_scan(growth(t), "yoy", ALL))


query("g09_robust_sup_wald_scan")(lambda t: breaks.robust_sup_wald_scan(growth(t), "yoy", ALL))
query("g10_robust_scan_summary")(lambda t: breaks.scan_summary(breaks.robust_sup_wald_scan(growth(t), "yoy", ALL), 5))


def summary_sql(table, pi0):
    c10, c5, c1 = breaks.SUP_F_CRIT[pi0][1]
    return (f"SELECT entity, {pi0}::DOUBLE AS pi0, CAST(2 AS BIGINT) AS k, {r('max(wald_f)')} AS sup_w, arg_max(candidate_date, wald_f) AS argmax_date, {r('avg(wald_f)')} AS avg_w, {r('ln(avg(exp(wald_f / 2)))')} AS exp_w, "
            f"{c10}::DOUBLE AS crit_10, {c5}::DOUBLE AS crit_5, {c1}::DOUBLE AS crit_1, CASE WHEN max(wald_f) > {c1} THEN 'reject @ 1%' WHEN max(wald_f) > {c5} THEN 'reject @ 5%' WHEN max(wald_f) > {c10} THEN 'reject @ 10%' "
            f"ELSE 'fail to reject' END AS verdict, CAST(count(*) AS BIGINT) AS n_candidates, min(candidate_date) AS window_start, max(candidate_date) AS window_end FROM {table} GROUP BY 1")


define("ssum", summary_sql("scan15", 0.15))
define("ssum10", summary_sql("scan10", 0.10))


def summary(t, pi0=0.15):
    return breaks.scan_summary(scan(t, pi0), 2, pi0)


query("g10_scan_summary", "SELECT * FROM ssum")(summary)
_mt = ", ".join(f"CAST(abs(date_diff('month', argmax_date, DATE '{d}')) AS BIGINT) AS months_to_{n}, abs(date_diff('month', argmax_date, DATE '{d}')) <= 6 AS aligned_{n}" for n, d in BREAKS)
_closest = f"(SELECT arg_min(nm, abs(date_diff('day', {{0}}, d)) * 10 + o) FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, DATE {chr(39)}{d}{chr(39)}, {i})' for i, (n, d) in enumerate(BREAKS))}) v(nm, d, o))"
_closem = f"(SELECT CAST(arg_min(abs(date_diff('month', {{0}}, d)), abs(date_diff('day', {{0}}, d)) * 10 + o) AS BIGINT) FROM (VALUES {', '.join(f'(DATE {chr(39)}{d}{chr(39)}, {i})' for i, (n, d) in enumerate(BREAKS))}) v(d, o))"
query("g11_align_to_known", f"SELECT *, aligned_B1 OR aligned_B2 OR aligned_B3 AS aligned_to_any FROM (SELECT entity, argmax_date, {_mt}, {_closest.format('argmax_date')} AS closest_break, {_closem.format('argmax_date')} AS months_to_closest FROM ssum)")(
    lambda t: breaks.align_to_known(summary(t).select("entity", "argmax_date"), BREAKS))
query("g12_top_candidates", f"SELECT entity, CAST(rank AS BIGINT) AS rank, candidate_date, {r('wald_f')} AS wald_f, {_closest.format('candidate_date')} AS closest_break, {_closem.format('candidate_date')} AS months_to_closest "
      "FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY wald_f DESC, candidate_date) AS rank FROM scan15) WHERE rank <= 3")(lambda t: breaks.top_candidates(scan(t), BREAKS))
query("g13_trim_sensitivity", "SELECT a.entity, a.sup_w AS sup_w_1, a.argmax_date AS argmax_1, a.verdict AS verdict_1, b.sup_w AS sup_w_2, b.argmax_date AS argmax_2, b.verdict AS verdict_2, a.argmax_date = b.argmax_date AS same_argmax, "
      "a.verdict = b.verdict AS same_verdict FROM ssum a JOIN ssum10 b USING (entity)")(lambda t: breaks.trim_sensitivity(summary(t), summary(t, 0.10)))
query("g14_nearest_scan_date", f"SELECT entity, break_name, d AS break_date, arg_min(candidate_date, o) AS scan_date, {r('arg_min(wald_f, o)')} AS wald_f, arg_min(candidate_date, o) = d AS exact FROM (SELECT *, abs(date_diff('day', candidate_date, d)) * 100000 "
      f"+ date_diff('day', DATE '1970-01-01', candidate_date) AS o FROM scan15 CROSS JOIN (VALUES {_b}) b(break_name, d)) GROUP BY 1, 2, 3")(lambda t: breaks.nearest_scan_date(scan(t), BREAKS))
query("g15_window_coverage", f"SELECT entity, min(candidate_date) AS window_start, max(candidate_date) AS window_end, break_name, d AS break_date, d BETWEEN min(candidate_date) AND max(candidate_date) AS inside FROM scan15 CROSS JOIN (VALUES {_b}) b(break_name, d) "
      "GROUP BY entity, break_name, d")(lambda t: breaks.window_coverage(scan(t), BREAKS))
