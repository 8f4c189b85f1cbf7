"""Registered queries: ridge layer.

With one feature a ridge fit has a closed form in SQL; queries named so run the same operators on one feature per key
and are checked against it. The multi-feature runs are checked by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.reshape import to_long
from panelspark.operators import evaluate as ev
from panelspark.operators import features as ft
from panelspark.operators import ridge
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r
from panelspark.plans.panels import HORIZONS, TARGET, TEST_START, TRAIN_END
from panelspark.plans.queries_evaluate import scale as level_scale
from panelspark.plans.queries_features import ALLOK, NAMES, matrix
from panelspark.plans.standins import forecasts

XS = [n for n in NAMES if n != TARGET]
ALPHAS = tuple(float(f"1e{k}") for k in range(-3, 5))
A = 10.0


def train(t):
    return ft.train_rows(matrix(t), NAMES, TRAIN_END)


# one feature per key: (entity, feature, ts, x, y)
define("one", "SELECT entity, feature, ts, value AS x, y, row_number() OVER (PARTITION BY entity, feature ORDER BY ts) AS rn, count(*) OVER (PARTITION BY entity, feature) AS n FROM flong JOIN "
       f"(SELECT entity AS e2, ts AS t2, REVENUE AS y FROM fmat WHERE {ALLOK} AND ts <= DATE '{TRAIN_END}') ON e2 = entity AND t2 = ts WHERE feature <> 'REVENUE'")
define("onef", "SELECT *, CASE WHEN rn <= n - 5 * (n // 6) THEN 0 ELSE (rn - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END AS b FROM one")
_w = "CASE WHEN var_pop(x) > 1e-12 * avg(x * x) THEN covar_pop(x, y) / sqrt(var_pop(x)) * count(*) / (count(*) + {a}) ELSE 0 END"
define("onec", f"SELECT entity, feature, 0 AS fold, {_w.format(a=A)} AS coef FROM onef GROUP BY 1, 2 UNION ALL SELECT entity, feature, f, {_w.format(a=A)} FROM onef JOIN range(1, 6) k(f) ON b < f GROUP BY 1, 2, 3")


def one_feature(t):
    rows = train(t)
    long = to_long(rows, XS)
    return long.join(rows.select("entity", "ts", F.col(TARGET).alias("y")), ["entity", "ts"]).select("entity", F.col("indicator").alias("key_feature"), "ts", F.col("value").alias("x"), "y")


def coefs(t):
    """(entity, feature, fold, coef) of one-feature fits."""
    out = ridge.fold_coefs(one_feature(t), ["x"], "y", A, ("entity", "key_feature"))
    return out.select("entity", F.col("key_feature").alias("feature"), "fold", "coef")


def full_coefs(t):
    return coefs(t).filter("fold = 0").select("entity", "feature", "coef", ft.classify_feature(F.col("feature")).alias("category"))


CAT = ("CASE WHEN feature LIKE '%\\_x\\_%' ESCAPE '\\' THEN 'interaction' WHEN feature LIKE 'D\\_%' ESCAPE '\\' THEN 'split' WHEN feature LIKE 'P\\_%' ESCAPE '\\' "
       "THEN 'period' WHEN regexp_matches(feature, '_lag[0-9]+$') THEN 'lag' WHEN regexp_matches(feature, '_roll[0-9]+_') THEN 'rolling' ELSE 'base' END")
define("cfull", f"SELECT entity, feature, coef, {CAT} AS category, row_number() OVER (PARTITION BY entity ORDER BY abs(coef) DESC, feature) AS rank FROM onec WHERE fold = 0")

query("j01_ridge_fit", f"SELECT entity, feature AS key_feature, {r('coef')} AS coef FROM onec WHERE fold = 0")(
    lambda t: ridge.ridge_fit(one_feature(t), ["x"], "y", A, ("entity", "key_feature")).select("entity", "key_feature", "coef"))
query("j01_ridge_fit_all_features")(lambda t: ridge.ridge_fit(train(t), XS, TARGET, A))
define("jtrain", f"SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM fmat WHERE {ALLOK} AND ts <= DATE '{TRAIN_END}'")
define("jb", "SELECT *, CASE WHEN rn <= n - 5 * (n // 6) THEN 0 ELSE (rn - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END AS b FROM jtrain")
query("j02_time_series_folds", "SELECT entity, CAST(f AS BIGINT) AS fold, CAST(count(CASE WHEN b < f THEN 1 END) AS BIGINT) AS n_train, CAST(count(CASE WHEN b = f THEN 1 END) AS BIGINT) AS n_val, min(CASE WHEN b < f THEN ts END) AS train_start, "
      "max(CASE WHEN b < f THEN ts END) AS train_end, min(CASE WHEN b = f THEN ts END) AS val_start, max(CASE WHEN b = f THEN ts END) AS val_end FROM jb CROSS JOIN range(1, 6) k(f) GROUP BY 1, 2")(lambda t: ridge.time_series_folds(train(t)))

_alphas = ", ".join(f"({a}::DOUBLE)" for a in ALPHAS)
define("cvm", "SELECT entity, f, count(*) AS nt, avg(ORDERS) AS mx, var_pop(ORDERS) AS vx, covar_pop(ORDERS, REVENUE) AS cxy, avg(REVENUE) AS my FROM jb JOIN range(1, 6) k(f) ON b < f GROUP BY 1, 2")
define("cvs", f"SELECT c.entity, alpha, c.f, any_value(nt) AS nt, count(CASE WHEN b = c.f THEN 1 END) AS nv, avg(CASE WHEN b < c.f THEN pow(REVENUE - my - cxy / vx * nt / (nt + alpha) * (ORDERS - mx), 2) END) AS tm, "
       f"avg(CASE WHEN b = c.f THEN pow(REVENUE - my - cxy / vx * nt / (nt + alpha) * (ORDERS - mx), 2) END) AS vm FROM cvm c JOIN jb ON jb.entity = c.entity CROSS JOIN (VALUES {_alphas}) a(alpha) GROUP BY 1, 2, 3")


def cv_one(t):
    return ridge.alpha_cv(train(t), ["ORDERS"], TARGET, ALPHAS)


query("j03_alpha_cv", f"SELECT entity, alpha, CAST(f AS BIGINT) AS fold, nt AS n_train, nv AS n_val, {r('tm')} AS train_mse, {r('vm')} AS val_mse FROM cvs")(cv_one)
query("j03_alpha_cv_all_features")(lambda t: ridge.alpha_cv(train(t), XS, TARGET, ALPHAS, h=1))
define("cva", "SELECT entity, alpha, avg(vm) AS m, stddev_samp(vm) / sqrt(5) AS se FROM cvs GROUP BY 1, 2")
define("cvsel", f"SELECT entity, arg_min(alpha, m) AS alpha, min(m) AS m, arg_min(se, m) AS se FROM cva GROUP BY 1")
define("csel", f"SELECT s.entity, any_value(s.alpha) AS alpha, {r('any_value(s.m)')} AS cv_mse, {r('any_value(s.se)')} AS cv_se, max(CASE WHEN a.m <= s.m + s.se THEN a.alpha END) AS alpha_1se, CASE WHEN any_value(s.alpha) = {ALPHAS[0]} THEN 'lower' "
       f"WHEN any_value(s.alpha) = {ALPHAS[-1]} THEN 'upper' ELSE 'interior' END AS boundary FROM cvsel s JOIN cva a USING (entity) GROUP BY 1")


def selection(t):
    return ridge.select_alpha(cv_one(t))


query("j04_select_alpha", "SELECT * FROM csel")(selection)
query("j05_intercept_bound", f"SELECT entity, {r('avg(m)')} AS intercept_mse FROM (SELECT c.entity, c.f, avg(pow(REVENUE - my, 2)) AS m FROM cvm c JOIN jb ON jb.entity = c.entity AND b = c.f GROUP BY 1, 2) GROUP BY 1")(
    lambda t: ridge.intercept_bound(train(t), TARGET))
_f = "CASE WHEN fold > 0 THEN coef END"
define("stab", f"SELECT *, n_same_sign = 5 AS sign_stable, row_number() OVER (PARTITION BY entity ORDER BY abs(c0) DESC, feature) AS rank_abs FROM (SELECT entity, feature, max(CASE WHEN fold = 0 THEN coef END) AS c0, avg({_f}) AS fm, stddev_samp({_f}) AS fs, min({_f}) AS fmin, max({_f}) AS fmax, "
       "count(CASE WHEN fold > 0 AND sign(coef) = sign(f0) THEN 1 END) AS n_same_sign FROM (SELECT *, max(CASE WHEN fold = 0 THEN coef END) OVER (PARTITION BY entity, feature) AS f0 FROM onec) GROUP BY 1, 2)")
query("j06_coef_stability", f"SELECT entity, feature, {r('c0')} AS coef, {r('fm')} AS fold_mean, {r('fs')} AS fold_sd, {r('fmin')} AS fold_min, {r('fmax')} AS fold_max, n_same_sign, sign_stable, rank_abs FROM stab")(lambda t: ridge.coef_stability(coefs(t)))
query("j06_coef_stability_all_features")(lambda t: ridge.coef_stability(ridge.fold_coefs(train(t), XS, TARGET, selection(t), h=1)))
query("j07_top_features", f"SELECT entity, rank, feature, {r('coef')} AS coef FROM cfull WHERE rank <= 10")(lambda t: ridge.top_features(full_coefs(t)))
query("j08_category_contribution", f"SELECT e.entity, e.category, CAST(count(coef) AS BIGINT) AS n, {r('coalesce(sum(abs(coef)), 0)')} AS sum_abs, {r('coalesce(avg(abs(coef)), 0)')} AS mean_abs, {r('coalesce(max(abs(coef)), 0)')} AS max_abs, arg_max(feature, struct_pack(a := abs(coef), f := feature)) FILTER (WHERE coef IS NOT NULL) AS top_feature FROM "
      "(SELECT DISTINCT entity, c AS category FROM cfull CROSS JOIN (VALUES ('base'), ('lag'), ('rolling'), ('split'), ('period'), ('interaction')) v(c)) e LEFT JOIN cfull USING (entity, category) GROUP BY 1, 2")(
    lambda t: ridge.category_contribution(full_coefs(t)))
query("j09_magnitude_summary", f"SELECT entity, {r('mx')} AS max_abs, {r('av')} AS mean_abs, {r('sm')} AS sum_abs, {r('md')} AS median_abs, n_stable, {r('mx / (SELECT max(abs(c0)) FROM stab WHERE entity = ' + chr(39) + 'ASIA' + chr(39) + ')')} AS ratio_to_baseline FROM (SELECT entity, max(abs(c0)) AS mx, avg(abs(c0)) AS av, "
      "sum(abs(c0)) AS sm, quantile_cont(abs(c0), 0.5) AS md, CAST(count(CASE WHEN sign_stable THEN 1 END) AS BIGINT) AS n_stable FROM stab GROUP BY 1)")(lambda t: ridge.magnitude_summary(ridge.coef_stability(coefs(t)), "ASIA"))


def chosen(t):
    """Penalty of every entity by cross-validation of the whole model one month ahead."""
    return ridge.select_alpha(ridge.alpha_cv(train(t), XS, TARGET, ALPHAS, h=1))


def walk(t):
    return ridge.direct_walk_forward(matrix(t), XS, TARGET, chosen(t), TEST_START, HORIZONS)


def walk_one(t):
    """One feature, with the penalty that its own cross-validation selects."""
    return ridge.direct_walk_forward(matrix(t), ["ORDERS"], TARGET, selection(t), TEST_START, HORIZONS)


query("j10_direct_h_walk_forward")(walk)
# a row of month m trains the response of m + h, so it counts from origin m + h on
define("jrow", "SELECT a.entity, h, a.ts, a.ORDERS AS x, a.REVENUE AS now, b.REVENUE AS y, b.ts AS known FROM fmat a CROSS JOIN (VALUES (1), (3), (6), (12)) v(h) JOIN fmat b ON b.entity = a.entity AND b.ts = CAST(a.ts + to_months(h) AS DATE) "
       "WHERE a.ORDERS IS NOT NULL AND b.REVENUE IS NOT NULL")
define("jfit", "SELECT o.entity, o.h, o.ts, any_value(o.x) AS x, any_value(o.now) AS now, any_value(o.y) AS y, any_value(o.known) AS known, count(*) AS n, avg(t.x) AS mx, var_pop(t.x) AS vx, covar_pop(t.x, t.y) AS cxy, avg(t.y) AS my "
       f"FROM jrow o JOIN jrow t ON t.entity = o.entity AND t.h = o.h AND t.known <= o.ts WHERE o.ts >= DATE '{TEST_START}' AND o.ts <= (SELECT max(ts) FROM fmat e WHERE e.entity = o.entity AND REVENUE IS NOT NULL) - INTERVAL 12 MONTH GROUP BY 1, 2, 3")
define("jone", "SELECT f.entity, f.h, f.ts AS origin_date, known AS target_date, y AS y_true, now AS y_naive, n AS n_train, CASE WHEN n >= 20 THEN my + cxy / vx * n / (n + alpha) * (x - mx) END AS y_pred FROM jfit f JOIN csel USING (entity)")
query("j10_direct_h_walk_forward_one_feature", f"SELECT entity, CAST(h AS BIGINT) AS h, origin_date, target_date, {r('y_true')} AS y_true, {r('y_naive')} AS y_naive, n_train, {r('y_pred')} AS y_pred FROM jone")(walk_one)
query("j10_direct_naive_part", "SELECT a.entity, CAST(h AS BIGINT) AS h, a.ts AS origin_date, CAST(a.ts + to_months(h) AS DATE) AS target_date, " + r("a.REVENUE") + " AS y_naive, " + r("b.REVENUE") + " AS y_true FROM fmat a CROSS JOIN (VALUES (1), (3), (6), (12)) v(h) "
      f"JOIN fmat b ON b.entity = a.entity AND b.ts = CAST(a.ts + to_months(h) AS DATE) WHERE a.ts >= DATE '{TEST_START}' AND a.ts <= (SELECT max(ts) FROM fmat e WHERE e.entity = a.entity) - INTERVAL 12 MONTH")(
    lambda t: walk(t).select("entity", "h", "origin_date", "target_date", "y_naive", "y_true"))


def tscale(t):
    return ev.naive_scale(ft.train_rows(matrix(t), NAMES, TRAIN_END), TARGET, TRAIN_END)


def drift_metrics(t, layer="drift"):
    f = forecasts(t).filter("form = 'level'")
    naive = f.filter("layer = 'naive'").select("entity", "h", "origin_date", F.col("y_pred").alias("y_naive"))
    return ridge.direct_metrics(f.filter(F.col("layer") == layer).join(naive, ["entity", "h", "origin_date"]), level_scale(t))


query("j11_direct_metrics_ridge")(lambda t: ridge.direct_metrics(walk(t), tscale(t)))
define("jscale", f"SELECT entity, avg(abs(d)) AS scale FROM (SELECT entity, REVENUE - lag(REVENUE) OVER (PARTITION BY entity ORDER BY ts) AS d FROM fmat WHERE {ALLOK} AND ts <= DATE '{TRAIN_END}') GROUP BY 1")
query("j11_direct_metrics_one_feature", f"SELECT entity, h, n AS n_origins, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('bias')} AS bias, {r('med')} AS median_ae, {r('nr')} AS naive_rmse, {r('nm')} AS naive_mae, {r('rmse / nr')} AS rmse_ratio, {r('mae / scale')} AS mase FROM "
      "(SELECT entity, CAST(h AS BIGINT) AS h, count(*) AS n, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae, avg(y_true - y_pred) AS bias, quantile_cont(abs(y_true - y_pred), 0.5) AS med, "
      "sqrt(avg(pow(y_true - y_naive, 2))) AS nr, avg(abs(y_true - y_naive)) AS nm FROM jone WHERE y_pred IS NOT NULL GROUP BY 1, 2) JOIN jscale USING (entity)")(lambda t: ridge.direct_metrics(walk_one(t), tscale(t)))
define("dmet", "SELECT entity, h, layer, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e) AS bias, quantile_cont(abs(e), 0.5) AS med, sqrt(avg(ne * ne)) AS nr, avg(abs(ne)) AS nm, avg(abs(e)) / any_value(scale) AS mase FROM (SELECT a.*, a.y_true - b.y_pred AS ne FROM fce a "
       "JOIN fc b ON b.layer = 'naive' AND a.entity = b.entity AND a.form = b.form AND a.h = b.h AND a.origin_date = b.origin_date WHERE a.form = 'level') JOIN nscale USING (entity) GROUP BY ALL")
query("j11_direct_metrics", f"SELECT entity, h, n AS n_origins, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('bias')} AS bias, {r('med')} AS median_ae, {r('nr')} AS naive_rmse, {r('nm')} AS naive_mae, {r('rmse / nr')} AS rmse_ratio, {r('mase')} AS mase FROM dmet WHERE layer = 'drift'")(drift_metrics)
query("j12_layer_mase_compare", f"SELECT entity, h, {r('a.mase')} AS mase_1, {r('b.mase')} AS mase_2, {r('b.mase - a.mase')} AS delta, {r('-100 * (b.mase - a.mase) / a.mase')} AS improvement_pct, CASE WHEN abs(b.mase - a.mase) <= 1e-9 THEN 'tie' WHEN b.mase < a.mase THEN 'drift' ELSE 'snaive' END AS winner "
      "FROM (SELECT * FROM dmet WHERE layer = 'snaive') a JOIN (SELECT * FROM dmet WHERE layer = 'drift') b USING (entity, h)")(lambda t: ridge.layer_compare(drift_metrics(t, "snaive"), drift_metrics(t), ("snaive", "drift")))
_ratio = ", ".join(f"{r(f'max(CASE WHEN h = {h} THEN rmse / nr END)')} AS ratio_h{h}" for h in HORIZONS)
query("j13_entity_scorecard", f"SELECT s.entity, s.alpha, s.boundary, a.feature AS top_1, b.feature AS top_2, c.feature AS top_3, m.* EXCLUDE (entity) FROM csel s JOIN cfull a ON a.entity = s.entity AND a.rank = 1 JOIN cfull b ON b.entity = s.entity AND b.rank = 2 JOIN cfull c ON c.entity = s.entity AND c.rank = 3 "
      f"JOIN (SELECT entity, {_ratio}, CAST(count(CASE WHEN rmse / nr < 1 THEN 1 END) AS BIGINT) AS n_beats_naive FROM dmet WHERE layer = 'drift' GROUP BY 1) m ON m.entity = s.entity")(
    lambda t: ridge.entity_scorecard(selection(t), ridge.top_features(full_coefs(t)), drift_metrics(t), HORIZONS))
query("j14_lens_audit", f"SELECT t.entity, in_top, matching, is_base, negative, {r('coef')} AS coef, in_top AND is_base AND negative AS passes FROM (SELECT entity, bool_or(feature = 'AVGVAL') AS in_top, coalesce(string_agg(CASE WHEN feature LIKE '%roll%' THEN feature END, ',' ORDER BY feature), '') AS matching FROM cfull WHERE rank <= 5 GROUP BY 1) t "
      "JOIN (SELECT entity, category = 'base' AS is_base, coef < 0 AS negative, coef FROM cfull WHERE feature = 'AVGVAL') USING (entity)")(lambda t: ridge.lens_audit(full_coefs(t), "AVGVAL", "roll"))
query("j15_heterogeneity_stats", "SELECT s.*, entity AS matching_entity, coalesce(n, 0) AS n_matching FROM (SELECT max(alpha) AS alpha_max, min(alpha) AS alpha_min, (SELECT entity FROM csel ORDER BY alpha DESC, entity DESC LIMIT 1) AS entity_max, (SELECT entity FROM csel ORDER BY alpha, entity LIMIT 1) AS entity_min, "
      "max(alpha) / min(alpha) AS ratio FROM csel) s LEFT JOIN (SELECT entity, count(*) AS n FROM cfull WHERE rank <= 10 AND feature LIKE '%URGENT%' GROUP BY 1) ON true")(
    lambda t: ridge.heterogeneity(selection(t), ridge.top_features(full_coefs(t)), "URGENT"))
