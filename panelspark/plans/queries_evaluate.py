"""Registered queries: forecast evaluation. Benchmark forecasts make every result checkable in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import evaluate as ev
from panelspark.operators.clean import densify
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r, t_two_sided
from panelspark.plans.panels import EXCLUDED, PERIODS, TARGET, TRAIN_END, region_panel
from panelspark.plans.standins import ALT_ENTITY, LAYERS, forecasts

PAIRS = ev.pairs_of(LAYERS[:3])
MULTI = ("snaive", "drift")
EXTRA = [(ALT_ENTITY, "yoy_pct", 1, "naive", "drift", "alternate_form")]
KEY = "entity, form, h, layer"

define("fce", "SELECT *, y_true - y_pred AS e FROM fc")
define("fcx", f"SELECT * FROM fc WHERE origin_date NOT IN ({', '.join(f'DATE {chr(39)}{d}{chr(39)}' for d in EXCLUDED)})")
define("nscale", f"SELECT entity, avg(abs(REVENUE - lag1)) AS scale FROM (SELECT entity, ts, REVENUE, lag(REVENUE) OVER (PARTITION BY entity ORDER BY ts) AS lag1 FROM panel WHERE ts <= DATE '{TRAIN_END}') GROUP BY 1")

query("k01_rmse", f"SELECT {KEY}, {r('sqrt(avg(e * e))')} AS rmse FROM fce GROUP BY ALL")(
    lambda t: ev.errors(forecasts(t)).groupBy("entity", "form", "h", "layer").agg(ev.rmse(F.col("e")).alias("rmse")))
query("k02_mae", f"SELECT {KEY}, {r('avg(abs(e))')} AS mae FROM fce GROUP BY ALL")(
    lambda t: ev.errors(forecasts(t)).groupBy("entity", "form", "h", "layer").agg(ev.mae(F.col("e")).alias("mae")))


def scale(t, period=1):
    return ev.naive_scale(densify(region_panel(t).select("entity", "ts", TARGET)), TARGET, TRAIN_END, period)


query("k03_mase", f"SELECT entity, h, layer, n, {r('mae')} AS mae, {r('scale')} AS scale, {r('mae / scale')} AS mase FROM (SELECT entity, h, layer, count(*) AS n, avg(abs(e)) AS mae FROM fce WHERE form = 'level' GROUP BY ALL) JOIN nscale USING (entity)")(
    lambda t: ev.mase(ev.errors(forecasts(t)).filter("form = 'level'"), scale(t), ["entity", "h", "layer"]))
query("k04_naive_scale", f"SELECT entity, {r('scale')} AS scale, {r('seasonal')} AS seasonal FROM nscale JOIN (SELECT entity, avg(abs(REVENUE - l)) AS seasonal FROM (SELECT entity, REVENUE, lag(REVENUE, 12) OVER (PARTITION BY entity ORDER BY ts) AS l FROM panel "
      f"WHERE ts <= DATE '{TRAIN_END}') GROUP BY 1) USING (entity)")(lambda t: scale(t).join(scale(t, 12).withColumnRenamed("scale", "seasonal"), "entity"))
query("k05_hln_factor", f"SELECT {KEY}, n, {r('sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)')} AS factor FROM (SELECT {KEY}, count(*) AS n FROM fc GROUP BY ALL)")(
    lambda t: forecasts(t).groupBy("entity", "form", "h", "layer").agg(F.count(F.lit(1)).alias("n")).withColumn("factor", ev.hln_factor(F.col("n"), F.col("h"))))


def aligned_sql(src, pairs=PAIRS):
    ps = ", ".join(f"('{a}','{b}')" for a, b in pairs)
    return (f"SELECT a.entity, a.form, a.h, l1 AS layer_1, l2 AS layer_2, a.target_date, a.y_true, a.y_true - a.y_pred AS e1, a.y_true - b.y_pred AS e2, pow(a.y_true - a.y_pred, 2) - pow(a.y_true - b.y_pred, 2) AS d, "
            f"abs(a.y_true - a.y_pred) - abs(a.y_true - b.y_pred) AS da FROM {src} a JOIN (VALUES {ps}) p(l1, l2) ON a.layer = l1 JOIN {src} b ON b.layer = l2 AND a.entity = b.entity AND a.form = b.form AND a.h = b.h AND a.target_date = b.target_date")


define("al", aligned_sql("fc"))
define("alx", aligned_sql("fcx"))
CELLS = "entity, form, h, layer_1, layer_2"


def lrv_sql(src):
    lags = " + ".join(f"CASE WHEN h > {k} THEN 2 * (1 - {k}::DOUBLE / h) * coalesce(sum(c * c{k}), 0) ELSE 0 END" for k in range(1, 12))
    return (f"SELECT {CELLS}, count(*) AS n, avg(d) AS md, avg(da) AS mda, var_samp(d) AS vd, var_samp(da) AS vda, bool_and(abs(d) <= 1e-8) AS z, bool_and(abs(da) <= 1e-8) AS za, (sum(c * c) + {lags}) / count(*) AS lrv FROM (SELECT *, " + ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, 12)) +
            f" FROM (SELECT *, d - avg(d) OVER (PARTITION BY {CELLS}) AS c FROM {src}) WINDOW w AS (PARTITION BY {CELLS} ORDER BY target_date)) GROUP BY {CELLS}")


HLN = "sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)"


def dm_sql(src):
    return (f"SELECT *, {t_two_sided('dm_standard', '(n - 1)')} AS p_standard, {t_two_sided('dm_hac', '(n - 1)')} AS p_hac, {t_two_sided('dm_robust', '(n - 1)')} AS p_robust FROM (SELECT *, CASE WHEN z THEN 0 ELSE md / sqrt(vd / n) * {HLN} END AS dm_standard, "
            f"CASE WHEN z THEN 0 WHEN lrv > 0 THEN md / sqrt(lrv / n) * {HLN} END AS dm_hac, CASE WHEN za THEN 0 ELSE mda / sqrt(vda / n) * {HLN} END AS dm_robust FROM ({lrv_sql(src)}) WHERE n > h)")


define("dm", dm_sql("al"))
define("dmx", dm_sql("alx"))
query("k06_loss_differential", f"SELECT {CELLS}, target_date, {r('d')} AS d_squared, {r('da')} AS d_absolute FROM al")(
    lambda t: ev.align_matched(forecasts(t), PAIRS).select(*ev.CELL, "target_date", ev.loss_differential(F.col("e1"), F.col("e2")).alias("d_squared"),
                                                           ev.loss_differential(F.col("e1"), F.col("e2"), "absolute").alias("d_absolute")))
query("k07_newey_west_lrv", f"SELECT {CELLS}, n, {r('lrv')} AS lrv FROM ({lrv_sql('al')})")(
    lambda t: ev.newey_west(ev.align_matched(forecasts(t), PAIRS).withColumn("d", ev.loss_differential(F.col("e1"), F.col("e2")))))


def tests(t):
    return ev.dm_tests(ev.align_matched(forecasts(t), PAIRS))


for _i, _v in (("08", "standard"), ("09", "hac"), ("10", "robust")):
    query(f"k{_i}_dm_{_v}", f"SELECT {CELLS}, n AS n_paired, {r(f'dm_{_v}')} AS dm, {r(f'p_{_v}')} AS p FROM dm")(
        lambda t, v=_v: tests(t).select(*ev.CELL, "n_paired", F.col(f"dm_{v}").alias("dm"), F.col(f"p_{v}").alias("p")))
query("k11_align_matched", f"SELECT {CELLS}, target_date, {r('y_true')} AS y_true, {r('e1')} AS e1, {r('e2')} AS e2 FROM al")(lambda t: ev.align_matched(forecasts(t), PAIRS))


def manifest(t):
    return ev.cell_manifest(t.region.select(F.col("r_name").alias("entity")), PAIRS, MULTI, (1, 3, 6, 12), "level", EXTRA)


_one = " UNION ALL ".join(f"SELECT 'level' AS form, 1 AS h, '{a}' AS layer_1, '{b}' AS layer_2, 'primary_h1' AS scope" for a, b in PAIRS)
_multi = " UNION ALL ".join(f"SELECT 'level', {h}, '{MULTI[0]}', '{MULTI[1]}', 'primary_multi'" for h in (3, 6, 12))
define("cells", f"SELECT entity, form, CAST(h AS BIGINT) AS h, layer_1, layer_2, scope, true AS \"primary\" FROM (SELECT DISTINCT entity FROM panel) CROSS JOIN ({_one} UNION ALL {_multi}) UNION ALL "
       f"SELECT '{ALT_ENTITY}', 'yoy_pct', CAST(1 AS BIGINT), 'naive', 'drift', 'alternate_form', false")
query("k12_cell_manifest", "SELECT * FROM cells")(manifest)
define("nlayer", f"SELECT {KEY}, count(*) AS n FROM fc GROUP BY ALL")
query("k13_cell_coverage", "SELECT c.*, coalesce(a.n, 0) AS n_layer_1, coalesce(b.n, 0) AS n_layer_2, coalesce(p.n, 0) AS n_paired, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'MISSING' "
      "WHEN p.n IS NULL THEN 'ERROR: no common targets' WHEN p.n < 30 THEN 'UNDERPOWERED' ELSE 'OK' END AS status FROM cells c LEFT JOIN nlayer a ON a.entity = c.entity AND a.form = c.form AND a.h = c.h "
      "AND a.layer = c.layer_1 LEFT JOIN nlayer b ON b.entity = c.entity AND b.form = c.form AND b.h = c.h AND b.layer = c.layer_2 LEFT JOIN dm p ON p.entity = c.entity AND p.form = c.form AND p.h = c.h AND p.layer_1 = c.layer_1 AND p.layer_2 = c.layer_2")(
    lambda t: ev.cell_coverage(manifest(t), forecasts(t), PAIRS))


def win(v):
    return f"CASE WHEN dm_{v} IS NULL THEN 'undefined' WHEN p_{v} >= 0.05 THEN 'tie' WHEN dm_{v} < 0 THEN layer_1 ELSE layer_2 END"


def battery_sql(dm, cells="cells", minimum=30):
    w = ", ".join(f"{win(v)} AS winner_{v}, coalesce(p_{v} < 0.05, false) AS sig_{v}" for v in ("standard", "hac", "robust"))
    cols = ", ".join(f"{r(f'dm_{v}')} AS dm_{v}, {r(f'p_{v}')} AS p_{v}" for v in ("standard", "hac", "robust"))
    return (f"SELECT *, winner_standard = winner_hac AND winner_standard = winner_robust AS agreement FROM (SELECT {CELLS}, scope, \"primary\", n AS n_paired, {r('md')} AS d_mean_squared, {r('mda')} AS d_mean_absolute, {cols}, {w}, "
            f"coalesce(p_standard < 0.01, false) AS sig_standard_strict FROM {cells} JOIN {dm} USING ({CELLS}) WHERE n >= {minimum})")


define("bat", battery_sql("dm"))
define("batx", battery_sql("dmx"))


def battery(t):
    return ev.dm_battery(forecasts(t), manifest(t), PAIRS)


query("k14_dm_battery", "SELECT * FROM bat")(battery)
query("k15_winner", f"SELECT {CELLS}, {win('standard').replace('0.05', '0.2')} AS winner_loose, {win('standard')} AS winner FROM dm")(
    lambda t: tests(t).select(*ev.CELL, ev.winner(F.col("dm_standard"), F.col("p_standard"), F.col("layer_1"), F.col("layer_2"), 0.2).alias("winner_loose"),
                              ev.winner(F.col("dm_standard"), F.col("p_standard"), F.col("layer_1"), F.col("layer_2")).alias("winner")))
_cnt = ", ".join(f"CAST(count(CASE WHEN {c} THEN 1 END) AS BIGINT) AS n_{c}" for c in ("sig_standard_strict", "sig_standard", "sig_hac", "sig_robust")) + ", " + ", ".join(
    f"CAST(count(CASE WHEN winner_standard = '{x}' THEN 1 END) AS BIGINT) AS {n}" for x, n in ((LAYERS[0], "wins_naive"), (LAYERS[1], "wins_snaive"), (LAYERS[2], "wins_drift"), ("tie", "ties"), ("undefined", "undefined")))
query("k16_battery_summary", " UNION ALL ".join(f"SELECT '{k}' AS grouping, {v} AS value, count(*) AS n_cells, {_cnt}, {r('avg(CASE WHEN agreement THEN 1.0 ELSE 0.0 END)')} AS agreement_rate FROM bat GROUP BY 1, 2" for k, v in (
    ("pair", "layer_1 || '-' || layer_2"), ("entity", "entity"), ("horizon", "CAST(h AS VARCHAR)"), ("scope", "scope"), ("overall", "'all'"))))(lambda t: ev.battery_summary(battery(t), LAYERS[:3]))


def trimmed(t):
    return ev.trimmed_battery(forecasts(t), manifest(t), PAIRS, EXCLUDED)


define("lost", f"SELECT {KEY}, CAST(count(CASE WHEN origin_date IN ({', '.join(f'DATE {chr(39)}{d}{chr(39)}' for d in EXCLUDED)}) THEN 1 END) AS BIGINT) AS n FROM fc GROUP BY ALL")
query("k17_exclude_origins", "SELECT b.*, x.n AS n_excluded_1, y.n AS n_excluded_2 FROM batx b JOIN lost x ON x.entity = b.entity AND x.form = b.form AND x.h = b.h AND x.layer = b.layer_1 JOIN lost y ON y.entity = b.entity AND y.form = b.form AND y.h = b.h AND y.layer = b.layer_2")(trimmed)
_vd = ", ".join(f"b.winner_{v} AS {v}_before, a.winner_{v} AS {v}_after, b.winner_{v} <> a.winner_{v} AS flip_{v}, CASE WHEN b.winner_{v} = a.winner_{v} THEN 'no change' ELSE b.winner_{v} || ' → ' || a.winner_{v} END AS change_{v}" for v in ("standard", "hac", "robust"))
query("k18_verdict_delta", f"SELECT *, flip_standard OR flip_hac OR flip_robust AS any_flip FROM (SELECT {CELLS}, a.n_paired AS n_after, {_vd} FROM bat b JOIN batx a USING ({CELLS}))")(lambda t: ev.verdict_delta(battery(t), trimmed(t)))


@query("k19_tag_rules", f"SELECT {CELLS}, array_to_string(list_sort(list_filter(['T1-all', CASE WHEN form <> 'level' THEN 'T5-alternate' END, CASE WHEN h > 1 THEN 'T3-multi' END, CASE WHEN layer_1 = 'naive' OR layer_2 = 'naive' THEN 'T2-naive' END, "
       "CASE WHEN sig_robust THEN 'T4-robust' END], lambda x: x IS NOT NULL)), ',') AS tags FROM bat")
def k19(t):
    b = battery(t)
    rules = [("T1-all", F.lit(True)), ("T5-alternate", F.col("form") != "level"), ("T3-multi", F.col("h") > 1),
             ("T2-naive", (F.col("layer_1") == "naive") | (F.col("layer_2") == "naive")), ("T4-robust", F.col("sig_robust"))]
    return b.select(*ev.CELL, ev.tags(rules).alias("tags"))


define("ori", "SELECT entity, origin_date, bool_or(layer = 'drift') AS a, bool_or(layer = 'mean12') AS b FROM fc WHERE layer IN ('drift', 'mean12') GROUP BY 1, 2")
query("k20_origin_set_integrity", "SELECT entity, CAST(count(CASE WHEN a THEN 1 END) AS BIGINT) AS n_a, CAST(count(CASE WHEN b THEN 1 END) AS BIGINT) AS n_b, CAST(count(CASE WHEN a AND b THEN 1 END) AS BIGINT) AS n_common, CAST(count(CASE WHEN a AND NOT b THEN 1 END) AS BIGINT) "
      "AS n_only_a, CAST(count(CASE WHEN b AND NOT a THEN 1 END) AS BIGINT) AS n_only_b, any_value(hs) AS horizons, bool_and(a = b) AS equal FROM ori JOIN (SELECT entity AS e0, string_agg(h::VARCHAR, ',' ORDER BY h) AS hs FROM "
      "(SELECT DISTINCT entity, h FROM fc WHERE layer IN ('drift', 'mean12')) GROUP BY 1) ON e0 = entity GROUP BY 1")(lambda t: ev.origin_integrity(forecasts(t), "drift", "mean12"))
query("k21_divergent_cells", "SELECT * FROM bat WHERE winner_standard = 'tie' AND sig_robust")(lambda t: ev.divergent_cells(battery(t)))
_w = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)
query("h08_window_errors", f"SELECT {KEY}, \"window\", count(*) AS n, {r('sqrt(avg(e * e))')} AS rmse, {r('avg(abs(e))')} AS mae, {r('avg(e)')} AS bias FROM fce JOIN (VALUES ('full', DATE '1900-01-01', DATE '2100-01-01'), {_w}) w(\"window\", a, b) ON target_date BETWEEN a AND b GROUP BY ALL")(
    lambda t: ev.window_errors(forecasts(t), PERIODS, ["entity", "form", "h", "layer"]))
