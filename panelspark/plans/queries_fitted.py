"""Registered queries: the comparison of fitted models.

Seasonal ARMA, vector autoregression and ridge forecasts of the order panel, each refitted at every origin, go through the adapters into one
table and on to the paired tests, as one plan. The same chain with the smallest models (a seasonal mean, one lag of one variable, one
feature) is also registered, and SQL checks it end to end.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from panelspark.operators import evaluate as ev
from panelspark.operators import ridge, sarma, var
from panelspark.operators.clean import densify
from panelspark.plans import oracle
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define
from panelspark.plans.panels import ENTITIES, HORIZONS, INDICATORS, TARGET, TEST_START, region_panel
from panelspark.plans.queries_evaluate import aligned_sql, battery_sql, dm_sql
from panelspark.plans.queries_features import ALT, EXOG, both_forms
from panelspark.plans.queries_ridge import ALPHAS, XS
from panelspark.plans.queries_var import ENDOG, P
from panelspark.sources import forecasts as adapters

SEASON, LONG, GRID = 12, 6, (2, 1, 1, 0)
#: First origin, and pairs that a cell needs: models want four years of history, which leaves few origins.
START, MINIMUM = dt.date(1999, 1, 1), 12
LAYERS = ("univariate", "multivariate", "direct")
PAIRS = ev.pairs_of(LAYERS)
MULTI = ("multivariate", "direct")
#: The entity whose second form is compared as well, one step ahead.
SECOND = "ASIA"


def univariate(series, orders, grid):
    walk = sarma.expanding_one_step(series, orders, SEASON, LONG, START, "month", *grid)
    return walk.select("variant_id", F.col("ts").alias("date"), "actual", "predicted")


def direct(rows, features, alpha, keys):
    walk = ridge.direct_walk_forward(rows, features, TARGET, alpha, START, HORIZONS, keys).filter(F.col("y_pred").isNotNull())
    return walk.withColumnsRenamed({"y_true": "actual", "y_pred": "forecast"})


def forecasts(t):
    """Forecasts of all three layers from models that are chosen on rows before the first origin and refitted at every origin."""
    m = both_forms(t)
    keys = ("entity", "variant")
    series = m.filter(F.col(TARGET).isNotNull()).select(F.concat_ws("_", *keys).alias("variant_id"), "ts", F.col(TARGET).alias("y"))
    past = F.col("ts") < F.lit(START)
    orders = sarma.select_order(sarma.fit_order_grid(series.filter(past), SEASON, LONG, "month", *GRID))
    one = univariate(series, orders.select("variant_id", *sarma.parse_order("aic_order")), GRID)
    primary = m.filter("variant = 'primary'").select("entity", "ts", *INDICATORS, *EXOG)
    alpha = ridge.select_alpha(ridge.alpha_cv(m.filter(past), XS, TARGET, ALPHAS, keys, h=1), keys)
    return adapters.unify_forecasts(
        adapters.adapt_univariate(one, [(f"{e}_{f}", e, f) for e in ENTITIES for f in ("primary", ALT)]),
        adapters.adapt_multivariate(var.walk_forward(primary, ENDOG, P, EXOG, START, HORIZONS), TARGET, "primary", guard=False),
        adapters.adapt_direct(direct(m, XS, alpha, keys).withColumnRenamed("variant", "form_label"), [("primary", "primary"), (ALT, ALT)]), names=LAYERS)


def entities(t):
    return t.region.select(F.col("r_name").alias("entity"))


def manifest(t):
    return ev.cell_manifest(entities(t), PAIRS, MULTI, HORIZONS, "primary", [(SECOND, ALT, 1, "univariate", "direct", "alternate_form")])


query("a10_unify_forecasts_fitted")(forecasts)


def battery(t):
    return ev.dm_battery(forecasts(t), manifest(t), PAIRS, MINIMUM)


query("k14_dm_battery_fitted")(battery)


# the same chain with models that SQL can fit
def small_forecasts(t):
    rows = densify(region_panel(t).select("entity", "ts", TARGET, "ORDERS"))
    series = rows.select(F.col("entity").alias("variant_id"), "ts", F.col(TARGET).alias("y"))
    orders = series.select("variant_id").distinct().select("variant_id", *[F.lit(v).cast("bigint").alias(c) for c, v in (("p", 0), ("q", 0), ("P_s", 0), ("D_s", 1), ("Q_s", 0))])
    alpha = ridge.select_alpha(ridge.alpha_cv(rows.filter(F.col("ts") < F.lit(START)), ["ORDERS"], TARGET, ALPHAS))
    walk = var.walk_forward(rows.select("entity", "ts", TARGET), [TARGET], 1, [], START, HORIZONS)
    return adapters.unify_forecasts(
        adapters.adapt_univariate(univariate(series, orders, (0, 0, 0, 0)), [(e, e, "level") for e in ENTITIES]),
        adapters.adapt_multivariate(walk, TARGET, "level", guard=False),
        adapters.adapt_direct(direct(rows, ["ORDERS"], alpha, ("entity",)).withColumn("form_label", F.lit("level")), [("level", "level")]), names=LAYERS)


def _like(name: str, source: str, **renamed: str) -> None:
    """A building block like ``source`` with other tables or dates in it."""
    sql = oracle.CTES[source]
    for a, b in renamed.items():
        sql = re.sub(rf"\b{a}\b", b, sql)
    define(name, sql.replace(str(TEST_START), str(START)))


define("ptrain", f"SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM panel WHERE ts < DATE '{START}'")
_like("pb", "jb", jtrain="ptrain")
_like("pcvm", "cvm", jb="pb")
_like("pcvs", "cvs", cvm="pcvm", jb="pb")
_like("pcva", "cva", cvs="pcvs")
_like("pcvsel", "cvsel", cva="pcva")
_like("pcsel", "csel", cvsel="pcvsel", cva="pcva")
_like("prow", "jrow", fmat="panel")
_like("pfit", "jfit", jrow="prow", fmat="panel")
_like("pone", "jone", jfit="pfit", csel="pcsel")
define("pmean", "SELECT entity, ts, y, b + avg(y - b) OVER w AS pred, count(*) OVER w AS n FROM (SELECT entity, ts, REVENUE AS y, lag(REVENUE, 12) OVER (PARTITION BY entity ORDER BY ts) AS b FROM panel) "
       "WHERE b IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
define("pfc", f"SELECT 'univariate' AS layer, entity, 'level' AS form, CAST(1 AS BIGINT) AS h, CAST(ts - INTERVAL 1 MONTH AS DATE) AS origin_date, ts AS target_date, y AS y_true, pred AS y_pred FROM pmean WHERE ts >= DATE '{START}' AND n > 1 "
       "UNION ALL SELECT 'multivariate', a.entity, 'level', CAST(h AS BIGINT), a.ts, b.ts, b.REVENUE, c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * a.y FROM arw a CROSS JOIN (VALUES (1), (3), (6), (12)) v(h) "
       f"JOIN panel b ON b.entity = a.entity AND b.ts = CAST(a.ts + to_months(h) AS DATE) WHERE a.ts >= DATE '{START}' AND a.ts <= (SELECT max(ts) FROM panel e WHERE e.entity = a.entity) - INTERVAL 12 MONTH AND n >= 15 "
       "UNION ALL SELECT 'direct', entity, 'level', CAST(h AS BIGINT), origin_date, target_date, y_true, y_pred FROM pone WHERE y_pred IS NOT NULL")
define("pal", aligned_sql("pfc", PAIRS))
define("pdm", dm_sql("pal"))
_cell = " UNION ALL ".join([*[f"SELECT 1 AS h, '{a}' AS layer_1, '{b}' AS layer_2, 'primary_h1' AS scope" for a, b in PAIRS],
                            *[f"SELECT {h}, '{MULTI[0]}', '{MULTI[1]}', 'primary_multi'" for h in HORIZONS if h != 1]])
define("pcells", f"SELECT entity, 'level' AS form, CAST(h AS BIGINT) AS h, layer_1, layer_2, scope, true AS \"primary\" FROM (SELECT DISTINCT entity FROM panel) CROSS JOIN ({_cell})")


def small_manifest(t):
    return ev.cell_manifest(entities(t), PAIRS, MULTI, HORIZONS, "level")


query("a10_unify_forecasts_small_models", "SELECT layer, entity, form, h, origin_date, target_date, " + oracle.r("y_true") + " AS y_true, " + oracle.r("y_pred") + " AS y_pred FROM pfc")(small_forecasts)
query("k14_dm_battery_small_models", battery_sql("pdm", "pcells", MINIMUM))(lambda t: ev.dm_battery(small_forecasts(t), small_manifest(t), PAIRS, MINIMUM))
