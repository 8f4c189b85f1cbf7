"""Registered queries: sources, adapters, sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.plans.catalog import query
from panelspark.session import shared_folder
from panelspark.plans.oracle import define, r
from panelspark.functions.reshape import to_long
from panelspark.plans.panels import ENTITIES, INDICATORS, TARGET, nation_panel, region_panel
from panelspark.plans.standins import forecasts
from panelspark.sources import readers, sinks, textfiles
from panelspark.sources import forecasts as adapters

COLS = ", ".join(INDICATORS)

define("fser", """
SELECT entity, 'level' AS form, ts, REVENUE AS y FROM panel UNION ALL
SELECT entity, 'yoy_pct', ts, 100.0::DOUBLE * (REVENUE / lag(REVENUE, 12) OVER (PARTITION BY entity ORDER BY ts) - 1)
FROM panel WHERE entity = 'AFRICA' QUALIFY lag(REVENUE, 12) OVER (PARTITION BY entity ORDER BY ts) IS NOT NULL""")
define("fidx", f"""
SELECT *, row_number() OVER w AS k, first_value(y) OVER w AS y0,
  CASE WHEN row_number() OVER w >= 12 THEN {r('avg(y) OVER (PARTITION BY entity, form ORDER BY ts ROWS 11 PRECEDING)')} END AS m12
FROM fser WINDOW w AS (PARTITION BY entity, form ORDER BY ts)""")
define("fc", f"""
SELECT layer, entity, form, h, origin_date, target_date, y_true, y_pred FROM (
 SELECT l.layer, o.entity, o.form, CAST(hh.h AS BIGINT) AS h, o.ts AS origin_date, a.ts AS target_date, a.y AS y_true,
  CASE l.layer WHEN 'naive' THEN o.y WHEN 'mean12' THEN o.m12
   WHEN 'drift' THEN CASE WHEN o.k > 1 THEN {r('o.y + hh.h * (o.y - o.y0) / (o.k - 1)')} END
   ELSE s.y END AS y_pred
 FROM fidx o CROSS JOIN (VALUES (1), (3), (6), (12)) hh(h)
 CROSS JOIN (VALUES ('naive'), ('snaive'), ('drift'), ('mean12')) l(layer)
 JOIN fidx a ON a.entity = o.entity AND a.form = o.form AND a.k = o.k + hh.h
 LEFT JOIN fidx s ON s.entity = o.entity AND s.form = o.form AND s.k = o.k + hh.h - 12
 WHERE o.ts >= DATE '1997-01-01') WHERE y_pred IS NOT NULL""")


def fc_rounded(where: str) -> str:
    return ("SELECT layer, entity, form, h, origin_date, target_date, " + r("y_true") + " AS y_true, " + r("y_pred") +
            " AS y_pred FROM fc " + where)


@query("a01_read_series", "SELECT ts, " + r("sum(REVENUE)") + " AS value FROM panel GROUP BY ts")
def a01(t):
    total = region_panel(t).groupBy(F.col("ts").alias("date")).agg(F.sum(TARGET).alias("TOTAL_REVENUE"))
    path = shared_folder(t.spark)
    total.write.option("header", True).csv(path)
    return readers.read_series(t.spark, path, "TOTAL_REVENUE")


@query("a02_read_all_series", "SELECT entity, indicator, ts, value FROM plong")
def a02(t):
    path = shared_folder(t.spark)
    sinks.write_series_files(to_long(region_panel(t), INDICATORS), path)
    return readers.read_all_series(t.spark, path, "/entity=([^/]+)/indicator=([^/]+)/")


@query("a03_read_panel", f"SELECT entity, ts, {COLS} FROM panel")
def a03(t):
    path = shared_folder(t.spark)
    sinks.write_panel(region_panel(t), path)
    return readers.read_panel(t.spark, path, ENTITIES).select("entity", "ts", *INDICATORS)


@query("a04_sniff_date_column", "SELECT entity, ts, REVENUE AS value FROM npanel WHERE month(ts) <> 6")
def a04(t):
    raw = nation_panel(t).select("entity", F.when(F.month("ts") == 6, "n/a").otherwise(
        F.date_format("ts", "yyyy-MM-dd")).alias("observation_date"), F.col(TARGET).alias("value"))
    return readers.sniff_date_column(raw, "value")


@query("a05_ingest_messy_csv", "SELECT entity AS file, ts, " + r("REVENUE * 1000") + " AS value FROM npanel "
       "WHERE month(ts) <> 5 AND ts >= DATE '1996-01-01'")
def a05(t):
    p = nation_panel(t)
    when = F.when(F.month("ts") % 3 == 0, F.date_format("ts", "yyyyMM")).when(
        F.month("ts") % 2 == 0, F.date_format("ts", "yyyy-MM")).otherwise(
        F.concat(F.year("ts").cast("string"), F.lit("年"), F.month("ts").cast("string"), F.lit("月")))
    val = F.when(F.month("ts") == 5, "-").otherwise(F.concat(F.lit('"'), F.format_number(F.col(TARGET) * 1000, 3), F.lit('"')))
    data = p.select(F.col("entity").alias("file"), (F.months_between("ts", F.lit(dt.date(1994, 1, 1)))).cast("int").alias("line_no"),
                    F.concat_ws(",", when, "entity", val).alias("text"))
    names = p.select(F.col("entity").alias("file")).distinct()
    head = names.select("file", F.posexplode(F.array(
        F.concat(F.lit("Statistics of "), "file"), F.lit("unit: thousand"), F.lit("year-month,area,revenue value"))))
    head = head.select("file", F.col("pos").alias("line_no"), F.col("col").alias("text"))
    path = shared_folder(t.spark)
    lines = head.unionByName(data).repartition("file").sortWithinPartitions("file", "line_no").select(F.col("file").alias("of"), "text")
    plain = {"sep": "\x01", "quote": "\x00", "escape": "\x00"}  # one column, written as it is
    lines.write.partitionBy("of").options(**plain).csv(path)
    back = textfiles.read_lines(t.spark, path).withColumn("file", F.regexp_extract("file", "/of=([^/]+)/", 1))
    return readers.ingest_messy(back, ["year-month", "date"], ["value"], dt.date(1996, 1, 1))


@query("a06_explode_api_json", "SELECT event_id, DATE '2024-12-01' AS ts, CAST(k AS DOUBLE) AS value FROM (SELECT event_id, "
       "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 10 <> 0 AND k % 7 <> 0")
def a06(t):
    k = F.get_json_object("props", "$.k")
    shown = F.when(k.cast("int") % 10 == 0, "null").when(k.cast("int") % 7 == 0, '"n.a."').otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    payload = F.concat(F.lit('[{"page":1},[{"date":"'), F.year("ts").cast("string"), F.lit('","value":'), shown, F.lit("}]]"))
    return readers.explode_payload(t.events.select("event_id", payload.alias("payload")), "payload", ["event_id"])


def _univariate(t):
    one = forecasts(t).filter((F.col("layer") == "drift") & (F.col("h") == 1))
    when = F.when(F.month("target_date") % 2 == 0, F.date_format("target_date", "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format("target_date", "yyyy-MM-dd"))
    raw = one.select(F.concat_ws("_", "entity", "form").alias("variant_id"), when.alias("date"),
                     F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted"))
    variants = [(f"{e}_{f}", e, f) for e in ENTITIES for f in ("level", "yoy_pct")]
    return adapters.adapt_univariate(raw, variants)


def _multivariate(t, guard=True):
    raw = forecasts(t).filter((F.col("layer") == "mean12") & (F.col("form") == "level"))
    raw = raw.withColumn("variable", F.explode(F.array(F.lit(TARGET), F.lit("OTHER")))).select(
        "entity", "variable", "h", "origin_date", "target_date", F.col("y_true").alias("actual"), F.col("y_pred").alias("forecast"))
    return adapters.adapt_multivariate(raw, TARGET, "level", guard=guard)


def _direct(t):
    raw = forecasts(t).filter(F.col("layer") == "snaive").select(
        "entity", F.concat(F.col("form"), F.lit("_primary")).alias("form_label"), "h", "origin_date", "target_date",
        F.col("y_true").alias("actual"), F.col("y_pred").alias("forecast"))
    return adapters.adapt_direct(raw, [("level_primary", "level"), ("yoy_pct_primary", "yoy_pct")])


def _relabel(sql: str, layer: str) -> str:
    return sql.replace("SELECT layer,", f"SELECT '{layer}' AS layer,")


A07_SQL = _relabel(fc_rounded("WHERE layer = 'drift' AND h = 1"), "univariate")
A08_SQL = _relabel(fc_rounded("WHERE layer = 'mean12' AND form = 'level'"), "multivariate")
A09_SQL = _relabel(fc_rounded("WHERE layer = 'snaive'"), "direct")
query("a07_adapt_layer_univariate", A07_SQL)(_univariate)
query("a08_adapt_layer_multivariate", A08_SQL)(_multivariate)
query("a09_adapt_layer_direct", A09_SQL)(_direct)


@query("a10_unify_forecasts", f"{A07_SQL} UNION ALL {A08_SQL} UNION ALL {A09_SQL}")
def a10(t):
    return adapters.unify_forecasts(_univariate(t), _multivariate(t, False), _direct(t), names=["univariate", "multivariate", "direct"])


FORMS = {"REVENUE": "yoy_pct_with_caveat", "ORDERS": "yoy_pct", "URGENT": "first_diff", "BALANCE": "level_with_linear_trend",
         "AVGVAL": "log_diff_pct_with_regime_dummy"}
OVERRIDES = [("ASIA", "REVENUE", "first_diff"), ("EUROPE", "REVENUE", "log_diff_pct"), ("AMERICA", "BALANCE", "second_diff")]


def registry(t):
    """Transform per series: a default per indicator for every region of the dimension table."""
    forms = F.array(*[F.struct(F.lit(i).alias("indicator"), F.lit(f).alias("form")) for i, f in FORMS.items()])
    return t.region.select(F.col("r_name").alias("entity"), F.explode(forms).alias("_p")).select("entity", "_p.indicator", "_p.form")


_case = "CASE indicator " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMS.items()) + " END"
_over = "CASE " + " ".join(f"WHEN entity='{e}' AND indicator='{i}' THEN '{f}'" for e, i, f in OVERRIDES) + " END"
define("reg", f"SELECT DISTINCT entity, indicator, {_case} AS form, {_over} AS override FROM plong")
define("ereg", "SELECT entity, indicator, form AS registered, coalesce(override, form) AS effective, override IS NOT NULL AS override_applied, "
       "CASE WHEN coalesce(override, form) = 'level_with_linear_trend' THEN 'level' ELSE regexp_replace(coalesce(override, form), "
       "'(_with_regime_dummy|_with_caveat)$', '') END AS base FROM reg")


def effective(t):
    return readers.effective_registry(registry(t), OVERRIDES)


query("a11_effective_registry", "SELECT * FROM ereg")(effective)


@query("a12_override_lookup", "SELECT o_custkey AS k, coalesce(b.v, a.v) AS v FROM (SELECT o_custkey, max(o_orderkey) AS v FROM orders "
       "GROUP BY 1) a FULL JOIN (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)")
def a12(t):
    base = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    new = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    return readers.override_lookup(base, new, ["k"])


@query("a13_source_precedence", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, "
       "CAST(strpos('PFO', o_orderstatus) AS BIGINT) AS rank FROM orders) QUALIFY row_number() OVER "
       "(PARTITION BY o_custkey ORDER BY rank, o_orderkey) = 1")
def a13(t):
    position = F.instr(F.lit("PFO"), F.col("o_orderstatus")).cast("bigint")
    c = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.struct(position.alias("position"), "o_orderkey").alias("rank"))
    return readers.source_precedence(c, ["o_custkey"], "rank").withColumn("rank", F.col("rank.position"))


@query("a14_write_panel", "SELECT entity, CAST(count(*) AS BIGINT) AS n, " + r("sum(REVENUE)") + " AS total, min(ts) AS first_ts, "
       "max(ts) AS last_ts FROM npanel GROUP BY 1")
def a14(t):
    path = shared_folder(t.spark)
    sinks.write_panel(nation_panel(t), path)
    return readers.read_panel(t.spark, path).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a15_append_audit_log", "SELECT entity, d AS logged_at, CAST(count(*) AS BIGINT) AS n_rows FROM panel CROSS JOIN "
       "(VALUES (DATE '2001-12-01'), (DATE '2002-01-01')) x(d) GROUP BY 1, 2")
def a15(t):
    path = shared_folder(t.spark)
    log = region_panel(t).groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"))
    sinks.append_audit_log(log, path, dt.date(2001, 12, 1))
    sinks.append_audit_log(log, path, dt.date(2002, 1, 1))
    return t.spark.read.parquet(path)


@query("a16_upsert_by_key", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders "
       "WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, NULL, " + r("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)") +
       " FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def a16(t):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("c_acctbal"))
    return sinks.upsert_by_key(base, new, ["c_custkey"])

