"""Registered queries: calendar, gaps, units, audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import audit, clean
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r
from panelspark.functions.reshape import to_long
from panelspark.plans.panels import ENTITIES, INDICATORS, TARGET, TODAY, event_panel, nation_panel, region_panel

COLS = ", ".join(INDICATORS)
HOUR = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"


def hours(t):
    """Dense hourly panel; hours without events are null."""
    return clean.densify(event_panel(t).select("entity", "ts", "EVENTS"), unit="hour")


query("b01_to_month_start", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")(
    lambda t: t.orders.select("o_orderkey", clean.month_start("o_orderdate").alias("month")))

query("b02_densify_calendar", f"SELECT entity, {HOUR}, EVENTS, {r('AVGVALUE')} AS AVGVALUE FROM egrid")(
    lambda t: clean.densify(event_panel(t), unit="hour"))

define("eruns", "SELECT entity, min(ts) AS s, max(ts) AS e, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) "
       "- row_number() OVER (PARTITION BY entity, EVENTS IS NULL ORDER BY ts) AS g FROM egrid) WHERE EVENTS IS NULL GROUP BY entity, g")
query("b03_null_runs", "SELECT entity, strftime(s, '%Y-%m-%d %H:%M') AS run_start, strftime(e, '%Y-%m-%d %H:%M') AS run_end, "
      "CAST(n AS BIGINT) AS length, CASE WHEN s = a THEN 'leading' WHEN e = b THEN 'trailing' ELSE 'internal' END AS kind FROM eruns JOIN "
      "(SELECT entity AS e0, min(ts) AS a, max(ts) AS b FROM egrid GROUP BY 1) ON e0 = entity")(
    lambda t: clean.null_runs(hours(t), "EVENTS", unit="hour"))

define("eneigh", """SELECT entity, ts, EVENTS AS v,
 last_value(EVENTS IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN EVENTS IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0,
 first_value(EVENTS IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN EVENTS IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS t1
 FROM egrid WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 f AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
define("epos", "SELECT *, date_diff('hour', t0, ts) AS pos, date_diff('hour', t0, t1) AS gap, "
       "v0 + (v1 - v0) * date_diff('hour', t0, ts) / date_diff('hour', t0, t1) AS line FROM eneigh")
query("b04_fill_short_gaps", f"SELECT entity, {HOUR}, {r('CASE WHEN v IS NULL AND gap - 1 <= 2 THEN line ELSE v END')} AS EVENTS FROM epos")(
    lambda t: clean.fill_short_gaps(hours(t), "EVENTS", 2, unit="hour"))
query("b04_fill_short_gaps_quirk", f"SELECT entity, {HOUR}, {r('CASE WHEN v IS NULL AND pos <= 2 AND (SELECT max(CASE WHEN v IS NULL AND gap - 1 <= 2 THEN 1 ELSE 0 END) FROM epos q WHERE q.entity = epos.entity) = 1 THEN line ELSE v END')} AS EVENTS FROM epos")(
    lambda t: clean.fill_short_gaps(hours(t), "EVENTS", 2, unit="hour", strict=False))

define("qm", """SELECT p.entity, p.ts, CASE WHEN month(p.ts) % 3 = 1 THEN p.REVENUE END AS q, a.REVENUE AS v0, a.ts AS t0, b.REVENUE AS v1
 FROM panel p LEFT JOIN panel a ON a.entity = p.entity AND a.ts = CAST(date_trunc('quarter', p.ts) AS DATE)
 LEFT JOIN panel b ON b.entity = p.entity AND b.ts = CAST(date_trunc('quarter', p.ts) + INTERVAL 3 MONTH AS DATE)
 WHERE p.ts <= (SELECT max(ts) FROM panel WHERE month(ts) % 3 = 1)""")
define("qfill", "SELECT entity, ts, CASE WHEN q IS NOT NULL THEN q ELSE v0 + (v1 - v0) * date_diff('month', t0, ts) / 3 END AS v FROM qm")
query("b05_low_to_high_freq", f"SELECT entity, ts, {r('v')} AS REVENUE, {r('100.0 * (v / lag(v, 12) OVER (PARTITION BY entity ORDER BY ts) - 1)')} AS REVENUE_yoy FROM qfill")(
    lambda t: clean.quarterly_to_monthly_yoy(region_panel(t).select("entity", "ts", TARGET).filter(F.month("ts") % 3 == 1), TARGET))

query("b06_forward_fill", f"SELECT entity, {HOUR}, v0 AS EVENTS FROM eneigh")(
    lambda t: clean.forward_fill(hours(t), "EVENTS", unit="hour"))

YOY = "100.0 * (REVENUE / lag(REVENUE, 12) OVER (PARTITION BY entity ORDER BY ts) - 1)"
query("b07_level_to_yoy", f"SELECT entity, ts, {r(YOY)} AS yoy FROM panel")(
    lambda t: clean.level_to_yoy(region_panel(t), TARGET, "yoy").select("entity", "ts", "yoy"))

define("pmom", "SELECT entity, ts, REVENUE, 100.0 * (REVENUE / lag(REVENUE) OVER (PARTITION BY entity ORDER BY ts) - 1) AS mom FROM panel")


def monthly_growth(t):
    from panelspark.functions.series import sliding
    return sliding(region_panel(t).select("entity", "ts", TARGET), ["entity"], lambda w: {
        "mom": 100.0 * (F.col(TARGET) / F.lag(TARGET, 1).over(w) - 1.0)}, back=1)


query("b08_growth_to_yoy", f"SELECT entity, ts, CASE WHEN count(mom) OVER w = 12 THEN {r('100.0 * (exp(sum(ln(1 + mom / 100)) OVER w) - 1)')} END AS yoy "
      "FROM pmom WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 11 PRECEDING)")(
    lambda t: clean.growth_to_yoy(monthly_growth(t), "mom", "yoy").select("entity", "ts", "yoy"))

UNITS = {e: ("mom_pct" if e in ("ASIA", "AFRICA") else "level") for e in ENTITIES}


@query("b09_harmonise_units", f"SELECT entity, ts, {r('CASE WHEN ts >= DATE ' + chr(39) + '1996-01-01' + chr(39) + ' THEN ' + YOY + ' END')} AS yoy FROM panel")
def b09(t):
    raw = monthly_growth(t).select("entity", "ts", F.when(F.col("entity").isin("ASIA", "AFRICA"), F.col("mom"))
                                   .otherwise(F.col(TARGET)).alias("value"))
    return clean.harmonise_units(raw, UNITS).select("entity", "ts", "yoy")


query("b10_assemble_wide", f"SELECT entity, ts, {COLS} FROM panel")(
    lambda t: clean.assemble_wide(to_long(region_panel(t), INDICATORS), INDICATORS))


def late_gap(t):
    """Nation panel on a dense calendar; BALANCE is withheld from 2001-04 on except for two nations."""
    p = clean.densify(nation_panel(t))
    keep = (F.col("ts") < F.lit(dt.date(2001, 4, 1))) | F.col("entity").isin("NATION_1", "NATION_2")
    return p.withColumn("BALANCE", F.when(keep, F.col("BALANCE")))


define("ngrid", f"SELECT e AS entity, CAST(g AS DATE) AS ts, {COLS} FROM (SELECT entity AS e, unnest(generate_series(min(ts), max(ts), "
       "INTERVAL 1 MONTH)) AS g FROM npanel GROUP BY 1) LEFT JOIN npanel ON e = entity AND CAST(g AS DATE) = ts")
define("nlate", "SELECT * REPLACE (CASE WHEN ts < DATE '2001-04-01' OR entity IN ('NATION_1','NATION_2') THEN BALANCE END AS BALANCE) FROM ngrid")
query("b11_trim_effective_window", f"SELECT entity, ts, {COLS} FROM nlate n WHERE ts >= DATE '1996-01-01' AND (entity = 'NATION_3' OR ts <= "
      "(SELECT max(ts) FROM nlate m WHERE m.entity = n.entity AND ORDERS IS NOT NULL AND BALANCE IS NOT NULL))")(
    lambda t: clean.trim_effective_window(late_gap(t), INDICATORS, dt.date(1996, 1, 1), ["NATION_3"]))

_gap_fill = ", ".join(
    f"CASE WHEN {c} IS NULL AND prev_{c} IS NOT NULL AND next_{c} IS NOT NULL THEN prev_{c} + (next_{c} - prev_{c}) * "
    f"date_diff('month', pt, ts) / date_diff('month', pt, nt) ELSE {c} END AS {c}" for c in INDICATORS)
_around = ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS prev_{c}, first_value({c} IGNORE NULLS) OVER f AS next_{c}" for c in INDICATORS)
define("nfill", f"SELECT entity, ts, {_gap_fill} FROM (SELECT *, {_around}, last_value(CASE WHEN ORDERS IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS pt, "
       "first_value(CASE WHEN ORDERS IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt FROM ngrid WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS "
       "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
_yoyed = ", ".join(r(f"100.0 * ({c} / lag({c}, 12) OVER (PARTITION BY entity ORDER BY ts) - 1)" if c in ("REVENUE", "ORDERS") else c) + f" AS {c}" for c in INDICATORS)
query("b12_build_panel", f"SELECT * FROM (SELECT entity, ts, {_yoyed} FROM nfill) WHERE ts >= DATE '1996-01-01'")(
    lambda t: clean.build_panel(to_long(nation_panel(t), INDICATORS), INDICATORS, dt.date(1996, 1, 1),
                                {"REVENUE": "level", "ORDERS": "level"}, max_gap=24))

define("nlong", "SELECT entity, indicator, ts, value FROM nlate UNPIVOT INCLUDE NULLS (value FOR indicator IN (REVENUE, ORDERS, URGENT, BALANCE, AVGVAL))")
define("nruns", """SELECT entity, indicator, max(CASE WHEN a > first_ts AND b < last_ts THEN n END) AS gap,
 sum(CASE WHEN b = last_ts AND a > first_ts THEN n END) AS tail FROM (
 SELECT entity, indicator, min(ts) AS a, max(ts) AS b, count(*) AS n, min(ft) AS first_ts, max(lt) AS last_ts FROM (
  SELECT *, min(ts) OVER (PARTITION BY entity, indicator) AS ft, max(ts) OVER (PARTITION BY entity, indicator) AS lt,
   row_number() OVER (PARTITION BY entity, indicator ORDER BY ts) - row_number() OVER (PARTITION BY entity, indicator, value IS NULL ORDER BY ts) AS g
  FROM nlong) WHERE value IS NULL GROUP BY entity, indicator, g) GROUP BY 1, 2""")
define("naudit", """SELECT *, CASE WHEN months_outdated IS NULL THEN 'MISSING' WHEN months_outdated < 6 THEN 'FRESH' WHEN months_outdated < 24 THEN 'WARNING'
 ELSE 'CRITICAL' END AS freshness FROM (SELECT l.entity, l.indicator, min(CASE WHEN value IS NOT NULL THEN ts END) AS effective_start,
 max(CASE WHEN value IS NOT NULL THEN ts END) AS effective_end, CAST(date_diff('month', max(CASE WHEN value IS NOT NULL THEN ts END), DATE '2001-12-01') AS BIGINT) AS months_outdated,
 CAST(count(*) AS BIGINT) AS n_obs, CAST(coalesce(any_value(gap), 0) AS BIGINT) AS max_internal_gap, CAST(coalesce(any_value(tail), 0) AS BIGINT) AS trailing_nulls
 FROM nlong l LEFT JOIN nruns r ON r.entity = l.entity AND r.indicator = l.indicator GROUP BY 1, 2)""")


def late_audit(t):
    return audit.freshness_audit(to_long(late_gap(t), INDICATORS), TODAY)


query("b13_freshness_audit", "SELECT entity, indicator, effective_start, effective_end, months_outdated, freshness, n_obs, max_internal_gap, trailing_nulls FROM naudit")(late_audit)
query("b14_coverage_pivot", "SELECT entity, " + ", ".join(f"max(CASE WHEN indicator = '{c}' THEN freshness END) AS {c}" for c in INDICATORS) + " FROM naudit GROUP BY 1")(
    lambda t: audit.coverage_pivot(late_audit(t), INDICATORS))

query("b15_status_distribution", "SELECT CAST(position AS BIGINT) AS position, s AS freshness, CAST(count(b.entity) AS BIGINT) AS n_before, CAST((SELECT count(*) FROM naudit a "
      "WHERE a.freshness = s) AS BIGINT) AS n_after FROM (VALUES (0,'FRESH'),(1,'WARNING'),(2,'CRITICAL'),(3,'MISSING')) x(position, s) LEFT JOIN "
      "(SELECT entity, indicator, CASE WHEN date_diff('month', max(ts), DATE '2001-12-01') < 6 THEN 'FRESH' WHEN date_diff('month', max(ts), DATE '2001-12-01') < 24 THEN 'WARNING' ELSE 'CRITICAL' END AS freshness FROM plong GROUP BY 1, 2) b ON b.freshness = s GROUP BY 1, 2")(
    lambda t: audit.status_distribution(audit.freshness_audit(to_long(region_panel(t), INDICATORS), TODAY), late_audit(t)))

NEEDS = [("Q1", "NATION_1", "BALANCE", dt.date(2001, 6, 1)), ("Q1", "NATION_2", "REVENUE", dt.date(2001, 6, 1)),
         ("Q2", "NATION_4", "BALANCE", dt.date(2001, 6, 1)), ("Q2", "NATION_4", "ORDERS", dt.date(2001, 6, 1)),
         ("Q3", "NOWHERE", "ORDERS", dt.date(1999, 1, 1))]
_needs = ", ".join(f"('{q}','{e}','{i}',DATE '{d}')" for q, e, i, d in NEEDS)
query("b16_readiness_gate", f"SELECT question, CAST(count(*) AS BIGINT) AS n_required, bool_and(coalesce(effective_end >= d, false)) AS ready FROM (VALUES {_needs}) "
      "n(question, e, i, d) LEFT JOIN naudit ON entity = e AND indicator = i GROUP BY 1")(lambda t: audit.readiness_gate(late_audit(t), NEEDS))

SIG = f"""SELECT entity, indicator, max(value) AS max_value, min(value) AS min_value, {r('avg(value)', 8)} AS mean_value, {r('stddev_samp(value)', 8)} AS sd_value,
 min(CASE WHEN value = mx THEN ts END) AS peak_date, min(CASE WHEN value = mn THEN ts END) AS trough_date FROM (SELECT *, max(value) OVER p AS mx, min(value) OVER p AS mn
 FROM plong WINDOW p AS (PARTITION BY entity, indicator)) GROUP BY 1, 2"""
define("usig", SIG)
EXPECTED = [(e, TARGET, dt.date(1998, 6, 1)) for e in ENTITIES]


@query("b17_unit_signature", "SELECT *, CAST(CASE WHEN indicator = 'REVENUE' THEN abs(date_diff('month', peak_date, DATE '1998-06-01')) END AS BIGINT) AS months_off, "
       "CASE WHEN indicator = 'REVENUE' THEN abs(date_diff('month', peak_date, DATE '1998-06-01')) <= 12 END AS matches FROM usig", digits=8)
def b17(t):
    sig = audit.unit_signature(to_long(region_panel(t), INDICATORS))
    hit = audit.match_expected_peak(sig, EXPECTED, 12).select("entity", "indicator", "months_off", "matches")
    return sig.join(hit, ["entity", "indicator"], "left")


query("b18_panel_log", "SELECT entity, CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_columns, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(" +
      " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in INDICATORS) + ") AS BIGINT) AS n_nulls FROM nlate GROUP BY 1")(
    lambda t: audit.panel_log(late_gap(t), INDICATORS))
query("b19_quality_gate", "SELECT entity, true AS schema_ok, bool_and(BALANCE IS NOT NULL AND ORDERS IS NOT NULL) AS no_nulls, "
      "bool_and(step IS NULL OR step = 1) AS monthly, bool_and(step IS NULL OR step > 0) AS unique_dates FROM (SELECT *, date_diff('month', lag(ts) OVER "
      "(PARTITION BY entity ORDER BY ts), ts) AS step FROM npanel) GROUP BY 1")(lambda t: audit.quality_gate(nation_panel(t), INDICATORS))
query("b20_profile_columns", f"SELECT entity, indicator AS column_name, CAST(count(value) AS BIGINT) AS n_known, min(value) AS min_value, max(value) AS max_value, "
      f"{r('avg(value)')} AS mean_value, {r('stddev_samp(value)')} AS sd_value, 'double' AS dtype FROM nlong GROUP BY 1, 2")(
    lambda t: audit.profile_columns(late_gap(t), INDICATORS))


def lagged_long(t):
    from panelspark.functions.series import sliding
    wide = sliding(late_gap(t), ["entity"], lambda w: {f"{c}_lag3": F.lag(c, 3).over(w) for c in INDICATORS}, back=3)
    return to_long(wide.drop(*INDICATORS))


define("nlag", "SELECT entity, indicator || '_lag3' AS indicator, ts, lag(value, 3) OVER (PARTITION BY entity, indicator ORDER BY ts) AS value FROM nlong")
query("b21_nulls_leading_only", "SELECT entity, indicator, any_value(f) AS first_valid, max(CASE WHEN value IS NOT NULL THEN ts END) AS last_valid, CAST(count(value) AS BIGINT) AS n_valid, "
      "CAST(count(CASE WHEN value IS NULL AND ts > f THEN 1 END) AS BIGINT) AS n_late_nulls, count(CASE WHEN value IS NULL AND ts > f THEN 1 END) = 0 AS leading_only "
      "FROM (SELECT *, min(CASE WHEN value IS NOT NULL THEN ts END) OVER (PARTITION BY entity, indicator) AS f FROM nlag) GROUP BY 1, 2")(
    lambda t: audit.nulls_leading_only(lagged_long(t)))


@query("b22_compare_frames", "SELECT indicator AS column_name, CAST(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched, CAST(sum(CASE WHEN r IS NOT NULL AND "
       "(a IS NULL) <> (b IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS n_null_mismatch, CAST(sum(CASE WHEN abs(a - b) > 1e-10 THEN 1 ELSE 0 END) AS BIGINT) AS n_value_mismatch, "
       f"{r('coalesce(max(abs(a - b)), 0)')} AS max_abs_diff, sum(CASE WHEN r IS NULL OR (a IS NULL) <> (b IS NULL) OR abs(a - b) > 1e-10 THEN 1 ELSE 0 END) = 0 AS equal FROM (SELECT x.indicator, "
       "x.value AS a, y.value AS b, y.entity AS r FROM nlong x LEFT JOIN (SELECT entity, indicator, ts, CASE WHEN indicator = 'URGENT' THEN value + 0.5 ELSE value END "
       "AS value FROM (UNPIVOT npanel ON REVENUE, ORDERS, URGENT, BALANCE, AVGVAL INTO NAME indicator VALUE value)) y USING (entity, indicator, ts)) GROUP BY 1")
def b22(t):
    other = nation_panel(t).withColumn("URGENT", F.col("URGENT") + 0.5)
    return audit.compare_frames(late_gap(t), other, INDICATORS)
