"""Registered queries: series transforms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.functions.series import sliding
from panelspark.operators import clean, transform
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r
from panelspark.functions.reshape import to_long
from panelspark.plans.panels import INDICATORS, TARGET, region_panel
from panelspark.plans.queries_sources import effective

LONG_W = "WINDOW w AS (PARTITION BY entity, indicator ORDER BY ts)"


def dense_long(t):
    return to_long(clean.densify(region_panel(t)), INDICATORS)


def one(name, back):
    return lambda t: sliding(dense_long(t), transform.PAIR, lambda w: {"out": transform.TRANSFORMS[name][0]("value", w)}, back=back) \
        .filter(F.col("out").isNotNull()).select("entity", "indicator", "ts", "out")


SQL = {
    "first_diff": "value - lag(value) OVER w",
    "second_diff": "value - 2 * lag(value) OVER w + lag(value, 2) OVER w",
    "yoy_pct": "100.0 * (value / nullif(lag(value, 12) OVER w, 0) - 1)",
    "log_diff_pct": "CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN 100.0 * ln(value / lag(value) OVER w) END",
}
for _i, (_n, _b) in enumerate((("first_diff", 1), ("second_diff", 2), ("yoy_pct", 12), ("log_diff_pct", 1)), 1):
    query(f"c0{_i}_{_n}", f"SELECT * FROM (SELECT entity, indicator, ts, {r(SQL[_n])} AS out FROM plong {LONG_W}) WHERE out IS NOT NULL")(one(_n, _b))

query("c05_strip_suffix", "SELECT entity, indicator, effective, base FROM ereg")(
    lambda t: effective(t).select("entity", "indicator", "effective", transform.strip_suffix("effective").alias("base")))

define("trans", "SELECT entity, indicator, base AS form, CASE WHEN base = 'level' AND indicator = 'REVENUE' THEN 'ct' ELSE 'c' END AS spec, ts, "
       "CASE base WHEN 'level' THEN value " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SQL.items()) +
       f" END AS value FROM plong JOIN ereg USING (entity, indicator) {LONG_W}")
define("tpanel", "SELECT entity, ts, " + ", ".join(f"max(CASE WHEN indicator = '{c}' THEN value END) AS {c}" for c in INDICATORS) + " FROM trans GROUP BY 1, 2")


def registry_forms(t):
    return effective(t).select("entity", "indicator", F.col("effective").alias("form"))


def transformed(t):
    return transform.transform_panel(dense_long(t), registry_forms(t), INDICATORS)


query("c06_apply_transform", f"SELECT entity, indicator, form, spec, ts, {r('value')} AS value FROM trans")(
    lambda t: transform.apply_transform(dense_long(t), registry_forms(t), (TARGET,)))
_cols = ", ".join(f"{r(c)} AS {c}" for c in INDICATORS)
query("c07_transform_panel", f"SELECT entity, ts, {_cols} FROM tpanel")(transformed)
query("c08_joint_valid_panel", f"SELECT entity, ts, {_cols} FROM tpanel WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in INDICATORS))(
    lambda t: transform.joint_valid(transformed(t), INDICATORS))
query("c09_rebase_index", f"SELECT entity, indicator, ts, value, {r('100.0 * value / nullif(coalesce(max(CASE WHEN ts = DATE ' + chr(39) + '1996-01-01' + chr(39) + ' THEN value END) OVER p, first_value(value) OVER w), 0)')} AS index_value "
      f"FROM plong {LONG_W}, p AS (PARTITION BY entity, indicator)")(
    lambda t: transform.rebase_index(dense_long(t), dt.date(1996, 1, 1)).select("entity", "indicator", "ts", "value", "index_value"))
