"""Registered queries: feature matrices and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import features
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define, r
from panelspark.plans.panels import BREAKS, INDICATORS, PERIODS, TARGET, TEST_START, TRAIN_END, region_panel
from panelspark.plans.queries_transforms import SQL as TSQL
from panelspark.plans.queries_transforms import dense_long, registry_forms, transformed

#: Regime specification used with the stand-in panel: (entity, break, driver or 'const' or None).
SPEC = [("AFRICA", "B1", "ORDERS"), ("AFRICA", "B2", "URGENT"), ("AFRICA", "B3", "URGENT"), ("AMERICA", "B1", None),
        ("AMERICA", "B2", "const"), ("AMERICA", "B3", "const"), ("ASIA", "B1", None), ("ASIA", "B2", "const"),
        ("ASIA", "B3", "ORDERS"), ("EUROPE", "B1", None), ("EUROPE", "B2", "ORDERS"), ("EUROPE", "B3", "ORDERS"),
        ("MIDDLE EAST", "B1", None), ("MIDDLE EAST", "B2", "const"), ("MIDDLE EAST", "B3", "BALANCE")]
PAIRS = features.interaction_pairs(SPEC)
NAMES = features.feature_names(INDICATORS, BREAKS, PERIODS, PAIRS)
EXOG = features.regime_names(BREAKS, PERIODS, PAIRS)
W = "WINDOW w AS (PARTITION BY entity ORDER BY ts)"


def spec(t):
    return t.spark.createDataFrame(SPEC, "entity string, break_name string, driver string")


def base(t):
    """Densified transformed panel."""
    return transformed(t)


def matrix(t):
    return features.feature_matrix(base(t), INDICATORS, BREAKS, PERIODS, spec(t), PAIRS)


def _feature_sql(name: str) -> str:
    """SQL of one feature over ``tpanel``."""
    import re
    if m := re.match(r"^(.*)_lag(\d+)$", name):
        return f"lag({m[1]}, {m[2]}) OVER w"
    if m := re.match(r"^(.*)_roll(\d+)_(mean|std)$", name):
        fn = {"mean": "avg", "std": "stddev_samp"}[m[3]]
        f = f"(PARTITION BY entity ORDER BY ts ROWS {int(m[2]) - 1} PRECEDING)"
        return f"CASE WHEN count({m[1]}) OVER {f} = {m[2]} THEN {fn}({m[1]}) OVER {f} END"
    if m := re.match(r"^D_(.*)$", name):
        return f"CASE WHEN ts >= DATE '{dict(BREAKS)[m[1]]}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    if m := re.match(r"^P_(.*)$", name):
        a, b = next((a, b) for n, a, b in PERIODS if n == m[1])
        return f"CASE WHEN ts BETWEEN DATE '{a}' AND DATE '{b}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    if m := re.match(r"^(.*)_x_D_(.*)$", name):
        who = ", ".join(f"'{e}'" for e, b, d in SPEC if (d, b) == (m[1], m[2]))
        return (f"CASE WHEN entity IN ({who}) THEN {m[1]} * (CASE WHEN ts >= DATE '{dict(BREAKS)[m[2]]}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) "
                "ELSE 0.0::DOUBLE END")
    return name


define("fmat", "SELECT entity, ts, " + ", ".join(f"{_feature_sql(n)} AS {n}" for n in NAMES) + f" FROM tpanel {W}")
define("flong", "SELECT entity, feature, ts, value FROM fmat UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(NAMES) + "))")
ALLOK = " AND ".join(f"{n} IS NOT NULL" for n in NAMES)


def pick(names, table="fmat", where=""):
    return "SELECT entity, ts, " + ", ".join(f"{r(n)} AS {n}" for n in names) + f" FROM {table} {where}"


LAGN = [n for n in NAMES if "_lag" in n]
ROLLN = [n for n in NAMES if "_roll" in n]
query("d01_lag_matrix", pick(LAGN))(lambda t: features.lag_matrix(base(t), INDICATORS))
query("d02_rolling_matrix", pick(ROLLN))(lambda t: features.rolling_matrix(base(t), INDICATORS))
query("d03_split_dummies", pick([f"D_{b}" for b, _ in BREAKS]))(
    lambda t: base(t).select("entity", "ts", *[c.alias(n) for n, c in features.split_columns(BREAKS).items()]))
query("d04_period_dummies", pick([f"P_{p[0]}" for p in PERIODS]))(
    lambda t: base(t).select("entity", "ts", *[c.alias(n) for n, c in features.period_columns(PERIODS).items()]))
query("d05_interactions", pick([f"{d}_x_D_{b}" for d, b in PAIRS]))(
    lambda t: features.attach_drivers(base(t), spec(t), BREAKS).select(
        "entity", "ts", *[c.alias(n) for n, c in features.interaction_columns(PAIRS, BREAKS).items()]))
query("d06_regime_matrix", pick(EXOG))(lambda t: features.regime_matrix(base(t), BREAKS, PERIODS, spec(t), PAIRS))
query("d07_feature_matrix", pick(NAMES))(matrix)

CAT = ("CASE WHEN feature LIKE '%\\_x\\_%' ESCAPE '\\' THEN 'interaction' WHEN feature LIKE 'D\\_%' ESCAPE '\\' THEN 'split' WHEN feature LIKE 'P\\_%' ESCAPE '\\' "
       "THEN 'period' WHEN regexp_matches(feature, '_lag[0-9]+$') THEN 'lag' WHEN regexp_matches(feature, '_roll[0-9]+_') THEN 'rolling' ELSE 'base' END")
define("fprof", f"SELECT entity, feature, count(value) AS n_known, bool_or(coalesce(value <> 0, false)) AS present, {CAT} AS category FROM flong GROUP BY 1, 2")
query("d08_classify_feature", "SELECT entity, feature, CAST(n_known AS BIGINT) AS n_known, present, category, category AS category_by_substring FROM fprof")(
    lambda t: features.feature_profile(matrix(t), NAMES).withColumn("category_by_substring", features.classify_feature_by_substring(F.col("feature"))))
query("d09_category_counts", "SELECT entity, " + ", ".join(f"CAST(count(CASE WHEN category = '{c}' AND present THEN 1 END) AS BIGINT) AS \"{c}\"" for c in features.CATEGORIES) +
      " FROM fprof GROUP BY 1")(lambda t: features.category_counts(features.feature_profile(matrix(t), NAMES)))
query("d10_joint_valid_summary", f"SELECT entity, CAST(count(*) AS BIGINT) AS n_rows, CAST({len(NAMES)} AS BIGINT) AS n_columns, min(CASE WHEN {ALLOK} THEN ts END) AS first_joint, "
      f"max(CASE WHEN {ALLOK} THEN ts END) AS last_joint, CAST(count(CASE WHEN {ALLOK} THEN 1 END) AS BIGINT) AS n_joint, CAST(sum(" +
      " + ".join(f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in NAMES) + ") AS BIGINT) AS n_nulls FROM fmat GROUP BY 1")(
    lambda t: features.joint_valid_summary(matrix(t), NAMES))

#: Name of the second form: the target of every entity as yearly growth, whatever the registry says.
ALT = "yoy_pct"
define("alt", f"SELECT entity, ts, {TSQL[ALT].replace('value', 'REVENUE')} AS REVENUE FROM panel {W}")
define("altpanel", "SELECT t.entity, t.ts, a.REVENUE, " + ", ".join(f"t.{c}" for c in INDICATORS if c != TARGET) + " FROM tpanel t JOIN alt a ON a.entity = t.entity AND a.ts = t.ts")
define("altmat", "SELECT entity, ts, " + ", ".join(f"{_feature_sql(n)} AS {n}" for n in NAMES) + f" FROM altpanel {W}")


def both_forms(t):
    """(variant, entity, ts, features): the registered forms and those with the target forced to ``ALT``, in one pass."""
    own = registry_forms(t)
    forced = F.when(F.col("indicator") == TARGET, F.lit(ALT)).otherwise(F.col("form"))
    variants = F.array(F.struct(F.lit("primary").alias("variant"), F.col("form")), F.struct(F.lit(ALT).alias("variant"), forced.alias("form")))
    registry = own.select("entity", "indicator", F.explode(variants).alias("_p")).select("entity", "indicator", "_p.variant", "_p.form")
    return features.form_matrices(dense_long(t), registry, INDICATORS, BREAKS, PERIODS, spec(t), PAIRS)


_named = ", ".join(f"{r(n)} AS {n}" for n in NAMES)
query("d11_alternate_form_matrix", f"SELECT 'primary' AS variant, entity, ts, {_named} FROM fmat UNION ALL SELECT '{ALT}', entity, ts, {_named} FROM altmat")(both_forms)

BLOCK = [*INDICATORS, *EXOG]
query("d13_endog_exog_blocks", pick(BLOCK, where="WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in BLOCK)))(
    lambda t: features.endog_exog(features.regime_matrix(base(t), BREAKS, PERIODS, spec(t), PAIRS, keep=("entity", "ts", *INDICATORS)), INDICATORS, EXOG))
query("d14_head_tail_preview", "SELECT entity, position, CAST(rank AS BIGINT) AS rank, ts, column_name, value FROM (SELECT *, 'head' AS position, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rank "
      "FROM panel QUALIFY rank <= 3 UNION ALL SELECT *, 'tail', row_number() OVER (PARTITION BY entity ORDER BY ts DESC) AS rank FROM panel QUALIFY rank <= 3) "
      "UNPIVOT INCLUDE NULLS (value FOR column_name IN (REVENUE, ORDERS, URGENT, BALANCE, AVGVAL))")(lambda t: features.head_tail(region_panel(t), INDICATORS))

define("ffirst", "SELECT entity, feature, min(CASE WHEN value IS NOT NULL THEN ts END) AS f FROM flong GROUP BY 1, 2")
define("flate", "SELECT l.entity, l.feature, count(CASE WHEN value IS NULL AND ts > f THEN 1 END) AS late FROM flong l JOIN ffirst q ON q.entity = l.entity AND q.feature = l.feature GROUP BY 1, 2")
query("d15_lag_self_check", "SELECT a.entity, a.feature AS column_name, b.feature AS source, CAST(regexp_extract(a.feature, '([0-9]+)$', 1) AS BIGINT) AS k, b.f AS source_first, "
      "CAST(b.f + to_months(CAST(regexp_extract(a.feature, '([0-9]+)$', 1) AS INTEGER)) AS DATE) AS expected_first, a.f AS first_valid, "
      "a.f = CAST(b.f + to_months(CAST(regexp_extract(a.feature, '([0-9]+)$', 1) AS INTEGER)) AS DATE) AS matches, late = 0 AS leading_only FROM ffirst a "
      "JOIN ffirst b ON a.entity = b.entity AND b.feature = regexp_extract(a.feature, '^(.*)_lag[0-9]+$', 1) JOIN flate z ON z.entity = a.entity AND z.feature = a.feature "
      "WHERE a.feature LIKE '%lag%'")(lambda t: features.lag_self_check(matrix(t), INDICATORS))
query("d16_rolling_self_check", "SELECT a.entity, a.feature AS column_name, CAST(b.f + to_months(CAST(regexp_extract(a.feature, '_roll([0-9]+)_', 1) AS INTEGER) - 1) AS DATE) AS expected_first, "
      f"a.f AS first_valid, {r('l.value')} AS value, {r('x.direct')} AS direct, a.f = CAST(b.f + to_months(CAST(regexp_extract(a.feature, '_roll([0-9]+)_', 1) AS INTEGER) - 1) AS DATE) AND abs(l.value - x.direct) <= 1e-10 AS matches "
      "FROM ffirst a JOIN flong l ON l.entity = a.entity AND l.feature = a.feature AND l.ts = a.f JOIN (SELECT q.entity AS e0, q.feature AS f0, CASE WHEN q.feature LIKE '%mean' THEN avg(s.value) ELSE stddev_samp(s.value) END AS direct "
      "FROM ffirst q JOIN ffirst z ON z.entity = q.entity AND z.feature = regexp_extract(q.feature, '^(.*)_roll', 1) JOIN flong s ON s.entity = q.entity AND s.feature = z.feature AND s.ts >= z.f AND "
      "s.ts < z.f + to_months(CAST(regexp_extract(q.feature, '_roll([0-9]+)_', 1) AS INTEGER)) WHERE q.feature LIKE '%roll%' GROUP BY 1, 2) x ON x.e0 = a.entity AND x.f0 = a.feature "
      "JOIN ffirst b ON a.entity = b.entity AND b.feature = regexp_extract(a.feature, '^(.*)_roll', 1) WHERE a.feature LIKE '%roll%'")(
    lambda t: features.rolling_self_check(matrix(t), INDICATORS))

_d17 = []
for _n, _d in BREAKS:
    _d17.append(f"SELECT entity, 'D_{_n}' AS dummy, max(CASE WHEN ts = DATE '{_d}' THEN D_{_n} END) AS at_start, max(CASE WHEN ts = DATE '{_d}' - INTERVAL 1 MONTH THEN D_{_n} END) AS before, "
                f"arg_max(D_{_n}, ts) AS at_end, CAST(NULL AS DOUBLE) AS after, CAST(count(CASE WHEN ts >= DATE '{_d}' THEN 1 END) AS BIGINT) AS expected_ones, CAST(sum(D_{_n}) AS BIGINT) AS found_ones FROM fmat GROUP BY 1")
for _n, _a, _b in PERIODS:
    _d17.append(f"SELECT entity, 'P_{_n}', max(CASE WHEN ts = DATE '{_a}' THEN P_{_n} END), max(CASE WHEN ts = DATE '{_a}' - INTERVAL 1 MONTH THEN P_{_n} END), max(CASE WHEN ts = DATE '{_b}' THEN P_{_n} END), "
                f"max(CASE WHEN ts = DATE '{_b}' + INTERVAL 1 MONTH THEN P_{_n} END), CAST(count(CASE WHEN ts BETWEEN DATE '{_a}' AND DATE '{_b}' THEN 1 END) AS BIGINT), CAST(sum(P_{_n}) AS BIGINT) FROM fmat GROUP BY 1")
query("d17_dummy_self_check", "SELECT *, at_start = 1 AND at_end = 1 AND coalesce(before, 0) = 0 AND coalesce(after, 0) = 0 AND expected_ones = found_ones AS matches FROM (" + " UNION ALL ".join(_d17) + ")")(
    lambda t: features.dummy_self_check(matrix(t), BREAKS, PERIODS))
query("d17_interaction_self_check", "SELECT entity, " + ", ".join(
    f"CAST(count(CASE WHEN {d}_x_D_{b} IS DISTINCT FROM (CASE WHEN entity IN (" + (", ".join(f"'{e}'" for e, b0, d0 in SPEC if (d0, b0) == (d, b)) or "''")
    + f") THEN D_{b} * {d} ELSE 0.0::DOUBLE END) THEN 1 END) AS BIGINT) AS {d}_x_D_{b}" for d, b in PAIRS) + " FROM fmat GROUP BY 1")(
    lambda t: features.interaction_self_check(matrix(t), spec(t), BREAKS, PAIRS))

_parts = []
for _p, _c in (("train", f"ts <= DATE '{TRAIN_END}'"), ("test", f"ts >= DATE '{TEST_START}'")):
    _y = f"CASE WHEN {_c} THEN REVENUE END"
    _parts.append(f"CAST(count({_y}) AS BIGINT) AS {_p}_n, {r(f'avg({_y})')} AS {_p}_mean, {r(f'stddev_samp({_y})')} AS {_p}_std, {r(f'min({_y})')} AS {_p}_min, {r(f'max({_y})')} AS {_p}_max")
query("d18_split_summary", f"SELECT entity, CAST(count(*) AS BIGINT) AS n_joint, min(ts) AS first_joint, max(ts) AS last_joint, {', '.join(_parts)} FROM fmat WHERE {ALLOK} GROUP BY 1")(
    lambda t: features.split_summary(matrix(t), NAMES, TARGET, TRAIN_END, TEST_START))
query("d19_train_test_split", pick(NAMES, where=f"WHERE {ALLOK} AND ts <= DATE '{TRAIN_END}'"))(lambda t: features.train_rows(matrix(t), NAMES, TRAIN_END))
