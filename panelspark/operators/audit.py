"""Data-quality audits: freshness, coverage, gates, profiles, frame comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.clean import all_known, null_runs
from panelspark.functions.reshape import to_long
from panelspark.schema import literal_rows

FRESH_MONTHS, WARNING_MONTHS = 6, 24
STATUS_ORDER = ("FRESH", "WARNING", "CRITICAL", "MISSING")


def month_distance(later: Column, earlier: Column) -> Column:
    """Whole calendar months, day of month ignored."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("bigint")


def freshness_label(months: Column) -> Column:
    return F.when(months.isNull(), "MISSING").when(months < FRESH_MONTHS, "FRESH") \
        .when(months < WARNING_MONTHS, "WARNING").otherwise("CRITICAL")


def freshness_audit(long: DataFrame, today, keys: Sequence[str] = ("entity", "indicator"), unit: str = "month") -> DataFrame:
    """Per series: known window, months outdated at ``today``, grade, longest internal gap, trailing nulls.

    Expects a dense series; null values mark missing periods.
    """
    known = F.when(F.col("value").isNotNull(), F.col("ts"))
    base = long.groupBy(*keys).agg(F.min(known).alias("effective_start"), F.max(known).alias("effective_end"),
                                   F.count(F.lit(1)).alias("n_obs"))
    gaps = null_runs(long, "value", keys, unit=unit).groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "internal", F.col("length"))).alias("_gap"),
        F.sum(F.when(F.col("kind") == "trailing", F.col("length"))).alias("_tail"))
    late = month_distance(F.lit(today), F.col("effective_end"))
    return base.join(gaps, list(keys), "left").select(
        *keys, "effective_start", "effective_end", late.alias("months_outdated"), freshness_label(late).alias("freshness"),
        "n_obs", F.coalesce("_gap", F.lit(0)).alias("max_internal_gap"), F.coalesce("_tail", F.lit(0)).alias("trailing_nulls"))


def coverage_pivot(audit: DataFrame, indicators: Sequence[str], value: str = "freshness") -> DataFrame:
    return audit.groupBy("entity").pivot("indicator", list(indicators)).agg(F.first(value))


def status_distribution(before: DataFrame, after: DataFrame, status: str = "freshness",
                        order: Sequence[str] = STATUS_ORDER) -> DataFrame:
    """Series per status in two audits; every status of ``order`` appears, absent ones with zero."""
    tag = F.lit
    both = before.select(status, tag(1).alias("_b"), tag(0).alias("_a")).unionByName(
        after.select(status, tag(0).alias("_b"), tag(1).alias("_a")))
    zero = before.sparkSession.range(1).select(F.explode(literal_rows(
        [(s, i) for i, s in enumerate(order)], [status, "position"])).alias("_p")).select("_p.*")
    counts = both.groupBy(status).agg(F.sum("_b").alias("n_before"), F.sum("_a").alias("n_after"))
    return zero.join(counts, status, "left").select(
        "position", status, F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"))


def readiness_gate(audit: DataFrame, requirements: Sequence[Sequence]) -> DataFrame:
    """Per question: do all required (entity, indicator) series reach the required end?

    ``requirements`` holds (question, entity, indicator, min_end); a series without audit row is not ready.
    """
    need = audit.sparkSession.range(1).select(F.explode(literal_rows(
        requirements, ["question", "entity", "indicator", "min_end"])).alias("_p")).select("_p.*")
    joined = need.join(audit.select("entity", "indicator", "effective_end"), ["entity", "indicator"], "left")
    ok = F.coalesce(F.col("effective_end") >= F.col("min_end"), F.lit(False))
    return joined.groupBy("question").agg(F.count(F.lit(1)).alias("n_required"), F.bool_and(ok).alias("ready"))


def unit_signature(long: DataFrame, keys: Sequence[str] = ("entity", "indicator")) -> DataFrame:
    """Location, spread and extremes with their (first) dates, from which the unit of a series is recognised."""
    v = F.col("value")
    first_high = F.struct(v, -F.unix_date("ts"))
    first_low = F.struct(v, F.unix_date("ts"))
    known = long.filter(v.isNotNull())
    return known.groupBy(*keys).agg(
        F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("sd_value"), F.max_by("ts", first_high).alias("peak_date"),
        F.min_by("ts", first_low).alias("trough_date"))


def match_expected_peak(signature: DataFrame, expected: Sequence[Sequence], tolerance_months: int = 0) -> DataFrame:
    """``expected`` holds (entity, indicator, expected_peak)."""
    need = signature.sparkSession.range(1).select(F.explode(literal_rows(
        expected, ["entity", "indicator", "expected_peak"])).alias("_p")).select("_p.*")
    gap = F.abs(month_distance(F.col("peak_date"), F.col("expected_peak")))
    return signature.join(F.broadcast(need), ["entity", "indicator"]).withColumn("months_off", gap).withColumn(
        "matches", F.col("months_off") <= tolerance_months)


def panel_log(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in columns[1:]),
                F.sum(F.col(columns[0]).isNull().cast("bigint")))
    return panel.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).cast("bigint").alias("n_columns"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), nulls.alias("n_nulls"))


def quality_gate(panel: DataFrame, columns: Sequence[str], unit_months: int = 1) -> DataFrame:
    """Per entity: schema complete, no nulls, regular monthly spacing, strictly increasing dates.

    Spacing is judged on counts (rows = distinct months = months spanned), which needs no ordering.
    """
    schema_ok = all(c in panel.columns for c in columns)
    span = month_distance(F.max("ts"), F.min("ts")) / unit_months + 1
    return panel.groupBy("entity").agg(
        F.lit(schema_ok).alias("schema_ok"), F.bool_and(all_known(columns)).alias("no_nulls"),
        ((F.count(F.lit(1)) == span) & (F.count_distinct(F.trunc("ts", "MM")) == span)).alias("monthly"),
        (F.count(F.lit(1)) == F.count_distinct("ts")).alias("unique_dates"))


def profile_columns(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type, known values, min, max, mean, standard deviation of every column, per entity."""
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, dict(panel.dtypes)[c])])
    return to_long(panel, columns).groupBy("entity", F.col("indicator").alias("column_name")).agg(
        F.count("value").alias("n_known"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("sd_value")).withColumn(
        "dtype", F.element_at(kinds, F.col("column_name")))


def nulls_leading_only(long: DataFrame, keys: Sequence[str] = ("entity", "indicator")) -> DataFrame:
    """First and last known date and whether nulls occur only before the first known row.

    Equivalent to: the known rows are exactly the rows from the first known one on.
    """
    known = F.when(F.col("value").isNotNull(), F.col("ts"))
    firsts = long.groupBy(*keys).agg(F.min(known).alias("first_valid"), F.max(known).alias("last_valid"),
                                     F.count("value").alias("n_valid"), F.max("ts").alias("_end"),
                                     F.count(F.lit(1)).alias("_n"))
    late = long.join(firsts, list(keys)).filter(F.col("ts") > F.col("first_valid")).groupBy(*keys).agg(
        F.count_if(F.col("value").isNull()).alias("n_late_nulls"))
    return firsts.join(late, list(keys), "left").select(
        *keys, "first_valid", "last_valid", "n_valid", F.coalesce("n_late_nulls", F.lit(0)).alias("n_late_nulls"),
        (F.coalesce("n_late_nulls", F.lit(0)) == 0).alias("leading_only"))


def compare_frames(left: DataFrame, right: DataFrame, columns: Sequence[str], tol: float = 1e-10,
                   keys: Sequence[str] = ("entity", "ts")) -> DataFrame:
    """Per column: rows on one side only, null on one side only, values further apart than ``tol``, largest distance."""
    a = to_long(left, columns, keys).withColumn("_in", F.lit(True))
    b = to_long(right, columns, keys).withColumn("_in", F.lit(True))
    on = [*keys, "indicator"]
    both = a.alias("a").join(b.alias("b"), on, "full")
    av, bv = F.col("a.value"), F.col("b.value")
    paired = F.col("a._in") & F.col("b._in")
    return both.groupBy(F.col("indicator").alias("column_name")).agg(
        F.count_if(F.col("a._in").isNull() | F.col("b._in").isNull()).alias("n_unmatched"),
        F.count_if(paired & (av.isNull() != bv.isNull())).alias("n_null_mismatch"),
        F.count_if(F.abs(av - bv) > tol).alias("n_value_mismatch"),
        F.coalesce(F.max(F.abs(av - bv)), F.lit(0.0)).alias("max_abs_diff")).withColumn(
        "equal", (F.col("n_unmatched") + F.col("n_null_mismatch") + F.col("n_value_mismatch")) == 0)
