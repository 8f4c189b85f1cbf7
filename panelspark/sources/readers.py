"""Sources: series files, panels, messy text tables, JSON payloads."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.schema import first_present, nan_to_null, require_columns

# Names under which a date column is recognised, texts that stand for a missing value, and encodings in
# the order in which they are tried.
DATE_NAMES = ("date", "DATE", "Date", "observation_date", "ts", "time")
NULL_TOKENS = ("", "nan", "None", "-", "...")
ENCODINGS = ("utf-8-sig", "cp932", "utf-8", "shift_jis", "cp1252")


def read_series(spark: SparkSession, path: str, column: str, date_column: str = "date") -> DataFrame:
    """One CSV of (date, ``column``); a header without the expected columns is an error."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, [date_column, column])
    df = header.select(F.to_date(date_column).alias("ts"), F.col(column).try_cast("double").alias("value"))
    return nan_to_null(df)


def read_all_series(spark: SparkSession, path: str, key_pattern: str = r"([^/_]+)_([^/]+)\.csv$") -> DataFrame:
    """All series files of a folder in one scan; entity and indicator come from the file path."""
    raw = spark.read.schema("ts DATE, value DOUBLE").option("header", True).option("recursiveFileLookup", True).csv(path)
    where = F.col("_metadata.file_path")
    keyed = raw.select(F.url_decode(F.regexp_extract(where, key_pattern, 1)).alias("entity"),
                       F.url_decode(F.regexp_extract(where, key_pattern, 2)).alias("indicator"), "ts", "value")
    return nan_to_null(keyed)


def read_panel(spark: SparkSession, path: str, entities: Sequence[str] | None = None) -> DataFrame:
    """Panel written by ``write_panel``; an entity list becomes a partition filter."""
    df = spark.read.parquet(path)
    return df if entities is None else df.filter(F.col("entity").isin(list(entities)))


def parse_date(c: str | Column) -> Column:
    """First date format that fits: ISO date or timestamp, year-month, compact year-month, or year and month in Japanese."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)

    def year_month(pattern: str) -> Column:
        y = F.regexp_extract(c, pattern, 1).try_cast("int")
        m = F.regexp_extract(c, pattern, 2).try_cast("int")
        return F.when(c.rlike(pattern) & m.between(1, 12), F.make_date(y, m, F.lit(1)))

    return F.coalesce(
        year_month("^(\\d{4})年\\s*(\\d{1,2})月$"), year_month("^(\\d{4})[-/](\\d{1,2})$"),
        year_month("^(\\d{4})(\\d{2})$"),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("date"),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def sniff_date_column(df: DataFrame, value: str, candidates: Sequence[str] = DATE_NAMES) -> DataFrame:
    """Date column by known name, else the first column; rows with unreadable dates are dropped."""
    try:
        name = first_present(df, candidates)
    except ValueError:
        name = df.columns[0]
    rest = [c for c in df.columns if c not in (name, value)]
    return df.select(*rest, parse_date(F.col(name).cast("string")).alias("ts"), F.col(value)).filter(F.col("ts").isNotNull())


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Text of each file in the first encoding that fits; Spark's own readers take Unicode and Latin-1 only."""
    def decode(raw: bytes) -> str | None:
        for encoding in ENCODINGS:
            try:
                return bytes(raw).decode(encoding)
            except UnicodeDecodeError:
                continue
        return None
    return content.map(decode)


def messy_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of the text files under ``path``, whatever their encoding. One row per file before the split."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), F.posexplode(F.split(decode_text("content"), "\r?\n")).alias("line_no", "text"))


def ingest_messy(lines: DataFrame, date_hints: Sequence[str], value_hints: Sequence[str], start=None) -> DataFrame:
    """Tables buried in text: find the header line, then the date and value columns, then the readable rows.

    The header is the first line with a comma and a date hint (else a value hint). Columns are matched by equality
    with a hint first and by containment second, hints in order. Values may carry thousands commas inside quotes.
    """
    low = F.lower("text")

    def has(hints):
        out = F.lit(False)
        for h in hints:
            out = out | low.contains(h.lower())
        return out

    comma = F.col("text").contains(",")
    headers = lines.groupBy("file").agg(
        F.min_by(F.struct("line_no", "text"), F.when(comma & has(date_hints), F.col("line_no"))).alias("_d"),
        F.min_by(F.struct("line_no", "text"), F.when(comma & has(value_hints), F.col("line_no"))).alias("_v"))
    headers = headers.select("file", F.coalesce("_d", "_v").alias("_h")).filter(F.col("_h").isNotNull())

    def cells(c):
        parts = F.split(c, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        return F.transform(parts, lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))

    def position(hints):
        exact = [F.expr(f"nullif(array_position(_low, '{h.lower()}'), 0)") for h in hints]
        inside = [F.expr(f"nullif(array_position(transform(_low, x -> contains(x, '{h.lower()}')), true), 0)") for h in hints]
        return F.coalesce(*exact, *inside)

    where = headers.withColumn("_names", cells(F.col("_h.text"))).withColumn(
        "_low", F.transform("_names", lambda x: F.lower(x)))
    where = where.select("file", F.col("_h.line_no").alias("_line"),
                         F.coalesce(position(date_hints), F.lit(1)).alias("_dc"), position(value_hints).alias("_vc"))
    body = lines.join(where, "file").filter(F.col("line_no") > F.col("_line")).withColumn("_c", cells(F.col("text")))
    value = F.regexp_replace(F.try_element_at("_c", F.col("_vc").cast("int")), ",", "")
    out = body.select("file", parse_date(F.try_element_at("_c", F.col("_dc").cast("int"))).alias("ts"),
                      F.when(~F.trim(value).isin(list(NULL_TOKENS)), F.trim(value)).try_cast("double").alias("value"))
    out = nan_to_null(out).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return out if start is None else out.filter(F.col("ts") >= F.lit(start))


def explode_payload(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """API payload ``[meta, [{date, value}, ...]]`` with yearly observations -> one row per known observation (December)."""
    outer = F.from_json(payload, "array<string>")
    obs = F.from_json(F.try_element_at(outer, F.lit(2)), "array<struct<date:string,value:string>>")
    rows = df.select(*keys, F.explode(obs).alias("o"))
    out = rows.select(*keys, F.make_date(F.col("o.date").try_cast("int"), F.lit(12), F.lit(1)).alias("ts"),
                      F.col("o.value").try_cast("double").alias("value"))
    return nan_to_null(out).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())


def source_precedence(candidates: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """The candidate with the smallest priority per key; a partial minimum, so no group is gathered."""
    rest = [c for c in candidates.columns if c not in keys]
    best = candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(priority)).alias("_best"))
    return best.select(*keys, "_best.*")


def override_lookup(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables by key; where both have the key the second table's values win."""
    values = [c for c in base.columns if c not in keys]
    require_columns(new, values)
    joined = base.alias("b").join(new.alias("n"), list(keys), "full")
    return joined.select(*keys, *[F.coalesce(f"n.{c}", f"b.{c}").alias(c) for c in values])


def effective_registry(registry: DataFrame, overrides: Sequence[Sequence], column: str = "form") -> DataFrame:
    """Registry with overrides applied: raw value, effective value, whether overridden, and base transform."""
    from panelspark.operators.transform import strip_suffix
    from panelspark.schema import lookup

    out = lookup(registry, overrides, ["entity", "indicator", "_override"], ["entity", "indicator"])
    out = out.withColumn("effective", F.coalesce("_override", column))
    return out.select("entity", "indicator", F.col(column).alias("registered"), "effective",
                      F.col("_override").isNotNull().alias("override_applied"), strip_suffix("effective").alias("base"))
