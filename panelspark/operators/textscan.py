"""Scans over tables of texts: secrets, leftovers, links, anchors, identifiers, sizes.

Every pattern is evaluated where the text lies; only short hits are exploded or shuffled, never the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Secret patterns with their labels, and case-insensitive leftover patterns.
SECRETS = (
    (r"FRED_API_KEY\s*=\s*['\"][a-f0-9]{16,}", "data service key"),
    (r"api[_-]?key['\"]?\s*[:=]\s*['\"][A-Za-z0-9]{20,}", "generic api key"),
    (r"ghp_[A-Za-z0-9]{20,}", "personal access token"),
    (r"AKIA[0-9A-Z]{16}", "cloud access key"),
    (r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "private key block"),
)
PLACEHOLDERS = (
    (r"\[your[-_ ]handle\]", "generic placeholder"),
    (r"YOUR[-_ ]GITHUB", "uppercase placeholder"),
    (r"TODO\b|FIXME\b|XXX\b", "development marker"),
)
MARKDOWN_LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
HEADING = r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"
ANCHOR = r"\]\(#([^)]+)\)"


def scan_secrets(docs: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str]] = SECRETS) -> DataFrame:
    """(key, label) for every pattern found in a text."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(label)) for p, label in patterns]))
    return docs.select(key, F.explode(hits).alias("label"))


def scan_placeholders(docs: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str]] = PLACEHOLDERS) -> DataFrame:
    """(key, label, n_hits) for every leftover pattern found, case ignored."""
    counts = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_count(text, F.lit("(?i)" + p)).cast("bigint").alias("n_hits")) for p, label in patterns])
    return docs.select(key, F.explode(counts).alias("_p")).select(key, "_p.*").filter(F.col("n_hits") > 0)


def links(docs: DataFrame, key: str, text: str, pattern: str = MARKDOWN_LINK) -> DataFrame:
    """(key, target, n_links): relative link targets without anchor and query, counted per text."""
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("_l"))
    target = F.regexp_replace("_l", "[#?].*$", "")
    return found.select(key, target.alias("target")).filter((F.col("target") != "") & ~F.col("target").rlike("^(https?://|mailto:)")).groupBy(key, "target").agg(
        F.count(F.lit(1)).alias("n_links"))


def broken_links(docs: DataFrame, key: str, text: str, known: DataFrame, pattern: str = MARKDOWN_LINK) -> DataFrame:
    """Links whose target is not in ``known`` (target). Both sides are reduced to distinct values before the join."""
    return links(docs, key, text, pattern).join(known.select("target").distinct(), "target", "left_anti").select(key, "target", "n_links")


def slug(title: Column) -> Column:
    """Anchor that a heading gets: lower case, letters, digits, underscores and hyphens, spaces to hyphens."""
    kept = F.regexp_replace(F.lower(title), "[^\\p{L}\\p{N}_\\s-]", "")
    return F.regexp_replace(F.trim(kept), "\\s+", "-")


def broken_anchors(docs: DataFrame, key: str, text: str, heading: str = HEADING, anchor: str = ANCHOR) -> DataFrame:
    """Anchors of a text that match none of its headings; decided inside the text's own row."""
    slugs = F.transform(F.regexp_extract_all(text, F.lit(heading), 1), slug)
    anchors = F.array_distinct(F.regexp_extract_all(text, F.lit(anchor), 1))
    return docs.select(key, F.explode(F.array_except(anchors, slugs)).alias("anchor"))


def identifiers(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, id): distinct identifiers of every text, as the first group of ``pattern`` finds them."""
    return docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("id"))


def unresolved_ids(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Referenced but undefined identifiers with the number of texts that use them, and the highest defined number.

    References are counted per identifier before the join, so a popular one is a single row.
    """
    used = references.groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"))
    defined = definitions.select("id").distinct()
    top = defined.agg(F.max(F.regexp_extract("id", "(\\d+)$", 1).cast("bigint")).alias("max_defined"))
    return used.join(defined, "id", "left_anti").join(F.broadcast(top))


def size_outliers(docs: DataFrame, key: str, size: str, warn: int, critical: int) -> DataFrame:
    level = F.when(F.col(size) >= critical, "CRITICAL").when(F.col(size) >= warn, "WARNING")
    return docs.filter(F.col(size) >= min(warn, critical)).select(key, size, level.alias("severity"))


def issue_rollup(issues: DataFrame, severities: Sequence[str] = ("CRITICAL", "WARNING", "INFO")) -> DataFrame:
    return issues.groupBy("section").pivot("severity", list(severities)).agg(F.count(F.lit(1))).na.fill(0)
