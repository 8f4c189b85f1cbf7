"""Registered queries: text scans over documents and pages.

The given texts hold none of the fixed secret formats, so marks derived from each row's own key are appended to the
whole text before scanning; the SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import textscan as ts
from panelspark.plans.catalog import query
from panelspark.plans.oracle import define

MARKS = ["' api_key=\"' || md5({k}) || '\"'", "' ghp_' || md5({k})", "' AKIA' || upper(substr(md5({k}), 1, 16))", "' TODO and todo, FIXME'", "' [Your-Handle] see your_github'",
         "' -----BEGIN RSA PRIVATE KEY-----'"]


def _marked(key: str) -> str:
    k = f"CAST(doc_id AS {key})"
    return "text || CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN {m.format(k=k)}" for i, m in enumerate(MARKS)) + " ELSE '' END"


def marked(t):
    return t.documents.select("doc_id", "lang", "n_chars", F.expr(_marked("STRING")).alias("text"))


define("mdocs", f"SELECT doc_id, lang, n_chars, {_marked('VARCHAR')} AS text FROM documents")


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


define("l01", " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM mdocs WHERE regexp_matches(text, {_lit(p)})" for p, label in ts.SECRETS))
define("l02", " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, len(regexp_extract_all(text, {_lit('(?i)' + p)})) AS n_hits FROM mdocs" for p, label in ts.PLACEHOLDERS))
query("l01_scan_secrets", "SELECT * FROM l01")(lambda t: ts.scan_secrets(marked(t), "doc_id", "text"))
query("l02_scan_placeholders", "SELECT * FROM l02 WHERE n_hits > 0")(lambda t: ts.scan_placeholders(marked(t), "doc_id", "text"))

HREF = 'href="([^"]*)"'
define("hrefs", f"SELECT page_id, regexp_replace(l, '[#?].*$', '') AS target, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, {_lit(HREF)}, 1)) AS l FROM pages) GROUP BY 1, 2")
define("words", "SELECT DISTINCT '/' || unnest(string_split(text, ' ')) AS target FROM benchmark")
query("l03_broken_links", "SELECT page_id, target, n_links FROM hrefs WHERE target <> '' AND NOT regexp_matches(target, '^(https?://|mailto:)') AND target NOT IN (SELECT target FROM words)")(
    lambda t: ts.broken_links(t.pages, "page_id", "html", t.benchmark.select(F.explode(F.split("text", " ")).alias("_w")).select(F.concat(F.lit("/"), "_w").alias("target")), HREF))

H1 = "<h1>(.*?)</h1>"
_md = "'# ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) || chr(10) || '[top](#' || lower(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), ' ', '-')) || ') and [end](#end-' || page_id || ')'"
define("mdp", f"SELECT page_id, {_md} AS text FROM pages")
_slug = "regexp_replace(trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}_\\s-]', '', 'g')), '\\s+', '-', 'g')"
query("l04_broken_anchors", f"SELECT page_id, unnest(list_filter(list_distinct(regexp_extract_all(text, {_lit(ts.ANCHOR)}, 1)), lambda a: NOT list_contains(list_transform(regexp_extract_all(text, {_lit(ts.HEADING)}, 1), lambda x: {_slug}), a))) AS anchor FROM mdp")(
    lambda t: ts.broken_anchors(t.pages.select("page_id", F.expr(_md).alias("text")), "page_id", "text"))

#: How documents are numbered here.
IDENTIFIER = r"\b(REF-\d{2})\b"
_ref = "text || ' see REF-' || lpad(CAST(doc_id * 7 % 100 AS {s}), 2, '0') || ' and REF-' || lpad(CAST(doc_id % 60 AS {s}), 2, '0') || '.'"
define("refs", f"SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all({_ref.format(s='VARCHAR')}, {_lit(IDENTIFIER)}, 1))) AS id FROM documents")
query("l05_unresolved_ids", "SELECT id, count(*) AS n_texts, (SELECT max(CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)) FROM refs WHERE lang = 'de') AS max_defined FROM refs WHERE lang <> 'de' AND id NOT IN (SELECT id FROM refs WHERE lang = 'de') GROUP BY 1")(
    lambda t: ts.unresolved_ids(*[ts.identifiers(t.documents.filter(c).select("doc_id", F.expr(_ref.format(s="STRING")).alias("text")), "doc_id", "text", IDENTIFIER) for c in ("lang <> 'de'", "lang = 'de'")]))
query("l06_size_outliers", "SELECT doc_id, n_chars, CASE WHEN n_chars >= 10000 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM documents WHERE n_chars >= 5000")(
    lambda t: ts.size_outliers(t.documents, "doc_id", "n_chars", 5000, 10000))


@query("l07_issue_rollup", "SELECT section, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS \"CRITICAL\", count(CASE WHEN severity = 'WARNING' THEN 1 END) AS \"WARNING\", count(CASE WHEN severity = 'INFO' THEN 1 END) AS \"INFO\" FROM (SELECT 'secrets' AS section, 'CRITICAL' AS severity FROM l01 "
       "UNION ALL SELECT 'leftovers', CASE WHEN n_hits > 2 THEN 'WARNING' ELSE 'INFO' END FROM l02 WHERE n_hits > 0 UNION ALL SELECT 'size', CASE WHEN n_chars >= 10000 THEN 'CRITICAL' ELSE 'WARNING' END FROM documents WHERE n_chars >= 5000) GROUP BY 1")
def l07(t):
    docs = marked(t)
    issues = ts.scan_secrets(docs, "doc_id", "text").select(F.lit("secrets").alias("section"), F.lit("CRITICAL").alias("severity"))
    left = ts.scan_placeholders(docs, "doc_id", "text").select(F.lit("leftovers").alias("section"), F.when(F.col("n_hits") > 2, "WARNING").otherwise("INFO").alias("severity"))
    size = ts.size_outliers(t.documents, "doc_id", "n_chars", 5000, 10000).select(F.lit("size").alias("section"), "severity")
    return ts.issue_rollup(issues.unionByName(left).unionByName(size))
