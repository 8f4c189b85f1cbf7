"""Registered queries of the training-data operators and their SQL. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import codes, decontaminate, divergence, hamming, jaccard, langid, licenses, lm, mixing, quality, sharding, substrings, tokens

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses whose notice is contained, to three quarters of its 5-grams, in a window of a document."""
    return licenses.scan(read(spark, sf_dir))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts are one apart at most."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                                      F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(docs, docs.columns).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without windows of 13 words that an earlier document has."""
    done = substrings.dedup(read(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return jaccard.link(read(spark, sf_dir))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to source weights 3, 1, 2; 150% of all words, twice a source at most."""
    mixed = mixing.mix(read(spark, sf_dir).select("doc_id", "text", "source"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text under the model and its unigram base; a tenth of the documents is held out."""
    return lm.score(read(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of 10 benchmark words."""
    found = decontaminate.decontaminate(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; a fifth of the documents is held out from training."""
    docs = read(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by a public byte-level vocabulary."""
    import public_tokenizers

    return tokens.token_counts(read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of every document."""
    return quality.judge(read(spark, sf_dir), ["doc_id"])


@query
def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sources of a language differ: every pair's distance and each source's 50 most typical terms."""
    return divergence.audit(read(spark, sf_dir))


@query
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more; the smallest id stays."""
    return hamming.deduplicate(read(spark, sf_dir))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four parts of every vector, their errors, and the errors of each label together."""
    found, books = codes.compress(read(spark, sf_dir, "embeddings"), carry=["label"])
    found = found.select("row.vec_id", "row.label", "code", "error")
    labels = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return found.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


ORACLE["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
m AS (SELECT doc_id, i, p.k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM pos) x
      JOIN p ON x.win = p.win AND x.k = p.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

def _components_sql(words: int, percent: int, more: str = "") -> str:
    """Pairs of documents by the shingles that they share, and the smallest id that links reach."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {words}) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= {percent} * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, CASE WHEN e.a = r.c THEN e.b ELSE e.a END FROM r JOIN e ON r.c = e.a OR r.c = e.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id{more}
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id, n"""


ORACLE["op9_jaccard_join"] = _components_sql(5, 75)
ORACLE["op12_minhash_dedup"] = _components_sql(2, 80, ", min(c) = d.doc_id AS kept")

ORACLE["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
f AS (SELECT win, min(doc_id) AS low FROM p GROUP BY 1),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT p.doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f ON p.win = f.win WHERE low < p.doc_id)),
r AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
       lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""


def _license_sql() -> str:
    """Every window compared with every template, by words instead of hashes."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
    return rf"""
WITH t0 AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '{licenses.SPLIT}'), lambda x: x <> '') AS w FROM (VALUES {quoted}) v(license, text)),
t AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t0)),
n AS (SELECT license, count(*) AS n, CAST(pow(2, greatest(0, floor(log2(greatest(1, count(*) // 4))))) AS BIGINT) AS stride FROM t GROUP BY 1),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{licenses.SPLIT}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
m AS (SELECT s.doc_id, i, s.g, t.license, n, stride FROM s JOIN t ON s.g = t.g JOIN n ON t.license = n.license),
x AS (SELECT doc_id, license, n, spot, count(DISTINCT g) AS k
      FROM (SELECT *, unnest(range(greatest(0, ((i - (n + stride - 1)) // stride + 1) * stride), i + 1, stride)) AS spot FROM m) GROUP BY ALL)
SELECT doc_id, license, max(k) AS n_shared, max(n) AS n_shingles, min(spot) AS first_word, count(*) AS n_windows, max(k) / max(n) AS containment
FROM x WHERE k >= 0.75 * n GROUP BY doc_id, license"""


ORACLE["op1_license_scan"] = _license_sql()


ORACLE["op11_divergence_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 30),
l AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1),
c AS (SELECT t.lang, source, term, CAST(sum(t.n) AS BIGINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(v, 0) AS v, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN l ON l.lang = x.lang LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v) AS p,
             1 + 1000000000 * (k.n + 5) // (l.n + 5 * l.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
             CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50"""


def _codes_sql() -> str:
    """All distances of every round, part by part."""
    steps = []
    for i in range(5):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, p, s, min(256 * CAST(list_sum(list_transform(range(1, w + 1), lambda i: (s[i] - m[i]) * (s[i] - m[i])))
                     AS BIGINT) + e) AS best FROM x JOIN c{i} USING (p) GROUP BY ALL)""")
        if i < 4:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.p, e, coalesce(f, m) AS m FROM c{i} LEFT JOIN (SELECT p, best % 256 AS e,
                         list(f ORDER BY i) AS f FROM (SELECT p, best % 256 AS best, i, CAST(floor(CAST(sum(s[i]) AS DOUBLE) / count(*)) AS BIGINT) AS f
                         FROM a{i}, range(1, (SELECT max(w) FROM x) + 1) r(i) GROUP BY p, best % 256, i) GROUP BY 1, 2) USING (p, e))""")
    return r"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, len(v) // 4 AS w, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS s FROM v, range(4) r(p)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, s AS m FROM (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM x) WHERE n <= 256),
""" + ",\n".join(steps) + r""",
b AS (SELECT sha256(string_agg(CAST(m[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM c4, range(1, (SELECT max(w) FROM x) + 1) r(i)),
o AS (SELECT vec_id, string_agg(lower(lpad(hex(best % 256), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY 1)
SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM o JOIN v USING (vec_id), b"""


ORACLE["op13_vector_codes"] = _codes_sql()
