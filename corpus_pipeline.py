"""Training corpus from raw documents: each stage works on all that the stage before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, jaccard, langid, mixing, sharding
from panelspark.llm.tables import WRITTEN, discard, saved

#: Bytes of rows that are handed to Python at once, about. Spark's own limits allow 10,000 whole texts, of which a task holds some copies.
HANDED = 2 << 20
#: Working tables of the stage that ran last.
_LEFT: list[str] = []


def stage(work):
    """A stage: the working tables of the one before go first, as its result has been written and read again by then.

    Its result is computed after it returns, so the session keeps the limit on what is handed to Python at once.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _LEFT)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", HANDED)
        before = len(WRITTEN)
        out = work(spark, docs, sf_dir)
        _LEFT[:] = WRITTEN[before:]
        del WRITTEN[before:]
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a fifth of them doesn't train the model. ``lang`` stays as it came.

    Null, empty and letterless texts go, repeated rows are judged each, an empty table gives none.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = langid.train(docs.where(~held_out))
    # a row and its prediction stay together: the struct is the key that the operator hands on
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return langid.identify(rows, model, key="row").where("lang_pred <> 'und'").select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component.

    Null and empty texts link with nothing and stay, as do rows without an id; repeated rows of a kept id all stay.
    """
    linked = jaccard.link(docs)
    gone = saved(linked.where("component_id <> doc_id").select("doc_id").distinct())
    # so that texts stay where they are
    return docs.join(F.broadcast(gone) if gone.count() <= jaccard.SENT else gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; those without words have none and stay, repeated rows are judged each."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice. Null sources form one of their own, a text without words has size 0."""
    rows = mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"), ["row"])
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


@stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in 40 shards of equal row counts, in a uniform order, whatever they hold."""
    return sharding.shard(docs, docs.columns)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed),
          ("sharding", sharded)]
#: A trained model and seeded picks decide, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES:
        docs = saved(work(spark, docs, sf_dir))
    return docs
