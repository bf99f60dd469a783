"""From raw documents to a training mixture: five stages, each one of the package's operators.

Every stage takes the documents that the one before it kept and returns those that it keeps, with the
columns of ``documents``; the last adds what it sampled by. Each result is saved as Parquet and read
again, so a lost executor costs a re-read and no stage repeats another's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm.batches import saved
from shiftlens.llm.quality_vote import score_quality
from shiftlens.llm.raking import mix
from shiftlens.llm.randomness import redacted
from shiftlens.llm.signature_join import one_of_each
from shiftlens.llm.winnowing import decontaminate
from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote does not reject; texts without words get the share of good labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return saved(score_quality(docs, labels).where("predicted = 1").select(*docs.columns), "quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; see ``one_of_each``."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item.

    Rows that repeat a ``doc_id`` go together if one of them is contaminated; among rows without one,
    each text by itself.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    numbered = found.where("contaminated and doc_id is not null").select("doc_id").distinct()
    clean = docs.where("doc_id is not null").join(broadcast_if_small(written(numbered, "contaminated")), "doc_id", "left_anti")
    nameless = docs.where("doc_id is null")
    if not nameless.limit(1).count():
        return clean.select(*docs.columns)
    marked = nameless.withColumn("doc_id", F.xxhash64("text"))
    hit = decontaminate(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id").distinct()
    rest = marked.join(hit, "doc_id", "left_anti").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return clean.select(*docs.columns).unionByName(rest.select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the new text."""
    masked = redacted(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))
    return masked.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated sample keeps, with ``topic``, ``n_tokens`` and ``probability``."""
    return mix(docs).where("kept").drop("kept")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
]

#: The classifier and the randomness tests are not expressible in SQL; the tests use plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
