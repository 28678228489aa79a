"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its rows are written as Parquet in the
shared folder and read again as the next one's docs, so a lost executor never costs more than the stage at hand. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelark.llm import exact_dedup, mixing, ngram_join, packing, quality_mil
from pagelark.llm.common import crc_bucket, table
from pagelark.sources.scratch import Workspace

#: Documents whose score is below this go.
QUALITY_FLOOR = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a fifth of the labels stays unseen for audits."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)
    scored = quality_mil.score(docs.withColumnRenamed("score", "_score"), quality_mil.fit(docs, labels))
    return scored.where(F.col("score") >= QUALITY_FLOOR).drop("score").withColumnRenamed("_score", "score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their five-word shingles."""
    return ngram_join.representatives(docs, ngram=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens, with their ids."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Classification, sampling by hash and tokenising have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
