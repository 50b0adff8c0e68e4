"""A corpus pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontaminate, quality, queries, simhash, toxicity
from strandframe.llm.common import held_out, table
from strandframe.plans.session import materialize, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows predicted toxic; every row is judged by its own text, with or without an id."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select("kept.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows predicted of low quality, each by its own text."""
    stats = materialize(quality.document_statistics(docs, keep=COLUMNS), "stats")
    model = quality.fit(stats, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return quality.score(stats, model).where("predicted = 1").select("kept.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group.

    Rows that repeat both id and text count as one document; different texts under one id both
    stay; rows with a null id have no place in a group and all stay.
    """
    copies = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    kept = docs.select(*COLUMNS).join(copies, "doc_id", "left_anti").select(*COLUMNS)
    if not _repeats(docs):
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id IS NULL"))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the contamination rule marks."""
    found = decontaminate.judged(decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS))
    return found.where("NOT contaminated").select("kept.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts; returns the digests of both."""
    return queries.bpe_digest(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/strandframe/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
