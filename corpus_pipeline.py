"""Corpus pipeline: ``documents`` through language, near duplicates, contamination, mixture and shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again. SQL can't express the trained models and the iterated links,
so there is no SQL for the rows of :func:`run`; a brute-force version is in ``tests/llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm import decontaminate, jaccard, language, mixing, sharding
from obsflow.session import checkpoint_folder, ship

SHARDS = 40
MIXTURE = {"good": 0.92, "low": 0.06, "toxic": 0.02}


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is rejected go (no letter, or a score below the calibrated threshold)."""
    ship(spark)
    found = language.identify(docs, language.fit_language(docs, F.lit(False)))
    return found.where("not lang_rejected").select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of every group of near copies the document with the smallest id stays."""
    ship(spark)
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    ship(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents of over-represented domains are thinned out by their rates; good ones stay."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_once(docs, mixing.quality_domains(labels), MIXTURE, anchor="good")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the columns of ``documents`` with shard, slot and the shard among one more."""
    ship(spark)
    placed = sharding.assign_shards(docs, [1.0] * SHARDS, [1.0])
    return sharding.number_slots(placed, SHARDS, ["doc_id"])


STAGES = [
    ("language_id", identified),
    ("jaccard_join", deduplicated),
    ("decontamination", decontaminated),
    ("target_mixture", mixed),
    ("sharding", sharded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
