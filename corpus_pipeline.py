"""The corpus pipeline over ``documents``: five stages, each one operator.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.
All but the last return the columns of ``documents``; the last writes the training
shards to the shared folder and returns the manifest of their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldkpi.llm import leaks, mixing, neardup, severity, shards
from fieldkpi.llm.common import new_path

# Its rows follow seeded hashes, a trained model and sketches: no SQL states them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejection severity."""
    return severity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    return neardup.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def write_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of all sequences in training order, and their manifest."""
    return shards.materialise(docs, new_path(spark, "training-shards"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token output", write_training_order),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
