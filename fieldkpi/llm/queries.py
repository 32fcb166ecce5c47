"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkpi.llm import (
    fixity,
    hostrank,
    leaks,
    licenses,
    mixing,
    neardup,
    negatives,
    repeats,
    secrets,
    severity,
    shards,
    vectors,
    whitening,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    )


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_read(spark, sf_dir, "documents")).drop("spans", "kept")


def _fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return fixity.fixity_audit(
        fixity.page_records(pages), fixity.page_records(fixity.damaged(pages))
    )


def _severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.severity_report(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    )


def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=4)


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_read(spark, sf_dir, "documents"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def _training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.in_slot_order(shards.training_order(_read(spark, sf_dir, "documents")))


def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrank.url_verdicts(_read(spark, sf_dir, "pages"))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents"))


def _hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row is mislabelled; every hundredth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(
        _read(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0
    )
    return negatives.mine_negatives(rows)


def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_read(spark, sf_dir, "embeddings"))


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_spaced_seed_leaks": _leaks,
    "op2_repeated_passages": _repeats,
    "op3_merkle_fixity": _fixity,
    "op4_toxic_severity": _severity,
    "op5_setsketch_near_duplicates": _near_duplicates,
    "op6_secret_entropy": _secrets,
    "op7_pq_near_vectors": _vectors,
    "op8_training_order": _training_order,
    "op9_host_rank": _url_filter,
    "op10_source_mixture": _mixture,
    "op11_cover_tree_negatives": _hard_negatives,
    "op12_cholesky_jacobi_whitening": _whitening,
    "op13_license_diagonals": _licenses,
}
