"""Session settings the operators are planned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # An aggregate above a join on the same key hides the join from skew
    # splitting unless it is forced; one expert may own a third of the blocks.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to an existing session.

    The time zone is part of the results and set each time; the others are set once a
    session, only where the caller has left them alone.
    """
    spark.conf.set("spark.sql.session.timeZone", RUNTIME_SETTINGS["spark.sql.session.timeZone"])
    if getattr(spark, "_fieldkpi_configured", False):
        return spark
    chosen = {row["key"] for row in spark.sql("SET").collect()}
    for key, value in RUNTIME_SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    spark._fieldkpi_configured = True
    return spark


def local_session(app: str = "fieldkpi", cpus: int | str | None = None) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
