"""Exact quantiles of groups that may be far larger than one task.

Spark's exact percentile keeps every distinct value of a group in one buffer. Here
the counted values are dealt out by range. Each range of a group adds up to one row,
the running sum of these rows tells which range holds a wanted rank, and only the
values of that range are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldkpi.functions.joins import join_same


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows ``keys, _v, _c``: one row stands for all copies of a value.

    Durations repeat, and a large group is spread over the tasks by value.
    """
    rows = df.where(F.col(value).isNotNull())
    return (
        rows.select(*keys, F.col(value).cast("double").alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Rows ``keys, prob, n, quantile`` with linear interpolation between ranks."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs)


def quantiles_of_counts(
    values: DataFrame, keys: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """``exact_quantiles`` of rows ``keys, _v, _c``."""
    keys = list(keys)
    # The bounds of a range are its own least and greatest value, so the result does not
    # depend on where Spark's sample cuts; a window below orders one range at the most.
    ranges = (
        values.repartitionByRange(*keys, "_v")
        .groupBy(*keys, F.spark_partition_id().alias("_range"))
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_size"))
    )
    group = Window.partitionBy(*keys)
    upto = F.sum("_size").over(
        group.orderBy("_lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rank = (F.col("_n") - 1) * F.col("prob")
    wanted = (
        ranges.withColumn("_n", F.sum("_size").over(group))
        .withColumn("_upto", upto)
        .withColumn("_below", F.col("_upto") - F.col("_size"))
        .withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        .withColumn("_first", F.floor(rank))
        .withColumn("_last", F.ceil(rank))
        .withColumn("_part", rank - F.floor(rank))
        # The two ranks around a quantile may lie in two ranges.
        .where((F.col("_below") <= F.col("_last")) & (F.col("_first") < F.col("_upto")))
        .select(*keys, "prob", "_n", "_first", "_last", "_part", "_lo", "_hi", "_below")
    )

    inside = join_same(values, wanted, keys).where(
        F.col("_v").between(F.col("_lo"), F.col("_hi"))
    )
    ordered = Window.partitionBy(*keys, "prob", "_below").orderBy("_v")
    end = F.col("_below") + F.sum("_c").over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = inside.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(position: str):
        here = (F.col("_start") <= F.col(position)) & (F.col(position) < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    found = placed.groupBy(*keys, "prob", "_n", "_part").agg(
        at("_first").alias("_a"), at("_last").alias("_b")
    )
    return found.select(
        *keys,
        "prob",
        F.col("_n").alias("n"),
        (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"),
    )
