"""Tables stored for the joins they take part in: bucketed by key, split by day.

A bridge and its items, bucketed alike by item id, join without a shuffle, as do blocks
and schedules by block id; folders by day let a report read its own days only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkpi.functions.times import Day, day, shift_day

DAY = "stored_day"


def write_bucketed(
    df: DataFrame,
    table: str,
    path: str,
    key: str,
    buckets: int,
    by_day: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write ``df`` as the catalog table ``table``, its files under ``path``.

    Rows are dealt by the bucketing hash first, so that one task writes one bucket and
    there is one sorted file per bucket (and day). ``by_day`` names a timestamp or date;
    its UTC day becomes the folder. Tables that shall join alike need equal key types
    and ``buckets``. A key that holds very many rows is one bucket's file, which the scan
    splits no further: give such a table more columns or leave it unbucketed.
    """
    if by_day is not None:
        df = df.withColumn(DAY, F.to_date(by_day))
    writer = df.repartition(buckets, key).write.format("parquet").mode(mode)
    if by_day is not None:
        writer = writer.partitionBy(DAY)
    writer.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_bucketed(
    spark: SparkSession, table: str, first: Day | None = None, last: Day | None = None
) -> DataFrame:
    """A table of ``write_bucketed`` without its folder column. For local days ``first`` to
    ``last`` only the folders of UTC days that may hold them are read (no zone is more than
    a day off); the exact test stays with the operators."""
    df = spark.table(table)
    if first is not None:
        df = df.where(F.col(DAY) >= day(shift_day(first, -1)))
    if last is not None:
        df = df.where(F.col(DAY) <= day(shift_day(last, 1)))
    return df.drop(DAY)
