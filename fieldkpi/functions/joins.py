"""Joins back to aggregates of the same rows, and to spells of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.times import Day, day

# Days that share one bucket of ``held_on_day``.
BUCKET_DAYS = 32


def join_same(rows: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a per-group row to every row; a null key matches a null key.

    Without keys ``per_group`` is a one-row total.
    """
    renamed = per_group.select(
        *(F.col(k).alias(f"_group_{k}") for k in keys),
        *(c for c in per_group.columns if c not in keys),
    )
    if not keys:
        return rows.join(F.broadcast(renamed))
    same = [rows[k].eqNullSafe(renamed[f"_group_{k}"]) for k in keys]
    return rows.join(renamed, same).drop(*(f"_group_{k}" for k in keys))


def held_on_day(
    rows: DataFrame,
    spells: DataFrame,
    key: str,
    on_day: str,
    start: str,
    end: str,
    first: Day,
    last: Day,
    bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Rows with every spell of their key that holds on their day, both ends included.

    ``spells`` has ``key``, ``start``, ``end`` and its own columns. Days are dealt into
    buckets, a spell stands once in each bucket it touches, and rows meet only the spells of
    their key and bucket: a key with very many spells and rows is spread over its buckets
    instead of pairing all with all. ``first`` and ``last`` bound the days of the rows, and so
    the buckets of a spell without a near end; rows of other days are lost. Overlapping
    spells all count; a spell with a missing end holds on no day.
    """

    def bucket(value: Column) -> Column:
        return F.floor(F.datediff(value, F.lit("1970-01-01").cast("date")) / bucket_days)

    inside = F.col(on_day).between(day(first), day(last))
    touched = F.sequence(
        bucket(F.greatest(F.col(start), day(first))), bucket(F.least(F.col(end), day(last)))
    )
    dealt = (
        spells.where(
            (F.col(start) <= F.col(end)) & (F.col(start) <= day(last)) & (F.col(end) >= day(first))
        )
        .withColumn("_bucket", F.explode(touched))
        .withColumnRenamed(key, "_key")
    )
    met = rows.where(inside).withColumn("_day_bucket", bucket(F.col(on_day)))
    return met.join(
        dealt,
        (F.col(key) == F.col("_key"))
        & (F.col("_day_bucket") == F.col("_bucket"))
        & F.col(on_day).between(F.col(start), F.col(end)),
    ).drop("_key", "_bucket", "_day_bucket")
