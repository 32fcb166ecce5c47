"""Calendar events placed at an expert's home market and local day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.labels import market_label
from fieldkpi.functions.times import (
    DEFAULT_SINCE,
    Day,
    could_be_after,
    could_be_between,
    day,
    local_date,
    minutes_between,
)


def at_home(
    rows: DataFrame, experts: DataFrame, centers: DataFrame, expert: str = "expert_id"
) -> DataFrame:
    """Add ``market`` (label), ``center_market`` and ``time_zone`` of an expert's current center.

    The dimensions join one after the other, so Spark weighs each by its own size:
    both are broadcast when small, and only a large expert table costs a shuffle,
    in which hot experts are split at run time.
    """
    house = experts.select(
        F.col("expert_id").alias(expert), F.col("current_enjoyment_house_id").alias("center_id")
    )
    center = centers.select(
        F.col("id").alias("center_id"),
        market_label().alias("market"),
        F.col("market").alias("center_market"),
        "time_zone",
    )
    return rows.join(house, expert).join(center, "center_id").drop("center_id")


def enabled_blocks(
    blocks: DataFrame,
    *event_types: str,
    since: Day | None = None,
    between: tuple[Day, Day] | None = None,
) -> DataFrame:
    """Enabled calendar blocks of the given types; the tests reach the scan.

    ``since`` and ``between`` (first and last local day) keep all rows that could qualify.
    """
    kept = blocks.where(F.col("enabled") & F.col("event_type").isin(*event_types))
    if since is not None:
        kept = kept.where(could_be_after("start_time", since))
    if between is not None:
        kept = kept.where(could_be_between("start_time", *between))
    return kept.select(
        F.col("id").alias("calendar_block_id"),
        "event_id",
        "event_type",
        "start_time",
        "end_time",
    )


def scheduled_events(
    blocks: DataFrame,
    sched: DataFrame,
    *event_types: str,
    since: Day | None = None,
    between: tuple[Day, Day] | None = None,
) -> DataFrame:
    """Enabled blocks with the expert who was scheduled for them."""
    return enabled_blocks(blocks, *event_types, since=since, between=between).join(
        sched.select("calendar_block_id", "expert_id"), "calendar_block_id"
    )


def located_events(
    blocks: DataFrame,
    sched: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    event_type: str,
    since: Day | None = DEFAULT_SINCE,
) -> DataFrame:
    """Rows ``event_id, expert_id, event_date, market, center_market, minutes``.

    The date is the local day of the block start at the expert's home center.
    """
    rows = (
        at_home(scheduled_events(blocks, sched, event_type, since=since), experts, centers)
        .select(
            "event_id",
            "expert_id",
            local_date("start_time", "time_zone").alias("event_date"),
            "market",
            "center_market",
            minutes_between("start_time", "end_time").alias("minutes"),
        )
    )
    return rows if since is None else rows.where(F.col("event_date") > day(since))


def by_day_and_market(rows: DataFrame, *measures: Column, date: str = "event_date") -> DataFrame:
    return rows.groupBy(date, "market").agg(*measures).orderBy(date, "market")
