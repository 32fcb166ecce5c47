"""Small hand-made tables. Text in timestamp and date columns is cast on the way."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "centers": "id bigint, name string, market string, address_id bigint, time_zone string",
    "experts": "expert_id bigint, expert_type string, expert_first_name string,"
    " expert_last_name string, current_enjoyment_house_id bigint,"
    " current_enjoyment_house_name string, home_enjoyment_house_name string",
    "blocks": "id bigint, event_id bigint, event_type string, start_time timestamp_ntz,"
    " end_time timestamp_ntz, enabled boolean",
    "sched": "calendar_block_id bigint, shift_id bigint, expert_id bigint",
    "shifts": "id bigint, expert_id bigint, start_time timestamp_ntz, end_time timestamp_ntz,"
    " enabled boolean",
    "transfers": "id bigint, expert_id bigint, travel_time_id bigint,"
    " inventory_location_id bigint, meeting_address_id bigint, created_at timestamp_ntz",
    "bridge": "id bigint, inventory_transfer_id bigint, order_item_id bigint",
    "items": "id bigint, order_id bigint, sku string, pick_up_location_id bigint",
    "visits": "id bigint, order_id bigint, expert_id bigint, travel_time_id bigint,"
    " meeting_address_id bigint, created_by_type string, status string,"
    " visit_created_date_local date",
    "visit_facts": "visit_id bigint, order_id bigint, expert_id bigint, visit_status string,"
    " visit_created_date_local date, visit_created_ts_local timestamp_ntz,"
    " visit_updated_ts_utc timestamp_ntz, visit_start_date_local date,"
    " visit_end_date_local date",
    "order_master": "order_id bigint, expert_id bigint, order_status string,"
    " order_created_date_local date, order_created_ts_local timestamp_ntz,"
    " order_created_date_pt date, canceled_ts_utc timestamp_ntz, partner_channel string,"
    " partner_id int, visit_id bigint, visit_date_local date, visit_eh string",
    "samples": "market string, period string, metric string, value double",
}

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
}


def table(spark: SparkSession, name_or_schema: str, rows: list[tuple]) -> DataFrame:
    """A frame from rows; a short row is filled with nulls.

    Arrow data becomes a local relation of known size, so small joins broadcast.
    """
    fields = [
        f.strip().split(" ") for f in SCHEMAS.get(name_or_schema, name_or_schema).split(",")
    ]
    filled = [tuple(r) + (None,) * (len(fields) - len(r)) for r in rows]
    columns = list(zip(*filled)) or [()] * len(fields)
    data = pa.table(
        {n: pa.array(c, ARROW.get(t, pa.string())) for (n, t), c in zip(fields, columns)}
    )
    df = spark.createDataFrame(data)
    return df.select(*(F.col(n).cast(t).alias(n) for n, t in fields))


def centers(spark: SparkSession) -> DataFrame:
    return table(
        spark,
        "centers",
        [
            (4, "Los Angeles", "LA", 1, "America/Los_Angeles"),
            (2, "New York", "NY", 2, "America/New_York"),
            (3, "Berlin", None, 3, "Europe/Berlin"),
        ],
    )


def experts(spark: SparkSession) -> DataFrame:
    return table(
        spark,
        "experts",
        [
            (1, "Expert", "Ann", "Lee", 4, "Los Angeles", "Los Angeles"),
            (2, "Expert", "Bo", None, 4, "Los Angeles", "New York"),
            (3, "Expert", "Cy", "Ray", 2, "New York", "New York"),
            (4, "Trainer", "Di", "Fox", 3, "Berlin", "Berlin"),
        ],
    )


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Collected rows as tuples, dates as text, in a repeatable order."""
    picked = df.select(*columns) if columns else df
    out = [
        tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in picked.collect()
    ]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@contextmanager
def settings_of(spark, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
