"""Rates at every level of time and place from one set of daily sums.

Day, week and month, and market, region and all, are grouping sets over sums that
merge: the facts are reduced to one row per day and market before the sets expand them,
so each fact is shuffled once however many levels there are. Distinct counts merge too,
as exact bitmaps of ids, so weeks and months need the days' bitmaps only, never the rows.

Rates follow from the sums: PED is pickups over expert days (an expert on a day on which
they picked up), UPP is units over pickups. Weeks begin on Monday.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.labels import partner_label, ratio
from fieldkpi.operators.pickups import with_units

TIME_LEVELS = {"day": "event_date", "week": "week", "month": "month"}
PLACE_LEVELS = {"market": "market", "region": "center_market", "all": None}


def over_levels(daily: DataFrame, *measures: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """``measures`` of rows with ``event_date, market, center_market`` at all levels.

    Rows ``time_level, period_start, place_level, place``, the columns ``within`` (which
    every set keeps) and the measures; the place of all is null.
    """
    dated = daily.withColumns(
        {
            "week": F.to_date(F.date_trunc("week", "event_date")),
            "month": F.to_date(F.date_trunc("month", "event_date")),
        }
    )
    places = {"market": ["market"], "region": ["center_market"], "all": []}
    sets = [[t, *places[p], *within] for t in TIME_LEVELS.values() for p in PLACE_LEVELS]
    columns = [*TIME_LEVELS.values(), "market", "center_market"]
    grouped = dated.groupingSets(
        [[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [*columns, *within])
    ).agg(*measures, *(F.grouping(c).alias(f"_no_{c}") for c in columns))

    def which(levels: dict[str, str | None], pick) -> Column:
        """``pick`` of the level whose column takes part in the row's set."""
        out = None
        for name, column in levels.items():
            value = pick(name, column)
            if column is None:
                return out.otherwise(value)
            test = F.col(f"_no_{column}") == 0
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    names = [c for c in grouped.columns if c not in columns and not c.startswith("_no_")]
    return grouped.select(
        which(TIME_LEVELS, lambda name, _: F.lit(name)).alias("time_level"),
        which(TIME_LEVELS, lambda _, column: F.col(column)).alias("period_start"),
        which(PLACE_LEVELS, lambda name, _: F.lit(name)).alias("place_level"),
        which(
            PLACE_LEVELS, lambda _, column: F.lit(None).cast("string") if column is None else F.col(column)
        ).alias("place"),
        *names,
    )


def daily_pickup_sums(events: DataFrame) -> DataFrame:
    """Rows ``event_date, market, center_market, n_pickups, n_expert_days``."""
    place = ["event_date", "market", "center_market"]
    return (
        events.groupBy(*place, "expert_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*place)
        .agg(F.sum("n").alias("n_pickups"), F.count(F.lit(1)).alias("n_expert_days"))
    )


def ped_levels(events: DataFrame) -> DataFrame:
    """Pickups, expert days and pickups per expert and day at all levels."""
    return over_levels(
        daily_pickup_sums(events),
        F.sum("n_pickups").alias("n_pickups"),
        F.sum("n_expert_days").alias("n_expert_days"),
        ratio(F.sum("n_pickups"), F.sum("n_expert_days")).alias("ped"),
    )


def upp_levels(events: DataFrame, units: DataFrame) -> DataFrame:
    """Pickups, units and units per pickup at all levels, zero-unit pickups included."""
    daily = (
        with_units(events, units)
        .groupBy("event_date", "market", "center_market")
        .agg(F.count("n_units").alias("n_pickups"), F.sum("n_units").alias("n_units"))
    )
    return over_levels(
        daily,
        F.sum("n_pickups").alias("n_pickups"),
        F.sum("n_units").alias("n_units"),
        ratio(F.sum("n_units"), F.sum("n_pickups")).alias("units_per_pickup"),
    )


def carried_by_partner(order_master: DataFrame, items: DataFrame, bridge: DataFrame) -> DataFrame:
    """Rows ``inventory_transfer_id, partner, n_units``: units of each partner's orders in
    every transfer that carries any."""
    orders = order_master.select("order_id", partner_label().alias("partner"))
    item = items.select(F.col("id").alias("order_item_id"), "order_id")
    return (
        bridge.select("inventory_transfer_id", "order_item_id")
        .join(item, "order_item_id")
        .join(orders, "order_id")
        .groupBy("inventory_transfer_id", "partner")
        .agg(F.count(F.lit(1)).alias("n_units"))
    )


def carried_by_location(transfers: DataFrame, units: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows ``inventory_transfer_id, location, n_units``: units of each transfer under the stock
    location it was picked up at."""
    place = locations.select(
        F.col("id").alias("inventory_location_id"), F.col("name").alias("location")
    )
    return (
        transfers.select(F.col("id").alias("inventory_transfer_id"), "inventory_location_id")
        .join(place, "inventory_location_id")
        .join(units, "inventory_transfer_id")
        .select("inventory_transfer_id", "location", "n_units")
    )


def rates_within(events: DataFrame, carried: DataFrame, entity: str) -> DataFrame:
    """PED and UPP of each ``entity`` (a column of ``carried``: one row per transfer and
    entity, with its units) at all levels of time and place.

    A transfer that an expert's events name more than once on a day is one pickup. Pickups are
    reduced to expert days and then to days before the levels expand them.
    """
    place = ["event_date", "market", "center_market", entity]
    pickups = with_units(events, carried).groupBy(
        *place, "expert_id", "inventory_transfer_id", "n_units"
    ).agg(F.lit(1).alias("once"))
    daily = (
        pickups.groupBy(*place, "expert_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_units").alias("units"))
        .groupBy(*place)
        .agg(
            F.sum("n").alias("n_pickups"),
            F.count(F.lit(1)).alias("n_expert_days"),
            F.sum("units").alias("n_units"),
        )
    )
    return over_levels(
        daily,
        F.sum("n_pickups").alias("n_pickups"),
        F.sum("n_expert_days").alias("n_expert_days"),
        F.sum("n_units").alias("n_units"),
        ratio(F.sum("n_pickups"), F.sum("n_expert_days")).alias("ped"),
        ratio(F.sum("n_units"), F.sum("n_pickups")).alias("units_per_pickup"),
        within=(entity,),
    )


def daily_bitmaps(events: DataFrame, ids: str = "expert_id") -> DataFrame:
    """Rows ``event_date, market, center_market, bucket, ids``: the distinct ids of a day.

    Every 32,768 neighbouring ids share a bitmap of 4 KiB, and a bucket without an id has
    no row, so a day's size follows its ids. Null ids are not counted.
    """
    place = ["event_date", "market", "center_market"]
    return (
        events.where(F.col(ids).isNotNull())
        .groupBy(*place, F.bitmap_bucket_number(ids).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(ids)).alias("ids"))
    )


def distinct_levels(bitmaps: DataFrame, name: str = "n_distinct") -> DataFrame:
    """Distinct ids at all levels, from ``daily_bitmaps`` (which may be stored by day)."""
    merged = over_levels(bitmaps, F.bitmap_or_agg("ids").alias("ids"), within=("bucket",))
    return merged.groupBy("time_level", "period_start", "place_level", "place").agg(
        F.sum(F.bitmap_count("ids")).alias(name)
    )
