"""Pickups per expert per day, units per pickup and pickup durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.labels import CANCELED, CART_PARTNER, partner_label, percent, ratio
from fieldkpi.operators.located import by_day_and_market


def units_per_transfer(transfers: DataFrame, bridge: DataFrame) -> DataFrame:
    """Units of every transfer, zero for one with no items.

    The bridge is counted before the join, so a transfer with very many items
    costs one partial count per task.
    """
    units = bridge.groupBy("inventory_transfer_id").agg(F.count("id").alias("n_units"))
    return (
        transfers.select(F.col("id").alias("inventory_transfer_id"))
        .join(units, "inventory_transfer_id", "left")
        .select("inventory_transfer_id", F.coalesce("n_units", F.lit(0)).alias("n_units"))
    )


def partner_units(
    order_master: DataFrame,
    items: DataFrame,
    bridge: DataFrame,
    partner: str = CART_PARTNER,
    exclude_canceled: bool = False,
) -> DataFrame:
    """Units of one partner's orders in every transfer that carries any."""
    orders = order_master.where(partner_label() == partner)
    if exclude_canceled:
        orders = orders.where(F.col("order_status") != CANCELED)
    item = items.select(F.col("id").alias("order_item_id"), "order_id")
    return (
        bridge.select("id", "inventory_transfer_id", "order_item_id")
        .join(item.join(orders.select("order_id"), "order_id"), "order_item_id")
        .groupBy("inventory_transfer_id")
        .agg(F.count("id").alias("n_units"))
    )


def with_units(events: DataFrame, units: DataFrame) -> DataFrame:
    """Pickup events with the units of their transfer."""
    return events.withColumnRenamed("event_id", "inventory_transfer_id").join(
        units, "inventory_transfer_id"
    )


def ped(events: DataFrame) -> DataFrame:
    """Mean over experts of pickups on the day."""
    per_expert = events.groupBy("event_date", "market", "expert_id").agg(
        F.count(F.lit(1)).alias("n_pickups")
    )
    return by_day_and_market(per_expert, F.avg("n_pickups").alias("ped"))


def ped_check(events: DataFrame, transfers: DataFrame) -> DataFrame:
    """PED beside its parts, with the expert named on the transfer as second view.

    One pass: the mean of per-expert counts is all pickups over distinct experts.
    """
    transfer = transfers.select(
        F.col("id").alias("event_id"), F.col("expert_id").alias("transfer_expert_id"),
        F.col("id").alias("transfer_id"),
    )
    parts = (
        events.join(transfer, "event_id", "left")
        .groupBy("event_date", "market")
        .agg(
            F.count_distinct("transfer_expert_id").alias("n_experts"),
            F.count("transfer_id").alias("n_pickups"),
            ratio(F.count(F.lit(1)), F.count_distinct("expert_id")).alias("ped"),
        )
    )
    return (
        parts.where(F.col("n_pickups") > 0)
        .withColumn("div", ratio("n_pickups", "n_experts"))
        .orderBy("event_date", "market")
    )


def pickup_components(events: DataFrame, units: DataFrame) -> DataFrame:
    """Pickups, experts and units, from which PED and UPP both follow.

    ``units`` holds only transfers that carry items: all of them, or a partner's.
    """
    pickups = (
        with_units(events, units)
        .groupBy("inventory_transfer_id", "expert_id", "event_date", "market")
        .agg(F.sum("n_units").alias("n_units"))
    )
    per_expert = pickups.groupBy("event_date", "market", "expert_id").agg(
        F.count("inventory_transfer_id").alias("n_pickups"),
        F.sum("n_units").alias("n_units"),
    )
    return by_day_and_market(
        per_expert,
        F.sum("n_pickups").alias("n_pickups"),
        F.count("expert_id").alias("n_experts"),
        F.sum("n_units").alias("total_units"),
    )


def ped_upp_components(events: DataFrame, transfers: DataFrame, bridge: DataFrame) -> DataFrame:
    carried = units_per_transfer(transfers, bridge).where(F.col("n_units") > 0)
    return pickup_components(events, carried)


def partner_ped(events: DataFrame, transfers: DataFrame, units: DataFrame) -> DataFrame:
    """PED over the distinct transfers that carry one partner's items."""
    carried = units.join(
        transfers.select(F.col("id").alias("inventory_transfer_id")), "inventory_transfer_id"
    )
    per_expert = (
        with_units(events, carried)
        .groupBy("event_date", "market", "expert_id")
        .agg(F.count_distinct("inventory_transfer_id").alias("n_pickups"))
    )
    return by_day_and_market(per_expert, F.avg("n_pickups").alias("ped"))


def partner_upp(events: DataFrame, transfers: DataFrame, units: DataFrame) -> DataFrame:
    """Mean units of one partner per transfer; give units without canceled orders."""
    carried = units.join(
        transfers.select(F.col("id").alias("inventory_transfer_id")), "inventory_transfer_id"
    )
    pickups = (
        with_units(events, carried)
        .groupBy("inventory_transfer_id", "event_date", "market")
        .agg(F.sum("n_units").alias("n_units"))
    )
    return by_day_and_market(pickups, F.avg("n_units").alias("units_per_pickup"))


def partner_components(events: DataFrame, transfers: DataFrame, units: DataFrame) -> DataFrame:
    carried = units.join(
        transfers.select(F.col("id").alias("inventory_transfer_id")), "inventory_transfer_id"
    )
    return pickup_components(events, carried)


def upp(events: DataFrame, units: DataFrame) -> DataFrame:
    """Mean units per pickup and pickups of the day, zero-unit pickups included."""
    return by_day_and_market(
        with_units(events, units),
        F.avg("n_units").alias("units_per_pickup"),
        F.count("n_units").alias("pickups_per_day"),
    )


def travel_to_pickup(travel_events: DataFrame, transfers: DataFrame) -> DataFrame:
    """Mean minutes travelled to a pickup."""
    trips = travel_events.join(
        transfers.select(F.col("travel_time_id").alias("event_id")), "event_id"
    )
    return by_day_and_market(trips, F.avg("minutes").alias("travel_minutes"))


def pickup_duration(events: DataFrame) -> DataFrame:
    """Mean minutes spent on a pickup."""
    return by_day_and_market(events, F.avg("minutes").alias("pickup_duration"))


def pickup_duration_per_unit(events: DataFrame, units: DataFrame) -> DataFrame:
    """Mean over pickups of minutes per unit; pickups without units have none."""
    carried = with_units(events, units.where(F.col("n_units") != 0))
    return by_day_and_market(
        carried,
        F.avg(ratio("minutes", "n_units")).alias("avg_pickup_duration_per_unit"),
    )


def pickup_units_histogram(units: DataFrame) -> DataFrame:
    """Number of pickups for every number of units."""
    return (
        units.groupBy(F.col("n_units").alias("n_items"))
        .agg(F.count(F.lit(1)).alias("n_pickups"))
        .orderBy("n_items")
    )


def pickup_class_mix(events: DataFrame, units: DataFrame) -> DataFrame:
    """Counts and shares of pickups with no, one and several units."""
    classes = {
        "zero": F.col("n_units") < 1,
        "single": F.col("n_units") == 1,
        "bulk": F.col("n_units") > 1,
    }
    counts = (
        with_units(events, units)
        .groupBy(F.col("event_date").alias("pickup_date"), "market")
        .agg(
            *(F.count_if(test).alias(f"n_{name}_pickups") for name, test in classes.items()),
            F.count("n_units").alias("total_pickups"),
        )
    )
    return counts.select(
        "*",
        *(
            percent(f"n_{name}_pickups", "total_pickups").alias(f"percent_{name}_pickups")
            for name in classes
        ),
    ).orderBy("pickup_date", "market")
