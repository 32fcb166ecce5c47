"""Pickup rates seen by location, product, week, region and expert.

All are means of means: average per expert first, then over experts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.labels import full_name


def expert_daily_counts(pickups: DataFrame) -> DataFrame:
    """Pickups of each expert on each (UTC) creation day."""
    return (
        pickups.select("expert_id", F.to_date("created_at").alias("pickup_date"))
        .groupBy("expert_id", "pickup_date")
        .agg(F.count("pickup_date").alias("n_pickups"))
    )


def expert_ped(pickups: DataFrame) -> DataFrame:
    return expert_daily_counts(pickups).groupBy("expert_id").agg(F.avg("n_pickups").alias("ped"))


def ped_by_location(locations: DataFrame, transfers: DataFrame) -> DataFrame:
    """Rate at each stock location; a location without transfers has rate 0."""
    daily = transfers.groupBy(
        F.col("inventory_location_id").alias("id"),
        "expert_id",
        F.to_date("created_at").alias("pickup_date"),
    ).agg(F.count("id").alias("n"))
    return (
        locations.select("id", F.col("name").alias("location"))
        .join(daily, "id", "left")
        .groupBy("location", "expert_id", "pickup_date")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pickups"))
        .groupBy("location", "expert_id")
        .agg(F.avg("n_pickups").alias("ped"))
        .groupBy("location")
        .agg(F.round(F.avg("ped"), 2).alias("ped"))
        .orderBy("location")
    )


def ped_by_sku(
    transfers: DataFrame, bridge: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """Mean daily pickups of each product."""
    item = items.select(F.col("id").alias("order_item_id"), "sku")
    transfer = transfers.select(
        F.col("id").alias("inventory_transfer_id"),
        "expert_id",
        F.to_date("created_at").alias("pickup_date"),
    )
    rates = (
        bridge.select("inventory_transfer_id", "order_item_id")
        .join(item, "order_item_id")
        .join(transfer, "inventory_transfer_id")
        .groupBy("pickup_date", "expert_id", "sku")
        .agg(F.count(F.lit(1)).alias("n_pickups"))
        .groupBy("expert_id", "sku")
        .agg(F.avg("n_pickups").alias("daily"))
        .groupBy("sku")
        .agg(F.round(F.avg("daily"), 2).alias("avg_daily_pickups"))
    )
    return rates.join(products.select("sku", "description"), "sku").select(
        "sku", "description", "avg_daily_pickups"
    )


def ped_by_week(transfers: DataFrame, fiscal_dates: DataFrame, experts: DataFrame) -> DataFrame:
    """Mean pickups of each expert per fiscal week; weeks of different years differ."""
    week = fiscal_dates.select(
        F.col("fiscal_date").alias("pickup_date"), "fiscal_week_end_date"
    )
    rates = (
        expert_daily_counts(transfers)
        .join(week, "pickup_date")
        .groupBy("fiscal_week_end_date", "expert_id")
        .agg(F.sum("n_pickups").alias("weekly"))
        .groupBy("expert_id")
        .agg(F.round(F.avg("weekly"), 2).alias("avg_weekly_pickups"))
    )
    return _named(rates, experts, "avg_weekly_pickups")


def ped_by_region(pickups: DataFrame, experts: DataFrame) -> DataFrame:
    """Rate by the expert's current house; unknown experts form the null group."""
    house = experts.select("expert_id", F.col("current_enjoyment_house_name").alias("market"))
    return (
        expert_ped(pickups)
        .join(house, "expert_id", "left")
        .groupBy("market")
        .agg(F.round(F.avg("ped"), 2).alias("ped"))
        .orderBy("market")
    )


def ped_by_expert(pickups: DataFrame, experts: DataFrame) -> DataFrame:
    rates = expert_ped(pickups).withColumn("ped", F.round("ped", 2))
    return _named(rates, experts, "ped")


def ped_overall(pickups: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """One row; with ``roster`` (column ``id``) only experts listed there count."""
    rates = expert_ped(pickups)
    if roster is not None:
        rates = rates.join(roster.select(F.col("id").alias("expert_id")), "expert_id")
    return rates.agg(F.round(F.avg("ped"), 2).alias("avg_ped"))


def entity_counts(pickups: DataFrame, roster: DataFrame, employees: DataFrame) -> DataFrame:
    """Pickups of each expert with the employee behind the expert."""
    counts = pickups.groupBy("expert_id").agg(F.count("expert_id").alias("n_pickups"))
    expert = roster.select(F.col("id").alias("expert_id"), "employee_id")
    employee = employees.select(F.col("id").alias("employee_id"), "first_name", "last_name")
    return (
        counts.join(expert, "expert_id")
        .join(employee, "employee_id")
        .select("expert_id", "employee_id", "first_name", "last_name", "n_pickups")
    )


def daily_counts(rows: DataFrame, timestamp: str = "created_at") -> DataFrame:
    """Rows per day: the daily series behind trend models."""
    return (
        rows.select(F.to_date(timestamp).alias("day"))
        .groupBy("day")
        .agg(F.count("day").alias("n"))
        .orderBy("day")
    )


def adjustment_counts(adjustments: DataFrame) -> DataFrame:
    return adjustments.groupBy("transaction_number").agg(
        F.count("transaction_number").alias("n_adjustments")
    )


def _named(rates: DataFrame, experts: DataFrame, measure: str) -> DataFrame:
    name = experts.select(
        "expert_id", full_name("expert_first_name", "expert_last_name").alias("expert")
    )
    return rates.join(name, "expert_id").select("expert_id", "expert", measure)
