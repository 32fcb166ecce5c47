"""Units per pickup by expert, product and market.

A pickup here counts only items that exist, so a transfer without any is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.labels import full_name


def items_per_transfer(items: DataFrame, bridge: DataFrame) -> DataFrame:
    """Items of each transfer, matched on the item id."""
    return (
        bridge.select("inventory_transfer_id", "order_item_id")
        .join(items.select(F.col("id").alias("order_item_id")), "order_item_id")
        .groupBy("inventory_transfer_id")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


def _pickups(items: DataFrame, bridge: DataFrame, transfers: DataFrame, *keep: str) -> DataFrame:
    transfer = transfers.select(F.col("id").alias("inventory_transfer_id"), *keep)
    return items_per_transfer(items, bridge).join(transfer, "inventory_transfer_id")


def upp_by_expert(
    items: DataFrame, bridge: DataFrame, transfers: DataFrame, experts: DataFrame
) -> DataFrame:
    rates = (
        _pickups(items, bridge, transfers, "expert_id")
        .groupBy("expert_id")
        .agg(F.round(F.avg("n_items"), 2).alias("avg_units_per_pickup"))
    )
    name = experts.select(
        "expert_id", full_name("expert_first_name", "expert_last_name").alias("expert")
    )
    return rates.join(name, "expert_id").select("expert_id", "expert", "avg_units_per_pickup")


def upp_by_product(
    items: DataFrame, bridge: DataFrame, transfers: DataFrame, products: DataFrame
) -> DataFrame:
    """Mean number of one product in the pickups that carry it."""
    item = items.select(F.col("id").alias("order_item_id"), "sku")
    known = transfers.select(F.col("id").alias("inventory_transfer_id"))
    rates = (
        bridge.select("inventory_transfer_id", "order_item_id")
        .join(item, "order_item_id")
        .groupBy("inventory_transfer_id", "sku")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(known, "inventory_transfer_id")
        .groupBy("sku")
        .agg(F.round(F.avg("n"), 2).alias("avg_num_per_pickup"))
    )
    return rates.join(products.select("sku", "description"), "sku").select(
        "sku", "description", "avg_num_per_pickup"
    )


def upp_by_market_geo(
    items: DataFrame,
    bridge: DataFrame,
    transfers: DataFrame,
    addresses: DataFrame,
    zip_codes: DataFrame,
    coverage_areas: DataFrame,
    centers: DataFrame,
) -> DataFrame:
    """Market of the meeting address: address, zip, coverage area, center."""
    address = addresses.select(F.col("id").alias("meeting_address_id"), "zip")
    area = coverage_areas.select(F.col("id").alias("coverage_area_id"), "enjoyment_center_id")
    center = centers.select(F.col("id").alias("enjoyment_center_id"), "market")
    return (
        _pickups(items, bridge, transfers, "meeting_address_id")
        .join(address, "meeting_address_id")
        .join(zip_codes.select("zip", "coverage_area_id"), "zip")
        .join(area, "coverage_area_id")
        .join(center, "enjoyment_center_id")
        .groupBy("inventory_transfer_id", "market")
        .agg(F.sum("n_items").alias("n_items"))
        .groupBy("market")
        .agg(F.round(F.avg("n_items"), 2).alias("units_per_pickup"))
    )


def upp_by_market_home(
    items: DataFrame, bridge: DataFrame, transfers: DataFrame, experts: DataFrame
) -> DataFrame:
    """Market of the expert's home house."""
    home = experts.select("expert_id", F.col("home_enjoyment_house_name").alias("market"))
    return (
        _pickups(items, bridge, transfers, "expert_id")
        .join(home, "expert_id")
        .groupBy("market")
        .agg(F.avg("n_items").alias("avg_units_per_pickups"))
    )


def upp_overall(items: DataFrame, bridge: DataFrame, transfers: DataFrame) -> DataFrame:
    return _pickups(items, bridge, transfers).agg(
        F.round(F.avg("n_items"), 2).alias("avg_units_per_pickup")
    )
