"""Labels, flags and ratios shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event types, statuses and the partner rule of the source data.
PICKUP_EVENT = "InventoryTransfer"
TRAVEL_EVENT = "TravelTime"
PVT_EVENTS = ("InventoryTransfer", "TravelTime", "Visit")
DECK_PVT_EVENTS = ("Pickup", "Visit", "TravelTime", "Relay", "Reservation", "InventoryTransfer")
DECK_PICKUP_EVENTS = ("Pickup", "InventoryTransfer")
TIME_OFF_EVENTS = ("PaidTimeOff", "paid_time_off")
CANCELED = "canceled"
CART_PARTNER = "ATT.com (Cart)"
OTHER_PARTNER = "Other"
CART_CHANNEL = "Integration"
CART_PARTNER_ID = 1


def market_label(center_id: str = "id", market: str = "market") -> Column:
    """``4-LA`` style label; a null market leaves just the id."""
    return F.concat_ws("-", F.col(center_id).cast("string"), F.col(market))


def full_name(first: str, last: str) -> Column:
    return F.concat_ws(" ", F.col(first), F.col(last))


def is_cart_partner(channel: str = "partner_channel", partner_id: str = "partner_id") -> Column:
    return (F.col(channel) == CART_CHANNEL) & (F.col(partner_id) == CART_PARTNER_ID)


def partner_label() -> Column:
    return F.when(is_cart_partner(), CART_PARTNER).otherwise(OTHER_PARTNER)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Floating-point division that is null, not an error, on a zero denominator."""
    return F.try_divide(_double(part), _double(whole))


def percent(part: Column | str, whole: Column | str) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def grouped_number(text: str) -> Column:
    """Whole number written with thousands commas, as in ``12,345``."""
    return F.replace(F.col(text), F.lit(","), F.lit("")).cast("bigint")


def _double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")
