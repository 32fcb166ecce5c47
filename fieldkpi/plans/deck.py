"""The daily metrics deck: staffing, hours, visits, bookings, travel and pickups.

Every part is reduced to day and house (or day and market) before the parts are
joined, so the joins see a few rows per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.joins import held_on_day
from fieldkpi.functions.labels import (
    CANCELED,
    DECK_PICKUP_EVENTS,
    DECK_PVT_EVENTS,
    TIME_OFF_EVENTS,
    is_cart_partner,
)
from fieldkpi.functions.times import (
    DECK_START,
    DEFAULT_SINCE,
    Day,
    could_be_between,
    could_be_near_shifts,
    day,
    headquarters_date,
    hours_between,
    local_date,
    near_shift,
    shift_day,
)

# Badge names, test experts, the days looked ahead and the number
# of one-hour shift classes.
OPUS_BADGE = "OPUS Ability"
SONOS_BADGE = "Sonos Ability"
TEST_EXPERTS = (113, 139, 355)
DAYS_AHEAD = 7
SHIFT_CLASSES = 15

HOUSE_DAY = ["start_date_local", "current_enjoyment_house_name"]


def _within(date: Column, start: Day, as_of: Day) -> Column:
    return date.between(day(start), day(shift_day(as_of, DAYS_AHEAD)))


def _at_house(shifts: DataFrame, experts: DataFrame, centers: DataFrame) -> DataFrame:
    """Shifts of experts proper, on the local day of the current house (``home_date``)."""
    field = experts.where(F.col("expert_type") == "Expert").select(
        "expert_id", "current_enjoyment_house_id", "current_enjoyment_house_name"
    )
    zone = centers.select(
        F.col("id").alias("current_enjoyment_house_id"), F.col("time_zone").alias("home_zone")
    )
    return (
        shifts.join(field, "expert_id")
        .join(zone, "current_enjoyment_house_id")
        .withColumn("home_date", local_date("start_time", "home_zone"))
    )


def _dated_shifts(
    shifts: DataFrame, experts: DataFrame, centers: DataFrame, start: Day, as_of: Day
) -> DataFrame:
    near = shifts.where(could_be_between("start_time", start, shift_day(as_of, DAYS_AHEAD)))
    return _at_house(near, experts, centers).where(_within(F.col("home_date"), start, as_of))


def roster_days(
    shifts: DataFrame,
    experts: DataFrame,
    profile_changes: DataFrame,
    centers: DataFrame,
    as_of: Day,
    start: Day = DECK_START,
    test_experts: Sequence[int] = TEST_EXPERTS,
) -> DataFrame:
    """Distinct day, house, market and expert, by the house that held on the day."""
    house = centers.select(
        F.col("id").alias("enjoyment_center_id"),
        F.col("name").alias("house"),
        "market",
        "time_zone",
    )
    dated = (
        _dated_shifts(shifts, experts, centers, start, as_of)
        .where(~F.col("expert_id").isin(list(test_experts)))
        .withColumn("on_day", headquarters_date("start_time"))
    )
    # The headquarters' day is at most a day off the local one.
    days = (shift_day(start, -1), shift_day(as_of, DAYS_AHEAD + 1))
    return (
        held_on_day(
            dated,
            profile_changes.select(
                "expert_id", "enjoyment_center_id", "effective_start_date", "effective_end_date"
            ),
            "expert_id",
            "on_day",
            "effective_start_date",
            "effective_end_date",
            *days,
        )
        .join(house, "enjoyment_center_id")
        .select(
            local_date("start_time", "time_zone").alias("start_date_local"),
            F.col("house").alias("current_enjoyment_house_name"),
            "market",
            "expert_id",
        )
        .dropDuplicates()
    )


def skilled_headcount(
    roster: DataFrame, expert_badges: DataFrame, badges: DataFrame
) -> DataFrame:
    """Experts on shift, and those who held each badge by that day."""
    badge = badges.select(F.col("id").alias("badge_id"), "name").where(
        F.col("name").isin(OPUS_BADGE, SONOS_BADGE)
    )
    held = (
        expert_badges.join(badge, "badge_id")
        .groupBy(F.col("expert_id").alias("badge_expert_id"))
        .agg(
            *(
                F.min(
                    F.when(F.col("name") == name, headquarters_date("date_added"))
                ).alias(f"{short}_since")
                for short, name in (("opus", OPUS_BADGE), ("sonos", SONOS_BADGE))
            )
        )
    )
    on_day = F.col("start_date_local")
    return (
        roster.join(held, F.col("expert_id") == F.col("badge_expert_id"), "left")
        .groupBy(*HOUSE_DAY, "market")
        .agg(
            F.count("expert_id").alias("experts_shift"),
            F.count_if(F.col("opus_since") <= on_day).alias("experts_opus"),
            F.count_if(F.col("sonos_since") <= on_day).alias("experts_sonos"),
        )
    )


def planned_headcount(
    fiscal_dates: DataFrame, planned: DataFrame, as_of: Day, start: Day = DECK_START
) -> DataFrame:
    """Planned experts of every house on every calendar day.

    The days of the range are a scalar array (one entry per day at most), so each
    house row is expanded in place rather than paired in a cross join.
    """
    days = (
        fiscal_dates.where(_within(F.col("fiscal_date"), start, as_of))
        .agg(F.collect_list("fiscal_date").alias("days"))
        .scalar()
    )
    return planned.select(
        F.explode(days).alias("start_date_local"),
        F.col("ec_name").alias("current_enjoyment_house_name"),
        "experts_lms",
    )


def used_hours(
    shifts: DataFrame,
    sched: DataFrame,
    blocks: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    as_of: Day,
    start: Day = DECK_START,
) -> DataFrame:
    """Hours of enabled blocks by kind, summed per shift before shifts are joined.

    A block counts if it starts near its shift (``near_shift``), so the deck's days bound
    the scan of the blocks.
    """
    hours = F.col("hours")
    kind = F.col("event_type")
    kinds = {
        "used_hours": hours,
        "used_hours_pvt": F.when(kind.isin(*DECK_PVT_EVENTS), hours),
        "used_hours_nvb": F.when(~kind.isin(*DECK_PVT_EVENTS), hours),
        "used_hours_pto": F.when(kind.isin(*TIME_OFF_EVENTS), hours),
        "pickup_duration": F.when(kind.isin(*DECK_PICKUP_EVENTS), hours),
    }
    last = shift_day(as_of, DAYS_AHEAD)
    block = blocks.where(
        F.col("enabled") & could_be_near_shifts("start_time", start, last)
    ).select(
        F.col("id").alias("calendar_block_id"),
        "event_type",
        F.col("start_time").alias("block_start"),
        hours_between("start_time", "end_time").alias("hours"),
    )
    dated = _dated_shifts(shifts, experts, centers, start, as_of).select(
        F.col("id").alias("shift_id"),
        F.col("home_date").alias("start_date_local"),
        F.col("start_time").alias("shift_start"),
        "current_enjoyment_house_name",
    )
    # Only schedules of the wanted shifts meet the blocks.
    per_shift = (
        sched.select("calendar_block_id", "shift_id")
        .join(dated.select("shift_id", "shift_start"), "shift_id")
        .join(block, "calendar_block_id")
        .where(near_shift("block_start", "shift_start"))
        .groupBy("shift_id")
        .agg(*(F.sum(c).alias(name) for name, c in kinds.items()))
    )
    return (
        dated.join(per_shift, "shift_id")
        .groupBy(*HOUSE_DAY)
        .agg(*(F.sum(name).alias(name) for name in kinds))
    )


def shift_length_histogram(
    shifts: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    roster: DataFrame,
    as_of: Day,
    start: Day = DECK_START,
) -> DataFrame:
    """Shifts by length in whole hours, the last class open, and their total hours.

    Only shifts of experts who are on the roster of their current house that day.
    """
    utc_date = F.to_date("start_time")
    near = could_be_between("start_time", start, shift_day(as_of, DAYS_AHEAD))
    enabled = shifts.where(F.col("enabled") & near & _within(utc_date, start, as_of))
    dated = _at_house(enabled, experts, centers).select(
        "expert_id",
        "current_enjoyment_house_name",
        F.col("home_date").alias("start_date_local"),
        hours_between("start_time", "end_time").alias("hours"),
    )
    hours = F.col("hours")
    classes = []
    for h in range(SHIFT_CLASSES):
        inside = hours >= h if h == SHIFT_CLASSES - 1 else (hours >= h) & (hours < h + 1)
        classes.append(F.count_if(inside).alias(f"shift_{h:02d}_hour"))
    return (
        dated.join(
            roster.select(*HOUSE_DAY, "expert_id"), [*HOUSE_DAY, "expert_id"]
        )
        .groupBy(*HOUSE_DAY)
        .agg(*classes, F.sum("hours").alias("shift_hours"))
    )


def visit_counts(order_master: DataFrame, as_of: Day, start: Day = DECK_START) -> DataFrame:
    """Visits of live orders, and the cart partner's part."""
    visits = order_master.where(
        (F.col("order_status") != CANCELED) & _within(F.col("visit_date_local"), start, as_of)
    )
    return visits.groupBy(
        F.col("visit_date_local").alias("start_date_local"),
        F.col("visit_eh").alias("current_enjoyment_house_name"),
    ).agg(
        F.count("visit_id").alias("visits"),
        F.count(F.when(is_cart_partner(), F.col("visit_id"))).alias("visits_att_cart"),
    )


def booking_counts(order_master: DataFrame, as_of: Day, start: Day = DECK_START) -> DataFrame:
    """Orders booked and canceled by Pacific day of creation."""
    orders = order_master.where(_within(F.col("order_created_date_pt"), start, as_of))
    return orders.groupBy(
        F.col("order_created_date_pt").alias("start_date_local"),
        F.col("visit_eh").alias("current_enjoyment_house_name"),
    ).agg(
        F.count("order_id").alias("booked_orders"),
        F.count(F.when(F.col("order_status") == CANCELED, F.col("order_id"))).alias(
            "cancelations"
        ),
    )


def travel_avgs(travel_times: DataFrame, as_of: Day, start: Day = DECK_START) -> DataFrame:
    rows = travel_times.where(_within(F.col("visit_date_local_tt"), start, as_of))
    return rows.groupBy(
        F.col("mkt_tt").alias("market"), F.col("visit_date_local_tt").alias("start_date_local")
    ).agg(
        F.avg("visit_travel_duration_minutes").alias("avg_visit_tt"),
        F.avg("pickup_visit_travel_duration_minutes").alias("avg_pickup_tt"),
    )


def pickup_totals(
    events: DataFrame, units: DataFrame, as_of: Day, start: Day = DEFAULT_SINCE
) -> DataFrame:
    """Units and pickups per day and market, up to the day before ``as_of``."""
    rows = events.where(F.col("event_date").between(day(start), day(shift_day(as_of, -1))))
    return (
        rows.withColumnRenamed("event_id", "inventory_transfer_id")
        .join(units, "inventory_transfer_id")
        .groupBy(
            F.col("event_date").alias("start_date_local"), F.col("center_market").alias("market")
        )
        .agg(
            F.sum("n_units").alias("num_units_in_pickup"),
            F.count("n_units").alias("num_pickups"),
        )
    )


def metrics_deck(
    headcount: DataFrame,
    planned: DataFrame,
    hours: DataFrame,
    shift_lengths: DataFrame,
    visits: DataFrame,
    bookings: DataFrame,
    travel: DataFrame,
    pickups: DataFrame,
    centers: DataFrame,
    fiscal_dates: DataFrame,
) -> DataFrame:
    """One row per day and house with 38 columns.

    Travel and pickups exist per market; they repeat for each of its houses.
    """
    fiscal = fiscal_dates.select(
        F.col("fiscal_date").alias("start_date_local"),
        "fiscal_week_end_date",
        "fiscal_week_offset",
        "fiscal_day_offset",
    )
    center = centers.select(
        F.col("name").alias("current_enjoyment_house_name"),
        F.concat(F.col("id").cast("string"), F.lit("-"), F.col("market")).alias("house_label"),
    )
    joined = (
        headcount.join(planned, HOUSE_DAY)
        .join(hours, HOUSE_DAY)
        .join(shift_lengths, HOUSE_DAY)
        .join(visits, HOUSE_DAY, "left")
        .join(bookings, HOUSE_DAY, "left")
        .join(travel, ["market", "start_date_local"], "left")
        .join(pickups, ["market", "start_date_local"], "left")
        .join(center, "current_enjoyment_house_name")
        .join(fiscal, "start_date_local")
    )
    counts = ("visits", "visits_att_cart", "booked_orders", "cancelations")
    filled = {c: F.coalesce(c, F.lit(0)) for c in counts}
    columns = [
        "experts_lms",
        "experts_shift",
        "experts_opus",
        "used_hours",
        "shift_hours",
        "visits",
        "used_hours_pvt",
        "used_hours_nvb",
        "experts_sonos",
        *(f"shift_{h:02d}_hour" for h in range(SHIFT_CLASSES)),
        "fiscal_week_end_date",
        "visits_att_cart",
        "booked_orders",
        "cancelations",
        "used_hours_pto",
        "fiscal_week_offset",
        "fiscal_day_offset",
        "avg_visit_tt",
        "avg_pickup_tt",
        "pickup_duration",
        "num_pickups",
        "num_units_in_pickup",
    ]
    return (
        joined.withColumns(filled)
        .select(
            "start_date_local",
            F.col("house_label").alias("current_enjoyment_house_name"),
            *columns,
        )
        .orderBy("start_date_local", "current_enjoyment_house_name")
    )
