"""Travel time of visits and pickups, and what share of shifts it takes.

A visit's total travel is its own trip plus its part of the trip to each pickup
that served it. Items are counted per (order, transfer) before any fact is
joined, so an order with many items in one transfer travels as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldkpi.functions.joins import join_same
from fieldkpi.functions.labels import (
    PVT_EVENTS,
    TRAVEL_EVENT,
    full_name,
    ratio,
)
from fieldkpi.functions.times import (
    DEFAULT_SINCE,
    Day,
    could_be_after,
    could_be_between,
    could_be_near_shifts,
    day,
    hours_between,
    local_date,
    minutes_between,
    near_shift,
)
from fieldkpi.operators.located import at_home, by_day_and_market, scheduled_events

# Short names of the four metrics: visit trip, pickup trip, pickup trip per
# visit, total.
TRAVEL_METRICS = ("vtt", "ptt", "pttpv", "ttt")

# Roles of a trip.
VISIT_LEG, PICKUP_LEG = "visit", "pickup"


def order_transfers(
    items: DataFrame, bridge: DataFrame, skus: Sequence[str] | None = None
) -> DataFrame:
    """Rows ``order_id, inventory_transfer_id, n_items``."""
    if skus is not None:
        items = items.where(F.col("sku").isin(list(skus)))
    return (
        bridge.select("inventory_transfer_id", "order_item_id")
        .join(items.select(F.col("id").alias("order_item_id"), "order_id"), "order_item_id")
        .groupBy("order_id", "inventory_transfer_id")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


def visits_per_transfer(visits: DataFrame, served: DataFrame) -> DataFrame:
    """Visit rows behind each transfer, one per visit and item.

    Visits are counted per order first, so an order with very many visits is
    one row in the join.
    """
    per_order = visits.groupBy("order_id").agg(F.count("id").alias("n"))
    return (
        served.join(per_order, "order_id")
        .groupBy("inventory_transfer_id")
        .agg(F.sum(F.col("n") * F.col("n_items")).alias("n_visits"))
    )


def _shared_out(visits: DataFrame, served: DataFrame, pickup_trips: DataFrame) -> DataFrame:
    """Pickup trips with the part that falls to one visit."""
    return (
        visits_per_transfer(visits, served)
        .join(pickup_trips, "inventory_transfer_id")
        .select(
            "inventory_transfer_id",
            "pickup_expert_id",
            "pickup_start",
            "ptt",
            ratio("ptt", "n_visits").alias("pttpv"),
        )
    )


def pickup_travel(
    visits: DataFrame,
    served: DataFrame,
    transfers: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
) -> DataFrame:
    """Trip of each transfer and the part of it that falls to one visit."""
    return _shared_out(visits, served, _pickup_trips(trip_base(None, transfers, blocks, sched)))


def trip_base(
    visits: DataFrame | None,
    transfers: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
    *keep: str,
) -> DataFrame:
    """Every scheduled trip of a visit and of a transfer, tagged with its ``role``.

    Visits and transfers are one set of tagged legs that meets blocks and schedules once.
    Equal rows become one with its number of ``copies``. The role is an aggregate, so a
    filter on it stays above, and the plan below is the same for all uses: Spark runs it
    once and reads its exchange again. Without visits it holds the trips to pickups alone.
    """
    empty = F.lit(None).cast("bigint")
    legs = transfers.select(
        F.lit(PICKUP_LEG).alias("leg"),
        empty.alias("visit_id"),
        empty.alias("order_id"),
        empty.alias("expert_id"),
        F.col("id").cast("bigint").alias("inventory_transfer_id"),
        "travel_time_id",
        *(F.lit(None).cast(visits.schema[k].dataType).alias(k) for k in keep),
    )
    if visits is not None:
        legs = legs.unionByName(
            visits.select(
                F.lit(VISIT_LEG).alias("leg"),
                F.col("id").cast("bigint").alias("visit_id"),
                F.col("order_id").cast("bigint").alias("order_id"),
                F.col("expert_id").cast("bigint").alias("expert_id"),
                empty.alias("inventory_transfer_id"),
                "travel_time_id",
                *keep,
            )
        )
    trips = scheduled_events(blocks, sched, TRAVEL_EVENT).select(
        F.col("event_id").alias("travel_time_id"),
        F.col("expert_id").alias("trip_expert_id"),
        "start_time",
        minutes_between("start_time", "end_time").alias("minutes"),
    )
    joined = legs.join(trips, "travel_time_id")
    return joined.groupBy(*joined.columns).agg(
        F.max("leg").alias("role"), F.count(F.lit(1)).alias("copies")
    )


def _of_role(base: DataFrame, role: str, **columns: str) -> DataFrame:
    """The rows of one role, each as often as it stood, with ``columns`` (new name, old name).

    The columns depend on the role, so that what Spark infers of them (a join key is not
    null) also stays above the aggregate.
    """
    this = F.col("role") == role
    rows = base.where(this).select(
        *(F.when(this, F.col(old)).alias(new) for new, old in columns.items()), "copies"
    )
    often = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return rows.select(*columns, often).drop("copy")


def _pickup_trips(base: DataFrame) -> DataFrame:
    return _of_role(
        base,
        PICKUP_LEG,
        inventory_transfer_id="inventory_transfer_id",
        pickup_expert_id="trip_expert_id",
        pickup_start="start_time",
        ptt="minutes",
    )


def _visit_and_pickup_trips(
    visits: DataFrame,
    transfers: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
    *keep: str,
    between: tuple[Day, Day] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Trips of visits and of transfers. Without a window both come out of one base; a
    window bounds the visits' trips at the scan, which pickups on any day may not share."""
    if between is not None:
        own = visit_trips(visits, blocks, sched, *keep, between=between)
        return own, _pickup_trips(trip_base(None, transfers, blocks, sched))
    base = trip_base(visits, transfers, blocks, sched, *keep)
    same = ("visit_id", "order_id", "expert_id", "trip_expert_id", "start_time", *keep)
    own = _of_role(base, VISIT_LEG, **{k: k for k in same}, vtt="minutes")
    return own, _pickup_trips(base)


def visit_trips(
    visits: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
    *keep: str,
    since: Day | None = None,
    between: tuple[Day, Day] | None = None,
) -> DataFrame:
    """The trip of each visit, with the expert of the visit and of the block."""
    trips = scheduled_events(blocks, sched, TRAVEL_EVENT, since=since, between=between).select(
        F.col("event_id").alias("travel_time_id"),
        F.col("expert_id").alias("trip_expert_id"),
        "start_time",
        minutes_between("start_time", "end_time").alias("vtt"),
    )
    return visits.select(
        F.col("id").alias("visit_id"), "order_id", "expert_id", "travel_time_id", *keep
    ).join(trips, "travel_time_id")


def visit_travel_rows(
    visits: DataFrame,
    items: DataFrame,
    bridge: DataFrame,
    transfers: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    skus: Sequence[str] | None = None,
    zones: DataFrame | None = None,
    addresses: DataFrame | None = None,
    market: str | None = None,
    since: Day | None = None,
    between: tuple[Day, Day] | None = None,
) -> DataFrame:
    """One row per visit and distinct trips: ``visit_id, visit_date, market[, zone]`` and
    the four metrics in minutes.

    ``skus`` limits the visits to orders with such an item. The shared pickup
    trip is still divided among all its visits. ``zones`` (zip, zone) with
    ``addresses`` (address_id, zip) adds the zone of the meeting address. ``between`` keeps
    visits of these local days and reaches the scan of their trips; a pickup may lie on any day.
    """
    served = order_transfers(items, bridge)
    wanted = served if skus is None else order_transfers(items, bridge, skus)
    # Equal trips of an order are one row before they meet its visits. The test on the count
    # keeps the column alive, so that both uses of the bridge are one plan and one shuffle.
    rows, to_pickup = _visit_and_pickup_trips(
        visits, transfers, blocks, sched, *_address_column(zones), between=between
    )
    pickups = (
        wanted.where(F.col("n_items") > 0)
        .join(
            _shared_out(visits, served, to_pickup).select("inventory_transfer_id", "ptt", "pttpv"),
            "inventory_transfer_id",
        )
        .select("order_id", "ptt", "pttpv")
        .distinct()
    )
    keys = ["visit_id", "visit_date", "market"]
    if zones is not None:
        address = addresses.select(F.col("address_id").alias("meeting_address_id"), "zip")
        rows = rows.join(address, "meeting_address_id").join(zones.select("zip", "zone"), "zip")
        keys.append("zone")
    rows = (
        at_home(rows, experts, centers)
        .withColumn("visit_date", local_date("start_time", "time_zone"))
        .join(pickups, "order_id")
    )
    if market is not None:
        rows = rows.where(F.col("market") == market)
    if since is not None:
        rows = rows.where(F.col("visit_date") > day(since))
    if between is not None:
        rows = rows.where(F.col("visit_date").between(*map(day, between)))
    return rows.groupBy(*keys, "ptt", "vtt", "pttpv").agg(
        F.min(F.col("vtt") + F.col("pttpv")).alias("ttt")
    )


def apportioned_travel(
    visits: DataFrame,
    items: DataFrame,
    bridge: DataFrame,
    transfers: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
    by_market: bool = True,
) -> DataFrame:
    """Smallest total travel of each visit on each local day.

    The smallest sum is the smallest own trip plus the smallest pickup part, so
    each side is reduced before they meet and no product of the two is formed.
    """
    served = order_transfers(items, bridge)
    trips, to_pickup = _visit_and_pickup_trips(visits, transfers, blocks, sched)
    pickups = _shared_out(visits, served, to_pickup)
    keys = ["visit_id", "visit_date"] + (["market"] if by_market else [])
    # The test on the count keeps both uses of the bridge one plan, as above.
    part_of_order = (
        served.where(F.col("n_items") > 0)
        .join(pickups.select("inventory_transfer_id", "pttpv"), "inventory_transfer_id")
        .groupBy("order_id")
        .agg(F.min("pttpv").alias("pickup_part"))
    )
    own = (
        at_home(trips, experts, centers)
        .withColumn("visit_date", local_date("start_time", "time_zone"))
        .where(F.col("visit_date") > day(since))
        .groupBy("order_id", *keys)
        .agg(F.min("vtt").alias("own_trip"))
    )
    return (
        own.join(part_of_order, "order_id")
        .groupBy(*keys)
        .agg(F.min(F.col("own_trip") + F.col("pickup_part")).alias("total_travel_time"))
    )


def total_travel(per_visit: DataFrame) -> DataFrame:
    return by_day_and_market(
        per_visit, F.avg("total_travel_time").alias("avg_total_travel_time"), date="visit_date"
    )


def total_travel_by_date(per_visit: DataFrame) -> DataFrame:
    """Mean per day; give visits reduced without the market (``by_market=False``)."""
    return (
        per_visit.groupBy("visit_date")
        .agg(F.avg("total_travel_time").alias("avg_total_travel_time"))
        .orderBy("visit_date")
    )


def shift_event_minutes(
    sched: DataFrame,
    blocks: DataFrame,
    event_types: Sequence[str],
    shifts: DataFrame,
    first: Day | None = None,
    last: Day | None = None,
) -> DataFrame:
    """Minutes of the given events in each shift and expert.

    Only schedules of ``shifts`` (shift_id, start_time, one row each) meet the blocks, and a
    block counts only if it starts within ``SHIFT_MARGIN_DAYS`` of the shift's start. So the
    local days of the shifts, ``first`` to ``last``, bound the scan of the blocks too. The
    sum comes before the shifts' own columns; a null sum (no usable block) stays null.
    """
    events = blocks.where(
        F.col("enabled")
        & F.col("event_type").isin(list(event_types))
        & could_be_near_shifts("start_time", first, last)
    ).select(
        F.col("id").alias("calendar_block_id"),
        F.col("start_time").alias("block_start"),
        minutes_between("start_time", "end_time").alias("minutes"),
    )
    return (
        sched.select("calendar_block_id", "shift_id", "expert_id")
        .join(shifts.select("shift_id", F.col("start_time").alias("shift_start")), "shift_id")
        .join(events, "calendar_block_id")
        .where(near_shift("block_start", "shift_start"))
        .groupBy("shift_id", "expert_id")
        .agg(F.sum("minutes").alias("event_minutes"))
    )


def travel_share_of_shift(
    shifts: DataFrame,
    sched: DataFrame,
    blocks: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
    until: Day | None = None,
) -> DataFrame:
    """Mean over shifts of travel as a percentage of the shift; local shift days after
    ``since``, up to ``until`` if given."""
    near = could_be_after("start_time", since)
    in_time = F.col("shift_date") > day(since)
    if until is not None:
        near &= could_be_between("start_time", since, until)
        in_time &= F.col("shift_date") <= day(until)
    open_shifts = shifts.where(F.col("enabled") & near).select(
        F.col("id").alias("shift_id"),
        "start_time",
        minutes_between("start_time", "end_time").alias("shift_minutes"),
    )
    minutes = shift_event_minutes(sched, blocks, [TRAVEL_EVENT], open_shifts, since, until)
    shares = (
        at_home(minutes.join(open_shifts, "shift_id"), experts, centers)
        .withColumn("shift_date", local_date("start_time", "time_zone"))
        .where(in_time)
        .groupBy("shift_id", "shift_date", "market", "shift_minutes")
        .agg(F.sum("event_minutes").alias("event_minutes"))
    )
    return by_day_and_market(
        shares,
        (F.avg(ratio("event_minutes", "shift_minutes")) * 100.0).alias(
            "average_shift_travel_percent"
        ),
        date="shift_date",
    )


def utilization_pvt(
    shifts: DataFrame,
    sched: DataFrame,
    blocks: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    first: Day,
    as_of: Day,
) -> DataFrame:
    """Pickup, visit and travel minutes against shift minutes, by UTC shift day."""
    shift_date = F.to_date("start_time")
    open_shifts = shifts.where(
        F.col("enabled")
        & could_be_between("start_time", first, as_of)
        & shift_date.between(day(first), day(as_of))
    ).select(
        F.col("id").alias("shift_id"),
        "start_time",
        shift_date.alias("shift_date"),
        minutes_between("start_time", "end_time").alias("shift_minutes"),
    )
    minutes = shift_event_minutes(sched, blocks, PVT_EVENTS, open_shifts, first, as_of)
    per_shift = (
        at_home(minutes.join(open_shifts, "shift_id"), experts, centers)
        .groupBy("shift_id", "shift_date", "market", "shift_minutes")
        .agg(F.sum("event_minutes").alias("pvt"))
    )
    totals = per_shift.groupBy("shift_date", "market").agg(
        F.sum("pvt").alias("total_pvt"), F.sum("shift_minutes").alias("total_shift_time")
    )
    return totals.withColumn(
        "utilization_percent", ratio("total_pvt", "total_shift_time") * 100.0
    ).orderBy("shift_date", "market")


def pickup_travel_hours(blocks: DataFrame, sched: DataFrame, transfers: DataFrame) -> DataFrame:
    """Rows ``expert_id, hours`` of every trip to a pickup."""
    trips = scheduled_events(blocks, sched, TRAVEL_EVENT).select(
        F.col("event_id").alias("travel_time_id"),
        "expert_id",
        hours_between("start_time", "end_time").alias("hours"),
    )
    return trips.join(transfers.select("travel_time_id"), "travel_time_id").select(
        "expert_id", "hours"
    )


def travel_hours_by_market(trips: DataFrame, experts: DataFrame) -> DataFrame:
    house = experts.select("expert_id", F.col("current_enjoyment_house_name").alias("market"))
    return (
        trips.join(house, "expert_id")
        .groupBy("market")
        .agg(F.round(F.avg("hours"), 2).alias("avg_travel_time"))
    )


def travel_hours_by_expert(trips: DataFrame, experts: DataFrame) -> DataFrame:
    name = experts.select(
        "expert_id", full_name("expert_first_name", "expert_last_name").alias("expert")
    )
    rates = trips.groupBy("expert_id").agg(F.round(F.avg("hours"), 2).alias("avg_travel_time"))
    return rates.join(name, "expert_id").select("expert_id", "expert", "avg_travel_time")


def travel_hours_overall(trips: DataFrame) -> DataFrame:
    return trips.agg(F.round(F.avg("hours"), 2).alias("avg_travel_time"))


def travel_metrics(
    visits: DataFrame,
    items: DataFrame,
    bridge: DataFrame,
    transfers: DataFrame,
    blocks: DataFrame,
    sched: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
    partner_orders: DataFrame | None = None,
    spread: bool = False,
    between: tuple[Day, Day] | None = None,
) -> DataFrame:
    """Mean visit, pickup, pickup-per-visit and total travel by local day and market.

    Visit and pickup trips are placed by the expert of the trip, totals by the
    expert of the visit. A visit trip counts once per item, as in a plain join.
    ``partner_orders`` (order_id) limits the visits; ``spread`` adds the sample
    deviation and range of pickup trips; ``between`` keeps these local days, and reaches the
    scan of the visits' trips.
    """
    if partner_orders is not None:
        visits = visits.join(partner_orders.select("order_id").dropDuplicates(), "order_id")
    served = order_transfers(items, bridge)
    trips, to_pickup = _visit_and_pickup_trips(visits, transfers, blocks, sched, between=between)
    pickups = _shared_out(visits, served, to_pickup)
    keys = ["visit_date", "market"]
    in_time = F.col("visit_date") > day(since)
    if between is not None:
        in_time &= F.col("visit_date").between(*map(day, between))

    # What an order's visits need of its transfers: their items, and the least pickup part.
    known = transfers.select(F.col("id").alias("inventory_transfer_id"))
    least_part = pickups.groupBy("inventory_transfer_id").agg(F.min("pttpv").alias("pttpv"))
    of_order = (
        served.join(known, "inventory_transfer_id")
        .join(least_part, "inventory_transfer_id", "left")
        .groupBy("order_id")
        .agg(
            F.sum("n_items").alias("n_rows"),
            F.min("pttpv").alias("pickup_part"),
            F.count("pttpv").alias("n_parts"),
        )
    )
    # Each trip twice, tagged: placed by its own expert, and by the expert of the visit.
    placing = F.array(
        F.struct(F.lit(True).alias("as_trip"), F.col("trip_expert_id").alias("placed_by")),
        F.struct(F.lit(False).alias("as_trip"), F.col("expert_id").alias("placed_by")),
    )
    tagged = trips.join(of_order, "order_id").select(
        "visit_id", "start_time", "vtt", "n_rows", "pickup_part", "n_parts", F.inline(placing)
    )
    as_trip = F.col("as_trip")
    per_visit = (
        at_home(tagged, experts, centers, "placed_by")
        .withColumn("visit_date", local_date("start_time", "time_zone"))
        .where(in_time & (as_trip | (F.col("n_parts") > 0)))
        .groupBy(*keys, "visit_id", "as_trip")
        .agg(
            F.sum(F.when(as_trip, F.col("vtt") * F.col("n_rows"))).alias("minutes"),
            F.sum(F.when(as_trip & F.col("vtt").isNotNull(), F.col("n_rows"))).alias("n_rows"),
            F.min(F.when(~as_trip, F.col("vtt") + F.col("pickup_part"))).alias("total"),
        )
    )
    visits_of_day = (
        per_visit.groupBy(*keys)
        .agg(
            F.avg("total").alias("avg_total_travel_time"),
            ratio(F.sum("minutes"), F.sum("n_rows")).alias("visit_travel_time"),
            F.bool_or(as_trip).alias("has_trips"),
            F.bool_or(~as_trip).alias("has_totals"),
        )
        .where("has_trips AND has_totals")
        .drop("has_trips", "has_totals")
    )

    measures = [
        F.avg("ptt").alias("pickup_travel_time"),
        F.avg("pttpv").alias("pickup_travel_time_per_visit"),
    ]
    if spread:
        measures += [
            F.stddev_samp("ptt").alias("std_pickup_travel_time"),
            F.max("ptt").alias("max_pickup_travel_time"),
            F.min("ptt").alias("min_pickup_travel_time"),
        ]
    pickup_means = (
        at_home(pickups, experts, centers, "pickup_expert_id")
        .withColumn("visit_date", local_date("pickup_start", "time_zone"))
        .where(in_time)
        .groupBy(*keys)
        .agg(*measures)
    )
    return visits_of_day.join(pickup_means, keys)


def travel_metrics_spread(*tables: DataFrame, **options) -> DataFrame:
    """``travel_metrics`` with the spread of pickup trips."""
    return travel_metrics(*tables, spread=True, **options)


def travel_stats(rows: DataFrame, *keys: str | Column, with_min: bool = True) -> DataFrame:
    """Range, mean and sample deviation of the four metrics in one aggregation."""
    stats = {"min": F.min, "max": F.max, "avg": F.avg, "std": F.stddev_samp}
    if not with_min:
        del stats["min"]
    return rows.groupBy(*keys).agg(
        *(fn(m).alias(f"{stat}_{m}") for m in TRAVEL_METRICS for stat, fn in stats.items())
    )


def travel_stats_by_period(
    rows: DataFrame, change_date: Day, first: Day, last: Day
) -> DataFrame:
    """``travel_stats`` with before/after the change in the market label."""
    period = F.when(F.col("visit_date") < day(change_date), "before").otherwise("after")
    return travel_stats(
        rows.where(F.col("visit_date").between(day(first), day(last))),
        F.concat_ws("-", F.col("market"), period).alias("market"),
    ).orderBy("market")


def travel_samples(rows: DataFrame, *keys: str) -> DataFrame:
    """Every observation as a long row ``keys, metric, value``.

    This is the sample set of a day or zone without building arrays.
    """
    return rows.unpivot(list(keys), list(TRAVEL_METRICS), "metric", "value")


def sample_arrays(rows: DataFrame, *keys: str, parts: int = 1) -> DataFrame:
    """Samples as arrays, ``keys, part, vtt, ptt, pttpv, ttt``: ``parts`` rows for each group.

    The caller says into how many parts every group is dealt, so the shape of the result
    does not depend on the data. One array per group suits groups that fit a task;
    ``travel_samples`` has no such bound.
    """
    if parts < 1:
        raise ValueError(f"parts must be positive, not {parts}")
    deal = F.pmod(F.xxhash64("visit_id", *TRAVEL_METRICS), F.lit(parts)).cast("int")
    return (
        rows.withColumn("part", deal)
        .groupBy(*keys, "part")
        .agg(*(F.collect_list(m).alias(m) for m in TRAVEL_METRICS))
    )


def chunked_arrays(
    rows: DataFrame,
    *keys: str,
    length: int,
    order: str = "visit_id",
    together: int = 50_000,
) -> DataFrame:
    """Samples as arrays of ``length`` rows, the last of a group shorter.

    Rows ``keys, chunk, n, vtt, ptt, pttpv, ttt`` with ``sum_`` and ``count_`` of each metric
    beside its array, so that means need no array. A group's rows stand in the order of
    ``order`` (a number), then of their values; a row's place follows from the sizes of the
    ranges of ``order`` before its own. A range is as wide as about ``together`` rows of
    the group would fill evenly, and only one range is ordered in a task.
    """
    if length < 1:
        raise ValueError(f"length must be positive, not {length}")
    keys = list(keys)
    spans = rows.groupBy(*keys).agg(
        F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    width = F.greatest(
        F.ceil((F.col("_hi") - F.col("_lo") + 1) * F.lit(float(together)) / F.col("_n")), F.lit(1)
    )
    # A row without a number stands first, in a range of its own.
    of_range = F.coalesce(F.floor((F.col(order) - F.col("_lo")) / width), F.lit(-1))
    dealt = join_same(rows, spans, keys).select(
        *keys, order, *TRAVEL_METRICS, of_range.alias("_range")
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        dealt.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order, *TRAVEL_METRICS)
    placed = join_same(
        dealt.withColumn("_place", F.row_number().over(inside) - 1), starts, [*keys, "_range"]
    ).withColumn("_at", F.col("_first") + F.col("_place"))

    def ordered(metric: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct("_at", metric)))
        return F.transform(pairs, lambda p: p[metric]).alias(metric)

    return (
        placed.groupBy(*keys, F.floor(F.col("_at") / length).cast("int").alias("chunk"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(ordered(m) for m in TRAVEL_METRICS),
            *(F.sum(m).alias(f"sum_{m}") for m in TRAVEL_METRICS),
            *(F.count(m).alias(f"count_{m}") for m in TRAVEL_METRICS),
        )
    )


def chunk_means(chunks: DataFrame, *keys: str) -> DataFrame:
    """Mean of each metric over all chunks of a group, from the sums beside the arrays."""
    return chunks.groupBy(*keys).agg(
        *(ratio(F.sum(f"sum_{m}"), F.sum(f"count_{m}")).alias(m) for m in TRAVEL_METRICS)
    )


def array_means(arrays: DataFrame, *keys: str) -> DataFrame:
    """Mean of each array column, over all parts of a group."""
    totals = []
    for m in TRAVEL_METRICS:
        total = F.aggregate(m, F.lit(0.0), lambda acc, v: acc + v)
        totals.append(ratio(F.sum(total), F.sum(F.size(m))).alias(m))
    return arrays.groupBy(*keys).agg(*totals)


def explode_arrays(arrays: DataFrame, *keys: str) -> DataFrame:
    """Arrays of all days run together, as long rows ``keys, metric, value``."""
    return arrays.unpivot(list(keys), list(TRAVEL_METRICS), "metric", "samples").select(
        *keys, "metric", F.explode("samples").alias("value")
    )


def _address_column(zones: DataFrame | None) -> list[str]:
    return [] if zones is None else ["meeting_address_id"]
