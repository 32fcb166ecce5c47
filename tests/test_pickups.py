from __future__ import annotations

import pytest

from fieldkpi.operators import ped_views, pickups, units
from fieldkpi.operators.located import at_home, located_events
from tests.frames import centers, experts, rows, table

LA, NY = "4-LA", "2-NY"


@pytest.fixture(scope="module")
def pickup_tables(spark):
    """Transfers 10 (no items), 11 (one), 12 (three); 13 is on a disabled block."""
    blocks = table(
        spark,
        "blocks",
        [
            # 03:00 UTC is the previous day in Los Angeles.
            (100, 10, "InventoryTransfer", "2016-10-02 03:00:00", "2016-10-02 03:30:00", True),
            (101, 11, "InventoryTransfer", "2016-10-01 18:00:00", "2016-10-01 18:20:00", True),
            (102, 12, "InventoryTransfer", "2016-10-01 19:00:00", "2016-10-01 20:00:00", True),
            (103, 13, "InventoryTransfer", "2016-10-01 19:00:00", "2016-10-01 20:00:00", False),
            # Same event id as transfer 11, another type.
            (104, 11, "TravelTime", "2016-10-01 17:00:00", "2016-10-01 17:10:00", True),
            # Local day 25 September is not after the start.
            (105, 12, "InventoryTransfer", "2016-09-26 05:00:00", "2016-09-26 06:00:00", True),
            (106, 12, "InventoryTransfer", None, None, True),
        ],
    )
    sched = table(
        spark,
        "sched",
        [(100, 1, 1), (101, 1, 1), (102, 1, 2), (103, 1, 2), (104, 1, 1), (105, 1, 2), (106, 1, 2)],
    )
    transfers = table(
        spark,
        "transfers",
        [
            (10, 1, 11, 1, 1, "2016-10-01 10:00:00"),
            (11, 1, 99, 1, 1, "2016-10-01 11:00:00"),
            (12, 3, 99, 2, 1, "2016-10-02 11:00:00"),
            (13, 2, 99, 2, 1, "2016-10-08 11:00:00"),
        ],
    )
    bridge = table(spark, "bridge", [(1, 11, 21), (2, 12, 22), (3, 12, 23), (4, 12, 24)])
    items = table(
        spark, "items", [(21, 31, "A", 1), (22, 31, "A", 1), (23, 32, "A", 1), (24, 32, "B", 1)]
    )
    return {
        "blocks": blocks,
        "sched": sched,
        "transfers": transfers,
        "bridge": bridge,
        "items": items,
        "events": located_events(
            blocks, sched, experts(spark), centers(spark), "InventoryTransfer"
        ),
        "units": pickups.units_per_transfer(transfers, bridge),
    }


def test_located_events(pickup_tables):
    assert rows(pickup_tables["events"], "event_id", "expert_id", "event_date", "market", "minutes") == [
        (10, 1, "2016-10-01", LA, 30.0),
        (11, 1, "2016-10-01", LA, 20.0),
        (12, 2, "2016-10-01", LA, 60.0),
    ]


def test_null_market_keeps_the_center_id(spark):
    found = at_home(table(spark, "expert_id bigint", [(4,)]), experts(spark), centers(spark))
    assert rows(found, "market") == [("3",)]


def test_ped_and_its_check(pickup_tables):
    assert rows(pickups.ped(pickup_tables["events"])) == [("2016-10-01", LA, 1.5)]
    # The transfers name experts 1 and 3: two experts, three pickups.
    checked = pickups.ped_check(pickup_tables["events"], pickup_tables["transfers"])
    assert rows(checked) == [("2016-10-01", LA, 2, 3, 1.5, 1.5)]


def test_zero_unit_pickups(pickup_tables):
    events, per_transfer = pickup_tables["events"], pickup_tables["units"]
    assert rows(per_transfer) == [(10, 0), (11, 1), (12, 3), (13, 0)]
    assert rows(pickups.upp(events, per_transfer)) == [("2016-10-01", LA, 4 / 3, 3)]
    assert rows(pickups.pickup_duration_per_unit(events, per_transfer)) == [
        ("2016-10-01", LA, 20.0)
    ]
    assert rows(pickups.pickup_units_histogram(per_transfer)) == [(0, 2), (1, 1), (3, 1)]
    mix = pickups.pickup_class_mix(events, per_transfer)
    assert rows(mix, "n_zero_pickups", "n_single_pickups", "n_bulk_pickups", "total_pickups") == [
        (1, 1, 1, 3)
    ]
    shares = rows(
        mix, "percent_zero_pickups", "percent_single_pickups", "percent_bulk_pickups"
    )[0]
    assert abs(sum(shares) - 100) < 1e-9
    components = pickups.ped_upp_components(
        events, pickup_tables["transfers"], pickup_tables["bridge"]
    )
    assert rows(components) == [("2016-10-01", LA, 2, 2, 4)]


def test_travel_to_pickup_matches_the_trip_not_the_transfer(spark, pickup_tables):
    trips = located_events(
        pickup_tables["blocks"], pickup_tables["sched"], experts(spark), centers(spark),
        "TravelTime",
    )
    assert rows(pickups.travel_to_pickup(trips, pickup_tables["transfers"])) == [
        ("2016-10-01", LA, 10.0)
    ]
    assert rows(pickups.pickup_duration(pickup_tables["events"])) == [
        ("2016-10-01", LA, (30 + 20 + 60) / 3)
    ]


def test_partner_counts_distinct_transfers(spark, pickup_tables):
    orders = table(
        spark,
        "order_id bigint, order_status string, partner_channel string, partner_id int",
        [(31, "complete", "Integration", 1), (32, "canceled", "Integration", 1)],
    )
    events, transfers = pickup_tables["events"], pickup_tables["transfers"]
    carried = pickups.partner_units(orders, pickup_tables["items"], pickup_tables["bridge"])
    assert rows(carried) == [(11, 1), (12, 3)]
    assert rows(pickups.partner_ped(events, transfers, carried)) == [("2016-10-01", LA, 1.0)]
    live = pickups.partner_units(
        orders, pickup_tables["items"], pickup_tables["bridge"], exclude_canceled=True
    )
    assert rows(pickups.partner_upp(events, transfers, live)) == [("2016-10-01", LA, 1.0)]
    assert rows(pickups.partner_components(events, transfers, carried)) == [
        ("2016-10-01", LA, 2, 2, 4)
    ]
    others = pickups.partner_units(
        orders, pickup_tables["items"], pickup_tables["bridge"], partner="Other"
    )
    assert rows(others) == []


def test_rates_are_means_of_means(spark):
    made = table(
        spark,
        "transfers",
        [(i, 1, 1, 1, 1, "2016-10-01 01:00:00") for i in range(4)]
        + [(9, 1, 1, 1, 1, "2016-10-02 01:00:00"), (8, 3, 1, 1, 1, "2016-10-01 23:00:00")],
    )
    people = experts(spark)
    assert rows(ped_views.expert_ped(made)) == [(1, 2.5), (3, 1.0)]
    assert rows(ped_views.ped_overall(made)) == [(1.75,)]
    assert rows(ped_views.ped_by_region(made, people)) == [
        ("Los Angeles", 2.5),
        ("New York", 1.0),
    ]
    assert rows(ped_views.ped_by_expert(made, people)) == [(1, "Ann Lee", 2.5), (3, "Cy Ray", 1.0)]
    roster = table(spark, "id bigint, employee_id bigint", [(3, 30)])
    assert rows(ped_views.ped_overall(made, roster)) == [(1.0,)]
    staff = table(spark, "id bigint, first_name string, last_name string", [(30, "Cy", "Ray")])
    assert rows(ped_views.entity_counts(made, roster, staff)) == [(3, 30, "Cy", "Ray", 1)]
    assert rows(ped_views.daily_counts(made)) == [("2016-10-01", 5), ("2016-10-02", 1)]


def test_unknown_expert_forms_the_null_region(spark):
    made = table(spark, "transfers", [(1, 77, 1, 1, 1, "2016-10-01 01:00:00")])
    assert rows(ped_views.ped_by_region(made, experts(spark))) == [(None, 1.0)]


def test_location_without_transfers_has_rate_zero(spark, pickup_tables):
    places = table(spark, "id bigint, name string", [(1, "North"), (2, "South"), (3, "Empty")])
    assert rows(ped_views.ped_by_location(places, pickup_tables["transfers"])) == [
        ("Empty", 0.0),
        ("North", 2.0),
        ("South", 1.0),
    ]


def test_weeks_of_two_years_stay_apart(spark):
    made = table(
        spark,
        "transfers",
        [(1, 1, 1, 1, 1, "2016-10-05 01:00:00"), (2, 1, 1, 1, 1, "2017-10-04 01:00:00")],
    )
    weeks = table(
        spark,
        "fiscal_date date, fiscal_week_in_year int, fiscal_week_end_date date",
        [("2016-10-05", 40, "2016-10-08"), ("2017-10-04", 40, "2017-10-07")],
    )
    assert rows(ped_views.ped_by_week(made, weeks, experts(spark))) == [(1, "Ann Lee", 1.0)]


def test_products(spark, pickup_tables):
    t = pickup_tables
    products = table(spark, "sku string, description string", [("A", "lamp"), ("B", "cable")])
    assert rows(ped_views.ped_by_sku(t["transfers"], t["bridge"], t["items"], products)) == [
        ("A", "lamp", 1.5),
        ("B", "cable", 1.0),
    ]
    assert rows(units.upp_by_product(t["items"], t["bridge"], t["transfers"], products)) == [
        ("A", "lamp", 1.5),
        ("B", "cable", 1.0),
    ]


def test_units_per_pickup(spark, pickup_tables):
    t = pickup_tables
    args = (t["items"], t["bridge"], t["transfers"])
    assert rows(units.upp_overall(*args)) == [(2.0,)]
    assert rows(units.upp_by_expert(*args, experts(spark))) == [
        (1, "Ann Lee", 1.0),
        (3, "Cy Ray", 3.0),
    ]
    assert rows(units.upp_by_market_home(*args, experts(spark))) == [
        ("Los Angeles", 1.0),
        ("New York", 3.0),
    ]
    places = table(spark, "id bigint, address_id bigint, zip string", [(1, 1, "00001")])
    zips = table(spark, "zip string, coverage_area_id bigint", [("00001", 7)])
    areas = table(spark, "id bigint, enjoyment_center_id bigint", [(7, 2)])
    assert rows(units.upp_by_market_geo(*args, places, zips, areas, centers(spark))) == [
        ("NY", 2.0)
    ]


def test_adjustments(spark):
    df = table(spark, "transaction_number bigint", [(1,), (1,), (2,), (None,)])
    assert rows(ped_views.adjustment_counts(df)) == [(1, 2), (2, 1), (None, 0)]
