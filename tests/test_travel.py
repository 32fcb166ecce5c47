from __future__ import annotations

import pytest

from fieldkpi.operators import travel
from tests.frames import centers, experts, rows, table

LA = "4-LA"


@pytest.fixture(scope="module")
def trip_tables(spark):
    """Transfer 12 serves the orders of visits 1 and 2; visit 2 also draws on 13."""
    visits = table(
        spark,
        "visits",
        [(1, 31, 1, 501, 1, None, "done"), (2, 32, 1, 502, 2, None, "done"),
         (3, 33, 1, 503, 1, None, "done")],
    )
    items = table(
        spark, "items", [(21, 31, "A", 1), (22, 32, "A", 1), (23, 32, "B", 1), (24, 32, "B", 1)]
    )
    bridge = table(spark, "bridge", [(1, 12, 21), (2, 12, 22), (3, 12, 23), (4, 13, 24)])
    transfers = table(
        spark, "transfers", [(12, 1, 601, 1, 1, None), (13, 1, 602, 1, 1, None)]
    )
    blocks = table(
        spark,
        "blocks",
        [
            (1, 501, "TravelTime", "2016-10-01 18:00:00", "2016-10-01 18:10:00", True),
            (2, 502, "TravelTime", "2016-10-02 03:00:00", "2016-10-02 03:20:00", True),
            (3, 503, "TravelTime", "2016-10-01 18:00:00", "2016-10-01 18:10:00", True),
            (4, 601, "TravelTime", "2016-10-01 15:00:00", "2016-10-01 15:30:00", True),
            (5, 602, "TravelTime", "2016-10-01 15:00:00", "2016-10-01 15:04:00", True),
            # Ids that mean another table, and a disabled block.
            (6, 501, "InventoryTransfer", "2016-10-01 18:00:00", "2016-10-01 18:01:00", True),
            (7, 501, "TravelTime", "2016-10-01 18:00:00", "2016-10-01 18:01:00", False),
        ],
    )
    sched = table(spark, "sched", [(i, 900, 1) for i in range(1, 8)])
    return (visits, items, bridge, transfers, blocks, sched, experts(spark), centers(spark))


def test_pickup_trip_is_shared_by_visit_rows(trip_tables):
    visits, items, bridge, transfers, blocks, sched, *_ = trip_tables
    served = travel.order_transfers(items, bridge)
    assert rows(travel.visits_per_transfer(visits, served), "inventory_transfer_id", "n_visits") == [
        (12, 3),
        (13, 1),
    ]
    assert rows(
        travel.pickup_travel(visits, served, transfers, blocks, sched), "inventory_transfer_id", "ptt", "pttpv"
    ) == [(12, 30.0, 10.0), (13, 4.0, 4.0)]


def test_rows_and_smallest_total(trip_tables):
    found = travel.visit_travel_rows(*trip_tables)
    # Visit 2 is on the local day before its UTC day and has two pickups.
    assert rows(found, "visit_id", "visit_date", "market", "ptt", "vtt", "pttpv", "ttt") == [
        (1, "2016-10-01", LA, 30.0, 10.0, 10.0, 20.0),
        (2, "2016-10-01", LA, 30.0, 20.0, 10.0, 30.0),
        (2, "2016-10-01", LA, 4.0, 20.0, 4.0, 24.0),
    ]
    per_visit = travel.apportioned_travel(*trip_tables)
    assert rows(per_visit, "visit_id", "total_travel_time") == [(1, 20.0), (2, 24.0)]
    assert rows(travel.total_travel(per_visit)) == [("2016-10-01", LA, 22.0)]
    by_day = travel.apportioned_travel(*trip_tables, by_market=False)
    assert rows(travel.total_travel_by_date(by_day)) == [("2016-10-01", 22.0)]
    for row in found.collect():
        assert row.ttt >= row.vtt


def test_sku_limits_visits_not_the_division(trip_tables):
    found = travel.visit_travel_rows(*trip_tables, skus=["B"])
    assert rows(found, "visit_id", "ptt", "pttpv") == [(2, 30.0, 10.0), (2, 4.0, 4.0)]


def test_zone_market_and_since(spark, trip_tables):
    zones = table(spark, "zip string, zone string", [("90001", "LA-A")])
    places = table(spark, "address_id bigint, zip string", [(1, "90001"), (2, "90002")])
    found = travel.visit_travel_rows(*trip_tables, zones=zones, addresses=places)
    assert rows(found, "visit_id", "zone") == [(1, "LA-A")]
    assert travel.visit_travel_rows(*trip_tables, market="2-NY").count() == 0
    assert travel.visit_travel_rows(*trip_tables, since="2016-10-01").count() == 0


def test_travel_metrics(spark, trip_tables):
    assert rows(travel.travel_metrics(*trip_tables)) == [
        # Visit trips count once per item: (10 + 3 * 20) / 4.
        ("2016-10-01", LA, 22.0, 17.5, 17.0, 7.0)
    ]
    spread = travel.travel_metrics_spread(*trip_tables)
    assert rows(
        spread, "max_pickup_travel_time", "min_pickup_travel_time"
    ) == [(30.0, 4.0)]
    one = table(spark, "order_id bigint", [(31,)])
    only = travel.travel_metrics(*trip_tables, partner_orders=one)
    assert rows(only, "pickup_travel_time_per_visit", "avg_total_travel_time") == [(30.0, 40.0)]


def test_stats_samples_and_arrays(trip_tables):
    found = travel.visit_travel_rows(*trip_tables)
    stats = travel.travel_stats(found, "visit_date", "market")
    assert rows(stats, "min_ttt", "max_ttt", "avg_ptt") == [(20.0, 30.0, 64 / 3)]
    assert "min_vtt" not in travel.travel_stats(found, "market", with_min=False).columns
    periods = travel.travel_stats_by_period(found, "2016-10-02", "2016-09-01", "2016-10-03")
    assert rows(periods, "market", "max_vtt") == [("4-LA-before", 20.0)]
    assert travel.travel_samples(found, "visit_date").count() == 12

    whole = travel.sample_arrays(found, "visit_date")
    assert [sorted(r.ptt) for r in whole.collect()] == [[4.0, 30.0, 30.0]]
    pieces = travel.sample_arrays(found, "visit_date", parts=3)
    assert sorted(v for r in pieces.collect() for v in r.ptt) == [4.0, 30.0, 30.0]
    # Three copies of every row: a larger group is still one row per part.
    tripled = found.union(found).union(found)
    assert travel.sample_arrays(tripled, "visit_date").count() == 1
    with pytest.raises(ValueError):
        travel.sample_arrays(found, "visit_date", parts=0)
    for arrays in (whole, pieces):
        assert rows(travel.array_means(arrays, "visit_date"), "ptt") == [(64 / 3,)]
        assert travel.explode_arrays(arrays, "visit_date").count() == 12


def test_single_sample_has_no_deviation(spark):
    schema = "market string, vtt double, ptt double, pttpv double, ttt double"
    one = table(spark, schema, [("a", 1.0, 1.0, 1.0, 2.0)])
    assert rows(travel.travel_stats(one, "market"), "std_vtt") == [(None,)]


def test_shift_shares(spark):
    shifts = table(
        spark,
        "shifts",
        [
            (900, 1, "2016-10-01 16:00:00", "2016-10-01 17:40:00", True),
            (901, 2, "2016-10-01 16:00:00", "2016-10-01 16:00:00", True),
            (902, 1, "2016-10-01 16:00:00", "2016-10-01 17:00:00", False),
        ],
    )
    blocks = table(
        spark,
        "blocks",
        [
            (1, 1, "TravelTime", "2016-10-01 16:00:00", "2016-10-01 16:10:00", True),
            (2, 1, "TravelTime", "2016-10-01 16:30:00", "2016-10-01 16:45:00", True),
            (3, 1, "Visit", "2016-10-01 17:00:00", "2016-10-01 17:30:00", True),
            (4, 1, "PaidTimeOff", "2016-10-01 17:00:00", "2016-10-01 17:30:00", True),
            (5, 1, "TravelTime", "2016-10-01 16:00:00", "2016-10-01 16:10:00", True),
            (6, 1, "TravelTime", "2016-10-01 16:00:00", "2016-10-01 16:10:00", True),
        ],
    )
    sched = table(
        spark, "sched", [(1, 900, 1), (2, 900, 1), (3, 900, 1), (4, 900, 1), (5, 901, 2), (6, 902, 1)]
    )
    place = (experts(spark), centers(spark))
    # The empty shift has no share and does not lower the mean.
    assert rows(travel.travel_share_of_shift(shifts, sched, blocks, *place)) == [
        ("2016-10-01", LA, 25.0)
    ]
    used = travel.utilization_pvt(
        shifts, sched, blocks, *place, first="2016-08-01", as_of="2016-10-01"
    )
    assert rows(used) == [("2016-10-01", LA, 65.0, 100.0, 65.0)]
    assert travel.utilization_pvt(
        shifts, sched, blocks, *place, first="2016-08-01", as_of="2016-09-30"
    ).count() == 0


def test_travel_hours(spark, trip_tables):
    _, _, _, transfers, blocks, sched, people, _ = trip_tables
    trips = travel.pickup_travel_hours(blocks, sched, transfers)
    assert rows(travel.travel_hours_overall(trips)) == [(0.28,)]
    assert rows(travel.travel_hours_by_market(trips, people)) == [("Los Angeles", 0.28)]
    assert rows(travel.travel_hours_by_expert(trips, people)) == [(1, "Ann Lee", 0.28)]


def test_base_keeps_repeated_rows(spark, trip_tables):
    """A visit scheduled twice counts twice in means of rows, as in plain joins."""
    visits, items, bridge, transfers, blocks, sched, *places = trip_tables
    twice = sched.union(sched.where("calendar_block_id IN (2, 4)"))
    base = travel.trip_base(visits, transfers, blocks, twice)
    assert sorted((r.role, r.copies) for r in base.collect()) == [
        ("pickup", 1), ("pickup", 2), ("visit", 1), ("visit", 1), ("visit", 2)
    ]
    found = travel.travel_metrics(visits, items, bridge, transfers, blocks, twice, *places)
    # Visit trips: (10 + 2 * 3 * 20) / 7 by items; pickups: 30, 30 and 4 minutes.
    assert rows(found, "visit_travel_time", "pickup_travel_time") == [(130 / 7, 64 / 3)]


def test_window_and_base_agree(trip_tables):
    wide = ("2016-09-30", "2016-10-05")
    assert rows(travel.travel_metrics(*trip_tables, between=wide)) == rows(
        travel.travel_metrics(*trip_tables)
    )
    assert rows(travel.visit_travel_rows(*trip_tables, between=wide)) == rows(
        travel.visit_travel_rows(*trip_tables)
    )


def test_blocks_far_from_their_shift_do_not_count(spark):
    shifts = table(
        spark,
        "shifts",
        [(900, 1, "2016-10-01 16:00:00", "2016-10-01 20:00:00", True),
         (901, 1, "2016-10-05 16:00:00", "2016-10-05 20:00:00", True)],
    )
    starts = [
        ("2016-09-29 16:00:00", 900), ("2016-09-29 15:59:59", 900), ("2016-10-03 16:00:00", 900),
        ("2016-10-03 16:00:01", 900), ("2016-10-05 17:00:00", 901), ("2016-10-05 17:00:00", 900),
    ]
    blocks = table(
        spark, "blocks", [(i, i, "TravelTime", at, at[:14] + "59:59", True) for i, (at, _) in enumerate(starts)]
    )
    sched = table(spark, "sched", [(i, shift, 1) for i, (_, shift) in enumerate(starts)])
    open_shifts = shifts.selectExpr("id AS shift_id", "start_time")
    for bounds in ((), ("2016-10-01", "2016-10-05")):
        found = travel.shift_event_minutes(sched, blocks, ["TravelTime"], open_shifts, *bounds)
        # On the margin's very end a block counts, a second beyond it does not.
        assert [(i, round(m, 2)) for i, m in rows(found, "shift_id", "event_minutes")] == [
            (900, 119.97), (901, 59.98)
        ]
    share = travel.travel_share_of_shift(
        shifts, sched, blocks, experts(spark), centers(spark), until="2016-10-01"
    )
    assert [r[0] for r in rows(share, "shift_date")] == ["2016-10-01"]


ROWS = "visit_id bigint, day string, vtt double, ptt double, pttpv double, ttt double"


@pytest.mark.parametrize("together", [1, 7, 10_000])
@pytest.mark.parametrize("length", [1, 4, 1000])
def test_chunks_number_rows_without_ordering_a_group(spark, together, length):
    values = [
        ((i * 37) % 101 if i % 9 else None, "ab"[i % 4 == 0], i / 4, i / 8 if i % 5 else None, 1.0, 2.0)
        for i in range(150)
    ] + [(5, None, 1.0, 2.0, 3.0, 4.0), (10**15, "a", 9.0, 9.0, 9.0, 9.0), (-(10**15), "b", 8.0, 8.0, 8.0, 8.0)]
    df = table(spark, ROWS, values).repartition(5)
    chunks = travel.chunked_arrays(df, "day", length=length, together=together).collect()
    first = lambda v: (v is not None, v or 0)
    for group in ("a", "b", None):
        own = sorted((v for v in values if v[1] == group), key=lambda v: (*first(v[0]), *map(first, v[2:])))
        mine = sorted((c for c in chunks if c.day == group), key=lambda c: c.chunk)
        assert [c.chunk for c in mine] == list(range(len(mine)))
        assert [c.n for c in mine] == [len(own[i : i + length]) for i in range(0, len(own), length)]
        assert [v for c in mine for v in c.vtt] == [v[2] for v in own]
        assert [v for c in mine for v in c.ptt] == [v[3] for v in own]
        for c in mine:
            assert c.sum_vtt == sum(c.vtt) and c.count_ptt == sum(v is not None for v in c.ptt)
    means = travel.chunk_means(travel.chunked_arrays(df, "day", length=length), "day")
    assert rows(means, "day", "ttt") == [("a", (2.0 * 112 + 9) / 113), ("b", (2.0 * 38 + 8) / 39), (None, 4.0)]


def test_chunks_reject_no_length_and_take_no_rows(spark):
    df = table(spark, ROWS, [])
    with pytest.raises(ValueError):
        travel.chunked_arrays(df, "day", length=0)
    assert travel.chunked_arrays(df, "day", length=3).count() == 0
