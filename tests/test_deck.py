from __future__ import annotations

import datetime as dt

import pytest

from fieldkpi.functions.joins import held_on_day
from fieldkpi.plans import deck
from tests.frames import centers, experts, rows, table

AS_OF = "2016-10-10"
CHANGES = (
    "expert_id bigint, enjoyment_center_id bigint, effective_start_date date,"
    " effective_end_date date"
)


@pytest.fixture(scope="module")
def shift_rows(spark):
    return table(
        spark,
        "shifts",
        [
            # Exactly one hour, fourteen hours, and a long one in New York.
            (900, 1, "2016-10-01 16:00:00", "2016-10-01 17:00:00", True),
            (901, 1, "2016-10-02 16:00:00", "2016-10-03 06:00:00", True),
            (902, 3, "2016-10-01 16:00:00", "2016-10-01 16:30:00", True),
            (903, 2, "2016-10-01 16:00:00", "2016-10-01 17:00:00", False),
            (904, 4, "2016-10-01 16:00:00", "2016-10-01 17:00:00", True),
            (905, 1, "2016-12-01 16:00:00", "2016-12-01 17:00:00", True),
        ],
    )


@pytest.fixture(scope="module")
def roster(spark, shift_rows):
    # Expert 1 moves to New York on the second; the day before belongs to the old house.
    changes = table(
        spark,
        CHANGES,
        [
            (1, 4, "2016-01-01", "2016-10-01"),
            (1, 2, "2016-10-02", "2099-01-01"),
            (2, 4, "2016-01-01", "2099-01-01"),
            (3, 2, "2016-01-01", "2016-10-01"),
            (3, 2, "2016-10-01", "2099-01-01"),
            (4, 3, "2016-01-01", "2099-01-01"),
        ],
    )
    return deck.roster_days(
        shift_rows, experts(spark), changes, centers(spark), as_of=AS_OF, test_experts=[2]
    )


def test_roster_follows_the_house_of_the_day(roster):
    assert rows(roster) == [
        ("2016-10-01", "Los Angeles", "LA", 1),
        # Two spells meet on the day: still one row.
        ("2016-10-01", "New York", "NY", 3),
        ("2016-10-02", "New York", "NY", 1),
    ]


def test_skills_count_from_the_day_of_the_badge(spark, roster):
    badges = table(
        spark, "id bigint, name string", [(1, deck.OPUS_BADGE), (2, deck.SONOS_BADGE), (3, "Other")]
    )
    held = table(
        spark,
        "expert_id bigint, badge_id bigint, date_added timestamp_ntz",
        [
            # 03:00 UTC on the second is the first in Los Angeles.
            (1, 1, "2016-10-02 03:00:00"),
            (1, 1, "2016-10-05 03:00:00"),
            (1, 2, "2016-10-02 08:00:00"),
            (3, 3, "2016-01-01 00:00:00"),
        ],
    )
    found = deck.skilled_headcount(roster, held, badges)
    assert rows(found) == [
        ("2016-10-01", "Los Angeles", "LA", 1, 1, 0),
        ("2016-10-01", "New York", "NY", 1, 0, 0),
        ("2016-10-02", "New York", "NY", 1, 1, 1),
    ]


def test_planned_headcount_covers_every_day(spark):
    days = table(
        spark, "fiscal_date date", [("2016-09-25",), ("2016-09-26",), ("2016-10-17",), ("2016-10-18",)]
    )
    plan = table(spark, "ec_name string, experts_lms bigint", [("Los Angeles", 5), ("New York", 7)])
    found = deck.planned_headcount(days, plan, as_of=AS_OF)
    assert rows(found) == [
        ("2016-09-26", "Los Angeles", 5),
        ("2016-09-26", "New York", 7),
        ("2016-10-17", "Los Angeles", 5),
        ("2016-10-17", "New York", 7),
    ]


def test_used_hours_by_kind(spark, shift_rows):
    kinds = ["Visit", "Pickup", "PaidTimeOff", "Meeting", None]
    blocks = table(
        spark,
        "blocks",
        [
            (i, i, kind, "2016-10-01 16:00:00", "2016-10-01 16:30:00", True)
            for i, kind in enumerate(kinds)
        ]
        + [(9, 9, "Visit", "2016-10-01 16:00:00", "2016-10-01 16:30:00", False)],
    )
    sched = table(spark, "sched", [(i, 900, 1) for i in (*range(5), 9)])
    found = deck.used_hours(
        shift_rows, sched, blocks, experts(spark), centers(spark), as_of=AS_OF
    )
    assert rows(found) == [("2016-10-01", "Los Angeles", 2.5, 1.0, 1.0, 0.5, 0.5)]


def test_shift_classes(spark, shift_rows, roster):
    found = deck.shift_length_histogram(
        shift_rows, experts(spark), centers(spark), roster, as_of=AS_OF
    )
    # Expert 1's second shift is not on the roster of the current house.
    assert rows(
        found, "start_date_local", "current_enjoyment_house_name", "shift_00_hour",
        "shift_01_hour", "shift_14_hour", "shift_hours",
    ) == [
        ("2016-10-01", "Los Angeles", 0, 1, 0, 1.0),
        ("2016-10-01", "New York", 1, 0, 0, 0.5),
    ]
    here = roster.withColumn("current_enjoyment_house_name", deck.F.lit("Los Angeles"))
    long = deck.shift_length_histogram(
        shift_rows, experts(spark), centers(spark), here, as_of=AS_OF
    )
    assert ("2016-10-02", 1) in rows(long, "start_date_local", "shift_14_hour")


def test_visit_and_booking_counts(spark):
    made = table(
        spark,
        "order_master",
        [
            (1, 1, "done", None, None, "2016-10-01", None, "Integration", 1, 11, "2016-10-01", "LA"),
            (2, 1, "done", None, None, "2016-10-01", None, "Direct", 1, None, "2016-10-01", "LA"),
            (3, 1, "canceled", None, None, "2016-10-01", None, "Integration", 1, 13, "2016-10-01", "LA"),
        ],
    )
    assert rows(deck.visit_counts(made, AS_OF)) == [("2016-10-01", "LA", 1, 1)]
    assert rows(deck.booking_counts(made, AS_OF)) == [("2016-10-01", "LA", 3, 1)]


def test_travel_and_pickup_ranges(spark):
    trips = table(
        spark,
        "mkt_tt string, visit_date_local_tt date, visit_travel_duration_minutes double,"
        " pickup_visit_travel_duration_minutes double",
        [("LA", "2016-10-01", 10.0, None), ("LA", "2016-10-01", 20.0, 4.0),
         ("LA", "2016-09-25", 99.0, 99.0)],
    )
    assert rows(deck.travel_avgs(trips, AS_OF)) == [("LA", "2016-10-01", 15.0, 4.0)]
    events = table(
        spark,
        "event_id bigint, event_date date, center_market string",
        [(1, "2016-10-01", "LA"), (2, "2016-10-01", "LA"), (1, AS_OF, "LA")],
    )
    units = table(spark, "inventory_transfer_id bigint, n_units bigint", [(1, 0), (2, 3)])
    # The day of the report itself is not complete.
    assert rows(deck.pickup_totals(events, units, AS_OF)) == [("2016-10-01", "LA", 3, 2)]


def test_spells_meet_by_bucket_as_by_pairs(spark):
    """A hot expert with many spells and shifts: equal to all pairs, and no pairing by expert."""
    base = dt.date(2020, 1, 1)
    day = lambda n: str(base + dt.timedelta(days=n))
    spells = [(1, i, day(i * 3), day(i * 3 + 1 + i % 5)) for i in range(200)]
    spells += [(1, 900, day(-4000), "9999-12-31"), (2, 901, day(50), None), (2, 902, None, day(50))]
    spells += [(2, 903, day(60), day(59)), (2, 904, day(20), day(20)), (None, 905, day(0), day(9))]
    seen = [(1, day(i % 640 - 20), i) for i in range(900)] + [(2, day(i), i) for i in range(80)]
    seen += [(3, day(5), 0), (1, None, 0), (None, day(5), 0)]
    left = table(spark, "expert_id bigint, on_day date, n bigint", seen)
    right = table(spark, "expert_id bigint, house bigint, since date, until date", spells)
    met = held_on_day(left, right, "expert_id", "on_day", "since", "until", day(-10), day(700))
    got = sorted((r.expert_id, str(r.on_day), r.n, r.house) for r in met.collect())
    assert got == sorted(
        (e, d, n, h)
        for e, d, n in seen
        for k, h, a, b in spells
        if e is not None and e == k and None not in (d, a, b) and a <= d <= b and day(-10) <= d <= day(700)
    )
    assert met.columns == ["expert_id", "on_day", "n", "house", "since", "until"]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_day_bucket" in plan.split("Join Inner")[1].split("\n")[0]


def test_hours_of_blocks_far_from_the_shift_are_left_out(spark, shift_rows):
    blocks = table(
        spark,
        "blocks",
        [(0, 0, "Visit", "2016-10-01 16:00:00", "2016-10-01 16:30:00", True),
         (1, 1, "Visit", "2016-10-09 16:00:00", "2016-10-09 16:30:00", True)],
    )
    sched = table(spark, "sched", [(i, 900, 1) for i in range(2)])
    found = deck.used_hours(
        shift_rows, sched, blocks, experts(spark), centers(spark), as_of=AS_OF
    )
    assert rows(found, "used_hours") == [(0.5,)]
