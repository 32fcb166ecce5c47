from __future__ import annotations

import pytest

from fieldkpi.operators import orders
from tests.frames import centers, experts, rows, table

LA = "4-LA"


@pytest.fixture(scope="module")
def place(spark):
    return experts(spark), centers(spark)


@pytest.fixture(scope="module")
def order_rows(spark):
    return table(
        spark,
        "order_master",
        [
            # order, expert, status, created day, created at, pacific day, canceled at
            (31, 1, "complete", "2016-10-01", "2016-10-01 09:30:00", None, None),
            (32, 1, "canceled", "2016-10-01", "2016-10-01 10:10:00", None, "2016-10-02 03:00:00"),
            (33, 1, "canceled", "2016-10-01", "2016-10-01 10:20:00", None, "2016-10-02 08:00:00"),
            (34, 3, "complete", "2016-10-01", "2016-10-01 23:59:59", None, None),
            (35, 1, "canceled", "2016-10-03", None, None, None),
        ],
    )


@pytest.fixture(scope="module")
def visit_rows(spark):
    return table(
        spark,
        "visit_facts",
        [
            # visit, order, expert, status, created day, created at, updated, start, end
            (1, 31, 1, "complete", "2016-10-01", None, "2016-10-01 20:00:00", "2016-10-01", "2016-10-01"),
            (2, 31, 1, "canceled", "2016-10-01", None, "2016-10-02 05:00:00", "2016-10-01", "2016-10-01"),
            (3, 34, 1, "complete", "2016-10-01", None, "2016-10-03 05:00:00", "2016-10-02", "2016-10-02"),
            (4, 32, 1, "complete", "2016-10-01", None, None, "2016-10-01", "2016-10-01"),
            (5, 34, 1, "complete", "2016-09-01", None, "2016-09-01 20:00:00", "2016-09-01", "2016-09-01"),
            (6, 31, 1, None, "2016-10-01", None, None, "2016-10-01", "2016-10-01"),
        ],
    )


def test_same_day_share(visit_rows, order_rows, place):
    # Live visits are 1, 3 and 5; a null status is not live.
    assert rows(orders.same_day_share(visit_rows, order_rows)) == [(1 / 3,)]
    found = orders.same_day_share_by_market(visit_rows, order_rows, *place)
    assert rows(found) == [
        ("2016-10-01", LA, 1, 1, 100.0),
        ("2016-10-02", LA, 0, 1, 0.0),
    ]


def test_cancelations(visit_rows, order_rows, place):
    # 03:00 UTC is still the day of the order in Los Angeles; 08:00 is not.
    assert rows(orders.same_day_order_cancels(order_rows, *place)) == [("2016-10-01", LA, 1)]
    assert rows(orders.same_day_visit_cancels(visit_rows, *place)) == [("2016-10-01", LA, 1)]
    share = orders.same_day_visit_cancel_share(visit_rows, order_rows, *place)
    assert rows(share) == [("2016-10-01", LA, 1, 4, 0.25)]
    assert rows(orders.cancel_summary(visit_rows, order_rows, *place)) == [
        ("2016-10-01", LA, 1, 1, 1)
    ]


def test_cancelations_by_hour(order_rows):
    found = rows(orders.cancel_share_by_hour(order_rows))
    assert [h for h, _ in found] == [3, 8, None]
    assert abs(sum(p for _, p in found) - 100) < 1e-9


def test_hours_of_the_day(visit_rows, order_rows, place):
    # The order without a time sorts first, before the earliest hour.
    running = {h: p for h, p in rows(orders.hourly_running_share(order_rows))}
    assert running == {None: 20.0, 9: 40.0, 10: 80.0, 23: 100.0}
    same = orders.hourly_running_share_same_day(visit_rows, order_rows)
    assert rows(same) == [(9, 100.0)]
    assert rows(orders.hourly_share_by_market(visit_rows, order_rows, *place)) == [
        (LA, 9, 100.0)
    ]
    assert rows(orders.hourly_running_share_by_market(visit_rows, order_rows, *place)) == [
        (LA, 9, 100.0)
    ]


def test_running_share_ends_at_one_hundred(spark):
    made = table(
        spark,
        "order_master",
        [(i, 1, "complete", None, f"2016-10-01 {i % 7:02d}:00:00") for i in range(50)],
    )
    running = [p for _, p in rows(orders.hourly_running_share(made))]
    assert running == sorted(running)
    assert abs(running[-1] - 100) < 1e-9


def test_density(spark):
    made = table(
        spark,
        "order_id bigint, billing_address_id bigint",
        [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 9)],
    )
    places = table(
        spark,
        "address_id bigint, zip string",
        [(1, "00001"), (2, "00001"), (3, "00002"), (4, "00003")],
    )
    zips = table(
        spark, "zip string, market string", [("00001", "LA"), ("00002", "LA"), ("00003", "NY")]
    )
    people = table(
        spark,
        "zipcode string, population string, landsqmi string",
        [("00001", "12,000", "1.5"), ("00002", "0", "2"), ("00003", "5", "0")],
    )
    args = (made, places, zips, people)
    assert rows(orders.order_density(*args)) == [("00001", 0.25, 2.0)]
    assert rows(orders.order_density_rows(*args)) == [
        ("00001", "LA", 3, 12000, 1.5),
        ("00002", "LA", 1, 0, 2.0),
        ("00003", "NY", 1, 5, 0.0),
    ]
    assert rows(orders.order_density_by_market(*args)) == [
        ("LA", 4, 12000, 3.5, 4 / 12000 * 1000, 4 / 3.5),
        ("NY", 1, 5, 0.0, 200.0, None),
    ]


def test_fact_join(visit_rows, order_rows):
    joined = orders.fact_join(visit_rows, order_rows)
    assert joined.count() == 6
    assert len(joined.columns) == len(set(joined.columns))
