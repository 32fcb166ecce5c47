from __future__ import annotations

import pytest

from fieldkpi.operators import reschedules
from tests.frames import centers, experts, rows, table

LA, DAY = "4-LA", "2016-10-01"


@pytest.fixture(scope="module")
def made(spark):
    def visit(visit_id, order, status, created):
        return (visit_id, order, 1, status, None, created)

    facts = table(
        spark,
        "visit_facts",
        [
            visit(1, 31, "complete", "2016-10-01 09:00:00"),
            # canceled, then completed
            visit(2, 32, "canceled", "2016-10-01 09:00:00"),
            visit(3, 32, "complete", "2016-10-01 10:00:00"),
            # completed, then canceled
            visit(4, 33, "complete", "2016-10-01 09:00:00"),
            visit(5, 33, "canceled", "2016-10-01 10:00:00"),
            # two at one time: the larger id is last
            visit(6, 34, "canceled", "2016-10-01 09:00:00"),
            visit(7, 34, "complete", "2016-10-01 09:00:00"),
            # no creation time comes last; a null last status is not "complex"
            visit(8, 35, "canceled", "2016-10-01 09:00:00"),
            visit(9, 35, "complete", None),
            visit(10, 36, "canceled", "2016-10-01 09:00:00"),
            visit(11, 36, None, "2016-10-01 10:00:00"),
        ],
    )
    orders = table(
        spark,
        "order_master",
        [(n, 1, "complete", DAY, None, None, "2016-10-02 03:00:00") for n in range(31, 37)]
        + [(37, 1, "complete", DAY)],
    )
    return facts, orders, experts(spark), centers(spark)


def test_simple_and_complex(made):
    history = reschedules.order_reschedules(*made)
    assert rows(history, "order_id", "simple", "complex", "n_reschedules") == [
        (31, False, False, 0),
        (32, True, True, 1),
        (33, True, False, 1),
        (34, True, True, 1),
        (35, True, True, 1),
        (36, True, False, 1),
    ]
    assert rows(reschedules.reschedules_simple_complex(history)) == [(DAY, LA, 5, 3, 6)]
    assert rows(reschedules.rescheduled_orders(history)) == [(DAY, LA, 5, 6)]
    assert rows(reschedules.avg_reschedules(history)) == [(DAY, LA, 1.0)]


def test_actors_and_summary(spark, made):
    _, orders, people, places = made

    def visit(order, actor, status="done", created=DAY):
        return (order * 10, order, 1, 1, 1, actor, status, created)

    visits = table(
        spark,
        "visits",
        [
            visit(31, "Employee"), visit(31, None),
            visit(32, "Customer"), visit(32, "Customer", created="2016-10-05"),
            visit(32, "Robot", status=None), visit(32, None),
            visit(33, "Employee"),
        ],
    )
    args = (visits, orders, people, places)
    assert rows(reschedules.reschedule_actor_mix(*args)) == [(DAY, LA, 0.25, 0.25, 0.375)]
    # Order 32 has three visits with a status.
    assert rows(reschedules.reschedule_summary(*args)) == [(DAY, LA, 2, 1.5, 2, 2, 2)]
    assert rows(reschedules.same_day_reschedules(*args)) == [(DAY, LA, 6, 6, 2, 2, 2, 2)]


def test_no_rescheduled_orders_gives_null_mean(spark, made):
    facts, orders, people, places = made
    history = reschedules.order_reschedules(
        facts.where("order_id = 31"), orders, people, places
    )
    assert rows(reschedules.avg_reschedules(history)) == [(DAY, LA, None)]
