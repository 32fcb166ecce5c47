"""Levels of time and place: merged sums and bitmaps against counting the rows."""

from __future__ import annotations

import datetime as dt

import pytest

from fieldkpi.operators import levels
from tests.frames import rows, table

EVENTS = "event_id bigint, expert_id bigint, event_date date, market string, center_market string"


@pytest.fixture(scope="module")
def seen():
    out = []
    for i in range(400):
        day = dt.date(2024, 1, 25) + dt.timedelta(days=i % 17)
        expert = (i * i) % 53 * 40_000 - 5 if i % 7 else None  # many bitmap buckets, one id below 0
        place = i % 3
        out.append((i, expert, str(day), ["4-LA", "2-NY", "5-SD"][place], ["W", "E", "W"][place]))
    return out


@pytest.fixture(scope="module")
def events(spark, seen):
    return table(spark, EVENTS, seen)


def counted(seen, value):
    """``value`` of the rows of every level, counted from the rows."""
    groups = {}
    for event, expert, day, market, region in seen:
        d = dt.date.fromisoformat(day)
        times = [("day", d), ("week", d - dt.timedelta(days=d.weekday())), ("month", d.replace(day=1))]
        for t in times:
            for p in (("market", market), ("region", region), ("all", None)):
                groups.setdefault((t[0], str(t[1]), *p), []).append((event, expert, day, market))
    return {k: value(v) for k, v in groups.items()}


def found(df, *columns):
    return {tuple(r[:4]): r[4:] for r in rows(df, "time_level", "period_start", "place_level", "place", *columns)}


def test_ped_levels(events, seen):
    got = found(levels.ped_levels(events), "n_pickups", "n_expert_days", "ped")

    def value(group):
        days = len({(e, d, m) for _, e, d, m in group})
        return (len(group), days, len(group) / days)

    assert got == counted(seen, value)


def test_upp_levels(spark, events, seen):
    units = table(
        spark, "inventory_transfer_id bigint, n_units bigint", [(i, i % 4) for i in range(0, 400, 2)]
    )
    got = found(levels.upp_levels(events, units), "n_pickups", "n_units", "units_per_pickup")

    def value(group):
        own = [e % 4 for e, *_ in group if e % 2 == 0]
        return (len(own), sum(own), sum(own) / len(own)) if own else None

    assert got == {k: v for k, v in counted(seen, value).items() if v}


def test_distinct_ids_merge_from_daily_bitmaps(spark, events, seen, tmp_path):
    path = f"{tmp_path}/bitmaps"
    levels.daily_bitmaps(events).write.partitionBy("event_date").parquet(path)
    stored = spark.read.parquet(path)
    got = found(levels.distinct_levels(stored, "n_experts"), "n_experts")
    want = counted(seen, lambda g: (len({e for _, e, *_ in g if e is not None}),))
    assert got == {k: v for k, v in want.items() if v[0]}
    assert "expert_id" not in stored.columns


def test_one_shuffle_of_the_facts_serves_all_levels(events):
    plan = levels.ped_levels(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Exchange") == 3  # experts, days, levels
    assert levels.ped_levels(events.where("false")).count() == 0


def test_rates_within_an_entity(spark):
    events = table(
        spark,
        EVENTS,
        [(1, 7, "2024-01-30", "4-LA", "W"), (1, 7, "2024-01-30", "4-LA", "W"),  # one transfer, named twice
         (2, 7, "2024-01-31", "4-LA", "W"), (3, 8, "2024-02-01", "2-NY", "E"), (9, 8, "2024-02-01", "2-NY", "E")],
    )
    carried = table(
        spark,
        "inventory_transfer_id bigint, partner string, n_units bigint",
        [(1, "a", 2), (1, "b", 5), (2, "a", 4), (3, "b", 0), (4, "a", 9)],
    )
    got = rows(
        levels.rates_within(events, carried, "partner").where("time_level = 'week' AND place_level <> 'region'"),
        "period_start", "place", "partner", "n_pickups", "n_expert_days", "n_units", "ped", "units_per_pickup",
    )
    assert got == [
        ("2024-01-29", "2-NY", "b", 1, 1, 0, 1.0, 0.0),
        ("2024-01-29", "4-LA", "a", 2, 2, 6, 1.0, 3.0),
        ("2024-01-29", "4-LA", "b", 1, 1, 5, 1.0, 5.0),
        ("2024-01-29", None, "a", 2, 2, 6, 1.0, 3.0),
        ("2024-01-29", None, "b", 2, 2, 5, 1.0, 2.5),
    ]
