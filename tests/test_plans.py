"""The shape of physical plans: what reaches the scans, and what must not appear."""

from __future__ import annotations

import glob
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from fieldkpi.functions.times import DEFAULT_SINCE
from fieldkpi.operators import located, pickups, travel
from fieldkpi.sources import stored as bucketed_tables
from fieldkpi.sources import tables
from fieldkpi.sources.star_roles import StarRoles
from tests.frames import centers, experts, rows, settings_of

USES_PYTHON = re.compile("BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry._QUERIES))
def test_no_cross_join_and_no_row_python(name, spark, sf_dir):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if not name.startswith("experiment_"):
        assert not USES_PYTHON.search(text)


@pytest.fixture(scope="module")
def stored(spark):
    """Calendar blocks and schedules as files, so that scans show their filters."""
    path = tempfile.mkdtemp(prefix="run-")
    day = "timestampadd(HOUR, CAST(id % 48 AS INT), TIMESTAMP_NTZ'2016-10-01 00:00:00')"
    spark.range(3000).selectExpr(
        "id", "id AS event_id",
        "CASE id % 2 WHEN 0 THEN 'InventoryTransfer' ELSE 'TravelTime' END AS event_type",
        f"{day} AS start_time", f"timestampadd(MINUTE, 30, {day}) AS end_time",
        "true AS enabled", "'unused' AS note",
    ).write.parquet(f"{path}/blocks")
    # Expert 1 has nearly every block.
    spark.range(3000).selectExpr(
        "id AS calendar_block_id", "1L AS shift_id",
        "CASE WHEN id % 50 = 0 THEN 3L ELSE 1L END AS expert_id",
    ).repartition(8).write.parquet(f"{path}/sched")
    return spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/sched")


def test_filters_and_columns_reach_the_scan(spark, stored):
    events = located.located_events(
        *stored, experts(spark), centers(spark), "InventoryTransfer", since=DEFAULT_SINCE
    )
    with settings_of(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
        text = plan(pickups.ped(events))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    blocks = next(p for p in pushed if "event_type" in p)
    assert "EqualTo(event_type,InventoryTransfer)" in blocks
    assert "GreaterThanOrEqual(start_time,2016-09-25T00:00)" in blocks
    assert "EqualTo(enabled,true)" in blocks
    assert "note" not in text
    # The end of a block is not needed to count it.
    assert "end_time" not in text


def test_mapped_event_type_reaches_the_scan(spark, sf_dir):
    """The role maps the log's types; the test on the mapped one is a test on the log's."""
    with settings_of(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
        text = plan(registry.queries()["ped"](spark, sf_dir))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    assert any("EqualTo(event_type,view)" in p for p in pushed)


def test_hot_expert_is_split(spark, stored):
    """One expert owning nearly all blocks: the join is split, the result is whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        # A hot partition is split between its map outputs: keep several of them.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    with settings_of(spark, settings):
        events = located.located_events(
            *stored, experts(spark), centers(spark), "InventoryTransfer"
        )
        result = pickups.ped(events)
        split = rows(result)
        text = plan(result)
    assert "skew=true" in text
    assert split == rows(pickups.ped(events))
    counts = events.groupBy("event_date", "market", "expert_id").count()
    expected = counts.groupBy("event_date", "market").agg(F.avg("count").alias("ped"))
    assert split == rows(expected)


def test_reschedules_collect_no_lists(spark, sf_dir):
    for name in ("order_reschedules", "reschedules_simple_complex", "same_day_reschedules"):
        text = plan(registry.queries()[name](spark, sf_dir))
        assert "collect_list" not in text
        assert "Window" not in text


def test_sums_merge_before_the_shuffle(spark, sf_dir):
    text = plan(registry.queries()["upp"](spark, sf_dir))
    assert "partial_count" in text and "partial_avg" in text


@pytest.mark.parametrize(
    "name", ["experiment_impact_summary_full", "experiment_variance_summary", "experiment_describe_periods"]
)
def test_samples_are_read_once(name, spark, sf_dir):
    """All moments, medians and distances come from one count of equal values."""
    df = registry.queries()[name](spark, sf_dir)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    scans = set(re.findall(r"FileScan parquet \[[^\]]*value#\d+", text))
    assert len(scans) == 1
    assert "ReusedExchange" in text


@pytest.mark.parametrize("name", ["travel_stats_by_period", "experiment_impact_around_change"])
def test_date_window_reaches_the_scan_of_trips(name, spark, sf_dir):
    with settings_of(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
        text = plan(registry.queries()[name](spark, sf_dir))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    assert any("LessThan(ts," in p and "GreaterThanOrEqual(ts," in p for p in pushed)


def scans(df) -> dict[str, int]:
    """Files scanned by the final plan, reused results not counted."""
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    return Counter(re.findall(r"FileScan parquet .*?/(\w+)\.parquet", text))


@pytest.mark.parametrize(
    "name, events", [("travel_metrics", 4), ("total_travel", 4), ("travel_stats", 4), ("experiment_impact_around_change", 5)]
)
def test_trips_are_one_base_and_the_bridge_is_joined_once(name, events, spark, sf_dir):
    # Sort-merge joins would read each side through an exchange of its own.
    found = scans(registry.queries()[name](spark, sf_dir))
    assert found["lineitem"] == 2
    assert found["events"] == events


@pytest.mark.parametrize(
    "name", ["utilization_pvt", "travel_share_of_shift", "deck_used_hours", "metrics_deck"]
)
def test_days_of_shifts_bound_the_scan_of_blocks(name, spark, sf_dir):
    with settings_of(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
        text = plan(registry.queries()[name](spark, sf_dir))
    blocks = [
        line
        for line in text.split("\n")
        if "FileScan" in line and "value#" in line.split("]")[0] and "ts#" in line.split("]")[0]
    ]
    assert any("LessThan(ts," in b and "GreaterThanOrEqual(ts," in b for b in blocks)


@pytest.mark.parametrize("name", ["travel_array_means", "travel_arrays_exploded"])
def test_no_array_holds_a_whole_group(name, spark, sf_dir):
    """Means come from sums; what is exploded was collected in chunks of a given length."""
    text = plan(registry.queries()[name](spark, sf_dir))
    if name == "travel_array_means":
        assert "collect_list" not in text
    for line in text.split("\n"):
        if "collect_list" in line:
            assert re.search(r"floor\(.*_at#", line) or "chunk" in line or "_groupingexpression" in line


def test_no_job_reads_footers_twice(spark, tmp_path):
    path = f"{tmp_path}/part.parquet"
    spark.range(5).toDF("a").write.parquet(path)
    tracker = spark.sparkContext.statusTracker()

    def jobs_of(build):
        spark.sparkContext.setJobGroup(group := f"build {build}", "")
        df = tables.read_table(spark, str(tmp_path), "part")
        spark.sparkContext.setJobGroup("rest", "")
        return df, len(tracker.getJobIdsForGroup(group))

    assert jobs_of(1)[1] == 1
    assert jobs_of(2)[1] == 0
    spark.range(5, 9).selectExpr("CAST(id AS STRING) AS b").write.mode("overwrite").parquet(path)
    df, jobs = jobs_of(3)
    assert jobs == 1 and [r.b for r in df.orderBy("b").collect()] == ["5", "6", "7", "8"]
    assert jobs_of(4)[1] == 0


def test_a_missing_or_unlisted_table_is_not_remembered(spark, tmp_path):
    assert tables.files_of(spark, f"{tmp_path}/nothing.parquet") is None
    assert tables.files_of(spark, "nosuchscheme://there/is.parquet") is None


@pytest.fixture(scope="module")
def bucketed(spark, sf_dir):
    """Bridge, items, blocks and schedules as bucketed tables, blocks in day folders."""
    path = tempfile.mkdtemp(prefix="run-")
    roles = StarRoles(spark, sf_dir)
    for name, key, by_day in (
        ("bridge", "order_item_id", None), ("items", "id", None),
        ("blocks", "id", "start_time"), ("sched", "calendar_block_id", None),
    ):
        bucketed_tables.write_bucketed(roles[name], f"kept_{name}", f"{path}/{name}", key, 4, by_day)
    yield roles, path
    for name in ("bridge", "items", "blocks", "sched"):
        spark.sql(f"DROP TABLE kept_{name}")


def test_bucketed_tables_join_without_a_shuffle(spark, bucketed):
    roles, path = bucketed
    bridge, items = (bucketed_tables.read_bucketed(spark, f"kept_{n}") for n in ("bridge", "items"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with settings_of(spark, off):
        served = travel.order_transfers(items, bridge)
        found = rows(served)
        below = plan(served).split("== Initial Plan ==")[0].split("SortMergeJoin")[1]
        assert "Exchange" not in below and "Bucketed: true" in below
        assert found == rows(travel.order_transfers(roles["items"], roles["bridge"]))
        pairs = bucketed_tables.read_bucketed(spark, "kept_blocks").join(
            bucketed_tables.read_bucketed(spark, "kept_sched"), F.col("id") == F.col("calendar_block_id")
        )
        assert pairs.count() == roles["blocks"].count()
        assert "Exchange hashpartitioning" not in plan(pairs)
    assert len(glob.glob(f"{path}/bridge/*.parquet")) <= 4


def test_day_folders_are_pruned(spark, bucketed):
    roles, path = bucketed
    some = bucketed_tables.read_bucketed(spark, "kept_blocks", "2024-01-10", "2024-01-12")
    assert some.columns == roles["blocks"].columns
    text = plan(some)
    assert re.search(r"PartitionFilters: \[[^\]]*stored_day", text)
    days = {r[0] for r in some.selectExpr("CAST(CAST(start_time AS DATE) AS STRING)").collect()}
    assert days == {f"2024-01-{d:02d}" for d in range(9, 14)}
    whole = [located.scheduled_events(b, roles["sched"], "TravelTime", between=("2024-01-10", "2024-01-12"))
             for b in (some, roles["blocks"])]
    assert rows(whole[0]) == rows(whole[1])
