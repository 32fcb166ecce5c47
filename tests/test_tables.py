from __future__ import annotations

import tempfile

from fieldkpi.sources import tables
from fieldkpi.sources.star_roles import ROLE_NAMES, StarRoles
from tests.frames import rows, table

SUMMARY = "market string, metric string, value double"


def test_csv_round_trip(spark):
    df = table(spark, SUMMARY, [("4-LA", "vtt", 1.5), ("2-NY, east", 'a "b"', None)])
    path = tempfile.mkdtemp(prefix="run-") + "/summary"
    tables.write_summary_csv(df, path)
    assert rows(tables.read_results_csv(spark, path, SUMMARY)) == rows(df)


def test_list_columns(spark, sf_dir):
    tables.read_table(spark, sf_dir, "region").createOrReplaceTempView("regions_seen")
    found = tables.list_columns(spark, "regions_seen").collect()
    assert [(r.column_name, r.data_type) for r in found] == [
        ("r_regionkey", "int"),
        ("r_name", "string"),
    ]


def test_preview_sorted_values_and_fill(spark):
    df = table(spark, SUMMARY, [("b", "x", 2.0), ("a", "x", None), ("a", "y", 1.0)])
    assert [r.metric for r in tables.preview(df, "market", "metric", rows=2).collect()] == ["x", "y"]
    assert tables.preview(df, rows=2).count() == 2
    assert [r[0] for r in tables.sorted_values(df, "market").collect()] == ["a", "b"]
    assert rows(tables.fill_nulls(df), "value") == [(0.0,), (1.0,), (2.0,)]


def test_every_role_reads(spark, sf_dir):
    roles = StarRoles(spark, sf_dir)
    for name in ROLE_NAMES:
        assert roles[name].limit(1).count() == 1, name


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    path = f"{tmp_path}/nation.parquet"
    spark.range(3).toDF("old").write.parquet(path)
    assert StarRoles(spark, str(tmp_path)).table("nation").columns == ["old"]
    spark.range(5, 8).toDF("new").write.mode("overwrite").parquet(path)
    again = StarRoles(spark, str(tmp_path)).table("nation")
    assert sorted(r.new for r in again.collect()) == [5, 6, 7]
