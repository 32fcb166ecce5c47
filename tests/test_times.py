from __future__ import annotations

from pyspark.sql import functions as F

from fieldkpi.functions import labels, times
from tests.frames import rows, table

STAMPS = "ts timestamp_ntz, zone string"


def test_local_date_across_zones_and_clock_changes(spark):
    df = table(
        spark,
        STAMPS,
        [
            ("2016-10-01 03:00:00", "America/Los_Angeles"),
            # The clock goes back on 6 November and forward on 12 March, at 2 am.
            ("2016-11-06 06:59:59", "America/Los_Angeles"),
            ("2016-11-06 07:00:00", "America/Los_Angeles"),
            ("2016-11-07 07:30:00", "America/Los_Angeles"),
            ("2017-03-12 07:30:00", "America/Los_Angeles"),
            ("2017-03-13 07:30:00", "America/Los_Angeles"),
            ("2016-10-01 23:30:00", "Asia/Kolkata"),
            (None, "Asia/Kolkata"),
        ],
    )
    found = [str(r[0]) for r in df.select(times.local_date("ts", "zone")).collect()]
    assert found == [
        "2016-09-30", "2016-11-05", "2016-11-06", "2016-11-06", "2017-03-11", "2017-03-13",
        "2016-10-02", "None",
    ]


def test_durations_keep_microseconds(spark):
    df = table(
        spark,
        "a timestamp_ntz, b timestamp_ntz",
        [("2016-10-01 00:00:00", "2016-10-01 00:01:30.000006")],
    )
    minutes, hours = df.select(
        times.minutes_between("a", "b"), times.hours_between("a", "b")
    ).first()
    assert abs(minutes - 1.5000001) < 1e-12
    assert abs(hours * 60 - minutes) < 1e-12


def test_raw_prefilter_never_loses_a_row(spark):
    zones = ["Pacific/Kiritimati", "Pacific/Pago_Pago", "UTC", "America/Los_Angeles"]
    hours = spark.range(24 * 8).select(
        F.expr("timestampadd(HOUR, id, TIMESTAMP_NTZ'2016-09-22 00:00:00')").alias("ts")
    )
    df = hours.withColumn("zone", F.explode(F.array(*map(F.lit, zones))))
    after = times.local_date("ts", "zone") > times.day("2016-09-25")
    lost = df.where(after & ~times.could_be_after("ts", "2016-09-25"))
    assert lost.count() == 0
    within = times.local_date("ts", "zone").between(
        times.day("2016-09-24"), times.day("2016-09-26")
    )
    lost = df.where(within & ~times.could_be_between("ts", "2016-09-24", "2016-09-26"))
    assert lost.count() == 0


def test_market_label_and_partner(spark):
    df = table(
        spark,
        "id bigint, market string, partner_channel string, partner_id int",
        [(4, "LA", "Integration", 1), (3, None, "Integration", 2), (2, "NY", None, 1)],
    )
    assert rows(df.select("id", labels.market_label(), labels.partner_label())) == [
        (2, "2-NY", "Other"),
        (3, "3", "Other"),
        (4, "4-LA", "ATT.com (Cart)"),
    ]


def test_ratio_and_grouped_number(spark):
    df = table(spark, "a bigint, b bigint, p string", [(1, 4, "12,345"), (1, 0, "0")])
    assert rows(df.select(labels.ratio("a", "b"), labels.grouped_number("p"))) == [
        (0.25, 12345),
        (None, 0),
    ]
