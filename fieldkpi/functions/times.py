"""Dates, local time and durations as column expressions.

Timestamps are TIMESTAMP_NTZ. ``*_utc`` and block times hold UTC; local values
come from the time zone of a center.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = str | dt.date

# The first day kept by default is the one after this date.
DEFAULT_SINCE = "2016-09-25"
DECK_START = "2016-09-26"
HEADQUARTERS_ZONE = "America/Los_Angeles"

# A block counts for the shift it is scheduled in if it starts at most so many days before
# or after the shift does.
SHIFT_MARGIN_DAYS = 2


def day(value: Day) -> Column:
    return F.lit(value).cast("date")


def shift_day(value: Day, days: int) -> dt.date:
    base = value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    return base + dt.timedelta(days=days)


def local_time(ts_utc: str | Column, zone: str | Column) -> Column:
    """UTC timestamp moved to the wall clock of ``zone`` (a column or a zone name column)."""
    return F.convert_timezone(F.lit("UTC"), _col(zone), _col(ts_utc))


def local_date(ts_utc: str | Column, zone: str | Column) -> Column:
    return F.to_date(local_time(ts_utc, zone))


def headquarters_date(ts_utc: str | Column) -> Column:
    return local_date(ts_utc, F.lit(HEADQUARTERS_ZONE))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(60e6)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(3600e6)


def could_be_after(ts_utc: str | Column, since: Day) -> Column:
    """Raw-timestamp test implied by "local date > since" in every time zone.

    No zone is more than 14 hours ahead, so this loses no row. Unlike the test on
    the converted date it reaches the Parquet scan, which skips row groups by it.
    """
    return _col(ts_utc) >= day(since).cast("timestamp_ntz")


def could_be_between(ts_utc: str | Column, first: Day, last: Day) -> Column:
    """Raw-timestamp test implied by "local date between first and last"."""
    lower = day(shift_day(first, -1)).cast("timestamp_ntz")
    upper = day(shift_day(last, 2)).cast("timestamp_ntz")
    return (_col(ts_utc) >= lower) & (_col(ts_utc) < upper)


def near_shift(block_start: str | Column, shift_start: str | Column) -> Column:
    """Whether a block starts within ``SHIFT_MARGIN_DAYS`` of its shift's start."""
    margin = F.make_dt_interval(days=F.lit(SHIFT_MARGIN_DAYS))
    start = _col(shift_start)
    return _col(block_start).between(start - margin, start + margin)


def could_be_near_shifts(
    ts_utc: str | Column, first: Day | None = None, last: Day | None = None
) -> Column:
    """Raw-timestamp test implied by ``near_shift`` for shifts of local days ``first`` to
    ``last``; a missing end is open."""
    test = F.lit(True)
    if first is not None:
        lower = day(shift_day(first, -1 - SHIFT_MARGIN_DAYS)).cast("timestamp_ntz")
        test = _col(ts_utc) >= lower
    if last is not None:
        test &= _col(ts_utc) < day(shift_day(last, 2 + SHIFT_MARGIN_DAYS)).cast("timestamp_ntz")
    return test


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
