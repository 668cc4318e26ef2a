"""Date and time expressions. Every "current date" is an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DayTimeIntervalType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_date(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of).cast("date")


def month_offset(d, months: int) -> Column:
    """``d`` shifted by ``months`` calendar months, clamped to the month end
    (31 Mar - 1 month = 29 Feb 2000)."""
    return F.add_months(_col(d).cast("date"), months)


def previous_month_bounds(as_of) -> tuple[Column, Column]:
    """First and last day (dates) of the month before ``as_of``."""
    prev = F.add_months(_as_date(as_of), -1)
    return F.trunc(prev, "MM"), F.last_day(prev)


def previous_month_window(as_of) -> tuple[Column, Column]:
    """Half-open timestamp window [first instant of last month, first instant of
    this month) for ``as_of``, as zone-less timestamps.

    With a literal ``as_of`` both bounds constant-fold, so the predicate on the raw
    ``completed_at`` column is pushed to the parquet scan.
    """
    d = _as_date(as_of)
    lo = F.trunc(F.add_months(d, -1), "MM").cast("timestamp_ntz")
    hi = F.trunc(d, "MM").cast("timestamp_ntz")
    return lo, hi


def format_ddmmyyyy(ts) -> Column:
    """``dd/MM/yyyy`` text of a timestamp; null stays null. Built from the day, month
    and year of the zone-less timestamp: ``date_format`` would go through a zoned
    timestamp, which a day that the session zone skips would move."""
    day = F.to_date(_col(ts))
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return F.concat(
        two(F.dayofmonth(day)), F.lit("/"), two(F.month(day)), F.lit("/"),
        F.lpad(F.year(day).cast("string"), 4, "0"),
    )


# An interval of seconds (with microseconds): casting to it and then to a decimal
# turns a day-time interval into an exact number of seconds.
_SECONDS = DayTimeIntervalType(DayTimeIntervalType.SECOND, DayTimeIntervalType.SECOND)


def lead_time_hours(created, completed) -> Column:
    """Hours from ``created`` to ``completed`` as a double; null if either is null,
    negative if completed precedes created.

    Computed from the zone-free difference of the two zone-less timestamps (an
    exact interval), never through the session time zone: a wall-clock time that
    does not exist in the session zone (a DST gap) must not shift the result.
    """
    seconds = (_col(completed) - _col(created)).cast(_SECONDS).cast("decimal(20,6)")
    micros = (seconds * 1_000_000).cast("long")
    return micros.cast("double") / F.lit(1_000_000.0) / F.lit(3600.0)


def posting_day(ts) -> Column:
    """Calendar date of a timestamp."""
    return F.to_date(_col(ts))


def shift_time(ts, days=0, hours=0) -> Column:
    """``ts`` plus a day-time interval (negative values shift back)."""
    days_c = days if isinstance(days, Column) else F.lit(days)
    hours_c = hours if isinstance(hours, Column) else F.lit(hours)
    return _col(ts) + F.make_dt_interval(days=days_c, hours=hours_c)
