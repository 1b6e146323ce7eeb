"""Dates, times and reporting periods.

"Today" is always an ``as_of`` argument. Period limits are worked out once on the driver, so
a period filter is a pair of literals on a plain column and reaches the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmetrics.functions.money import ColumnOrName, col

TODAY, WEEK, MONTH, RANGE, ALL_TIME = "today", "week", "month", "range", "all"
PERIODS = (TODAY, WEEK, MONTH, RANGE, ALL_TIME)

# Day zero of spreadsheet serial dates, and the serials of 0001-01-01 and 9999-12-31.
SERIAL_DAY_ZERO = dt.date(1899, 12, 30)
FIRST_SERIAL = -693593
LAST_SERIAL = 2958465


def as_date(d: dt.date | str) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)


def month_start(as_of: dt.date | str) -> dt.date:
    return as_date(as_of).replace(day=1)


def month_end(as_of: dt.date | str) -> dt.date:
    into_next = month_start(as_of) + dt.timedelta(days=31)
    return into_next.replace(day=1) - dt.timedelta(days=1)


def days_before(as_of: dt.date | str, n: int) -> dt.date:
    return as_date(as_of) - dt.timedelta(days=n)


def period_bounds(
    mode: str, as_of: dt.date | str, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> tuple[dt.date, dt.date] | None:
    """P31/F4. First and last day of a period, or None for all time.

    A week starts on Monday; week and month stop at ``as_of``. A range without limits runs
    from the start of the month to ``as_of``.
    """
    day = as_date(as_of)
    if mode == TODAY:
        return day, day
    if mode == WEEK:
        return days_before(day, day.weekday()), day
    if mode == MONTH:
        return month_start(day), day
    if mode == RANGE:
        return as_date(start or month_start(day)), as_date(end or day)
    if mode == ALL_TIME:
        return None
    raise ValueError(f"unknown period {mode!r}; use one of {PERIODS}")


def in_period(date: ColumnOrName, mode: str, as_of, start=None, end=None) -> Column:
    """F4."""
    bounds = period_bounds(mode, as_of, start, end)
    if bounds is None:
        return F.lit(True)
    return col(date).between(F.lit(bounds[0]), F.lit(bounds[1]))


def on_day(date: ColumnOrName, day: dt.date | str) -> Column:
    """F3."""
    return col(date) == F.lit(as_date(day))


def in_calendar_month(date: ColumnOrName, as_of: dt.date | str) -> Column:
    """F5. The whole calendar month of ``as_of``, later days included (unlike F4), as a range."""
    return col(date).between(F.lit(month_start(as_of)), F.lit(month_end(as_of)))


def hour_of(time: ColumnOrName) -> Column:
    """P10, for a ``HH:mm:ss`` time of day."""
    return F.substring(col(time), 1, 2).cast("int")


def hhmm(time: ColumnOrName) -> Column:
    """P12, for a ``HH:mm:ss`` time of day."""
    return F.substring(col(time), 1, 5)


def time_of_day(ts: ColumnOrName) -> Column:
    """Time of day of a timestamp as ``HH:mm:ss`` text; without a time zone, what the clock showed."""
    return F.substring(col(ts).cast("string"), 12, 8)


def long_date(d: ColumnOrName) -> Column:
    """P21. ``Monday, 01 June 2026``."""
    return F.date_format(col(d), "EEEE, dd MMMM yyyy")


def excel_date(serial: ColumnOrName) -> Column:
    """P13. Spreadsheet serial number to date; the fraction of a day is cut off towards zero.

    For numeric columns. What is not a number, or falls outside years 1-9999, gives NULL.
    """
    days = col(serial).cast("double")
    ok = ~F.isnan(days) & (days > FIRST_SERIAL - 1) & (days < LAST_SERIAL + 1)
    return F.when(ok, F.date_add(F.lit(SERIAL_DAY_ZERO), F.when(ok, days).cast("int")))
