"""Calendar expressions shared by the operators (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def elapsed_days(start: str | Column, end: str | Column) -> Column:
    """Whole 24-hour periods from ``start`` to ``end`` (floor, like a
    timedelta's ``.days``).  ``datediff`` counts midnights instead, which is
    wrong for intraday timestamps (23:00 -> 01:00 is 0 days, not 1)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def day(col: str | Column) -> Column:
    return F.to_date(_c(col))


def month_start(col: str | Column) -> Column:
    return F.trunc(F.to_date(_c(col)), "month")


def week_start(col: str | Column) -> Column:
    """Monday of the ISO week (weekly buckets labelled by their start)."""
    return F.trunc(F.to_date(_c(col)), "week")


def week_end_label(col: str | Column) -> Column:
    """Sunday closing the Monday-based week (weekly buckets labelled by their
    end, as a Sunday-anchored weekly resample labels them)."""
    return F.date_add(week_start(col), 6)


def month_index(col: str | Column) -> Column:
    """Months since year 0; differences give whole calendar months."""
    d = _c(col)
    return F.year(d) * 12 + F.month(d)


def month_diff(later: str | Column, earlier: str | Column) -> Column:
    return month_index(later) - month_index(earlier)
