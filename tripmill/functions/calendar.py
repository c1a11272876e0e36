"""Calendar expressions over wall-clock pickup times (timestamp_ntz)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, functions as F

MONTH_TEXT = re.compile(r"(\d{4})-(\d{1,2})")


def parse_month(month: str) -> tuple[int, int]:
    """'2025-11' -> (2025, 11). The month number is not range-checked: a file
    may be named 2025-13, and asking for it is answered with no rows."""
    match = MONTH_TEXT.fullmatch(month)
    if match is None:
        raise ValueError(f"month must look like YYYY-MM, got {month!r}")
    return int(match[1]), int(match[2])


def first_day(month: str) -> Column:
    """The month's first day; NULL if there is no such month (2025-13)."""
    year, number = parse_month(month)
    exists = 1 <= number <= 12
    return F.expr(f"DATE'{year:04d}-{number:02d}-01'" if exists else "CAST(NULL AS DATE)")


def month_bounds(month: str) -> tuple[Column, Column] | None:
    """First instant of the month and of the next; None if there is no such
    month."""
    if not 1 <= parse_month(month)[1] <= 12:
        return None
    first = first_day(month)
    return first.cast("timestamp_ntz"), F.add_months(first, 1).cast("timestamp_ntz")


def month_micros(month: str) -> tuple[int, int]:
    """The same bounds of an existing month as microseconds since 1970."""
    year, number = parse_month(month)
    first = date(year, number, 1)
    following = date(year + number // 12, number % 12 + 1, 1)
    return tuple((day - date(1970, 1, 1)).days * 86_400_000_000 for day in (first, following))


def in_month(ts: Column, month: str) -> Column:
    """ts lies in the calendar month, as a half-open range: unlike a comparison
    of year and month parts, a range reaches the Parquet reader."""
    bounds = month_bounds(month)
    if bounds is None:
        return F.lit(False)
    first, following = bounds
    return (ts >= first) & (ts < following)


def month_text(first_day: Column) -> Column:
    return F.substring(first_day.cast("string"), 1, 7)


def day(ts: Column) -> Column:
    return ts.cast("date")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("bigint")


def weekday(moment: Column) -> Column:
    """0 = Sunday ... 6 = Saturday; Spark itself counts from 1."""
    return (F.dayofweek(moment) - 1).cast("bigint")


def monday_first(dow: Column) -> Column:
    """Sort key that puts Monday first and Sunday last."""
    return (dow + 6) % 7
