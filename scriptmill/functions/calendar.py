"""Dates kept as ``yyyyMMdd`` text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ymd(date_col: Column | str) -> Column:
    return F.date_format(date_col, "yyyyMMdd")


def to_day(text: Column | str) -> Column:
    """NULL, not an error, for text that is no date."""
    return F.try_to_timestamp(text if isinstance(text, Column) else F.col(text), F.lit("yyyyMMdd")).cast("date")


def month_first(text: Column | str) -> Column:
    return F.trunc(to_day(text), "MM")


def prev_month_end(text: Column | str) -> Column:
    """Last day of the month before, as ``yyyyMMdd``."""
    return ymd(F.date_sub(month_first(text), 1))


def month_end(text: Column | str) -> Column:
    return ymd(F.last_day(to_day(text)))


def month_range(col: Column | str, year: int, month: int | None = None) -> Column:
    """Half-open range on the bare column, which reaches the scan as two pushed bounds."""
    c = F.col(col) if isinstance(col, str) else col
    first = f"{year:04d}-{month or 1:02d}-01"
    if month is None:
        after = f"{year + 1:04d}-01-01"
    else:
        after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    return (c >= F.lit(first).cast("timestamp_ntz")) & (c < F.lit(after).cast("timestamp_ntz"))
