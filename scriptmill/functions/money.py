"""Exact money arithmetic on DOUBLE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(col: Column | str) -> Column:
    """A row's amount as DECIMAL(22,2), so that sums do not depend on the order of the rows."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(22,2)")


def money_sum(col: Column | str) -> Column:
    """Exact sum, shown as DOUBLE."""
    return F.sum(cents(col)).cast("double")


def money_avg(col: Column | str) -> Column:
    """Average from the exact sum and the count of non-null amounts."""
    value = cents(col)
    return F.sum(value).cast("double") / F.count(value)
