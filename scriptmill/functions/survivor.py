"""Which of two systems' values survives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_good(value: Column) -> Column:
    """Neither NULL nor blank nor a placeholder that starts with '@@'."""
    return F.coalesce((value != "") & ~value.startswith("@@"), F.lit(False))


def survivor(a: Column, b: Column) -> Column:
    """A's value, unless it is missing, blank or a placeholder and B's is good."""
    return F.when(~is_good(a) & is_good(b), b).otherwise(a)
