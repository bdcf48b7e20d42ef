"""Validation of report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, keys: list[str], checks: list[tuple[Column, str]]) -> DataFrame:
    """One row per row and failed check: the key columns and ``message``. All checks are tried in one pass; a check
    whose condition is NULL does not fail."""
    failed = F.array_compact(F.array(*[F.when(condition, F.lit(message)) for condition, message in checks]))
    return df.select(*keys, F.explode(failed).alias("message"))


def unknown_codes(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """Rows whose code is not in the code table; a missing code counts as unknown."""
    known = codes.select(F.col(code).alias("__code")).where("__code IS NOT NULL").distinct()
    return df.join(known, F.col(column) == F.col("__code"), "left_anti")
