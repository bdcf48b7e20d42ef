"""Column contracts of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.session import shuffle_partitions


def project(df: DataFrame, contract: list[str]) -> DataFrame:
    """Exactly the named columns, in this order; a missing one is an error instead of a NULL column."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*contract)


def fill_layout(df: DataFrame, contract: dict[str, str | None]) -> DataFrame:
    """The contract's columns in order; a column the table lacks is filled with the given constant."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in contract.items()])


# Rows of a code list that may be broadcast; a longer one is dealt out and met bucket by bucket.
BROADCAST_CODES = 10_000


def report_frame(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``: the empty frame of a report over code lists. The right list is
    counted first. A short one is broadcast; of a long one, every bucket meets a copy of the left list."""
    if right.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        return left.crossJoin(F.broadcast(right))
    n = shuffle_partitions(left.sparkSession)
    dealt = right.withColumn("__bucket", F.pmod(F.xxhash64(*right.columns), F.lit(n)))
    copies = left.withColumn("__bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return copies.join(dealt, "__bucket").select(*left.columns, *right.columns)
