"""History tables: rows valid in [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.operators.frames import with_latest


def as_of(history: DataFrame, day: Column | str, start: str = "start_dt", end: str = "end_dt") -> DataFrame:
    """Rows valid on one day; a plain filter that reaches the scan, applied before any join."""
    d = F.lit(day) if isinstance(day, str) else day
    return history.where((F.col(start) <= d) & (F.col(end) > d))


def asof_join(facts: DataFrame, history: DataFrame, key: str, at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Each fact with the values of the history row of its key that is valid at its own time, NULLs if there is none.

    A NULL key has no history. The histories of one key do not overlap. ``at`` and ``start`` are timestamps or dates. Both
    sides are sorted together inside a key and the last history row is carried forward, so no pairs are made; keys with
    many rows are cut along the time (``frames.with_latest``). The sides are read up to four times: store what is dear to
    derive.
    """
    payload = F.struct(F.col(end).alias("until"), *[F.col(v) for v in values])
    side = history.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(start).alias("__t"), F.lit(0).alias("__side"),
                          payload.alias("__valid"))
    fact = F.struct(*[F.col(c) for c in facts.columns]).alias("__fact")
    both = facts.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), fact).unionByName(
        side, allowMissingColumns=True
    )
    met = with_latest(both, ["__k"], ["__t", "__side"], "__valid", "__v").where("__side = 1")
    valid = F.col("__v")["until"].isNull() | (F.col("__v")["until"] > F.col("__t"))
    return met.select("__fact.*", *[F.when(valid, F.col("__v")[v]).alias(v) for v in values])
