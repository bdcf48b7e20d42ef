"""Joins of values with the ranges that hold them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.session import shuffle_partitions

# Levels of cells at most, and values of a bin that meet in one task at least before it is split.
LEVELS, BIN_ROWS = 20, 100_000


def interval_join(points: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of ``points`` with each of the ``ranges`` where lo <= value < hi, every pair once, as an equi join.

    The values' span is cut into 2^k cells, about two to a range of median width. A range is the two cells of its ends,
    whose values are compared, and between them as few blocks of 1, 2, 4, ... cells as cover it, whose values all lie in it;
    a value is in one block of each size, and only sizes that some range needs are looked up. Bins with more values than a
    shuffle partition holds on average are split by the values' hash, and the ranges copied to the parts.

    NULL and NaN values or bounds match nothing, nor does an empty range; equal rows are all kept. Column names of the two
    sides must differ."""
    v, low, high = (F.col(c).cast("double") for c in (value, lo, hi))
    valid = ranges.where((low < high) & ~F.isnan(low) & ~F.isnan(high))
    known = points.where(v.isNotNull() & ~F.isnan(v))
    finite = F.when(F.abs(v) < 1e300, v)
    first, last, n = known.agg(F.min(finite), F.max(finite), F.count(F.lit(1))).first()
    width = valid.agg(F.percentile_approx(high - low, 0.5)).first()[0]
    span = (last - first) if n and last is not None else 0.0
    k = 0 if not span or not width else min(LEVELS, max(0, math.ceil(math.log2(max(1.0, 2 * span / width)))))
    cells, step = 1 << k, (span / (1 << k)) or 1.0
    start = first or 0.0

    def cell(x: Column) -> Column:  # never falls as x grows, so what lies between two cells lies between their values
        return F.floor(F.least(F.greatest((x - F.lit(start)) / F.lit(step), F.lit(0.0)), F.lit(float(cells - 1)))).cast("long")

    def bin_of(level: Column | int, number: Column) -> Column:
        return F.struct((F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"), number.alias("no"))

    a, b = F.col("__a"), F.col("__b")
    bins = [bin_of(-1, a), F.when(b != a, bin_of(-1, b))]
    for j in range(k + 1):
        left, right = F.shiftright(a + (1 << j), j), F.shiftright(b, j)  # of the cells a + 1, ..., b - 1
        bins += [F.when((left < right) & (left % 2 == 1), bin_of(j, left)), F.when((left < right) & (right % 2 == 1), bin_of(j, right - 1))]
    held = valid.withColumns({"__a": cell(low), "__b": cell(high)}).withColumn("__bin", F.explode(F.array_compact(F.array(*bins))))
    held = held.drop("__a", "__b")
    levels = sorted(r.level for r in held.select("__bin.level").distinct().collect())  # LEVELS + 2 at most
    spots = F.array(*[bin_of(j, F.shiftright(F.col("__cell"), max(j, 0))) for j in levels]) if levels else F.array().cast(
        "array<struct<level:int,no:bigint>>")
    placed = known.withColumn("__cell", cell(v)).withColumn("__spot", F.explode(spots)).drop("__cell")

    # fewer full bins than partitions on each level
    full = max(BIN_ROWS, n // shuffle_partitions(points.sparkSession))
    large = placed.groupBy(F.col("__spot").alias("__full")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > full)
    large = F.broadcast(large.select("__full", F.ceil(F.col("__n") / full).cast("int").alias("__g")))
    mine = F.pmod(F.xxhash64(*points.columns), F.coalesce("__g", F.lit(1))).cast("int")
    left = placed.join(large, F.col("__spot") == F.col("__full"), "left").withColumn("__part", mine).drop("__full", "__g")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__g", F.lit(1)) - 1))
    right = held.join(large, F.col("__bin") == F.col("__full"), "left").withColumn("__copy", copies).drop("__full", "__g")
    within = (F.col("__bin.level") >= 0) | ((v >= low) & (v < high))
    met = left.join(right, (F.col("__spot") == F.col("__bin")) & (F.col("__part") == F.col("__copy")) & within)
    return met.select(*points.columns, *ranges.columns)
