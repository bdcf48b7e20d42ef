"""Window functions for groups of any size.

A plain window puts a whole group into one task. Here the groups that hold more rows than a shuffle partition would hold on
average (there can be no more of them than partitions, so their list can be broadcast) are range-partitioned by their full
order, tie break included, and stored with the number of the partition and the place of the row in it. A partition is cut
where the data say so: inside a group, a day or a run of equal values. One row per (partition, group) then tells what lies
before a partition, and partitions see each other through these rows only. All other groups are windowed as usual. NULL
keys form a group, as in a window.

Frames of a fixed number of rows are evaluated inside blocks of consecutive rows, with the rows a frame reaches over a
block's edge copied to the neighbour block; time frames are differences of running sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptmill.operators.skew import group_key, hot_groups
from scriptmill.session import shuffle_partitions, store

# Rows of a block of a large group; a block is longer where a frame is.
BLOCK_ROWS = 4096


def _order(columns: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


@dataclass
class Split:
    """``plain``: rows of groups that fit a task. ``cut``: the other rows, stored in order, with __part, __at (place in the
    part) and __group; None if there are none."""

    plain: DataFrame | None
    cut: DataFrame | None


def split(df: DataFrame, keys: list[str], order: list[Column | str]) -> Split:
    """Without keys the whole table is one group."""
    spark = df.sparkSession
    rows = df.withColumn("__group", group_key(keys) if keys else F.struct(F.lit(0).alias("k0")))
    plain, large = None, rows
    if keys:
        hot = hot_groups(df, keys).select(F.col("__group").alias("__hot"))
        if not hot.limit(1).count():
            return Split(rows, None)
        same = F.col("__group") == F.col("__hot")
        plain, large = rows.join(F.broadcast(hot), same, "left_anti"), rows.join(F.broadcast(hot), same, "left_semi")
    # the row's hash parts rows that the order leaves equal (maps cannot be hashed)
    hashed = [F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)])]
    by = [F.col("__group"), *_order(order), *hashed]
    placed = large.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()  # partition number in the upper bits, place in the lower 33
    return Split(plain, store(placed.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn(
        "__at", place.bitwiseAND((1 << 33) - 1))))


def _spans(cut: DataFrame, aggs: list[Column]) -> DataFrame:
    """(__p, __g, aggregates) per partition and group: a row per group and one more per further partition, so no more
    than two per partition."""
    return cut.groupBy(F.col("__part").alias("__p"), F.col("__group").alias("__g")).agg(*aggs)


def _earlier() -> WindowSpec:
    return Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)


def _whole() -> WindowSpec:
    return Window.partitionBy("__g")


def _meet(cut: DataFrame, spans: DataFrame) -> DataFrame:
    return cut.join(F.broadcast(spans), (F.col("__part") == F.col("__p")) & (F.col("__group") == F.col("__g"))).drop("__p", "__g")


def _joined(parts: list[DataFrame | None], columns: list[str]) -> DataFrame:
    found = [p.select(*columns) for p in parts if p is not None]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def with_row_number(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "row_number") -> DataFrame:
    """Consecutive numbers 1.. inside each group; no keys numbers the whole table."""
    two = split(df, keys, order)
    plain = cut = None
    if two.plain is not None:
        plain = two.plain.withColumn(name, F.row_number().over(Window.partitionBy("__group").orderBy(*_order(order))).cast("long"))
    if two.cut is not None:
        spans = _spans(two.cut, [F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")]).withColumn(
            "__before", F.coalesce(F.sum("__n").over(_earlier()), F.lit(0)))
        cut = _meet(two.cut, spans).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1)
    return _joined([plain, cut], [c for c in df.columns if c != name] + [name])


def with_ranks(df: DataFrame, keys: list[str], by: str, tie_break: list[str], descending: bool = False) -> DataFrame:
    """Adds row_number, rank, dense_rank and group_rows; ``by`` is ranked, ``tie_break`` only orders row_number.

    Rows that share one value may lie in several partitions: rank and dense rank of a partition's first value go on where
    it is the last one of the partition before.
    """
    lead = F.col(by).desc() if descending else F.col(by).asc()
    two = split(df, keys, [lead, *tie_break])
    plain = cut = None
    if two.plain is not None:
        ranked = Window.partitionBy("__group").orderBy(lead)
        numbered = Window.partitionBy("__group").orderBy(lead, *_order(tie_break))
        plain = two.plain.withColumns({
            "row_number": F.row_number().over(numbered).cast("long"), "rank": F.rank().over(ranked).cast("long"),
            "dense_rank": F.dense_rank().over(ranked).cast("long"),
            "group_rows": F.count(F.lit(1)).over(Window.partitionBy("__group"))})
    if two.cut is not None:
        local = Window.partitionBy("__part", "__group").orderBy(lead)
        rows = two.cut.withColumns({"__r": F.rank().over(local).cast("long"), "__d": F.dense_rank().over(local).cast("long")})
        value = F.struct(F.col(by).alias("v"))
        spans = _spans(rows, [
            F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"), F.max("__d").alias("__values"),
            F.max("__r").alias("__last_rank"), F.min_by(value, "__at").alias("__head"), F.max_by(value, "__at").alias("__tail")])
        ordered = Window.partitionBy("__g").orderBy("__p")
        before = lambda c: F.coalesce(F.sum(c).over(_earlier()), F.lit(0))
        goes_on = F.coalesce(F.col("__head") == F.lag("__tail").over(ordered), F.lit(False))
        spans = spans.withColumn("__on", goes_on).withColumn("__before", before("__n"))
        spans = spans.withColumn("__d0", before(F.col("__values") - F.col("__on").cast("long")) - F.col("__on").cast("long"))
        # rank of the last value of a partition; unknown where the partition only goes on with the value before it
        tail = F.when(~(F.col("__on") & (F.col("__values") == 1)), F.col("__before") + F.col("__last_rank"))
        spans = spans.withColumn("__tail_rank", tail).withColumn("__run", F.last("__tail_rank", ignorenulls=True).over(_earlier()))
        spans = spans.withColumn("__all", F.sum("__n").over(_whole())).drop("__values", "__last_rank", "__head", "__tail",
                                                                              "__tail_rank", "__n")
        met = _meet(rows, spans)
        cut = met.withColumns({
            "row_number": F.col("__at") - F.col("__first") + F.col("__before") + 1,
            "rank": F.when(F.col("__on") & (F.col("__r") == 1), F.col("__run")).otherwise(F.col("__before") + F.col("__r")),
            "dense_rank": F.col("__d") + F.col("__d0"), "group_rows": F.col("__all")})
    return _joined([plain, cut], [*df.columns, "row_number", "rank", "dense_rank", "group_rows"])


def ntile(n: int, row_number: str = "row_number", group_rows: str = "group_rows") -> Column:
    """Tile of a row: the first (rows mod n) tiles hold one row more."""
    rn, rows = F.col(row_number), F.col(group_rows)
    small = F.floor(rows / n)
    larger = rows % n
    head = larger * (small + 1)
    return F.when(rn <= head, F.floor((rn - 1) / (small + 1)) + 1).otherwise(
        larger + F.floor((rn - 1 - head) / F.greatest(small, F.lit(1))) + 1
    )


def percent_rank(rank: str = "rank", group_rows: str = "group_rows") -> Column:
    return F.when(F.col(group_rows) <= 1, F.lit(0.0)).otherwise((F.col(rank) - 1) / (F.col(group_rows) - 1))


def with_running_sum(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """Adds, per name, the sum of the value from the group's first row to the current one."""
    two = split(df, keys, order)
    rows_before = [Window.unboundedPreceding, Window.currentRow]
    plain = cut = None
    if two.plain is not None:
        so_far = Window.partitionBy("__group").orderBy(*_order(order)).rowsBetween(*rows_before)
        plain = two.plain.withColumns({n: F.coalesce(F.sum(v).over(so_far), F.lit(0)) for n, v in values.items()})
    if two.cut is not None:
        so_far = Window.partitionBy("__part", "__group").orderBy("__at").rowsBetween(*rows_before)
        spans = _spans(two.cut, [F.coalesce(F.sum(v), F.lit(0)).alias(f"__sum_{n}") for n, v in values.items()])
        spans = spans.select("__p", "__g", *[
            F.coalesce(F.sum(f"__sum_{n}").over(_earlier()), F.lit(0)).alias(f"__before_{n}") for n in values])
        local = two.cut.withColumns({f"__so_far_{n}": F.coalesce(F.sum(v).over(so_far), F.lit(0)) for n, v in values.items()})
        cut = _meet(local, spans).withColumns({n: F.col(f"__so_far_{n}") + F.col(f"__before_{n}") for n in values})
    kept = [c for c in df.columns if c not in values]
    return _joined([plain, cut], [*kept, *values])


def with_running_extreme(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds, per name, the smallest or largest value ("min" or "max") from the group's first row to the current one."""
    two = split(df, keys, order)
    find = {n: (F.min, F.least) if kind == "min" else (F.max, F.greatest) for n, (_, kind) in values.items()}
    rows_before = [Window.unboundedPreceding, Window.currentRow]
    plain = cut = None
    if two.plain is not None:
        so_far = Window.partitionBy("__group").orderBy(*_order(order)).rowsBetween(*rows_before)
        plain = two.plain.withColumns({n: find[n][0](v).over(so_far) for n, (v, _) in values.items()})
    if two.cut is not None:
        so_far = Window.partitionBy("__part", "__group").orderBy("__at").rowsBetween(*rows_before)
        spans = _spans(two.cut, [find[n][0](v).alias(f"__own_{n}") for n, (v, _) in values.items()])
        spans = spans.select("__p", "__g", *[find[n][0](f"__own_{n}").over(_earlier()).alias(f"__before_{n}") for n in values])
        local = two.cut.withColumns({f"__so_far_{n}": find[n][0](v).over(so_far) for n, (v, _) in values.items()})
        cut = _meet(local, spans).withColumns({n: find[n][1](f"__so_far_{n}", f"__before_{n}") for n in values})
    kept = [c for c in df.columns if c not in values]
    return _joined([plain, cut], [*kept, *values])


def with_latest(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the last value, from the group's first row to the current one, that is not NULL."""
    two = split(df, keys, order)
    rows_before = [Window.unboundedPreceding, Window.currentRow]
    plain = cut = None
    if two.plain is not None:
        so_far = Window.partitionBy("__group").orderBy(*_order(order)).rowsBetween(*rows_before)
        plain = two.plain.withColumn(name, F.last(value, ignorenulls=True).over(so_far))
    if two.cut is not None:
        so_far = Window.partitionBy("__part", "__group").orderBy("__at").rowsBetween(*rows_before)
        newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias("__newest")
        spans = _spans(two.cut, [newest]).select("__p", "__g", F.last("__newest", ignorenulls=True).over(_earlier()).alias("__carried"))
        met = _meet(two.cut.withColumn("__seen", F.last(value, ignorenulls=True).over(so_far)), spans)
        cut = met.withColumn(name, F.coalesce("__seen", "__carried"))
    return _joined([plain, cut], [*df.columns, name])


def over_rows(df: DataFrame, keys: list[str], order: list[Column | str], preceding: int, following: int,
              exprs: dict[str, Callable[[WindowSpec], Column]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds columns computed over a window that looks at most ``preceding`` rows back and ``following`` ahead.

    Each expression gets the window without a frame, and sets its own within these limits.
    """
    two = split(df, keys, order)
    plain = cut = None
    if two.plain is not None:
        window = Window.partitionBy("__group").orderBy(*_order(order))
        plain = two.plain
        for name, build in exprs.items():
            plain = plain.withColumn(name, build(window))
    if two.cut is not None:
        block = max(block_rows, preceding, following)
        spans = _spans(two.cut, [F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")]).withColumn(
            "__before", F.coalesce(F.sum("__n").over(_earlier()), F.lit(0)))
        rows = _meet(two.cut, spans).withColumn("__no", F.col("__at") - F.col("__first") + F.col("__before"))
        rows = rows.withColumn("__block", F.floor(F.col("__no") / block)).withColumn("__in", F.col("__no") % block)
        homes = F.array_compact(F.array(
            F.col("__block"),
            F.when(F.col("__in") >= block - preceding, F.col("__block") + 1),
            F.when((F.col("__in") < following) & (F.col("__block") > 0), F.col("__block") - 1)))
        cut = rows.withColumn("__home", F.explode(homes))
        window = Window.partitionBy("__group", "__home").orderBy("__no")
        for name, build in exprs.items():
            cut = cut.withColumn(name, build(window))
        cut = cut.where("__home = __block")
    return _joined([plain, cut], [*[c for c in df.columns if c not in exprs], *exprs])


def sums_over_time(df: DataFrame, keys: list[str], ts: str, seconds: int, values: dict[str, Column]) -> DataFrame:
    """Adds, per name, the sum of the value over the frame [ts - seconds, ts] of the same group (RANGE ... PRECEDING); NULL
    if the frame has no value. Values must be whole numbers or decimals, whose running sums are exact.

    Values are first summed per time, the sums added up along the time (``with_running_sum``), and the sum before the frame
    is carried to its end (``with_latest``); rows then meet the sums of their time. Rows without a time form their own frame.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("__spot", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], at.alias("us")))
    parts = {f"{what}{i}": agg for i, v in enumerate(values.values()) for what, agg in (("s", F.sum(v)), ("c", F.count(v)))}
    times = rows.groupBy("__spot").agg(*[agg.alias(n) for n, agg in parts.items()]).select("__spot.*", *parts)
    groups = [f"k{i}" for i in range(len(keys))]
    running = store(with_running_sum(times.where("us IS NOT NULL"), groups, ["us"], {f"r{n}": F.col(n) for n in parts}))
    sums = F.struct(*[f"r{n}" for n in parts])
    marks = running.select(*groups, "us", F.lit(0).alias("side"), sums.alias("sum"), F.lit(None).cast("struct<%s>" % ",".join(
        f"r{n}:{dict(running.dtypes)[f'r{n}']}" for n in parts)).alias("own"))
    asks = running.select(*groups, (F.col("us") - seconds * 1_000_000 - 1).alias("us"), F.lit(1).alias("side"),
                          F.lit(None).cast(marks.schema["sum"].dataType).alias("sum"), sums.alias("own"))
    found = with_latest(marks.unionByName(asks), groups, ["us", "side"], "sum", "before").where("side = 1")
    in_frame = {n: F.col("own")[f"r{n}"] - F.coalesce(F.col("before")[f"r{n}"], F.lit(0)) for n in parts}
    framed = found.select(F.struct(*groups, (F.col("us") + seconds * 1_000_000 + 1).alias("us")).alias("__at"),
                          *[c.alias(n) for n, c in in_frame.items()])
    timeless = times.where("us IS NULL").select(F.struct(*groups, "us").alias("__at"), *parts)
    framed = store(framed.unionByName(timeless))
    met = rows.join(framed, F.col("__spot") == F.col("__at"))
    return met.select(*df.columns, *[F.when(F.col(f"c{i}") > 0, F.col(f"s{i}")).alias(n) for i, n in enumerate(values)])


def extremes_over_time(df: DataFrame, keys: list[str], ts: str, seconds: int, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds, per name, the smallest or largest value ("min" or "max") over the frame [ts - seconds, ts] of the same group; NULL
    if the frame has no value. A value may be of any ordered type: the smallest struct of (ts, tie break, v) holds the first v.

    Time is cut into stretches as long as the frame. A frame then is the end of one stretch and the beginning of the next,
    so two running extremes, one backwards and one forwards, give that of any frame without a structure over all rows. A
    group is spread over its stretches, and a stretch larger than a task is cut further (``split``). Values meet per time
    first; rows without a time form their own frame."""
    if seconds <= 0:
        raise ValueError("a frame has a length")
    at, length = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    both = {n: F.min if kind == "min" else F.max for n, (_, kind) in values.items()}
    names = {n: f"v{i}" for i, n in enumerate(values)}
    rows = df.withColumn("__spot", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], at.alias("us")))
    times = store(rows.groupBy("__spot").agg(*[both[n](v).alias(names[n]) for n, (v, _) in values.items()]).select("__spot.*", *names.values()))
    groups = [f"k{i}" for i in range(len(keys))]
    timed = times.where("us IS NOT NULL").withColumn("stretch", F.floor(F.col("us") / length))
    running = {names[n]: (F.col(names[n]), kind) for n, (_, kind) in values.items()}
    begun = with_running_extreme(timed, [*groups, "stretch"], ["us"], running)
    kinds = dict(timed.dtypes)
    asks = timed.select(*groups, (F.col("us") - length).alias("us"), (F.col("stretch") - 1).alias("stretch"), F.lit(1).alias("side"),
                        *[F.lit(None).cast(kinds[v]).alias(v) for v in names.values()])
    marks = timed.select(*groups, "us", "stretch", F.lit(0).alias("side"), *names.values())
    ended = with_running_extreme(marks.unionByName(asks), [*groups, "stretch"], [F.col("us").desc(), "side"], running).where("side = 1")
    spot = lambda us: F.struct(*groups, us.alias("us")).alias("__at")
    halves = begun.select(spot(F.col("us")), *names.values()).unionByName(ended.select(spot(F.col("us") + length), *names.values()))
    framed = halves.groupBy("__at").agg(*[both[n](names[n]).alias(names[n]) for n in values])
    framed = store(framed.unionByName(times.where("us IS NULL").select(spot(F.col("us")), *names.values())))
    met = rows.join(framed, F.col("__spot") == F.col("__at"))
    return met.select(*df.columns, *[F.col(v).alias(n) for n, v in names.items()])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """First k rows per group. Spark cuts each task's rows of a group to the limit before the shuffle
    (WindowGroupLimit), so a hot group arrives small."""
    window = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)


def top_ranks_per_group(df: DataFrame, keys: list[str], by: str, k: int) -> DataFrame:
    """All rows of rank <= k, largest value of ``by`` first. Any number of rows may share a value, so the values are
    counted and ranked instead of the rows: at most k values of a group can have rank <= k, and the rows meet them in a
    join on (keys, value)."""
    value = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(by).alias("v")).alias("__value")
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).select(
        "__value", "__n", *[F.col("__value")[f"k{i}"].alias(f"__k{i}") for i in range(len(keys))],
        F.col("__value")["v"].alias("__v"))
    groups = [f"__k{i}" for i in range(len(keys))]
    few = top_per_group(counts, groups, [F.col("__v").desc_nulls_last()], k)
    before = Window.partitionBy(*groups).orderBy(F.col("__v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = few.select("__value", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1).alias("place")).where(
        F.col("place") <= k)
    return df.withColumn("__value", value).join(ranked, "__value").drop("__value")


def surrogate_code(prefix: Column, number: Column, width: int = 7) -> Column:
    """prefix || zero-padded number; a longer number is kept whole."""
    text = number.cast("string")
    return F.concat(prefix, F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))
