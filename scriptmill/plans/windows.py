"""Window functions on groups of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.money import cents
from scriptmill.operators import frames
from scriptmill.operators.skew import with_group_stats
from scriptmill.plans.registry import query
from scriptmill.sources.tables import table


def orders(spark, d, *cols):
    return table(spark, d, "orders", *cols)


def _ranked(spark, d):
    base = orders(spark, d, "o_orderkey", "o_orderstatus", "o_totalprice")
    return frames.with_ranks(base, ["o_orderstatus"], "o_totalprice", ["o_orderkey"], descending=True)


@query(
    "w01_row_number",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn
FROM orders""",
)
def w01(spark, d):
    return _ranked(spark, d).select("o_orderkey", F.col("row_number").alias("rn"))


@query(
    "w02_rank",
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS rk FROM orders",
)
def w02(spark, d):
    return _ranked(spark, d).select("o_orderkey", F.col("rank").alias("rk"))


@query(
    "w03_dense_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS dr FROM lineitem""",
)
def w03(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag",
                  "l_quantity")
    # The distinct values are ranked and meet the rows by value, so rows that share a value need no common task.
    values = frames.with_ranks(lines.select("l_returnflag", "l_quantity").distinct(), ["l_returnflag"], "l_quantity", []).select("l_returnflag", "l_quantity", F.col("dense_rank").alias("dr"))
    return lines.join(values, ["l_returnflag", "l_quantity"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "dr"
    )


@query(
    "w03_dense_rank_prices",
    "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS dr FROM orders",
)
def w03_prices(spark, d):
    return _ranked(spark, d).select("o_orderkey", F.col("dense_rank").alias("dr"))


@query(
    "w04_ntile",
    """SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS tile
FROM orders""",
)
def w04(spark, d):
    return _ranked(spark, d).select("o_orderkey", frames.ntile(7).alias("tile"))


@query(
    "w05_percent_rank",
    """SELECT o_orderkey, percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS pr FROM orders""",
)
def w05(spark, d):
    return _ranked(spark, d).select("o_orderkey", frames.percent_rank().alias("pr"))


def _by_date(spark, d, preceding, following, exprs):
    base = orders(spark, d, "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return frames.over_rows(base, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], preceding, following, exprs)


@query(
    "w06_lag",
    """SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS prev_price, lag(o_orderkey, 3, -1) OVER w AS key3
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def w06(spark, d):
    return _by_date(spark, d, 3, 0, {
        "prev_price": lambda w: F.lag("o_totalprice", 1, 0.0).over(w),
        "key3": lambda w: F.lag("o_orderkey", 3, -1).over(w),
    }).select("o_orderkey", "prev_price", "key3")


@query(
    "w07_lead",
    """SELECT o_orderkey, lead(o_totalprice, 1, 0.0) OVER w AS next_price, lead(o_orderkey, 2, -1) OVER w AS key2
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def w07(spark, d):
    return _by_date(spark, d, 0, 2, {
        "next_price": lambda w: F.lead("o_totalprice", 1, 0.0).over(w),
        "key2": lambda w: F.lead("o_orderkey", 2, -1).over(w),
    }).select("o_orderkey", "next_price", "key2")


@query(
    "w08_first_last_value",
    """SELECT o_orderkey, first_value(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_price,
last_value(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def w08(spark, d):
    base = orders(spark, d, "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    place = F.struct("o_orderdate", "o_orderkey")
    return with_group_stats(base, ["o_orderstatus"], [
        F.min_by("o_totalprice", place).alias("first_price"), F.max_by("o_totalprice", place).alias("last_price"),
    ]).select("o_orderkey", "first_price", "last_price")


@query(
    "w09_running_total",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) OVER (PARTITION BY o_orderstatus
ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders""",
)
def w09(spark, d):
    base = orders(spark, d, "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return frames.with_running_sum(
        base, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], {"running": cents("o_totalprice")}
    ).select("o_orderkey", F.col("running").cast("double").alias("running"))


def _avg(w):
    value = cents("o_totalprice")
    return F.sum(value).over(w).cast("double") / F.count(value).over(w)


@query(
    "w10_moving_average",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) OVER w AS DOUBLE) / count(*) OVER w AS avg3
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def w10(spark, d):
    return _by_date(spark, d, 2, 0, {"avg3": lambda w: _avg(w.rowsBetween(-2, 0))}).select("o_orderkey", "avg3")


@query(
    "w11_centered_frame",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) OVER w AS DOUBLE) / count(*) OVER w AS avg3,
max(o_totalprice) OVER w AS max3 FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def w11(spark, d):
    return _by_date(spark, d, 1, 1, {
        "avg3": lambda w: _avg(w.rowsBetween(-1, 1)),
        "max3": lambda w: F.max("o_totalprice").over(w.rowsBetween(-1, 1)),
    }).select("o_orderkey", "avg3", "max3")


@query(
    "w12_range_interval",
    """SELECT event_id, count(*) OVER w AS n_day, CAST(sum(CAST(value AS DECIMAL(22,2))) OVER w AS DOUBLE) AS sum_day
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
)
def w12(spark, d):
    base = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    return frames.sums_over_time(base, ["user_id"], "ts", 86400, {"n_day": F.lit(1), "sum_day": cents("value")}).select(
        "event_id", "n_day", F.col("sum_day").cast("double").alias("sum_day"))


@query(
    "w12_range_interval_by_type",
    """SELECT event_id, count(*) OVER w AS n_hours, CAST(sum(CAST(value AS DECIMAL(22,2))) OVER w AS DOUBLE) AS sum_hours
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
)
def w12_types(spark, d):
    """Few groups, each with a large part of the rows."""
    base = table(spark, d, "events", "event_id", "event_type", "ts", "value")
    return frames.sums_over_time(base, ["event_type"], "ts", 6 * 3600, {"n_hours": F.lit(1), "sum_hours": cents("value")}).select(
        "event_id", "n_hours", F.col("sum_hours").cast("double").alias("sum_hours"))


@query(
    "w12_range_extremes",
    """SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high, (min({'t': ts, 'e': event_id, 'v': value}) OVER w).v AS first_value
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
)
def w12_extremes(spark, d):
    """Few groups, each with a large part of the rows; extremes cannot be taken back as sums can."""
    base = table(spark, d, "events", "event_id", "event_type", "ts", "value")
    found = frames.extremes_over_time(base, ["event_type"], "ts", 6 * 3600, {
        "low": (F.col("value"), "min"), "high": (F.col("value"), "max"), "first": (F.struct("ts", "event_id", "value"), "min")})
    return found.select("event_id", "low", "high", F.col("first.value").alias("first_value"))


@query(
    "w13_difference_from_average",
    """SELECT c_custkey, c_acctbal - CAST(sum(CAST(c_acctbal AS DECIMAL(22,2))) OVER w AS DOUBLE) / count(*) OVER w AS diff
FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""",
)
def w13(spark, d):
    base = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    value = cents("c_acctbal")
    mean = (F.sum(value).cast("double") / F.count(F.lit(1))).alias("mean")
    return with_group_stats(base, ["c_mktsegment"], [mean]).select(
        "c_custkey", (F.col("c_acctbal") - F.col("mean")).alias("diff")
    )


@query(
    "w14_partition_aggregates",
    """SELECT c_custkey, CAST(sum(CAST(c_acctbal AS DECIMAL(22,2))) OVER w AS DOUBLE) AS total, min(c_acctbal) OVER w AS low,
max(c_acctbal) OVER w AS high, count(*) OVER w AS n, round(stddev_samp(c_acctbal) OVER w, 4) AS sd,
round(var_pop(c_acctbal) OVER w, 2) AS vp FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""",
)
def w14(spark, d):
    base = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return with_group_stats(base, ["c_mktsegment"], [
        F.sum(cents("c_acctbal")).cast("double").alias("total"), F.min("c_acctbal").alias("low"),
        F.max("c_acctbal").alias("high"), F.count(F.lit(1)).alias("n"),
        F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_pop("c_acctbal"), 2).alias("vp"),
    ]).select("c_custkey", "total", "low", "high", "n", "sd", "vp")


@query(
    "w15_named_windows",
    """SELECT event_id, row_number() OVER u AS user_no, lag(event_type) OVER u AS prev_type,
count(*) OVER (PARTITION BY event_type) AS n_type
FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def w15(spark, d):
    base = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    numbered = frames.with_row_number(base, ["user_id"], ["ts", "event_id"], "user_no")
    looked = frames.over_rows(numbered, ["user_id"], ["ts", "event_id"], 1, 0, {
        "prev_type": lambda w: F.lag("event_type").over(w)})
    return with_group_stats(looked, ["event_type"], [F.count(F.lit(1)).alias("n_type")]).select(
        "event_id", "user_no", "prev_type", "n_type"
    )


@query(
    "w16_top_n_per_group",
    """SELECT o_orderkey, o_custkey, place FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey
ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""",
)
def w16(spark, d):
    base = orders(spark, d, "o_orderkey", "o_custkey", "o_totalprice")
    return frames.top_per_group(base, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select(
        "o_orderkey", "o_custkey", "place"
    )


@query(
    "w17_qualify",
    """SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem
QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) <= 2""",
)
def w17(spark, d):
    base = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    return frames.top_ranks_per_group(base, ["l_suppkey"], "l_quantity", 2).drop("place")


@query(
    "w18_surrogate_code",
    """SELECT o_orderkey, 'G' || strftime(o_orderdate, '%Y%m') || lpad(CAST(row_number() OVER (
PARTITION BY strftime(o_orderdate, '%Y%m') ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 7, '0') AS code FROM orders""",
)
def w18(spark, d):
    base = orders(spark, d, "o_orderkey", "o_orderdate").withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    return frames.with_row_number(base, ["month"], ["o_orderdate", "o_orderkey"], "n").select(
        "o_orderkey", frames.surrogate_code(F.concat(F.lit("G"), "month"), F.col("n")).alias("code")
    )


@query(
    "w19_global_numbering",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders",
)
def w19(spark, d):
    base = orders(spark, d, "o_orderkey", "o_orderdate")
    return frames.with_row_number(base, [], ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", "n")


@query(
    "w20_window_over_union",
    """SELECT kind, id, rank() OVER (PARTITION BY kind ORDER BY amount DESC) AS rk FROM (
SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS amount FROM customer
UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier)""",
)
def w20(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"),
                                           F.col("c_acctbal").alias("amount"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"),
                                           F.col("s_acctbal").alias("amount"))
    return frames.with_ranks(c.unionByName(s), ["kind"], "amount", ["id"],
                             descending=True).select("kind", "id", F.col("rank").alias("rk"))


@query(
    "w20_window_after_lateral_view",
    """SELECT doc_id, word, n, place FROM (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id
ORDER BY n DESC, word) AS place FROM (SELECT doc_id, word, count(*) AS n FROM (
SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY doc_id, word)) WHERE place <= 2""",
)
def w20_words(spark, d):
    words = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return frames.top_per_group(counts, ["doc_id"], [F.desc("n"), "word"], 2).select("doc_id", "word", "n", "place")
