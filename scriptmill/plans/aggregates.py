"""Grouping and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.money import money_avg, money_sum
from scriptmill.operators.skew import two_phase_distinct
from scriptmill.plans.registry import query
from scriptmill.session import store
from scriptmill.sources.tables import register_views, table


def money(col: str) -> str:
    return f"CAST(sum(CAST({col} AS DECIMAL(22,2))) AS DOUBLE)"


@query("g01_group_by", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {money('l_extendedprice')} AS total,
{money('l_extendedprice')} / count(*) AS mean, min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def g01(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), money_sum("l_extendedprice").alias("total"),
        money_avg("l_extendedprice").alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("g02_global", f"SELECT count(*) AS n, {money('o_totalprice')} AS total, max(o_totalprice) AS high FROM orders")
def g02(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total"),
                                         F.max("o_totalprice").alias("high"))


@query("g03_having", f"""SELECT o_custkey, count(*) AS n, {money('o_totalprice')} AS total FROM orders GROUP BY o_custkey
HAVING count(*) > 12 AND {money('o_totalprice')} > 3000000""")
def g03(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total")).where("n > 12 AND total > 3000000")


@query("g04_count_distinct", """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers,
count(DISTINCT (o_custkey, o_orderpriority)) AS pairs FROM orders GROUP BY o_orderstatus""")
def g04(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_custkey", "o_orderpriority").alias("pairs"))


@query("g05_approx_distinct", "SELECT o_orderstatus, true AS close FROM orders GROUP BY o_orderstatus")
def g05(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.approx_count_distinct("o_custkey", 0.01).alias("a"), F.count_distinct("o_custkey").alias("n")
    ).select("o_orderstatus", (F.abs(F.col("a") - F.col("n")) <= F.col("n") * 0.05).alias("close"))


# Registers of a sketch: 2^14, a standard error of 0.8 %.
SKETCH_LG = 14


@query("g05_stored_sketches", """SELECT strftime(ts, '%Y-%m') AS month, event_type, count(DISTINCT event_id // 3) AS n_exact, true AS close
FROM events GROUP BY ALL""")
def g05_sketches(spark, d):
    """Distinct counts that can be added up later: a sketch per day and type is stored, and months are rolled up from the
    sketches alone. The exact count stands beside the estimate."""
    rows = table(spark, d, "events", "event_id", "event_type", "ts").withColumn("who", F.floor(F.col("event_id") / 3))
    days = store(rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.hll_sketch_agg("who", SKETCH_LG).alias("sketch")))
    months = days.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "event_type").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count_distinct("who").alias("n_exact"))
    return months.join(exact, ["month", "event_type"]).select(
        "month", "event_type", "n_exact", (F.abs(F.col("estimate") - F.col("n_exact")) <= F.col("n_exact") * 0.05).alias("close"))


GROUPED = f"count(*) AS n, {money('o_totalprice')} AS total, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS gid"


def _grouped():
    return [F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total"), F.grouping_id().alias("gid")]


@query("g06_grouping_sets", f"""SELECT o_orderstatus, o_orderpriority, {GROUPED} FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
def g06(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([(s, p), (s,), ()], s, p).agg(*_grouped())


@query("g07_rollup", f"SELECT o_orderstatus, o_orderpriority, {GROUPED} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def g07(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(*_grouped())


@query("g07_rollup_geo", """SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def g07_geo(spark, d):
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).rollup(
        "r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("g08_cube", f"SELECT o_orderstatus, o_orderpriority, {GROUPED} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def g08(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(*_grouped())


@query("g09_filter_clause", f"""SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS n_debt,
CAST(sum(CAST(c_acctbal AS DECIMAL(22,2))) FILTER (WHERE c_acctbal > 5000) AS DOUBLE) AS rich FROM customer GROUP BY c_mktsegment""")
def g09(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.expr("count(*) FILTER (WHERE c_acctbal < 0)").alias("n_debt"),
        F.expr("cast(sum(cast(c_acctbal AS decimal(22,2))) FILTER (WHERE c_acctbal > 5000) AS double)").alias("rich"))


@query("g10_conditional_count", """SELECT l_suppkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_returned,
count(CASE WHEN l_discount > 0.05 THEN l_partkey END) AS n_discounted FROM lineitem GROUP BY l_suppkey""")
def g10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned"),
        F.count(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("n_discounted"))


KEYS14 = ["r_name", "n_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "l_linenumber",
          "p_type", "p_brand", "s_nationkey", "yr", "mon", "big"]
G11_FROM = """(SELECT r_name, n_name, c_mktsegment, o_orderstatus, o_orderpriority, l_returnflag, l_linestatus, l_linenumber,
p_type, p_brand, s_nationkey, year(l_shipdate) AS yr, month(l_shipdate) AS mon, l_quantity > 25 AS big, l_quantity, l_extendedprice,
l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey)"""


@query("g11_many_keys", f"""SELECT {', '.join(KEYS14)}, {money('l_quantity')} AS q, {money('l_extendedprice')} AS p,
{money('l_discount')} AS di, {money('l_tax')} AS tx FROM {G11_FROM} GROUP BY {', '.join(KEYS14)}""")
def g11(spark, d):
    t = lambda n: table(spark, d, n)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumns({"yr": F.year("l_shipdate").cast("bigint"), "mon": F.month("l_shipdate").cast("bigint"),
                      "big": F.col("l_quantity") > 25})
    )
    measures = {"q": "l_quantity", "p": "l_extendedprice", "di": "l_discount", "tx": "l_tax"}
    return joined.groupBy(*KEYS14).agg(*[money_sum(c).alias(a) for a, c in measures.items()])


@query("g12_decimal_sum", """SELECT l_suppkey, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))
* CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))) AS DECIMAL(22,2)) AS VARCHAR) AS revenue FROM lineitem GROUP BY l_suppkey""")
def g12(spark, d):
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(net).cast("decimal(22,2)").cast("string").alias("revenue"))


@query("g13_filtered_sums", f"""SELECT l_returnflag, l_suppkey, {money('l_extendedprice')} AS total FROM lineitem
WHERE l_linenumber NOT IN (6, 7) AND l_discount <> 0 GROUP BY l_returnflag, l_suppkey HAVING {money('l_extendedprice')} <> 0""")
def g13(spark, d):
    return table(spark, d, "lineitem").where(~F.col("l_linenumber").isin(6, 7) & (F.col("l_discount") != 0)).groupBy(
        "l_returnflag", "l_suppkey").agg(money_sum("l_extendedprice").alias("total")).where("total <> 0")


@query("g14_group_by_expression", """SELECT strftime(o_orderdate, '%Y%m') AS month, substr(o_orderpriority, 1, 1) AS prio,
count(*) AS n FROM orders GROUP BY 1, 2""")
def g14(spark, d):
    return table(spark, d, "orders").groupBy(
        F.date_format("o_orderdate", "yyyyMM").alias("month"), F.substring("o_orderpriority", 1, 1).alias("prio")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("g15_spread_measures", """SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS sds, round(stddev_pop(o_totalprice), 3) AS sdp,
round(var_samp(o_totalprice), 0) AS vs, round(var_pop(o_totalprice), 0) AS vp FROM orders GROUP BY o_orderstatus""")
def g15(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.round(F.stddev_samp("o_totalprice"), 3).alias("sds"), F.round(F.stddev_pop("o_totalprice"), 3).alias("sdp"),
        F.round(F.var_samp("o_totalprice"), 0).alias("vs"), F.round(F.var_pop("o_totalprice"), 0).alias("vp"))


@query("g16_collect", """SELECT l_suppkey, string_agg(k, ',' ORDER BY k) AS flags, string_agg(k || ':' || n, ',' ORDER BY k) AS counted FROM
(SELECT l_suppkey, l_returnflag || l_linestatus AS k, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_suppkey""")
def g16(spark, d):
    """Set and list of a group. Equal values are counted before they are collected, so a list is as long as its set of
    values and not as long as the group."""
    counted = table(spark, d, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("k")).agg(
        F.count(F.lit(1)).cast("string").alias("n"))
    lists = counted.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("k")).alias("s"),
                                             F.sort_array(F.collect_list(F.struct("k", "n"))).alias("l"))
    return lists.select("l_suppkey", F.array_join("s", ",").alias("flags"),
                        F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["k"], x["n"])), ",").alias("counted"))


@query("g17_first_last", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey""")
def g17(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"))


PIVOT = ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN CAST(o_totalprice AS DECIMAL(22,2)) END) AS DOUBLE) AS {n}"
                  for s, n in (("F", "finished"), ("O", "open"), ("P", "pending")))


@query("g18_pivot", f"SELECT o_orderpriority, {PIVOT} FROM orders GROUP BY o_orderpriority")
def g18(spark, d):
    # Listed values: no extra job to find them.
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(
        money_sum("o_totalprice")).withColumnsRenamed({"F": "finished", "O": "open", "P": "pending"})


@query("g18_pivot_sql", f"SELECT o_orderpriority, {PIVOT} FROM orders GROUP BY o_orderpriority")
def g18_sql(spark, d):
    register_views(spark, d, "orders")
    return spark.sql("""SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders)
PIVOT (cast(sum(cast(o_totalprice AS decimal(22,2))) AS double) FOR o_orderstatus IN ('F' AS finished, 'O' AS open, 'P' AS pending))""")


@query("g19_unpivot", """SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS measure, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem""")
def g19(spark, d):
    wide = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"),
                                              F.col("l_tax").alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "measure", "value")


@query("g20_two_phase_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY l_suppkey")
def g20(spark, d):
    return two_phase_distinct(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("g21_having_after_lateral", """SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word
FROM documents) GROUP BY lang, word HAVING count(*) > 5""")
def g21(spark, d):
    register_views(spark, d, "documents")
    return spark.sql("""SELECT lang, word, count(*) AS n FROM documents LATERAL VIEW explode(split(text, ' ')) w AS word
GROUP BY lang, word HAVING count(*) > 5""")
