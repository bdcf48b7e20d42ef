"""Set operations, sort, limit and distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.calendar import month_range
from scriptmill.functions.money import cents, money_sum
from scriptmill.plans.registry import query
from scriptmill.session import scratch_dir
from scriptmill.sources import sinks
from scriptmill.sources.tables import register_views, table

O08_FILES = 16


def cust_nations(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))


def supp_nations(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


def custs_with(spark, d, status):
    """Customers of one status, each once: a set operation needs no repetitions, and a hot customer shrinks map-side."""
    return table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_custkey").distinct()


@query("u01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u01(spark, d):
    return cust_nations(spark, d).unionAll(supp_nations(spark, d))


@query("u02_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(spark, d):
    return cust_nations(spark, d).union(supp_nations(spark, d)).distinct()


@query("u03_intersect", """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def u03(spark, d):
    return custs_with(spark, d, "F").intersect(custs_with(spark, d, "P"))


@query("u04_except", """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def u04(spark, d):
    return custs_with(spark, d, "F").subtract(custs_with(spark, d, "P"))


@query("u05_minus", """SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def u05(spark, d):
    register_views(spark, d, "customer", "orders")
    return spark.sql("SELECT c_custkey FROM customer MINUS SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")


@query("u06_mixed_chain", """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def u06(spark, d):
    # INTERSECT binds tighter, the others go left to right.
    debtors = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    both = custs_with(spark, d, "P").intersect(custs_with(spark, d, "O"))
    return custs_with(spark, d, "F").union(both).subtract(debtors)


@query("u07_parenthesized", """(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') INTERSECT
(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def u07(spark, d):
    c = table(spark, d, "customer")
    right = c.where("c_mktsegment = 'BUILDING'").select("c_custkey").union(c.where("c_acctbal > 9000").select("c_custkey"))
    return custs_with(spark, d, "F").union(custs_with(spark, d, "P")).intersect(right)


@query("u08_join_in_branch", """SELECT 'customer' AS kind, c_name AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def u08(spark, d):
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("customer").alias("kind"), F.col("c_name").alias("name"), "n_name")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), "n_name")
    return c.unionAll(s)


@query("u09_period_segments", "\nUNION ALL\n".join(
    f"""SELECT 'Q{q}' AS quarter, o_orderstatus, count(*) AS n,
CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total FROM orders
WHERE o_orderdate >= DATE '1997-{3 * q - 2:02d}-01' AND o_orderdate < DATE '1997-{3 * q - 2:02d}-01' + INTERVAL 3 MONTH
GROUP BY o_orderstatus HAVING count(*) > 1""" for q in (1, 2, 3, 4)))
def u09(spark, d):
    # One pass with a quarter label replaces a scan per quarter.
    year = table(spark, d, "orders").where(month_range(F.col("o_orderdate"), 1997))
    return (
        year.groupBy(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"), "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total")).where("n > 1")
    )


@query("o01_order_by", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def o01(spark, d):
    return table(spark, d, "orders", "o_orderstatus", "o_totalprice", "o_orderkey").orderBy(
        "o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@query("o02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o02(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o03_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def o03(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("o04_distinct_order", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY p_brand, p_type")
def o04(spark, d):
    pairs = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy("p_brand", "p_type").select("p_brand", "p_type")


@query("o05_distribute_by", "SELECT o_custkey, true AS one_partition, count(*) AS n FROM orders GROUP BY o_custkey")
def o05(spark, d):
    register_views(spark, d, "orders")
    spread = spark.sql("SELECT o_custkey, o_orderkey FROM orders DISTRIBUTE BY o_custkey")
    return spread.withColumn("p", F.spark_partition_id()).groupBy("o_custkey").agg(
        (F.min("p") == F.max("p")).alias("one_partition"), F.count(F.lit(1)).alias("n"))


@query("o06_sort_by", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def o06(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey").sortWithinPartitions(
        F.desc("o_totalprice"), "o_orderkey")


@query("o07_cluster_by", "SELECT o_custkey, o_orderkey FROM orders")
def o07(spark, d):
    register_views(spark, d, "orders")
    return spark.sql("SELECT o_custkey, o_orderkey FROM orders CLUSTER BY o_custkey")


@query("o08_spread_output", f"""SELECT {O08_FILES} AS files, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS DOUBLE) AS total,
true AS even FROM lineitem""")
def o08(spark, d):
    """Written as a given number of even files and read back. Round-robin over whole rows: a rand() key would place a row
    elsewhere when a lost task runs again."""
    path = scratch_dir(spark)
    sinks.write_files(table(spark, d, "lineitem"), path, O08_FILES)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("l_extendedprice")).alias("total"))
    even = (F.max("n") - F.min("n") <= O08_FILES * 2 * F.count(F.lit(1))).alias("even")
    return files.agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), even)
