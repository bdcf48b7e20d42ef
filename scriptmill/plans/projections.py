"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.money import money_sum
from scriptmill.operators.contract import fill_layout, project
from scriptmill.plans.registry import query
from scriptmill.sources.tables import register_views, table


@query("s04_pruned_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def s04(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "l_orderkey", "l_extendedprice"
    )


@query("p01_projection", "SELECT c_custkey AS id, c_name AS name, c_acctbal + 10 AS raised FROM customer")
def p01(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") + 10).alias("raised")
    )


@query("p02_explicit_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p02(spark, d):
    return project(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "p03_filler_columns",
    "SELECT s_suppkey, s_name, '' AS branch, '156' AS currency, 'N' AS flag FROM supplier",
)
def p03(spark, d):
    return fill_layout(table(spark, d, "supplier"),
                       {"s_suppkey": None, "s_name": None, "branch": "", "currency": "156", "flag": "N"})


@query("p04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def p04(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("p05_comparison_and", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 200000""")
def p05(spark, d):
    return table(spark, d, "orders").where(
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") < 200000)
    ).select("o_orderkey", "o_totalprice")


@query("p06_or_groups", """SELECT p_partkey FROM part WHERE (p_type = 'ECONOMY' OR p_type = 'PROMO')
AND (p_size < 10 OR (p_size > 40 AND p_retailprice > 950))""")
def p06(spark, d):
    t, s = F.col("p_type"), F.col("p_size")
    return table(spark, d, "part").where(
        ((t == "ECONOMY") | (t == "PROMO")) & ((s < 10) | ((s > 40) & (F.col("p_retailprice") > 950)))
    ).select("p_partkey")


@query("p07_in_list", """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
AND o_orderstatus NOT IN ('P', 'X')""")
def p07(spark, d):
    return table(spark, d, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P", "X")
    ).select("o_orderkey")


@query("p08_between", """SELECT o_orderkey FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_totalprice NOT BETWEEN 50000 AND 300000""")
def p08(spark, d):
    ts = [F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-12-31")]
    return table(spark, d, "orders").where(
        F.col("o_orderdate").between(*ts) & ~F.col("o_totalprice").between(50000, 300000)
    ).select("o_orderkey")


@query("p09_like", """SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'red%' OR p_name LIKE '%gear%' OR p_name LIKE
'%ring') AND p_brand NOT LIKE 'Brand#2%'""")
def p09(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").where(
        (n.startswith("red") | n.contains("gear") | n.endswith("ring")) & ~F.col("p_brand").like("Brand#2%")
    ).select("p_partkey", "p_name")


@query("p10_like_escape", "SELECT page_id FROM pages WHERE html LIKE '%!%!%!%%' ESCAPE '!'")
def p10(spark, d):
    return table(spark, d, "pages").where(F.like("html", F.lit("%!%!%!%%"), F.lit("!"))).select("page_id")


@query("p11_rlike", "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\b[A-Z][a-z]+\\. [A-Z]')")
def p11(spark, d):
    return table(spark, d, "documents").where(F.rlike("text", F.lit(r"\b[A-Z][a-z]+\. [A-Z]"))).select("doc_id")


@query("p12_null_tests", """SELECT d.doc_id, l.quality IS NULL AS unlabelled, coalesce(l.quality, -1) AS quality,
coalesce(d.source, '') <> '' AS has_source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def p12(spark, d):
    return table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").isNull().alias("unlabelled"), F.coalesce("quality", F.lit(-1)).alias("quality"),
        (F.coalesce("source", F.lit("")) != "").alias("has_source"),
    )


@query("p13_negated_group", """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE NOT (l.quality = 1 AND d.lang = 'en')""")
def p13(spark, d):
    both = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return both.where(~((F.col("quality") == 1) & (F.col("lang") == "en"))).select("doc_id")


@query("p14_not_equal", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus != 'O'")
def p14(spark, d):
    return table(spark, d, "lineitem").where(
        (F.col("l_returnflag") != "N") & (F.col("l_linestatus") != "O")
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query("p15_searched_case", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal'
ELSE 'rich' END AS class FROM customer""")
def p15(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.when(b < 0, "debt").when(b < 5000, "normal").otherwise("rich").alias("class")
    )


@query("p16_nested_case", """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN
CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity > 25 THEN 'RF+' ELSE 'RF-' END ELSE 'RO' END
ELSE CASE WHEN l_discount > 0.05 THEN 'D' ELSE 'K' END END AS code FROM lineitem""")
def p16(spark, d):
    inner = F.when(F.col("l_quantity") > 25, "RF+").otherwise("RF-")
    code = F.when(
        F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", inner).otherwise("RO")
    ).otherwise(F.when(F.col("l_discount") > 0.05, "D").otherwise("K"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                                              code.alias("code"))


@query("p17_case_without_else", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END
AS state FROM orders""")
def p17(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "finished").when(s == "O", "open").alias("state"))


@query("p18_date_literals", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-04-01'""")
def p18(spark, d):
    import datetime as dt

    date = F.col("o_orderdate")
    return table(spark, d, "orders").where(
        (date >= F.lit(dt.date(1997, 3, 1))) & (date < F.lit("1997-04-01").cast("date"))
    ).select("o_orderkey", F.date_format(date, "yyyy-MM-dd").alias("day"))


@query("p19_derived_tables", """SELECT status, n FROM (SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status,
o_totalprice AS price FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') a) b WHERE price > 1000
GROUP BY status) c WHERE n > 10""")
def p19(spark, d):
    a = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    b = a.select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).where("price > 1000")
    return b.groupBy("status").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@query("p20_ctes", """WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey), nations AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region
ON n_regionkey = r_regionkey) SELECT c_custkey, n_name, r_name, total FROM customer
JOIN spend ON o_custkey = c_custkey JOIN nations ON n_nationkey = c_nationkey""")
def p20(spark, d):
    spend = table(spark, d, "orders").groupBy("o_custkey").agg(money_sum("o_totalprice").alias("total"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, d, "customer").join(spend, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name", "r_name", "total")
    )


@query("p21_sample", """SELECT true AS subset, true AS share_in_bounds, true AS repeatable, count(*) AS n_rows FROM orders""")
def p21(spark, d):
    """What is certain of a seeded sample of a tenth: it holds rows of the table, each once, about a tenth of them (within
    six standard deviations), and a second draw with the seed gives the same rows."""
    whole = table(spark, d, "orders", "o_orderkey")
    # By name: given by position, the fraction makes PySpark drop the seed.
    draw = lambda: whole.sample(fraction=0.1, seed=123)
    both = draw().select("o_orderkey", F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("w")).unionByName(
        draw().select("o_orderkey", F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("w"))).unionByName(
        whole.select("o_orderkey", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("w")))
    keys = both.groupBy("o_orderkey").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    n = F.sum("w")
    return keys.agg(
        (F.max(F.col("a") - F.col("w")) <= 0).alias("subset"),
        (F.abs(F.sum("a") - 0.1 * n) <= 6 * F.sqrt(0.09 * n)).alias("share_in_bounds"),
        (F.sum(F.abs(F.col("a") - F.col("b"))) == 0).alias("repeatable"), n.alias("n_rows"))


@query("p22_hash_sample", """SELECT o_orderkey, o_totalprice FROM orders
WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS INTEGER) % 10 = 3""")
def p22(spark, d):
    bucket = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int") % 10
    return table(spark, d, "orders").where(bucket == 3).select("o_orderkey", "o_totalprice")


@query("p23_struct_field", """SELECT c_custkey, s.c_name AS name, s.bal AS bal FROM (
SELECT c_custkey, {'c_name': c_name, 'bal': c_acctbal} AS s FROM customer)""")
def p23(spark, d):
    s = F.struct("c_name", F.col("c_acctbal").alias("bal"))
    return table(spark, d, "customer").select("c_custkey", s.getField("c_name").alias("name"), s["bal"].alias("bal"))


@query("s17_temp_view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def s17(spark, d):
    register_views(spark, d, "orders")
    spark.table("orders").where("o_totalprice > 1000").createOrReplaceTempView("paid_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM paid_orders GROUP BY o_orderstatus")
