"""Each performance rule's original form and the advised one. Both have the same twin; tests compare them with
each other and look at the plan of the advised form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scriptmill.functions.calendar import month_range
from scriptmill.functions.money import money_sum
from scriptmill.operators import masking, skew, trigrams
from scriptmill.operators.contract import project
from scriptmill.operators.lookup import not_in
from scriptmill.plans.registry import query, sql_text
from scriptmill.session import materialize, scratch_dir, shuffle_partitions
from scriptmill.sources import sinks
from scriptmill.sources.tables import code_table, register_views, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
C01 = f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ({', '.join(map(sql_text, PRIORITIES))}) OR o_totalprice > 400000"


def _c01_parts():
    return [F.col("o_orderpriority") == p for p in PRIORITIES] + [F.col("o_totalprice") > 400000]


@query("c01_or_original", C01)
def c01_or(spark, d):
    chain = reduce(lambda a, b: a | b, _c01_parts())
    return table(spark, d, "orders").where(chain).select("o_orderkey", "o_totalprice")


@query("c01_in_advised", C01)
def c01_in(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin(PRIORITIES) | (F.col("o_totalprice") > 400000)).select(
        "o_orderkey", "o_totalprice")


@query("c01_union_advised", C01)
def c01_union(spark, d):
    """Disjoint branches: each leaves out the rows of the branches before it, or they would come twice."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    parts, branches = _c01_parts(), []
    for i, cond in enumerate(parts):
        branches.append(o.where(reduce(lambda a, b: a & ~b, parts[:i], cond)).select("o_orderkey", "o_totalprice"))
    return reduce(lambda a, b: a.unionAll(b), branches)


C02 = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2"


@query("c02_having_original", C02)
def c02_having(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).where(
        "o_orderstatus = 'F'")


@query("c02_where_advised", C02)
def c02_where(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


C03 = "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("c03_in_subquery_original", C03)
def c03_in(spark, d):
    register_views(spark, d, "customer", "orders")
    return spark.sql(C03)


@query("c03_semi_join_advised", C03)
def c03_semi(spark, d):
    register_views(spark, d, "customer", "orders")
    return spark.sql("""SELECT c_custkey FROM customer LEFT SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o
ON c_custkey = o_custkey""")


@query("c04_not_in_versus_anti", """WITH q AS (SELECT d.doc_id, l.doc_id AS lk, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT CASE WHEN toxic = 1 THEN NULL ELSE lk END AS k FROM q WHERE lk IS NOT NULL)
SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT k FROM r)) AS n_not_in,
(SELECT count(*) FROM documents WHERE NOT EXISTS (SELECT 1 FROM r WHERE k = doc_id)) AS n_anti,
(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT k FROM r WHERE k IS NOT NULL)) AS n_not_in_without_nulls""")
def c04(spark, d):
    """NOT IN and the anti join differ as soon as the right side holds a NULL. All three arms run: NOT IN is an anti join
    whose rows pass only if the right side has no NULL (or is empty) and the left value is known."""
    docs = table(spark, d, "documents", "doc_id")
    keys = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, None).otherwise(F.col("doc_id")).alias("k"))
    count = F.count(F.lit(1))
    anti = docs.join(keys, F.col("doc_id") == F.col("k"), "left_anti").agg(count.alias("n_anti"))
    full = not_in(docs, "doc_id", keys, "k").agg(count.alias("n_not_in"))
    known = not_in(docs, "doc_id", keys.where("k IS NOT NULL"), "k").agg(count.alias("n_not_in_without_nulls"))
    return full.crossJoin(F.broadcast(anti)).crossJoin(F.broadcast(known))  # one row each


LIST = list(range(1, 1500, 11))
C05 = f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({', '.join(map(str, LIST))})"


@query("c05_long_list_original", C05)
def c05_list(spark, d):
    return table(spark, d, "orders").where(F.col("o_custkey").isin(LIST)).select("o_orderkey")


@query("c05_semi_join_advised", C05)
def c05_join(spark, d):
    values = code_table(spark, [(v,) for v in LIST], "o_custkey bigint")
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(F.broadcast(values), "o_custkey", "left_semi").select("o_orderkey")


C06 = "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997"


@query("c06_function_original", C06)
def c06_function(spark, d):
    return table(spark, d, "orders").where(F.year("o_orderdate") == 1997).select("o_orderkey", "o_totalprice")


@query("c06_range_advised", C06)
def c06_range(spark, d):
    return table(spark, d, "orders").where(month_range("o_orderdate", 1997)).select("o_orderkey", "o_totalprice")


C07 = "SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199701' AND '199703'"


def by_month(spark, d):
    """The orders, partitioned by month in the scratch folder."""
    path = scratch_dir(spark)
    rows = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    sinks.write_partitioned(rows, path, ["month"])
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz, month string").parquet(path)


@query("c07_date_function_original", C07)
def c07_function(spark, d):
    return by_month(spark, d).where(F.date_format("o_orderdate", "yyyyMM").between("199701", "199703")).select(
        "o_orderkey", "o_totalprice")


@query("c07_partition_column_advised", C07)
def c07_partition(spark, d):
    return by_month(spark, d).where(F.col("month").between("199701", "199703")).select("o_orderkey", "o_totalprice")


C08 = """SELECT o_orderkey, (SELECT count(*) FROM orders i WHERE i.o_custkey = o.o_custkey) AS n_cust,
(SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AS top FROM orders o"""


@query("c08_scalar_subquery_original", C08)
def c08_scalar(spark, d):
    register_views(spark, d, "orders")
    return spark.sql(C08)


@query("c08_group_stats_advised", C08)
def c08_window(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return skew.with_group_stats(o, ["o_custkey"], [F.count(F.lit(1)).alias("n_cust"), F.max("o_totalprice").alias("top")]).select(
        "o_orderkey", "n_cust", "top")


C09 = """WITH s AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey)
SELECT a.o_custkey, a.total FROM s a WHERE a.total > (SELECT sum(total) / count(*) FROM (SELECT round(total, 0) AS total FROM s))"""


def _c09_totals(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(money_sum("o_totalprice").alias("total"))


def _c09_limit(totals):
    rounded = totals.select(F.round("total", 0).alias("t"))
    return rounded.agg((F.sum("t") / F.count(F.lit(1))).alias("limit"))


@query("c09_repeated_subquery_original", C09)
def c09_repeated(spark, d):
    limit = _c09_limit(_c09_totals(spark, d))
    return _c09_totals(spark, d).crossJoin(F.broadcast(limit)).where("total > limit").select("o_custkey", "total")


@query("c09_computed_once_advised", C09)
def c09_once(spark, d):
    totals = materialize(_c09_totals(spark, d))
    return totals.crossJoin(F.broadcast(_c09_limit(totals))).where("total > limit").select("o_custkey", "total")


C10 = "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem GROUP BY l_returnflag"


@query("c10_count_distinct_original", C10)
def c10_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_distinct"))


@query("c10_two_phase_advised", C10)
def c10_two_phase(spark, d):
    return skew.two_phase_distinct(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey")


@query("c10_salted_advised", C10)
def c10_salted(spark, d):
    return skew.salted_distinct(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey", shuffle_partitions(spark))


@query("c10_approximate_advised", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def c10_approx(spark, d):
    lines = table(spark, d, "lineitem", "l_returnflag", "l_orderkey")
    approx = lines.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"))
    return approx.join(c10_salted(spark, d), "l_returnflag").select(
        "l_returnflag", (F.abs(F.col("a") - F.col("n_distinct")) <= 0.1 * F.col("n_distinct")).alias("close"))


@query("c11_key_profile", """SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS max_rows, CAST(sum(n) AS DOUBLE) / count(*) AS avg_rows,
CAST(max(n) * count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS max_to_avg,
quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def c11_profile(spark, d):
    return skew.key_profile(table(spark, d, "orders"), "o_custkey")


@query("c11_top_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def c11_top(spark, d):
    return skew.top_keys(table(spark, d, "orders"), "o_custkey", 10)


@query("c12_filter_placement", """SELECT (SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P') AS n_on,
(SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P') AS n_where""")
def c12(spark, d):
    c, o = table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey", "o_orderstatus")
    key = F.col("c_custkey") == F.col("o_custkey")
    on = c.join(o, key & (F.col("o_orderstatus") == "P"), "left").agg(F.count(F.lit(1)).alias("n_on"))
    where = c.join(o, key, "left").where("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("n_where"))
    return on.crossJoin(F.broadcast(where))


@query("c13_join_fanout", """SELECT l.k, l.n AS n_left, r.n AS n_right, l.n * r.n AS n_output FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l
JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) r ON l.k = r.k""")
def c13(spark, d):
    left = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
    return skew.join_fanout(left, table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k")), "k")


C14 = "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem ORDER BY l_suppkey, l_returnflag"


@query("c14_distinct_order_original", C14)
def c14_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct().orderBy("l_suppkey", "l_returnflag")


@query("c14_aggregate_advised", C14)
def c14_aggregate(spark, d):
    groups = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return groups.orderBy("l_suppkey", "l_returnflag").select("l_suppkey", "l_returnflag")


@query("c15_order_original", "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC")
def c15_order(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"))


@query("c15_order_limit_advised", """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber LIMIT 100""")
def c15_limit(spark, d):
    return c15_order(spark, d).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber").limit(100)


C16 = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-28'"


@query("c16_literal_date_original", C16)
def c16_literal(spark, d):
    register_views(spark, d, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = TIMESTAMP_NTZ '1997-05-28'")


@query("c16_parameter_advised", C16)
def c16_parameter(spark, d):
    register_views(spark, d, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = to_timestamp_ntz(:d)", args={"d": "1997-05-28"})


@query("c17_dated_copies", """SELECT strftime(o_orderdate, '%Y0101') AS dt, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1""")
def c17(spark, d):
    """Copies t_19950101, t_19960101, ... read as one table with the date as a column."""
    folder = scratch_dir(spark)
    copies = table(spark, d, "orders").withColumn("copy", F.concat(F.lit("t_"), F.date_format("o_orderdate", "yyyy"), F.lit("0101")))
    sinks.write_partitioned(copies, folder, ["copy"])
    return sinks.read_dated_copies(spark, folder, r"t_([12]\d{7})").groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total"))


@query("c18_masked_columns", """SELECT c_custkey, sha256('s1:' || c_name) AS name_hash,
regexp_replace(regexp_replace(c_mktsegment, '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS segment_mask,
regexp_replace(regexp_replace(regexp_replace(substr(c_name, 1, length(c_name) - 4), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')
|| right(c_name, 4) AS name_mask FROM customer""")
def c18(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", masking.pseudonym(name, "s1:").alias("name_hash"), F.mask("c_mktsegment").alias("segment_mask"),
        masking.partial_mask(name, 4).alias("name_mask"))


@query("c18_masked_join", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def c18_join(spark, d):
    """Pseudonymized keys still join."""
    c = table(spark, d, "customer").select(masking.pseudonym(F.col("c_custkey"), "s1:").alias("k"), "c_mktsegment")
    o = table(spark, d, "orders").select(masking.pseudonym(F.col("o_custkey"), "s1:").alias("k"))
    return c.join(o, "k").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


WORDS = ["the", "and", "eaux", "tion", "der"]
C19 = "WITH w(word) AS (VALUES " + ", ".join(f"('{w}')" for w in WORDS) + """)
SELECT doc_id, word FROM documents JOIN w ON ' ' || replace(text, chr(10), ' ') || ' ' LIKE '% ' || word || ' %'"""


@query("c19_like_original", C19)
def c19_like(spark, d):
    padded = F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "))
    hits = F.array_compact(F.array(*[F.when(padded.like(f"% {w} %"), F.lit(w)) for w in WORDS]))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(hits).alias("word"))


def token_index(spark, d):
    """(word, doc_id), each pair once: the words of a document are made distinct inside its row, without a shuffle."""
    words = F.array_distinct(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))
    return table(spark, d, "documents", "doc_id", "text").select(F.explode(words).alias("word"), "doc_id")


@query("c19_token_index_advised", C19)
def c19_index(spark, d):
    words = code_table(spark, [(w,) for w in WORDS], "word string")
    return token_index(spark, d).join(F.broadcast(words), "word").select("doc_id", "word")


# Parts of words and of several words, none of them a word of its own.
INNER = ["hat", "ionth", "e the ", "zzzz", "au l", "Dieü"]


@query("c19_trigram_index_advised", "WITH w(word) AS (VALUES " + ", ".join(f"('{w}')" for w in INNER)
       + ") SELECT doc_id, word FROM documents JOIN w ON text LIKE '%' || word || '%'")
def c19_trigrams(spark, d):
    folder = scratch_dir(spark)
    trigrams.write_index(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", folder)
    return trigrams.search(spark, folder, INNER).select(F.col("key").alias("doc_id"), F.col("pattern").alias("word"))


C20 = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49"


@query("c20_star_original", "SELECT * FROM lineitem WHERE l_quantity > 49")
def c20_star(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 49")


@query("c20_columns_advised", C20)
def c20_columns(spark, d):
    return project(table(spark, d, "lineitem").where("l_quantity > 49"), ["l_orderkey", "l_quantity"])
