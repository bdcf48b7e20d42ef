"""Tables written, reloaded and merged; every query reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.money import cents, money_sum
from scriptmill.operators.frames import top_per_group
from scriptmill.operators.merge import When, merge_frames
from scriptmill.operators.merge_files import create_files, merge_files
from scriptmill.plans.registry import query, sql_text
from scriptmill.session import materialize, scratch_dir, store
from scriptmill.sources import sinks
from scriptmill.sources.tables import table

# Partitions that are worth an INSERT of their own.
MAX_STATIC = 100

CUSTOMER_COLUMNS = [
    ("id", "BIGINT", "key  of the customer"), ("name", "VARCHAR(36)", "full name"),
    ("balance", "DECIMAL(22,2)", "account balance"), ("dt", "STRING", "load day"),
]


@query("s05_typed_table", """SELECT 'id' AS name, 'bigint' AS type, 'key  of the customer' AS comment, count(c_custkey) AS n FROM customer
UNION ALL SELECT 'name', 'varchar(36)', 'full name', count(c_name) FROM customer
UNION ALL SELECT 'balance', 'decimal(22,2)', 'account balance', count(c_acctbal) FROM customer
UNION ALL SELECT 'dt', 'string', 'load day', count(*) FROM customer""")
def s05(spark, d):
    db = sinks.work_database(spark)
    sinks.create_typed_table(spark, f"{db}.customers", CUSTOMER_COLUMNS, "customers")
    table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), cents("c_acctbal").alias("balance"),
        F.lit("20240131").alias("dt")).write.insertInto(f"{db}.customers")
    stored = spark.table(f"{db}.customers")
    counts = stored.agg(*[F.count(c).alias(c) for c in stored.columns]).unpivot([], stored.columns, "name", "n")
    about = spark.sql(f"DESCRIBE TABLE {db}.customers").select(
        F.col("col_name").alias("name"), F.col("data_type").alias("type"), "comment")
    return about.join(counts, "name").select("name", "type", "comment", "n")


@query("s06_partitioned_table", """SELECT o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y') AS yr, count(*) AS n
FROM orders GROUP BY 1, 2, 3""")
def s06(spark, d):
    path = scratch_dir(spark)
    rows = table(spark, d, "orders").withColumn("yr", F.date_format("o_orderdate", "yyyy"))
    sinks.write_partitioned(rows, path, ["o_orderstatus", "o_orderpriority", "yr"])
    return spark.read.parquet(path).groupBy("o_orderstatus", "o_orderpriority", F.col("yr").cast("string").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"))


@query("s07_ctas", """SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey""")
def s07(spark, d):
    db = sinks.work_database(spark)
    table(spark, d, "orders").createOrReplaceTempView("ctas_orders")
    spark.sql(f"""CREATE TABLE {db}.totals USING parquet AS SELECT o_custkey, count(*) AS n,
cast(sum(cast(o_totalprice AS decimal(22,2))) AS double) AS total FROM ctas_orders GROUP BY o_custkey""")
    return spark.table(f"{db}.totals")


@query("s08_staged_chain", """WITH w1 AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS amt FROM lineitem
WHERE l_returnflag <> 'N' GROUP BY l_orderkey), w2 AS (SELECT o_custkey, o_orderstatus, amt FROM orders JOIN w1 ON o_orderkey = l_orderkey),
w3 AS (SELECT o_custkey, o_orderstatus, sum(amt) AS amt FROM w2 GROUP BY 1, 2)
SELECT c_mktsegment, o_orderstatus, CAST(sum(amt) AS DOUBLE) AS amt, count(*) AS n FROM w3 JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def s08(spark, d):
    """A chain of dropped and rebuilt work tables as one lazy plan; only a stage that is read twice would be stored."""
    w1 = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(
        F.sum(cents("l_extendedprice")).alias("amt"))
    w2 = table(spark, d, "orders").join(w1, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderstatus", "amt")
    w3 = w2.groupBy("o_custkey", "o_orderstatus").agg(F.sum("amt").alias("amt"))
    return w3.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        "c_mktsegment", "o_orderstatus").agg(F.sum("amt").cast("double").alias("amt"), F.count(F.lit(1)).alias("n"))


def _orders_table(spark, d, partitioned=True):
    """An empty orders table in a fresh work database."""
    db = sinks.work_database(spark)
    columns = [("o_orderkey", "BIGINT", ""), ("o_totalprice", "DOUBLE", ""), ("st", "STRING", "")]
    sinks.create_typed_table(spark, f"{db}.o", columns, partitioned_by=["st"] if partitioned else None)
    return f"{db}.o"


def _orders(spark, d, status=None):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("st"))
    return rows if status is None else rows.where(F.col("st") == status)


@query("s09_append", """SELECT o_orderkey, o_totalprice, o_orderstatus AS st FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O'""")
def s09(spark, d):
    name = _orders_table(spark, d, partitioned=False)
    for status in ("F", "O", "O"):
        _orders(spark, d, status).write.insertInto(name)
    return spark.table(name)


@query("s10_static_partition", """SELECT o_orderkey, o_totalprice, 'X' || o_orderstatus AS st FROM orders WHERE o_orderstatus <> 'P'""")
def s10(spark, d):
    """Each append names its partition, as long as there are few of them; many are loaded dynamically."""
    name = _orders_table(spark, d)
    rows = _orders(spark, d).where("st <> 'P'")
    found = [r.st for r in rows.select("st").distinct().limit(MAX_STATIC + 1).collect()]
    if len(found) > MAX_STATIC:
        rows.withColumn("st", F.concat(F.lit("X"), "st")).write.insertInto(name)
        return spark.table(name)
    for status in sorted(found):
        _orders(spark, d, status).createOrReplaceTempView("static_rows")
        spark.sql(f"INSERT INTO {name} PARTITION (st = {sql_text('X' + status)}) SELECT o_orderkey, o_totalprice FROM static_rows")
    return spark.table(name)


@query("s11_dynamic_partition", "SELECT o_orderkey, o_totalprice, o_orderstatus AS st FROM orders")
def s11(spark, d):
    name = _orders_table(spark, d)
    _orders(spark, d).createOrReplaceTempView("dynamic_rows")
    spark.sql(f"INSERT INTO {name} PARTITION (st) SELECT o_orderkey, o_totalprice, st FROM dynamic_rows")
    return spark.table(name)


@query("s12_overwrite_table", "SELECT o_orderkey, o_totalprice, o_orderstatus AS st FROM orders WHERE o_orderstatus = 'P'")
def s12(spark, d):
    name = _orders_table(spark, d, partitioned=False)
    _orders(spark, d, "F").write.insertInto(name)
    _orders(spark, d, "P").write.mode("overwrite").insertInto(name)
    return spark.table(name)


@query("s13_overwrite_partition", """SELECT o_orderkey, o_totalprice, o_orderstatus AS st FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, o_totalprice + 1, 'P' FROM orders WHERE o_orderstatus = 'P'""")
def s13(spark, d):
    path = scratch_dir(spark)
    sinks.write_partitioned(_orders(spark, d), path, ["st"])
    changed = _orders(spark, d, "P").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    sinks.write_partitioned(changed, path, ["st"])
    return spark.read.parquet(path)


@query("s14_idempotent_reload", "SELECT o_orderkey, o_totalprice, o_orderstatus AS st FROM orders")
def s14(spark, d):
    """Every partition that occurs in the rows is replaced, in one job a run."""
    name = _orders_table(spark, d)
    for _ in range(2):
        sinks.reload_partitions(_orders(spark, d), name)
    return spark.table(name)


SOURCE_SQL = """lines AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS DOUBLE) AS total,
bool_and(l_returnflag = 'R') AS gone FROM lineitem GROUP BY l_orderkey),
src AS (SELECT k, total, gone FROM lines UNION ALL SELECT -1 - o_orderkey, o_totalprice, false FROM orders WHERE o_orderstatus = 'P')"""


def _target(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"),
                                            F.col("o_orderstatus").alias("st"))


def _updates(spark, d):
    """Changes for the orders: new totals from their lines, cancelled ones, and follow-up orders that are new."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        money_sum("l_extendedprice").alias("total"), F.bool_and(F.col("l_returnflag") == "R").alias("gone"))
    follow = table(spark, d, "orders").where("o_orderstatus = 'P'").select(
        (-1 - F.col("o_orderkey")).alias("k"), F.col("o_totalprice").alias("total"), F.lit(False).alias("gone"))
    return lines.unionByName(follow)


def _branches() -> list[When]:
    return [
        When("delete", F.col("s.gone")),
        When("update", F.col("s.total") > 100000, {"price": F.col("s.total"), "st": F.lit("U")}),
        When("insert", F.col("s.total") > 1000, {"k": F.col("s.k"), "price": F.col("s.total"), "st": F.lit("N")}),
    ]


@query("s15_merge", f"""WITH {SOURCE_SQL}
SELECT o_orderkey AS k, CASE WHEN total > 100000 THEN total ELSE o_totalprice END AS price,
CASE WHEN total > 100000 THEN 'U' ELSE o_orderstatus END AS st FROM orders LEFT JOIN src ON k = o_orderkey WHERE NOT coalesce(gone, false)
UNION ALL SELECT k, total, 'N' FROM src WHERE total > 1000 AND k NOT IN (SELECT o_orderkey FROM orders)""")
def s15(spark, d):
    return merge_frames(_target(spark, d), _updates(spark, d), ["k"], _branches())


@query("s16_merge_from_query", """WITH feed AS (SELECT l_orderkey AS k, l_extendedprice AS price, l_shipdate AS ts, l_partkey AS p FROM lineitem
UNION ALL SELECT -1 - o_orderkey, o_totalprice, o_orderdate, 0 FROM orders),
latest AS MATERIALIZED (SELECT k, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, price DESC, p) AS rn FROM feed) WHERE rn = 1)
SELECT o_orderkey AS k, coalesce(price, o_totalprice) AS price, o_orderstatus AS st FROM orders LEFT JOIN latest ON k = o_orderkey
UNION ALL SELECT k, price, 'N' FROM latest WHERE k < 0""")
def s16(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("p"))
    extra = table(spark, d, "orders").select(
        (-1 - F.col("o_orderkey")).alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ts"),
        F.lit(0).cast("bigint").alias("p"))
    latest = store(top_per_group(lines.unionByName(extra), ["k"], [F.desc("ts"), F.desc("price"), "p"], 1).select("k", "price"))
    return merge_frames(_target(spark, d), latest, ["k"], [
        When("update", None, {"price": F.col("s.price")}),
        When("insert", None, {"k": F.col("s.k"), "price": F.col("s.price"), "st": F.lit("N")}),
    ])


@query("s15_stored_merge", f"""WITH {SOURCE_SQL}
SELECT o_orderkey AS k, CASE WHEN total > 100000 THEN total ELSE o_totalprice END AS price,
CASE WHEN total > 100000 THEN 'U' ELSE o_orderstatus END AS st FROM orders LEFT JOIN src ON k = o_orderkey WHERE NOT coalesce(gone, false)
UNION ALL SELECT k, total, 'N' FROM src WHERE total > 1000 AND k NOT IN (SELECT o_orderkey FROM orders)""")
def s15_stored(spark, d):
    """The merged table is written as a new version of the target and read back."""
    db = sinks.work_database(spark)
    _target(spark, d).write.saveAsTable(f"{db}.target_v1")
    merged = merge_frames(spark.table(f"{db}.target_v1"), _updates(spark, d), ["k"], _branches())
    merged.write.saveAsTable(f"{db}.target_v2")
    return spark.table(f"{db}.target_v2")


@query("s15_file_merge", """WITH late AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(22,2))) AS DOUBLE) AS total,
bool_and(l_returnflag = 'R') AS gone FROM lineitem GROUP BY l_orderkey HAVING l_orderkey >= (SELECT 0.8 * max(o_orderkey) FROM orders))
SELECT o_orderkey AS k, CASE WHEN total > 100000 THEN total ELSE o_totalprice END AS price,
CASE WHEN total > 100000 THEN 'U' ELSE o_orderstatus END AS st FROM orders LEFT JOIN late ON k = o_orderkey WHERE NOT coalesce(gone, false)
UNION ALL SELECT k, total, 'N' FROM late WHERE total > 1000 AND k NOT IN (SELECT o_orderkey FROM orders)""")
def s15_files(spark, d):
    """The changes of the latest fifth of the orders, merged into files by order key: the other files stay as they are."""
    orders = _target(spark, d)
    files = create_files(orders.repartitionByRange("k").sortWithinPartitions("k"), scratch_dir(spark))
    last = orders.agg((0.8 * F.max("k")).alias("since"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        money_sum("l_extendedprice").alias("total"), F.bool_and(F.col("l_returnflag") == "R").alias("gone"))
    merge_files(files, lines.join(F.broadcast(last), F.col("k") >= F.col("since")).drop("since"), ["k"], _branches())
    return files.read()


@query("s18_shared_result", """WITH t AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)
SELECT 'big' AS kind, count(*) AS n FROM t WHERE total > 2000000 UNION ALL SELECT 'small', count(*) FROM t WHERE total <= 2000000""")
def s18(spark, d):
    """A result that two steps read. Stored in the scratch folder, it survives lost executors and needs no unpersist."""
    path = scratch_dir(spark)
    table(spark, d, "orders").groupBy("o_custkey").agg(money_sum("o_totalprice").alias("total")).write.parquet(path)
    totals = spark.read.parquet(path)
    big = totals.where("total > 2000000").agg(F.lit("big").alias("kind"), F.count(F.lit(1)).alias("n"))
    small = totals.where("total <= 2000000").agg(F.lit("small").alias("kind"), F.count(F.lit(1)).alias("n"))
    return big.unionAll(small)


@query("s18_checkpointed_result", """WITH t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, n * 1.0 / (SELECT sum(n) FROM t) AS share FROM t""")
def s18_checkpointed(spark, d):
    counts = materialize(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("l_suppkey", "n", (F.col("n") / F.col("total")).alias("share"))


@query("s19_delimited_text", """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang AS lang, CAST(l.quality AS VARCHAR) AS quality FROM documents d
LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def s19(spark, d):
    path = scratch_dir(spark)
    rows = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "quality")
    sinks.write_delimited(rows, path)
    return spark.read.option("sep", "\u0001").option("nullValue", "").schema("id string, lang string, quality string").csv(path)
