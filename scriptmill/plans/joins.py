"""Joins and subqueries.

Sides are left to Spark's size statistics and AQE unless they are tables written in code or one aggregated row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.calendar import prev_month_end, ymd
from scriptmill.functions.money import money_sum
from scriptmill.functions.survivor import survivor
from scriptmill.operators import history, lookup
from scriptmill.operators.contract import report_frame
from scriptmill.operators.frames import over_rows
from scriptmill.operators.ranges import interval_join
from scriptmill.plans.registry import query
from scriptmill.session import store
from scriptmill.sources.tables import code_table, register_views, table


def t(spark, d, name, *cols):
    return table(spark, d, name, *cols)


@query("j01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return t(spark, d, "orders").join(c, on="o_custkey").select("o_orderkey", "c_name")


@query("j02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def j02(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey")


@query("j03_right", "SELECT doc_id, quality, lang FROM labels RIGHT JOIN documents USING (doc_id)")
def j03(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id", "right").select("doc_id", "quality", "lang")


@query("j04_full", """SELECT c.k AS c_nation, s.k AS s_nation, c.n AS n_customers, s.n AS n_suppliers FROM
(SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN
(SELECT s_nationkey + 3 AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def j04(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("c_nation")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = t(spark, d, "supplier").groupBy((F.col("s_nationkey") + 3).alias("s_nation")).agg(
        F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, F.col("c_nation") == F.col("s_nation"), "full")


@query("j05_cross", """SELECT r_name, o_orderstatus, coalesce(n, 0) AS n FROM region CROSS JOIN
(SELECT DISTINCT o_orderstatus FROM orders) LEFT JOIN (SELECT n_regionkey AS rk, o_orderstatus AS st, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
ON rk = r_regionkey AND st = o_orderstatus""")
def j05(spark, d):
    """All region/status pairs. Both sides are code lists of checked size, not facts; the counts meet them by key."""
    o = t(spark, d, "orders", "o_custkey", "o_orderstatus")
    frame = report_frame(t(spark, d, "region", "r_regionkey", "r_name"), o.select("o_orderstatus").distinct())
    counts = (
        o.join(t(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").alias("r_regionkey"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    )
    return frame.join(counts, ["r_regionkey", "o_orderstatus"], "left").select(
        "r_name", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"))


@query("j06_star", """SELECT l_orderkey, l_linenumber, l_partkey, p_name, s_name, n_name, r_name FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def j06(spark, d):
    return (
        t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "s_name", "n_name", "r_name")
    )


@query("j07_multi_condition", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders
ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000""")
def j07(spark, d):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)
    return t(spark, d, "customer").join(t(spark, d, "orders"), on, "left").select("c_custkey", "o_orderkey")


@query("j08_aggregated_sides", """SELECT c.n_name, c.bal, s.n FROM (SELECT n_name, n_nationkey,
CAST(sum(CAST(c_acctbal AS DECIMAL(22,2))) AS DOUBLE) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, n_nationkey) c JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) s
ON c.n_nationkey = s.s_nationkey""")
def j08(spark, d):
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(money_sum("c_acctbal").alias("bal"))
    s = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        c.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(s, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "bal", "n")
    )


@query("j09_filter_in_on", """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders
ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""")
def j09_on(spark, d):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "P")
    return t(spark, d, "customer").join(t(spark, d, "orders"), on, "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("n"))


@query("j09_filter_in_where", """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders
ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY c_custkey""")
def j09_where(spark, d):
    joined = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("j10_in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j10(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey")
    return t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j11_exists", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 49))""")
def j11(spark, d):
    lines = t(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49")
    o = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j12_not_exists", """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def j12(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(
        "o_orderkey")


NULL_KEYS = """WITH bad AS (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("j13_not_in", f"""{NULL_KEYS} SELECT 'null on the right' AS kind, c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT q FROM bad) UNION ALL SELECT 'no null', c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT q FROM bad WHERE q IS NOT NULL)""")
def j13(spark, d):
    customers = t(spark, d, "customer", "c_custkey")
    labelled = t(spark, d, "documents", "doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    # The value set is what the predicate needs, not its repetitions.
    values = labelled.select(F.col("quality").alias("q")).distinct()
    full = lookup.not_in(customers, "c_custkey", values, "q").select(F.lit("null on the right").alias("kind"), "c_custkey")
    known = lookup.not_in(customers, "c_custkey", values.where("q IS NOT NULL"), "q")
    return full.unionByName(known.select(F.lit("no null").alias("kind"), "c_custkey"))


@query("j13_not_in_explicit", f"""{NULL_KEYS}, probe AS (SELECT doc_id, CASE WHEN q = 0 THEN NULL ELSE doc_id END AS k FROM bad)
SELECT doc_id FROM probe WHERE k NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def j13_explicit(spark, d):
    """NOT IN as an anti join that scales: no row passes if the right side holds a NULL; a NULL on the left passes only
    if the right side is empty."""
    labelled = t(spark, d, "documents", "doc_id").join(t(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    probe = labelled.select("doc_id", F.when(F.col("quality") == 0, None).otherwise(F.col("doc_id")).alias("k"))
    right = t(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("r"))
    return lookup.not_in(probe, "k", right, "r").select("doc_id")


@query("j14_exists_flag", """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND
o_orderpriority = '1-URGENT') THEN 'Y' ELSE 'N' END AS urgent FROM customer""")
def j14(spark, d):
    keys = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return t(spark, d, "customer").join(keys, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.when(F.col("o_custkey").isNotNull(), "Y").otherwise("N").alias("urgent"))


@query("j15_scalar_in_select", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def j15(spark, d):
    top = t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t(spark, d, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top")


@query("j16_scalar_in_where", """SELECT o_orderkey FROM orders WHERE o_totalprice >
(SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) / count(*) * 1.8 FROM orders)""")
def j16(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_totalprice")
    limit = o.agg((money_sum("o_totalprice") / F.count(F.lit(1)) * 1.8).alias("limit"))
    return o.crossJoin(F.broadcast(limit)).where("o_totalprice > limit").select("o_orderkey")


@query("j17_scalar_in_aggregate", """SELECT c_mktsegment, CAST(sum(CAST(coalesce((SELECT max(o_totalprice) FROM orders
WHERE o_custkey = c_custkey), 0) AS DECIMAL(22,2))) AS DOUBLE) / count(*) AS avg_top FROM customer GROUP BY c_mktsegment""")
def j17(spark, d):
    top = t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    joined = t(spark, d, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(
        (money_sum(F.coalesce("top", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_top"))


@query("j18_derived_key", """SELECT s_suppkey, n_name FROM supplier JOIN nation
ON TRY_CAST(substr(n_name, 8) AS INTEGER) = s_nationkey""")
def j18(spark, d):
    key = F.substring("n_name", F.lit(8), F.length("n_name")).try_cast("int")
    return t(spark, d, "supplier").join(t(spark, d, "nation"), key == F.col("s_nationkey")).select("s_suppkey", "n_name")


PREFIXES = [("ECONOMY-Brand#2", "A1"), ("ECONOMY-Brand#11", "A2"), ("ECONOMY-Bra", "A3"), ("LARGE-Bra", "B1"),
            ("LARG", "B2"), ("MEDIUM", "C1"), ("MEDIUM-Bran", "C2"), ("PROMO-Brand#2", "D1"), ("SMAL", "E1")]
PREFIX_SQL = "dim(code, val) AS (VALUES " + ", ".join(f"('{c}', '{v}')" for c, v in PREFIXES) + ")"


@query("j19_prefix_lookup", f"""WITH {PREFIX_SQL}, p AS (SELECT p_partkey, p_type || '-' || p_brand AS item FROM part)
SELECT p_partkey, item, coalesce(d0.val, d11.val, d9.val, d6.val, d4.val) AS val FROM p
LEFT JOIN dim d0 ON d0.code = item LEFT JOIN dim d11 ON d11.code = substr(item, 1, 11)
LEFT JOIN dim d9 ON d9.code = substr(item, 1, 9) LEFT JOIN dim d6 ON d6.code = substr(item, 1, 6)
LEFT JOIN dim d4 ON d4.code = substr(item, 1, 4)""")
def j19(spark, d):
    dim = code_table(spark, PREFIXES, "code string, val string")
    parts = t(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_type", "p_brand").alias("item"))
    return lookup.prefix_lookup(parts, "item", dim, "code", "val", [11, 9, 6, 4], "val")


HISTORY_SQL = """history AS (SELECT o_custkey, o_orderkey, o_orderdate AS start_ts,
lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_ts FROM orders)"""


def customer_history(spark, d):
    """History rows made from the orders: valid from the order's day to the customer's next order."""
    base = t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return over_rows(base, ["o_custkey"], ["o_orderdate", "o_orderkey"], 0, 1, {
        "end_ts": lambda w: F.lead("o_orderdate").over(w)}).withColumnRenamed("o_orderdate", "start_ts")


@query("j20_history_snapshot", f"""WITH {HISTORY_SQL}, snap AS (SELECT * FROM (SELECT o_custkey, o_orderkey,
strftime(start_ts, '%Y%m%d') AS start_dt, coalesce(strftime(end_ts, '%Y%m%d'), '99991231') AS end_dt FROM history)
WHERE start_dt <= '19980630' AND end_dt > '19980630')
SELECT c_custkey, c_name, o_orderkey, start_dt, end_dt FROM customer JOIN snap ON c_custkey = o_custkey""")
def j20(spark, d):
    rows = customer_history(spark, d).select(
        "o_custkey", "o_orderkey", ymd("start_ts").alias("start_dt"), F.coalesce(ymd("end_ts"), F.lit("99991231")).alias("end_dt"))
    snap = history.as_of(rows, "19980630")
    return t(spark, d, "customer").join(snap, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_name", "o_orderkey", "start_dt", "end_dt")


@query("j21_asof_join", f"""WITH {HISTORY_SQL}, facts AS (SELECT o_custkey AS k, l_orderkey, l_linenumber, l_partkey,
l_extendedprice, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_extendedprice, h.o_orderkey AS valid_order FROM facts f
LEFT JOIN (SELECT * FROM history WHERE end_ts IS NULL OR end_ts > start_ts) h
ON h.o_custkey = f.k AND h.start_ts <= f.l_shipdate AND (h.end_ts IS NULL OR h.end_ts > f.l_shipdate)""")
def j21(spark, d):
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    facts = lines.join(t(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop(
        "o_orderkey")
    # The join reads its sides more than once, and both are derived here: each is stored first.
    valid = store(customer_history(spark, d).where("end_ts IS NULL OR end_ts > start_ts").withColumnRenamed(
        "o_orderkey", "valid_order"))
    facts = store(facts)
    return history.asof_join(facts, valid, "o_custkey", "l_shipdate", "start_ts", "end_ts", ["valid_order"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "valid_order")


@query("j22_previous_month", """WITH m AS (SELECT o_orderstatus AS st, strftime(last_day(o_orderdate), '%Y%m%d') AS month_end,
CAST(sum(CAST(o_totalprice AS DECIMAL(22,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)
SELECT a.st, a.month_end, a.total, coalesce(b.total, 0.0) AS prev_total FROM m a LEFT JOIN m b ON a.st = b.st AND b.month_end =
strftime(date_trunc('month', strptime(a.month_end, '%Y%m%d')) - INTERVAL 1 DAY, '%Y%m%d')""")
def j22(spark, d):
    months = t(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("st"), ymd(F.last_day("o_orderdate")).alias("month_end")
    ).agg(money_sum("o_totalprice").alias("total"))
    prev = months.select("st", F.col("month_end").alias("prev_end"), F.col("total").alias("prev_total"))
    return months.withColumn("prev_end", prev_month_end("month_end")).join(prev, ["st", "prev_end"], "left").select(
        "st", "month_end", "total", F.coalesce("prev_total", F.lit(0.0)).alias("prev_total"))


@query("j23_code_mapping", """WITH codes(st, code) AS (VALUES ('F', '01'), ('O', '02'))
SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN '00' ELSE coalesce(code, '99') END AS code FROM orders
LEFT JOIN codes ON st = o_orderstatus""")
def j23(spark, d):
    codes = code_table(spark, [("F", "01"), ("O", "02")], "st string, code string")
    mapped = lookup.code_map(t(spark, d, "orders"), "o_orderstatus", codes, "st", "code", "99", "mapped")
    return mapped.select("o_orderkey", F.when(F.col("o_totalprice") < 1000, "00").otherwise(F.col("mapped")).alias("code"))


def _keyword_case() -> str:
    return "CASE " + " ".join(f"WHEN contains(p_name, '{w}') THEN '{c}'" for _, w, c in lookup.KEYWORD_RULES) + " ELSE 'Z99' END"


@query("j24_keyword_rules", f"SELECT p_partkey, p_name, {_keyword_case()} AS code FROM part")
def j24(spark, d):
    parts = t(spark, d, "part", "p_partkey", "p_name")
    return lookup.keyword_code(parts, F.col("p_name"), lookup.rules_table(spark), "Z99")


@query("j24_keyword_rules_text", """SELECT doc_id, CASE WHEN contains(text, 'http') THEN 'W1' WHEN contains(text, '@') THEN 'M1'
WHEN contains(text, 'icense') THEN 'L1' WHEN contains(text, 'the ') THEN 'E1' ELSE 'N0' END AS code FROM documents""")
def j24_text(spark, d):
    rules = code_table(spark, [(1, "http", "W1"), (2, "@", "M1"), (3, "icense", "L1"), (4, "the ", "E1")],
                                  "prio int, word string, code string")
    docs = t(spark, d, "documents", "doc_id", "text")
    return lookup.keyword_code(docs, F.col("text"), rules, "N0").select("doc_id", "code")


@query("j25_exclusive_split", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, 'A' AS origin, n AS n_a, 0 AS n_b FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT k, 'B', 0, n FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT a.k, 'AB', a.n, b.n FROM a JOIN b ON a.k = b.k""")
def j25(spark, d):
    def system(status, n):
        return t(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(
            F.count(F.lit(1)).alias(n))

    both = system("F", "n_a").join(system("O", "n_b"), "k", "full")
    origin = F.when(F.col("n_b").isNull(), "A").when(F.col("n_a").isNull(), "B").otherwise("AB")
    return both.select("k", origin.alias("origin"), F.coalesce("n_a", F.lit(0)).alias("n_a"),
                       F.coalesce("n_b", F.lit(0)).alias("n_b"))


@query("j26_survivor", """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN '@@none' WHEN c_acctbal < 2000 THEN ''
ELSE c_mktsegment END AS seg FROM customer),
b AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END) AS seg FROM orders GROUP BY 1)
SELECT a.k, CASE WHEN (a.seg IS NULL OR a.seg = '' OR starts_with(a.seg, '@@')) AND b.seg IS NOT NULL AND b.seg <> ''
AND NOT starts_with(b.seg, '@@') THEN b.seg ELSE a.seg END AS seg FROM a LEFT JOIN b ON a.k = b.k""")
def j26(spark, d):
    bal = F.col("c_acctbal")
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(bal < 0, "@@none").when(bal < 2000, "").otherwise(
        F.col("c_mktsegment")).alias("seg_a"))
    b = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).alias("seg_b"))
    return a.join(b, "k", "left").select("k", survivor(F.col("seg_a"), F.col("seg_b")).alias("seg"))


BANDS = [("low", 0, 50000), ("mid", 50000, 200000), ("high", 200000, 400000), ("top", 300000, 10**12)]


@query("j27_theta", "WITH bands(band, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in BANDS)
       + ") SELECT o_orderkey, band FROM orders JOIN bands ON o_totalprice >= lo AND o_totalprice < hi")
def j27(spark, d):
    bands = code_table(spark, BANDS, "band string, lo bigint, hi bigint")  # a table written in code
    on = (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))
    return t(spark, d, "orders", "o_orderkey", "o_totalprice").join(F.broadcast(bands), on).select("o_orderkey", "band")


# A price range per customer, most of them narrow and every tenth a hundred times as wide.
_RANGES = """SELECT c_custkey, abs(c_acctbal) * 40 AS lo, abs(c_acctbal) * 40 + 5 + c_custkey % 7 + CASE WHEN c_custkey % 10 = 0 THEN 500 ELSE 0 END AS hi
FROM customer"""


@query("j27_price_ranges", f"WITH r AS ({_RANGES}) SELECT o_orderkey, c_custkey FROM orders JOIN r ON o_totalprice >= lo AND o_totalprice < hi")
def j27_ranges(spark, d):
    bal, key = F.abs("c_acctbal") * 40, F.col("c_custkey")
    ranges = t(spark, d, "customer", "c_custkey", "c_acctbal").select(
        "c_custkey", bal.alias("lo"), (bal + 5 + key % 7 + F.when(key % 10 == 0, 500).otherwise(0)).alias("hi"))
    points = t(spark, d, "orders", "o_orderkey", "o_totalprice")
    return interval_join(points, "o_totalprice", ranges, "lo", "hi").select("o_orderkey", "c_custkey")


# One rule per order, with its number as word: words of one to many digits, more than travel in a plan.
@query("j24_many_rules", """WITH rules AS (SELECT CAST(o_orderkey AS VARCHAR) AS word FROM orders)
SELECT c_custkey, count(*) AS n_rules, max(word) AS last_word FROM customer JOIN rules ON contains(c_name, word) GROUP BY c_custkey""")
def j24_many(spark, d):
    word = F.col("o_orderkey").cast("string")
    rules = t(spark, d, "orders", "o_orderkey").select(F.lit(1).alias("prio"), word.alias("word"), word.alias("code"))
    return lookup.keyword_matches(t(spark, d, "customer", "c_custkey", "c_name"), F.col("c_name"), rules).groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_rules"), F.max("code").alias("last_word"))


LONG_LIST = list(range(3, 2000, 17))


@query("j28_list_as_join", f"SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_partkey IN ({', '.join(map(str, LONG_LIST))})")
def j28(spark, d):
    values = code_table(spark, [(v,) for v in LONG_LIST], "l_partkey bigint")  # a table written in code
    return t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").join(
        F.broadcast(values), "l_partkey", "left_semi")
