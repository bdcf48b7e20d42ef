"""Reporting jobs put together from the operators. Each is a function of the tables and its parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.functions.calendar import prev_month_end, ymd
from scriptmill.functions.money import cents
from scriptmill.functions.survivor import survivor
from scriptmill.operators import frames, history, lookup
from scriptmill.operators.validate import unknown_codes, validate
from scriptmill.plans.joins import HISTORY_SQL, PREFIX_SQL, PREFIXES, customer_history
from scriptmill.plans.registry import query, sql_text
from scriptmill.session import store
from scriptmill.sources import sinks
from scriptmill.sources.tables import code_table, table

# Ordered keyword rules for the class of an item; I = income, E = expense.
CLASS_RULES = [(1, "ring", "I01"), (2, "gear", "I02"), (3, "bolt", "E01"), (4, "red", "E02"), (5, "small", "I03")]
PRIORITY_CLASS = [("1-URGENT", "I09"), ("2-HIGH", "E09")]
REGION_CODE = [("ASIA", "AS"), ("EUROPE", "EU")]
VALID_CLASSES = ["I01", "I02", "I03", "I09", "E01", "E02", "E03", "E09"]

DEC = "CAST({} AS DECIMAL(22,2))"

D01_SQL = f"""WITH prio(p, pc) AS (VALUES {', '.join(f'({sql_text(a)}, {sql_text(b)})' for a, b in PRIORITY_CLASS)}),
reg(rn, rc) AS (VALUES {', '.join(f'({sql_text(a)}, {sql_text(b)})' for a, b in REGION_CODE)}),
raw AS (SELECT strftime(l_shipdate, '%Y%m') AS month, coalesce(rc, 'XX') AS region, c_mktsegment AS segment, c_acctbal,
  CASE WHEN l_linestatus = 'O' THEN 'D' ELSE 'C' END AS dir,
  CASE WHEN l_returnflag = 'R' THEN -{DEC.format('l_extendedprice')} ELSE {DEC.format('l_extendedprice')} END AS amt,
  CASE WHEN coalesce(pc, '') <> '' THEN pc {' '.join(f"WHEN contains(p_name, '{w}') THEN '{c}'" for _, w, c in CLASS_RULES)} ELSE 'E03' END AS cls
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey LEFT JOIN prio ON p = o_orderpriority
  LEFT JOIN reg ON rn = r_name),
flipped AS (SELECT month, region, segment, c_acctbal, CASE WHEN amt < 0 THEN CASE dir WHEN 'D' THEN 'C' ELSE 'D' END ELSE dir END AS dir,
  CASE WHEN amt < 0 THEN CASE WHEN starts_with(cls, 'I') THEN 'E' || substr(cls, 2) ELSE 'I' || substr(cls, 2) END ELSE cls END AS cls,
  abs(amt) AS amt FROM raw),
flagged AS (SELECT month, region, segment, dir, CASE WHEN c_acctbal < 0 THEN 'E09' ELSE cls END AS cls, amt FROM flipped)
SELECT month, region, dir, cls, segment, CAST(sum(amt) AS DOUBLE) AS total, count(*) AS n FROM flagged
WHERE cls IN ({', '.join(map(sql_text, VALID_CLASSES))}) GROUP BY month, region, dir, cls, segment"""


def swap_sign(amount: Column, direction: Column, cls: Column) -> dict[str, Column]:
    """A negative amount becomes positive; its direction (C/D) and the kind of its class (I/E) swap."""
    negative = amount < 0
    turned = F.concat(F.when(cls.startswith("I"), "E").otherwise("I"), F.substring(cls, F.lit(2), F.length(cls)))
    return {
        "dir": F.when(negative, F.when(direction == "D", "C").otherwise("D")).otherwise(direction),
        "cls": F.when(negative, turned).otherwise(cls),
        "amt": F.abs(amount),
    }


def income_expense(spark, d) -> DataFrame:
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = (
        lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    rows = lookup.code_map(rows, "o_orderpriority", code_table(spark, PRIORITY_CLASS, "p string, pc string"), "p", "pc", "", "known")
    rows = lookup.code_map(rows, "r_name", code_table(spark, REGION_CODE, "rn string, rc string"), "rn", "rc", "XX", "region")
    rows = lookup.keyword_code(rows, F.col("p_name"), CLASS_RULES, "E03", "by_word")
    amount = cents("l_extendedprice")
    rows = rows.select(
        F.date_format("l_shipdate", "yyyyMM").alias("month"), "region", F.col("c_mktsegment").alias("segment"), "c_acctbal",
        F.when(F.col("l_linestatus") == "O", "D").otherwise("C").alias("dir"),
        F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("amt"),
        # Only an empty class is filled by the word rules.
        F.when(F.col("known") != "", F.col("known")).otherwise(F.col("by_word")).alias("cls"),
    )
    rows = rows.withColumns(swap_sign(F.col("amt"), F.col("dir"), F.col("cls")))
    rows = rows.withColumn("cls", F.when(F.col("c_acctbal") < 0, "E09").otherwise(F.col("cls"))).where(
        F.col("cls").isin(VALID_CLASSES))
    return rows.groupBy("month", "region", "dir", "cls", "segment").agg(
        F.sum("amt").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query("d01_income_expense", D01_SQL)
def d01(spark, d):
    return income_expense(spark, d)


D02_SQL = f"""WITH {HISTORY_SQL}, snap AS (SELECT o_custkey AS k, o_orderkey AS current_order FROM history
WHERE start_ts <= TIMESTAMP '1998-06-30' AND (end_ts IS NULL OR end_ts > TIMESTAMP '1998-06-30')),
moves AS (SELECT o_custkey AS k, l_returnflag AS kind, CASE WHEN l_returnflag = 'R' THEN -{DEC.format('l_extendedprice')}
  ELSE {DEC.format('l_extendedprice')} END AS amt, l_quantity, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
picked AS (SELECT k, 'buy' AS event, amt FROM moves WHERE kind = 'N' AND l_quantity > 10
  UNION ALL SELECT k, 'refund', amt FROM moves WHERE kind = 'R'),
signed AS (SELECT c_mktsegment AS segment, event, CASE WHEN amt < 0 THEN 'C' ELSE 'D' END AS dir, abs(amt) AS amt
  FROM picked JOIN snap USING (k) JOIN customer ON c_custkey = k)
SELECT segment, event, dir, CAST(sum(amt) AS DOUBLE) AS total, count(*) AS n FROM signed GROUP BY segment, event, dir"""


def signed_moves(spark, d, day: str = "19980630") -> DataFrame:
    rows = customer_history(spark, d).select(
        F.col("o_custkey").alias("k"), ymd("start_ts").alias("start_dt"),
        F.coalesce(ymd("end_ts"), F.lit("99991231")).alias("end_dt"))
    snap = history.as_of(rows, day).select("k").join(
        table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("k") == F.col("c_custkey")).select("k", "c_mktsegment")
    amount = cents("l_extendedprice")
    moves = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice").join(
        table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("o_custkey").alias("k"), F.col("l_returnflag").alias("kind"), "l_quantity",
             F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("amt"))
    # Both inserts in one pass: a row belongs to at most one of them.
    event = F.when((F.col("kind") == "N") & (F.col("l_quantity") > 10), "buy").when(F.col("kind") == "R", "refund")
    picked = moves.withColumn("event", event).where("event IS NOT NULL").join(snap, "k")
    return picked.groupBy(
        F.col("c_mktsegment").alias("segment"), "event", F.when(F.col("amt") < 0, "C").otherwise("D").alias("dir")
    ).agg(F.sum(F.abs("amt")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query("d02_signed_moves", D02_SQL)
def d02(spark, d):
    return signed_moves(spark, d)


@query("d03_event_channels", """WITH failed AS (SELECT DISTINCT user_id, strftime(ts, '%Y%m%d') AS day, 'Y' AS flag FROM events WHERE event_type = 'error'),
marked AS (SELECT e.*, f.flag, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events e LEFT JOIN failed f
  ON e.user_id = f.user_id AND strftime(e.ts, '%Y%m%d') = f.day)
SELECT event_type, CASE WHEN k < 30 THEN 'web' WHEN k < 60 THEN CASE WHEN event_type = 'view' THEN 'app-view' ELSE 'app' END ELSE 'shop' END AS channel,
count(*) AS n, CAST(sum(CAST(value AS DECIMAL(22,2))) AS DOUBLE) AS total FROM marked
WHERE event_type <> 'error' AND NOT (coalesce(flag, 'N') = 'Y' AND event_type = 'click') GROUP BY 1, 2""")
def d03(spark, d):
    events = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    failed = events.where("event_type = 'error'").select("user_id", "day").distinct().withColumn("flag", F.lit("Y"))
    marked = events.join(failed, ["user_id", "day"], "left").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    channel = F.when(k < 30, "web").when(k < 60, F.when(kind == "view", "app-view").otherwise("app")).otherwise("shop")
    kept = marked.where((kind != "error") & ~((F.coalesce("flag", F.lit("N")) == "Y") & (kind == "click")))
    return kept.groupBy("event_type", channel.alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("value")).cast("double").alias("total"))


CHECKS = [
    ("o_totalprice > 450000", "amount above the limit"),
    ("o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'", "pending for too long"),
    ("o_orderpriority LIKE '%NOT SPECIFIED%'", "no priority"),
    ("o_orderstatus NOT IN ('F', 'O', 'P')", "unknown status"),
]


@query("d04_validation_errors", "\nUNION ALL\n".join(
    f"SELECT o_orderkey, '{m}' AS message FROM orders WHERE {c}" for c, m in CHECKS)
    + """\nUNION ALL SELECT o_orderkey, 'customer not active' FROM orders WHERE o_custkey NOT IN
(SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def d04(spark, d):
    orders = table(spark, d, "orders")
    checks = [(F.expr(c.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), m) for c, m in CHECKS]
    errors = validate(orders, ["o_orderkey"], checks)
    active = table(spark, d, "customer").where("c_acctbal > 0")
    missing = unknown_codes(orders, "o_custkey", active, "c_custkey").select(
        "o_orderkey", F.lit("customer not active").alias("message"))
    return errors.unionByName(missing)


@query("d05_merged_report", f"""WITH one AS ({D01_SQL}), two AS ({D02_SQL}),
stacked AS (SELECT 'A' AS src, month || '/' || region || '/' || dir || '/' || cls || '/' || segment AS item, total, n FROM one
UNION ALL SELECT 'B', segment || '/' || event || '/' || dir, total, n FROM two)
SELECT 'G202401' || lpad(CAST(row_number() OVER (ORDER BY src, item) AS VARCHAR), 7, '0') AS code, src, item, total, n, '20240131' AS data_dt
FROM stacked WHERE total <> 0""")
def d05(spark, d):
    """Both sources stacked, renumbered and written over their partition; the second run leaves the same table."""
    one = income_expense(spark, d).select(
        F.lit("A").alias("src"), F.concat_ws("/", "month", "region", "dir", "cls", "segment").alias("item"), "total", "n")
    two = signed_moves(spark, d).select(F.lit("B").alias("src"), F.concat_ws("/", "segment", "event", "dir").alias("item"), "total", "n")
    # Numbering reads its input twice; the stacked sums are kept so that the jobs behind them run once.
    stacked = store(one.unionByName(two).where("total <> 0"))
    numbered = frames.with_row_number(stacked, [], ["src", "item"], "no").select(
        frames.surrogate_code(F.lit("G202401"), F.col("no")).alias("code"), "src", "item", "total", "n")
    numbered = store(numbered)
    db = sinks.work_database(spark)
    sinks.create_typed_table(spark, f"{db}.report", [
        ("code", "STRING", ""), ("src", "STRING", ""), ("item", "STRING", ""), ("total", "DOUBLE", ""), ("n", "BIGINT", ""),
        ("data_dt", "STRING", "")], partitioned_by=["data_dt"])
    for _ in range(2):
        sinks.reload_partition(spark, f"{db}.report", {"data_dt": "20240131"}, numbered)
    return spark.table(f"{db}.report")


@query("d06_balance_roll_forward", f"""WITH m AS (SELECT c_mktsegment AS segment, strftime(last_day(o_orderdate), '%Y%m%d') AS month_end,
sum({DEC.format('o_totalprice')}) AS principal, sum(CASE WHEN o_orderstatus = 'F' THEN {DEC.format('o_totalprice')} ELSE 0 END) AS interest,
sum(CASE WHEN o_orderpriority = '5-LOW' THEN {DEC.format('o_totalprice')} ELSE 0 END) AS other FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT a.segment, a.month_end, CAST(a.principal AS DOUBLE) AS principal, CAST(a.interest AS DOUBLE) AS interest,
CAST(a.principal + a.interest - coalesce(b.principal, 0) - coalesce(b.interest, 0) - a.other AS DOUBLE) AS net_flow FROM m a LEFT JOIN m b
ON a.segment = b.segment AND b.month_end = strftime(date_trunc('month', strptime(a.month_end, '%Y%m%d')) - INTERVAL 1 DAY, '%Y%m%d')
WHERE a.principal <> 0 OR a.interest <> 0 OR a.other <> 0""")
def d06(spark, d):
    price = cents("o_totalprice")
    rows = table(spark, d, "orders").join(
        table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    months = rows.groupBy(F.col("c_mktsegment").alias("segment"), ymd(F.last_day("o_orderdate")).alias("month_end")).agg(
        F.sum(price).alias("principal"),
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", price)), F.lit(0)).alias("interest"),
        F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "5-LOW", price)), F.lit(0)).alias("other"))
    before = months.select("segment", F.col("month_end").alias("prev_end"), F.col("principal").alias("pp"), F.col("interest").alias("pi"))
    joined = months.withColumn("prev_end", prev_month_end("month_end")).join(before, ["segment", "prev_end"], "left")
    zero = F.lit(0)
    flow = F.col("principal") + F.col("interest") - F.coalesce("pp", zero) - F.coalesce("pi", zero) - F.col("other")
    return joined.where("principal <> 0 OR interest <> 0 OR other <> 0").select(
        "segment", "month_end", F.col("principal").cast("double").alias("principal"),
        F.col("interest").cast("double").alias("interest"), flow.cast("double").alias("net_flow"))


@query("d07_customer_merge", f"""WITH a AS (SELECT o_custkey AS k, max(CASE WHEN o_orderpriority = '5-LOW' THEN '@@low' WHEN o_orderpriority = '1-URGENT' THEN ''
ELSE o_orderpriority END) AS grade, sum({DEC.format('o_totalprice')}) AS line, sum(CASE WHEN o_totalprice > 250000 THEN {DEC.format('o_totalprice')} END) AS used
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, min(o_orderpriority) AS grade, sum({DEC.format('o_totalprice')}) AS line, sum(CASE WHEN o_totalprice < 100000 THEN
{DEC.format('o_totalprice')} * 2 END) AS used FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'A' WHEN a.k IS NULL THEN 'B' ELSE 'AB' END AS origin,
CASE WHEN (a.grade IS NULL OR a.grade = '' OR starts_with(a.grade, '@@')) AND b.grade IS NOT NULL AND b.grade <> '' AND NOT starts_with(b.grade, '@@')
THEN b.grade ELSE a.grade END AS grade, coalesce(a.line, 0) + coalesce(b.line, 0) AS line, coalesce(a.used, 0) + coalesce(b.used, 0) AS used
FROM a FULL JOIN b ON a.k = b.k)
SELECT k, origin, grade, CAST(line AS DOUBLE) AS line, CAST(CASE WHEN used > line THEN line ELSE used END AS DOUBLE) AS used FROM j""")
def d07(spark, d):
    """One full outer join of two systems that hold a customer at most once each."""
    price, prio = cents("o_totalprice"), F.col("o_orderpriority")

    def system(status: str, grade: Column, used: Column, side: str) -> DataFrame:
        return table(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(
            grade.alias(f"grade_{side}"), F.sum(price).alias(f"line_{side}"), F.sum(used).alias(f"used_{side}"),
            F.lit(True).alias(side))

    a = system("F", F.max(F.when(prio == "5-LOW", "@@low").when(prio == "1-URGENT", "").otherwise(prio)),
               F.when(F.col("o_totalprice") > 250000, price), "a")
    b = system("O", F.min(prio), F.when(F.col("o_totalprice") < 100000, price * 2), "b")
    both = a.join(b, "k", "full")

    def added(name: str) -> Column:
        return F.coalesce(f"{name}_a", F.lit(0)) + F.coalesce(f"{name}_b", F.lit(0))

    merged = both.select(
        "k", F.when(F.col("b").isNull(), "A").when(F.col("a").isNull(), "B").otherwise("AB").alias("origin"),
        survivor(F.col("grade_a"), F.col("grade_b")).alias("grade"), added("line").alias("line"), added("used").alias("used"))
    # Used credit never exceeds the line.
    return merged.select("k", "origin", "grade", F.col("line").cast("double").alias("line"),
                         F.least("used", "line").cast("double").alias("used"))


@query("d08_deposit_extract", f"""WITH {PREFIX_SQL}, {HISTORY_SQL},
items AS (SELECT p_partkey, p_type || '-' || p_brand AS item FROM part),
found AS (SELECT p_partkey, coalesce(d0.val, d11.val, d9.val, d6.val, d4.val) AS val FROM items
LEFT JOIN dim d0 ON d0.code = item LEFT JOIN dim d11 ON d11.code = substr(item, 1, 11) LEFT JOIN dim d9 ON d9.code = substr(item, 1, 9)
LEFT JOIN dim d6 ON d6.code = substr(item, 1, 6) LEFT JOIN dim d4 ON d4.code = substr(item, 1, 4)),
snap AS (SELECT o_custkey AS k FROM history WHERE start_ts <= TIMESTAMP '1999-12-31' AND (end_ts IS NULL OR end_ts > TIMESTAMP '1999-12-31')),
rows AS (SELECT o_custkey AS acc, strftime(l_shipdate, '%Y%m%d') AS day, l_orderkey, l_linenumber, l_partkey, l_quantity, val,
CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'C' END AS dr_cr, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN found ON l_partkey = p_partkey JOIN snap ON snap.k = o_custkey
WHERE val LIKE 'A%' OR val LIKE 'B%' OR val = 'D1')
SELECT acc, day, 'T' || day || lpad(CAST(row_number() OVER (PARTITION BY acc, day ORDER BY l_orderkey, l_linenumber, l_partkey, amt) AS VARCHAR), 4, '0') AS seq,
val, dr_cr, amt, substr(day, 1, 6) AS data_dt FROM rows""")
def d08(spark, d):
    dim = code_table(spark, PREFIXES, "code string, val string")
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_type", "p_brand").alias("item"))
    found = lookup.prefix_lookup(parts, "item", dim, "code", "val", [11, 9, 6, 4], "val").where(
        F.col("val").startswith("A") | F.col("val").startswith("B") | (F.col("val") == "D1"))
    rows = customer_history(spark, d).select(
        F.col("o_custkey").alias("acc"), ymd("start_ts").alias("start_dt"), F.coalesce(ymd("end_ts"), F.lit("99991231")).alias("end_dt"))
    snap = history.as_of(rows, "19991231").select("acc")
    back = F.col("l_returnflag") == "R"
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag",
                  "l_shipdate")
    extract = (
        lines.join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(found, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("o_custkey", "acc").join(snap, "acc")
        .select("acc", ymd("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "val",
                F.when(back, "D").otherwise("C").alias("dr_cr"),
                F.when(back, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amt"))
    )
    # numbering reads its input more than once
    numbered = frames.with_row_number(store(extract), ["acc", "day"], ["l_orderkey", "l_linenumber", "l_partkey", "amt"], "no")
    result = numbered.select("acc", "day", frames.surrogate_code(F.concat(F.lit("T"), "day"), F.col("no"), 4).alias("seq"),
                             "val", "dr_cr", "amt", F.substring("day", 1, 6).alias("data_dt"))
    db = sinks.work_database(spark)
    sinks.create_typed_table(spark, f"{db}.deposits", [
        ("acc", "BIGINT", "account"), ("day", "STRING", ""), ("seq", "STRING", ""), ("val", "STRING", ""), ("dr_cr", "STRING", ""),
        ("amt", "DOUBLE", ""), ("data_dt", "STRING", "month")], partitioned_by=["data_dt"])
    sinks.spread_by(result, ["data_dt"]).write.insertInto(f"{db}.deposits")
    return spark.table(f"{db}.deposits")
