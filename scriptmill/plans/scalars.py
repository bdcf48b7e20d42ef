"""Scalar function families, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.calendar import month_end, prev_month_end, ymd
from scriptmill.functions.money import cents
from scriptmill.plans.registry import query
from scriptmill.sources.tables import register_views, table


@query("f01_string_shape", """SELECT p_partkey, p_name || '/' || p_brand AS c1, p_type || '-' || p_brand AS c2,
substr(p_name, 2, 3) AS s1, right(p_brand, 2) AS s2, lpad(CAST(p_size AS VARCHAR), 5, '0') AS lp, rpad(p_type, 10, '*') AS rp,
repeat(p_type, 2) AS rep, reverse(p_name) AS rev, '[' || repeat(' ', 3) || ']' AS sp, upper(p_name) AS up, lower(p_type) AS lo,
array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ic,
trim('  ' || p_type || ' ') AS t, ltrim('  ' || p_type) AS lt, rtrim(p_type || ' ') AS rt, trim(p_type, 'SE') AS bt FROM part""")
def f01(spark, d):
    register_views(spark, d, "part")
    return spark.sql("""SELECT p_partkey, concat(p_name, '/', p_brand) AS c1, concat_ws('-', p_type, p_brand) AS c2,
substr(p_name, 2, 3) AS s1, substring(p_brand, -2, 2) AS s2, lpad(p_size, 5, 0) AS lp, rpad(p_type, 10, '*') AS rp,
repeat(p_type, 2) AS rep, reverse(p_name) AS rev, concat('[', space(3), ']') AS sp, ucase(p_name) AS up, lcase(p_type) AS lo,
initcap(p_name) AS ic, trim(concat('  ', p_type, ' ')) AS t, ltrim(concat('  ', p_type)) AS lt, rtrim(concat(p_type, ' ')) AS rt,
btrim(p_type, 'SE') AS bt FROM part""")


@query("f02_string_measure", """SELECT p_partkey, length(p_name) AS len, bit_length(p_name) AS bits, strlen(p_name) AS octets,
instr(p_name, 'e') AS ins, CASE WHEN instr(substr(p_name, 3), 'e') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'e') + 2 END AS loc,
ascii(p_name) AS asc, chr(65 + p_size % 26) AS ch, levenshtein(p_name, p_type) AS lev, translate(p_name, 'aeiou', '12345') AS tr,
CASE p_type WHEN 'ECONOMY' THEN 'E255' WHEN 'LARGE' THEN 'L620' WHEN 'MEDIUM' THEN 'M350' WHEN 'PROMO' THEN 'P650'
WHEN 'SMALL' THEN 'S540' WHEN 'STANDARD' THEN 'S353' END AS sx FROM part""")
def f02(spark, d):
    register_views(spark, d, "part")
    return spark.sql("""SELECT p_partkey, length(p_name) AS len, bit_length(p_name) AS bits, octet_length(p_name) AS octets,
instr(p_name, 'e') AS ins, locate('e', p_name, 3) AS loc, ascii(p_name) AS asc, char(65 + p_size % 26) AS ch,
levenshtein(p_name, p_type) AS lev, translate(p_name, 'aeiou', '12345') AS tr, soundex(p_type) AS sx FROM part""")


@query("f03_split_regex_url", """SELECT page_id, len(string_split(url, '/')) AS n_parts, regexp_extract(url, '://([^/?#]+)', 1) AS host_rx,
regexp_replace(url, '[0-9]+', '#', 'g') AS masked, len(regexp_extract_all(html, '<[a-z]+')) AS n_tags,
nullif(regexp_extract(url, '^([a-z]+)://', 1), '') AS proto, nullif(regexp_extract(url, '://([^/?#]+)', 1), '') AS host,
regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query,
nullif(regexp_extract(url, '#(.*)$', 1), '') AS frag, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
printf('%05d|%s', page_id, regexp_extract(url, '://([^/?#]+)', 1)) AS label FROM pages""")
def f03(spark, d):
    url = F.col("url")
    part = lambda p: F.try_parse_url(url, F.lit(p))
    args = F.str_to_map(part("QUERY"), F.lit("&"), F.lit("="))
    return table(spark, d, "pages").select(
        "page_id", F.size(F.split(url, "/")).alias("n_parts"), F.regexp_extract(url, "://([^/?#]+)", 1).alias("host_rx"),
        F.regexp_replace(url, "[0-9]+", "#").alias("masked"), F.regexp_count("html", F.lit("<[a-z]+")).alias("n_tags"),
        part("PROTOCOL").alias("proto"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"),
        part("REF").alias("frag"), F.element_at(args, "page").alias("page"),
        F.printf(F.lit("%05d|%s"), F.col("page_id"), part("HOST")).alias("label"))


@query("f04_hash_encode", """SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, to_base64(encode(c_name)) AS b64,
c_name AS back, hex(c_name) AS hx, c_mktsegment AS unhx, to_base(c_custkey, 2) AS bn, to_base(c_custkey, 16) AS cv,
true AS stable FROM customer""")
def f04(spark, d):
    register_views(spark, d, "customer")
    return spark.sql("""SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha2(c_name, 256) AS s2, base64(c_name) AS b64,
decode(unbase64(base64(c_name)), 'UTF-8') AS back, hex(c_name) AS hx, decode(unhex(hex(c_mktsegment)), 'UTF-8') AS unhx,
bin(c_custkey) AS bn, conv(c_custkey, 10, 16) AS cv,
hash(c_name) = hash(concat(c_name, '')) AND xxhash64(c_custkey, c_name) IS NOT NULL AND sha(c_name) = sha1(c_name) AS stable
FROM customer""")


@query("f05_math", """SELECT c_custkey, abs(c_acctbal) AS ab, CAST(round(CAST(c_acctbal AS DECIMAL(22,2)), 1) AS DOUBLE) AS rd,
CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq,
CAST(pow(c_nationkey, 3) AS DOUBLE) AS pw, round(exp(c_nationkey / 10.0), 6) AS ex, round(ln(c_custkey + 1), 6) AS l,
round(log2(c_custkey + 1), 6) AS l2, round(log10(c_custkey + 1), 6) AS l10, round(ln(c_custkey + 1) / ln(3), 6) AS l3,
(c_nationkey - 12) % 5 AS md, (((c_nationkey - 12) % 5) + 5) % 5 AS pm, CAST(sign(c_acctbal) AS DOUBLE) AS sg, -c_acctbal AS neg,
c_acctbal AS pos, greatest(c_nationkey, 10) AS gr, least(c_nationkey, 10) AS le, round(exp(1.0), 6) AS e, round(pi(), 6) AS pi,
CAST(bit_count(c_custkey) AS INTEGER) AS bc, c_custkey << 2 AS sl, c_custkey >> 1 AS sr FROM customer""")
def f05(spark, d):
    register_views(spark, d, "customer")
    return spark.sql("""SELECT c_custkey, abs(c_acctbal) AS ab, CAST(round(CAST(c_acctbal AS DECIMAL(22,2)), 1) AS DOUBLE) AS rd,
ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq, pow(c_nationkey, 3) AS pw,
round(exp(c_nationkey / 10.0), 6) AS ex, round(ln(c_custkey + 1), 6) AS l, round(log2(c_custkey + 1), 6) AS l2,
round(log10(c_custkey + 1), 6) AS l10, round(log(3, c_custkey + 1), 6) AS l3, mod(c_nationkey - 12, 5) AS md,
pmod(c_nationkey - 12, 5) AS pm, sign(c_acctbal) AS sg, negative(c_acctbal) AS neg, positive(c_acctbal) AS pos,
greatest(c_nationkey, 10) AS gr, least(c_nationkey, 10) AS le, round(e(), 6) AS e, round(pi(), 6) AS pi,
bit_count(c_custkey) AS bc, shiftleft(c_custkey, 2) AS sl, shiftright(c_custkey, 1) AS sr FROM customer""")


TRIG = ["sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "degrees", "radians"]
_TRIG_SQL = ", ".join(f"round({f}(l_discount + 0.01), 6) AS {f}_v" for f in [*TRIG, "cot"])


@query("f06_trigonometry", f"SELECT DISTINCT l_discount, {_TRIG_SQL} FROM lineitem")
def f06(spark, d):
    register_views(spark, d, "lineitem")
    return spark.sql(f"SELECT DISTINCT l_discount, {_TRIG_SQL} FROM lineitem")


@query("f07_random_and_ids", "SELECT count(*) AS n, true AS in_unit, count(*) AS n_uuid, count(*) AS n_ids, true AS has_partition FROM orders")
def f07(spark, d):
    rows = table(spark, d, "orders", "o_orderkey").select(
        F.rand(7).alias("r"), F.uuid().alias("u"), F.monotonically_increasing_id().alias("i"),
        F.spark_partition_id().alias("p"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_unit"),
        F.count_if(F.length("u") == 36).alias("n_uuid"), F.count_distinct("i").alias("n_ids"),
        (F.min("p") >= 0).alias("has_partition"))


@query("f08_date_parts", """SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS dd, day(ts) AS dm, dayofweek(ts) + 1 AS dw,
dayofyear(ts) AS dy, weekofyear(ts) AS wk, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events""")
def f08(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events", "event_id", "ts").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.day(ts).alias("dd"), F.dayofmonth(ts).alias("dm"),
        F.dayofweek(ts).alias("dw"), F.dayofyear(ts).alias("dy"), F.weekofyear(ts).alias("wk"), F.hour(ts).alias("h"),
        F.minute(ts).alias("mi"), F.second(ts).alias("s"))


@query("f09_date_arithmetic", """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS plus,
strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS minus, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS dd,
strftime(last_day(o_orderdate), '%Y-%m-%d') AS ld, strftime(CAST(o_orderdate AS DATE) + (8 - isodow(o_orderdate))::INTEGER, '%Y-%m-%d') AS nm,
strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS tm, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS ty,
strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS am, true AS past FROM orders""")
def f09(spark, d):
    register_views(spark, d, "orders")
    return spark.sql("""SELECT o_orderkey, string(date_add(o_orderdate, 30)) AS plus, string(date_sub(o_orderdate, 7)) AS minus,
datediff(o_orderdate, DATE '1995-01-01') AS dd, string(last_day(o_orderdate)) AS ld, string(next_day(o_orderdate, 'MON')) AS nm,
string(trunc(o_orderdate, 'MM')) AS tm, string(trunc(o_orderdate, 'YEAR')) AS ty, string(add_months(o_orderdate, 2)) AS am,
current_date() > date(o_orderdate) AND now() > o_orderdate AND current_timestamp() > o_orderdate AS past FROM orders""")


@query("f10_date_text_epoch", """SELECT event_id, strftime(ts, '%Y/%m/%d %H') AS df, strftime(ts, '%Y-%m-%d') AS td,
strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS tt, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ut,
strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS fu,
strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS tu FROM events""")
def f10(spark, d):
    register_views(spark, d, "events")
    return spark.sql("""SELECT event_id, date_format(ts, 'yyyy/MM/dd HH') AS df, string(to_date(date_format(ts, 'yyyyMMdd'), 'yyyyMMdd')) AS td,
date_format(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss')), 'yyyy-MM-dd HH:mm:ss') AS tt,
to_unix_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS ut,
from_unixtime(to_unix_timestamp(from_utc_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'Asia/Shanghai'))) AS fu,
from_unixtime(to_unix_timestamp(to_utc_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'Asia/Shanghai'))) AS tu FROM events""")


@query("f11_ymd_calendar", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d,
strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y%m%d') AS prev_end, strftime(last_day(o_orderdate), '%Y%m%d') AS this_end,
strftime(o_orderdate, '%Y-%m-01') AS first_day FROM orders""")
def f11(spark, d):
    days = table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", ymd("o_orderdate").alias("d"))
    return days.select("o_orderkey", "d", prev_month_end("d").alias("prev_end"), month_end("d").alias("this_end"),
                       F.concat_ws("-", F.substring("d", 1, 4), F.substring("d", 5, 2), F.lit("01")).alias("first_day"))


@query("f12_conditional", """WITH x AS (SELECT d.doc_id, l.quality AS q, l.toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(q, -1) AS a, CASE WHEN q IS NOT NULL THEN 'has' ELSE 'none' END AS b, coalesce(t, 9) AS c, coalesce(q, t, 5) AS e,
CASE WHEN q = 1 THEN 'good' ELSE 'other' END AS f, 0.0 AS g, q IS NULL AS h, q IS NOT NULL AS i, false AS j FROM x""")
def f12(spark, d):
    table(spark, d, "documents", "doc_id").join(table(spark, d, "labels"), "doc_id", "left").createOrReplaceTempView("doc_labels")
    return spark.sql("""SELECT doc_id, nvl(quality, -1) AS a, nvl2(quality, 'has', 'none') AS b, ifnull(toxic, 9) AS c,
coalesce(quality, toxic, 5) AS e, if(quality = 1, 'good', 'other') AS f, nanvl(double('NaN'), 0D) AS g, isnull(quality) AS h,
isnotnull(quality) AS i, isnan(double(quality)) AS j FROM doc_labels""")


@query("f13_casts", """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(22,1)) AS VARCHAR) AS dc, substr(o_orderpriority, 1, 5) AS vc,
CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_custkey AS VARCHAR) AS s, TRY_CAST(o_orderpriority AS INTEGER) AS bad,
CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 0 AS INTEGER) AS coerced, strftime(CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE), '%d') AS dt FROM orders""")
def f13(spark, d):
    prio = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", cents("o_totalprice").cast("decimal(22,1)").cast("string").alias("dc"),
        F.substring(prio.cast("varchar(20)"), 1, 5).alias("vc"), F.col("o_totalprice").cast("bigint").alias("i"),
        F.col("o_custkey").cast("string").alias("s"), prio.try_cast("int").alias("bad"),
        F.try_subtract(F.substring(prio, 1, 1).try_cast("int"), F.lit(0)).alias("coerced"),
        F.date_format(F.date_format("o_orderdate", "yyyy-MM-dd").cast("date"), "dd").alias("dt"))


@query("f14_arrays", """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 4) AS doubled,
len(list_filter(embedding, lambda x: x > 0)) AS n_pos, len(list_filter(embedding, lambda x: x > 0.25)) > 0 AS any_big,
round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS sq, 3 AS lit,
list_contains([label, 1], 1) AS has_one FROM embeddings""")
def f14(spark, d):
    x = "CAST(x AS double)"
    return table(spark, d, "embeddings").select(
        "vec_id", F.size("embedding").alias("n"),
        F.expr(f"round(aggregate(transform(embedding, x -> {x} * 2), 0D, (a, x) -> a + x), 4)").alias("doubled"),
        F.size(F.filter("embedding", lambda v: v > 0)).alias("n_pos"), F.exists("embedding", lambda v: v > 0.25).alias("any_big"),
        F.expr(f"round(aggregate(embedding, 0D, (a, x) -> a + {x} * {x}), 4)").alias("sq"),
        F.size(F.array(F.lit(1), F.lit(None), F.lit(3))).alias("lit"),
        F.array_contains(F.array("label", F.lit(1)), 1).alias("has_one"))


@query("f15_maps", """SELECT c_custkey, 'name,segment' AS keys, array_to_string(list_sort([c_name, c_mktsegment]), ',') AS vals,
c_name AS got FROM customer""")
def f15(spark, d):
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return table(spark, d, "customer").select(
        "c_custkey", F.array_join(F.sort_array(F.map_keys(m)), ",").alias("keys"),
        F.array_join(F.sort_array(F.map_values(m)), ",").alias("vals"), F.element_at(m, "name").alias("got"))


@query("f16_structs", "SELECT p_partkey, p_name AS n, p_size + 1 AS s, p_brand AS b FROM part")
def f16(spark, d):
    register_views(spark, d, "part")
    return spark.sql("""SELECT p_partkey, struct(p_name, p_brand).p_name AS n, named_struct('size', p_size + 1, 'brand', p_brand).size AS s,
named_struct('size', p_size, 'brand', p_brand).brand AS b FROM part""")


@query("f17_json", """SELECT event_id, to_json({'id': event_id, 'type': event_type}) AS js,
'{"x":{"id":' || event_id || '}}' AS ms, '[{"t":"' || event_type || '"}]' AS am,
CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS ks, json_extract_string(props, '$.none') AS missing
FROM events""")
def f17(spark, d):
    register_views(spark, d, "events")
    return spark.sql("""SELECT event_id, to_json(named_struct('id', event_id, 'type', event_type)) AS js,
to_json(map('x', named_struct('id', event_id))) AS ms, to_json(array(map('t', event_type))) AS am,
from_json(props, 'k INT').k AS k, get_json_object(props, '$.k') AS ks, get_json_object(props, '$.none') AS missing FROM events""")


@query("f18_time_window", """SELECT 'tumbling' AS kind, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n
FROM events GROUP BY 1, 2, 3 UNION ALL SELECT 'sliding', strftime(s, '%Y-%m-%d %H:%M'), event_type, count(*) FROM (
SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events)
GROUP BY 1, 2, 3""")
def f18(spark, d):
    events = table(spark, d, "events", "ts", "event_type")

    def counted(kind, *span):
        return events.groupBy(F.window("ts", *span), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")

    return counted("tumbling", "1 hour").unionAll(counted("sliding", "1 hour", "30 minutes"))
