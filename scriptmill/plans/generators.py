"""Generators, script transform and user functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptmill.operators.lookup import KEYWORD_RULES, KeywordMatches, keyword_matches, rules_table
from scriptmill.plans.registry import query, sql_text
from scriptmill.sources.tables import register_views, table


@query("t01_explode", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def t01(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.explode("embedding").alias("x"))


@query("t02_explode_split", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
GROUP BY word""")
def t02(spark, d):
    return table(spark, d, "documents", "text").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


@query("t03_lateral_view", "SELECT label, v.x AS x FROM embeddings, unnest(embedding) AS v(x) WHERE v.x > 0.2")
def t03(spark, d):
    register_views(spark, d, "embeddings")
    return spark.sql("SELECT label, x FROM embeddings LATERAL VIEW explode(embedding) v AS x WHERE x > 0.2")


@query("t04_two_lateral_views", """SELECT page_id, a.part AS part, b.q AS q FROM pages,
unnest(string_split(regexp_replace(url, '[?#].*', ''), '/')) AS a(part),
unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS b(q)""")
def t04(spark, d):
    register_views(spark, d, "pages")
    return spark.sql(r"""SELECT page_id, part, q FROM pages
LATERAL VIEW explode(split(regexp_replace(url, '[?#].*', ''), '/')) a AS part
LATERAL VIEW explode(split(regexp_extract(url, r'\?([^#]*)', 1), '&')) b AS q""")


@query("t05_chained_explode", """SELECT doc_id, line_no, word FROM (
SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l
FROM documents)), unnest(string_split(line, ' ')) AS w(word) WHERE word <> ''""")
def t05(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.transform(
        F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.split(x, " ").alias("words")))).alias("line"))
    return lines.select("doc_id", F.col("line.no").cast("bigint").alias("line_no"),
                        F.explode("line.words").alias("word")).where("word <> ''")


@query("t06_lateral_outer", """SELECT doc_id, num FROM documents LEFT JOIN
(SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS num FROM documents) USING (doc_id)""")
def t06(spark, d):
    numbers = F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode_outer(numbers).alias("num"))


@query("t07_json_tuple", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.z') AS z FROM events")
def t07(spark, d):
    return table(spark, d, "events", "event_id", "props").select("event_id", F.json_tuple("props", "k", "z").alias("k", "z"))


@query("t07_json_tuple_view", """SELECT k, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) GROUP BY k""")
def t07_view(spark, d):
    register_views(spark, d, "events")
    return spark.sql("SELECT k, count(*) AS n FROM events LATERAL VIEW json_tuple(props, 'k') j AS k GROUP BY k")


@query("t08_posexplode", "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings")
def t08(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("pos", "x"))


@query("t08_inline", """SELECT c_custkey, 'name' AS field, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer""")
def t08_inline(spark, d):
    pairs = F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")),
                    F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")))
    return table(spark, d, "customer").select("c_custkey", F.inline(pairs))


@query("t09_sequence", """SELECT p_partkey, unnest(generate_series(1, p_size)) AS i FROM part
UNION ALL SELECT p_partkey, unnest(generate_series(0, p_size, 10)) + 1000 FROM part""")
def t09(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size")
    one = p.select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("i"))
    ten = p.select("p_partkey", (F.explode(F.sequence(F.lit(0), F.col("p_size"), F.lit(10)))).alias("i"))
    return one.unionAll(ten.select("p_partkey", F.col("i") + 1000))


@query("t10_stack", """SELECT s_suppkey, 'bal' AS field, CAST(s_acctbal AS VARCHAR) AS value FROM supplier
UNION ALL SELECT s_suppkey, 'name', s_name FROM supplier""")
def t10(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", F.stack(F.lit(2), F.lit("bal"), F.col("s_acctbal").cast("string"), F.lit("name"),
                             F.col("s_name")).alias("field", "value"))


@query("t11_script_transform", "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer")
def t11(spark, d):
    register_views(spark, d, "customer")
    return spark.sql("SELECT TRANSFORM(c_custkey, c_name) USING 'cat' AS (k STRING, name STRING) FROM customer")


@query("t11_map_in_pandas", """SELECT event_id, upper(event_type) AS kind, value * 2 AS doubled FROM events""")
def t11_pandas(spark, d):
    def double(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "kind": b["event_type"].str.upper(), "doubled": b["value"] * 2})

    return table(spark, d, "events", "event_id", "event_type", "value").mapInPandas(
        double, "event_id bigint, kind string, doubled double")


X01_TWIN = """SELECT o_orderkey, o_orderpriority FROM orders
WHERE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 AND length(o_orderpriority) > 6"""


@query("x01_udf_filter", X01_TWIN)
def x01_udf(spark, d):
    @F.pandas_udf(T.BooleanType())
    def urgent(priority: pd.Series) -> pd.Series:
        return (priority.str[:1].astype(int) <= 2) & (priority.str.len() > 6)

    return table(spark, d, "orders", "o_orderkey", "o_orderpriority").where(urgent("o_orderpriority"))


@query("x01_builtin_filter", X01_TWIN)
def x01_builtin(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders", "o_orderkey", "o_orderpriority").where(
        (F.substring(p, 1, 1).cast("int") <= 2) & (F.length(p) > 6))


RULES_SQL = "rules(prio, word, code) AS (VALUES " + ", ".join(
    f"({p}, {sql_text(w)}, {sql_text(c)})" for p, w, c in KEYWORD_RULES) + ")"

X02_TWIN = f"WITH {RULES_SQL} SELECT p_partkey, prio, code FROM part JOIN rules ON contains(p_name, word)"


@query("x02_udtf", X02_TWIN)
def x02_udtf(spark, d):
    spark.udtf.register("keyword_matches", KeywordMatches)
    register_views(spark, d, "part")
    return spark.sql("SELECT p_partkey, m.prio, m.code FROM part, LATERAL keyword_matches(p_name) m")


@query("x02_join_form", X02_TWIN)
def x02_join(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_name")
    return keyword_matches(parts, F.col("p_name"), rules_table(spark)).select("p_partkey", "prio", "code")
