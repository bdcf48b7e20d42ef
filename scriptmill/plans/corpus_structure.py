"""The token table and the structure tables derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.sqltext import NOT_FUNCTIONS, TOKEN, TYPE_NAMES, re2
from scriptmill.operators import lexing, lint, scopes, structure, tokens
from scriptmill.operators.structure import BY_WORDS, CLAUSE_WORDS, JOIN_WORDS, NAME_STOPS, QUERY_WORDS, SET_WORDS
from scriptmill.plans.corpus_lint import CORPUS
from scriptmill.plans.registry import TWINS, query, sql_text
from scriptmill.sources.corpus import SCOPE_SHAPES, SCRIPTS_SQL, scripts_from_orders, scripts_sql
from scriptmill.sources.sinks import work_database
from scriptmill.sources.tables import table


def names(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TOKENS = f"""{CORPUS},
lists AS (SELECT script_id, regexp_extract_all(sql, {sql_text(re2(TOKEN))}) AS l FROM scripts),
raw AS (SELECT script_id, unnest(l) AS tok, CAST(unnest(range(len(l))) AS INTEGER) AS pos FROM lists),
kinds AS (SELECT *, CASE WHEN tok = chr(10) THEN 'newline' WHEN starts_with(tok, '--') THEN 'line_comment'
  WHEN starts_with(tok, '/*') AND length(tok) >= 4 THEN 'block_comment'
  WHEN (starts_with(tok, '''') OR starts_with(tok, '"')) AND length(tok) >= 2 THEN 'string'
  WHEN regexp_matches(tok, '^\\$?\\{{\\w') THEN 'parameter'
  WHEN regexp_matches(tok, '^[A-Za-z_]|^`.') THEN 'ident'
  WHEN regexp_matches(tok, '^[0-9]') THEN 'number' ELSE 'op' END AS kind,
  length(tok) - length(replace(tok, chr(10), '')) AS nl,
  CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS step FROM raw),
lev AS (SELECT *, CAST(1 + coalesce(sum(nl) OVER b, 0) AS INTEGER) AS line, coalesce(sum(step) OVER b, 0) AS opened
  FROM kinds WINDOW b AS (PARTITION BY script_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev2 AS (SELECT *, CAST(least(opened, opened + step) AS INTEGER) AS level FROM lev),
tokens AS (SELECT script_id, pos, tok, kind, CASE WHEN kind = 'ident' THEN upper(tok) ELSE tok END AS u, line, level,
  step, CAST(1 + coalesce(sum(CASE WHEN tok = ';' AND level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY script_id
    ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS stmt_no FROM lev2),
code AS (SELECT *, lag(u, 1) OVER s AS prev1, lag(u, 2) OVER s AS prev2, lead(u, 1) OVER s AS next1,
  lead(u, 2) OVER s AS next2, lead(u, 3) OVER s AS next3, lead(u, 4) OVER s AS next4, lead(u, 5) OVER s AS next5,
  lag(tok, 1) OVER s AS ptok, lead(tok, 1) OVER s AS tok1, lead(tok, 2) OVER s AS tok2, lead(tok, 3) OVER s AS tok3,
  first_value(u) OVER s AS u1
  FROM tokens WHERE kind NOT IN ('newline', 'line_comment', 'block_comment') AND NOT (tok = ';' AND level = 0)
  WINDOW s AS (PARTITION BY script_id, stmt_no ORDER BY pos))"""

RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
STMT = "PARTITION BY script_id, stmt_no"


def agg_text(cond: str = "true", sep: str = " ", value: str = "tok") -> str:
    return f"coalesce(string_agg({value}, '{sep}' ORDER BY pos) FILTER (WHERE {cond}), '')"


def segments_sql(source: str, start: str, extra: str = "") -> str:
    """Chained CTE bodies seg0 .. seg for the rows of ``source`` cut at ``start``."""
    keys = f"script_id, stmt_no{extra}"
    return f"""
seg0 AS (SELECT *, CASE WHEN {start} THEN 1 ELSE 0 END AS is_start FROM {source}),
seg1 AS (SELECT *, sum(is_start) OVER (PARTITION BY {keys} ORDER BY pos {RUN}) AS seg_no FROM seg0),
seg2 AS (SELECT *, max(CASE WHEN is_start = 1 THEN level END) OVER (PARTITION BY {keys}, seg_no) AS seg_level
  FROM seg1 WHERE seg_no > 0),
seg AS (SELECT *, sum(CASE WHEN tok = ')' AND level = seg_level THEN 1 ELSE 0 END)
  OVER (PARTITION BY {keys}, seg_no ORDER BY pos {RUN}) AS closed FROM seg2)"""


@query("a01_tokens", f"{TOKENS} SELECT script_id, pos, tok, kind, line FROM tokens")
def a01(spark, d):
    return tokens.tokens(scripts_from_orders(spark, d)).select("script_id", "pos", "tok", "kind", "line")


# One script per day, with the statements of all orders of that day.
DAILY = f"""WITH single AS ({SCRIPTS_SQL}),
scripts AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS script_id, string_agg(sql, ';' || chr(10) ORDER BY single.script_id) AS sql
  FROM single JOIN orders ON script_id = o_orderkey GROUP BY ALL)"""
DAILY_PIECE = 1024


def daily_scripts(spark, d):
    scripts = scripts_from_orders(spark, d)
    days = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    rows = scripts.join(days, scripts["script_id"] == days["o_orderkey"]).select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.struct("script_id", "sql").alias("s"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["sql"]), ";\n")
    return rows.groupBy(F.col("day").alias("script_id")).agg(together.alias("sql"))


@query("a01_large_scripts", f"{TOKENS.replace(CORPUS, DAILY)} SELECT script_id, pos, tok, kind, line, level, stmt_no FROM tokens")
def a01_large(spark, d):
    return lexing.large_tokens(daily_scripts(spark, d), DAILY_PIECE).drop("u")


@query(
    "a03_large_statements",
    f"""{TOKENS.replace(CORPUS, DAILY)} SELECT script_id, stmt_no, min(line) AS first_line, max(line) AS last_line, count(*) AS n_tokens,
max(level) AS max_level FROM code GROUP BY script_id, stmt_no""",
)
def a03_large(spark, d):
    code = lexing.large_tokens(daily_scripts(spark, d), DAILY_PIECE).where(
        "kind NOT IN ('newline', 'line_comment', 'block_comment') AND NOT (tok = ';' AND level = 0)")
    return code.groupBy("script_id", "stmt_no").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n_tokens"),
        F.max("level").alias("max_level"))


@query(
    "a02_paren_balance",
    f"""{TOKENS} SELECT script_id, max(level + CASE WHEN tok = '(' THEN 1 ELSE 0 END) AS max_level,
CAST(sum(step) AS BIGINT) AS balance, sum(step) <> 0 OR min(level) < 0 AS is_unbalanced FROM tokens GROUP BY script_id""",
)
def a02(spark, d):
    return tokens.paren_balance(scripts_from_orders(spark, d))


@query(
    "a03_statements",
    f"""{TOKENS} SELECT script_id, stmt_no, min(line) AS first_line, max(line) AS last_line, count(*) AS n_tokens,
max(level) AS max_level, string_agg(u, ' ' ORDER BY pos) AS text_norm FROM code GROUP BY script_id, stmt_no""",
)
def a03(spark, d):
    return tokens.statements(scripts_from_orders(spark, d))


@query("a03_statements_stored", TWINS["a03_statements"])
def a03_stored(spark, d):
    """The same from a token table that is written once and bucketed by script."""
    name = f"{work_database(spark)}.tokens"
    return tokens.statements(tokens.store_tokens(scripts_from_orders(spark, d), name))


@query(
    "a04_comments",
    f"""{TOKENS} SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY pos) AS seq,
CASE WHEN kind = 'line_comment' THEN 'line' ELSE 'block' END AS kind,
regexp_replace(CASE WHEN kind = 'line_comment' THEN tok[3:] ELSE tok[3:length(tok) - 2] END, '^\\s+|\\s+$', '', 'g')
  AS content, line
FROM tokens WHERE kind IN ('line_comment', 'block_comment')""",
)
def a04(spark, d):
    return tokens.comments(scripts_from_orders(spark, d))


@query(
    "a13_statement_kinds",
    f"""{TOKENS}, ranked AS (SELECT *, row_number() OVER ({STMT} ORDER BY pos) AS n FROM code),
words AS (SELECT script_id, stmt_no, max(u) FILTER (WHERE n = 1) AS w1, max(u) FILTER (WHERE n = 2) AS w2,
  max(u) FILTER (WHERE n = 3) AS w3, bool_or(u = 'AS' AND level = 0 AND next1 IN ('SELECT', '(', 'WITH')) AS as_query,
  bool_or(u = 'PARTITION' AND level = 0) AS partitioned FROM ranked GROUP BY script_id, stmt_no)
SELECT script_id, stmt_no, CASE
  WHEN w1 = 'DROP' AND w2 = 'DATABASE' THEN 'DROP DATABASE' WHEN w1 = 'DROP' THEN 'DROP'
  WHEN w1 = 'CREATE' AND w2 = 'DATABASE' THEN 'CREATE DATABASE'
  WHEN w1 = 'CREATE' AND w2 = 'TABLE' AND as_query THEN 'CREATE TABLE AS SELECT'
  WHEN w1 = 'CREATE' AND w2 = 'TABLE' THEN 'CREATE TABLE'
  WHEN w1 = 'CREATE' AND (w2 = 'VIEW' OR (w2 IN ('TEMPORARY', 'TEMP') AND w3 = 'VIEW')
    OR (w2 = 'OR' AND w3 = 'REPLACE')) THEN 'CREATE VIEW'
  WHEN w1 = 'CREATE' AND w2 = 'FUNCTION' THEN 'CREATE FUNCTION'
  WHEN w1 = 'INSERT' AND partitioned THEN 'INSERT PARTITION' WHEN w1 = 'DESC' THEN 'DESCRIBE'
  WHEN w1 IN ('ALTER', 'TRUNCATE', 'ANALYZE', 'INSERT', 'UPDATE', 'DELETE', 'MERGE', 'WITH', 'CACHE', 'UNCACHE',
    'REFRESH', 'EXPLAIN', 'SHOW', 'DESCRIBE', 'USE', 'SET', 'SELECT') THEN w1 ELSE 'OTHER' END AS kind FROM words""",
)
def a13(spark, d):
    return structure.statement_kinds(scripts_from_orders(spark, d))


CLAUSES = f"""
cl0 AS (SELECT *, CASE WHEN kind = 'ident' AND level = 0 AND (u IN {names(CLAUSE_WORDS)}
    OR (u IN {names(BY_WORDS)} AND next1 = 'BY')
    OR (u IN {names(JOIN_WORDS[:5])} AND next1 IN ('JOIN', 'OUTER', 'SEMI', 'ANTI'))
    OR (u IN ('SEMI', 'ANTI') AND next1 = 'JOIN' AND coalesce(prev1, '') NOT IN {names(JOIN_WORDS)})
    OR (u = 'JOIN' AND coalesce(prev1, '') NOT IN {names(JOIN_WORDS)})) THEN 1 ELSE 0 END AS starts FROM {{source}}),
cl AS (SELECT *, sum(starts) OVER ({STMT} ORDER BY pos {RUN}) AS clause_no,
  coalesce(last_value(CASE WHEN starts = 1 THEN CASE WHEN u IN {names(BY_WORDS)} THEN u || ' BY'
    WHEN u IN {names([*JOIN_WORDS, 'JOIN'])} THEN 'JOIN' ELSE u END END IGNORE NULLS)
    OVER ({STMT} ORDER BY pos {RUN}), 'HEAD') AS clause FROM cl0)"""


@query(
    "a20_clauses",
    f"""{TOKENS},{CLAUSES.format(source='code')}
SELECT script_id, stmt_no, CAST(clause_no AS BIGINT) AS clause_no, clause, count(*) AS n_tokens, {agg_text()} AS text
FROM cl GROUP BY script_id, stmt_no, clause_no, clause""",
)
def a20(spark, d):
    return structure.clauses(scripts_from_orders(spark, d))


@query(
    "a21_select_fields",
    f"""{TOKENS},
notes AS (SELECT *, max(CASE WHEN kind NOT IN ('line_comment', 'block_comment') THEN pos END)
    OVER (PARTITION BY script_id ORDER BY pos {RUN}) AS code_pos FROM tokens WHERE kind <> 'newline'),
note AS (SELECT c.script_id, c.code_pos, arg_min(c.tok, c.pos) AS note FROM notes c JOIN tokens t
  ON c.script_id = t.script_id AND c.code_pos = t.pos AND c.line = t.line
  WHERE c.kind IN ('line_comment', 'block_comment') GROUP BY c.script_id, c.code_pos),
noted AS (SELECT code.*, note.note FROM code LEFT JOIN note
  ON code.script_id = note.script_id AND code.pos = note.code_pos),{CLAUSES.format(source='noted')},
f0 AS (SELECT *, CASE WHEN tok = ',' AND level = 0 THEN 1 ELSE 0 END AS is_comma FROM cl WHERE clause = 'SELECT'),
f1 AS (SELECT *, 1 + coalesce(sum(is_comma) OVER (PARTITION BY script_id, stmt_no, clause_no ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM f0),
f2 AS (SELECT *, row_number() OVER fw AS n, coalesce(lead(is_comma) OVER fw, 1) = 1 AND is_comma = 0 AS is_last FROM f1
  WHERE NOT (u = 'SELECT' AND level = 0) AND NOT (u IN ('DISTINCT', 'ALL') AND prev1 = 'SELECT')
  WINDOW fw AS (PARTITION BY script_id, stmt_no, clause_no, ordinal ORDER BY pos)),
f3 AS (SELECT script_id, stmt_no, clause_no, ordinal, {agg_text('is_comma = 0')} AS text,
  max(tok) FILTER (WHERE is_last AND n > 1 AND kind = 'ident' AND level = 0 AND (prev1 = 'AS' OR (
    u NOT IN ('END', 'NULL', 'TRUE', 'FALSE') AND regexp_matches(prev1, '^[A-Za-z0-9_''"`)]')))) AS alias,
  bool_or(is_last AND n > 1 AND kind = 'ident' AND level = 0 AND prev1 = 'AS') AS has_as,
  arg_min(note, pos) FILTER (WHERE note IS NOT NULL) AS note
  FROM f2 GROUP BY script_id, stmt_no, clause_no, ordinal)
SELECT script_id, stmt_no, CAST(clause_no AS BIGINT) AS clause_no, CAST(ordinal AS BIGINT) AS ordinal,
  CASE WHEN alias IS NULL THEN text WHEN has_as THEN text[1:length(text) - length(alias) - 4]
    ELSE text[1:length(text) - length(alias) - 1] END AS expression,
  coalesce(alias, '') AS alias, coalesce(note, '') AS note FROM f3""",
)
def a21(spark, d):
    return structure.select_fields(scripts_from_orders(spark, d))


@query(
    "a22_joins",
    f"""{TOKENS}, named AS (SELECT *, CASE WHEN next2 = '.' THEN next4 ELSE next2 END AS aft,
  CASE WHEN next2 = '.' THEN next5 ELSE next3 END AS aft2 FROM code),
aliased AS (SELECT *, CASE WHEN aft = 'AS' THEN aft2 ELSE aft END AS al FROM named),
{segments_sql('aliased', "u = 'JOIN'", ', level')}
SELECT script_id, stmt_no, level, CAST(seg_no AS BIGINT) AS join_no,
  max(CASE WHEN prev1 IN ('OUTER', 'SEMI', 'ANTI') AND prev2 IN {names(JOIN_WORDS)} THEN prev2 || ' ' || prev1
    WHEN prev1 IN {names(JOIN_WORDS)} THEN prev1 ELSE 'INNER' END) FILTER (WHERE is_start = 1) AS join_type,
  max(CASE WHEN next1 = '(' OR (next1 = 'LATERAL' AND next2 = '(') THEN '(subquery)' WHEN next1 = 'LATERAL' THEN replace(tok2, '`', '')
    WHEN next2 = '.' THEN replace(tok1 || '.' || tok3, '`', '') ELSE replace(tok1, '`', '') END) FILTER (WHERE is_start = 1) AS table_name,
  coalesce(max(CASE WHEN next1 NOT IN ('(', 'LATERAL') AND regexp_matches(al, '^[A-Z_]') AND al NOT IN {names(NAME_STOPS)}
    THEN lower(al) END) FILTER (WHERE is_start = 1), '') AS alias,
  max(CASE WHEN u IN ('ON', 'USING') THEN 1 ELSE 0 END) AS has_condition
FROM seg GROUP BY script_id, stmt_no, level, seg_no""",
)
def a22(spark, d):
    return structure.joins(scripts_from_orders(spark, d))


@query(
    "a23_set_segments",
    f"""{TOKENS}, ops AS (SELECT *, CASE WHEN level = 0 AND kind = 'ident' AND u IN {names(SET_WORDS)} THEN 1 ELSE 0 END
  AS is_op, CASE WHEN level = 0 AND u IN ('ALL', 'DISTINCT') AND prev1 IN {names(SET_WORDS)} THEN 1 ELSE 0 END AS is_mod
  FROM code),
cut AS (SELECT *, sum(is_op) OVER ({STMT} ORDER BY pos {RUN}) AS seg_no FROM ops)
SELECT script_id, stmt_no, CAST(seg_no AS BIGINT) AS seg_no,
  coalesce(max(CASE WHEN next1 = 'ALL' THEN u || ' ALL' ELSE u END) FILTER (WHERE is_op = 1), '') AS operator,
  count(*) FILTER (WHERE is_op = 0 AND is_mod = 0) AS n_tokens, {agg_text('is_op = 0 AND is_mod = 0')} AS text
FROM cut GROUP BY script_id, stmt_no, seg_no""",
)
def a23(spark, d):
    return structure.set_segments(scripts_from_orders(spark, d))


@query(
    "a24_ctes",
    f"""{TOKENS}, withs AS (SELECT *, max(CASE WHEN level = 0 AND u IN {names(QUERY_WORDS)} THEN 1 ELSE 0 END)
  OVER ({STMT}) AS has_main FROM code WHERE u1 = 'WITH'),
{segments_sql('withs', "level = 0 AND kind = 'ident' AND next1 = 'AS' AND next2 = '(' AND prev1 IN ('WITH', 'RECURSIVE', ',')")}
SELECT script_id, stmt_no, CAST(seg_no AS BIGINT) AS cte_no, has_main, max(tok) FILTER (WHERE is_start = 1) AS name,
  min(line) FILTER (WHERE closed = 0 AND level > seg_level) AS first_line,
  max(line) FILTER (WHERE closed = 0 AND level > seg_level) AS last_line,
  count(*) FILTER (WHERE closed = 0 AND level > seg_level) AS n_tokens
FROM seg GROUP BY script_id, stmt_no, seg_no, has_main""",
)
def a24(spark, d):
    return structure.ctes(scripts_from_orders(spark, d))


CREATE_TABLE = f"""
ct0 AS (SELECT *, max(CASE WHEN prev1 = 'CREATE' AND u = 'TABLE' THEN 1 ELSE 0 END) OVER ({STMT}) AS is_table,
  sum(CASE WHEN u = 'AS' AND level = 0 AND next1 IN ('SELECT', 'WITH', '(') THEN 1 ELSE 0 END)
    OVER ({STMT} ORDER BY pos {RUN}) AS as_seen,
  CASE WHEN kind = 'ident' AND level = 0 AND ((prev1 = 'TABLE' AND u <> 'IF') OR (prev1 = 'EXISTS' AND prev2 = 'NOT'))
    THEN lower(CASE WHEN next1 = '.' THEN u || '.' || next2 ELSE u END) END AS nm FROM code),
ct1 AS (SELECT *, first_value(nm IGNORE NULLS) OVER ({STMT} ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS table_name,
  sum(CASE WHEN tok = '(' AND level = 0 THEN 1 ELSE 0 END) OVER ({STMT} ORDER BY pos {RUN}) AS group_no FROM ct0),
ct AS (SELECT *, max(CASE WHEN tok = '(' AND level = 0 AND prev1 = 'BY' AND prev2 = 'PARTITIONED' THEN 'partition'
  WHEN tok = '(' AND level = 0 AND group_no = 1 THEN 'column' END) OVER (PARTITION BY script_id, stmt_no, group_no)
  AS group_kind FROM ct1 WHERE u1 = 'CREATE' AND is_table = 1 AND as_seen = 0)"""

UNQUOTE = "replace(tok[2:length(tok) - 1], '''''', '''')"


@query(
    "a25_ddl_columns",
    f"""{TOKENS},{CREATE_TABLE},
c0 AS (SELECT *, 1 + sum(CASE WHEN tok = ',' AND level = 1 THEN 1 ELSE 0 END)
  OVER (PARTITION BY script_id, stmt_no, group_no ORDER BY pos {RUN}) AS ordinal
  FROM ct WHERE level >= 1 AND group_kind IS NOT NULL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY script_id, stmt_no, group_no, ordinal ORDER BY pos) AS n
  FROM c0 WHERE NOT (tok = ',' AND level = 1)),
c2 AS (SELECT *, sum(CASE WHEN n > 1 AND u IN ('COMMENT', 'NOT', 'NULL', 'DEFAULT', 'PRIMARY') THEN 1 ELSE 0 END)
  OVER (PARTITION BY script_id, stmt_no, group_no, ordinal ORDER BY pos {RUN}) AS past_type FROM c1)
SELECT script_id, stmt_no, table_name, CAST(ordinal AS BIGINT) AS ordinal, max(tok) FILTER (WHERE n = 1) AS name,
  lower({agg_text('n > 1 AND past_type = 0', '')}) AS type,
  coalesce(max({UNQUOTE}) FILTER (WHERE n > 2 AND prev1 = 'COMMENT'), '') AS comment,
  group_kind = 'partition' AS is_partition
FROM c2 GROUP BY script_id, stmt_no, table_name, group_no, group_kind, ordinal""",
)
def a25(spark, d):
    return structure.ddl_columns(scripts_from_orders(spark, d))


@query(
    "a26_table_options",
    f"""{TOKENS},{CREATE_TABLE},
o AS (SELECT *, last_value(CASE WHEN level = 0 AND group_no >= 1 AND u IN ('COMMENT', 'PARTITIONED', 'ROW', 'STORED',
  'USING', 'LOCATION', 'TBLPROPERTIES') THEN u END IGNORE NULLS) OVER ({STMT} ORDER BY pos {RUN}) AS section FROM ct)
SELECT script_id, stmt_no, table_name,
  coalesce(max({UNQUOTE}) FILTER (WHERE level = 0 AND prev1 = 'COMMENT' AND kind = 'string'), '') AS comment,
  {agg_text("section = 'PARTITIONED' AND level >= 1")} AS partitioned_by,
  {agg_text("section = 'ROW' AND u NOT IN ('ROW', 'FORMAT')")} AS row_format,
  {agg_text("section = 'STORED' AND u NOT IN ('STORED', 'AS')")} AS stored_as
FROM o GROUP BY script_id, stmt_no, table_name""",
)
def a26(spark, d):
    return structure.table_options(scripts_from_orders(spark, d))


def case_depth_sql(source: str) -> str:
    opens = "u = 'CASE' AND coalesce(prev1, '') <> '.'"
    closes = "u = 'END' AND coalesce(prev1, '') <> '.'"
    return f"""
cs AS (SELECT *, coalesce(sum(CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END) OVER ({STMT} ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_blocks FROM {source}),
cd AS (SELECT *, open_blocks - least(0, min(open_blocks) OVER ({STMT} ORDER BY pos {RUN}))
  + CASE WHEN {opens} THEN 1 ELSE 0 END AS case_depth FROM cs)"""


@query(
    "a27_merge_parts",
    f"""{TOKENS}, merges AS (SELECT * FROM code WHERE u1 = 'MERGE'),{case_depth_sql('merges')},
m0 AS (SELECT *, CASE WHEN u = 'INTO' AND prev1 = 'MERGE' THEN 'target' WHEN level <> 0 OR case_depth <> 0 THEN NULL
  WHEN u = 'USING' THEN 'source' WHEN u = 'ON' THEN 'on' WHEN u = 'WHEN' THEN 'when' WHEN u = 'THEN' THEN 'action' END
  AS mark FROM cd),
m1 AS (SELECT *, last_value(mark IGNORE NULLS) OVER ({STMT} ORDER BY pos {RUN}) AS part,
  sum(CASE WHEN mark = 'when' THEN 1 ELSE 0 END) OVER ({STMT} ORDER BY pos {RUN}) AS branch_no FROM m0)
SELECT script_id, stmt_no, CAST(branch_no AS BIGINT) AS branch_no, part, {agg_text()} AS text
FROM m1 WHERE mark IS NULL AND part IS NOT NULL GROUP BY script_id, stmt_no, branch_no, part""",
)
def a27(spark, d):
    return structure.merge_parts(scripts_from_orders(spark, d))


_BODY = "has_body = 1 AND closed = 0 AND level > seg_level"
_WORD = "(level = seg_level + 1 AND u IN ('PARTITION', 'ORDER', 'BY'))"


@query(
    "a28_window_specs",
    f"""{TOKENS}, wc AS (SELECT *, sum(CASE WHEN u = 'WINDOW' AND level = 0 AND kind = 'ident' THEN 1 ELSE 0 END)
  OVER ({STMT} ORDER BY pos {RUN}) AS at_window,
  lag(u, 3) OVER lv AS called3, lag(u, 6) OVER lv AS called6 FROM code
  WINDOW lv AS (PARTITION BY script_id, stmt_no, level ORDER BY pos)),
{segments_sql('wc', "(u = 'OVER' AND kind = 'ident') OR (u = 'AS' AND next1 = '(' AND level = 0 AND at_window > 0)")},
sect AS (SELECT *, max(CASE WHEN is_start = 1 AND next1 = '(' THEN 1 ELSE 0 END) OVER (PARTITION BY script_id, stmt_no,
  seg_no) AS has_body, last_value(CASE WHEN level = seg_level + 1 AND u IN ('PARTITION', 'ORDER', 'ROWS', 'RANGE')
  THEN u END IGNORE NULLS) OVER (PARTITION BY script_id, stmt_no, seg_no ORDER BY pos {RUN}) AS section FROM seg)
SELECT script_id, stmt_no, CAST(seg_no AS BIGINT) AS spec_no,
  lower(coalesce(max(CASE WHEN called3 = 'FILTER' THEN called6 ELSE called3 END)
    FILTER (WHERE is_start = 1 AND u = 'OVER'), '')) AS function,
  coalesce(max(CASE WHEN u = 'AS' THEN ptok WHEN next1 <> '(' THEN tok1 END) FILTER (WHERE is_start = 1), '')
    AS window_name,
  {agg_text(f"{_BODY} AND section = 'PARTITION' AND NOT {_WORD}")} AS partition_by,
  {agg_text(f"{_BODY} AND section = 'ORDER' AND NOT {_WORD}")} AS order_by,
  {agg_text(f"{_BODY} AND section IN ('ROWS', 'RANGE') AND NOT {_WORD}")} AS frame
FROM sect GROUP BY script_id, stmt_no, seg_no""",
)
def a28(spark, d):
    return structure.window_specs(scripts_from_orders(spark, d))


_STOPS = names(["WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "DISTRIBUTE", "CLUSTER", "SORT", "WINDOW", "JOIN",
                *JOIN_WORDS, *SET_WORDS])


@query(
    "a29_lateral_views",
    f"""{TOKENS},
{segments_sql('code', "u = 'LATERAL' AND next1 = 'VIEW'")},
l0 AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN level < seg_level OR (closed > 0 AND level = seg_level
  AND u IN {_STOPS}) THEN 1 ELSE 0 END) OVER (w {RUN}) AS ended FROM seg
  WINDOW w AS (PARTITION BY script_id, stmt_no, seg_no ORDER BY pos)),
l1 AS (SELECT *, CASE WHEN closed = 1 AND ended = 0 AND tok <> ')' THEN 1 ELSE 0 END AS post FROM l0),
l2 AS (SELECT *, sum(post) OVER (w {RUN}) AS after_no,
  sum(CASE WHEN post = 1 AND u = 'AS' THEN 1 ELSE 0 END) OVER (w {RUN}) AS as_seen FROM l1
  WINDOW w AS (PARTITION BY script_id, stmt_no, seg_no ORDER BY pos))
SELECT script_id, stmt_no, CAST(seg_no AS BIGINT) AS view_no,
  max(CASE WHEN n = 3 AND u = 'OUTER' THEN 1 ELSE 0 END) AS is_outer,
  lower(max(u) FILTER (WHERE (prev1 = 'OUTER' AND n = 4) OR (prev1 <> 'OUTER' AND n = 3 AND u <> 'OUTER'))) AS generator,
  {agg_text('closed = 0 AND level > seg_level')} AS args,
  coalesce(max(tok) FILTER (WHERE post = 1 AND after_no = 1 AND u <> 'AS'), '') AS table_alias,
  {agg_text("post = 1 AND as_seen > 0 AND u <> 'AS' AND tok <> ','", ',')} AS columns
FROM l2 GROUP BY script_id, stmt_no, seg_no""",
)
def a29(spark, d):
    return structure.lateral_views(scripts_from_orders(spark, d))


@query(
    "a30_case_blocks",
    f"""{TOKENS},{case_depth_sql('code')},
b AS (SELECT *, sum(CASE WHEN u = 'CASE' THEN 1 ELSE 0 END) OVER (PARTITION BY script_id, stmt_no, case_depth
  ORDER BY pos {RUN}) AS block_no FROM cd WHERE case_depth > 0)
SELECT script_id, stmt_no, CAST(case_depth AS BIGINT) AS case_depth, CAST(block_no AS BIGINT) AS block_no,
  min(line) AS line, count(*) FILTER (WHERE u = 'WHEN') AS n_branches, max(CASE WHEN u = 'ELSE' THEN 1 ELSE 0 END)
  AS has_else FROM b GROUP BY script_id, stmt_no, case_depth, block_no""",
)
def a30(spark, d):
    return structure.case_blocks(scripts_from_orders(spark, d))


@query(
    "a31_subquery_depth",
    f"""{TOKENS} SELECT script_id, stmt_no, count(*) AS n_selects, max(level) AS max_depth FROM code
WHERE u = 'SELECT' AND kind = 'ident' GROUP BY script_id, stmt_no""",
)
def a31(spark, d):
    return structure.subquery_depth(scripts_from_orders(spark, d))


# The built-in functions that occur in the corpus; the job itself asks the session for all of them.
CORPUS_BUILTINS = ["cast", "count", "year", "max", "row_number", "explode", "sum", "avg", "posexplode", "json_tuple",
                   "extract", "upper", "trim"]


@query(
    "a32_function_calls",
    f"""{TOKENS} SELECT script_id, lower(tok) AS function, count(*) AS n_calls,
  lower(tok) IN {names(CORPUS_BUILTINS)} AS is_builtin
FROM code WHERE kind = 'ident' AND next1 = '(' AND u NOT IN {names(NOT_FUNCTIONS)} AND u NOT IN {names(TYPE_NAMES)}
  AND coalesce(prev1, '') NOT IN ('INTO', 'TABLE', 'EXISTS', 'AS', '.') GROUP BY script_id, lower(tok)""",
)
def a32(spark, d):
    return structure.function_calls(scripts_from_orders(spark, d))


# Each token with the query it stands in: its parentheses (lv, grp) and the last clause word inside them.
PARTS = f"""{TOKENS},
p0 AS (SELECT *, level + CASE WHEN tok = '(' THEN 1 ELSE 0 END AS lv, lead(tok, 6) OVER s AS tok6,
  lag(u, 3) OVER s AS prev3, lag(u, 4) OVER s AS prev4, kind = 'ident' AND coalesce(prev1, '') <> '.' AS plain
  FROM code WINDOW s AS ({STMT} ORDER BY pos)),
p1 AS (SELECT *, sum(CASE WHEN tok = '(' THEN 1 ELSE 0 END) OVER ({STMT}, lv ORDER BY pos {RUN}) AS grp FROM p0),
p2 AS (SELECT *, max(CASE WHEN plain AND u = 'SELECT' THEN 1 ELSE 0 END) OVER ({STMT}, lv, grp ORDER BY pos {RUN}) AS in_select FROM p1),
p3 AS (SELECT *, plain AND u = 'FROM' AND (in_select = 1 OR lv = 0)
  AND NOT (coalesce(prev1, '') = 'DISTINCT' AND coalesce(prev2, '') IN ('IS', 'NOT')) AS is_from FROM p2),
p4 AS (SELECT *, CASE WHEN is_from THEN 'FROM' WHEN plain AND u IN ('JOIN', 'ON', 'USING', 'WHERE', 'GROUP', 'ORDER', 'HAVING',
  'LIMIT', 'SELECT', 'LATERAL', 'WINDOW', 'SET', 'VALUES', 'WHEN', 'DISTRIBUTE', 'CLUSTER', 'SORT', 'UNION', 'INTERSECT',
  'EXCEPT', 'MINUS') THEN u END AS clause_word FROM p3),
parts AS (SELECT *, coalesce(last_value(clause_word IGNORE NULLS) OVER (g {RUN}), '') AS part, coalesce(lag(u) OVER g, '') AS gprev,
  coalesce(lag(is_from) OVER g, false) AS after_from, coalesce(lead(u, 1) OVER g, '') AS gnext1, coalesce(lead(u, 2) OVER g, '') AS gnext2,
  last_value(CASE WHEN kind = 'ident' AND u IN ('SELECT', 'FROM', 'WHERE', 'ON', 'HAVING', 'GROUP', 'ORDER') THEN u END IGNORE NULLS)
    OVER ({STMT}, level ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS outer_part
  FROM p4 WINDOW g AS ({STMT}, lv, grp ORDER BY pos)),
named AS (SELECT *, replace(lower(CASE WHEN next1 = '.' AND next3 = '.' THEN u || '.' || next2 || '.' || next4
  WHEN next1 = '.' THEN u || '.' || next2 ELSE u END), '`', '') AS full_name,
  last_value(CASE WHEN u IN ('WITH', 'RECURSIVE', 'SELECT', 'FROM', 'INSERT', 'WINDOW') THEN u END IGNORE NULLS)
    OVER ({STMT}, lv, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_word FROM parts),
heads AS (SELECT script_id, stmt_no, pos, level, full_name AS name, last_word = 'RECURSIVE' AS rec, next1 = '(' AS has_columns FROM named
  WHERE kind = 'ident' AND last_word IN ('WITH', 'RECURSIVE') AND prev1 IN ('WITH', 'RECURSIVE', ',') AND next1 IN ('AS', '(')),
ctes AS (SELECT h.script_id, h.stmt_no, h.name, CASE WHEN rec THEN h.pos
    ELSE list_sort(list(c.pos) FILTER (WHERE c.level = h.level))[CASE WHEN has_columns THEN 2 ELSE 1 END] END AS seen_from,
  coalesce(min(c.pos) FILTER (WHERE c.level = h.level - 1), 2147483647) AS seen_to
  FROM heads h JOIN parts c ON c.script_id = h.script_id AND c.stmt_no = h.stmt_no AND c.tok = ')' AND c.pos > h.pos
  GROUP BY h.script_id, h.stmt_no, h.name, h.pos, rec, has_columns),
refs AS (SELECT script_id, stmt_no, pos, full_name AS table_name,
  CASE WHEN kind <> 'ident' OR u IN ('SELECT', 'IF', 'TABLE', 'LATERAL', 'VALUES', 'ONLY') THEN NULL
    WHEN (prev1 IN ('INTO', 'OVERWRITE', 'TABLE') AND level = 0)
      OR (prev1 = 'EXISTS' AND u1 IN ('CREATE', 'DROP') AND level = 0) OR (prev1 = 'UPDATE' AND u1 = 'UPDATE')
      OR (prev1 = 'FROM' AND u1 = 'DELETE' AND level = 0) THEN 'write'
    WHEN ((prev1 = 'FROM' AND after_from) OR prev1 = 'JOIN' OR (gprev = ',' AND part IN ('FROM', 'JOIN', 'ON'))
      OR (prev1 = 'USING' AND u1 = 'MERGE' AND level = 0)) AND coalesce(next1, '') <> '(' THEN 'read' END AS access FROM named),
places AS (SELECT r.*, EXISTS (SELECT 1 FROM ctes c WHERE c.script_id = r.script_id AND c.stmt_no = r.stmt_no AND c.name = r.table_name
    AND r.pos BETWEEN c.seen_from AND c.seen_to) AS is_with FROM refs r WHERE access IS NOT NULL),
table_names AS (SELECT DISTINCT script_id, stmt_no, table_name, access FROM places WHERE access = 'write' OR NOT is_with)"""


@query("a33_table_refs", f"{PARTS} SELECT * FROM table_names")
def a33(spark, d):
    return scopes.table_refs(scripts_from_orders(spark, d))


@query("a33_scoped_names", f"""{PARTS.replace(SCRIPTS_SQL, scripts_sql(SCOPE_SHAPES))}
SELECT script_id, stmt_no, table_name, access, count(*) AS n_places, count(*) FILTER (WHERE is_with) AS n_with FROM places GROUP BY ALL""")
def a33_scoped(spark, d):
    return scopes.name_places(scripts_from_orders(spark, d, SCOPE_SHAPES))


@query("a22_lateral_joins", TWINS["a22_joins"].replace(SCRIPTS_SQL, scripts_sql(SCOPE_SHAPES)))
def a22_lateral(spark, d):
    return structure.joins(scripts_from_orders(spark, d, SCOPE_SHAPES))


_CALL = f"""kind = 'ident' AND next1 = '(' AND part = 'WHERE' AND u NOT IN {names(TYPE_NAMES)} AND u NOT IN ('IN', 'AND', 'OR', 'NOT',
  'EXISTS', 'WHERE', 'ON', 'WHEN', 'THEN', 'ELSE', 'BETWEEN', 'LIKE', 'SELECT', 'AS', 'OVER', 'VALUES', 'USING', 'FROM', 'JOIN', 'BY',
  'ANY', 'ALL', 'SOME', 'INTERVAL', 'CASE')"""
_LITERAL = "regexp_matches(coalesce({}, ''), '^[''\"0-9]')"


@query("a34_advice", f"""{PARTS},
j AS (SELECT *, lag(outer_part) OVER ({STMT} ORDER BY pos) AS prev_outer, coalesce(prev1, '') AS b1, coalesce(prev2, '') AS b2,
  last_value(CASE WHEN u = 'JOIN' THEN pos END IGNORE NULLS) OVER ({STMT}, lv, grp ORDER BY pos {RUN}) AS join_pos FROM parts),
lefts AS (SELECT script_id, pos, next1 AS right_name, CASE WHEN next2 = 'AS' THEN next3 WHEN next2 <> 'ON' THEN next2 END AS alias
  FROM parts WHERE u = 'JOIN' AND (prev1 = 'LEFT' OR (prev1 = 'OUTER' AND prev2 = 'LEFT'))),
calls AS (SELECT * FROM j WHERE {_CALL}),
equal AS (SELECT * FROM j WHERE kind = 'ident' AND next1 = '=' AND {_LITERAL.format('tok2')} AND (
  (next3 = 'OR' AND next4 = u AND next5 = '=' AND {_LITERAL.format('tok6')})
  OR (b1 = 'OR' AND prev3 = '=' AND prev4 = u AND {_LITERAL.format('prev2')}))),
in_lists AS (SELECT script_id, stmt_no, lv, grp, bool_or(tok = '(' AND b1 = 'IN' AND next1 <> 'SELECT') AS is_list,
  sum(length(tok) + 1) FILTER (WHERE tok <> '(') AS chars, count(*) FILTER (WHERE tok = ',') AS commas FROM j GROUP BY 1, 2, 3, 4),
nested AS (SELECT script_id, stmt_no, count(*) AS n FROM j WHERE kind = 'ident' AND u = 'SELECT' AND b1 = '(' AND b2 <> 'AS' GROUP BY 1, 2)
SELECT script_id, 'COUNT_DISTINCT' AS rule, 'approx_count_distinct(' || lower(CASE WHEN next4 = '.' THEN next3 || '.' || next5 ELSE next3 END)
  || ')' AS advice FROM j WHERE kind = 'ident' AND u = 'COUNT' AND next1 = '(' AND next2 = 'DISTINCT'
UNION SELECT script_id, 'SELECT_STAR', 'list the columns of ' || lower(CASE WHEN next4 = '.' THEN next3 || '.' || next5 ELSE next3 END)
  FROM j WHERE kind = 'ident' AND u = 'SELECT' AND next1 = '*' AND next2 = 'FROM' AND next3 <> '('
UNION SELECT script_id, CASE WHEN b1 = 'NOT' THEN 'NOT_IN_SUBQUERY' ELSE 'IN_SUBQUERY' END, CASE WHEN b1 = 'NOT'
  THEN 'left anti join on ' || lower(b2) || ' if no value is NULL' ELSE 'left semi join on ' || lower(b1) END
  FROM j WHERE kind = 'ident' AND u = 'IN' AND next1 = '(' AND next2 = 'SELECT'
UNION SELECT script_id, 'WHERE_FUNCTION', 'compare the column itself instead of ' || lower(u) || '(...)' FROM calls
  WHERE gnext1 = ')' AND gnext2 IN ('=', '>', '<', '>=', '<=', '!=', '<>', 'LIKE', 'IN')
UNION SELECT script_id, 'PARTITION_PRUNING', 'give a range of the partition column instead of ' || lower(u) || '(...)' FROM calls
  WHERE gnext1 = ')' AND gnext2 = '=' AND u IN ('YEAR', 'MONTH', 'DAY', 'TO_DATE', 'DATE_FORMAT')
UNION SELECT script_id, 'SUBQUERY_IN_SELECT', 'join or window instead of a subquery per row' FROM j
  WHERE kind = 'ident' AND u = 'SELECT' AND b1 = '(' AND prev_outer = 'SELECT'
UNION SELECT j.script_id, 'LEFT_JOIN_WHERE_FILTER', 'move the condition on ' || lower(next1) || ' to WHERE' FROM j JOIN lefts l
  ON j.script_id = l.script_id AND j.join_pos = l.pos WHERE kind = 'ident' AND u = 'AND' AND part = 'ON' AND next2 = '.'
  AND next1 <> right_name AND next1 <> coalesce(alias, '')
UNION SELECT script_id, 'UDF_IN_WHERE', 'built-in functions instead of ' || lower(u) FROM calls WHERE lower(u) NOT IN {names(CORPUS_BUILTINS)}
UNION SELECT script_id, 'OR_IN_WHERE', lower(u) || ' IN (' || string_agg(tok2, ', ' ORDER BY pos) || ')' FROM equal
  GROUP BY script_id, stmt_no, lv, grp, u
UNION SELECT script_id, 'SUBQUERY_DEEP', 'name the ' || n || ' subqueries in a WITH clause' FROM nested WHERE n > 1
UNION SELECT script_id, 'IN_VALUES_LONG', 'join a table of the ' || (commas + 1) || ' values' FROM in_lists WHERE is_list AND chars >= 100
UNION SELECT script_id, 'TABLE_NAME_WITH_DATE', 'partition ' || regexp_extract(table_name, '^(.*?)_?[12][0-9]{{7}}$', 1) || ' by dt'
  FROM table_names WHERE regexp_extract(table_name, '^(.*?)_?[12][0-9]{{7}}$', 1) <> ''""")
def a34(spark, d):
    return lint.advice_rows(scripts_from_orders(spark, d))
