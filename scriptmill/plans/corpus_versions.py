"""Two versions of the corpus, and copies inside one."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.sqltext import ELEMENTS, TOKEN, re2
from scriptmill.operators import integrity, scopes, similar
from scriptmill.plans.corpus_lint import CORPUS, KEYWORD_RX, rx
from scriptmill.plans.corpus_structure import PARTS
from scriptmill.plans.registry import query, sql_text
from scriptmill.sources.corpus import SCRIPTS_SQL, scripts_from_orders
from scriptmill.sources.tables import table


def second_version(scripts):
    """The corpus one release later: some scripts in capitals, some without line comments, some with another constant,
    some in another folder."""
    k, sql = F.col("script_id"), F.col("sql")
    return scripts.select(
        "script_id",
        F.when(k % 13 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(k % 3 == 0, F.upper(sql)).when(k % 5 == 0, F.regexp_replace(sql, r"--[^\n]*", ""))
        .when(k % 7 == 0, F.regexp_replace(sql, "'[^']*'", "'?'"))
        .when(k % 11 == 0, F.regexp_replace(sql, " ", "  ")).otherwise(sql).alias("sql"),
    )


VERSIONS = f"""WITH old AS ({SCRIPTS_SQL}),
new AS (SELECT script_id, CASE WHEN script_id % 13 = 0 THEN 'moved/' || path ELSE path END AS path,
  CASE WHEN script_id % 3 = 0 THEN upper(sql) WHEN script_id % 5 = 0 THEN regexp_replace(sql, '--[^\\n]*', '', 'g')
    WHEN script_id % 7 = 0 THEN regexp_replace(sql, '''[^'']*''', '''?''', 'g')
    WHEN script_id % 11 = 0 THEN replace(sql, ' ', '  ') ELSE sql END AS sql FROM old)"""


def measures(name: str, table: str) -> str:
    elements = ", ".join(f"len(regexp_extract_all(sql, {rx(p)})) AS {e}" for e, p in ELEMENTS.items())
    return f"""{name} AS (SELECT path, true AS here, {elements},
  list_transform(regexp_extract_all(sql, {rx(KEYWORD_RX)}), lambda w: lower(w)) AS kws,
  list_distinct(regexp_extract_all(sql, '''[^'']*''')) AS strings,
  list_distinct(regexp_extract_all(sql, '\\b\\d+\\.?\\d*\\b')) AS numbers,
  len(regexp_extract_all(sql, '--[^\\n]*')) AS n_remarks,
  list_distinct(regexp_extract_all(lower(array_to_string(regexp_extract_all(sql, '--[^\\n]*'), ' ')), '\\b\\w+\\b')) AS words
  FROM {table})"""


def _minus(x: str, y: str) -> str:
    return f"len(list_filter({x}, lambda v: NOT list_contains({y}, v)))"


_CHANGES = ", ".join(
    f"CASE WHEN a.{e} <> b.{e} THEN '{e}: ' || CAST(a.{e} AS VARCHAR) || ' -> ' || CAST(b.{e} AS VARCHAR) END"
    for e in ELEMENTS
)

INTEGRITY = f"""{VERSIONS},
{measures('a', 'old')},
{measures('b', 'new')},
kw AS (SELECT path, w, sum(o) AS o, sum(n) AS n FROM (
  SELECT path, unnest(kws) AS w, 1 AS o, 0 AS n FROM a UNION ALL SELECT path, unnest(kws), 0, 1 FROM b)
  GROUP BY path, w HAVING sum(n) < sum(o)),
lost AS (SELECT path, string_agg(w || '(' || CAST(CAST(o AS BIGINT) AS VARCHAR) || '->' || CAST(CAST(n AS BIGINT) AS VARCHAR)
  || ')', ', ' ORDER BY w) AS details FROM kw GROUP BY path),
pairs AS (SELECT coalesce(a.path, b.path) AS path, a.here IS NULL OR b.here IS NULL AS absent,
  CASE WHEN a.here IS NULL THEN 'added' WHEN b.here IS NULL THEN 'missing' ELSE '' END AS presence,
  array_to_string(list_filter([{_CHANGES}], lambda x: x IS NOT NULL), ', ') AS elements,
  coalesce(lost.details, '') AS keywords,
  {_minus('a.strings', 'b.strings')} AS ls, {_minus('b.strings', 'a.strings')} AS xs,
  {_minus('a.numbers', 'b.numbers')} AS ln,
  CASE WHEN b.n_remarks < a.n_remarks THEN 'fewer line comments: ' || CAST(a.n_remarks - b.n_remarks AS VARCHAR)
    WHEN {_minus('a.words', 'b.words')} > 0 THEN 'missing comment words: ' || CAST({_minus('a.words', 'b.words')} AS VARCHAR)
    ELSE '' END AS comments
  FROM a FULL JOIN b ON a.path = b.path LEFT JOIN lost ON lost.path = a.path),
texts AS (SELECT path, absent, 'presence' AS "check", presence AS details, 'FAIL' AS bad, false AS two_sided FROM pairs
  UNION ALL SELECT path, absent, 'elements', elements, 'FAIL', true FROM pairs
  UNION ALL SELECT path, absent, 'keywords', keywords, 'FAIL', true FROM pairs
  UNION ALL SELECT path, absent, 'literals', CASE WHEN ls + xs + ln = 0 THEN '' ELSE 'missing strings '
    || CAST(ls AS VARCHAR) || ', extra strings ' || CAST(xs AS VARCHAR) || ', missing numbers ' || CAST(ln AS VARCHAR) END,
    'FAIL', true FROM pairs
  UNION ALL SELECT path, absent, 'comments', comments, 'WARN', true FROM pairs),
report AS (SELECT path, "check", CASE WHEN two_sided AND absent THEN 'SKIP' WHEN details = '' THEN 'PASS' ELSE bad END AS result,
  CASE WHEN two_sided AND absent THEN '' ELSE details END AS details FROM texts)"""


def _report(spark, d):
    old = scripts_from_orders(spark, d)
    return integrity.integrity(old, second_version(old))


@query("a17_integrity", f"{INTEGRITY} SELECT path, \"check\", result, details FROM report")
def a17(spark, d):
    return _report(spark, d)


_CODE = (
    f"list_filter(regexp_extract_all(sql, {sql_text(re2(TOKEN))}), "
    "lambda t: NOT (regexp_matches(t, '^(--|/\\*[\\s\\S]*\\*/$)') OR t = chr(10)))"
)
NORMAL = (
    f"array_to_string(list_transform({_CODE}, "
    "lambda t: CASE WHEN regexp_matches(t, '^[''\"].') THEN t ELSE upper(t) END), ' ')"
)


@query(
    "a18_layout_changes",
    f"""{VERSIONS}, o AS (SELECT path, sql, {NORMAL} AS norm FROM old), n AS (SELECT path, sql, {NORMAL} AS norm FROM new)
SELECT o.path, o.sql = n.sql AS same_text, o.norm = n.norm AS same_tokens FROM o JOIN n ON o.path = n.path""",
)
def a18(spark, d):
    old = scripts_from_orders(spark, d)
    return integrity.layout_changes(old, second_version(old))


@query(
    "a19_verdicts",
    f"""{INTEGRITY} SELECT path, bool_and(result = 'PASS') FILTER (WHERE result <> 'SKIP') AS passed
FROM report GROUP BY path""",
)
def a19(spark, d):
    return integrity.verdicts(_report(spark, d))


@query(
    "a37_copies",
    f"""WITH scripts AS ({SCRIPTS_SQL}), s AS (SELECT path, {NORMAL} AS norm FROM scripts),
g AS (SELECT path, count(*) OVER (PARTITION BY norm) AS n_copies, min(path) OVER (PARTITION BY norm) AS first_name FROM s)
SELECT path, n_copies, first_name FROM g WHERE n_copies > 1""",
)
def a37(spark, d):
    return integrity.copies(scripts_from_orders(spark, d))


@query(
    "a37_same_tables",
    f"""{PARTS},
sets AS (SELECT script_id, string_agg(table_name, ',' ORDER BY table_name) AS tables
  FROM (SELECT DISTINCT script_id, table_name FROM table_names) GROUP BY script_id)
SELECT script_id, tables, count(*) OVER (PARTITION BY tables) AS n_scripts FROM sets""",
)
def a37_tables(spark, d):
    return integrity.same_tables(scopes.table_refs(scripts_from_orders(spark, d)))


def bundles(spark, d):
    """Two releases of the scripts of every customer, one file each. In the second one, the statements of every tenth order
    have been rewritten; one statement is in all files."""
    scripts = scripts_from_orders(spark, d)
    owner = table(spark, d, "orders", "o_orderkey", "o_custkey")
    rows = scripts.join(owner, scripts["script_id"] == owner["o_orderkey"]).select("o_custkey", "script_id", "sql")

    # the texts are shuffled once for both releases
    files = rows.select("o_custkey", F.struct("script_id", "sql").alias("s")).groupBy("o_custkey").agg(
        F.array_sort(F.collect_list("s")).alias("all"))

    def release(name, text):
        path = F.concat(F.lit(f"{name}/c"), F.col("o_custkey").cast("string"), F.lit(".sql"))
        body = F.array_join(F.transform("all", text), ";\n")
        return F.struct(path.alias("script_id"), path.alias("path"), F.concat(body, F.lit(";\nselect 1 from common_log;")).alias("sql"))

    changed = lambda x: F.when(
        x["script_id"] % 10 == 0, F.concat(F.lit("select * from changed_"), x["script_id"].cast("string"))).otherwise(x["sql"])
    return files.select(F.inline(F.array(release("v1", lambda x: x["sql"]), release("v2", changed))))


_BUNDLES = f"""WITH single AS ({SCRIPTS_SQL}),
owned AS (SELECT o_custkey, script_id, sql, CASE WHEN script_id % 10 = 0 THEN 'select * from changed_' || script_id ELSE sql END AS changed
  FROM single JOIN orders ON script_id = o_orderkey),
scripts AS (
  SELECT 'v1/c' || o_custkey || '.sql' AS script_id, 'v1/c' || o_custkey || '.sql' AS path,
    string_agg(sql, ';' || chr(10) ORDER BY owned.script_id) || ';' || chr(10) || 'select 1 from common_log;' AS sql FROM owned GROUP BY o_custkey
  UNION ALL SELECT 'v2/c' || o_custkey || '.sql', 'v2/c' || o_custkey || '.sql',
    string_agg(changed, ';' || chr(10) ORDER BY owned.script_id) || ';' || chr(10) || 'select 1 from common_log;' FROM owned GROUP BY o_custkey)"""
_PIECES = "[,;\n]"
SIMILAR = f"""{PARTS.replace(CORPUS, _BUNDLES)},
cut AS (SELECT script_id, replace(unnest(string_split_regex(regexp_replace(replace({NORMAL}, ' ', '  '),
  '(^| )({"|".join(similar.CUTS).replace(" ", "  ")})( |$)', chr(10) || '\\2\\3', 'g'), '{_PIECES}')), '  ', ' ') AS part FROM scripts),
features AS (
  SELECT DISTINCT script_id AS path, 'p' || trim(part) AS f FROM cut WHERE trim(part) <> ''
  UNION SELECT script_id, 't' || table_name FROM table_names),
sets AS (SELECT path, list_sort(list(f)) AS fs, count(*) AS n FROM features GROUP BY path),
members AS (SELECT path, n, min(path) OVER (PARTITION BY fs) AS class_path, count(*) OVER (PARTITION BY fs) AS n_scripts FROM sets),
reps AS (SELECT path, n, n_scripts, f FROM members JOIN features USING (path) WHERE path = class_path),
links AS (
  SELECT a.path AS path_a, b.path AS path_b, a.n_scripts AS n_a, b.n_scripts AS n_b, count(*)::INT AS n_shared,
    count(*) / (a.n + b.n - count(*)) AS similarity
  FROM reps a JOIN reps b ON a.f = b.f AND a.path < b.path AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.path, b.path, a.n, b.n, a.n_scripts, b.n_scripts HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*)))"""


@query("a37_similar_scripts", f"{SIMILAR} SELECT * FROM links")
def a37_similar(spark, d):
    return similar.similar_scripts(bundles(spark, d))[0]


@query("a37_similarity_classes", f"""{SIMILAR},
ends AS (SELECT path_a AS path FROM links UNION ALL SELECT path_b FROM links)
SELECT m.path, class_path, n_scripts, (SELECT count(*) FROM ends e WHERE e.path = class_path) AS n_links FROM members m""")
def a37_classes(spark, d):
    return similar.similar_scripts(bundles(spark, d))[1]
