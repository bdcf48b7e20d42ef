"""Rules, classes, counts and literals of the script corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.functions.rules import RULES, STRICT_ID_NUMBER, re2_pattern
from scriptmill.functions.sqltext import COUNTED_KEYWORDS, ELEMENTS, STRING_BODY, STRING_OR_COMMENT, SYNTAX_CLASSES, re2
from scriptmill.operators import lint, textual
from scriptmill.plans.registry import query, sql_text
from scriptmill.session import scratch_dir
from scriptmill.sources.corpus import SCRIPTS_SQL, scripts_from_orders
from scriptmill.sources.tables import table

CORPUS = f"WITH scripts AS (\n{SCRIPTS_SQL}\n)"


def rx(pattern: str) -> str:
    return sql_text("(?im)" + pattern)


def finding_sql(text: str = "sql") -> str:
    """One SELECT per rule; the line is counted in the text before the first match."""
    arms = []
    for i, (name, severity, _, _, _) in enumerate(RULES, 1):
        p = re2_pattern(name)
        before = f"regexp_extract({text}, {sql_text('(?im)((?s:' + chr(92) + 'A.*?))(?:' + p + ')')}, 1)"
        arms.append(
            f"SELECT script_id, path, {i} AS rule_no, '{name}' AS rule, '{severity}' AS severity, "
            f"CAST(1 + length({before}) - length(replace({before}, chr(10), '')) AS INTEGER) AS line "
            f"FROM scripts WHERE regexp_matches({text}, {rx(p)})"
        )
    return "\nUNION ALL\n".join(arms)


FINDINGS = f"{CORPUS},\nfindings AS (\n{finding_sql()}\n)"

NO_COMMENT = f"regexp_replace(sql, {sql_text(re2(STRING_OR_COMMENT))}, '\\1', 'g')"
CODE_ONLY = f"regexp_replace({NO_COMMENT}, {sql_text(re2(STRING_BODY))}, '''''', 'g')"


@query("s03_script_scan", f"{CORPUS} SELECT script_id, path, sql FROM scripts")
def script_scan(spark, d):
    return scripts_from_orders(spark, d)


@query("a05_comment_free_text", f"{CORPUS} SELECT script_id, {NO_COMMENT} AS code FROM scripts")
def comment_free_text(spark, d):
    return scripts_from_orders(spark, d).select("script_id", lint.without_comments(F.col("sql")).alias("code"))


@query("a06_findings", f"{FINDINGS} SELECT script_id, path, rule_no, rule, severity, line FROM findings")
def findings(spark, d):
    return lint.findings(scripts_from_orders(spark, d))


@query(
    "a07_all_matches",
    f"{CORPUS}\n"
    + "\nUNION ALL\n".join(
        f"SELECT script_id, '{n}' AS rule, CAST(len(regexp_extract_all(sql, {rx(re2_pattern(n))})) AS INTEGER) "
        f"AS n_matches FROM scripts WHERE regexp_matches(sql, {rx(re2_pattern(n))})"
        for n, *_ in RULES
    ),
)
def all_matches(spark, d):
    return lint.all_matches(scripts_from_orders(spark, d))


def _outside_sql() -> str:
    arms = []
    for name, severity, _, _, _ in RULES:
        p = rx(re2_pattern(name))
        if name in ("LIKE_LEADING_WILDCARD", "HARDCODED_DATE"):
            cond = f"regexp_matches(bare, {p})"
        elif name == "SENSITIVE_INFO_DETECTED":
            cond = f"(regexp_matches(code, {p}) OR regexp_matches(sql, {rx(STRICT_ID_NUMBER)}))"
        else:
            cond = f"regexp_matches(code, {p})"
        arms.append(
            f"SELECT script_id, path, '{name}' AS rule, '{severity}' AS severity FROM cleaned WHERE {cond}"
        )
    return (
        f"{CORPUS},\ncleaned AS (SELECT *, {NO_COMMENT} AS bare, {CODE_ONLY} AS code FROM scripts)\n"
        + "\nUNION ALL\n".join(arms)
    )


@query("a08_findings_outside_literals", _outside_sql())
def findings_outside_literals(spark, d):
    return lint.findings_outside_literals(scripts_from_orders(spark, d))


@query(
    "a09_severity_counters",
    f"""{FINDINGS}
SELECT s.script_id, s.path, count(f.rule) AS issue_count,
       count(CASE WHEN f.severity = 'HIGH' THEN 1 END) AS high_priority,
       count(CASE WHEN f.severity = 'MEDIUM' THEN 1 END) AS medium_priority,
       count(CASE WHEN f.severity = 'LOW' THEN 1 END) AS low_priority
FROM scripts s LEFT JOIN findings f ON s.script_id = f.script_id GROUP BY s.script_id, s.path""",
)
def severity_counters(spark, d):
    return lint.severity_counters(scripts_from_orders(spark, d))


@query(
    "a10_batch_summary",
    f"""{FINDINGS}
SELECT severity, rule, count(*) AS n_findings, CAST(grouping(severity, rule) AS BIGINT) AS level,
  (SELECT count(*) FROM scripts) AS total_files
FROM findings GROUP BY ROLLUP (severity, rule)""",
)
def batch_summary(spark, d):
    return lint.batch_summary(scripts_from_orders(spark, d))


@query(
    "a10_top_scripts",
    f"""{FINDINGS}
SELECT path, count(*) AS issue_count FROM findings GROUP BY path
ORDER BY issue_count DESC, path LIMIT 20""",
)
def top_scripts(spark, d):
    return (
        lint.findings(scripts_from_orders(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("issue_count"))
        .orderBy(F.desc("issue_count"), "path").limit(20)
    )


@query(
    "a11_rule_catalogue",
    f"""{FINDINGS}, rules AS (SELECT * FROM (VALUES
{','.join('(' + ', '.join(sql_text(x) for x in (n, s, m, g)) + ')' for n, s, _, m, g in RULES)}
) v(rule, severity, message, suggestion))
SELECT r.rule, r.severity, r.message, r.suggestion, count(f.rule) AS n_scripts
FROM rules r LEFT JOIN findings f ON r.rule = f.rule GROUP BY r.rule, r.severity, r.message, r.suggestion""",
)
def rule_catalogue(spark, d):
    used = lint.findings(scripts_from_orders(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return lint.rule_catalogue(spark).join(used, "rule", "left").select(
        "rule", "severity", "message", "suggestion", F.coalesce("n", F.lit(0)).alias("n_scripts")
    )


def _class_case() -> str:
    arms = []
    for name, patterns in SYNTAX_CLASSES.items():
        cond = " OR ".join(f"regexp_matches(bare, {rx(p)})" for p in patterns)
        arms.append(f"CASE WHEN {cond} THEN '{name}' END")
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)"


@query(
    "a12_syntax_classes",
    f"""{CORPUS}, cleaned AS (SELECT script_id, sql, {NO_COMMENT} AS bare FROM scripts),
classed AS (SELECT script_id, trim(sql) = '' AS blank, {_class_case()} AS found FROM cleaned)
SELECT script_id,
       CASE WHEN blank THEN '' WHEN len(found) = 0 THEN 'basic' ELSE array_to_string(found, ',') END AS classes,
       CASE WHEN blank OR len(found) = 0 THEN 'basic' ELSE found[1] END AS primary_class
FROM classed""",
)
def syntax_classes(spark, d):
    return textual.syntax_classes(scripts_from_orders(spark, d)).select(
        "script_id", F.array_join("classes", ",").alias("classes"), "primary_class"
    )


@query(
    "a14_element_counts",
    f"{CORPUS} SELECT script_id, "
    + ", ".join(f"len(regexp_extract_all(sql, {rx(p)})) AS {n}" for n, p in ELEMENTS.items())
    + " FROM scripts",
)
def element_counts(spark, d):
    return textual.element_counts(scripts_from_orders(spark, d))


KEYWORD_RX = r"\b(" + "|".join(COUNTED_KEYWORDS) + r")\b"


@query(
    "a15_keyword_frequency",
    f"""{CORPUS}, words AS (SELECT script_id, unnest(regexp_extract_all(sql, {rx(KEYWORD_RX)})) AS w FROM scripts)
SELECT script_id, lower(w) AS keyword, count(*) AS n FROM words GROUP BY script_id, lower(w)""",
)
def keyword_frequency(spark, d):
    return textual.keyword_frequency(scripts_from_orders(spark, d))


@query(
    "a16_literal_sets",
    f"""{CORPUS}, lits AS (
SELECT script_id, 'string' AS kind, unnest(regexp_extract_all(sql, '''[^'']*''')) AS literal FROM scripts
UNION ALL
SELECT script_id, 'number', unnest(regexp_extract_all(sql, '\\b\\d+\\.?\\d*\\b')) FROM scripts)
SELECT DISTINCT script_id, kind, literal FROM lits""",
)
def literal_sets(spark, d):
    return textual.literal_sets(scripts_from_orders(spark, d))


@query(
    "s20_findings_report",
    f"""{FINDINGS}
SELECT s.script_id, s.path,
       coalesce(string_agg(f.rule || ':' || f.severity || ':' || CAST(f.line AS VARCHAR), '|' ORDER BY f.rule_no), '')
         AS issues,
       count(f.rule) AS issue_count
FROM scripts s LEFT JOIN findings f ON s.script_id = f.script_id GROUP BY s.script_id, s.path""",
)
def findings_report(spark, d):
    flat = F.transform("issues", lambda i: F.concat_ws(":", i["rule"], i["severity"], i["line"].cast("string")))
    return lint.report(scripts_from_orders(spark, d)).select(
        "script_id", "path", F.array_join(flat, "|").alias("issues"), "issue_count"
    )


@query(
    "s20_report_file",
    f"""{FINDINGS}, per AS (SELECT s.script_id, count(f.rule) AS issue_count,
  count(CASE WHEN f.severity = 'HIGH' THEN 1 END) AS high_priority FROM scripts s LEFT JOIN findings f
  ON s.script_id = f.script_id GROUP BY s.script_id)
SELECT issue_count, high_priority, count(*) AS n_scripts FROM per GROUP BY issue_count, high_priority""",
)
def report_file(spark, d):
    """The nested report as JSON lines, read back with its schema."""
    path = scratch_dir(spark)
    nested = lint.report(scripts_from_orders(spark, d))
    nested.write.json(path)
    return spark.read.schema(nested.schema).json(path).groupBy(
        F.size("issues").alias("issue_count"),
        F.size(F.filter("issues", lambda i: i["severity"] == "HIGH")).alias("high_priority"),
    ).agg(F.count(F.lit(1)).alias("n_scripts"))


_SENSITIVE = sql_text("(?im)" + re2_pattern("SENSITIVE_INFO_DETECTED"))


@query(
    "a35_sensitive_values",
    f"""WITH texts AS (
SELECT 'documents' AS source_table, doc_id AS row_key, text FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000000 + turn, text FROM conversations)
SELECT source_table, row_key,
       CAST(len(regexp_extract_all(text, {rx(STRICT_ID_NUMBER)})) AS INTEGER) AS n_strict_numbers,
       CAST(len(regexp_extract_all(text, {_SENSITIVE})) AS INTEGER) AS n_rule_hits,
       CAST(len(regexp_extract_all(text, '[0-9]{{11,}}')) AS INTEGER) AS n_long_numbers
FROM texts""",
)
def sensitive_values(spark, d):
    docs = lint.sensitive_columns(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", "documents")
    talk = table(spark, d, "conversations", "conv_id", "turn", "text").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("row_key"), "text"
    )
    return docs.unionByName(lint.sensitive_columns(talk, "row_key", "text", "conversations"))


@query(
    "a36_template_parameters",
    f"""{CORPUS}, found AS (
SELECT script_id, unnest(regexp_extract_all(sql, '\\$\\{{\\w+\\}}|\\{{\\w+\\}}|\\$[A-Za-z_]\\w*')) AS p FROM scripts)
SELECT DISTINCT script_id, regexp_replace(p, '[${{}}]', '', 'g') AS parameter FROM found""",
)
def template_parameters(spark, d):
    return lint.template_parameters(scripts_from_orders(spark, d))
