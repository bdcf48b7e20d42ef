"""Rule findings over a corpus of scripts.

Everything here is a projection over the script rows: a script is checked where it was read, nothing is shuffled
before the report counts. All functions take scripts(script_id, path, sql).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.functions.rules import ASCII_FLAGS, JAVA_FLAGS, LITERALS, RULES, STRICT_ID_NUMBER
from scriptmill.functions.sqltext import STRING_BODY, STRING_OR_COMMENT
from scriptmill.operators.advised import marked_tokens
from scriptmill.operators.scopes import table_refs
from scriptmill.operators.structure import STMT, builtin_functions
from scriptmill.operators.tokens import is_token_table
from scriptmill.session import store
from scriptmill.sources.tables import code_table


def java(pattern: str) -> Column:
    return F.lit(JAVA_FLAGS + pattern)


def is_ascii(text: Column) -> Column:
    """Whether a text is ASCII. There the patterns mean the same without Unicode classes and with plain lower case, and cost
    half as much."""
    return F.octet_length(text) == F.length(text)


def without_comments(sql: Column) -> Column:
    """The text without comments; strings that look like comments stay, as does the newline after a line comment."""
    return F.regexp_replace(sql, F.lit(STRING_OR_COMMENT), F.lit("$1"))


def blank_strings(sql: Column) -> Column:
    """Every string literal emptied to ''."""
    return F.regexp_replace(sql, F.lit(STRING_BODY), F.lit("''"))


def line_of(sql: Column, pos: Column) -> Column:
    """1-based line of a 1-based character position."""
    before = F.substring(sql, F.lit(1), pos - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """rules(rule, severity, message, suggestion), a constant table of 24 rows."""
    return code_table(
        spark,
        [(n, s, m, g) for n, s, _, m, g in RULES],
        "rule string, severity string, message string, suggestion string",
    )


def _hits(rows: DataFrame, position: dict[str, Column]) -> DataFrame:
    """All rules tried in one pass over the row; only hits leave it as rows of their own."""
    probe = F.array(
        *[
            F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"),
                     position[name].alias("pos"))
            for i, (name, severity, _, _, _) in enumerate(RULES, 1)
        ]
    )
    return rows.withColumn("hit", F.explode(F.filter(probe, lambda h: h["pos"] > 0)))


def _first_match(rule: str, pattern: str) -> Column:
    """Position of the first match in ``sql``, 0 without one. A rule is searched in a text that is ASCII only if the text holds
    what every match does; others have letters that patterns take for ASCII ones."""
    found = F.regexp_instr("sql", F.lit(ASCII_FLAGS + pattern))
    for literal in LITERALS.get(rule, ()):
        found = F.when(F.contains("low", F.lit(literal)), found).otherwise(0)
    return F.when(F.col("ascii"), found).otherwise(F.regexp_instr("sql", java(pattern)))


def findings(scripts: DataFrame) -> DataFrame:
    """First match of each rule: (script_id, path, rule_no, rule, severity, line)."""
    rows = scripts.select("script_id", "path", "sql", is_ascii(F.col("sql")).alias("ascii"), F.lower("sql").alias("low"))
    # in a column of their own the positions are compiled, inside the filter of the hits they would be interpreted
    rows = rows.select("script_id", "path", "sql", F.array(*[_first_match(name, pattern) for name, _, pattern, _, _ in RULES]).alias("at"))
    return _hits(rows, {name: F.get("at", F.lit(i)) for i, (name, *_) in enumerate(RULES)}).select(
        "script_id", "path", "hit.rule_no", "hit.rule", "hit.severity",
        line_of(F.col("sql"), F.col("hit.pos")).alias("line"),
    )


# These two rules look into string literals on purpose; for them only comments are taken out.
READ_LITERALS = ("LIKE_LEADING_WILDCARD", "HARDCODED_DATE")


def findings_outside_literals(scripts: DataFrame) -> DataFrame:
    """The rules on text without comments and with emptied strings: (script_id, path, rule, severity).

    The identity-number rule searches names in that text and numbers, in their strict form, in the whole script.
    """
    bare = without_comments(F.col("sql"))
    texts = scripts.select("script_id", "path", "sql", bare.alias("bare")).withColumn(
        "code", blank_strings(F.col("bare"))
    )
    position = {
        name: F.regexp_instr("bare" if name in READ_LITERALS else "code", java(pattern))
        for name, _, pattern, _, _ in RULES
    }
    position["SENSITIVE_INFO_DETECTED"] = F.greatest(
        position["SENSITIVE_INFO_DETECTED"], F.regexp_instr("sql", java(STRICT_ID_NUMBER))
    )
    return _hits(texts, position).select("script_id", "path", "hit.rule", "hit.severity")


def all_matches(scripts: DataFrame) -> DataFrame:
    """Number of matches per script and rule: (script_id, rule, n_matches)."""
    counts = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.regexp_count(F.col("sql"), java(p)).alias("n_matches"))
            for n, _, p, _, _ in RULES
        ]
    )
    return scripts.select("script_id", F.explode(F.filter(counts, lambda c: c["n_matches"] > 0)).alias("c")).select(
        "script_id", "c.rule", "c.n_matches"
    )


def severity_counters(scripts: DataFrame) -> DataFrame:
    """One row per script, also for scripts without a finding.

    The counters come from the row itself, so no grouping over findings is needed.
    """
    hits = F.array_compact(
        F.array(*[F.when(F.regexp_instr("sql", java(p)) > 0, F.lit(sev)) for _, sev, p, _, _ in RULES])
    )

    def of(severity: str) -> Column:
        return F.size(F.filter("__hits", lambda s: s == severity))

    return scripts.select("script_id", "path", hits.alias("__hits")).select(
        "script_id", "path", F.size("__hits").alias("issue_count"), of("HIGH").alias("high_priority"),
        of("MEDIUM").alias("medium_priority"), of("LOW").alias("low_priority"),
    )


def report(scripts: DataFrame) -> DataFrame:
    """One nested row per script: (script_id, path, issues ARRAY<STRUCT>, issue_count, high, medium, low).

    The issues stay an array inside the row; at most one entry per rule. An unreadable script of a checked scan keeps its
    ``error`` and has no issues.
    """
    errors = ["error"] if "error" in scripts.columns else []
    advice = {n: (m, g) for n, _, _, m, g in RULES}
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_instr("sql", java(p)).alias("pos"),
                F.lit(advice[n][0]).alias("message"), F.lit(advice[n][1]).alias("suggestion"),
            )
            for n, s, p, _, _ in RULES
        ]
    )
    issues = F.transform(
        F.filter(entries, lambda e: e["pos"] > 0),
        lambda e: F.struct(e["rule"].alias("rule"), e["severity"].alias("severity"),
                           line_of(F.col("sql"), e["pos"]).alias("line"), e["message"].alias("message"),
                           e["suggestion"].alias("suggestion")),
    )

    def of(severity: str) -> Column:
        return F.size(F.filter("issues", lambda e: e["severity"] == severity))

    found = F.coalesce(issues, F.array().cast("array<struct<rule:string,severity:string,line:int,message:string,suggestion:string>>"))
    return scripts.select("script_id", "path", *errors, found.alias("issues")).select(
        "*", F.size("issues").alias("issue_count"), of("HIGH").alias("high_priority"),
        of("MEDIUM").alias("medium_priority"), of("LOW").alias("low_priority"),
    )


def batch_summary(scripts: DataFrame) -> DataFrame:
    """Findings by rule, by severity and in total: rollup(severity, rule), beside the number of all scripts of the batch.

    A rule hits a script at most once, so counting rows counts scripts at the rule level.
    """
    total = scripts.agg(F.count(F.lit(1)).alias("total_files"))  # one row
    return (
        findings(scripts).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))
        .rollup("severity", "rule").agg(F.sum("n").alias("n_findings"), F.grouping_id().alias("level"))
        .crossJoin(F.broadcast(total))
    )


def advice_rows(scripts: DataFrame) -> DataFrame:
    """Computed advice: (script_id, rule, advice), each once per script. The script text itself is not edited.

    Advice looks at tokens, so text in strings and comments gives none, and at the place of a token in its query: a function
    is one in WHERE only if the WHERE is of the same parentheses, a call of a registered function is no user function, and
    OR becomes IN only between equalities of one column with literals.
    """
    # Few tokens matter to any kind of advice; these are found in one pass over a script, and each kind reads them.
    t = store(marked_tokens(scripts))
    name = F.lower("u")
    by_token = t.select("script_id", F.explode("entries").alias("e")).select(
        "script_id", "e.rule", F.concat("e.before", F.lower("e.name"), "e.behind").alias("advice"))

    calls = t.where("is_call").select("script_id", name.alias("function")).distinct()
    known = builtin_functions(scripts.sparkSession)  # a few hundred names
    user = calls.join(F.broadcast(known), "function", "left_anti").select(
        "script_id", F.lit("UDF_IN_WHERE").alias("rule"), F.concat(F.lit("built-in functions instead of "), "function").alias("advice"))

    values = t.where("is_choice").groupBy(*STMT, "lv", "grp", "u").agg(
        F.array_sort(F.collect_list(F.struct("pos", "tok2"))).alias("found"))
    either = values.select("script_id", F.lit("OR_IN_WHERE").alias("rule"), F.concat(
        F.lower("u"), F.lit(" IN ("), F.array_join(F.transform("found", lambda f: f["tok2"]), ", "), F.lit(")")).alias("advice"))

    several = t.where("is_nested").groupBy(*STMT).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    deep = several.select("script_id", F.lit("SUBQUERY_DEEP").alias("rule"), F.concat(
        F.lit("name the "), F.col("n").cast("string"), F.lit(" subqueries in a WITH clause")).alias("advice"))

    # an opening parenthesis stands for its list
    long = t.where("is_list").select("script_id", F.lit("IN_VALUES_LONG").alias("rule"), F.concat(
        F.lit("join a table of the "), (F.col("commas") + 1).cast("string"), F.lit(" values")).alias("advice"))

    base = F.regexp_extract("table_name", r"^(.*?)_?[12][0-9]{7}$", 1)
    # a date stands in one part of a name, so a text without one names no such table
    texts = scripts if is_token_table(scripts) else scripts.where(F.rlike("sql", F.lit("[12][0-9]{7}")))
    dated = table_refs(texts).select("script_id", F.lit("TABLE_NAME_WITH_DATE").alias("rule"), F.when(
        base != "", F.concat(F.lit("partition "), base, F.lit(" by dt"))).alias("advice")).where("advice IS NOT NULL")

    out = by_token
    for part in (user, either, deep, long, dated):
        out = out.unionByName(part)
    return out.distinct()


def template_parameters(scripts: DataFrame) -> DataFrame:
    """Parameters a script waits for, written {X}, ${X} or $X: (script_id, parameter), each once per script."""
    found = F.regexp_extract_all("sql", F.lit(r"\$\{\w+\}|\{\w+\}|\$[A-Za-z_]\w*"), F.lit(0))
    names = F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"[${}]", "")))
    return scripts.select("script_id", F.explode(names).alias("parameter"))


def sensitive_columns(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Rows of a data table whose text holds an identity number, an id-like field name or a long digit run."""
    col = F.col(text)
    rule = next(p for n, _, p, _, _ in RULES if n == "SENSITIVE_INFO_DETECTED")
    return df.select(
        F.lit(label).alias("source_table"), F.col(key).alias("row_key"),
        F.regexp_count(col, java(STRICT_ID_NUMBER)).alias("n_strict_numbers"),
        F.regexp_count(col, java(rule)).alias("n_rule_hits"),
        F.regexp_count(col, F.lit(r"[0-9]{11,}")).alias("n_long_numbers"),
    )
