"""Comparison of two versions of a script corpus.

Both versions are reduced to their measures where they are read; the join on the path moves measures, not texts. A path
occurs once per version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.functions.sqltext import COUNTED_KEYWORDS, ELEMENTS
from scriptmill.operators.lint import is_ascii, java
from scriptmill.operators.skew import copy_groups, with_group_stats
from scriptmill.operators.textual import keyword_words, numbers_in, strings_in
from scriptmill.operators.tokens import normal_text
from scriptmill.session import materialize


def _keywords_and_elements(sql: Column, low: Column) -> tuple[Column, Column]:
    """The counted keywords in text order and the element counts in the order of ELEMENTS, both as ``keyword_words`` and the
    patterns give them, for an ASCII text: one pass finds all words, and the elements that are single words are counted in it.
    A join is a word JOIN, or one run together with its kind."""
    words = F.regexp_extract_all(low, F.lit(rf"(?=[a-z])\b({'|'.join(COUNTED_KEYWORDS).lower()})\b"), F.lit(1))
    many = lambda w: F.size("kw") - F.size(F.array_remove("kw", w))
    run_together = F.when(F.contains(low, F.lit("join")), F.regexp_count(
        low, F.lit(r"(?=[ilrfc])\b(?:inner|left|right|full|cross)join\b"))).otherwise(0)
    fast = {"n_select": many("select"), "n_from": many("from"), "n_join": many("join") + run_together, "n_union": many("union"),
            "n_subquery": F.regexp_count(low, F.lit(r"\(\s*select\b"))}
    counts = F.array(*[F.when(F.col("ascii"), fast[e]).otherwise(F.regexp_count(sql, java(p))) for e, p in ELEMENTS.items()])
    return F.when(F.col("ascii"), words).otherwise(keyword_words(sql)), counts


def _measures(scripts: DataFrame, name: str) -> DataFrame:
    sql, low = F.col("sql"), F.col("low")
    remarks = F.regexp_extract_all(sql, F.lit(r"--[^\n]*"), F.lit(0))
    words = F.regexp_extract_all(F.lower(F.array_join(remarks, " ")), java(r"\b\w+\b"), F.lit(0))
    numbers = F.array_distinct(F.regexp_extract_all(sql, F.lit(r"(?=[0-9])\b[0-9]+\.?[0-9]*\b"), F.lit(0)))
    kw, elements = _keywords_and_elements(sql, low)
    scripts = scripts.select("path", "sql", F.lower(sql).alias("low"), is_ascii(sql).alias("ascii")).withColumn("kw", kw)
    return scripts.select(
        "path",
        F.struct(
            elements.alias("elements"),
            F.sort_array("kw").alias("keywords"),
            strings_in(sql).alias("strings"),
            F.when(F.col("ascii"), numbers).otherwise(numbers_in(sql)).alias("numbers"),
            F.size(remarks).alias("n_remarks"),
            F.array_distinct(words).alias("remark_words"),
        ).alias(name),
    )


def integrity(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, check, result, details); result is PASS, FAIL, WARN or SKIP (one side is missing). What is equal on both sides
    is not taken apart."""
    both = _measures(old, "a").join(_measures(new, "b"), "path", "full")
    a, b = F.col("a"), F.col("b")

    pairs = F.arrays_zip(F.array(*[F.lit(e) for e in ELEMENTS]).alias("element"), a["elements"].alias("x"), b["elements"].alias("y"))
    changed = F.filter(pairs, lambda p: p["x"] != p["y"])
    elements = F.when(a["elements"] == b["elements"], "").otherwise(F.array_join(F.transform(changed, lambda p: F.concat(
        p["element"], F.lit(": "), p["x"].cast("string"), F.lit(" -> "), p["y"].cast("string"))), ", "))

    def times(words: Column, word: Column) -> Column:
        return F.size(F.filter(words, lambda w: w == word))

    left = F.coalesce(b["keywords"], F.array().cast("array<string>"))
    counts = F.transform(F.array_distinct(a["keywords"]), lambda w: F.struct(
        w.alias("word"), times(a["keywords"], w).alias("x"), times(left, w).alias("y")))
    fewer = F.filter(counts, lambda c: c["y"] < c["x"])
    keywords = F.when(a["keywords"] == b["keywords"], "").otherwise(F.array_join(F.sort_array(F.transform(fewer, lambda c: F.concat(
        c["word"], F.lit("("), c["x"].cast("string"), F.lit("->"), c["y"].cast("string"), F.lit(")")))), ", "))

    lost = F.size(F.array_except(a["strings"], b["strings"]))
    extra = F.size(F.array_except(b["strings"], a["strings"]))
    numbers = F.size(F.array_except(a["numbers"], b["numbers"]))
    same = (a["strings"] == b["strings"]) & (a["numbers"] == b["numbers"])
    literals = F.when(same | (lost + extra + numbers == 0), "").otherwise(F.concat(
        F.lit("missing strings "), lost.cast("string"), F.lit(", extra strings "), extra.cast("string"),
        F.lit(", missing numbers "), numbers.cast("string")))

    words = F.size(F.array_except(a["remark_words"], b["remark_words"]))
    remarks = (
        F.when(b["n_remarks"] < a["n_remarks"],
               F.concat(F.lit("fewer line comments: "), (a["n_remarks"] - b["n_remarks"]).cast("string")))
        .when(a["remark_words"] == b["remark_words"], "")
        .when(words > 0, F.concat(F.lit("missing comment words: "), words.cast("string"))).otherwise("")
    )

    presence = F.when(a.isNull(), "added").when(b.isNull(), "missing").otherwise("")
    # the details stand in columns of their own, so that each is put together once and not for every use
    both = both.select("path", (a.isNull() | b.isNull()).alias("absent"), presence.alias("presence"), elements.alias("elements"),
                       keywords.alias("keywords"), literals.alias("literals"), remarks.alias("comments"))

    def row(check: str, bad: str, needs_both: bool = True) -> Column:
        details, absent = F.col(check), F.col("absent")
        result = F.when(details == "", "PASS").otherwise(bad)
        return F.struct(
            F.lit(check).alias("check"),
            (F.when(absent, "SKIP").otherwise(result) if needs_both else result).alias("result"),
            (F.when(absent, "").otherwise(details) if needs_both else details).alias("details"),
        )

    rows = F.array(row("presence", "FAIL", needs_both=False), row("elements", "FAIL"), row("keywords", "FAIL"),
                   row("literals", "FAIL"), row("comments", "WARN"))
    return both.select("path", F.explode(rows).alias("r")).select("path", "r.check", "r.result", "r.details")


def verdicts(report: DataFrame) -> DataFrame:
    """(path, passed): every check that was not skipped is PASS."""
    return report.groupBy("path").agg(F.bool_and(F.expr("result = 'PASS' OR result = 'SKIP'")).alias("passed"))


def layout_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, same_text, same_tokens) for scripts of both versions; same tokens in a different text is a change of
    layout, comments or case only."""

    def digest(scripts: DataFrame, name: str) -> DataFrame:
        return scripts.select("path", F.sha2("sql", 256).alias(f"{name}_text"),
                              F.sha2(normal_text(F.col("sql")), 256).alias(f"{name}_tokens"))

    return digest(old, "old").join(digest(new, "new"), "path").select(
        "path", (F.col("old_text") == F.col("new_text")).alias("same_text"),
        (F.col("old_tokens") == F.col("new_tokens")).alias("same_tokens"),
    )


def copies(scripts: DataFrame) -> DataFrame:
    """Scripts that are copies of each other but for layout: (path, n_copies, first_name)."""
    return copy_groups(
        scripts.select("path", F.sha2(normal_text(F.col("sql")), 256).alias("signature")), "signature", "path"
    )


def same_tables(refs: DataFrame) -> DataFrame:
    """Scripts that touch exactly the same set of tables: (script_id, tables, n_scripts). The set of one script is small,
    it is part of its text."""
    sets = refs.groupBy("script_id").agg(F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("tables"))
    # The sets are read twice; what the tokens cost is paid once.
    return with_group_stats(materialize(sets), ["tables"], [F.count(F.lit(1)).alias("n_scripts")])
