"""Classes, counts and literals of a script, read from its text in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.functions.sqltext import COUNTED_KEYWORDS, ELEMENTS, SYNTAX_CLASSES
from scriptmill.operators.lint import java, without_comments


def syntax_classes(scripts: DataFrame) -> DataFrame:
    """(script_id, classes ARRAY<STRING> by priority, primary_class); blank text has no class."""

    def member(name: str, patterns: list[str]) -> Column:
        return F.when(F.rlike("__bare", java("|".join(f"(?:{p})" for p in patterns))), F.lit(name))

    found = F.array_compact(F.array(*[member(n, p) for n, p in SYNTAX_CLASSES.items()]))
    classes = (
        F.when(F.trim(F.regexp_replace("sql", r"\s", "")) == "", F.array().cast("array<string>"))
        .when(F.size("__found") == 0, F.array(F.lit("basic")))
        .otherwise(F.col("__found"))
    )
    return (
        scripts.withColumn("__bare", without_comments(F.col("sql"))).withColumn("__found", found)
        .select("script_id", classes.alias("classes"))
        .withColumn("primary_class", F.coalesce(F.get("classes", F.lit(0)), F.lit("basic")))
    )


def element_counts(scripts: DataFrame) -> DataFrame:
    """(script_id, n_select, n_from, n_join, n_union, n_subquery)."""
    return scripts.select(
        "script_id", *[F.regexp_count(F.col("sql"), java(p)).cast("bigint").alias(n) for n, p in ELEMENTS.items()]
    )


def keyword_words(sql: Column) -> Column:
    """The counted keywords in text order, in lower case."""
    pattern = r"\b(" + "|".join(COUNTED_KEYWORDS) + r")\b"
    return F.transform(F.regexp_extract_all(sql, java(pattern), F.lit(1)), F.lower)


def keyword_counts(words: Column) -> Column:
    """MAP<keyword, count> of the words of one script; ``words`` should be a column, it is read once per keyword."""
    return F.map_from_entries(
        F.transform(
            F.array_distinct(words),
            lambda k: F.struct(k.alias("keyword"), F.size(F.filter(words, lambda w: w == k)).alias("n")),
        )
    )


def keyword_frequency(scripts: DataFrame) -> DataFrame:
    """(script_id, keyword, n). Counted before the shuffle: all words of a script are in one task."""
    words = scripts.select("script_id", F.explode(keyword_words(F.col("sql"))).alias("keyword"))
    return words.groupBy("script_id", "keyword").agg(F.count(F.lit(1)).alias("n"))


def strings_in(sql: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"'[^']*'"), F.lit(0)))


def numbers_in(sql: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(sql, java(r"\b\d+\.?\d*\b"), F.lit(0)))


def literal_sets(scripts: DataFrame) -> DataFrame:
    """(script_id, kind, literal), each literal once per script."""

    def part(kind: str, values: Column) -> DataFrame:
        return scripts.select("script_id", F.lit(kind).alias("kind"), F.explode(values).alias("literal"))

    return part("string", strings_in(F.col("sql"))).unionByName(part("number", numbers_in(F.col("sql"))))
