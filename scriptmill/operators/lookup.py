"""Code tables, prefix fallbacks and keyword rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from scriptmill.session import shuffle_partitions, store
from scriptmill.sources.tables import code_table

# Sample rule table for part names: priority, word, code. The first matching rule wins.
KEYWORD_RULES: list[tuple[int, str, str]] = [
    (1, "ring", "J01"), (2, "gear", "M01"), (3, "bolt", "M02"), (4, "gizmo", "G01"), (5, "widget", "G02"),
    (6, "red", "C01"), (7, "blue", "C02"), (8, "hot", "T01"), (9, "cold", "T02"), (10, "small", "S01"),
]

def rules_table(spark: SparkSession) -> DataFrame:
    return code_table(spark, KEYWORD_RULES, "prio int, word string, code string")


Rules = DataFrame | list[tuple[int, str, str]]
# Rules of a table that may travel inside one row (counted before they are collected); a larger table is joined.
PACKED_RULES = 10_000
# Words of a larger table of up to so many characters meet the texts as a whole, longer ones by a piece of that length.
GRAM = 32
# Beginnings of words (three characters) that may be broadcast, so that other pieces of the texts do not travel.
HEAD, HEADS = 3, 100_000


def _packed(rules: Rules) -> Column | None:
    """The rules as a constant array by priority, or None if there are too many."""
    if not isinstance(rules, list):
        found = rules.select("prio", "word", "code").limit(PACKED_RULES + 1).collect()
        if len(found) > PACKED_RULES:
            return None
        rules = [tuple(r) for r in found]
    kind = "array<struct<prio:int,word:string,code:string>>"
    entries = [F.struct(F.lit(p).alias("prio"), F.lit(w).alias("word"), F.lit(c).alias("code")) for p, w, c in sorted(rules)]
    return F.array(*entries).cast(kind)


def keyword_matches(df: DataFrame, text: Column, rules: Rules) -> DataFrame:
    """One row per row and matching rule, with prio and code.

    Few rules become a constant of the plan, and nothing is shuffled. Many are joined with the texts on pieces of the lengths
    that the words have: a word of up to ``GRAM`` characters is such a piece itself, so it meets only the texts that hold it,
    however many words have parts in common. A longer one is looked up by the one of its pieces of that length that the fewest
    texts hold. The empty word is in every text. Of many rules, equal ones of ``HEAD`` characters or more count once.
    """
    packed = _packed(rules)
    rows = df.withColumn("__text", text)
    if packed is not None:
        hits = F.filter(packed, lambda r: F.contains(F.col("__text"), r["word"]))
        return rows.withColumn("__hit", F.explode(hits)).select("*", "__hit.prio", "__hit.code").drop("__text", "__hit")
    named = rules.where("word IS NOT NULL").select(F.col("prio").alias("__p"), F.col("word").alias("__w"), F.col("code").alias("__c"))
    sizes = sorted(r.n for r in named.select(F.least(F.length("__w"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM + 1 at most
    if not sizes:
        sizes = [0]
    once = named.where(F.length("__w").between(HEAD, GRAM)).distinct()
    short = named.where(F.length("__w") < HEAD).unionByName(once).withColumn("__gram", F.col("__w"))
    pieces = named.where(F.length("__w") > GRAM).withColumn("__gram", F.explode(F.array_distinct(_grams("__w", F.lit(GRAM)))))
    heads = store(short.select("__gram").unionByName(pieces.select("__gram")).select(
        F.substring("__gram", 1, HEAD).alias("__head")).distinct())
    texts = store(df.select(text.alias("__text")).where("__text IS NOT NULL").distinct().withColumn("__id", F.monotonically_increasing_id()))
    # Small rows become many pieces here: they are dealt out first, and the planner is not to take them for a small table.
    held = texts.repartition(shuffle_partitions(df.sparkSession), "__id").withColumn("__n", F.explode(F.array(*[F.lit(n) for n in sizes]))).select(
        "__id", F.explode(F.array_distinct(_grams("__text", F.col("__n")))).alias("__gram"))
    held = held.withColumn("__head", F.substring("__gram", 1, HEAD)).join(
        F.broadcast(heads) if heads.count() <= HEADS else heads, "__head", "left_semi").drop("__head")
    met = held.hint("merge").join(short, "__gram").select("__id", "__p", "__c")
    if sizes[-1] == GRAM and not pieces.isEmpty():
        held = store(held.where(F.length("__gram") == GRAM))
        wanted = pieces.select(F.col("__gram").alias("__g")).distinct()
        counts = held.join(wanted, F.col("__gram") == F.col("__g"), "left_semi").groupBy(F.col("__gram").alias("__g")).agg(
            F.count(F.lit(1)).alias("__n"))
        # a word with a piece that no text holds is in none
        known = pieces.join(counts, F.col("__gram") == F.col("__g"), "left").groupBy("__p", "__w", "__c").agg(
            F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("g"))).alias("__rare"))
        long = known.where("__rare.n > 0").select("__p", "__w", "__c", F.col("__rare.g").alias("__gram"))
        near = held.join(long, "__gram").join(texts, "__id").where(F.contains("__text", "__w")).select("__id", "__p", "__c")
        met = met.unionByName(near)
    found = met.join(texts, "__id").select("__text", "__p", "__c")
    return rows.join(found, "__text").select(*df.columns, F.col("__p").alias("prio"), F.col("__c").alias("code"))


def _grams(text: str, n: Column) -> Column:
    """All pieces of n characters; none of a shorter text. A piece of no characters is in every text."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))."))
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, pattern, F.lit(1)))


def keyword_code(df: DataFrame, text: Column, rules: Rules, default: str, name: str = "code") -> DataFrame:
    """Adds the code of the first rule, by priority, whose word occurs in the text."""
    packed = _packed(rules)
    rows = df.withColumn("__text", text)
    if packed is not None:
        hit = F.filter(packed, lambda r: F.contains(F.col("__text"), r["word"]))
        return rows.withColumn(name, F.coalesce(F.get(hit, F.lit(0))["code"], F.lit(default))).drop("__text")
    texts = df.select(text.alias("__key")).distinct()
    first = keyword_matches(texts, F.col("__key"), rules).groupBy("__key").agg(F.min_by("code", "prio").alias("__code"))
    return rows.join(first, F.col("__text") == F.col("__key"), "left").select(
        *[c for c in df.columns if c != name], F.coalesce("__code", F.lit(default)).alias(name))


def not_in(left: DataFrame, key: str, right: DataFrame, value: str) -> DataFrame:
    """Rows of ``left`` for which ``key NOT IN (SELECT value FROM right)`` holds: none if the right side has a NULL; all if
    it is empty; otherwise those with a known key that does not occur. An anti join that shuffles, and one row of counts."""
    side = right.select(F.col(value).alias("__value"))
    facts = side.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__value").isNull()).alias("__nulls"))
    kept = left.join(side, F.col(key) == F.col("__value"), "left_anti").crossJoin(F.broadcast(facts))
    return kept.where(f"__n = 0 OR (__nulls = 0 AND `{key}` IS NOT NULL)").select(*left.columns)


@udtf(returnType="prio int, code string")
class KeywordMatches:
    """The rules as a table function: yields every matching rule of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for prio, word, code in KEYWORD_RULES:
            if text is not None and word in text:
                yield prio, code


def code_map(df: DataFrame, key: str, codes: DataFrame, code: str, value: str, default: str, name: str) -> DataFrame:
    """Adds ``name``: the code table's value for the key, or the default. Code tables have one row per code."""
    side = codes.select(F.col(code).alias("__code"), F.col(value).alias("__value"))
    return (
        df.join(side, df[key] == side["__code"], "left")
        .withColumn(name, F.coalesce("__value", F.lit(default))).drop("__code", "__value")
    )


def prefix_lookup(df: DataFrame, key: str, dim: DataFrame, code: str, value: str, lengths: list[int],
                  name: str) -> DataFrame:
    """Adds ``name``: the value of the longest prefix of the key that the dimension knows, NULL if it knows none.

    ``lengths`` are the prefix lengths tried besides the whole key. Prefixes are made for distinct keys only and meet
    the dimension in one join; the rows then meet the few found keys.
    """
    prefixes = F.array_distinct(F.array("__key", *[F.substring("__key", 1, n) for n in lengths]))
    side = dim.select(F.col(code).alias("__prefix"), F.col(value).alias("__value"))
    found = (
        df.select(F.col(key).alias("__key")).where(F.col(key).isNotNull()).distinct()
        .select("__key", F.explode(prefixes).alias("__prefix"))
        .join(side, "__prefix").groupBy("__key").agg(F.max_by("__value", F.length("__prefix")).alias(name))
    )
    return df.join(found, df[key] == found["__key"], "left").drop("__key")

