"""Token, statement and comment tables of a script corpus.

The scripts, not their tokens, are shuffled: one hash partitioning on script_id before the tokens are exploded serves
every window and grouping here and in ``structure``, because all of them have script_id among their keys. A window
never holds more than the tokens of one script, which came from one row.

All functions take scripts(script_id, path, sql), or a stored token table in their place: ``store_tokens`` writes the
tokens once, bucketed by script, and what is derived from that table needs no shuffle at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scriptmill.functions.sqltext import TOKEN
from scriptmill.session import shuffle_partitions

# Characters of text in a bucket of stored tokens; its tokens take some thirty times as many bytes while they are sorted.
BUCKET = 8 << 20


def by_script() -> WindowSpec:
    return Window.partitionBy("script_id").orderBy("pos")


def by_statement() -> WindowSpec:
    return Window.partitionBy("script_id", "stmt_no").orderBy("pos")


def _kind(tok: Column) -> Column:
    """Told by the first character and the length, the pattern has done the rest."""
    first, long = F.ascii(tok), F.length(tok) > 1
    letter = first.between(65, 90) | first.between(97, 122) | (first == 95)
    return (
        F.when(tok == "\n", "newline")
        .when(letter | ((first == ord("`")) & long), "ident")
        .when(first.between(48, 57), "number")
        .when((first.isin(ord("'"), ord('"'))) & long, "string")
        .when(first.isin(ord("{"), ord("$")) & long, "parameter")
        .when(tok.startswith("--"), "line_comment")
        .when(tok.startswith("/*"), "block_comment")
        .otherwise("op")
    )


def is_token_table(df: DataFrame) -> bool:
    return "tok" in df.columns


def mentioning(scripts: DataFrame, *words: str) -> DataFrame:
    """Scripts whose text holds one of the words at all; the others are dropped before their tokens are made. A stored
    token table is returned as it is."""
    if is_token_table(scripts):
        return scripts
    text = F.upper("sql")
    return scripts.where(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]))


def raw_tokens(scripts: DataFrame, partitions: int | None = None) -> DataFrame:
    """(script_id, pos, tok, kind)."""
    n = partitions or shuffle_partitions(scripts.sparkSession)  # given, since AQE would merge by the bytes of the texts
    return (
        scripts.select("script_id", "sql").repartition(n, "script_id")
        .select("script_id", F.posexplode(F.regexp_extract_all("sql", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
        .withColumn("kind", _kind(F.col("tok")))
    )


def tokens(scripts: DataFrame, partitions: int | None = None) -> DataFrame:
    """(script_id, pos, tok, kind, u, line, level, stmt_no).

    ``u`` is the token in upper case, strings as they are. ``level`` is the parenthesis depth a token stands at, a
    parenthesis itself belongs to the outer level. A statement ends at a ``;`` of level 0.
    """
    if is_token_table(scripts):
        return scripts
    before = by_script().rowsBetween(Window.unboundedPreceding, -1)
    tok = F.col("tok")
    inner = F.length(tok) - F.length(F.replace(tok, F.lit("\n"), F.lit("")))
    newlines = F.when(F.col("kind") == "newline", 1).when(F.col("kind").isin("string", "block_comment"), inner).otherwise(0)
    step = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)
    return (
        raw_tokens(scripts, partitions)
        .withColumn("line", (F.lit(1) + F.coalesce(F.sum(newlines).over(before), F.lit(0))).cast("int"))
        .withColumn("__open", F.coalesce(F.sum(step).over(before), F.lit(0)))
        .withColumn("level", F.least(F.col("__open"), F.col("__open") + step).cast("int"))
        .withColumn("__ends", F.when((tok == ";") & (F.col("level") == 0), 1).otherwise(0))
        .withColumn("stmt_no", (F.lit(1) + F.coalesce(F.sum("__ends").over(before), F.lit(0))).cast("int"))
        .select("script_id", "pos", "tok", "kind",
                F.when(F.col("kind") == "ident", F.upper(tok)).otherwise(tok).alias("u"), "line", "level", "stmt_no")
    )


def buckets_for(scripts: DataFrame) -> int:
    """Buckets of about ``BUCKET`` characters of text, so that the tokens of a bucket are sorted in memory."""
    chars = scripts.agg(F.sum(F.length("sql"))).first()[0] or 0
    return max(16, -(-chars // BUCKET))


def store_tokens(scripts: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    """Write the tokens as a table bucketed and sorted by script, one file per bucket, and return the table. Without a number
    of buckets it follows from the size of the texts."""
    buckets = buckets or buckets_for(scripts)
    tokens(scripts, buckets).write.mode("overwrite").bucketBy(buckets, "script_id").sortBy("script_id", "pos").saveAsTable(table)
    return scripts.sparkSession.table(table)


def code_tokens(scripts: DataFrame) -> DataFrame:
    """Tokens of the statements, without comments, newlines and separators, with the neighbours prev1, prev2,
    next1 .. next3 (upper case) inside the statement."""
    code = tokens(scripts).where(
        ~F.col("kind").isin("newline", "line_comment", "block_comment") & ~((F.col("tok") == ";") & (F.col("level") == 0))
    )
    for n in (1, 2):
        code = code.withColumn(f"prev{n}", F.lag("u", n).over(by_statement()))
    for n in (1, 2, 3):
        code = code.withColumn(f"next{n}", F.lead("u", n).over(by_statement()))
    return code


def text_of(condition: Column | None = None, sep: str = " ", value: str = "tok") -> Column:
    """Aggregate: the tokens of the group that meet the condition, in text order. The group is part of one script."""
    item = F.struct("pos", F.col(value).alias("t"))
    kept = F.collect_list(item if condition is None else F.when(condition, item))
    return F.array_join(F.sort_array(kept)["t"], sep)


def paren_balance(scripts: DataFrame) -> DataFrame:
    """(script_id, max_level, balance, is_unbalanced) over parentheses outside strings and comments."""
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    return (
        tokens(scripts).withColumn("step", step)
        .groupBy("script_id")
        .agg(F.max(F.col("level") + (F.col("tok") == "(").cast("int")).alias("max_level"),
             F.sum("step").alias("balance"), F.min("level").alias("lowest"))
        .select("script_id", "max_level", "balance",
                ((F.col("balance") != 0) | (F.col("lowest") < 0)).alias("is_unbalanced"))
    )


def statements(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, first_line, last_line, n_tokens, max_level, text_norm), blank statements left out."""
    return (
        tokens(scripts)
        .where(~F.col("kind").isin("newline", "line_comment", "block_comment")
               & ~((F.col("tok") == ";") & (F.col("level") == 0)))
        .groupBy("script_id", "stmt_no")
        .agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n_tokens"),
             F.max("level").alias("max_level"), text_of(value="u").alias("text_norm"))
    )


def comments(scripts: DataFrame) -> DataFrame:
    """(script_id, seq, kind, content, line), content without the delimiters and outer blanks."""
    tok = F.col("tok")
    body = F.when(F.col("kind") == "line_comment", F.substring(tok, F.lit(3), F.length(tok))).otherwise(
        F.substring(tok, F.lit(3), F.length(tok) - 4)
    )
    return (
        tokens(mentioning(scripts, "--", "/*"))
        .where(F.col("kind").isin("line_comment", "block_comment"))
        .select("script_id", F.row_number().over(by_script()).alias("seq"),
                F.when(F.col("kind") == "line_comment", "line").otherwise("block").alias("kind"),
                F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"), "line")
    )


def normal_text(sql: Column) -> Column:
    """The tokens of a script in one line, without comments, keywords and names in upper case, strings as they are.
    Equal for two texts that differ only in layout, comments or case."""
    toks = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    code = F.filter(toks, lambda t: ~(F.rlike(t, F.lit(r"^(--|/\*[\s\S]*\*/$)")) | (t == "\n")))
    return F.array_join(F.transform(code, lambda t: F.when(F.rlike(t, F.lit("^['\"].")), t).otherwise(F.upper(t))), " ")
