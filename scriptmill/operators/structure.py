"""Structure of the statements in a script corpus, as tables derived from the code tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptmill.functions.sqltext import NOT_FUNCTIONS, TYPE_NAMES
from scriptmill.operators.tokens import by_script, by_statement, code_tokens, mentioning, text_of, tokens

STMT = ["script_id", "stmt_no"]
SO_FAR = (Window.unboundedPreceding, Window.currentRow)

JOIN_WORDS = ["INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "SEMI", "ANTI"]
CLAUSE_WORDS = ["SELECT", "FROM", "WHERE", "HAVING", "LIMIT", "WINDOW", "UNION", "INTERSECT", "EXCEPT", "MINUS"]
BY_WORDS = ["GROUP", "ORDER", "DISTRIBUTE", "CLUSTER", "SORT"]
SET_WORDS = ["UNION", "INTERSECT", "EXCEPT", "MINUS"]
QUERY_WORDS = ["SELECT", "INSERT", "MERGE", "UPDATE", "DELETE", "FROM", "VALUES", "TABLE"]
NAME_STOPS = ["ON", "USING", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "WHEN", "LATERAL", *JOIN_WORDS, "JOIN",
              *SET_WORDS]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _segments(code: DataFrame, start: Column, within: list[str] | None = None) -> DataFrame:
    """Cut each statement at the start tokens: seg_no, seg_level (level of the start token) and closed, the number of
    closing parentheses of that level since the start. Tokens before the first start are left out."""
    keys = [*STMT, *(within or [])]
    order = Window.partitionBy(*keys).orderBy("pos")
    seg = Window.partitionBy(*keys, "seg_no")
    return (
        code.withColumn("is_start", _flag(start))
        .withColumn("seg_no", F.sum("is_start").over(order.rowsBetween(*SO_FAR)))
        .where("seg_no > 0")
        .withColumn("seg_level", F.max(F.when(F.col("is_start") == 1, F.col("level"))).over(seg))
        .withColumn("closed", F.sum(_flag((F.col("tok") == ")") & (F.col("level") == F.col("seg_level"))))
                    .over(seg.orderBy("pos").rowsBetween(*SO_FAR)))
    )


def _first_word(code: DataFrame) -> DataFrame:
    return code.withColumn("u1", F.first("u").over(by_statement().rowsBetween(*SO_FAR)))


def statement_kinds(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, kind) by the leading keywords; comments do not count."""
    ranked = code_tokens(scripts).withColumn("n", F.row_number().over(by_statement()))
    words = ranked.groupBy(*STMT).agg(
        *[F.max(F.when(F.col("n") == i, F.col("u"))).alias(f"w{i}") for i in (1, 2, 3)],
        F.max(_flag((F.col("u") == "AS") & (F.col("level") == 0) & F.col("next1").isin("SELECT", "(", "WITH")))
        .alias("as_query"),
        F.max(_flag((F.col("u") == "PARTITION") & (F.col("level") == 0))).alias("partitioned"),
    )
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    view = (w2 == "VIEW") | (w2.isin("TEMPORARY", "TEMP") & (w3 == "VIEW")) | ((w2 == "OR") & (w3 == "REPLACE"))
    kind = (
        F.when((w1 == "DROP") & (w2 == "DATABASE"), "DROP DATABASE")
        .when(w1 == "DROP", "DROP")
        .when((w1 == "CREATE") & (w2 == "DATABASE"), "CREATE DATABASE")
        .when((w1 == "CREATE") & (w2 == "TABLE") & (F.col("as_query") == 1), "CREATE TABLE AS SELECT")
        .when((w1 == "CREATE") & (w2 == "TABLE"), "CREATE TABLE")
        .when((w1 == "CREATE") & view, "CREATE VIEW")
        .when((w1 == "CREATE") & (w2 == "FUNCTION"), "CREATE FUNCTION")
        .when((w1 == "INSERT") & (F.col("partitioned") == 1), "INSERT PARTITION")
        .when(w1 == "DESC", "DESCRIBE")
        .when(w1.isin("ALTER", "TRUNCATE", "ANALYZE", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH", "CACHE", "UNCACHE",
                      "REFRESH", "EXPLAIN", "SHOW", "DESCRIBE", "USE", "SET", "SELECT"), w1)
        .otherwise("OTHER")
    )
    return words.select(*STMT, kind.alias("kind"))


def _clause_tokens(code: DataFrame) -> DataFrame:
    """Adds clause_no and clause for tokens of the statement's top level and everything inside it."""
    u, nxt, prv = F.col("u"), F.col("next1"), F.coalesce("prev1", F.lit(""))
    is_word = (F.col("kind") == "ident") & (F.col("level") == 0)
    start = is_word & (
        u.isin(CLAUSE_WORDS)
        | (u.isin(BY_WORDS) & (nxt == "BY"))
        | (u.isin(JOIN_WORDS[:5]) & nxt.isin("JOIN", "OUTER", "SEMI", "ANTI"))
        | (u.isin("SEMI", "ANTI") & (nxt == "JOIN") & ~prv.isin(JOIN_WORDS))
        | ((u == "JOIN") & ~prv.isin(JOIN_WORDS))
    )
    name = F.when(u.isin(BY_WORDS), F.concat(u, F.lit(" BY"))).when(u.isin([*JOIN_WORDS, "JOIN"]), "JOIN").otherwise(u)
    started = code.withColumn("__starts", F.coalesce(start, F.lit(False)))
    return (
        started.withColumn("clause_no", F.sum(_flag(F.col("__starts"))).over(by_statement().rowsBetween(*SO_FAR)))
        .withColumn("clause", F.coalesce(
            F.last(F.when(F.col("__starts"), name), ignorenulls=True).over(by_statement().rowsBetween(*SO_FAR)),
            F.lit("HEAD")))
    )


def clauses(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, clause_no, clause, n_tokens, text); HEAD is what stands before the first clause."""
    return (
        _clause_tokens(code_tokens(scripts)).groupBy(*STMT, "clause_no", "clause")
        .agg(F.count(F.lit(1)).alias("n_tokens"), text_of().alias("text"))
    )


def _with_notes(scripts: DataFrame) -> DataFrame:
    """Code tokens with ``note``: the comment that follows on the same line."""
    is_comment = F.col("kind").isin("line_comment", "block_comment")
    anchored = (
        tokens(scripts).where("kind <> 'newline'")
        .withColumn("anchor", F.sum(_flag(~is_comment)).over(by_script().rowsBetween(*SO_FAR)))
        .withColumn("code_line", F.last(F.when(~is_comment, F.col("line")), ignorenulls=True)
                    .over(by_script().rowsBetween(*SO_FAR)))
        .where("anchor > 0")
    )
    mine = is_comment & (F.col("line") == F.col("code_line"))
    code = anchored.groupBy("script_id", "anchor").agg(
        *[F.max(F.when(~is_comment, F.col(c))).alias(c) for c in ("pos", "tok", "kind", "u", "line", "level", "stmt_no")],
        F.min_by("tok", F.when(mine, F.col("pos"))).alias("note"),
    ).drop("anchor").where(~((F.col("tok") == ";") & (F.col("level") == 0)))
    return code.withColumn("prev1", F.lag("u", 1).over(by_statement())).withColumn("next1", F.lead("u", 1).over(by_statement()))


def select_fields(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, clause_no, ordinal, expression, alias, note) of the top-level select lists."""
    comma = (F.col("tok") == ",") & (F.col("level") == 0)
    clause = Window.partitionBy(*STMT, "clause_no").orderBy("pos")
    field = Window.partitionBy(*STMT, "clause_no", "ordinal").orderBy("pos")
    body = (
        _clause_tokens(_with_notes(mentioning(scripts, "SELECT"))).where("clause = 'SELECT'")
        .withColumn("ordinal", F.lit(1) + F.coalesce(
            F.sum(_flag(comma)).over(clause.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(~((F.col("u") == "SELECT") & (F.col("level") == 0))
               & ~(F.col("u").isin("DISTINCT", "ALL") & (F.col("prev1") == "SELECT")))
        # A comma ends its field and may carry the field's comment, but it is not part of the expression.
        .withColumn("is_comma", _flag(comma))
        .withColumn("n", F.row_number().over(field))
        .withColumn("is_last", _flag(F.coalesce(F.lead("is_comma").over(field), F.lit(1)) == 1) * (1 - F.col("is_comma")))
    )
    last = F.col("is_last") == 1
    prev = F.col("prev1")
    named = last & (F.col("n") > 1) & (F.col("kind") == "ident") & (F.col("level") == 0)
    implicit = ~F.col("u").isin("END", "NULL", "TRUE", "FALSE") & ~F.rlike(prev, F.lit(r"^[^A-Za-z0-9_'\"`)]"))
    alias = F.when(named & ((prev == "AS") | implicit), F.col("tok"))
    return (
        body.groupBy(*STMT, "clause_no", "ordinal")
        .agg(text_of(F.col("is_comma") == 0).alias("text"), F.max(alias).alias("alias"),
             F.max(_flag(named & (prev == "AS"))).alias("has_as"), F.min_by("note", F.when(F.col("note").isNotNull(), F.col("pos"))).alias("note"))
        .select(*STMT, "clause_no", "ordinal",
                F.when(F.col("alias").isNull(), F.col("text"))
                .when(F.col("has_as") == 1, F.expr("substring(text, 1, length(text) - length(alias) - 4)"))
                .otherwise(F.expr("substring(text, 1, length(text) - length(alias) - 1)")).alias("expression"),
                F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("note", F.lit("")).alias("note"))
    )


def joins(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, level, join_no, join_type, table_name, alias, has_condition), at every level. Names stand
    without quotes; of JOIN LATERAL it is the subquery or the function that is joined, without alias."""
    code = code_tokens(mentioning(scripts, "JOIN")).withColumn("next4", F.lead("u", 4).over(by_statement())).withColumn(
        "next5", F.lead("u", 5).over(by_statement())
    )
    for n in (1, 2, 3):
        code = code.withColumn(f"tok{n}", F.lead("tok", n).over(by_statement()))
    lateral = F.coalesce(F.col("next1") == "LATERAL", F.lit(False))
    subquery = (F.col("next1") == "(") | (lateral & (F.col("next2") == "("))
    prv, prv2 = F.coalesce("prev1", F.lit("")), F.coalesce("prev2", F.lit(""))
    join_type = (
        F.when(prv.isin("OUTER", "SEMI", "ANTI") & prv2.isin(JOIN_WORDS), F.concat_ws(" ", prv2, prv))
        .when(prv.isin(JOIN_WORDS), prv)
        .otherwise("INNER")
    )
    dotted = F.col("next2") == "."
    after = F.when(dotted, F.col("next4")).otherwise(F.col("next2"))
    after2 = F.when(dotted, F.col("next5")).otherwise(F.col("next3"))
    alias = F.when(after == "AS", after2).otherwise(after)
    is_name = F.rlike(alias, F.lit("^[A-Z_]")) & ~alias.isin(NAME_STOPS)
    seg = _segments(code, F.col("u") == "JOIN", within=["level"])
    first = F.col("is_start") == 1
    return (
        seg.groupBy(*STMT, "level", "seg_no")
        .agg(
            F.max(F.when(first, join_type)).alias("join_type"),
            F.max(F.when(first, F.when(subquery, F.lit("(subquery)")).otherwise(F.replace(
                F.when(lateral, F.col("tok2")).when(dotted, F.concat_ws(".", "tok1", "tok3")).otherwise(F.col("tok1")),
                F.lit("`"), F.lit(""))))).alias("table_name"),
            F.max(F.when(first & (F.col("next1") != "(") & ~lateral & is_name, F.lower(alias))).alias("alias"),
            F.max(_flag(F.col("u").isin("ON", "USING"))).alias("has_condition"),
        )
        .select(*STMT, "level", F.col("seg_no").alias("join_no"), "join_type", "table_name",
                F.coalesce("alias", F.lit("")).alias("alias"), "has_condition")
    )


def set_segments(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, seg_no, operator, n_tokens, text): the branches of top-level set operations, with the
    operator in front of each; statements without one give a single segment."""
    op = (F.col("level") == 0) & F.col("u").isin(SET_WORDS) & (F.col("kind") == "ident")
    modifier = F.col("u").isin("ALL", "DISTINCT") & F.coalesce("prev1", F.lit("")).isin(SET_WORDS) & (F.col("level") == 0)
    cut = code_tokens(scripts).withColumn("is_op", _flag(op)).withColumn("is_mod", _flag(modifier)).withColumn(
        "seg_no", F.sum("is_op").over(by_statement().rowsBetween(*SO_FAR))
    )
    operator = F.when(F.col("next1") == "ALL", F.concat(F.col("u"), F.lit(" ALL"))).otherwise(F.col("u"))
    plain = (F.col("is_op") == 0) & (F.col("is_mod") == 0)
    return (
        cut.groupBy(*STMT, "seg_no")
        .agg(F.coalesce(F.max(F.when(F.col("is_op") == 1, operator)), F.lit("")).alias("operator"),
             F.sum(_flag(plain)).alias("n_tokens"), text_of(plain).alias("text"))
    )


def ctes(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, cte_no, name, first_line, last_line, n_tokens, has_main)."""
    code = _first_word(code_tokens(mentioning(scripts, "WITH"))).where("u1 = 'WITH'").withColumn(
        "has_main", F.max(_flag((F.col("level") == 0) & F.col("u").isin(QUERY_WORDS))).over(Window.partitionBy(*STMT))
    )
    start = (
        (F.col("level") == 0) & (F.col("kind") == "ident") & (F.col("next1") == "AS") & (F.col("next2") == "(")
        & F.col("prev1").isin("WITH", "RECURSIVE", ",")
    )
    body = (F.col("closed") == 0) & (F.col("level") > F.col("seg_level"))
    return (
        _segments(code, start).groupBy(*STMT, "seg_no", "has_main")
        .agg(F.max(F.when(F.col("is_start") == 1, F.col("tok"))).alias("name"),
             F.min(F.when(body, F.col("line"))).alias("first_line"), F.max(F.when(body, F.col("line"))).alias("last_line"),
             F.sum(_flag(body)).alias("n_tokens"))
        .withColumnRenamed("seg_no", "cte_no")
    )


def _create_table_tokens(scripts: DataFrame) -> DataFrame:
    """Tokens of CREATE TABLE statements with table_name, group_no and group_kind of the top-level parentheses."""
    stmt = Window.partitionBy(*STMT)
    names_table = (F.col("kind") == "ident") & (F.col("level") == 0) & (
        ((F.col("prev1") == "TABLE") & (F.col("u") != "IF")) | ((F.col("prev1") == "EXISTS") & (F.col("prev2") == "NOT"))
    )
    full = F.when(F.col("next1") == ".", F.concat_ws(".", F.col("u"), F.col("next2"))).otherwise(F.col("u"))
    opens = (F.col("tok") == "(") & (F.col("level") == 0)
    code = (
        _first_word(code_tokens(mentioning(scripts, "CREATE")))
        .withColumn("u2", F.max(_flag((F.col("prev1") == "CREATE") & (F.col("u") == "TABLE"))).over(stmt))
        .withColumn("table_name", F.lower(F.min_by(full, F.when(names_table, F.col("pos"))).over(stmt)))
        .withColumn("as_seen", F.sum(_flag((F.col("u") == "AS") & (F.col("level") == 0)
                                           & F.col("next1").isin("SELECT", "WITH", "(")))
                    .over(by_statement().rowsBetween(*SO_FAR)))
        .where("u1 = 'CREATE' AND u2 = 1 AND as_seen = 0")
        .withColumn("group_no", F.sum(_flag(opens)).over(by_statement().rowsBetween(*SO_FAR)))
    )
    kind = F.when(opens & (F.col("prev1") == "BY") & (F.col("prev2") == "PARTITIONED"), "partition").when(
        opens & (F.col("group_no") == 1), "column"
    )
    return code.withColumn("group_kind", F.max(kind).over(Window.partitionBy(*STMT, "group_no")))


def _unquote(tok: Column) -> Column:
    return F.replace(F.substring(tok, F.lit(2), F.length(tok) - 2), F.lit("''"), F.lit("'"))


def ddl_columns(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, table_name, ordinal, name, type, comment, is_partition); blanks in comments are kept."""
    group = Window.partitionBy(*STMT, "group_no").orderBy("pos")
    column = Window.partitionBy(*STMT, "group_no", "ordinal").orderBy("pos")
    comma = (F.col("tok") == ",") & (F.col("level") == 1)
    body = (
        _create_table_tokens(scripts).where("level >= 1 AND group_kind IS NOT NULL")
        .withColumn("ordinal", F.lit(1) + F.sum(_flag(comma)).over(group.rowsBetween(*SO_FAR)))
        .where(~comma)
        .withColumn("n", F.row_number().over(column))
        .withColumn("past_type", F.sum(_flag(F.col("u").isin("COMMENT", "NOT", "NULL", "DEFAULT", "PRIMARY")
                                             & (F.col("n") > 1))).over(column.rowsBetween(*SO_FAR)))
    )
    return (
        body.groupBy(*STMT, "table_name", "group_no", "group_kind", "ordinal")
        .agg(F.max(F.when(F.col("n") == 1, F.col("tok"))).alias("name"),
             F.lower(text_of((F.col("n") > 1) & (F.col("past_type") == 0), "")).alias("type"),
             F.coalesce(F.max(F.when((F.col("prev1") == "COMMENT") & (F.col("n") > 2), _unquote(F.col("tok")))),
                        F.lit("")).alias("comment"))
        .select(*STMT, "table_name", "ordinal", "name", "type", "comment",
                (F.col("group_kind") == "partition").alias("is_partition"))
    )


def table_options(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, table_name, comment, partitioned_by, row_format, stored_as) of CREATE TABLE."""
    top = F.col("level") == 0
    section = F.when(
        top & F.col("u").isin("COMMENT", "PARTITIONED", "ROW", "STORED", "USING", "LOCATION", "TBLPROPERTIES")
        & (F.col("group_no") >= 1), F.col("u"))
    body = _create_table_tokens(scripts).withColumn(
        "section", F.last(section, ignorenulls=True).over(by_statement().rowsBetween(*SO_FAR))
    )
    return (
        body.groupBy(*STMT, "table_name")
        .agg(F.coalesce(F.max(F.when(top & (F.col("prev1") == "COMMENT") & (F.col("kind") == "string"),
                                     _unquote(F.col("tok")))), F.lit("")).alias("comment"),
             text_of((F.col("section") == "PARTITIONED") & (F.col("level") >= 1)).alias("partitioned_by"),
             text_of((F.col("section") == "ROW") & ~F.col("u").isin("ROW", "FORMAT")).alias("row_format"),
             text_of((F.col("section") == "STORED") & ~F.col("u").isin("STORED", "AS")).alias("stored_as"))
    )


def _case_depth(code: DataFrame) -> DataFrame:
    """Adds case_depth: 1 for the tokens of an outermost CASE block, its CASE and END included; 0 outside. A column may be
    named end: behind a point, and where no block is open, END closes nothing."""
    free = F.coalesce("prev1", F.lit("")) != "."
    step = F.when((F.col("u") == "CASE") & free, 1).when((F.col("u") == "END") & free, -1).otherwise(0)
    earlier = by_statement().rowsBetween(Window.unboundedPreceding, -1)
    # a sum that is not to fall below zero: the plain sum less its lowest value so far
    summed = code.withColumn("__sum", F.coalesce(F.sum(step).over(earlier), F.lit(0)))
    lowest = F.least(F.lit(0), F.min("__sum").over(by_statement().rowsBetween(*SO_FAR)))
    return summed.withColumn("case_depth", F.col("__sum") - lowest + _flag((F.col("u") == "CASE") & free)).drop("__sum")


def case_blocks(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, case_depth, block_no, line, n_branches, has_else)."""
    nested = Window.partitionBy(*STMT, "case_depth").orderBy("pos")
    return (
        _case_depth(code_tokens(mentioning(scripts, "CASE"))).where("case_depth > 0")
        .withColumn("block_no", F.sum(_flag(F.col("u") == "CASE")).over(nested.rowsBetween(*SO_FAR)))
        .groupBy(*STMT, "case_depth", "block_no")
        .agg(F.min("line").alias("line"), F.sum(_flag(F.col("u") == "WHEN")).alias("n_branches"),
             F.max(_flag(F.col("u") == "ELSE")).alias("has_else"))
    )


def merge_parts(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, branch_no, part, text) of MERGE statements; parts target, source, on, then per branch
    when (with its condition) and action. WHEN inside strings or CASE does not start a branch."""
    code = _case_depth(_first_word(code_tokens(mentioning(scripts, "MERGE"))).where("u1 = 'MERGE'"))
    free = (F.col("level") == 0) & (F.col("case_depth") == 0)
    mark = (
        F.when((F.col("u") == "INTO") & (F.col("prev1") == "MERGE"), "target")
        .when(free & (F.col("u") == "USING"), "source")
        .when(free & (F.col("u") == "ON"), "on")
        .when(free & (F.col("u") == "WHEN"), "when")
        .when(free & (F.col("u") == "THEN"), "action")
    )
    so_far = by_statement().rowsBetween(*SO_FAR)
    return (
        code.withColumn("mark", mark)
        .withColumn("part", F.last("mark", ignorenulls=True).over(so_far))
        .withColumn("branch_no", F.sum(_flag(F.col("mark") == "when")).over(so_far))
        .where("mark IS NULL AND part IS NOT NULL")
        .groupBy(*STMT, "branch_no", "part").agg(text_of().alias("text"))
    )


def window_specs(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, spec_no, function, window_name, partition_by, order_by, frame); definitions in a WINDOW
    clause have no function, uses of a named window have no body."""
    same_level = Window.partitionBy(*STMT, "level").orderBy("pos")
    code = (
        code_tokens(mentioning(scripts, "OVER", "WINDOW"))
        .withColumn("at_window", F.sum(_flag((F.col("u") == "WINDOW") & (F.col("level") == 0) & (F.col("kind") == "ident")))
                    .over(by_statement().rowsBetween(*SO_FAR)))
        .withColumn("called", F.lag("u", 3).over(same_level))
        .withColumn("called_filtered", F.lag("u", 6).over(same_level))
        .withColumn("next_tok", F.lead("tok", 1).over(by_statement()))
        .withColumn("prev_tok", F.lag("tok", 1).over(by_statement()))
    )
    over = (F.col("u") == "OVER") & (F.col("kind") == "ident")
    definition = (F.col("u") == "AS") & (F.col("next1") == "(") & (F.col("level") == 0) & (F.col("at_window") > 0)
    seg = _segments(code, over | definition)
    whole = Window.partitionBy(*STMT, "seg_no")
    first = F.col("is_start") == 1
    direct = F.col("level") == F.col("seg_level") + 1
    section = F.when(direct & F.col("u").isin("PARTITION", "ORDER", "ROWS", "RANGE"), F.col("u"))
    seg = (
        seg.withColumn("has_body", F.max(_flag(first & (F.col("next1") == "("))).over(whole))
        .withColumn("section", F.last(section, ignorenulls=True).over(whole.orderBy("pos").rowsBetween(*SO_FAR)))
        .withColumn("in_body", (F.col("has_body") == 1) & (F.col("closed") == 0) & (F.col("level") > F.col("seg_level")))
    )
    word = direct & F.col("u").isin("PARTITION", "ORDER", "BY")

    def part(*names: str) -> Column:
        return text_of(F.col("in_body") & F.col("section").isin(*names) & ~word)

    function = F.when(F.col("called") == "FILTER", F.col("called_filtered")).otherwise(F.col("called"))
    return seg.groupBy(*STMT, F.col("seg_no").alias("spec_no")).agg(
        F.lower(F.coalesce(F.max(F.when(first & (F.col("u") == "OVER"), function)), F.lit(""))).alias("function"),
        F.coalesce(F.max(F.when(first & (F.col("u") == "AS"), F.col("prev_tok"))
                         .when(first & (F.col("next1") != "("), F.col("next_tok"))), F.lit("")).alias("window_name"),
        part("PARTITION").alias("partition_by"), part("ORDER").alias("order_by"), part("ROWS", "RANGE").alias("frame"),
    )


def lateral_views(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, view_no, is_outer, generator, args, table_alias, columns); clauses that follow the view
    are not part of it."""
    seg = _segments(code_tokens(mentioning(scripts, "LATERAL")), (F.col("u") == "LATERAL") & (F.col("next1") == "VIEW"))
    order = Window.partitionBy(*STMT, "seg_no").orderBy("pos")
    stops = ["WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "DISTRIBUTE", "CLUSTER", "SORT", "WINDOW", "JOIN", *JOIN_WORDS,
             *SET_WORDS]
    ended = (F.col("level") < F.col("seg_level")) | ((F.col("closed") > 0) & (F.col("level") == F.col("seg_level"))
                                                     & F.col("u").isin(stops))
    post = (F.col("closed") == 1) & (F.col("ended") == 0) & (F.col("tok") != ")")
    seg = (
        seg.withColumn("n", F.row_number().over(order))
        .withColumn("ended", F.sum(_flag(ended)).over(order.rowsBetween(*SO_FAR)))
        .withColumn("after_no", F.sum(_flag(post)).over(order.rowsBetween(*SO_FAR)))
        .withColumn("as_seen", F.sum(_flag(post & (F.col("u") == "AS"))).over(order.rowsBetween(*SO_FAR)))
    )
    name_at = F.when(F.col("prev1") == "OUTER", F.col("n") == 4).otherwise((F.col("n") == 3) & (F.col("u") != "OUTER"))
    return seg.groupBy(*STMT, F.col("seg_no").alias("view_no")).agg(
        F.max(_flag((F.col("n") == 3) & (F.col("u") == "OUTER"))).alias("is_outer"),
        F.lower(F.max(F.when(name_at, F.col("u")))).alias("generator"),
        text_of((F.col("closed") == 0) & (F.col("level") > F.col("seg_level"))).alias("args"),
        F.coalesce(F.max(F.when(post & (F.col("after_no") == 1) & (F.col("u") != "AS"), F.col("tok"))), F.lit(""))
        .alias("table_alias"),
        text_of(post & (F.col("as_seen") > 0) & (F.col("u") != "AS") & (F.col("tok") != ","), ",").alias("columns"),
    )


def subquery_depth(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, n_selects, max_depth): how deep a SELECT stands in parentheses."""
    return (
        code_tokens(mentioning(scripts, "SELECT")).where("u = 'SELECT' AND kind = 'ident'").groupBy(*STMT)
        .agg(F.count(F.lit(1)).alias("n_selects"), F.max("level").alias("max_depth"))
    )


def builtin_functions(spark: SparkSession) -> DataFrame:
    """Names the session itself registers; anything else that is called is a user function."""
    return spark.sql("SHOW SYSTEM FUNCTIONS").select(F.lower("function").alias("function")).distinct()


def function_calls(scripts: DataFrame, builtins: DataFrame | None = None) -> DataFrame:
    """(script_id, function, n_calls, is_builtin)."""
    spark = scripts.sparkSession
    known = builtins if builtins is not None else builtin_functions(spark)
    # A name in front of a parenthesis after INTO, TABLE, VIEW or a table keyword is a table with a column list.
    calls = (
        code_tokens(scripts)
        .where((F.col("kind") == "ident") & (F.col("next1") == "(") & ~F.col("u").isin(NOT_FUNCTIONS)
               & ~F.col("u").isin(TYPE_NAMES)
               & ~F.coalesce("prev1", F.lit("")).isin("INTO", "TABLE", "EXISTS", "AS", "."))
        .groupBy("script_id", F.lower("tok").alias("function")).agg(F.count(F.lit(1)).alias("n_calls"))
    )
    # A few hundred names from the function registry, far below any broadcast limit.
    flagged = calls.join(F.broadcast(known.withColumn("is_builtin", F.lit(True))), "function", "left")
    return flagged.select("script_id", "function", "n_calls", F.coalesce("is_builtin", F.lit(False)).alias("is_builtin"))


# Words after which names are no longer tables of the FROM clause.
FROM_ENDS = ["WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "SELECT", "LATERAL", "WINDOW", "SET", "VALUES", "WHEN", "DISTRIBUTE",
             "CLUSTER", "SORT", *SET_WORDS]


def with_query_parts(code: DataFrame) -> DataFrame:
    """Adds for each token the query it stands in and the part of it: lv and grp (its parentheses; an opening one counts
    to its inside), part (the last of SELECT, FROM, JOIN, ON, USING, WHERE, ... of the same parentheses) and gprev, gnext1,
    gnext2 (neighbours within them). FROM counts only behind a SELECT of the same parentheses or outside all of them, and
    not in IS DISTINCT FROM; so extract(year FROM x) has no FROM clause."""
    opens = F.col("tok") == "("
    level = code.withColumn("lv", F.col("level") + _flag(opens))
    run = Window.partitionBy(*STMT, "lv").orderBy("pos").rowsBetween(*SO_FAR)
    level = level.withColumn("grp", F.sum(_flag(opens)).over(run))
    inside = Window.partitionBy(*STMT, "lv", "grp").orderBy("pos")
    u, word = F.col("u"), F.col("kind") == "ident"
    plain = word & (F.coalesce("prev1", F.lit("")) != ".")
    selects = F.coalesce(F.max(_flag(plain & (u == "SELECT"))).over(inside.rowsBetween(*SO_FAR)), F.lit(0))
    distinct_from = (F.coalesce("prev1", F.lit("")) == "DISTINCT") & F.coalesce("prev2", F.lit("")).isin("IS", "NOT")
    is_from = plain & (u == "FROM") & ~distinct_from & ((selects == 1) | (F.col("lv") == 0))
    part = F.when(is_from, "FROM").when(plain & u.isin("JOIN", "ON", "USING", *FROM_ENDS), u)
    return (
        level.withColumn("__part", part).withColumn("part", F.coalesce(F.last("__part", ignorenulls=True).over(
            inside.rowsBetween(*SO_FAR)), F.lit("")))
        .withColumn("is_from", is_from)
        .withColumn("gprev", F.coalesce(F.lag("u").over(inside), F.lit("")))
        .withColumn("gprev_from", F.coalesce(F.lag("is_from").over(inside), F.lit(False)))
        .withColumn("gnext1", F.coalesce(F.lead("u", 1).over(inside), F.lit("")))
        .withColumn("gnext2", F.coalesce(F.lead("u", 2).over(inside), F.lit("")))
        .drop("__part")
    )
