"""Tokens of scripts of any size: one script is cut into pieces that are lexed side by side.

A piece ends behind white space, which is inside no token but a literal, a quoted name or a comment. So a piece can begin in
one of six states. Every piece is scanned for literals and comments from all of them, which gives a map from its first state
to its last; the maps are composed along a script, and each piece is lexed once, from the state that it really begins in. A
literal or comment counts as opened only if it is closed somewhere; whether a later piece can close it is known from the pieces
alone. The tokens of a piece stay in one row until the numbers that all earlier pieces add to them are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.functions.sqltext import _DOUBLE, _SINGLE, TOKEN
from scriptmill.operators.tokens import _kind
from scriptmill.session import store

# Characters of a piece; it goes on to the next white space.
PIECE = 1 << 16

CODE, SINGLE, DOUBLE, QUOTED, BLOCK, LINE = range(6)
# What ends a token that an earlier piece has opened, from the beginning of the piece.
TAILS = {
    SINGLE: r"^[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'", DOUBLE: r'^[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', QUOTED: r"^[^`]*+`",
    BLOCK: r"^[^*]*+(?:\*(?!/)[^*]*+)*+\*/", LINE: r"^[^\n]*+(?=\n)",
}
# A token that is opened and goes on behind its piece.
OPEN = {
    SINGLE: r"|'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+\z", DOUBLE: r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\z', QUOTED: r"|`[^`]*+\z",
    BLOCK: r"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\z",
}
# Pieces that close any such token which is still open when they begin. A single quote closes if it stands in an odd run of
# them, the first not counted if a backslash escapes it; a double one if no backslash does.
CLOSERS = {
    SINGLE: r"(?:(?<![\\'])|(?<!\\)(?=\\))(?:\\\\)*+(?:\\')?+'(?:'')*+(?!')", DOUBLE: r'(?<!\\)(?:\\\\)*+"', QUOTED: "`", BLOCK: r"\*/",
}
# How an open token begins, in the order of the states.
MARKS = ["", "'", '"', "`", "/*", "--"]
# What a scan for literals and comments goes over: whole ones, and code without their marks.
OVER = rf"[^'\"`/\-]++|-(?!-)|/(?!\*)|--[^\n]*+\n|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|{_SINGLE}|{_DOUBLE}|`[^`]*+`"
# Marks that begin nothing, since nothing later closes them.
ALONE = {SINGLE: "'", DOUBLE: '"', QUOTED: "`", BLOCK: r"/(?=\*)"}
FALLBACK = r"|[^\s]"
HEAD = TOKEN.removesuffix(FALLBACK)


def pieces(scripts: DataFrame, size: int = PIECE) -> DataFrame:
    """(script_id, piece, text, close1 .. close4), stored. Pieces are dealt out by script and number."""
    cut = F.regexp_extract_all("sql", F.lit(rf"[\s\S]{{1,{size}}}+\S*+\s?"), F.lit(0))
    rows = scripts.select("script_id", F.posexplode(cut).alias("piece", "text")).repartition("script_id", "piece")
    return store(rows.select("*", *[F.rlike("text", F.lit(p)).alias(f"close{k}") for k, p in CLOSERS.items()]))


def _rest(state: Column) -> tuple[Column, Column]:
    """(whether the token open in that state ends in the piece, what of the piece belongs to it)."""
    ends, tail = F.lit(True), F.lit("")
    for k, pattern in TAILS.items():
        ends = F.when(state == k, F.rlike("text", F.lit(pattern))).otherwise(ends)
        tail = F.when(state == k, F.regexp_extract("text", pattern, 0)).otherwise(tail)
    return ends, F.when(ends, tail).otherwise(F.col("text"))


def _lexed(tail: Column) -> Column:
    """The tokens of the piece behind the tail; the last one may be open."""
    pattern = F.concat(F.lit(HEAD), *[F.when(F.col(f"later{k}"), F.lit(p)).otherwise("") for k, p in OPEN.items()], F.lit(FALLBACK))
    return F.regexp_extract_all(F.substring("text", F.length(tail) + 1, F.length("text")), pattern, F.lit(0))


def _opens(tok: Column) -> Column:
    """Whether the last token of a piece is open: open tokens reach the white space that ends the piece, closed ones end with a
    mark."""
    def goes_on(state: int, mark: str, end: str) -> Column:
        return tok.startswith(mark) & F.col(f"later{state}") & ~tok.endswith(end)

    return tok.startswith("--") | goes_on(SINGLE, "'", "'") | goes_on(DOUBLE, '"', '"') | goes_on(QUOTED, "`", "`") | goes_on(
        BLOCK, "/*", "*/")


def _behind(state: int) -> Column:
    """The state behind a piece that begins in that state. One match goes over the rest of an open token, whole literals and
    comments and the code between them; what it stops at is open."""
    alone = [F.when(F.col(f"later{k}"), F.lit("")).otherwise(f"|{p}") for k, p in ALONE.items()]
    first = TAILS.get(state, "^")
    stop = F.concat(F.lit(f"{first}(?:{OVER}"), *alone, F.lit(")*+(--|/\\*|['\"`])?"))
    after = (F.array_position(F.array(*[F.lit(m) for m in MARKS]), F.call_function("regexp_extract", "text", stop, F.lit(1))) - 1).cast("int")
    return after if state == CODE else F.when(F.rlike("text", F.lit(first)), after).otherwise(state)


def with_first_states(cut: DataFrame) -> DataFrame:
    """Pieces with later1 .. later4 (whether a later piece closes such a token) and the state that they begin in. Only a few
    numbers per piece of a script meet in one task."""
    script = Window.partitionBy("script_id")
    flags = cut.select("script_id", "piece", *[
        (F.max(F.when(F.col(f"close{k}"), F.col("piece"))).over(script) > F.col("piece")).alias(f"later{k}") for k in OPEN])
    flags = store(flags.select("script_id", "piece", *[F.coalesce(f"later{k}", F.lit(False)).alias(f"later{k}") for k in OPEN]))

    # A row of states, the one behind the piece at the place of the one before it.
    maps = cut.join(flags, ["script_id", "piece"]).select(
        "script_id", F.struct("piece", F.array(*[_behind(k) for k in range(6)]).alias("to")).alias("m"))
    ordered = maps.groupBy("script_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    # The states are gathered as digits: a text grows by copying bytes, not rows.
    scan = F.expr("""aggregate(ms, named_struct('state', 0, 'out', ''),
      (a, m) -> named_struct('state', m.to[a.state], 'out', concat(a.out, cast(a.state as string))), a -> a.out)""")
    states = ordered.select("script_id", F.posexplode(F.regexp_extract_all(scan, F.lit("."), F.lit(0))).alias("piece", "state"))
    known = store(states.withColumn("state", F.col("state").cast("int")).join(flags, ["script_id", "piece"]))
    return cut.join(known, ["script_id", "piece"])


def piece_tokens(scripts: DataFrame, size: int = PIECE) -> DataFrame:
    """(script_id, piece, toks, last), stored: the tokens that begin in each piece. The last one is apart in ``last`` if the
    piece leaves it open; what it has in later pieces is put together there."""
    ends, tail = _rest(F.col("state"))
    known = with_first_states(pieces(scripts, size)).select("*", ends.alias("ends"), tail.alias("tail")).withColumn(
        "toks", F.when(F.col("ends"), _lexed(F.col("tail"))).otherwise(F.array().cast("array<string>")))
    known = known.withColumn("end", F.try_element_at("toks", F.lit(-1)))
    known = known.withColumn("opens", F.coalesce(_opens(F.col("end")), F.lit(False)))
    known = store(known.select("script_id", "piece", "state", "tail", "opens", F.when(F.col("opens"), F.col("end")).alias("end"), F.when(
        F.col("opens"), F.slice("toks", F.lit(1), F.size("toks") - 1)).otherwise(F.col("toks")).alias("toks")))
    # The open token of a piece goes on in all that follow up to the first one in which it ends.
    begun = F.max(F.when(F.col("opens"), F.col("piece"))).over(
        Window.partitionBy("script_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    origin = known.where(f"opens OR state <> {CODE}").select("script_id", "piece", "state", "opens", begun.alias("origin"))
    heads = origin.where("opens").select("script_id", "piece", F.col("piece").alias("origin"), F.lit(True).alias("head"))
    rest = origin.where(f"state <> {CODE}").select("script_id", "piece", "origin", F.lit(False).alias("head"))
    parts = heads.unionByName(rest).join(known.select("script_id", "piece", "tail", "end"), ["script_id", "piece"])
    text = F.when(F.col("head"), F.col("end")).otherwise(F.col("tail"))
    spanning = parts.select("script_id", "origin", "piece", text.alias("t")).groupBy("script_id", F.col("origin").alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("piece", "t"))).alias("all"))
    spanning = spanning.select("script_id", "piece", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("last"))
    return store(known.select("script_id", "piece", "toks").join(spanning, ["script_id", "piece"], "left"))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _with_bases(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(script_id, piece) and the sums of the values over all earlier pieces of the script."""
    earlier = Window.partitionBy("script_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("script_id", "piece", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(n) for n, v in values.items()])


def large_tokens(scripts: DataFrame, size: int = PIECE) -> DataFrame:
    """(script_id, pos, tok, kind, u, line, level, stmt_no), as ``tokens.tokens`` gives them, for scripts of which one may be
    as large as a row can be. A window holds the tokens of one piece, or one line per piece of a script.

    A null or empty text has no tokens."""
    rows = piece_tokens(scripts, size)
    text = F.array_join("toks", "")
    names = F.array_join(F.filter("toks", lambda t: t.startswith("`")), "")  # a line break in a quoted name is none of the script
    whole = _newlines(text) - F.when(F.contains(text, F.lit("`")), _newlines(names)).otherwise(0)
    apart = F.when(F.col("last").startswith("`"), 0).otherwise(F.coalesce(_newlines(F.col("last")), F.lit(0)))
    without = lambda mark: F.size("toks") - F.size(F.array_remove("toks", mark))
    totals = store(rows.select(
        "script_id", "piece", (F.size("toks") + F.col("last").isNotNull().cast("int")).alias("n"), (whole + apart).alias("lines"),
        (without("(") - without(")")).alias("step"),
        F.array_join(F.filter("toks", lambda t: t.isin("(", ")", ";")), "").alias("marks")))
    bases = store(_with_bases(totals, {"pos0": F.col("n"), "line0": F.col("lines"), "open0": F.col("step")}).join(
        totals.select("script_id", "piece", "marks"), ["script_id", "piece"]))
    # A statement ends at a semicolon outside all parentheses, and how many are open is known now.
    ended = F.expr("""aggregate(regexp_extract_all(marks, '.', 0), named_struct('open', open0, 'n', 0L), (a, m) -> named_struct(
      'open', a.open + CASE m WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, 'n', a.n + CASE WHEN m = ';' AND a.open = 0 THEN 1 ELSE 0 END),
      a -> a.n)""")
    bases = bases.select("script_id", "piece", "pos0", "line0", "open0", F.when(F.contains("marks", F.lit(";")), ended).otherwise(0).alias("n"))
    stmts = store(_with_bases(bases, {"stmt0": F.col("n")}).join(bases.drop("n"), ["script_id", "piece"]))

    tok = F.col("tok")
    all_toks = F.when(F.col("last").isNull(), F.col("toks")).otherwise(F.array_append("toks", F.col("last")))
    rows = rows.join(stmts, ["script_id", "piece"]).select(
        "script_id", "piece", "pos0", "line0", "open0", "stmt0", F.posexplode(all_toks).alias("idx", "tok")).withColumn("kind", _kind(tok))
    newlines = F.when(F.col("kind") == "newline", 1).when(F.col("kind").isin("string", "block_comment"), _newlines(tok)).otherwise(0)
    step = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)
    inside = Window.partitionBy("script_id", "piece").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda base, value: F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    rows = rows.withColumn("__line", so_far("line0", newlines)).withColumn("__open", so_far("open0", step))
    rows = rows.withColumn("level", F.least(F.col("__open"), F.col("__open") + step).cast("int"))
    rows = rows.withColumn("__ends", so_far("stmt0", F.when((tok == ";") & (F.col("level") == 0), 1).otherwise(0)))
    return rows.select(
        "script_id", (F.col("pos0") + F.col("idx")).cast("int").alias("pos"), "tok", "kind",
        F.when(F.col("kind") == "ident", F.upper(tok)).otherwise(tok).alias("u"), (F.col("__line") + 1).cast("int").alias("line"),
        "level", (F.col("__ends") + 1).cast("int").alias("stmt_no"))
