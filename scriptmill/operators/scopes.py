"""Names in the scope where they are used: which tables a statement reads and writes, with WITH queries resolved.

One fold over the tokens of a script, in Arrow batches where it was read; nothing is shuffled but the text. The state holds
the open parentheses as a stack of query scopes and the WITH queries that can be seen from the current token."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptmill.functions.sqltext import TOKEN
from scriptmill.operators.tokens import is_token_table, text_of

# Executors need not have this package; what runs there is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PART = r"(?:`[^`]*`|[A-Za-z_][A-Za-z0-9_$]*)"
# As TOKEN, but a name is one token with all its parts.
NAMED_TOKEN = TOKEN.replace(r"|`[^`]*`", "").replace(r"|[A-Za-z_][A-Za-z0-9_$]*", rf"|{_PART}(?:\s*\.\s*{_PART})*+")

# Words behind which names are no longer tables of the FROM clause.
ENDS = ["WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "SELECT", "LATERAL", "WINDOW", "SET", "VALUES", "WHEN", "DISTRIBUTE",
        "CLUSTER", "SORT", "UNION", "INTERSECT", "EXCEPT", "MINUS"]
NO_NAMES = ["SELECT", "IF", "TABLE", "LATERAL", "VALUES", "ONLY"]

# Steps of a WITH list.
NONE, NAME, NAMED, COLUMNS, AS, BODY, DONE = range(7)
# Words that change the scope, and words behind which the name of a table may stand.
WORDS = ["FROM", "JOIN", "ON", "USING", "WITH", *ENDS]
BEFORE_NAMES = ["INTO", "OVERWRITE", "TABLE", "EXISTS", "UPDATE", "FROM", "JOIN", "USING"]
# Tokens that change the state wherever they stand.
CHANGING = frozenset(["(", ")", ",", ";", *WORDS, *BEFORE_NAMES])
PARTS = frozenset(["JOIN", "ON", "USING", *ENDS])
BEFORE, NOT_NAMED = frozenset(BEFORE_NAMES), frozenset(NO_NAMES)
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")

# Classes like \s and \w hold ASCII only, as in the engine's own patterns.
_TOKENS = re.compile(NAMED_TOKEN, re.ASCII)
_POINT = re.compile(r"\s*\.\s*(?=(?:[^`]*`[^`]*`)*[^`]*$)", re.ASCII)


def _full(t: str) -> str:
    return (_POINT.sub(".", t).replace("`", "") if "." in t or "`" in t else t).lower()


def _places(sql: str) -> list[tuple[int, str, str, bool]]:
    """(stmt_no, table_name, access, is_with) of the places in one script, in text order.

    A scope is what is known inside one pair of parentheses: the part of the query, whether a SELECT was seen, how far a WITH
    list has come, the name it defines and whether it is recursive, and whether the parentheses hold the body of a WITH query."""
    toks = [t for t in _TOKENS.findall(sql) if t != "\n" and t[:2] != "--" and (t[:2] != "/*" or len(t) < 4)]
    refs: list[tuple[int, str, str, bool]] = []
    stmt, p1, p2, u1, from_, busy = 1, "", "", "", False, False
    part, sel, step, pend, rec, body = "", False, NONE, "", False, False
    stack: list[tuple] = []
    defs: list[tuple[str, int, bool]] = []  # name, number of open parentheses, whether it is seen
    for i, t in enumerate(toks):
        name = t[0] in LETTERS or (t[0] == "`" and len(t) > 1)
        u = t.upper() if name else t
        # Most tokens stand where no name is expected and change nothing.
        if not busy and u not in CHANGING:
            from_ = False
        elif t == "(":
            if step == AS:  # a WITH query is seen from the end of its body on, a recursive one from its beginning
                defs.append((pend, len(stack), rec))
            stack.append((part, sel, COLUMNS if step == NAMED else BODY if step == AS else NONE, pend, rec, body))
            part, sel, step, pend, rec, body, from_, busy = "", False, NONE, "", False, step == AS, False, False
        elif t == ")" and stack:
            depth, was_body = len(stack), body
            if defs:  # up to the end of its scope
                defs = [(n, d, s or (was_body and d == depth - 1)) for n, d, s in defs if d < depth]
            part, sel, step, pend, rec, body = stack.pop()
            step = DONE if was_body else NAMED if step == COLUMNS else NONE
            from_, busy = False, step != NONE
        elif t == ";" and not stack:
            stmt, p1, p2, u1, from_, busy, defs = stmt + 1, "", "", "", False, False, []
            part, sel, step, pend, rec, body = "", False, NONE, "", False, False
            continue
        else:
            top = not stack
            if name and u not in NOT_NAMED:
                writes = ((p1 in ("INTO", "OVERWRITE", "TABLE") and top) or (p1 == "EXISTS" and u1 in ("CREATE", "DROP") and top)
                          or (p1 == "UPDATE" and u1 == "UPDATE") or (p1 == "FROM" and u1 == "DELETE" and top))
                reads = ((p1 == "FROM" and from_) or p1 == "JOIN" or (p1 == "," and part in ("FROM", "JOIN", "ON"))
                         or (p1 == "USING" and u1 == "MERGE" and top)) and toks[i + 1 : i + 2] != ["("]
                if writes or reads:
                    full = _full(t)
                    refs.append((stmt, full, "write" if writes else "read", any(n == full and s for n, _, s in defs)))
            from_ = u == "FROM" and (sel or top) and not (p1 == "DISTINCT" and p2 in ("IS", "NOT"))
            again = step == NAME and u == "RECURSIVE"
            rec = u != "WITH" and (rec or again)
            if name and step == NAME and not again:
                pend, step = _full(t), NAME if u == "WITH" else NAMED
            elif u == "WITH" or again or (step == DONE and t == ","):
                step = NAME
            else:
                step = AS if step == NAMED and u == "AS" else NONE
            part = "FROM" if from_ else u if u in PARTS else part
            sel = sel or u == "SELECT"
            busy = u in BEFORE or t == "," or step != NONE
        p1, p2, u1 = u, p1, u1 or u
    return refs


TYPES = {"stmt_no": pa.int32(), "table_name": pa.string(), "access": pa.string(), "is_with": pa.bool_()}
REFS = "refs array<struct<stmt_no:int,table_name:string,access:string,is_with:boolean>>"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat: list[tuple[int, str, str, bool]] = []
        starts: list[int | None] = []
        for sql in batch["sql"].to_pylist():
            starts.append(None if sql is None else len(flat))  # a null start makes a null list
            flat += _places(sql) if sql is not None else []
        columns = zip(*flat) if flat else [()] * len(TYPES)
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES.values())], list(TYPES))
        refs = pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch["script_id"], refs], ["script_id", "refs"])


def resolved_names(scripts: DataFrame) -> DataFrame:
    """(script_id, refs): for every place where a statement names a table its number, the name (lower case, all parts, no
    quotes), read or write, and whether the name stands for a WITH query there. A WITH query is seen in the queries of its
    list behind it, in the query of the list and in everything inside; an inner one hides an outer one, and a table of the
    same name elsewhere in the statement is a table. The body of a query does not see its own name unless it is RECURSIVE.

    A null text has no names; unclosed parentheses are closed by the end of the script. What stands behind FROM in a
    function call is no table."""
    if is_token_table(scripts):
        code = scripts.where(~F.col("kind").isin("newline", "line_comment", "block_comment"))
        scripts = code.groupBy("script_id").agg(text_of().alias("sql"))
    rows = scripts.select("script_id", F.col("sql").cast("string").alias("sql"))
    schema = StructType([rows.schema["script_id"], *StructType.fromDDL(REFS)])
    return rows.mapInArrow(_fold, schema)


def names_table(place: Column) -> Column:
    """Whether an entry of ``refs`` names a table, not a WITH query."""
    return (place["access"] == "write") | ~place["is_with"]


def table_refs(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, table_name, access), access read or write, each once per statement; WITH queries are left out
    where their name is seen (``resolved_names``)."""
    tables = F.array_distinct(F.transform(F.filter("refs", names_table), lambda r: F.struct(r["stmt_no"], r["table_name"], r["access"])))
    return resolved_names(scripts).select("script_id", F.explode(tables).alias("r")).select("script_id", "r.*")


def name_places(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, table_name, access, n_places, n_with): how often a statement names a table, and how many of these
    places stand for a WITH query."""
    places = resolved_names(scripts).select("script_id", F.explode("refs").alias("r")).select("script_id", "r.*")
    return places.groupBy("script_id", "stmt_no", "table_name", "access").agg(
        F.count(F.lit(1)).alias("n_places"), F.count_if("is_with").alias("n_with"))
