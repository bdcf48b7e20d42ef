"""Tokens that give advice, found in one fold over the tokens of a script, in Arrow batches.

A token stands in a group: the query parentheses around it (level and number). The state holds the current group of every
level with the part of its query, its last join, its words, and the characters and commas in it. Tokens that may matter are
looked at again at the end of their statement, when what follows them is known."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptmill.functions.sqltext import TOKEN, TYPE_NAMES
from scriptmill.operators.structure import FROM_ENDS
from scriptmill.operators.tokens import is_token_table
from scriptmill.session import shuffle_partitions

# Executors need not have this package; what runs there is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPARISONS = ["=", ">", "<", ">=", "<=", "!=", "<>", "LIKE", "IN"]
# Characters of an IN list that is called long.
LONG_LIST = 100
DATE_PARTS = ["YEAR", "MONTH", "DAY", "TO_DATE", "DATE_FORMAT"]
NO_CALL = ["IN", "AND", "OR", "NOT", "EXISTS", "WHERE", "ON", "WHEN", "THEN", "ELSE", "BETWEEN", "LIKE", "SELECT", "AS", "OVER",
           "VALUES", "USING", "FROM", "JOIN", "BY", "ANY", "ALL", "SOME", "INTERVAL", "CASE"]

# Classes like \s and \w hold ASCII only, as in the engine's own patterns.
_TOKENS = re.compile(TOKEN, re.ASCII)
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_LITERAL = frozenset("'\"0123456789")
_PARTS = frozenset(["JOIN", "ON", "USING", *FROM_ENDS])
_OUTER = frozenset(["SELECT", "FROM", "WHERE", "ON", "HAVING", "GROUP", "ORDER"])
_CHANGING = _PARTS | _OUTER
_NOT_CALLED = frozenset([*NO_CALL, *TYPE_NAMES])
_COMPARED, _DATES = frozenset(COMPARISONS), frozenset(DATE_PARTS)


class _Group:
    __slots__ = ("lv", "grp", "part", "selects", "join", "words", "chars", "commas")

    def __init__(self, lv: int, grp: int):
        self.lv, self.grp, self.part, self.selects, self.join, self.words, self.chars, self.commas = lv, grp, "", False, None, [], 0, 0


def _statement(no: int, toks: list[str], words: list[str], names: list[bool], levels: list[int]) -> Iterator[tuple]:
    """(stmt_no, lv, grp, u, pos, tok2, commas, is_call, is_choice, is_nested, is_list, entries) of the tokens of a statement
    that matter; an entry is (rule, text before, name, text behind)."""
    # Every kind of advice needs one of these.
    if not ("(" in toks or "*" in toks or "OR" in words or "LEFT" in words):
        return
    n = len(toks)
    at = lambda i: words[i] if 0 <= i < n else None
    groups: dict[int, _Group] = {}
    outer: dict[int, str] = {}
    seen = []  # tokens that may matter, with what is known in front of them
    for i, (t, u, name, level) in enumerate(zip(toks, words, names, levels)):
        if t == "(":
            level += 1
            g = groups.get(level)
            g = groups[level] = _Group(level, g.grp + 1 if g else 1)
            if i and words[i - 1] == "IN":
                seen.append((i, g, 0, "", None, None))
        else:
            g = groups.get(level)
            if g is None:
                g = groups[level] = _Group(level, 0)
            g.chars += len(t) + 1
            if t == ",":
                g.commas += 1
        g.words.append(u)
        if not name:
            continue
        scalar = None
        if u in _CHANGING:
            if u == "SELECT" and i and words[i - 1] == "(":
                scalar = outer.get(levels[i - 1])
            if not i or words[i - 1] != ".":
                g.selects = g.selects or u == "SELECT"
                if u == "FROM":
                    distinct = i > 1 and words[i - 1] == "DISTINCT" and words[i - 2] in ("IS", "NOT")
                    if not distinct and (g.selects or level == 0):
                        g.part = "FROM"
                elif u in _PARTS:
                    g.part = u
            if u == "JOIN":
                before, two, after = at(i - 1), at(i - 2), at(i + 2)
                g.join = (before == "LEFT" or (before == "OUTER" and two == "LEFT"), at(i + 1), at(i + 3) if after == "AS" else after if after != "ON" else None)
            if u in _OUTER:
                outer[level] = u
        if (i + 1 < n and words[i + 1] in ("(", "=")) or u in ("SELECT", "AND"):
            seen.append((i, g, len(g.words), g.part, g.join, scalar))

    for i, g, behind, part, join, scalar in seen:
        t, u, n1, n2, n3 = toks[i], words[i], at(i + 1), at(i + 2), at(i + 3)
        p1, p2 = at(i - 1) or "", at(i - 2) or ""
        tok2 = toks[i + 2] if i + 2 < n else None
        entries: list[tuple] = []
        call = choice = nested = listed = given = False
        if t == "(":
            listed = n1 is not None and n1 != "SELECT" and g.chars >= LONG_LIST
        elif u == "SELECT":
            if n1 == "*" and n2 == "FROM" and n3 is not None and n3 != "(":
                entries.append(("SELECT_STAR", "list the columns of ", _dotted(n3, at(i + 4), at(i + 5)), ""))
            if p1 == "(":
                nested = p2 != "AS"
                if scalar == "SELECT":
                    entries.append(("SUBQUERY_IN_SELECT", "join or window instead of a subquery per row", "", ""))
        elif u == "AND":
            if part == "ON" and join and join[0] and n2 == "." and join[1] is not None and n1 != join[1] and n1 != (join[2] or ""):
                entries.append(("LEFT_JOIN_WHERE_FILTER", "move the condition on ", n1, " to WHERE"))
        if t != "(" and n1 == "(":
            if u == "COUNT" and n2 == "DISTINCT":
                given = True
                if n3 is not None:
                    entries.append(("COUNT_DISTINCT", "approx_count_distinct(", _dotted(n3, at(i + 4), at(i + 5)), ")"))
            elif u == "IN" and n2 == "SELECT":
                entries.append(("NOT_IN_SUBQUERY", "left anti join on ", p2, " if no value is NULL") if p1 == "NOT" else (
                    "IN_SUBQUERY", "left semi join on ", p1, ""))
            call = part == "WHERE" and u not in _NOT_CALLED
            if call:
                next1, next2 = (g.words[behind : behind + 2] + ["", ""])[:2]
                if next1 == ")" and next2 in _COMPARED:
                    entries.append(("WHERE_FUNCTION", "compare the column itself instead of ", u, "(...)"))
                    if u in _DATES and next2 == "=":
                        entries.append(("PARTITION_PRUNING", "give a range of the partition column instead of ", u, "(...)"))
        elif t != "(" and n1 == "=" and tok2 is not None and tok2[0] in _LITERAL:
            choice = (n3 == "OR" and at(i + 4) == u and at(i + 5) == "=" and i + 6 < n and toks[i + 6][0] in _LITERAL) or (
                p1 == "OR" and at(i - 3) == "=" and at(i - 4) == u and p2[:1] in _LITERAL)
        if entries or call or choice or nested or listed or given:
            yield no, g.lv, g.grp, u, i, tok2, g.commas, call, choice, nested, listed, entries


def _dotted(name: str, point: str | None, second: str | None) -> str:
    return f"{name}.{second}" if point == "." and second is not None else name


def _marks(toks: list[str]) -> Iterator[tuple]:
    """The tokens of one script that matter (``_statement``)."""
    depth, no = 0, 1
    kept: tuple[list, list, list, list] = ([], [], [], [])
    for t in toks:
        first = t[0]
        if t == "\n" or (first == "-" and t[:2] == "--") or (first == "/" and t[:2] == "/*"):
            continue
        level = depth
        if t == "(":
            depth += 1
        elif t == ")":
            level = depth = depth - 1
        elif t == ";" and depth == 0:
            yield from _statement(no, *kept)
            no, kept = no + 1, ([], [], [], [])
            continue
        name = first in _LETTERS or (first == "`" and len(t) > 1)
        kept[0].append(t)
        kept[1].append(t.upper() if name else t)
        kept[2].append(name)
        kept[3].append(level)
    yield from _statement(no, *kept)


ENTRY = {"rule": pa.string(), "before": pa.string(), "name": pa.string(), "behind": pa.string()}
COLUMNS = {"stmt_no": pa.int32(), "lv": pa.int32(), "grp": pa.int64(), "u": pa.string(), "pos": pa.int32(), "tok2": pa.string(), "commas": pa.int64(),
           "is_call": pa.bool_(), "is_choice": pa.bool_(), "is_nested": pa.bool_(), "is_list": pa.bool_()}
MARKED = ("stmt_no int, lv int, grp long, u string, pos int, tok2 string, commas long, is_call boolean, is_choice boolean, "
          "is_nested boolean, is_list boolean, entries array<struct<rule:string,before:string,name:string,behind:string>>")


def _together(texts: list[list[str]]) -> list[str]:
    """The tokens of all texts in the order of their places."""
    if len(texts) == 1:
        return texts[0]
    return [t for _, _, t in sorted((i, k, t) for k, toks in enumerate(sorted(texts)) for i, t in enumerate(toks))]


def marked_tokens(scripts: DataFrame) -> DataFrame:
    """One row per token that matters to any kind of advice: (script_id, stmt_no, lv, grp, u, pos, tok2, commas, is_call,
    is_choice, is_nested, is_list, entries). Texts of one id count as one script, as in the token tables."""
    # The number of partitions is given, since AQE would merge them by the bytes of the texts.
    rows = scripts.repartition(shuffle_partitions(scripts.sparkSession), "script_id").groupBy("script_id")
    whole = is_token_table(scripts)
    if whole:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"])
    else:
        texts = F.collect_list(F.col("sql").cast("string"))
    rows = rows.agg(texts.alias("texts"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            found: list[tuple] = []
            for k, texts in enumerate(batch["texts"].to_pylist()):
                new = list(_marks(texts if whole else _together([_TOKENS.findall(t) for t in texts]))) if texts else []
                owner += [k] * len(new)
                found += new
            columns = list(zip(*found)) if found else [()] * (len(COLUMNS) + 1)
            flat = [e for entries in columns[-1] for e in entries]
            starts = [0]
            for entries in columns[-1]:
                starts.append(starts[-1] + len(entries))
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [()] * 4, ENTRY.values())], list(ENTRY))
            entries = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch["script_id"].take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, COLUMNS.values())], entries],
                ["script_id", *COLUMNS, "entries"])

    return rows.mapInArrow(fold, StructType([scripts.schema["script_id"], *StructType.fromDDL(MARKED)]))
