"""Fixed patterns and word lists for SQL text."""

from __future__ import annotations

# Literals. The repetitions are possessive: Java matches them in a loop, where plain ones recurse per repetition and
# overflow the stack on a literal with thousands of escapes.
_SINGLE = r"'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'"
_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'

# One alternative per token kind. Strings take '' and \x escapes; an unclosed quote is a token of its own.
TOKEN = (
    r"--[^\n]*"
    r"|/\*[\s\S]*?\*/"
    rf"|{_SINGLE}"
    rf"|{_DOUBLE}"
    r"|`[^`]*`"
    r"|\$?\{\w+\}"
    r"|[A-Za-z_][A-Za-z0-9_$]*"
    r"|\d+(?:\.\d+)?"
    r"|<=>|<>|!=|<=|>=|\|\||->"
    r"|\n"
    r"|[^\s]"
)

# Literals are kept (group 1), comments are dropped; the newline after a line comment stays.
STRING_OR_COMMENT = rf"({_SINGLE}|{_DOUBLE}|`[^`]*`)" r"|--[^\n]*" r"|/\*[\s\S]*?\*/"

STRING_BODY = rf"{_SINGLE}|{_DOUBLE}"


def re2(pattern: str) -> str:
    """The pattern without possessive repetition, for engines that never backtrack."""
    return pattern.replace("*+", "*")


# The keywords whose frequency is compared between two versions of a script.
COUNTED_KEYWORDS = (
    "SELECT FROM WHERE JOIN ON AND OR GROUP BY HAVING ORDER UNION INTERSECT EXCEPT CASE WHEN THEN ELSE END OVER "
    "PARTITION WITH AS IN EXISTS BETWEEN LIKE IS NULL"
).split()

# The patterns of the element counts.
ELEMENTS = {
    "n_select": r"\bSELECT\b",
    "n_from": r"\bFROM\b",
    "n_join": r"\b(?:INNER|LEFT|RIGHT|FULL|CROSS)?\s*JOIN\b",
    "n_union": r"\bUNION\b",
    "n_subquery": r"\(\s*SELECT\b",
}

# Syntax classes in order of priority, with the patterns that put a script into them.
SYNTAX_CLASSES = {
    "data_operations": [r"^\s*MERGE\s+INTO\b", r"INSERT\s+OVERWRITE\s+(?:TABLE\s+)?\S+"],
    "set_operations": [r"\bUNION\s+(?:ALL\s+)?\b", r"\bINTERSECT\b", r"\bEXCEPT\b", r"\bMINUS\b"],
    "window_functions": [r"\bOVER\s*\(", r"\bWINDOW\s+\w+\s+AS\b"],
    "advanced_transforms": [r"\bPIVOT\b", r"\bUNPIVOT\b", r"\bLATERAL\s+VIEW\b"],
}

# Words that stand before a parenthesis without being a function.
NOT_FUNCTIONS = (
    "ALL AND ANY AS BETWEEN BY CACHE CASE DISTINCT ELSE EXCEPT EXISTS FROM HAVING IN INSERT INTERSECT INTO JOIN LIKE "
    "MINUS NOT ON OR OVER PARTITION SELECT SETS TABLE THEN UNION USING VALUES VIEW WHEN WHERE"
).split()

# Type names whose parenthesis holds a precision.
TYPE_NAMES = "CHAR DECIMAL NUMERIC VARCHAR".split()
