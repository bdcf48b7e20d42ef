"""The rule catalogue: fixed values that decide which findings appear."""

from __future__ import annotations

# Rule name, severity, pattern, message, suggestion.
# Patterns are searched without regard to case, ^ and $ match at lines, and . stops at a newline.
RULES: list[tuple[str, str, str, str, str]] = [
    ("SELECT_STAR", "HIGH", r"SELECT\s+\*",
     "SELECT * reads and ships every column",
     "name the columns that are needed"),
    ("LIKE_LEADING_WILDCARD", "HIGH", r"LIKE\s+['\"]%",
     "LIKE with a leading wildcard compares every value",
     "look words up in a token table, or anchor the pattern"),
    ("CROSS_JOIN", "HIGH", r"CROSS\s+JOIN",
     "the join multiplies both sides",
     "check whether a join condition is missing"),
    ("IMPLICIT_CAST", "MEDIUM", r"CAST\s*\(",
     "the statement converts types",
     "store the column in the type it is used in"),
    ("OR_IN_WHERE", "MEDIUM", r"WHERE.*OR.*OR",
     "several OR conditions in one WHERE",
     "use an IN list, or UNION ALL of disjoint branches"),
    ("HAVING_WHERE", "MEDIUM", r"HAVING\s",
     "HAVING filters after the grouping",
     "move conditions on grouping keys to WHERE"),
    ("DISTINCT_ORDER_BY", "LOW", r"DISTINCT.*ORDER\s+BY",
     "DISTINCT and ORDER BY shuffle twice",
     "check whether the order is needed, or aggregate instead"),
    ("HARDCODED_DATE", "LOW", r"DATE\s*[=<>]\s*['\"]\d{4}-\d{2}-\d{2}",
     "a date is written into the script",
     "pass the date as a parameter such as ${date_var}"),
    ("LIMIT_MISSING", "LOW", r"ORDER\s+BY.*(?!LIMIT)",
     "a global sort may return everything",
     "add LIMIT where only the first rows are read"),
    ("JOIN_NO_CONDITION", "HIGH", r"JOIN\s+\w+\s+(?!ON|USING)",
     "no ON directly after the joined table",
     "check that the join has a condition"),
    ("COUNT_DISTINCT_LARGE", "MEDIUM", r"COUNT\s*\(\s*DISTINCT",
     "COUNT(DISTINCT) can be skewed",
     "use approx_count_distinct where an estimate is enough"),
    ("IN_SUBQUERY", "HIGH", r"\bIN\s*\(\s*SELECT\b",
     "IN over a subquery",
     "write a LEFT SEMI JOIN"),
    ("NOT_IN_SUBQUERY", "HIGH", r"\bNOT\s+IN\s*\(\s*SELECT\b",
     "NOT IN over a subquery returns nothing once it holds a NULL",
     "write a LEFT ANTI JOIN"),
    ("IN_VALUES_LONG", "MEDIUM", r"\bIN\s*\([^)]{100,}\)",
     "a long IN list makes a large plan",
     "put the values into a table and join it"),
    ("WHERE_FUNCTION", "MEDIUM",
     r"\bWHERE\s+[^'\"]*?\b[a-z_][a-z0-9_]*\s*\([^)]+\)\s*(=|<>|>|<|>=|<=)",
     "a function call is compared in WHERE",
     "compare the bare column with a range"),
    ("PARTITION_PRUNING", "HIGH",
     r"\bWHERE\s+[^'\"]*?\b(YEAR|MONTH|DAY|TO_DATE|DATE_FORMAT)\s*\([^)]+\)\s*=",
     "a date function in WHERE can keep the scan from skipping files",
     "filter the partition column by a half-open range"),
    ("SUBQUERY_IN_SELECT", "MEDIUM", r"\bSELECT\s+.*\(\s*SELECT\b",
     "a scalar subquery in the select list",
     "join an aggregate, or use a window"),
    ("SUBQUERY_DEEP", "MEDIUM", r"\bWHERE\s+.*\(\s*SELECT|\bIN\s*\(\s*SELECT|\bEXISTS\s*\(\s*SELECT",
     "nested subqueries",
     "name them in a WITH clause"),
    ("COUNT_DISTINCT", "MEDIUM", r"\bCOUNT\s*\(\s*DISTINCT\b",
     "COUNT(DISTINCT) shuffles every value",
     "estimate, or group in two phases"),
    ("UDF_IN_WHERE", "HIGH", r"\bWHERE\s+.*?\b[a-z_]+[a-z0-9_]*\s*\(",
     "a call in WHERE may be a user function that stops pushdown",
     "use built-in functions"),
    ("LEFT_JOIN_WHERE_FILTER", "HIGH", r"\bLEFT\s+(?:OUTER\s+)?JOIN\b.*?\bON\b.*?\bAND\b",
     "a filter in the ON of a left join keeps all left rows",
     "filters on the left table belong in WHERE"),
    ("TABLE_NAME_WITH_DATE", "HIGH",
     r"\b(?:FROM|JOIN|TABLE|INSERT\s+INTO|UPDATE|CREATE\s+TABLE)\s+(?:\w+\.)?\w*[12]\d{3}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\w*",
     "a date is part of a table name",
     "use one table with a date partition"),
    ("COMMENT_WITH_SEMICOLON", "HIGH", r"--[^;\n]*;",
     "a semicolon inside a line comment",
     "remove it, naive splitters cut the script there"),
    ("SENSITIVE_INFO_DETECTED", "HIGH",
     r"\b1[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"
     r"|(?:身份证|证件号|id_card|idcard|identity|sfz)",
     "an identity number or a column for one",
     "mask or hash the values"),
]

# Texts that every match of a rule holds, in lower case; a rule that is not named has none.
LITERALS: dict[str, tuple[str, ...]] = {
    "SELECT_STAR": ("select", "*"),
    "LIKE_LEADING_WILDCARD": ("like", "%"),
    "CROSS_JOIN": ("cross", "join"),
    "IMPLICIT_CAST": ("cast", "("),
    "OR_IN_WHERE": ("where", "or"),
    "HAVING_WHERE": ("having",),
    "DISTINCT_ORDER_BY": ("distinct", "order"),
    "HARDCODED_DATE": ("date", "-"),
    "LIMIT_MISSING": ("order", "by"),
    "JOIN_NO_CONDITION": ("join",),
    "COUNT_DISTINCT_LARGE": ("count", "distinct"),
    "IN_SUBQUERY": ("in", "(", "select"),
    "NOT_IN_SUBQUERY": ("not", "in", "(", "select"),
    "IN_VALUES_LONG": ("in", "(", ")"),
    "WHERE_FUNCTION": ("where", "(", ")"),
    "PARTITION_PRUNING": ("where", "(", ")", "="),
    "SUBQUERY_IN_SELECT": ("select", "("),
    "SUBQUERY_DEEP": ("select", "("),
    "COUNT_DISTINCT": ("count", "distinct"),
    "UDF_IN_WHERE": ("where", "("),
    "LEFT_JOIN_WHERE_FILTER": ("left", "join", "on", "and"),
    "COMMENT_WITH_SEMICOLON": ("--", ";"),
}

# The identity number as it is really issued (a six-digit area code before the year).
STRICT_ID_NUMBER = r"\b[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"

# Java: MULTILINE, CASE_INSENSITIVE, UNIX_LINES and Unicode classes, the meaning the patterns are written for.
JAVA_FLAGS = "(?imdU)"
# They find the same in a text that is ASCII only, at half the cost.
ASCII_FLAGS = "(?imd)"

# RE2 has no look-ahead; these two patterns accept the same texts.
_RE2_FORMS = {
    "LIMIT_MISSING": r"ORDER\s+BY",
    "JOIN_NO_CONDITION": (
        r"JOIN\s+\w+(?:\s+(?:[^OoUu\s]|[Oo](?:[^Nn]|$)"
        r"|[Uu](?:[^Ss]|$|[Ss](?:[^Ii]|$|[Ii](?:[^Nn]|$|[Nn](?:[^Gg]|$)))))|\s\s+|\s$)"
    ),
}


def re2_pattern(rule: str) -> str:
    for name, _, pattern, _, _ in RULES:
        if name == rule:
            return _RE2_FORMS.get(rule, pattern)
    raise KeyError(rule)
