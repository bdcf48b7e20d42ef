"""The rules against Python's re on hand-made scripts, and the edge cases of the text operators."""

import re

import pytest
from pyspark.sql import functions as F

from scriptmill.functions.rules import RULES, STRICT_ID_NUMBER
from scriptmill.functions.sqltext import ELEMENTS
from scriptmill.operators import integrity, lint, scopes, structure, textual, tokens

SAMPLES = [
    "", "   \n\t ", "-- only a comment", "select 'unclosed", "select (a", "select 'it''s'; select 2",
    "select 'a\\'b;c' from t; select 3", "select '-- no; comment' from t -- yes; this\nwhere 1 = 1",
    "SELECT  *\r\nFROM t\r\nWHERE a LIKE \"%x\"", "select t.* from t cross  join u", "select CAST (a as int)",
    "where a = 1 or b = 2 or c = 3", "select store from order_t where x = 1 order by y",
    "having\ncount(1) > 2", "select distinct a,b from t order   by a", "where load_date='2024-01-02'",
    "where load_date >= '2024-01-02'", "select a from t join db.u on 1=1", "select a from t join u  on t.a=u.a",
    "select a from t join u on t.a=u.a", "join u using (a)", "join u x", "join u\n", "count ( distinct x)",
    "x not in ( select 1)", "x in (" + "1," * 60 + "2)", "where f(a) >= 3", "where a = 'x' and f(a) = 3",
    "where year(dt)\n = 2024", "select a, (select 1)", "where exists (select 1)", "where my_udf (a) > 1",
    "left outer join u on a=b and c=d", "left join u on a=b\nand c=d", "from db.t_20240131_x", "from t_20241331",
    "create table if not exists t_20240101", "insert into t_20240101 select 1", "-- a;b", "id_card", "身份证号",
    "where 中文(a) = 1", "select a 中文from t_20240101", "112345619900101123X", "11010119900101123X", "order by a limit 3",
    "merge into t using s on 1=1 when matched then delete",
]


@pytest.fixture(scope="module")
def scripts(spark):
    return spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(SAMPLES)], "script_id long, path string, sql string")


def test_first_match_and_line(scripts):
    got = {(r.script_id, r.rule): r.line for r in lint.findings(scripts).collect()}
    want = {}
    for i, s in enumerate(SAMPLES):
        for name, _, pattern, _, _ in RULES:
            m = re.search(pattern, s, re.IGNORECASE | re.MULTILINE)
            if m:
                want[i, name] = s[: m.start()].count("\n") + 1
    assert got == want
    assert {rule for _, rule in got} == {r[0] for r in RULES}


def test_number_of_matches(scripts):
    got = {(r.script_id, r.rule): r.n_matches for r in lint.all_matches(scripts).collect()}
    want = {
        (i, name): n
        for i, s in enumerate(SAMPLES)
        for name, _, p, _, _ in RULES
        if (n := sum(1 for _ in re.finditer(p, s, re.IGNORECASE | re.MULTILINE)))
    }
    assert got == want


def test_counters_keep_every_script(scripts):
    counted = lint.severity_counters(scripts).collect()
    assert len(counted) == len(SAMPLES)
    assert all(r.issue_count == r.high_priority + r.medium_priority + r.low_priority for r in counted)
    nested = {r.script_id: r.issue_count for r in lint.report(scripts).collect()}
    assert nested == {r.script_id: r.issue_count for r in counted}


def test_strict_number(scripts):
    got = {r.script_id for r in lint.findings_outside_literals(scripts).where("rule = 'SENSITIVE_INFO_DETECTED'").collect()}
    strict = {i for i, s in enumerate(SAMPLES) if re.search(STRICT_ID_NUMBER, s)}
    assert strict and strict <= got


def test_literals_do_not_fire(spark):
    df = spark.createDataFrame([(1, "p", "select a from t where s = 'cross join' -- SELECT * ;\n")],
                               "script_id long, path string, sql string")
    assert lint.findings(df).where("rule in ('CROSS_JOIN', 'SELECT_STAR')").count() == 2
    assert lint.findings_outside_literals(df).count() == 0


def test_statements(scripts):
    got = {}
    for r in tokens.statements(scripts).collect():
        got.setdefault(r.script_id, []).append(r.text_norm)
    assert 0 not in got and 1 not in got and 2 not in got
    assert got[3] == ["SELECT ' UNCLOSED"]
    assert got[5] == ["SELECT 'it''s'", "SELECT 2"]
    assert got[6] == ["SELECT 'a\\'b;c' FROM T", "SELECT 3"]
    assert got[7] == ["SELECT '-- no; comment' FROM T WHERE 1 = 1"]


def test_unbalanced(scripts):
    bad = {r.script_id for r in tokens.paren_balance(scripts).where("is_unbalanced").collect()}
    assert bad == {4}


def test_comments(scripts):
    got = {(r.script_id, r.kind, r.content) for r in tokens.comments(scripts).collect()}
    assert (2, "line", "only a comment") in got and (7, "line", "yes; this") in got
    assert not any("no; comment" in c for _, _, c in got)


def test_classes(spark):
    cases = {
        "": [], "  ": [], "select 1": ["basic"], "-- union\nselect 1": ["basic"],
        "merge into t using s on a=b when matched then delete": ["data_operations"],
        "insert overwrite table t select * from a union all select * from b": ["data_operations", "set_operations"],
        "select sum(a) over (partition by b) from t minus select 1": ["set_operations", "window_functions"],
        "select * from t lateral view explode(a) x as y": ["advanced_transforms"],
        "select * from t window w as (order by a)": ["window_functions"], "/* pivot */ select '/' from t": ["basic"],
    }
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "script_id long, sql string")
    got = {r.script_id: r for r in textual.syntax_classes(df).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i].classes == want
        assert got[i].primary_class == (want[0] if want else "basic")


def test_statement_kinds(spark):
    cases = {
        "/* c */ drop table t": "DROP", "drop database d": "DROP DATABASE", "create temporary view v as select 1": "CREATE VIEW",
        "create table t as select 1": "CREATE TABLE AS SELECT", "create table t (a int)": "CREATE TABLE",
        "alter table t add column a int": "ALTER", "insert into t partition (dt='1') select 1": "INSERT PARTITION",
        "insert into t select sum(a) over (partition by b) from u": "INSERT", "desc t": "DESCRIBE", "cache table t as select 1": "CACHE",
        "with a as (select 1) select * from a": "WITH", "explain select 1": "EXPLAIN", "foo": "OTHER",
    }
    df = spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(cases)], "script_id long, path string, sql string")
    got = {r.script_id: r.kind for r in structure.statement_kinds(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_join_on_follows_nested_join(spark):
    df = spark.createDataFrame(
        [(1, "p", "select * from a join (select x from b join c on b.k = c.k) s on a.k = s.k left semi join d")],
        "script_id long, path string, sql string")
    got = {(r.level, r.join_no): (r.join_type, r.table_name, r.has_condition) for r in structure.joins(df).collect()}
    assert got == {(0, 1): ("INNER", "(subquery)", 1), (0, 2): ("LEFT SEMI", "d", 0), (1, 1): ("INNER", "c", 1)}


def test_long_string_literal(spark):
    """A literal of many kilobytes neither overflows the matcher nor is cut."""
    text = "select '" + "x" * 300_000 + "' from t; /* " + "y" * 300_000 + " */ select 1"
    df = spark.createDataFrame([(1, "p", text)], "script_id long, path string, sql string")
    assert tokens.statements(df).count() == 2
    assert len(lint.all_matches(df).collect()) == 0
    code = df.select(F.length(lint.without_comments(F.col("sql"))).alias("n")).first().n
    assert code == len("select '" + "x" * 300_000 + "' from t;  select 1")


def test_many_escapes_in_one_literal(spark):
    text = "select '" + "a''b\\'c" * 2000 + "' from t; select 1"
    df = spark.createDataFrame([(1, "p", text)], "script_id long, path string, sql string")
    assert tokens.statements(df).count() == 2


def corpus(spark, cases):
    return spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(cases)], "script_id long, path string, sql string")


def test_advice_of_every_kind(spark):
    cases = {
        "select * from db.t where status = 'A' or status = 'B' or x.y = 3 or status = 'C'":
            [("OR_IN_WHERE", "status IN ('A', 'B')"), ("SELECT_STAR", "list the columns of db.t")],
        "select a from t where status = 'A' or status = 'B' or status = 'C'": [("OR_IN_WHERE", "status IN ('A', 'B', 'C')")],
        "select a from t where a = 1 or b = 2 or c = 3": [],
        "select a from t where k in (select k from u)": [("IN_SUBQUERY", "left semi join on k")],
        "select a from t where t.j not in (select j from v)": [("NOT_IN_SUBQUERY", "left anti join on j if no value is NULL")],
        "select a from t where year(dt) = 1996": [
            ("PARTITION_PRUNING", "give a range of the partition column instead of year(...)"),
            ("WHERE_FUNCTION", "compare the column itself instead of year(...)")],
        "select f_a(x), year(d) from t where my_fn(x) > 2 and a in (1, 2) -- and other(x) = 1": [
            ("UDF_IN_WHERE", "built-in functions instead of my_fn"), ("WHERE_FUNCTION", "compare the column itself instead of my_fn(...)")],
        "select a, (select max(b) from u) from t": [("SUBQUERY_IN_SELECT", "join or window instead of a subquery per row")],
        "select count(distinct x.id) from t": [("COUNT_DISTINCT", "approx_count_distinct(x.id)")],
        "select a from t left join u b on t.k = b.k and t.f = 1": [("LEFT_JOIN_WHERE_FILTER", "move the condition on t to WHERE")],
        "select a from t left join u b on t.k = b.k and b.f = 1": [],
        "select a from t left outer join u on t.k = u.k and u.f = 1": [],
        "select a from t where a in (" + ", ".join(str(1000 + i) for i in range(40)) + ")": [("IN_VALUES_LONG", "join a table of the 40 values")],
        "select a from (select a from t) x join (select a from u) y on x.a = y.a": [("SUBQUERY_DEEP", "name the 2 subqueries in a WITH clause")],
        "with x as (select a from t), y as (select a from u) select a from x": [],
        "select a from log_20240131": [("TABLE_NAME_WITH_DATE", "partition log by dt")],
        "select 'where f(x) = 1 or a = 1 or a = 2' from t": [],
    }
    got = {}
    for r in lint.advice_rows(corpus(spark, cases)).collect():
        got.setdefault(r.script_id, []).append((r.rule, r.advice))
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == [sorted(v) for v in cases.values()]


def test_table_refs(spark):
    cases = {
        "select 1 from t x, db.u y join cat.db.v z on x.a = z.a, w": "r:cat.db.v r:db.u r:t r:w",
        "select 1 from t where extract(year from dt) = 1 and a is distinct from b and trim(both ' ' from c) = ''": "r:t",
        "with q as (select * from base), r as (select 1 from q) insert into table out_t select * from r, q": "r:base w:out_t",
        "delete from old where k in (select k from gone)": "r:gone w:old",
        "merge into t using s on t.a = s.a when matched then delete": "r:s w:t",
        "update cust set v = 1": "w:cust", "drop table if exists a.b": "w:a.b", "select 1 from range(10)": "",
        "select a from b semi join c on b.x = c.x anti join d": "r:b r:c r:d",
        "select a from t lateral view explode(l) e as x, y": "r:t",
        "select a, b from (select c, d from t) s, u": "r:t r:u",
    }
    got = {}
    for r in scopes.table_refs(corpus(spark, cases)).collect():
        got.setdefault(r.script_id, []).append(f"{r.access[0]}:{r.table_name}")
    assert [" ".join(sorted(got.get(i, []))) for i in range(len(cases))] == list(cases.values())


def test_names_in_their_scope(spark):
    cases = {
        "with c(n) as (select 1 from base) select n from c": "r:base",
        "with c as (select k from c) select * from c": "r:c",  # the body does not see its own name
        "with recursive c as (select k from c) select * from c": "",
        "select * from (with c as (select 1 from x) select * from c) z, c": "r:c r:x",  # the second c is outside
        "with a as (with b as (select 1 from t) select * from b), b as (select * from a join b) select * from a, b; select * from a":
            "r:a r:b r:t",
        "with c as (select 1 from e) insert overwrite table c select * from c": "r:e w:c",
        "select * from t join lateral (select 1 from u) z on true join lateral explode(l) y": "r:t r:u",
        "with x (a, b) as (select 1, 2 from y), z as (select * from x, (select * from x) w) select * from z, x": "r:y",
        "insert into `my db`.`odd.name` select a from `db` . tab, cat.db.f, with_x": "r:cat.db.f r:db.tab r:with_x w:my db.odd.name",
        "select 1 from t window w as (partition by g), v as (order by h); select 1 from v": "r:t r:v",
        "create table w as with `Odd` as (select 1 from base) select * from odd": "r:base w:w",
        "with a as (select 1 from t where x in (with a as (select 1 from u) select * from a)) select * from a, ((a))": "r:t r:u",
        "with a as (select (1) from t), /* b as ( */ b as (select ')' from a -- )\n) select * from b, c": "r:c r:t",
        "select (((1 from t": "", "))) select 1 from t": "r:t", "": "",
    }
    df = corpus(spark, cases)
    got, places = {}, {}
    for r in scopes.table_refs(df).collect():
        got.setdefault(r.script_id, set()).add(f"{r.access[0]}:{r.table_name}")
    assert [" ".join(sorted(got.get(i, []))) for i in range(len(cases))] == list(cases.values())
    for r in scopes.name_places(df).collect():
        places[r.script_id, r.table_name, r.stmt_no] = (r.n_places, r.n_with)
    assert places[1, "c", 1] == (2, 1) and places[2, "c", 1] == (2, 2) and places[4, "b", 1] == (3, 2) and places[4, "a", 2] == (1, 0)


def test_scopes_of_stored_tokens_and_long_scripts(spark):
    deep = "select * from " + "(select * from " * 60 + "t" + ") x" * 60
    wide = "with " + ", ".join(f"c{i} as (select * from {'base' if i == 0 else f'c{i - 1}'})" for i in range(300)) + " select * from c299, c300"
    df = corpus(spark, [deep, wide, "select a from x.y -- from z\n, `w`"])
    want = {(0, "t"), (1, "base"), (1, "c300"), (2, "x.y"), (2, "w")}
    assert {(r.script_id, r.table_name) for r in scopes.table_refs(df).collect()} == want
    assert {(r.script_id, r.table_name) for r in scopes.table_refs(tokens.tokens(df)).collect()} == want
    assert "Exchange" not in scopes.table_refs(df)._jdf.queryExecution().executedPlan().toString()


def test_joined_laterals(spark):
    df = corpus(spark, ["select 1 from t join lateral (select 1 from u) z on true left join lateral explode(l) y on 1 = 1 join `odd name` o on 1 = 1"])
    assert [(r.join_type, r.table_name, r.alias) for r in structure.joins(df).where("level = 0").orderBy("join_no").collect()] == [
        ("INNER", "(subquery)", ""), ("LEFT", "explode", ""), ("INNER", "odd name", "o")]


def test_semi_and_anti_joins_start_clauses(spark):
    df = corpus(spark, ["select a from b semi join c on b.x = c.x left anti join d on 1 = 1 anti join e"])
    got = [(r.clause, r.text) for r in structure.clauses(df).orderBy("clause_no").collect()]
    assert got == [("SELECT", "select a"), ("FROM", "from b"), ("JOIN", "semi join c on b . x = c . x"),
                   ("JOIN", "left anti join d on 1 = 1"), ("JOIN", "anti join e")]


def test_columns_named_end(spark):
    df = corpus(spark, ["select t.end, case x when 1 then 2 end from t", "select end, case when a then case when b then 1 end else 2 end from t"])
    got = sorted((r.script_id, r.case_depth, r.n_branches, r.has_else) for r in structure.case_blocks(df).collect())
    assert got == [(0, 1, 1, 0), (1, 1, 1, 1), (1, 2, 1, 0)]


STRUCTURE = {
    "select_fields": ("select a.id as id, -- the key\n sum(b) total, t.* from t a", [
        (0, 1, 1, 1, "a . id", "id", "-- the key"), (0, 1, 1, 2, "sum ( b )", "total", ""), (0, 1, 1, 3, "t . *", "", "")]),
    "set_segments": ("select a from t union all select b from u minus select c from v", [
        (0, 1, 0, "", 4, "select a from t"), (0, 1, 1, "UNION ALL", 4, "select b from u"), (0, 1, 2, "MINUS", 4, "select c from v")]),
    "ctes": ("with a as (select x from t), b as (select x from u) select * from a", [(0, 1, 1, 1, "a", 1, 1, 4), (0, 1, 2, 1, "b", 1, 1, 4)]),
    "ddl_columns": ("create table if not exists w (id string comment 'key', amt decimal(22,2)) comment 'work' partitioned by (dt string)", [
        (0, 1, "w", 1, "dt", "string", "", True), (0, 1, "w", 1, "id", "string", "key", False), (0, 1, "w", 2, "amt", "decimal(22,2)", "", False)]),
    "table_options": ("create table w (id string) comment 'work' partitioned by (dt string) stored as orc", [(0, 1, "w", "work", "dt string", "", "orc")]),
    "merge_parts": ("merge into t using s on t.id = s.id when matched and s.del = 1 then delete when not matched then insert (id) values (s.id)", [
        (0, 1, 0, "on", "t . id = s . id"), (0, 1, 0, "source", "s"), (0, 1, 0, "target", "t"), (0, 1, 1, "action", "delete"),
        (0, 1, 1, "when", "matched and s . del = 1"), (0, 1, 2, "action", "insert ( id ) values ( s . id )"), (0, 1, 2, "when", "not matched")]),
    "window_specs": ("select row_number() over (partition by y order by z desc) rn, sum(v) over w from t window w as (partition by g)", [
        (0, 1, 1, "row_number", "", "y", "z desc", ""), (0, 1, 2, "sum", "w", "", "", ""), (0, 1, 3, "", "w", "g", "", "")]),
    "lateral_views": ("select id, tag from t lateral view outer explode(tags) g as tag", [(0, 1, 1, 1, "explode", "tags", "g", "tag")]),
    "subquery_depth": ("select a from (select b from (select c from t) x) y where a in (select 1)", [(0, 1, 4, 2)]),
    "function_calls": ("select upper(a), my_f(b), upper(c) from t", [(0, "my_f", 1, False), (0, "upper", 2, True)]),
}


@pytest.mark.parametrize("name", sorted(STRUCTURE))
def test_structure_of_one_script(spark, name):
    script, want = STRUCTURE[name]
    assert sorted((tuple(r) for r in getattr(structure, name)(corpus(spark, [script])).collect()), key=str) == sorted(want, key=str)


def test_advice_stores_only_tokens_that_matter(spark, monkeypatch):
    """Tokens that no kind of advice looks for are not written; the lists and choices they stand in are known without them."""
    kept = []
    monkeypatch.setattr(lint, "store", lambda df: kept.append(df.count()) or df)
    values = ", ".join(str(i) for i in range(100, 140))
    text = f"select a, b, c from t where a in ({values}) and (b = 1 or b = 2) and c in ()"
    scripts = spark.createDataFrame([(1, "p", text)], "script_id int, path string, sql string")
    got = {tuple(r) for r in lint.advice_rows(scripts).collect()}
    assert got == {(1, "IN_VALUES_LONG", "join a table of the 40 values"), (1, "OR_IN_WHERE", "b IN (1, 2)")}
    assert kept == [3]


def test_advice_needs_no_window_over_tokens(spark, monkeypatch):
    """Tokens are looked at in one pass over a script; rows of one id are one script, a null text has no advice, and a stored
    token table gives the same."""
    plans = []
    monkeypatch.setattr(lint, "store", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    text = ("select count(distinct x.id), (select max(b) from u) from t left join u b on t.k = b.k and t.f = 1 "
            "where my_fn(c) > 2 /* ( */ and `Odd` = 'x' or `Odd` = 'y' -- (\n; select * from db.log_20240131 where a not in (select a from v)")
    rows = [(1, "p", text), (2, "q", None), (None, "r", "select * from t"), (4, "s", "a ) b ( select * from t )) x in (select 1")]
    scripts = spark.createDataFrame(rows, "script_id long, path string, sql string")
    want = {(1, "COUNT_DISTINCT", "approx_count_distinct(x.id)"), (1, "SUBQUERY_IN_SELECT", "join or window instead of a subquery per row"),
            (1, "LEFT_JOIN_WHERE_FILTER", "move the condition on t to WHERE"), (1, "UDF_IN_WHERE", "built-in functions instead of my_fn"),
            (1, "WHERE_FUNCTION", "compare the column itself instead of my_fn(...)"), (1, "OR_IN_WHERE", "`odd` IN ('x', 'y')"),
            (1, "SELECT_STAR", "list the columns of db.log_20240131"), (1, "NOT_IN_SUBQUERY", "left anti join on a if no value is NULL"),
            (None, "SELECT_STAR", "list the columns of t"),
            (1, "TABLE_NAME_WITH_DATE", "partition db.log by dt"),
            (4, "SELECT_STAR", "list the columns of t"), (4, "IN_SUBQUERY", "left semi join on x"),
            (4, "SUBQUERY_DEEP", "name the 2 subqueries in a WITH clause")}
    assert {tuple(r) for r in lint.advice_rows(scripts).collect()} == want
    assert plans and not any("Window" in p for p in plans)
    assert {tuple(r) for r in lint.advice_rows(tokens.tokens(scripts)).collect()} == want


def test_names_are_folded_in_batches(spark):
    """The fold is no expression that is interpreted for every token; null texts keep their row and have no names."""
    df = spark.createDataFrame([(1, "p", "select a from T1 join `D b` . t2"), (2, "q", None)], "script_id long, path string, sql string")
    rows = scopes.resolved_names(df)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.script_id: r.refs and [(x.table_name, x.access) for x in r.refs] for r in rows.collect()}
    assert got == {1: [("t1", "read"), ("d b.t2", "read")], 2: None}


ODD_SCRIPTS = [
    None, "", "select * from t", "ſelect * from t", "SELECT\t* from x crosſ joın y", "a cross  join b", "lıke '%x' lİke \"%", "LIKE '%y'",
    "innerjoin leftjoin x JOIN y left  join z on a and b", "from (\n select 1) where f(x) >= 3 or a or b -- n; é", "where f(x) = 3 or a or b -- x;",
    "select count( distinct a) having max(x) order by z", "ſelect a Union unıon UNİON from ( ſelect", "date='2020-01-02' not in (select 1) 110101199001011234 idcard",
    "in (" + "1," * 60 + "2) from t_20200102", "where year(x) = 3 and cast (a as int) 12.5 ١٢ 3.", "\x1cselect\x0bfrom\x85join x", "select\r\nfrom t order by x",
]


def test_findings_are_those_of_every_rule_tried(spark):
    """Rules that are left out for want of a literal, and patterns without Unicode classes, change no finding."""
    scripts = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(ODD_SCRIPTS)], "script_id int, path string, sql string")
    plain = scripts.select("script_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.regexp_instr("sql", lint.java(p)).alias("pos")) for n, _, p, _, _ in RULES])).alias("h"))
    want = {(r.script_id, r.rule) for r in plain.where("h.pos > 0").select("script_id", "h.rule").collect()}
    got = lint.findings(scripts)
    assert {(r.script_id, r.rule) for r in got.collect()} == want and {n for _, n in want} == {r[0] for r in RULES}
    # a rule without its literals in an ASCII text is not searched
    assert "Contains(low" in got._jdf.queryExecution().optimizedPlan().toString()


def test_integrity_counts_are_those_of_the_patterns(spark):
    """Words found in one pass give the counts of the element patterns, and equal measures need no second look."""
    texts = [(f"p{i}", t) for i, t in enumerate(ODD_SCRIPTS)]
    frame = spark.createDataFrame(texts, "path string, sql string")
    got = {r.path: (r.a.elements, r.a.keywords, r.a.numbers) for r in integrity._measures(frame, "a").collect()}
    plain = frame.select("path", F.array(*[F.regexp_count("sql", lint.java(p)) for p in ELEMENTS.values()]).alias("e"),
                         F.sort_array(textual.keyword_words(F.col("sql"))).alias("k"), textual.numbers_in(F.col("sql")).alias("n"))
    assert got == {r.path: (r.e, r.k, r.n) for r in plain.collect()}
    turned = spark.createDataFrame([(p, texts[-1 - i][1]) for i, (p, _) in enumerate(texts)], "path string, sql string")
    report = integrity.integrity(frame, turned)
    assert report.count() == 5 * len(texts)
    # the details of the keywords are put together once, not for the result and the text each
    assert report._jdf.queryExecution().optimizedPlan().toString().count("sort_array(transform") == 1
