"""Merge, lookups, NULL traps, sinks and folders on small fixtures."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptmill.functions.calendar import month_end, month_range, prev_month_end
from scriptmill.functions.survivor import survivor
from scriptmill.operators import contract, lint, lookup, masking
from scriptmill.operators.contract import fill_layout, project, report_frame
from scriptmill.operators.history import as_of
from scriptmill.operators.merge import When, merge_frames
from scriptmill.operators.validate import unknown_codes, validate
from scriptmill.session import ensure_checkpoint_dir, materialize, scratch_dir
from scriptmill.sources import corpus, sinks
from scriptmill.sources.tables import code_table
from scriptmill.streaming.incremental import findings_of_new_files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (None, "n", 0)], "id int, name string, v int")


@pytest.fixture
def branches(spark):
    return [
        When("delete", F.expr("s.v < 0")),
        When("update", F.expr("s.v > 100"), {"v": F.col("s.v"), "name": F.lit("big")}),
        When("update", None, {"v": F.col("s.v") + F.col("t.v")}),
        When("insert", F.expr("s.v > 0"), {"id": F.col("s.id"), "v": F.col("s.v")}),
    ]


def test_merge_first_branch_wins(spark, target, branches):
    source = spark.createDataFrame([(1, -1), (2, 500), (3, 5), (4, 7), (5, -7), (None, 9)], "id int, v int")
    got = rows(merge_frames(target, source, ["id"], branches))
    assert got == sorted([(2, "big", 500), (3, "c", 35), (4, None, 7), (None, None, 9), (None, "n", 0)], key=repr)


def test_merge_twice_matched_row_is_an_error(spark, target, branches):
    source = spark.createDataFrame([(1, 5), (1, 6)], "id int, v int")
    with pytest.raises(PySparkException, match="several source rows"):
        merge_frames(target, source, ["id"], branches).collect()


def test_merge_duplicates_without_match_are_inserted(spark, target, branches):
    source = spark.createDataFrame([(9, 5), (9, 6)], "id int, v int")
    assert len(rows(merge_frames(target, source, ["id"], branches))) == 6


def test_merge_null_condition_does_not_hold(spark, target, branches):
    source = spark.createDataFrame([(1, None)], "id int, v int")
    got = rows(merge_frames(target, source, ["id"], branches[:2]))
    assert (1, "a", 10) in got


def test_prefix_lookup_longest_wins(spark):
    dim = code_table(spark, [("1234", "four"), ("123456", "six"), ("9", "never"), ("12345678901234", "whole")], "c string, v string")
    df = spark.createDataFrame([("12345678901234",), ("123456",), ("1234999",), ("9999",), (None,), ("12",)], "k string")
    got = {r.k: r.v for r in lookup.prefix_lookup(df, "k", dim, "c", "v", [11, 9, 6, 4], "v").collect()}
    assert got == {"12345678901234": "whole", "123456": "six", "1234999": "four", "9999": None, None: None, "12": None}


def test_keyword_code_by_priority(spark):
    rules = code_table(spark, [(2, "b", "B"), (1, "ab", "AB"), (3, "z", "Z")], "prio int, word string, code string")
    df = spark.createDataFrame([("xabx",), ("b",), ("q",), (None,)], "t string")
    got = {r.t: r.code for r in lookup.keyword_code(df, F.col("t"), rules, "none").collect()}
    assert got == {"xabx": "AB", "b": "B", "q": "none", None: "none"}
    listed = lookup.keyword_code(df, F.col("t"), [(2, "b", "B"), (1, "ab", "AB")], "none")
    assert {r.t: r.code for r in listed.collect()} == got
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()


def test_many_rules_are_joined(spark, monkeypatch):
    """More rules than travel in the plan: the same answers by a join."""
    rules = code_table(spark, [(2, "b", "B"), (1, "abc", "AB"), (3, "zzz", "Z"), (5, "the", "T"), (4, "abcd", "D")], "prio int, word string, code string")
    df = spark.createDataFrame([("xabcx",), ("b",), ("q",), (None,), ("bathezzz",), ("zzzz",), ("",), ("zzzz",)], "t string")
    few = rows(lookup.keyword_code(df, F.col("t"), rules, "none"))
    hits = rows(lookup.keyword_matches(df, F.col("t"), rules).select("t", "prio", "code"))
    monkeypatch.setattr(lookup, "PACKED_RULES", 2)
    assert rows(lookup.keyword_code(df, F.col("t"), rules, "none")) == few
    assert rows(lookup.keyword_matches(df, F.col("t"), rules).select("t", "prio", "code")) == hits


def test_long_code_lists_make_the_same_frame(spark, monkeypatch):
    left, right = spark.range(7).withColumnRenamed("id", "a"), spark.range(30).selectExpr("id AS b", "cast(id AS string) AS s")
    few = rows(report_frame(left, right))
    monkeypatch.setattr(contract, "BROADCAST_CODES", 5)
    assert rows(report_frame(left, right)) == few and len(few) == 210


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for values, want in (([(1,)], [(2,)]), ([(1,), (None,)], []), ([], [(1,), (2,), (None,)])):
        assert rows(lookup.not_in(left, "k", spark.createDataFrame(values, "v int"), "v")) == sorted(want, key=repr)


@pytest.mark.parametrize("turned", [False, True])
def test_merge_does_not_depend_on_the_order_of_rows(spark, turned):
    target = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 7)], "id int, v int")
    over = [When("update", F.col("s.v") > 100, {"v": F.col("s.v")}), When("insert", None, {"id": F.col("s.id"), "v": F.col("s.v")})]
    source = [(1, 5), (1, 500), (2, 5), (2, 6), (3, 900), (3, 1), (8, 1), (8, 200)]
    df = spark.createDataFrame(source[::-1] if turned else source, "id int, v int").coalesce(1)
    assert rows(merge_frames(target, df, ["id"], over)) == [(1, 500), (2, 0), (3, 900), (3, 900), (8, 1), (8, 200)]
    twice = spark.createDataFrame([(1, 500), (1, 600)][:: -1 if turned else 1], "id int, v int").coalesce(1)
    with pytest.raises(PySparkException, match="several source rows"):
        merge_frames(target, twice, ["id"], over).collect()


def test_reload_is_one_step(spark):
    db = sinks.work_database(spark)
    sinks.create_typed_table(spark, f"{db}.r", [("a", "INT", ""), ("p", "STRING", "")], partitioned_by=["p"])
    odd = "o'k \\ x"
    for p in (odd, "other"):
        sinks.reload_partition(spark, f"{db}.r", {"p": p}, spark.createDataFrame([(1,), (2,)], "a int"))
    broken = spark.createDataFrame([(5,)], "a int").select(F.raise_error(F.lit("no")).cast("int").alias("a"))
    with pytest.raises(PySparkException):
        sinks.reload_partition(spark, f"{db}.r", {"p": odd}, broken)
    assert rows(spark.table(f"{db}.r")) == [(1, odd), (1, "other"), (2, odd), (2, "other")]
    sinks.reload_partition(spark, f"{db}.r", {"p": "other"}, spark.createDataFrame([], "a int"))
    assert rows(spark.table(f"{db}.r")) == [(1, odd), (2, odd)]
    sinks.reload_partitions(spark.createDataFrame([("new", 9), ("new", 8)], "p string, a int"), f"{db}.r")
    sinks.reload_partitions(spark.createDataFrame([("new", 3)], "p string, a int"), f"{db}.r")
    assert rows(spark.table(f"{db}.r")) == [(1, odd), (2, odd), (3, "new")]


def test_a_large_partition_is_written_by_many_tasks(spark, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(200_000).selectExpr("id", "sha2(cast(id AS string), 256) AS h", "if(id % 10 = 0, cast(id % 100 AS string), 'hot') AS p")
        sinks.write_partitioned(df.repartition(16), str(tmp_path / "t"), ["p"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("part-*"))) for d in (tmp_path / "t").iterdir() if d.is_dir()}
    assert files.pop("p=hot") >= 8
    # a rare value is one file, unless it shares its hash partition with the large one
    assert sorted(files.values())[len(files) // 2] == 1


def test_nothing_is_left_behind(tmp_path):
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {repr(ROOT)})
import __spark_entry__ as e
from scriptmill.session import build_session
spark = build_session("left", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2",
                      spark__checkpoint__dir={repr(str(tmp_path / "ckpt"))}, spark__sql__warehouse__dir={repr(str(tmp_path / "wh"))})
for name in ("s07_ctas", "s13_overwrite_partition", "w01_row_number", "s14_idempotent_reload"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=tmp_path)
    assert [p for p in (tmp_path / "ckpt").rglob("*") if p.is_file()] == []

def test_code_table_is_broadcast_by_size(spark):
    codes = code_table(spark, [("a", 1)], "c string, v int")
    df = spark.range(10).select(F.col("id").cast("string").alias("c"))
    assert "BroadcastHashJoin" in df.join(codes, "c", "left")._jdf.queryExecution().executedPlan().toString()


def test_survivor(spark):
    cases = [(None, "b", "b"), ("", "b", "b"), ("@@x", "b", "b"), ("a", "b", "a"), (None, "", None), ("@@x", "@@y", "@@x"),
             ("", None, ""), ("a", None, "a")]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], "a string, b string, w string")
    assert df.where(~survivor(F.col("a"), F.col("b")).eqNullSafe(F.col("w"))).count() == 0


def test_calendar(spark):
    df = spark.createDataFrame([("20240315",), ("20240101",), ("20230301",), ("bad",), (None,)], "d string")
    got = {r.d: (r.p, r.e) for r in df.select("d", prev_month_end("d").alias("p"), month_end("d").alias("e")).collect()}
    assert got == {"20240315": ("20240229", "20240331"), "20240101": ("20231231", "20240131"),
                   "20230301": ("20230228", "20230331"), "bad": (None, None), None: (None, None)}


def test_as_of_is_half_open(spark):
    df = spark.createDataFrame([(1, "20240101", "20240201"), (2, "20240201", "99991231")], "i int, start_dt string, end_dt string")
    assert rows(as_of(df, "20240201").select("i")) == [(2,)]
    assert rows(as_of(df, "20240131").select("i")) == [(1,)]


def test_contract(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert project(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="c"):
        project(df, ["a", "c"])
    assert rows(fill_layout(df, {"x": "", "b": None})) == [("", 2)]


def test_validate(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (3, 50, None)], "id int, v int, c string")
    got = rows(validate(df, ["id"], [(F.col("v") > 10, "large"), (F.col("v").isNull(), "missing"), (F.col("c") == "y", "why")]))
    assert got == [(1, "missing"), (2, "why"), (3, "large")]
    codes = spark.createDataFrame([("x",), (None,)], "code string")
    assert rows(unknown_codes(df, "c", codes, "code").select("id")) == [(2,), (3,)]


def test_masking_keeps_equality(spark):
    df = spark.createDataFrame([("Ab12",), ("Ab12",), ("Zz99",)], "x string")
    assert df.select(masking.pseudonym(F.col("x"), "s")).distinct().count() == 2
    assert {r[0] for r in df.select(masking.partial_mask(F.col("x"), 2)).collect()} == {"Xx12", "Xx99"}


def test_reload_is_idempotent_and_can_empty_a_partition(spark):
    db = sinks.work_database(spark)
    sinks.create_typed_table(spark, f"{db}.t", [("a", "INT", "key's"), ("dt", "STRING", "")], "it's", ["dt"])
    one = spark.createDataFrame([(1,), (2,)], "a int")
    for _ in range(2):
        sinks.reload_partition(spark, f"{db}.t", {"dt": "1"}, one)
        sinks.reload_partition(spark, f"{db}.t", {"dt": "2"}, one)
    assert spark.table(f"{db}.t").count() == 4
    sinks.reload_partition(spark, f"{db}.t", {"dt": "1"}, one.limit(0))
    assert rows(spark.table(f"{db}.t")) == [(1, "2"), (2, "2")]
    comments = {f.name: f.metadata.get("comment") for f in spark.table(f"{db}.t").schema}
    assert comments["a"] == "key's"


def test_dynamic_overwrite_leaves_other_partitions(spark):
    path = scratch_dir(spark)
    df = spark.range(100).withColumn("p", (F.col("id") % 3).cast("string"))
    sinks.write_partitioned(df, path, ["p"])
    sinks.write_partitioned(df.where("p = '1'").limit(5), path, ["p"])
    got = {r.p: r["count"] for r in spark.read.parquet(path).groupBy("p").count().collect()}
    assert got == {0: 34, 1: 5, 2: 33}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
    assert materialize(spark.range(3)).count() == 3


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.sql").write_text("SELECT * FROM t;\n-- 注释", encoding="utf-8")
    (tmp_path / "a" / "b" / "y.sql").write_bytes(b"select '\xff\xfe' from t")
    (tmp_path / "a" / "n.txt").write_text("select 1")
    (tmp_path / "blank.sql").write_text("\n")
    (tmp_path / "empty.sql").write_text("")  # Spark's file sources leave files of length 0 out
    scan = corpus.scan_folder(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in scan.collect()} == {"x.sql", "y.sql", "blank.sql"}
    assert {r.rule for r in lint.findings(scan).collect()} >= {"SELECT_STAR"}
    assert {r.issue_count for r in lint.severity_counters(scan).where("path like '%blank.sql'").collect()} == {0}
    checked = {r.path.rsplit("/", 1)[1]: r for r in corpus.scan_folder_checked(spark, str(tmp_path)).collect()}
    assert checked["y.sql"].sql is None and checked["y.sql"].error
    report = {r.path.rsplit("/", 1)[1]: r for r in lint.report(corpus.scan_folder_checked(spark, str(tmp_path))).collect()}
    assert report["y.sql"].error and report["y.sql"].issue_count == 0 and report["y.sql"].issues == []
    assert report["x.sql"].error is None and report["x.sql"].issue_count > 0
    assert checked["x.sql"].error is None and checked["x.sql"].sql.endswith("注释")


def test_new_files_only(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("select * from t")
    findings_of_new_files(spark, folder, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    (tmp_path / "in" / "b.sql").write_text("select * from t cross join u")
    for _ in range(2):
        findings_of_new_files(spark, folder, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    (tmp_path / "in" / "c.sql").write_bytes(b"select \xff\xfe from t cross join u")
    findings_of_new_files(spark, folder, out, ckpt).awaitTermination()
    broken = spark.read.parquet(out).where("rule = 'UNREADABLE_FILE'").collect()
    assert len(broken) == 1 and broken[0].path.endswith("c.sql") and spark.read.parquet(out).count() == 4


def test_empty_scripts_of_a_bundle_are_rows(spark, tmp_path):
    (tmp_path / "b.txt").write_text("select 1|||select 2|")
    got = corpus.scan_folder(spark, str(tmp_path), "*.txt", "|").orderBy("path").collect()
    assert [r.sql for r in got] == ["select 1", "", "", "select 2"]


def test_month_range(spark):
    df = spark.sql("SELECT explode(array('1996-12-31', '1997-01-01', '1997-12-31', '1998-01-01')) d").select(
        F.col("d").cast("timestamp_ntz").alias("d"))
    assert df.where(month_range("d", 1997)).count() == 2
    assert df.where(month_range("d", 1997, 12)).count() == 1


def test_texts_of_groups_are_sorted_without_a_comparator(spark):
    from scriptmill.operators.tokens import text_of

    rows = spark.range(6).selectExpr("id % 2 AS g", "cast(5 - id AS int) AS pos", "concat('t', id) AS tok")
    out = rows.groupBy("g").agg(text_of(rows.pos < 5).alias("t"))
    assert {r.g: r.t for r in out.collect()} == {0: "t4 t2", 1: "t5 t3 t1"}
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()


def test_merge_tasks_stay_small(spark):
    """AQE may not merge what one task sorts into as few partitions as the session allows."""
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst"]
    kept = {k: spark.conf.get(k) for k in keys}
    try:
        for key, value in zip(keys, ["40", "256m", "false"]):
            spark.conf.set(key, value)
        target = spark.range(0, 800_000, 1, 4).select("id", F.rand(1).alias("v"), F.lit(0).alias("n"))
        source = spark.range(400_000, 1_200_000, 1, 4).select("id", F.rand(2).alias("v"))
        got = merge_frames(target, source, ["id"], [
            When("update", None, {"v": F.col("s.v"), "n": F.lit(1)}),
            When("insert", None, {"id": F.col("s.id"), "v": F.col("s.v"), "n": F.lit(2)})])
        tasks = got.groupBy(F.input_file_name().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("s")).collect()
        assert sum(r.n for r in tasks) == 1_200_000 and sum(r.s for r in tasks) == 1_200_000
        assert max(r.n for r in tasks) <= 400_000
        assert spark.conf.get(keys[1]) == "256m"
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
