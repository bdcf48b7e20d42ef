"""Original and advised forms give the same rows, and the advised plan has the property it is advised for."""

import re

import pytest

import __spark_entry__ as entry

Q = entry.queries()
PAIRS = [
    ("c01_or_original", "c01_in_advised"), ("c01_or_original", "c01_union_advised"), ("c02_having_original", "c02_where_advised"),
    ("c03_in_subquery_original", "c03_semi_join_advised"), ("c05_long_list_original", "c05_semi_join_advised"),
    ("c06_function_original", "c06_range_advised"), ("c07_date_function_original", "c07_partition_column_advised"),
    ("c08_scalar_subquery_original", "c08_group_stats_advised"), ("c09_repeated_subquery_original", "c09_computed_once_advised"),
    ("c10_count_distinct_original", "c10_two_phase_advised"), ("c10_count_distinct_original", "c10_salted_advised"),
    ("c14_distinct_order_original", "c14_aggregate_advised"), ("c16_literal_date_original", "c16_parameter_advised"),
    ("c19_like_original", "c19_token_index_advised"), ("x01_udf_filter", "x01_builtin_filter"), ("x02_udtf", "x02_join_form"),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("original,advised", PAIRS)
def test_same_rows(spark, sf_dir, original, advised):
    a = Q[original](spark, sf_dir)
    b = Q[advised](spark, sf_dir).select(*a.columns)
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def test_in_list_reaches_the_scan(spark, sf_dir):
    assert "In(o_orderpriority" in plan(Q["c01_in_advised"](spark, sf_dir)) or " IN (1-URGENT" in plan(Q["c01_in_advised"](spark, sf_dir))


def test_range_is_pushed(spark, sf_dir):
    assert "GreaterThanOrEqual(o_orderdate" in plan(Q["c06_range_advised"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" not in plan(Q["c06_function_original"](spark, sf_dir))


def test_partitions_are_pruned(spark, sf_dir):
    def files(df):
        df.collect()
        text = df._jdf.queryExecution().executedPlan()
        scan = text.collectLeaves().head()
        return scan.metrics().get("numFiles").get().value()

    def leaves(df):
        return plan(df)

    assert "PartitionFilters: [isnotnull(month" in leaves(Q["c07_partition_column_advised"](spark, sf_dir))
    assert files(Q["c07_partition_column_advised"](spark, sf_dir)) * 10 < files(Q["c07_date_function_original"](spark, sf_dir))


def test_columns_are_pruned(spark, sf_dir):
    assert "l_orderkey:bigint,l_quantity:double>" in plan(Q["c20_columns_advised"](spark, sf_dir))


def test_limit_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(Q["c15_order_limit_advised"](spark, sf_dir))


def test_udf_is_a_barrier(spark, sf_dir):
    assert "ArrowEvalPython" in plan(Q["x01_udf_filter"](spark, sf_dir))
    assert "ArrowEvalPython" not in plan(Q["x01_builtin_filter"](spark, sf_dir))


def test_no_single_task_window(spark, sf_dir):
    """No window of the global numbering runs over all rows in one task: those over the rows have a partition, and the one
    without reads the counts of the parts, a row per partition."""
    df = Q["w19_global_numbering"](spark, sf_dir)
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan(df))
    assert all(not re.match(r"\S+ (ASC|DESC)", s) for s in specs) and "SinglePartition" not in plan(df)
    assert df.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_tokens_are_not_shuffled(spark, sf_dir):
    """The scripts are partitioned once; windows and groupings over their tokens add no exchange."""
    for name in ("a03_statements", "a20_clauses", "a28_window_specs", "a30_case_blocks"):
        assert plan(Q[name](spark, sf_dir)).count("Exchange") == 1, name


def test_stored_tokens_need_no_shuffle(spark, sf_dir):
    from scriptmill.operators import structure, tokens
    from scriptmill.sources.corpus import scripts_from_orders
    from scriptmill.sources.sinks import work_database

    scripts = scripts_from_orders(spark, sf_dir)
    stored = tokens.store_tokens(scripts, f"{work_database(spark)}.t", 4)
    for build in (tokens.statements, tokens.comments, structure.clauses, structure.window_specs, structure.select_fields,
                  structure.ddl_columns, structure.joins):
        again = build(stored)
        assert "Exchange" not in plan(again), build
    for build in (tokens.statements, structure.select_fields):
        again, direct = build(stored), build(scripts)
        assert again.exceptAll(direct).count() == 0 and direct.exceptAll(again).count() == 0


def test_buckets_follow_the_texts(spark, monkeypatch):
    from scriptmill.operators import tokens
    from scriptmill.sources.sinks import work_database

    scripts = spark.createDataFrame([(i, "select 1; " * 10) for i in range(40)] + [(99, None)], "script_id int, sql string")
    assert tokens.buckets_for(scripts) == 16 and tokens.buckets_for(scripts.limit(0)) == 16
    monkeypatch.setattr(tokens, "BUCKET", 100)
    assert tokens.buckets_for(scripts) == 40
    name = f"{work_database(spark)}.t"
    stored = tokens.store_tokens(scripts, name)
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert detail["Num Buckets"] == "40" and stored.count() == 40 * 30


def test_sorted_inside_partitions(spark, sf_dir):
    parts = Q["o06_sort_by"](spark, sf_dir).rdd.glom().collect()
    assert all([r.o_totalprice for r in p] == sorted((r.o_totalprice for r in p), reverse=True) for p in parts)


def test_clustered(spark, sf_dir):
    parts = [[r.o_custkey for r in p] for p in Q["o07_cluster_by"](spark, sf_dir).rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts)
    assert sum(len(set(p)) for p in parts) == len({k for p in parts for k in p})


def test_settings_for_a_large_input():
    from scriptmill.session import sized_for

    large = sized_for(100 * 10**12)
    assert 10_000 <= int(large["spark.sql.shuffle.partitions"]) <= 20_000
    assert 100 * 10**12 / int(large["spark.sql.files.maxPartitionBytes"]) < 200_000
    assert sized_for(1)["spark.sql.shuffle.partitions"] == "200"
