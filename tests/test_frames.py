"""Windows cut into range partitions and blocks against plain windows, with one group that holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptmill.operators import frames, history, skew


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 else rnd.choice(["a", "b", "c", None])
        at = start + dt.timedelta(hours=rnd.randrange(0, 24 * 40))
        value = None if rnd.random() < 0.05 else rnd.randrange(0, 60)
        data.append((i, key, at, value, rnd.randrange(0, 50)))
    return spark.createDataFrame(data, "id long, k string, at timestamp, v int, score int").cache()


def same(a, b):
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


@pytest.fixture(params=["some", "all"], autouse=True)
def cut_groups(request, monkeypatch):
    """Groups larger than a mean partition are cut, or all groups are."""
    if request.param == "all":
        monkeypatch.setattr(skew, "shuffle_partitions", lambda spark: 10**9)


def test_row_number(rows):
    w = Window.partitionBy("k").orderBy("at", "id")
    same(frames.with_row_number(rows, ["k"], ["at", "id"]).select("id", F.col("row_number").cast("long")),
         rows.select("id", F.row_number().over(w).cast("long")))


def test_global_number(rows):
    w = Window.orderBy("at", "id")
    same(frames.with_row_number(rows, [], ["at", "id"]).select("id", F.col("row_number").cast("long")),
         rows.select("id", F.row_number().over(w).cast("long")))


@pytest.mark.parametrize("column", ["score", "v"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(rows, descending, column):
    """``v`` has NULLs."""
    lead = F.col(column).desc() if descending else F.col(column).asc()
    by, full = Window.partitionBy("k").orderBy(lead), Window.partitionBy("k").orderBy(lead, "id")
    got = frames.with_ranks(rows, ["k"], column, ["id"], descending)
    same(
        got.select("id", *[F.col(c).cast("long") for c in ("row_number", "rank", "dense_rank")],
                   frames.ntile(7).cast("long"), frames.ntile(1001).cast("long"), F.round(frames.percent_rank(), 9)),
        rows.select("id", F.row_number().over(full).cast("long"), F.rank().over(by).cast("long"),
                    F.dense_rank().over(by).cast("long"), F.ntile(7).over(full).cast("long"),
                    F.ntile(1001).over(full).cast("long"), F.round(F.percent_rank().over(by), 9)),
    )


def test_running_sum(rows):
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(frames.with_running_sum(rows, ["k"], ["at", "id"], {"s": F.col("v")}).select("id", F.col("s").cast("long")),
         rows.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).cast("long")))


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_row_frames_over_block_edges(rows, block):
    w = Window.partitionBy("k").orderBy("at", "id")
    exprs = {
        "prev": lambda x: F.lag("v", 3, -1).over(x), "next": lambda x: F.lead("id", 2).over(x),
        "mean": lambda x: F.avg("v").over(x.rowsBetween(-2, 1)), "n": lambda x: F.count("v").over(x.rowsBetween(-3, 2)),
    }
    got = frames.over_rows(rows, ["k"], ["at", "id"], 3, 2, exprs, block_rows=block)
    want = rows
    for name, build in exprs.items():
        want = want.withColumn(name, build(w))
    same(got.select("id", "prev", "next", "mean", "n"), want.select("id", "prev", "next", "mean", "n"))


def test_row_frame_wider_than_block(rows):
    w = Window.partitionBy("k").orderBy("at", "id")
    got = frames.over_rows(rows, ["k"], ["at", "id"], 10, 0, {"old": lambda x: F.lag("id", 10).over(x)}, block_rows=5)
    same(got.select("id", "old"), rows.select("id", F.lag("id", 10).over(w)))


@pytest.mark.parametrize("days", [0, 1, 5])
def test_time_frame(rows, days):
    data = rows.withColumn("at", F.when(F.col("id") % 50 != 0, F.col("at")))  # some times are missing
    spec = Window.partitionBy("k").orderBy(F.unix_micros("at")).rangeBetween(-days * 86400 * 1_000_000, 0)
    want = data.select("id", F.sum("v").over(spec).cast("long"), F.count(F.lit(1)).over(spec).cast("long"))
    got = frames.sums_over_time(data, ["k"], "at", days * 86400, {"s": F.col("v"), "n": F.lit(1)})
    same(got.select("id", F.col("s").cast("long"), F.col("n").cast("long")), want)


def largest_share(df):
    """Rows of the largest task of the range partitions, as a share of all."""
    counts = [r["count"] for r in df.groupBy("__part").count().collect()]
    return max(counts) / sum(counts)


def test_one_day_and_one_value_are_cut_too(spark, cut_groups):
    """All rows in one group, on one day, with one value: still no task has more than a share of them."""
    same_day = spark.range(20_000).selectExpr("id", "'k' AS k", "timestamp'2024-01-01' AS at", "1 AS v")
    for order in (["at"], ["v"], ["v", "id"]):
        two = frames.split(same_day, [], order)
        assert two.plain is None and largest_share(two.cut) < 0.3
    ranked = frames.with_ranks(same_day.withColumn("v", F.when(F.col("id") < 15_000, 1).otherwise(2)), [], "v", ["id"])
    got = {tuple(r) for r in ranked.groupBy("v").agg(F.min("rank"), F.max("rank"), F.max("dense_rank"), F.max("group_rows")).collect()}
    assert got == {(1, 1, 1, 1, 20_000), (2, 15_001, 15_001, 2, 20_000)}


def test_thousands_of_large_groups(spark, monkeypatch):
    """5000 groups that all count as large: none is left to one task because of its place in a list."""
    monkeypatch.setattr(skew, "shuffle_partitions", lambda spark: 10**9)
    many = spark.range(50_000).selectExpr("id", "id % 5000 AS k", "id % 7 AS v")
    assert frames.split(many, ["k"], ["v"]).cut.select("__group").distinct().count() == 5000
    w = Window.partitionBy("k").orderBy("v", "id")
    same(frames.with_row_number(many, ["k"], ["v", "id"], "n").select("id", "n"),
         many.select("id", F.row_number().over(w).cast("long")))


def test_latest(rows):
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    data = rows.withColumn("x", F.when(F.col("id") % 40 == 0, F.struct("id", "v")))
    same(frames.with_latest(data, ["k"], ["at", "id"], "x", "y").select("id", "y"),
         data.select("id", F.last("x", ignorenulls=True).over(w)))


def test_top_per_group_is_cut_before_the_shuffle(rows):
    top = frames.top_per_group(rows, ["k"], ["at", "id"], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert top.count() == 10


@pytest.mark.parametrize("k", [1, 3, 500])
def test_top_ranks(rows, k):
    w = Window.partitionBy("k").orderBy(F.desc("score"))
    same(frames.top_ranks_per_group(rows, ["k"], "score", k).select("id", F.col("place").cast("int")),
         rows.withColumn("place", F.rank().over(w)).where(f"place <= {k}").select("id", "place"))


def test_group_stats(rows):
    w = Window.partitionBy("k")
    got = skew.with_group_stats(rows, ["k"], [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")])
    same(got.select("id", "k", "s", "n"), rows.select("id", "k", F.sum("v").over(w), F.count(F.lit(1)).over(w)))


def test_distinct_forms(rows):
    exact = rows.groupBy("k").agg(F.count_distinct("v").alias("n_distinct"))
    same(skew.salted_distinct(rows, "k", "v", 5), exact)
    same(skew.two_phase_distinct(rows, "k", "v"), exact)


def test_asof_join(spark, rows):
    rnd = random.Random(9)
    start = dt.datetime(2023, 12, 20)
    hist = []
    for key in ("hot", "a", "b", None):
        at = start + dt.timedelta(hours=rnd.randrange(200))
        for n in range(30):
            until = at + dt.timedelta(hours=rnd.randrange(1, 60))
            hist.append((key, at, until if n < 29 else None, f"{key}{n}"))
            at = until + dt.timedelta(hours=rnd.choice([0, 0, 7]))
    h = spark.createDataFrame(hist, "k string, s timestamp, e timestamp, name string")
    got = history.asof_join(rows, h, "k", "at", "s", "e", ["name"]).select("id", "name")
    facts = {r.id: r for r in rows.collect()}
    want = {}
    for i, r in facts.items():
        names = [x[3] for x in hist if r.k is not None and x[0] == r.k and x[1] <= r.at and (x[2] is None or x[2] > r.at)]
        want[i] = names[0] if names else None
    result = {r.id: r.name for r in got.where("k is not null" if "k" in got.columns else "true").collect()}
    assert len(result) == len(facts)
    assert {i: n for i, n in result.items() if facts[i].k is not None} == {i: n for i, n in want.items() if facts[i].k is not None}
    # NULL keys match nothing, as in a join.
    assert all(result[i] is None for i in facts if facts[i].k is None)
