"""Joins with ranges and keyword tables of any size, and extremes over time frames, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scriptmill.operators import frames, lookup, ranges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def brute_ranges(points, spans):
    ok = lambda x: x is not None and x == x
    return sorted((p, r) for p, v in points for r, lo, hi in spans if ok(v) and ok(lo) and ok(hi) and lo <= v < hi)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interval_join(spark, monkeypatch, seed):
    rng = random.Random(seed)
    inf, nan = float("inf"), float("nan")
    width = [1.0, 40.0, 400.0][seed - 1]
    points = [(i, rng.choice([rng.uniform(-500, 500), 7.0, 8.0])) for i in range(400)]
    points += [(900, None), (901, nan), (902, inf), (903, -inf), (7, 7.0), (7, 7.0)]
    spans = []
    for i in range(120):
        lo = rng.choice([rng.uniform(-600, 600), 7.0, 8.0])
        spans.append((i, lo, lo + rng.choice([0.0, -1.0, rng.uniform(0, width), rng.uniform(0, 1000)])))
    spans += [(500, -inf, inf), (501, None, 3.0), (502, nan, 9.0), (503, 8.0, nan), (504, 7.0, 7.0), (505, -1e308, 1e308), (3, 6.0, 9.0)]
    left = spark.createDataFrame(points, "p long, v double")
    right = spark.createDataFrame(spans, "r long, lo double, hi double")
    want = brute_ranges(points, spans)
    assert pairs(ranges.interval_join(left, "v", right, "lo", "hi"), "p", "r") == want and len(want) > 500
    monkeypatch.setattr(ranges, "BIN_ROWS", 5)  # the third of all rows with one value is split
    again = ranges.interval_join(left, "v", right, "lo", "hi")
    assert pairs(again, "p", "r") == want
    assert "NestedLoop" not in plan(again) and "Cartesian" not in plan(again)


def test_interval_join_without_rows(spark):
    left, right = spark.createDataFrame([(1, 2.0)], "p long, v double"), spark.createDataFrame([(1, 1.0, 3.0)], "r long, lo double, hi double")
    assert pairs(ranges.interval_join(left, "v", right, "lo", "hi"), "p", "r") == [(1, 1)]  # one value: no span
    assert ranges.interval_join(left.limit(0), "v", right, "lo", "hi").count() == 0
    assert ranges.interval_join(left, "v", right.limit(0), "lo", "hi").count() == 0
    assert ranges.interval_join(left, "v", right, "lo", "hi").columns == ["p", "v", "r", "lo", "hi"]


def test_fifty_thousand_rules(spark):
    """Words of one, two and many letters; the empty word; equal words with different codes; words that occur nowhere."""
    rng = random.Random(4)
    letter = lambda n: "".join(rng.choice("abcdeé中") for _ in range(n))
    words = [letter(rng.choice([1, 2, 2, 3, 4, 6])) for _ in range(20_000)] + [f"zz{i}" for i in range(30_000)] + ["", None]
    rules = [(i % 50, w, f"c{i}") for i, w in enumerate(words)]
    texts = [letter(rng.randint(0, 12)) for _ in range(60)] + [None, "", "zz7", "a" * 2000]
    frame = spark.createDataFrame(rules, "prio int, word string, code string").repartition(8)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.first, r.last) for r in lookup.keyword_matches(df, F.col("t"), frame).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.min("code").alias("first"), F.max("code").alias("last")).collect()}
    for i, t in enumerate(texts):
        hits = [c for _, w, c in rules if t is not None and w is not None and w in t]
        assert got.get(i) == ((len(hits), min(hits), max(hits)) if hits else None), t


def test_extremes_over_time(spark):
    """One group with most rows, many rows of one time, rows without a time, frames that end on the border of a stretch."""
    rng = random.Random(5)
    start = dt.datetime(1969, 12, 31, 12)
    rows = []
    for i in range(900):
        group = rng.choice(["hot"] * 8 + ["a", None])
        ts = None if rng.random() < 0.03 else start + dt.timedelta(seconds=rng.choice([0, 3600, 7200, rng.randint(0, 90_000)]))
        rows.append((i, group, ts, None if rng.random() < 0.1 else rng.randint(0, 1000)))
    df = spark.createDataFrame(rows, "i int, g string, ts timestamp, v int")
    out = frames.extremes_over_time(df, ["g"], "ts", 3600, {
        "low": (F.col("v"), "min"), "high": (F.col("v"), "max"), "first": (F.when(F.col("v").isNotNull(), F.struct("ts", "i", "v")), "min")})
    assert out.columns == ["i", "g", "ts", "v", "low", "high", "first"] and out.count() == len(rows)
    for r in out.collect():
        frame = [x for x in rows if x[1] == r.g and x[3] is not None and (
            x[2] is None if r.ts is None else x[2] is not None and r.ts - dt.timedelta(hours=1) <= x[2] <= r.ts)]
        assert r.low == min((x[3] for x in frame), default=None) and r.high == max((x[3] for x in frame), default=None)
        if r.ts is not None:
            assert (r["first"].i if r["first"] else None) == min(((x[2], x[0]) for x in frame), default=(None, None))[1]


def test_running_extremes_of_cut_groups(spark):
    rows = [(("big" if i % 10 else "small"), i, (i * 7919) % 1000 if i % 13 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    assert frames.split(df, ["g"], ["o"]).cut is not None
    got = {(r.g, r.o): (r.lo, r.hi) for r in frames.with_running_extreme(df, ["g"], ["o"], {"lo": (F.col("v"), "min"), "hi": (F.col("v"), "max")}).collect()}
    best = {}
    for g, o, v in rows:
        lo, hi = best.get(g, (None, None))
        best[g] = (v if lo is None else lo if v is None else min(lo, v), v if hi is None else hi if v is None else max(hi, v))
        assert got[g, o] == best[g]


def test_words_meet_only_texts_that_hold_them(spark, monkeypatch):
    """Short words are met as a whole, so words with the same pieces make no pairs to be tested; longer ones by a piece."""
    monkeypatch.setattr(lookup, "PACKED_RULES", 2)
    words = [str(i) for i in range(1000)] + ["x" * 32, "x" * 33, "ab" * 40, "ab" * 40 + "c", "no" * 30]
    rules = spark.createDataFrame([(1, w, w) for w in words], "prio int, word string, code string")
    texts = ["key 000123", "x" * 40, "ab" * 41, "ab" * 40, "c" + "ab" * 40 + "c 7", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = sorted((r.t, r.code) for r in lookup.keyword_matches(df, F.col("t"), rules).collect())
    assert got == sorted((t, w) for t in texts if t is not None for w in words if w in t)
    plain = lookup.keyword_matches(df, F.col("t"), rules.where("length(word) < 9"))
    assert "Contains" not in plain._jdf.queryExecution().executedPlan().toString()
    assert plain.where("code = '123'").count() == 1
