"""The set-similarity join of scripts against all pairs in plain Python."""

import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scriptmill.operators import similar


def corpus():
    """Families of near copies, exact copies in another layout, and one table that every script reads."""
    rng = random.Random(8)
    rows = []
    for family in range(12):
        base = [f"select c{rng.randint(0, 30)}, d{rng.randint(0, 30)} from t{rng.randint(0, 40)} where k = {i}" for i in range(14)]
        for member in range(5):
            lines = [f"select z from changed_{family}_{member}_{i}" if rng.random() < 0.04 * member else x for i, x in enumerate(base)]
            rows.append((f"f{family}/{member}.sql", ";\n".join([*lines, "select 1 from common_log"])))
        rows.append((f"f{family}/copy.sql", "-- copy\n" + ";".join([*base, "select 1 from common_log"]).upper()))
    rows += [("only.sql", "select 1 from common_log"), ("none.sql", "-- nothing"), ("empty.sql", ""), ("null.sql", None)]
    rng.shuffle(rows)
    return rows


def scripts(spark, rows):
    return spark.createDataFrame([(p, p, s) for p, s in rows], "script_id string, path string, sql string")


def brute(spark, rows, least):
    sets = {}
    for r in similar.script_features(scripts(spark, rows)).collect():
        sets.setdefault(r.path, set()).add(r.feature)
    by_set = {}
    for path, s in sets.items():
        by_set.setdefault(frozenset(s), []).append(path)
    heads = {min(v): (k, len(v)) for k, v in by_set.items()}
    pairs = set()
    for a, b in combinations(sorted(heads), 2):
        (x, m), (y, n) = heads[a], heads[b]
        if Fraction(len(x & y), len(x | y)) >= least:
            pairs.add((a, b, m, n, len(x & y), len(x & y) / len(x | y)))
    members = {p: (min(v), len(v)) for v in by_set.values() for p in v}
    return pairs, {(p, c, n, sum(c in pair[:2] for pair in pairs)) for p, (c, n) in members.items()}


@pytest.mark.parametrize("least", [Fraction(4, 5), Fraction(1, 2), Fraction(1)])
def test_pairs_and_classes(spark, least):
    rows = corpus()
    pairs, members = similar.similar_scripts(scripts(spark, rows), least)
    want_pairs, want_members = brute(spark, rows, least)
    assert {tuple(r) for r in pairs.collect()} == want_pairs and pairs.count() == len(want_pairs)
    assert {tuple(r) for r in members.collect()} == want_members and members.count() == len(want_members)
    if least < 1:
        assert len(want_pairs) > 20
    assert any(n > 1 for _, _, n, _ in want_members) and not any(p in ("none.sql", "empty.sql", "null.sql") for p, *_ in want_members)


def test_blocks_and_rare_features(spark, monkeypatch):
    """Entries of the index larger than a block are split, and frequencies that are not broadcast are joined."""
    rows = corpus()
    want, _ = brute(spark, rows, Fraction(1, 2))
    monkeypatch.setattr(similar, "BLOCK", 2)
    monkeypatch.setattr(similar, "FREQUENT", 5)
    pairs, _ = similar.similar_scripts(scripts(spark, rows), Fraction(1, 2))
    assert {tuple(r) for r in pairs.collect()} == want


def test_a_feature_of_all_scripts_is_no_candidate(spark):
    """Scripts with nothing in common but one table meet in no entry of the index."""
    rows = [(f"{i:03}.sql", "; ".join([f"select a{i}_{j} from own{i}_{j}" for j in range(6)] + ["select 1 from common_log"])) for i in range(300)]
    members = similar.classes(similar.script_features(scripts(spark, rows)))
    ordered = similar._ordered(members.select("class", "n", "features"))
    common = {r.f for r in spark.range(1).select(F.xxhash64(F.lit("table"), F.lit("common_log")).alias("f")).collect()}
    assert common <= {r.f for r in ordered.select(F.element_at("features", -1).alias("f")).collect()} | {
        r.f for r in ordered.select(F.element_at("features", -2).alias("f")).collect()} | {
        r.f for r in ordered.select(F.element_at("features", -3).alias("f")).collect()}
    pairs, rows_ = similar.similar_scripts(scripts(spark, rows))
    assert pairs.count() == 0 and rows_.where("n_links = 0 AND n_scripts = 1").count() == 300


def test_no_scripts(spark):
    pairs, members = similar.similar_scripts(scripts(spark, []))
    assert pairs.count() == 0 and members.count() == 0


def test_pairs_that_meet_too_late_are_no_candidates(spark):
    """Of two sets of ten, the first common feature stands at the second place of both: nine from there on suffice for 4/5, the
    last one of the prefix does not. Sizes that differ are found too."""
    shared = [f"s{i}" for i in range(9)]
    sets = {"a": ["x1", *shared], "b": ["x2", *shared], "c": ["y1", "y2", "y3", *shared[:7]], "d": [*shared[:8]]}
    df = spark.createDataFrame([(k, len(v), [hash(x) for x in v]) for k, v in sets.items()], "class string, n int, features array<long>")
    out = similar.similar_classes(df, Fraction(4, 5))
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})}
    assert {(r.class_a, r.class_b) for r in out.collect()} == want and want
    assert "least((n" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("least", [Fraction(4, 5), Fraction(1, 2)])
@pytest.mark.parametrize(("few", "block", "width"), [(1, 4, 1024), (1, 1000, 1024), (1, 4, 3), (3, 16, 8)])
def test_members_of_large_entries_are_compared_where_they_meet(spark, monkeypatch, least, few, block, width):
    """The pairs are the same for any size of entries that are written down, of blocks and of the matrix, and pairs of large
    entries are not rows of a join."""
    rng = random.Random(3)
    bases = [rng.sample(range(24), 14) for _ in range(6)]
    sets = {f"c{i:03}": {*rng.sample(bases[i % 6], rng.randint(11, 14)), *([] if i % 4 else [100 + i])} for i in range(60)}
    sets = dict({frozenset(v): (k, v) for k, v in sets.items()}.values())
    sets |= {f"d{i}": {*range(200, 206 + i)} for i in range(5)}
    df = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "class string, n int, features array<long>")
    for name, value in (("FEW", few), ("BLOCK", block), ("WIDTH", width), ("TILE", 7)):
        monkeypatch.setattr(similar, name, value)
    out = similar.similar_classes(df, least)
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in combinations(sorted(sets), 2)
            if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= least}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) > 10


def test_pairs_of_a_frequent_feature_are_not_written_down(spark, monkeypatch):
    """Sets that all share a feature of their prefix and little else: their pairs are no rows of any join."""
    sets = [(f"c{i:04}", 5, [1, *range(10 + 4 * i, 14 + 4 * i)]) for i in range(400)]
    df = spark.createDataFrame(sets, "class string, n int, features array<long>")
    monkeypatch.setattr(similar, "FEW", 16)
    # the shared feature is put first, as a rarer one would be
    monkeypatch.setattr(similar, "_ordered", lambda sets: sets)
    out = similar.similar_classes(df, Fraction(1, 5))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
