"""Periodic runs against a search over all periods, and the digests of the query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import __spark_entry__ as entry
from cases import DOCS, numbered, table

from scriptmill.llm import periodic


def words(text):
    return (text or "").encode().split()


def brute(w, length=6, times=4):
    """All runs (start, length, period): every period from 1 on, the first one that gives a stretch is its smallest."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, times * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def random_text(rng):
    n, letters = rng.choice([0, 1, 3, 8, 20, 60]), "abcdef"[: rng.choice([1, 2, 2, 3, 6])]
    w = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        w = w[: rng.randint(1, max(1, n // 3))] * rng.randint(2, 9) + w
    return w


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        texts = [random_text(rng) for _ in range(rng.randint(0, 4))]
        length, times = rng.choice([6, 2]), rng.choice([4, 4, 2, 3, 6])
        ids, offsets, parts = periodic.word_ids([" ".join(w).encode() for w in texts])
        got = periodic.runs_of(ids, offsets, length, times)
        assert got == [brute(w, length, times) for w in texts]
        assert [periodic.collapsed_words(p, r) for p, r in zip(parts, got)] == [
            collapsed([x.encode() for x in w], r) for w, r in zip(texts, got)]


def test_small_slices(monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 3)
    rng = random.Random(2)
    for _ in range(200):
        w = random_text(rng)
        assert periodic.runs_of(*periodic.word_ids([" ".join(w).encode()])[:2]) == [brute(w)]


def test_nested_and_long_runs():
    inner = (["a"] * 9 + ["b"]) * 5 + ["c"] * 6
    long = ["x"] * 50_000 + numbered("n", 10) * 300 + ["y", "z"] * 3
    ids, offsets, _ = periodic.word_ids([" ".join(inner).encode(), " ".join(long).encode()])
    first, second = periodic.runs_of(ids, offsets)
    assert first == brute(inner) and (0, 50, 10) in first and (10, 9, 1) in first
    assert second == [(0, 50_000, 1), (50_000, 3000, 10)]


def test_operator(spark):
    rows = [(i, " ".join(random_text(random.Random(i)))) for i in range(100, 200)] + DOCS + [(9, "é é\té é\n é\x0bé\x0c é"), (9, "no-break space " * 8)]
    got = periodic.periodic_runs(spark, table(spark, rows))
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = [(d, brute(words(t)), b" ".join(collapsed(words(t), brute(words(t)))).decode()) for d, t in rows if len(t or "") < 100_000]
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect() if len(r.collapsed) < 100_000), key=str)
    assert found == sorted(want, key=str)
    assert periodic.periodic_runs(spark, table(spark, [])).count() == 0


def digest(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest())


def test_query_on_a_fixture(spark):
    rows = [(i, " ".join(random_text(random.Random(i)))) for i in range(400)] + [(d, t) for d, t in DOCS if d is not None and len(t or "") < 100_000]
    got = periodic.digests(periodic.periodic_runs(spark, periodic.with_planted_periods(table(spark, rows))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*r) for r in rows), key=str)
    none = periodic.digests(periodic.periodic_runs(spark, periodic.with_planted_periods(table(spark, DOCS)))).filter("doc_id is null")
    assert none.count() == 2


def test_query_on_short_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in entry.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    short = [(d, t) for d, t in docs.items() if len(t or "") < 4000]
    assert len(short) > 50 and any(got[d][1] for d, _ in short)
    assert [got[d] for d, _ in short] == [digest(d, t) for d, t in short]
