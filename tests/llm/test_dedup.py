"""Near duplicates of texts and vectors, line chunks and passages against plain Python."""

import math
import random

import numpy as np
import pytest
from cases import BASE, DOCS, numbered, shingles, smallest, table, vary, words

from scriptmill.llm import embeddings, linededup, minhash, passages, textkit
from scriptmill.llm.common import components


def brute_components(rows, width):
    known = [(d, t) for d, t in rows if d is not None]
    sets = [(d, shingles(t, width)) for d, t in known]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :]
             if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return smallest([d for d, _ in known], links)


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_is_brute_force(spark, width):
    got = minhash.near_duplicates(spark, table(spark, DOCS), shingle=width).collect()
    assert len(got) == len(DOCS)
    root = brute_components(DOCS, width)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(
        (d, len(shingles(t, width)), root[d], root[d] == d) for d, t in DOCS if d is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert got[0].__fields__ == ["doc_id", "n_shingles", "component_id", "kept"]


def test_family_whose_members_differ_among_themselves(spark):
    """Copies of an original with other words replaced in each: linked with the original, hardly with each other; and a
    chain in which only neighbours are similar."""
    rng = random.Random(5)
    words_ = numbered("f", 150)
    rows = [(1000 + i, vary(words_, *rng.sample(range(150), rng.choice([1, 2, 3, 4])))) for i in range(150)] + [(5000, " ".join(words_))]
    chain = numbered("c", 400)
    rows += [(6000 + i, " ".join(chain[8 * i : 8 * i + 100])) for i in range(20)]
    root = brute_components(rows, 4)
    got = minhash.near_duplicates(spark, table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert len(set(root.values())) < 60


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    rows = [(i, vary(BASE, i)) for i in range(10)]
    members = spark.createDataFrame([(1, i, i, 117) for i, _ in rows], "key long, rep long, label long, n_shingles long")
    links = minhash.bucket_links(members, spark.createDataFrame(rows, "id long, text string"), 4, minhash.Fraction(4, 5)).collect()
    root = smallest(range(10), [(r.a, r.b) for r in links])
    assert set(root.values()) == {0} and len(links) < 45


def test_first_of_each_keeps_one_row(spark):
    kept = minhash.first_of_each(spark, table(spark, DOCS))
    assert kept.columns == table(spark, DOCS).columns
    root = brute_components(DOCS, 4)
    want = {(d, t) for d, t in DOCS if d is not None and root[d] == d} | {(None, t) for d, t in DOCS if d is None}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:250], rng.integers(0, 1 << 62, 50).astype(np.uint64)])
    s = textkit.circulant_signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 1024)
    assert abs((s[0] == s[1]).mean() - 250 / 350) < 0.05


def test_words_of_arrow_columns():
    import pyarrow as pa

    texts = [t for _, t in DOCS] + [" nbsp stays inside", "a\x0bb\x0cc\rd\ne"]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.chunked_array([texts[:3], texts[3:]])):
        raw, offsets = textkit.buffers(column)
        start, end, _, rows = textkit.words(raw, offsets, lower=True)
        data = raw.tobytes()
        got = [[data[start[i] : end[i]].decode().translate(str.maketrans("", "")) for i in range(a, b)] for a, b in zip(rows, rows[1:])]
        assert [[w.lower() if w.isascii() else w for w in g] for g in got] == [[w.lower() if w.isascii() else w for w in words(t)] for t in texts]


def test_empty_tables(spark):
    empty = table(spark, [])
    assert minhash.near_duplicates(spark, empty).count() == 0
    assert passages.repeated_passages(spark, empty).count() == 0
    assert linededup.without_repeated_chunks(spark, empty).count() == 0
    assert embeddings.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, x) for x in range(501, 700)] + [(900, 900), (None, 4), (4, None)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest([x for e in edges[:] for x in e if x is not None and x != 900], [e for e in edges if None not in e])
    assert got == want


def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x[100:160] = x[7] + 0.12 * rng.standard_normal((60, 16))
    x[160:200] = x[8] * rng.uniform(0.5, 3, (40, 1))
    x[200:230] = x[9]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] + [0.0] * 14), (404, [float("nan")] * 16),
           (405, [float("inf")] + [0.0] * 15), (406, [1.0, 2.0]), (407, [1.0, 2.0]), (None, rows[9][1])]
    return rows + odd


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = vectors()
    df = table(spark, rows, "vec_id long, embedding array<float>")
    got = embeddings.near_vectors(spark, df, recall=0.9999).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :]
             if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.9]
    root = smallest([i for i, _ in rows if i is not None], links)
    n = {i: 0 for i in root}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {
        i: (n[i], root[i], root[i] == i) for i in root}


def test_tables_grow_with_the_rows():
    for n in (100, 10**5, 10**9):
        k, tables = embeddings.plan_tables(n, 0.9)
        near = embeddings.collision(math.sqrt(0.2), embeddings.WIDTH)
        assert 1 - (1 - near**k) ** tables >= 0.99
        assert n * embeddings.collision(math.sqrt(2), embeddings.WIDTH) ** k <= embeddings.STRANGERS or k == 4


def brute_chunks(text):
    import struct

    import xxhash

    def signed_pair(a, b):
        x = xxhash.xxh64(struct.pack("<Q", a), seed=42).intdigest()
        x = xxhash.xxh64(struct.pack("<Q", b), seed=x).intdigest()
        return x - (1 << 64) if x >> 63 else x

    lines = (text or "").split("\n")
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        if i == len(lines) - 1 or (i >= 1 and signed_pair(h[i - 1], h[i]) % 4 == 0):
            out.append(tuple(now))
            now = []
    return out


def test_line_chunks_against_brute_force(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(4))
    block = [line() for _ in range(14)]
    rows = [(i, "\n".join([line() for _ in range(rng.randrange(4))] + block[rng.randrange(3):] + [line()])) for i in range(30)]
    rows += [(100, "\n".join(block)), (101, "\n".join(block)), (101, "\n".join(block)), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, ""),
             (105, None), (106, "one line"), (107, "one line"), (None, "\n".join(block)), (108, "a\r\nb\r\nc\r\n"),
             (109, "\n".join(line() for _ in range(5000)))]
    rng.shuffle(rows)
    got = linededup.without_repeated_chunks(spark, table(spark, rows)).collect()
    assert len(got) == len(rows)
    holder: dict = {}
    number = lambda d: 1 << 62 if d is None else d
    for d, t in sorted(rows, key=lambda r: number(r[0])):
        for unit, _ in line_units(t):
            holder.setdefault(unit, number(d))
    want = []
    for d, t in rows:
        late, again, stay, seen = set(), set(), set(), set()
        for unit, at in line_units(t):
            (late if holder[unit] < number(d) else again if unit in seen else stay).update(at)
            seen.add(unit)
        lines = (t or "").split("\n")
        lost = late | (again - stay)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in lost)
        want.append((d, kept if lost else t, len(lost), len(lines)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(((r.doc_id, r.text, r["__n_removed"], r["__n_lines"]) for r in got), key=key) == sorted(want, key=key)
    assert got[0].__fields__[: len(table(spark, rows).columns)] == table(spark, rows).columns
    # nothing is lost: every line is left somewhere; and no block of two lines that another document holds is left twice
    texts = [r.text or "" for r in got]
    assert {x for _, t in rows for x in (t or "").split("\n") if x} <= {x for t in texts for x in t.split("\n")}
    for r in got:
        assert sum(s.last - s.first + 1 for s in r["__removed"]) == r["__n_removed"]


def line_units(text):
    """Chunks of two lines or more and pairs of neighbouring lines that are not blank, in order, with their line numbers."""
    at, out = 0, []
    for c in brute_chunks(text):
        if len(c) > 1:
            out.append((("chunk", *c), range(at, at + len(c))))
        at += len(c)
    lines = (text or "").split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
    out += [(("pair", lines[i], lines[j]), range(i, j + 1)) for i, j in zip(filled, filled[1:])]
    return sorted(out, key=lambda u: (u[0][0], u[1][0]))


def test_repeated_blocks_go_whatever_their_borders(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(6))
    blocks = [[line() for _ in range(rng.choice([2, 3, 4, 6]))] for _ in range(12)]
    rows, own = [], {}
    for i in range(60):
        before, after = [line() for _ in range(rng.randrange(1, 5))], [line() for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(before + blocks[i % 12] + after)))
        own[i] = before + after
    by = {r.doc_id: r.text.split("\n") for r in linededup.without_repeated_chunks(spark, table(spark, rows)).collect()}
    assert all(by[i] == (own[i] if i >= 12 else dict(rows)[i].split("\n")) for i in by)


def passage_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, short, edited = text(55), text(20), text(80)
    rows = [(i, " ".join(text(rng.randrange(5, 90)) + shared + text(rng.randrange(0, 60)))) for i in range(1, 25)]
    rows += [(100 + i, " ".join(text(40) + short + text(40))) for i in range(10)]
    rows += [(200, " ".join(text(30) + edited + text(9))), (201, " ".join(text(3) + edited[:40] + ["other"] + edited[41:] + text(30)))]
    rows += [(300, None), (301, ""), (302, "few words"), (None, " ".join(shared)), (303, " ".join(["und"] * 300)), (304, " ".join(["und"] * 200))]
    return rows, " ".join(shared)


def test_passages_are_found_wherever_they_lie(spark):
    rows, shared = passage_rows()
    got = passages.repeated_passages(spark, table(spark, rows)).collect()
    text = dict(rows)
    hit = {r.doc_id for r in got}
    assert {*range(1, 25), 200, 201, 303, 304} == hit
    assert {r.doc_id for r in got if r.removed} == {*range(2, 25), 201, 304}
    for r in got:
        piece = text[r.doc_id][r.start : r.start + r.length]
        assert piece.split() == text[r.doc_id].split()[r.first_word : r.end_word]
        if r.doc_id < 25:
            assert shared in piece
    assert len({r.cluster for r in got if r.doc_id < 25}) == 1
    clean = passages.cleaned(spark, table(spark, [r for r in rows if r[0] is not None]), spark.createDataFrame(got))
    left = {r.doc_id: r.text for r in clean.collect()}
    assert sum(shared in (t or "") for t in left.values()) == 1 and left[300] is None and left[302] == "few words"


def test_passages_that_the_smallest_ids_hold_only_in_part(spark):
    """Extracts and edited copies with smaller ids own the paragraphs, too short to be passages; no 50 words may be left
    in two documents, and one keeps each run."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, at = [], 0
    for n in (55, 60, 90):
        shared = text(n)
        for _ in range(20):
            cut = rng.randrange(n - 40)
            part = shared[cut : cut + rng.randrange(30, 45)]
            rows.append((at := at + 1, " ".join(text(20) + part + text(20))))
        for _ in range(4):
            rows.append((at := at + 1, " ".join(text(15) + shared + text(25))))
    got = passages.repeated_passages(spark, table(spark, rows))
    left = [(r.doc_id, r.text.split()) for r in passages.cleaned(spark, table(spark, rows), got).collect()]
    runs: dict = {}
    for d, w in left:
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(d)
    assert all(len(v) == 1 for v in runs.values())
    assert {r.doc_id for r in got.filter("removed").collect()} >= {22, 23, 24, 46, 47, 48, 70, 71, 72}


def one_pair(x, y):
    import pyarrow as pa

    units = []
    for side in (x, y):
        raw, offsets = textkit.buffers(pa.array([" ".join(side)]))
        units.append(textkit.words(raw, offsets)[2])
    x, y = (passages.paragraphs(u) for u in units)
    return passages.common_passages(*units, x, passages.by_key(y))


def test_every_place_in_the_kept_text_and_gaps_of_any_length():
    rng = random.Random(3)
    text = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    for _ in range(30):
        shared = text(55)  # the first place holds 40 words of it only, the second all
        assert one_pair(text(20) + shared + text(20), text(9) + shared[8:48] + text(30) + shared + text(5)) == [(20, 75, 79, 134)]
    hits = 0
    for _ in range(30):
        long = text(300)  # six words are replaced by others, and two edits are seven words apart
        edited = long[:50] + text(6) + long[56:90] + text(1) + long[91:98] + text(1) + long[99:]
        hits += one_pair(text(10) + edited + text(10), text(30) + long + text(3)) == [(10, 310, 30, 330)]
    assert hits == 30


def test_two_texts_of_one_phrase_need_no_list_of_all_places():
    """About a thousand places each for every key; all pairs of them would take far more memory than the texts."""
    import tracemalloc

    ids = np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = np.tile(ids, 1000), np.tile(ids, 900)
    own, index = passages.paragraphs(x), passages.by_key(passages.paragraphs(y))
    assert len(own[0]) > 500 and len(index[0]) > 2500
    tracemalloc.start()
    got = passages.common_passages(x, y, own, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and max(b - a for a, b, _, _ in got) == len(y) and peak < 16 << 20


def test_paragraphs_of_many_texts_at_once_are_those_of_each():
    rng = np.random.default_rng(7)
    size = [0, 1, 23, 24, 25, 26, 49, 50, 51, 0, 74, 300, 24, 2, 500]
    texts = [rng.integers(1, 1 << 62, n).astype(np.uint64) if n % 2 else rng.integers(1, 6, n).astype(np.uint64) for n in size]
    rows = np.concatenate([[0], np.cumsum(size)])
    for text, (word, found) in zip(texts, passages._each(np.concatenate(texts), rows), strict=True):
        alone = passages.paragraphs(text)
        assert np.array_equal(word, text) and all(np.array_equal(a, b) for a, b in zip(found, alone))
        n = len(text) - passages.PARAGRAPH + 1
        rank = textkit.mix64(textkit.runs(text, passages.SHINGLE)[: max(n, 0)] ^ np.uint64(0xA0761D6478BD642F))
        width = min(max(n, 1), passages.STRETCH)
        want = {i + int(rank[i : i + width].argmin()) for i in range(n - width + 1)} if n > 0 else set()
        assert set(alone[0].tolist()) == want


@pytest.mark.parametrize("block", [3, 256])
def test_a_round_says_which_buckets_have_pairs_left(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    near = list(range(100))
    rows = [(d, 1, [0], 46, near) for d in range(1, 8)] + [(d, 2, [0], 46, near) for d in (1, 2)]
    rows += [(3, 3, [0], 46, near), (4, 3, [0], 46, [x + 1000 for x in near]), (5, 4, [0], 46, near)]
    members = spark.createDataFrame(rows, passages.MEMBERS)
    tried = spark.createDataFrame([(7, 1), (7, 2), (4, 1), (2, 9)], "a long, b long")
    got = {(r.key, r.a): (r.b, r.more) for r in passages.next_pairs(members, tried, 2).collect()}
    assert got == {(1, 2): ([1], False), (1, 3): ([1, 2], False), (1, 4): ([2, 3], False), (1, 5): ([1, 2], True),
                   (1, 6): ([1, 2], True), (1, 7): ([3, 4], True), (2, 2): ([1], False)}
