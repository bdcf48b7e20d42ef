"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import DOCS, LOWER, table

from scriptmill.llm import spelling


def counts(rows, planted):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            if d is not None and planted and (h := zlib.crc32(f"{d}:{run}".encode())) % planted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, planted=0):
    n = counts(rows, planted)
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n.get(form[w])))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéßÿ×") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    rows = [(i, t) for i, t in DOCS if len(t or "") < 100_000]
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.choice([3, 8, 25])])
            if rng.random() < 0.3:
                k, c = rng.randrange(len(w)), rng.choice("abcÀé")
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words.append(w.upper() if w.isascii() and rng.random() < 0.1 else w)
        rows.append((1000 + i, rng.choice([" ", ", ", "\n", "中"]).join(words)))
    rows += [(None, "Straße straße " * 3), (2, "abbbbbb " * 40 + "abbbbb " * 7 + "abbbbbbb " * 300)]
    return rows


def test_rows_are_brute_force(spark):
    rows = corpus()
    for planted in (0, 7):
        got = spelling.spelling_variants(spark, table(spark, rows), drop_one_in=planted)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = brute(rows, planted)
        assert sorted(map(tuple, got.collect())) == want
        assert len(want) > 300 and any(r[1] and r[2] != r[1] for r in want)


def test_filters_in_parts(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    monkeypatch.setattr(spelling, "FILTER_BYTES", 256)
    monkeypatch.setattr(spelling, "SLICE", 200)
    assert sorted(map(tuple, spelling.spelling_variants(spark, table(spark, rows)).collect())) == want


def test_long_words(spark):
    """Words of thousands of letters are probed like others; hashes are shuffled, never the edits themselves."""
    long = "abcdefghij" * 700
    rows = [(1, f"{long} {long[:50]}x{long[51:]} {long[1:]} ") ] * 6 + [(2, f"{long} " * 60)]
    got = {r.word: r for r in spelling.spelling_variants(spark, table(spark, rows)).collect()}
    assert len(got) == 3 and got[long].n == 66 and got[long].n_near == 2 and got[long].form is None
    assert all(r.form == long == r.root for w, r in got.items() if w != long)


def test_hash_of_an_edit_is_the_hash_of_the_word():
    rng = random.Random(6)
    alphabet = spelling._letters("abcéÿ")
    for _ in range(200):
        w = "".join(rng.choice("abcéÿ") for _ in range(rng.randint(1, 12)))
        got = {int(h) for _, hashes in spelling.edit_hashes(spelling._letters(w), alphabet) for h in hashes}
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abcéÿ" if c < w[i]}
        assert got == {int(h) for h in spelling.word_hashes([spelling._letters(e) for e in edits])}


def test_filter_holds_its_words_and_few_others():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    blocks = np.zeros(len(h) // spelling.PER_BLOCK, np.uint64)
    np.bitwise_or.at(blocks, spelling._blocks(h, len(blocks)).astype(np.int64), spelling._masks(h))
    other = rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
    hit = lambda x: (blocks[spelling._blocks(x, len(blocks)).astype(np.int64)] & spelling._masks(x)) == spelling._masks(x)
    assert hit(h).all() and hit(other).mean() < 0.02


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, ""), (None, "a b c")]):
        assert spelling.spelling_variants(spark, table(spark, rows), drop_one_in=199).count() == 0
