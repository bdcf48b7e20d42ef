"""Base counts and common lines against plain Python."""

import random
from collections import defaultdict

import pytest
from cases import DOCS, numbered, table

from scriptmill.llm import linerules

SCHEMA = "doc_id long, text string, source string"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def normal(line):
    lower = "".join(c.lower() if "A" <= c <= "Z" else "0" if "1" <= c <= "9" else c for c in line)
    return " ".join(words(lower))


def base(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    twice = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(twice)


def brute(rows, docs, share):
    texts, held = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if words(line):
                texts[host].add(text)
                held[host, normal(line)].add(text)
    common = {k for k, v in held.items() if len(v) > docs and 100 * len(v) > share * len(texts[k[0]])}
    out, clean = [], {}
    for d, text, host in rows:
        n, chars, symbols, dup, repeated = base(text)
        lines = (text or "").split("\n")
        left = sum(len(words(x)) for x in lines if (host, normal(x)) not in common)
        failed = n < 10 or 100 * repeated > 20 * n
        kept = not failed and left >= 10 and 100 * left >= linerules.LEFT_SHARE * n
        out.append((d, n, chars, symbols, dup, repeated, left, failed, kept))
        clean[text, host] = [x for x in lines if not words(x) or (host, normal(x)) not in common]
    return out, clean


def corpus():
    rng = random.Random(4)
    rows = [(d, t, "mixed") for d, t in DOCS]
    for i in range(60):
        own = [" ".join(rng.choice(numbered("x", 400)) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 4))]
        shared = ["All rights reserved 2024 by the Owner", "all  RIGHTS reserved 1999 by the owner", "#1 | <b> 50% off & more"][: i % 4]
        lines = own + shared
        rng.shuffle(lines)
        rows.append((100 + i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None])))
    rows += [(300 + i, "one text of many copies holds these ten words or more\nand this line", "b") for i in range(40)]
    rows += [(400, "a b c d e f g h i j " * 2, "a"), (401, "a b c d e " + " ".join(numbered("y", 30)) + " a b c d e", "a")]
    rows += [(402, "same\nsame\n same\nsame\n\n\n", "a"), (403, "\n" * 50, "a"), (404, "über ß 中文 " * 3 + "\r\n\x0b\x0c end é", "a")]
    return rows


@pytest.mark.parametrize(("docs", "share"), [(3, 1), (2, 40)])
def test_rows_are_brute_force(spark, docs, share):
    rows = corpus()
    got = linerules.line_rules(spark, table(spark, rows, SCHEMA), texts=docs, share=share)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "base_failed", "kept"]
    want, _ = brute(rows, docs, share)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[-1] for r in want if not r[-2]} == {True, False}


def test_texts_without_common_lines(spark):
    rows = corpus()
    df = table(spark, rows, SCHEMA)
    out = linerules.without_common_lines(spark, df, texts=3)
    assert out.columns == df.columns
    want, clean = brute(rows, 3, 1)
    kept = [(r[0], r[1], r[2]) for r, w in zip(rows, want) if w[-1]]
    got = {(r.doc_id, r.source): r.text for r in out.collect()}
    assert set(got) == {(d, h) for d, _, h in kept} and out.count() == len(kept)
    for d, text, host in kept:
        assert words(got[d, host]) == words("\n".join(clean[text, host])), d
    assert any(got[d, h] != t for d, t, h in kept)


def test_tables_that_do_not_fit_a_broadcast(spark, monkeypatch):
    rows = corpus()
    want = sorted(map(tuple, linerules.line_rules(spark, table(spark, rows, SCHEMA), texts=3).collect()), key=str)
    monkeypatch.setattr(linerules, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, linerules.line_rules(spark, table(spark, rows, SCHEMA), texts=3).collect()), key=str) == want


def test_empty_table(spark):
    assert linerules.line_rules(spark, table(spark, [], SCHEMA)).count() == 0
    assert linerules.without_common_lines(spark, table(spark, [], SCHEMA)).count() == 0
