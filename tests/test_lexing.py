"""Tokens of scripts that are cut into pieces, against the tokens of whole scripts."""

import random

import pytest

from scriptmill.operators import lexing, tokens

BITS = ["'", "''", "\\'", "\\", '"', "`", "/*", "*/", "--", "\n", " ", "a", "select", "1.5", "<=", "${x}", "(", ")", ";", "é", "\t", "''' "]


def scripts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "script_id int, sql string")


def same(a, b):
    return a.dtypes == b.dtypes and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("size", [1, 7, 200])
def test_any_cut_gives_the_same_tokens(spark, size):
    """Random mixtures of marks that open, close, escape and hide each other; most literals are never closed."""
    rng = random.Random(size)
    texts = ["".join(rng.choice(BITS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = scripts(spark, [*texts, None, "", "  \n "])
    assert same(lexing.large_tokens(df, size), tokens.tokens(df))


def test_tokens_of_many_pieces(spark):
    long = ["/* " + "q\n" * 3000 + "*/ select 'it''s' -- " + "z " * 3000 + "\nfrom t; select '" + "a ( ; " * 2000 + "' x;\n(" * 3,
            "x" * 20_000 + " 'y " + "w " * 5000, "`odd\n" + "name " * 3000 + "` \" " + "\\\" " * 2000 + "\" ;"]
    df = scripts(spark, long)
    cut = lexing.pieces(df, 64)
    assert cut.count() > 300 and cut.where("script_id = 1").count() > 100
    assert same(lexing.large_tokens(df, 64), tokens.tokens(df))


def test_pieces_end_behind_white_space(spark):
    rows = lexing.pieces(scripts(spark, ["select  a,\n'b c' from\tt " * 50]), 10).orderBy("piece").collect()
    assert "".join(r.text for r in rows) == "select  a,\n'b c' from\tt " * 50
    assert all(r.text[-1].isspace() and len(r.text) >= 10 for r in rows[:-1])


def test_no_window_over_a_whole_script_of_tokens(spark):
    """Windows over tokens have the piece among their keys; those without it hold one line per piece."""
    rows = lexing.large_tokens(scripts(spark, ["select 1; " * 500]), 100)
    text = rows._jdf.queryExecution().executedPlan().toString()
    over_tokens = [line for line in text.split("\n") if "Window [" in line and "idx" in line]
    assert over_tokens and all("[script_id" in line and "piece" in line for line in over_tokens)
    assert rows.agg({"stmt_no": "max"}).first()[0] == 500


def test_tokens_are_made_behind_the_last_shuffle(spark):
    """What travels is a row per piece; its tokens become rows when the numbers of all earlier pieces are known."""
    rows = lexing.large_tokens(scripts(spark, ["select 'a b', (1); -- c\n`d\ne`;" * 300]), 64)
    text = rows._jdf.queryExecution().sparkPlan().toString()
    assert "Generate posexplode" in text and "Join" not in text[: text.index("Generate posexplode")]
    assert same(rows, tokens.tokens(scripts(spark, ["select 'a b', (1); -- c\n`d\ne`;" * 300])))
