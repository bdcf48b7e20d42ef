"""The trigram index against plain substring search."""

import random

import pytest

from scriptmill.operators import trigrams


@pytest.mark.parametrize("parts", [1, 16])
def test_search_is_substring_search(spark, tmp_path, parts, monkeypatch):
    rng = random.Random(parts)
    letter = lambda n: "".join(rng.choice("abé中 \n😀%_") for _ in range(n))
    texts = {i: letter(rng.randint(0, 60)) for i in range(200)} | {900: None, 901: "", 902: "ab", 903: "abab" * 500, 904: "x" * 3000}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    folder = str(tmp_path / "index")
    trigrams.write_index(df, "id", "t", folder, parts)
    patterns = [letter(rng.randint(3, 5)) for _ in range(40)] + ["abababab", "xxx", "x" * 50, "b" + "ab" * 30, "nowhere", "中😀a", "%_a"]
    for limit in (1_000_000, 0):
        monkeypatch.setattr(trigrams, "CANDIDATES", limit)
        got = sorted((r.pattern, r.key) for r in trigrams.search(spark, folder, patterns, parts).collect())
        assert got == sorted((p, i) for p in set(patterns) for i, t in texts.items() if t and p in t)
    assert any(p in t for p in patterns for t in texts.values() if t)


def test_only_folders_of_the_patterns_are_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "id long, t string")
    folder = str(tmp_path / "index")
    trigrams.write_index(df, "id", "t", folder, 32)
    used = set()
    plain = spark.read.parquet(f"{folder}/grams")
    assert plain.select("part").distinct().count() > 8
    out = trigrams.search(spark, folder, ["number 7"], 32)
    used = {f.split("part=")[1].split("/")[0] for f in out.inputFiles() if "part=" in f}
    assert [r.key for r in out.collect()] == [7] and len(used) <= 32
    assert "PartitionFilters: [part" in out._jdf.queryExecution().executedPlan().toString()


def test_awkward_patterns(spark, tmp_path):
    folder = str(tmp_path / "index")
    trigrams.write_index(spark.createDataFrame([(1, "abc")], "id long, t string"), "id", "t", folder)
    assert trigrams.search(spark, folder, []).count() == 0
    assert [tuple(r) for r in trigrams.search(spark, folder, ["abc", "abc"]).collect()] == [("abc", 1)]
    with pytest.raises(ValueError):
        trigrams.search(spark, folder, ["ab"])


def test_index_has_one_row_for_the_texts_of_a_trigram(spark, tmp_path):
    """Places are gathered where the texts are read, so a row holds those of many texts and none is shuffled."""
    folder = str(tmp_path / "index")
    trigrams.write_index(spark.range(0, 300, 1, 1).selectExpr("id", "concat('same text ', id) AS t"), "id", "t", folder, 4)
    rows = spark.read.parquet(f"{folder}/grams").where("gram = 'ame'").collect()
    assert len(rows) == 1 and rows[0].n == 300 and sorted(rows[0]["keys"]) == list(range(300)) and rows[0].positions == [1] * 300


def test_repeated_keys_texts_of_other_keys_and_no_texts(spark, tmp_path):
    texts = spark.createDataFrame([("a", "abc abc"), ("a", "abc abc"), ("b", "xabc"), (None, "abc"), ("c", "ab")], "id string, t string")
    trigrams.write_index(texts, "id", "t", str(tmp_path / "some"))
    assert sorted((r.key or "") for r in trigrams.search(spark, str(tmp_path / "some"), ["abc"]).collect()) == ["", "a", "b"]
    trigrams.write_index(texts.where("id = 'c'"), "id", "t", str(tmp_path / "none"))
    assert trigrams.search(spark, str(tmp_path / "none"), ["abc"]).count() == 0
