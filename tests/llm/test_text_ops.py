"""Shards, archives, decontamination, quality, token files and packing."""

import random
import zlib

import numpy as np
import pytest
from cases import DOCS, numbered, table
from pyspark.sql import functions as F

from scriptmill.llm import decontam, packing, quality, rans, sharding, tokenfiles, warc
from scriptmill.llm.common import Stored, fresh_folder


def test_shards(spark):
    got = sharding.assign_shards(spark, table(spark, DOCS), 5).collect()
    size = lambda t: len((t or "").encode()) + 8
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    order = sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in DOCS), key=key)
    total, before, want, slots = sum(x[1] for x in order), 0, [], {}
    for d, n, crc in order:
        s = (2 * before + n) * 5 // (2 * total)
        slots[s] = slots.get(s, -1) + 1
        want.append((d, n, crc, "bytes", s, slots[s], None))
        before += n
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sharding.assign_shards(spark, table(spark, []), 5).count() == 0


def test_written_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(200)]
    path = sharding.write_shards(spark, table(spark, rows).drop("shard"), 4)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert back.select("shard").distinct().count() == 4


def test_equal_rows_are_cut_too(spark):
    got = sharding.assign_shards(spark, spark.range(5000).selectExpr("7L AS doc_id", "'same' AS text"), 4)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [1250] * 4


def pages():
    big, small = "<p>" + "é" * 600 + "</p>", "<p>small</p>"
    rows = [(i, f"http://Host{i % 3}.example.org/a?b={i}#f", big) for i in range(6)] + [(10 + i, "https://x.org", small) for i in range(3)]
    rows += [(20, None, None), (21, "", ""), (22, "u:80/é x\n", "WARC/1.1\r\n\r\n\x00" + "q" * 2000), (23, "same", "z" * 5000),
             (23, "same", "z" * 5000), (24, "same", "z" * 4999), (None, "n", big), (30, "big", random.Random(1).randbytes(9_000_000).hex())]
    return rows


def test_archives_round_trip(spark):
    rows = pages()
    df = table(spark, rows, "page_id long, url string, html string")
    path = fresh_folder(spark)
    got = warc.archive(spark, df, path=path).collect()
    import hashlib

    top: dict = {}
    for i, _, h in rows:
        if i is not None:
            top[h] = max(top.get(h, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = top.get(h) if len(b) >= 1000 and i is not None and i < top[h] else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    back = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in back if r.payload is not None), key=str) == sorted(
        ((i, (h or "").encode()) for (i, _, h), w in zip(rows, want) if w[3] == "response"), key=str)
    ordered = sorted(got, key=lambda r: r.capture_number)
    assert [r.capture_number for r in ordered] == list(range(len(rows)))
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in got)
    assert all((a.url_key, a.date) <= (b.url_key, b.date) for a, b in zip(ordered, ordered[1:]))
    # every line of the index leads to its record
    files = {r.path: r.content for r in spark.read.format("binaryFile").load(path).collect()}
    for r in got:
        record = zlib.decompress(files[r.file][r.offset : r.offset + r.length] if r.length < 1 << 24 else files[r.file][r.offset:], 31)
        assert record.startswith(b"WARC/1.1\r\n") and (f"<urn:page:{r.page_id if r.page_id is not None else ''}>").encode() in record
    assert warc.archive(spark, table(spark, [], "page_id long, url string, html string")).count() == 0


def test_large_members_end_with_zero():
    payload = random.Random(2).randbytes(17 << 20)
    data = warc._member(1, "u", "2024-01-01T00:00:00Z", payload, None) + b"\0"
    (at, length, record), = warc._windowed(memoryview(data))
    assert at == 0 and payload in record
    (at, length, record), = warc.members(data)
    assert payload in record


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(30))) for _ in range(k)]
    taken = list(warc.LoserTree(runs).take())
    assert [runs[r][i] for r, i in taken] == sorted(x for r in runs for x in r)
    assert len(set(taken)) == sum(map(len, runs))


def test_surt():
    assert warc.surt("HTTP://user@WWW.Example.com:80/A?q=1#x") == "com,example,www)/A?q=1"
    assert warc.surt("x.org:8080") == "org,x:8080)/" and warc.surt(None) == ")/"


ITEMS = [
    (0, "Then the old baker sold 12 loaves to Maria for 3 dollars each, and 12 rolls to Paul at the corner of the market square."),
    (1, "short item of six words"), (2, None), (3, ""), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
    (5, " ".join(numbered("token", 0)) + " every window of this item is made of plain words that never change at all in any way"),
]


def test_leaks(spark):
    item, plain = ITEMS[0][1], ITEMS[5][1]
    docs = [
        (1, "Some words before. " + item + " And after."), (2, item.upper().replace(",", " ;")),
        (3, "Noise here. " + item.replace("12", "75").replace("Maria", "Lucy").replace("Paul", "Erik").replace("3", "9")),
        (4, "Noise here. " + item.replace("12 loaves", "75 loaves").replace("12 rolls", "80 rolls")),  # 12 is replaced in two ways
        (5, "one 2 three 4 five 6 seven"), (6, "7 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (7, "Short item, of six words!"),
        (8, "a short item of six words inside"), (9, None), (10, ""), (None, plain), (11, plain[: len(plain) // 4]), (12, plain), (12, plain),
        (13, "every window of this thing is made of other words " * 4000), (14, "x" + plain.replace("plain", "fancy")),
        (15, "noise " + item.title()), (16, "short item of seven words, an item of six words"),
    ]
    got = decontam.contaminated(spark, table(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"))
    found = sorted(((r.doc_id, r.item_id, r.kind) for r in got.collect()), key=str)
    assert found == sorted([(1, 0, "verbatim"), (2, 0, "verbatim"), (3, 0, "re-parameterised"), (7, 1, "verbatim"),
                            (None, 5, "verbatim"), (12, 5, "verbatim"), (14, 5, "verbatim"), (6, 4, "verbatim"),
                            (8, 1, "verbatim"), (15, 0, "verbatim")], key=str)
    left = decontam.without_leaks(spark, table(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == table(spark, docs).columns
    assert {4, 5, 9, 10, 11, 13, 16} <= {r.doc_id for r in left.collect()} and not {1, 2, 3, 6, 7, 8, 12, 14, 15, None} & {r.doc_id for r in left.collect()}
    for a, b in ((docs, []), ([], ITEMS)):
        assert decontam.contaminated(spark, table(spark, a), spark.createDataFrame(b, "item_id long, text string")).count() == 0


def longest_copies(item, text):
    """Length of the longest stretch of tokens that both have."""
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0] + [row[j] + 1 if a == b else 0 for j, b in enumerate(text)]
        best = max(best, *row)
    return best


def test_copies_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["Anna", "Bob", "Rome", "7", "12", "3.5", "km", "sold", "ran", "the", "of"])
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 6, 7, 8, 12, 16, 25])))) for i in range(25)]
    docs = []
    for i in range(120):
        w = items[rng.randrange(25)][1].split()
        a = rng.randrange(3)
        w = w[a : len(w) - rng.randrange(4)]
        t = " ".join([word() for _ in range(rng.randrange(12))] + w + [word() for _ in range(rng.randrange(12))])
        docs.append((i, [t, t.upper(), t.title(), t.lower()][i % 4]))
    got = decontam.contaminated(spark, table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got if r.kind == "verbatim"}
    cut = spark.createDataFrame([*docs, *((1000 + i, t) for i, t in items)], "i long, t string").select(
        "i", decontam.template_tokens(F.col("t")).alias("t")).collect()
    tokens = {r.i: [x.lstrip("\u0001\u0002\u0003") for x in r.t] for r in cut}
    want = set()
    for i, _ in items:
        it = tokens[1000 + i]
        least = len(it) if len(it) < 8 else max(8, min(13, -(-len(it) * 4 // 5)))
        want |= {(d, i) for d, _ in docs if longest_copies(it, tokens[d]) >= least}
    assert len(want) > 20 and want <= found


def test_template_slots(spark):
    row = spark.createDataFrame([("Today Anna paid $5.50 for 3 kg, then 10% more. Bob left",)], "text string").select(
        decontam.template_tokens(F.col("text")).alias("t")).first()
    assert row.t == ["today", "\u0002anna", "paid", "\u0001$5.50", "for", "\u00013", "\u0003kg", "then", "\u000110", "\u0003%", "more",
                     "bob", "left"]


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 80)))
    rows = [(i, good() if i % 3 else " ".join(w.upper() + "!!" for w in good().split())) for i in range(600)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 500)] + [(700, None), (None, 1), (3, 0), (3, 0)]
    docs = rows + [(800, None), (801, ""), (None, "plain words"), (802, "word " * 50_000), (4, rows[4][1])]
    out = quality.with_scores(spark, table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = out.collect()
    assert len(got) == len(docs) and out.columns[: len(table(spark, docs).columns)] == table(spark, docs).columns
    by = {r.doc_id: r for r in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(by[i]["__predicted"] == int(i % 3 > 0) for i in held) / len(held) > 0.97
    assert all(0 <= r["__score"] <= 1 for r in got)
    flags = table(spark, rows, clashing=False).select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    assert {r.doc_id for r in flags.collect() if r.h} == set(held)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = [(i, f"text {i} " + ("!! " * 5 if i % 2 else "fine ")) for i in range(60)]
    base = [(i, 1 - i % 2) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in base]
    score = lambda ls: [r["__score"] for r in quality.with_scores(
        spark, table(spark, docs), spark.createDataFrame(ls, "doc_id long, quality int")).orderBy("doc_id").collect()]
    assert score(base) == score(turned)


def test_no_labels_or_one_class(spark):
    for labels in ([], [(1, 1), (2, 1), (3, 1)]):
        out = quality.with_scores(spark, table(spark, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert {r["__score"] for r in out} == {0.5} and len(out) == len(DOCS)
    assert quality.with_scores(spark, table(spark, []), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1000, 5000, 300_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.geometric(0.002, n), 50256).astype(np.uint32)
    tokens[: n // 3] = 7
    table_ = rans.Table.load(rans.Table.of(tokens).dump())
    assert int(table_.freq.sum()) == 1 << rans.SCALE and table_.freq.min() > 0
    block = rans.encode_block(tokens, table_)
    assert np.array_equal(rans.decode_block(block, table_, table_.slots()), tokens)
    lanes = min(rans.LANES, n)
    for point in range(-(-(-(-n // lanes)) // rans.CHECK)):  # every checkpoint is a place to begin, and to end
        first = point * rans.CHECK * lanes
        part = rans.decode_block(block, table_, table_.slots(), point, 1)
        assert np.array_equal(part, tokens[first : first + rans.CHECK * lanes])
    if n > 5000:
        p = np.bincount(tokens)[np.unique(tokens)] / n
        assert len(block) * 8 < 1.12 * n * -(p * np.log2(p)).sum() + 64 * lanes * 4
    with pytest.raises(ValueError):
        rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), table_, table_.slots())


def test_many_rare_ids_fit_the_table():
    tokens = np.concatenate([np.arange(50_000), np.zeros(1_000_000, int)]).astype(np.uint32)
    t = rans.Table.of(tokens)
    assert int(t.freq.sum()) == 1 << rans.SCALE and t.freq.min() >= 1


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = fresh_folder(spark)
    got = tokenfiles.token_files(spark, table(spark, DOCS), path, path=folder).collect()
    tok = Tokenizer.from_file(path)
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    want, at = [], 0
    for d, t in sorted(DOCS, key=key):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    ids = {(r.file_no, r.seq): r.ids for r in tokenfiles.read_tokens(spark, folder, with_ids=True).collect()}
    assert sum(map(len, ids.values())) == at
    assert tokenfiles.token_files(spark, table(spark, []), path).count() == 0


def test_pieces_encode_like_whole_texts(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = tokenfiles.Encoder(f.read())
    tok, rng = Tokenizer.from_file(path), random.Random(11)
    monkeypatch.setattr(tokenfiles, "_SEGMENT", 40)  # long texts are cut too
    parts = ["a", "The", "don't", " ", "  ", "\n", "\n\n", "é", "ß", ",", ".", "!", "?", "'s", "1", "23", "²", "\t", "<|endoftext|>",
             "x" * 60, "$", "(", ")", "-", "😀", "'", '"', ":", "\x00", "中文", "\x1f", " ", " "]
    for _ in range(600):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3)]
        ids, sizes = encoder.encode(pa.array(texts), 2)
        want = [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    # a collision of hashes is noticed
    encoder.place[:] = 0
    ids, _ = encoder.encode(pa.array(["The quick brown fox."]), 2)
    assert ids.tolist() == [*tok.encode("The quick brown fox.", add_special_tokens=False).ids, 2]


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in bins if b[0] >= sizes[i] and (sources[i] < 0 or sources[i] not in b[1]) and clusters[i] not in b[2]]
        b = min(fits, key=lambda b: b[0], default=None)
        if b is None:
            b = [capacity, set(), set(), len(bins)]
            bins.append(b)
        b[0] -= sizes[i]
        b[1].add(sources[i])
        b[2].add(clusters[i])
        out[i] = b[3]
    return bins, out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(8)
    sizes, sources, clusters = rng.integers(1, 100, 400), rng.integers(-1, 12, 400), rng.integers(0, 350, 400)
    got = packing.best_fit(sizes, sources, clusters, 128)
    bins, want = plain_best_fit(sizes.tolist(), sources.tolist(), clusters.tolist(), 128)
    assert abs(len(set(got.tolist())) - len(bins)) <= 2
    room = np.bincount(got, sizes)
    assert room.max() <= 128
    for b in set(got.tolist()):
        inside = np.flatnonzero(got == b)
        s = sources[inside][sources[inside] >= 0]
        assert len(set(s.tolist())) == len(s) and len(set(clusters[inside].tolist())) == len(inside)


@pytest.mark.parametrize("kinds", [12, 65, 500])
def test_best_fit_is_exact_with_any_number_of_sources(kinds):
    rng = np.random.default_rng(kinds)
    n = 1500
    sizes, sources, clusters = rng.integers(1, 12, n), rng.integers(-1, kinds, n), rng.integers(0, 400, n)
    got = packing.best_fit(sizes, sources, clusters, 900)
    bins = []
    for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
        fits = [b for b in bins if b[0] >= sizes[i] and (sources[i] < 0 or sources[i] not in b[1]) and clusters[i] not in b[2]]
        if not fits:
            fits = [[900, set(), set(), len(bins)]]
            bins.append(fits[0])
        tight = min(b[0] for b in fits)
        assert got[i] < len(bins) and bins[got[i]][0] == tight and any(b[3] == got[i] for b in fits)
        b = bins[got[i]]
        b[0] -= sizes[i]
        b[1].add(sources[i])
        b[2].add(clusters[i])


def test_short_pieces_make_more_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    got = packing.pack(spark, spark.range(1000).selectExpr("id AS doc_id", "'x' AS text", "string(id % 6) AS source")).collect()
    assert len({r.bin_id >> 32 for r in got}) == 10 and len(got) == 1000


def test_packing(spark):
    rows = [(d, t, f"s{i % 4}" if i % 5 else None) for i, (d, t) in enumerate(DOCS)]
    df = table(spark, rows, "doc_id long, text string, source string")
    got = packing.pack(spark, df, capacity=512, group_chars=100_000).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r.doc_id, r.text_key), []).append(r)
    assert sum(r.length for r in got) == sum(len(t or "") for _, t in DOCS)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_place)
        assert [r.bin_place for r in rs] == list(range(len(rs)))
        assert all(a.bin_start + a.length + 1 == b.bin_start for a, b in zip(rs, rs[1:]))
        assert rs[-1].bin_start + rs[-1].length + 1 <= 512
        assert len({r.doc_id for r in rs if r.doc_id is not None}) == len([r for r in rs if r.doc_id is not None])
    assert packing.pack(spark, table(spark, [], "doc_id long, text string, source string")).count() == 0
    texts = packing.packed_texts(df, packing.pack(spark, df, capacity=512)).collect()
    assert sum(len(r.text) for r in texts) >= sum(r.length + 1 for r in got)


def test_intermediate_tables_go(spark):
    store = Stored(spark)
    kept = store.keep(spark.range(3))
    assert kept.count() == 3
    store.drop()
    from py4j.protocol import Py4JJavaError  # noqa: F401

    with pytest.raises(Exception):
        spark.read.parquet(store.paths[0]).count()
