"""Spelling variants: generated edits of every word are probed against length-sharded blocked Bloom filters of the vocabulary;
only positives are shuffled, to an exact join."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, ready

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
# Filters: words per 64-bit block, bits set per word, and bytes that one broadcast may hold. Filters beyond it are split by
# hash into parts, and each part is broadcast in a round of its own.
PER_BLOCK, BITS, FILTER_BYTES = 4, 4, 32 << 20
# Hashes of edits that are worked on at once, and words whose edits one task probes.
SLICE, TASK_WORDS = 1 << 20, 20_000

_STEP, _STEP_INVERSE = textkit._P, textkit._P_INVERSE
_LETTER = textkit.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_counts(docs: DataFrame, least: int, drop_one_in: int) -> DataFrame:
    """word and n: runs of letters of all texts in lower case (A-Z), of ``least`` code points or more. In one of
    ``drop_one_in`` pairs of document and run (by the CRC-32 of ``id:run``; 0: in none) the run loses a letter. Each batch
    is counted before its words leave the task."""
    letters = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def counts(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in textkit.batched(batches):
            total: Counter = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    mine = Counter(letters.findall(text.lower().decode()))  # of bytes, lower() changes A-Z only
                    if drop_one_in and doc is not None:
                        start = zlib.crc32(b"%d:" % doc)
                        for word in [w for w in mine if zlib.crc32(w.encode(), start) % drop_one_in == 0]:
                            at = zlib.crc32(word.encode(), start) % len(word)
                            n = mine.pop(word)
                            if len(word) > least:
                                total[word[:at] + word[at + 1 :]] += n
                    total.update(mine)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(word: str) -> np.ndarray:
    """Code points, all below 256."""
    return np.frombuffer(word.encode("latin-1"), np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return textkit._power("up", n)[:n], textkit._power("down", n)[:n]


def word_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Polynomials of the letters, mixed with the lengths: the hash of an edit follows from that of the word."""
    total = np.array([(_LETTER[w] * _powers(len(w))[0]).sum(dtype=np.uint64) for w in words], np.uint64)
    return textkit.mix64(total + np.array([len(w) for w in words], np.uint64))


def edit_hashes(word: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and hashes of the words that the word becomes by deleting one letter, or by replacing one by a smaller one
    of the (sorted) alphabet, in slices. Insertions and other replacements are these edits seen from the other word."""
    n = len(word)
    up, _ = _powers(n)
    terms = _LETTER[word] * up
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=before[1:])
    total = before[-1]
    first = np.ones(n, bool)
    first[1:] = word[1:] != word[:-1]  # of equal letters side by side one deletion is enough
    at = np.flatnonzero(first)
    yield n - 1, textkit.mix64(before[at] + (total - before[at + 1]) * _STEP_INVERSE + np.uint64(n - 1))
    step = max(1, SLICE // max(1, len(alphabet)))
    value = _LETTER[alphabet]
    for a in range(0, n, step):
        part = word[a : a + step]
        changed = (total - terms[a : a + step])[:, None] + value[None, :] * up[a : a + step, None]
        yield n, textkit.mix64(changed[alphabet[None, :] < part[:, None]] + np.uint64(n))


def _masks(hashes: np.ndarray) -> np.ndarray:
    """The bits of a block that a hash sets."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(BITS):
        out |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _blocks(hashes: np.ndarray, n_blocks: np.ndarray | int) -> np.ndarray:
    """The block of a hash among ``n_blocks``: its upper 32 bits as a fraction."""
    return ((hashes >> np.uint64(32)) * np.asarray(n_blocks, np.uint64)) >> np.uint64(32)


def hashed(vocabulary: DataFrame) -> DataFrame:
    """Rows (word, n) as hash, length, word, n."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = [_letters(w) for w in batch.column(0).to_pylist()]
            h = word_hashes(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array([len(w) for w in words], pa.int32()), batch.column(0), batch.column(1)],
                ["hash", "length", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(add, "hash long, length int, word string, n long")


def filters(vocabulary: DataFrame, lengths: dict[int, int], part: int, parts: int) -> dict[int, np.ndarray]:
    """Per word length the blocks of its filter, of the hashes with this part. Blocks are put together in Spark; what comes
    back is one 64-bit number per block, of which there are as many as the caller has bounded."""
    sizes = {n: -(-count // (PER_BLOCK * parts)) for n, count in lengths.items()}
    here = F.pmod(F.xxhash64("hash"), F.lit(parts)) == part

    def bits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            length = np.asarray(batch.column(1))
            block = _blocks(h, np.array([sizes[n] for n in length.tolist()], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(block.view(np.int64)), pa.array(_masks(h).view(np.int64))],
                                             ["length", "block", "mask"])

    rows = vocabulary.filter(here).select("hash", "length").mapInArrow(bits, "length int, block long, mask long")
    blocks = rows.groupBy("length", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    length, block = np.asarray(blocks.column("length")), np.asarray(blocks.column("block"))
    mask = np.asarray(blocks.column("mask")).view(np.uint64)
    out = {}
    for n, size in sizes.items():
        out[n] = np.zeros(size, np.uint64)
        mine = length == n
        out[n][block[mine]] = mask[mine]
    return out


def positives(spark: SparkSession, vocabulary: DataFrame, lengths: dict[int, int], alphabet: np.ndarray) -> DataFrame:
    """Pairs (edit, source) of hashes: edits of words that the filters may hold. A part of the filters is used for the
    hashes of that part only, so every edit is probed once."""
    total = sum(8 * -(-count // PER_BLOCK) for count in lengths.values())
    parts = max(1, -(-total // FILTER_BYTES))
    # Words are few bytes and many edits: tasks follow from their number.
    words = vocabulary.select("word", "hash").repartition(max(1, -(-sum(lengths.values()) // TASK_WORDS)), "hash")
    found = None
    for part in range(parts):
        held = spark.sparkContext.broadcast(filters(vocabulary, lengths, part, parts))

        def probe(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                edits, sources = [], []
                for word, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for length, h in edit_hashes(_letters(word), alphabet):
                        blocks = held.value.get(length)
                        if blocks is not None:
                            mask = _masks(h)
                            hit = h[(blocks[_blocks(h, len(blocks))] & mask) == mask]
                            edits.append(hit)
                            sources.append(np.full(len(hit), source, np.int64))
                    if sum(map(len, edits)) > SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(edits).view(np.int64)), pa.array(np.concatenate(sources))],
                                                         ["edit", "source"])
                        edits, sources = [], []
                if edits:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(edits).view(np.int64)), pa.array(np.concatenate(sources))],
                                                     ["edit", "source"])

        rows = words.mapInArrow(probe, "edit long, source long")
        if parts > 1:
            rows = rows.filter(F.pmod(F.xxhash64("edit"), F.lit(parts)) == part)
        found = rows if found is None else found.unionByName(rows)
    return found


def near_words(spark: SparkSession, vocabulary: DataFrame) -> DataFrame:
    """Pairs (word, near, near_n) of a stored table (hash, length, word, n), in both directions: words that differ by one
    inserted, deleted or replaced letter. False positives of the filters find no word with their hash, and what has the
    hash is compared as text."""
    lengths = {r.length: r.m for r in vocabulary.groupBy("length").agg(F.count(F.lit(1)).alias("m")).collect()}
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c <> ''")
    alphabet = np.sort(np.array([ord(r.c) for r in letters.collect()], np.uint8))  # 90 letters at most
    probes = positives(spark, vocabulary, lengths, alphabet)
    edit = vocabulary.select(F.col("hash").alias("edit"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    source = vocabulary.select(F.col("hash").alias("source"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    links = probes.join(edit, "edit").join(source, "source").filter(F.levenshtein("a", "b", 1) == 1)
    links = links.select("a", "a_n", "b", "b_n").distinct()
    return links.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("l")).select("l.*")


def with_roots(store: Stored, words: DataFrame, largest: int, least: int, times: int) -> DataFrame:
    """Add ``root``, the end of the chain of forms of each word. Counts grow by ``times`` from link to link, which bounds
    the chains; every round doubles the steps that have been taken."""
    links = max(1, math.ceil(math.log(max(2, largest / least), max(2, times))))
    now = store.keep(words.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(max(1, math.ceil(math.log2(links + 1)))):
        step = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = store.keep(now.join(step, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root")))
    return words.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      length: int = LEAST_LENGTH, least: int = LEAST_COUNT, times: int = TIMES, drop_one_in: int = 0) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in lower case (A-Z only), of ``length`` code points or more and
    with ``least`` places in all texts. Two are near if they differ by one inserted, deleted or replaced code point. The
    form of a word is the near word with the largest n (of several the smallest one) if that is ``times`` its own, else
    null; its root is the last word of the chain of forms. ``drop_one_in`` plants variants (``word_counts``).

    Nulls: null and empty texts have no words; texts without an id count, but nothing is planted in them. Repeated rows
    count as often as they occur. An empty table gives an empty result; other columns are ignored, whatever their names."""
    ready(spark)
    store = Stored(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    vocabulary = store.keep(hashed(word_counts(rows, length, drop_one_in).filter(F.col("n") >= least)))
    near = near_words(spark, vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    words = vocabulary.select("word", "n").join(near, "word", "left").withColumn("best_n", -F.col("best.down"))
    chosen = F.col("best_n") >= F.col("n") * times
    words = store.keep(words.select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("best_n")).alias("form_n")))
    largest = words.agg(F.max("n")).first()[0] or least
    return with_roots(store, words, largest, least, times).select("word", "form", "root", "n", "n_near", "form_n")
