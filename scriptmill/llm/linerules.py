"""Quality rules: word and repetition counts of a text, and lines that many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, ready

# Base rules: fewest words, and the percentage of words in repeated windows of WINDOW words that is too much.
LEAST_WORDS, WINDOW, REPEATED = 10, 5, 20
# A line is common on a host if more than COMMON_DOCS of its documents and more than COMMON_SHARE per cent of them hold it.
COMMON_DOCS, COMMON_SHARE = 10, 1
# A document is depleted if less than this percentage of its words, or fewer than LEAST_WORDS, are outside common lines.
LEFT_SHARE = 30
# Rows (about 32 bytes each) that a broadcast may hold; with more, the same join shuffles.
BROADCAST_ROWS = 500_000

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NORMAL = textkit._LOWER.copy()
_NORMAL[ord("1") : ord("9") + 1] = ord("0")

LINES = "array<struct<h:long,w:int>>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sum of the flags between every two neighbouring offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[cut])


def _keyed(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash for a row and a hash in it."""
    return textkit.mix64(hashes + textkit.mix64(owner.astype(np.uint64) + np.uint64(1)))


def repeated_words(word: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per row, the words inside windows of WINDOW words that occur twice or more in the row."""
    window = textkit.runs(word, WINDOW)
    if not len(window):
        return np.zeros(len(rows) - 1, np.int64)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = np.flatnonzero(np.arange(len(window)) + WINDOW <= rows[owner[: len(window)] + 1])
    _, same, count = np.unique(_keyed(owner[inside], window[inside]), return_inverse=True, return_counts=True)
    first = inside[count[same] > 1]
    step = np.zeros(len(word) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + WINDOW, -1)
    return _per_row(np.cumsum(step)[:-1] > 0, rows)


def lines_of(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word: first byte, end, number of the first word, row. Words are given by their first bytes."""
    begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
    line = np.searchsorted(begin, start, side="right") - 1
    first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    at = line[first]
    stop = np.append(begin, len(raw))[at + 1]
    row = np.searchsorted(offsets, begin[at], side="right") - 1
    return begin[at], stop - (raw[stop - 1] == 10), first, row


def line_hashes(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the normal form of every line (words by one space, A-Z in lower case, digits as 0), and its words."""
    _, _, word, _ = textkit.words(_NORMAL[raw], offsets, lower=False)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(textkit.mix64(word) * textkit._power("up", len(word))[: len(word)], out=total[1:])
    end = np.append(first[1:], len(word)).astype(np.int64)
    n = end - first
    return textkit.mix64((total[end] - total[first]) * textkit._power("down", len(word) + 1)[first] + n.astype(np.uint64)), n


def measured(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, key, text) as doc_id, key, the base counts, and the different lines of each with their words."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            raw, offsets = textkit.buffers(batch.column(2))
            start, _, word, cut = textkit.words(raw, offsets, lower=False)
            n_rows = batch.num_rows
            begin, end, first, row = lines_of(raw, offsets, start)
            _, earliest = np.unique(_keyed(row, textkit.span_hashes(raw, begin, end)), return_index=True)
            again = np.bincount(row, minlength=n_rows) - np.bincount(row[earliest], minlength=n_rows)
            counts = [np.diff(cut), _per_row(~textkit._WS[raw] & ((raw & 0xC0) != 0x80), offsets), _per_row(_SYMBOL[raw], offsets),
                      again, repeated_words(word, cut)]
            h, n = line_hashes(raw, offsets, first)
            _, earliest, same = np.unique(_keyed(row, h), return_index=True, return_inverse=True)
            words = np.bincount(same, weights=n, minlength=len(earliest)).astype(np.int32)
            order = np.argsort(earliest)
            lines = pa.StructArray.from_arrays([pa.array(h[earliest[order]].view(np.int64)), pa.array(words[order])], ["h", "w"])
            at = np.concatenate([[0], np.cumsum(np.bincount(row[earliest], minlength=n_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.ListArray.from_arrays(pa.array(at), lines)],
                ["doc_id", "key", *(c.split()[0] for c in COUNTS.split(", ")), "lines"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(measure, f"doc_id long, key {key}, {COUNTS}, lines {LINES}")


def common_lines(lines: DataFrame, texts: int = COMMON_DOCS, share: int = COMMON_SHARE) -> DataFrame:
    """Lines (host, h) of a stored table (key, h, w) that too many different texts of their host hold. Both counts are
    partial sums before they are shuffled; only lines of more than ``texts`` texts meet the totals of the hosts."""
    held = lines.groupBy(F.col("key.host").alias("host"), "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > texts)
    hosts = lines.select("key").distinct().groupBy(F.struct(F.col("key.host").alias("host")).alias("of")).agg(F.count(F.lit(1)).alias("total"))
    return held.withColumn("mine", F.struct("host")).join(hosts, F.col("mine") == F.col("of")).filter(
        F.col("n") * 100 > F.col("total") * share).select(F.struct("host", "h").alias("common"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if it is counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _text_key(host: Column, text: Column) -> Column:
    """What tells texts of a host apart: equal texts of one host count as one document."""
    return F.struct(host.cast("string").alias("host"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("b"))


def _judged(store: Stored, docs: DataFrame, doc_id: str, text: str, host: str, limits: dict) -> tuple[DataFrame, DataFrame]:
    """Per row its counts and verdicts (doc_id, key, counts, words_left, base_failed, kept), and per text that has common
    lines their hashes (__key, lost, gone)."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text_key(F.col(host), F.col(text)).alias("key"),
                       F.col(text).cast("string").alias("text"))
    rows = store.keep(measured(slim))
    # One line per text and different line: what copies of one text add goes before anything is counted.
    lines = store.keep(rows.select("key", F.explode("lines").alias("line")).groupBy("key", F.col("line.h").alias("h")).agg(
        F.max("line.w").alias("w")))
    common = _small(store.keep(common_lines(lines, **limits)))
    hit = lines.join(common, F.struct(F.col("key.host").alias("host"), F.col("h")) == F.col("common"))
    lost = store.keep(hit.groupBy(F.col("key").alias("__key")).agg(F.sum("w").alias("lost"), F.collect_list("h").alias("gone")))
    per_text = _small(lost.select("__key", "lost"))
    out = rows.drop("lines").join(per_text, F.col("key") == F.col("__key"), "left").withColumn(
        "words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    depleted = (F.col("words_left") < LEAST_WORDS) | (F.col("words_left") * 100 < F.col("n_words") * LEFT_SHARE)
    return out.drop("__key", "lost").withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted), lost


def line_rules(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
               **limits: int) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left, base_failed,
    kept.

    Lines are hashed in normal form (words by one space, A-Z in lower case, digits as 0). A line that more than
    COMMON_DOCS different texts of one host and more than COMMON_SHARE per cent of them hold is common there (``texts`` and
    ``share`` in ``limits``); a document whose words mostly lie in common lines is depleted and rejected, as is one that
    fails the base rules. Texts are counted and not rows, so copies of a text do not make its lines common.

    Nulls: a null text has no words and fails the base rules, as do empty and blank ones. Rows without a host form one host.
    Rows without an id keep their null. Repeated rows each get their line. An empty table gives an empty result; other
    columns are ignored, whatever their names."""
    ready(spark)
    rows, _ = _judged(Stored(spark), docs, doc_id, text, host, limits)
    return rows.drop("key")


def without_common_lines(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         host: str = "source", **limits: int) -> DataFrame:
    """The rows of ``docs`` that ``line_rules`` keeps, all their columns; ``text`` has lost the lines that are common on
    its host. Columns may have any name that does not start with two underscores."""
    ready(spark)
    store = Stored(spark)
    rows, lost = _judged(store, docs, doc_id, text, host, limits)
    # The verdict follows from host and text alone, so it is found again by them.
    bad = store.keep(rows.filter(~F.col("kept")).select(F.col("key").alias("__bad")).distinct())

    @F.arrow_udf("string")
    def cut(texts, gone):
        import pyarrow as pa

        out = texts.to_pylist()
        for i, hashes in enumerate(gone.to_pylist()):
            if hashes:
                raw, offsets = textkit.buffers(texts.slice(i, 1))
                start = textkit.words(raw, offsets, lower=False)[0]
                begin, end, first, _ = lines_of(raw, offsets, start)
                common = np.isin(line_hashes(raw, offsets, first)[0].view(np.int64), np.array(hashes, np.int64))
                data, at, parts = raw.tobytes(), 0, []
                for a, b in zip(begin[common].tolist(), end[common].tolist()):
                    parts.append(data[at:a])
                    at = min(b + 1, len(data))  # the line feed goes with its line
                out[i] = b"".join([*parts, data[at:]]).decode()
        return pa.array(out, pa.string())

    left = docs.withColumn("__mine", _text_key(F.col(host), F.col(text)))
    left = left.join(_small(bad), F.col("__mine") == F.col("__bad"), "left_anti")
    left = left.join(lost.select(F.col("__key"), F.col("gone").alias("__gone")), F.col("__mine") == F.col("__key"), "left")
    return left.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cut(text, F.col("__gone")))).select(*docs.columns)
