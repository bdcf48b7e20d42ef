"""A stored positional trigram index of texts: finds any substring of three characters or more without reading the texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.session import store
from scriptmill.sources.tables import code_table

# Executors need not have this package; what runs there is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Folders of an index, by the hash of the trigram.
PARTS = 64
# Candidates (16 bytes each) that may be broadcast.
CANDIDATES = 1_000_000
# Characters of the texts whose places are sorted together.
SLICE = 1 << 21
# Keys, ends and positions rise within a list, so their differences are small.
PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


def _postings(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """(gram, n, keys, ends, positions) of some texts, a row per trigram: the texts that hold it, and its places in them one
    text behind the other, those of text i before ``ends[i]``."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(pos + 2 < lengths[text])
    grams = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2]
    order = np.argsort(grams, kind="stable")  # places stay in the order of texts and positions
    grams, at = grams[order], at[order]
    text, pos = text[at], pos[at]
    new_gram = np.r_[True, grams[1:] != grams[:-1]][: len(grams)]
    new_text = new_gram | np.r_[True, text[1:] != text[:-1]][: len(grams)]
    first, pairs = np.flatnonzero(new_gram), np.flatnonzero(new_text)
    bounds = np.r_[first, len(grams)]
    of = np.searchsorted(first, pairs, side="right") - 1  # the row of each pair of a trigram and a text
    ends = np.r_[pairs[1:], len(grams)][: len(pairs)] - first[of]
    held = np.searchsorted(pairs, bounds)
    letters = np.stack([grams[first] >> 42, grams[first] >> 21 & 0x1FFFFF, grams[first] & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
    return pa.RecordBatch.from_arrays([
        pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)], pa.string()), pa.array(np.diff(held), pa.int64()),
        lists(held, keys.take(pa.array(text[pairs]))), lists(held, pa.array(ends, pa.int32())),
        lists(bounds, pa.array(pos, pa.int32()))], ["gram", "n", "keys", "ends", "positions"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of stretches of texts with ``SLICE`` characters, or of one longer text."""
    for batch in batches:
        batch = batch.filter(pa.compute.greater_equal(pa.compute.utf8_length(batch["text"]), 3))
        texts, start, size = batch["text"].to_pylist(), 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > SLICE:
                yield _postings(batch["key"].slice(start, i - start), texts[start:i])
                start, size = i, 0
            size += len(t)
        if texts[start:]:
            yield _postings(batch["key"].slice(start), texts[start:])


def write_index(texts: DataFrame, key: str, text: str, folder: str, parts: int = PARTS) -> None:
    """Write (gram, n, keys, ends, positions) below ``folder``/grams, a folder per hash of the trigram, and the number of texts
    of each trigram below ``folder``/counts. Positions count characters from 0. Texts with the same key must not occur.

    The postings are made where a text is read and nothing is shuffled: every partition of the texts has its own files, one per
    folder, with a row per trigram and stretch of texts. Numbers are stored as differences."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    of = rows.schema["key"].dataType.simpleString()
    held = rows.mapInArrow(_indexed, f"gram string, n bigint, keys array<{of}>, ends array<int>, positions array<int>")
    held = held.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int"))
    held.sortWithinPartitions("part", "gram").write.partitionBy("part").options(**PACKED).parquet(f"{folder}/grams")
    index = texts.sparkSession.read.schema(held.schema).parquet(f"{folder}/grams")
    index.groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/counts")


def search(spark: SparkSession, folder: str, patterns: list[str], parts: int = PARTS) -> DataFrame:
    """(pattern, key): the texts that hold each pattern, as LIKE '%pattern%' with a literal pattern finds them.

    Only the folders of the patterns' trigrams are read. Texts with a pattern's rarest trigram are the candidates; the other
    trigrams are looked up for these only, and a text holds the pattern if all stand one behind the other at one place."""
    if any(len(p) < 3 for p in patterns):
        raise ValueError("patterns have three characters or more")
    wanted = [(p, p[i : i + 3], i) for p in dict.fromkeys(patterns) for i in range(len(p) - 2)]
    if not wanted:
        return spark.createDataFrame([], "pattern string, key long")
    asked = code_table(spark, wanted, "pattern string, gram string, at int")  # a table written in code
    values = sorted({g for _, g, _ in wanted})
    counts = spark.read.parquet(f"{folder}/counts").where(F.col("gram").isin(values))
    known = {r.gram: r.n for r in counts.collect()}  # one line per trigram of the patterns
    if not known:
        return spark.createDataFrame([], "pattern string, key long")
    rarest = {}
    for p, g, i in wanted:
        rarest[p] = min(rarest.get(p, (known.get(g, 0), i)), (known.get(g, 0), i))
    hashes = spark.createDataFrame([(g,) for g in values], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(parts)).alias("p"))
    folders = sorted({r.p for r in hashes.collect()})
    index = spark.read.parquet(f"{folder}/grams").where(F.col("part").isin(folders) & F.col("gram").isin(values)).drop("part")
    # a row per text: its positions are those between the end of the text before it and its own
    lists = F.expr("""transform(keys, (k, i) -> named_struct('key', k, 'positions', slice(
      positions, 1 + IF(i = 0, 0, ends[i - 1]), ends[i] - IF(i = 0, 0, ends[i - 1]))))""")
    found = index.select("gram", F.inline(lists))
    found = found.groupBy("gram", "key").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    starts = F.transform("positions", lambda x: x - F.col("at"))
    placed = found.join(F.broadcast(asked), "gram").select("pattern", "key", "at", starts.alias("starts"))
    first = code_table(spark, [(p, i) for p, (_, i) in rarest.items()], "pattern string, at int")
    begun = store(placed.join(F.broadcast(first), ["pattern", "at"]).select("pattern", "key", F.col("starts").alias("found")))
    candidates = begun.select("pattern", "key")
    rest = placed.join(F.broadcast(first), ["pattern", "at"], "left_anti").join(
        F.broadcast(candidates) if begun.count() <= CANDIDATES else candidates, ["pattern", "key"], "left_semi")
    others = rest.groupBy("pattern", "key").agg(F.collect_list("starts").alias("all"))  # one list per character of the pattern
    both = begun.join(others, ["pattern", "key"], "left").withColumn("n", F.coalesce(F.size("all"), F.lit(0)))
    length = code_table(spark, [(p, len(p) - 3) for p in rarest], "pattern string, others int")
    met = both.join(F.broadcast(length), "pattern").where("n = others")
    common = F.aggregate(F.coalesce("all", F.array().cast("array<array<int>>")), F.col("found"), lambda a, x: F.array_intersect(a, x))
    return met.where(F.size(common) > 0).select("pattern", "key")
