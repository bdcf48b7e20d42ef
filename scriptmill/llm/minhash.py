"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, components, ready

# Rows of ids that a broadcast may hold (8 bytes each); with more, the same join shuffles.
BROADCAST_IDS = 1_000_000
# A block of one bucket: so many members, or so many shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 20


def sketches(docs: DataFrame, shingle: int, bands: int, band_width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole shingle set; null for an empty one), bands (keys)."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            raw, offsets = textkit.buffers(batch.column(1))
            _, _, hashes, rows = textkit.words(raw, offsets)
            sets, cut = textkit.shingle_sets(hashes, rows, shingle)
            keys = textkit.band_keys(textkit.circulant_signatures(sets, cut, bands * band_width), band_width)
            n = np.diff(cut)
            data = sets.tobytes()
            digest = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None
                      for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digest, pa.binary()), lists],
                ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = textkit.buffers(column)
    _, _, hashes, rows = textkit.words(raw, offsets)
    return textkit.shingle_sets(hashes, rows, shingle)


def verified(pairs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Those of the pairs (a, b, text_a, text_b) whose whole sets are similar enough: (a, b)."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            left, at_left = _sets(batch.column(2), shingle)
            right, at_right = _sets(batch.column(3), shingle)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[at_left[i] : at_left[i + 1]], right[at_right[i] : at_right[i + 1]]
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both * least.denominator >= least.numerator * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _block_links(sets: list[np.ndarray], labels: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """Links of a block that join different labels, as few as span them: counts of shared shingles by matrix products over
    the shingles that occur twice, a slice of them at a time."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    owner, column = owner[shared], column[place[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width, at = 4096, 0
    while at < len(column):
        first = column[at]
        to = int(np.searchsorted(column, first + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[at:to], column[at:to] - first] = 1
        both += part @ part.T
        at = to
    both = both.astype(np.int64)
    union = n[:, None] + n[None, :] - both
    hit = (both * least.denominator >= least.numerator * union) & (labels[:, None] != labels[None, :]) & (n > 0)[:, None]
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1))):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def bucket_links(rows: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Links between members of one bucket that carry different labels: rows (key, rep, label, n_shingles) of buckets of
    any size, texts (id, text). A bucket is cut into blocks by members and shingles, and every two blocks meet in one
    task, so no task holds more than two blocks; pairs exist only as cells of a matrix, links leave as a spanning forest."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("total"))
    blocks = sizes.select("key", F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES))
                          .cast("int").alias("g"))
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("g")).cast("int")
    dealt = rows.join(blocks, "key").withColumn("c", mine).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("key", F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), "rep", "label")
    full = dealt.join(texts, dealt["rep"] == texts["id"]).select("key", "i", "j", "rep", "label", "text")

    def link(table):
        import pyarrow as pa

        table = table.combine_chunks()
        flat, cut = _sets(table.column("text"), shingle)
        sets = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        ids = np.asarray(table.column("rep"))
        found = _block_links(sets, np.asarray(table.column("label")), least)
        a = ids[[i for i, _ in found]] if found else np.zeros(0, np.int64)
        b = ids[[j for _, j in found]] if found else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("key", "i", "j").applyInArrow(link, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    least: Fraction = Fraction(4, 5), bands: int = 32, band_width: int = 6) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Equal shingle sets form a class that goes on as its smallest id, so groups of copies of any size cost one line. A
    band key that several classes share is a bucket. First every member is compared with the smallest id of its bucket
    only. Where that leaves a bucket with members in different components, all pairs of its members that are still
    apart are compared too, block by block, so every pair that shares a bucket is either compared or already connected.
    With the given bands a pair of similarity 0.8 shares no bucket with probability 6e-5, one of 0.9 with 3e-11.

    Nulls: null or blank texts have no shingles and are linked with nothing. Rows without an id are linked with nothing
    and have a null component_id. Repeated rows each get their line; rows that share an id count as one document where
    they link. An empty table gives an empty result; extra columns are ignored."""
    ready(spark)
    store = Stored(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = store.keep(sketches(docs, shingle, bands, band_width))
    known = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    classes = store.keep(every.filter(known).groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    in_band = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    buckets = store.keep(in_band.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("center")).filter("m > 1"))
    members = store.keep(in_band.join(buckets, "key"))
    ids = store.keep(members.select(F.col("rep").alias("id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = store.keep(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi").select(
        F.col("doc_id").alias("id"), "text"))

    pairs = members.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    with_texts = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = store.keep(verified(with_texts, shingle, least))
    roots = store.keep(components(spark, links))

    labelled = members.filter("rep <> center").join(roots, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n_shingles", F.coalesce("root", "rep").alias("label"))
    labelled = store.keep(labelled)
    apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    more = store.keep(bucket_links(labelled.join(store.keep(apart), "key"), texts, shingle, least))
    if more.limit(1).count():
        roots = store.keep(components(spark, links.unionByName(more)))

    of_class = store.keep(classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("set_key"), F.coalesce("root", "rep").alias("component_id")))
    linked = every.filter(known).join(of_class, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = every.filter(~known).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all their columns, that are the first of their component (``near_duplicates``). Of rows that
    share the id and the text one stays; rows without an id or without words all stay."""
    store = Stored(spark)
    found = store.keep(near_duplicates(spark, docs, doc_id, text, **settings))
    gone = store.keep(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct())
    again = store.keep(found.filter("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("__id")).agg(
        F.count(F.lit(1)).alias("m")).filter("m > 1").select("__id"))

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return rows.join(side, rows[doc_id] == F.col("__id"), how)

    left = among(docs, gone, "left_anti")
    if again.limit(1).count():
        left = among(left, again, "left_anti").unionByName(among(left, again, "left_semi").dropDuplicates([doc_id, text]))
    return left
