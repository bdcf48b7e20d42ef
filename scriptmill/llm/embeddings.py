"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, components, partitions, ready

# Width of a bucket along one projection, in units of the normalised vectors; unrelated vectors that a bucket may hold on
# average; share of the pairs at exactly the threshold that some table brings together; members of a block of a bucket.
WIDTH, STRANGERS, RECALL, BLOCK = 2.0, 64, 0.99, 1024


def collision(distance: float, width: float) -> float:
    """Probability that two points at that distance share the cell of one quantised Gaussian projection."""
    t = width / distance
    below = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, least: float, width: float = WIDTH, strangers: int = STRANGERS, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table and tables: enough projections that unrelated (orthogonal) vectors fill a bucket with
    ``strangers`` at most, enough tables that a pair at the threshold meets with probability ``recall``."""
    near, far = collision(math.sqrt(2 - 2 * least), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(2, n) / strangers) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _projections(dims: int, k: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240101, dims, k, tables])
    return rng.standard_normal((dims, k * tables)), rng.uniform(0, width, k * tables)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def clean_vectors(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, vec (bytes of the components) and its key; vec and key are null for vectors that link with nothing."""
    dtype = np.dtype(kind)

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            column = batch.column(1)
            flat = np.asarray(column.flatten().fill_null(float("nan")), dtype) + dtype.type(0)
            length = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
            length = np.where(np.asarray(column.is_null()), 0, length)
            at, keys, vecs = 0, [], []
            for n in length.tolist():
                x = flat[at : at + n]
                at += n
                good = n > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                vecs.append(x.tobytes() if good else None)
                keys.append(hashlib.blake2b(vecs[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())],
                                             ["vec_id", "vec", "same"])

    return vectors.mapInArrow(clean, "vec_id long, vec binary, same binary")


def bucket_keys(classes: DataFrame, kind: str, k: int, tables: int, width: float) -> DataFrame:
    """Add to (rep, m, vec) an array with one key per table."""
    dtype = np.dtype(kind)

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            vecs = [np.frombuffer(v, dtype).astype(np.float64) for v in batch.column(2).to_pylist()]
            out = np.empty((len(vecs), tables), np.uint64)
            sizes = np.array([len(v) for v in vecs], int)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                a, b = _projections(int(dims), k, tables, width)
                cells = np.floor((_unit(np.stack([vecs[i] for i in rows])) @ a + b) / width).astype(np.int64)
                cells = cells.reshape(len(rows), tables, k)
                key = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(dims), (len(rows), tables))
                for j in range(k):
                    key = textkit.mix64(key * np.uint64(0x9FB21C651E98DF25) + cells[:, :, j].astype(np.uint64))
                out[rows] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * tables), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["rep", "m", "vec", "keys"])

    return classes.select("rep", "m", "vec").mapInArrow(keys, "rep long, m long, vec binary, keys array<long>")


def _links(ids, m, x, keys, table: int, side: np.ndarray, cross: bool, least: float):
    """Links of a block: for every row the weight of its partners, and the first member of its component in the block.
    A pair counts in the first table that brings it together, so in no other one."""
    n = len(ids)
    rows = np.flatnonzero(side == 0)
    cols = np.flatnonzero(side == 1) if cross else rows
    weight, p_all, q_all = np.zeros(n, np.int64), [], []
    for at in range(0, len(rows), 128):
        part = rows[at : at + 128]
        i, j = np.nonzero(x[part] @ x[cols].T >= least)
        p, q = part[i], cols[j]
        if not cross:
            p, q = p[p < q], q[p < q]
        if table and len(p):
            new = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
            p, q = p[new], q[new]
        np.add.at(weight, p, m[q])
        np.add.at(weight, q, m[p])
        p_all.append(p)
        q_all.append(q)
    p, q = (np.concatenate(a) if a else np.zeros(0, int) for a in (p_all, q_all))
    label = np.arange(n)
    while len(p):
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    return weight, label


def near_vectors(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 least: float = 0.9, recall: float = RECALL, width: float = WIDTH) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors with a cosine of ``least`` or more), component_id, kept.

    Equal vectors form a class with a weight. Each class is hashed into tables of quantised Gaussian projections; their
    number follows from the number of classes (``plan_tables``), so the size of a bucket of unrelated vectors stays the
    same as the table grows. Members of a bucket are compared by matrix products in double precision, block by block, so a
    bucket of any size is spread over tasks; pairs exist only inside a block, which returns a weight per member and a
    spanning star per component. A pair that several tables find counts once: in the first of them.

    Nulls: a null vector, one with null, infinite or no components, or of length zero links with nothing (n_links 0, its
    own component, kept). A row without an id links with nothing and has a null component. Vectors with different
    numbers of components do not link. Repeated rows are vectors of their own and link with each other. An empty table
    gives an empty result; other columns are ignored."""
    ready(spark)
    store = Stored(spark)
    element = vectors.schema[embedding].dataType.elementType
    kind = "f4" if isinstance(element, T.FloatType) else "f8"
    numbers = F.col(embedding).cast("array<float>" if kind == "f4" else "array<double>")
    every = store.keep(clean_vectors(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), numbers.alias("e")), kind))
    known = F.col("same").isNotNull() & F.col("vec_id").isNotNull()
    classes = store.keep(every.filter(known).groupBy("same").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec")))
    # an id that repeats with different vectors may stand for several classes: number them by key instead
    k, tables = plan_tables(classes.count(), least, width, STRANGERS, recall)
    hashed = store.keep(bucket_keys(classes.select(F.xxhash64("same").alias("rep"), "m", "vec"), kind, k, tables, width))

    spots = hashed.select("rep", F.posexplode("keys").alias("t", "key"))
    buckets = store.keep(spots.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(
        "t", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("g")))
    dealt = spots.join(buckets, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("g")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep")
    dtype, n_tables = np.dtype(kind), tables

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def work(table) -> Iterator:
            """Whole groups, one after the other."""
            t, key, i, j, c, rep, m = (np.asarray(table.column(x)) for x in ("t", "key", "i", "j", "c", "rep", "m"))
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            vecs = table.column("vec").combine_chunks()
            keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(-1, n_tables)
            ids, weights, others = [], [], []
            for a, b in zip([0, *new.tolist()], [*new.tolist(), table.num_rows]):
                x = _unit(np.stack([np.frombuffer(v, dtype) for v in vecs[a:b].to_pylist()]).astype(np.float64))
                w, low = _links(rep[a:b], m[a:b], x, keys[a:b], int(t[a]), (c[a:b] != i[a]).astype(int), i[a] != j[a], least)
                hit = np.flatnonzero(w)
                ids.append(rep[a:b][hit])
                weights.append(w[hit])
                others.append(rep[a:b][low[hit]])
            out = [pa.array(np.concatenate(x)) for x in (ids, weights, others)]
            yield pa.RecordBatch.from_arrays(out, ["rep", "w", "other"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = [table.column(x)[-1].as_py() for x in ("t", "key", "i", "j")]
            same = np.ones(table.num_rows, bool)
            for x, v in zip(("t", "key", "i", "j"), last):
                same &= np.asarray(table.column(x)) == v
            cut = int(np.argmax(same))
            if cut:
                yield from work(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from work(rest)

    group = ["t", "key", "i", "j"]
    full = dealt.join(hashed, "rep").select(*group, "c", "rep", "m", "vec", "keys")
    full = full.repartition(partitions(spark), *group).sortWithinPartitions(*group)
    found = store.keep(full.mapInArrow(link, "rep long, w long, other long"))
    weights = found.groupBy("rep").agg(F.sum("w").alias("w"))
    named = store.keep(classes.select("same", F.xxhash64("same").alias("c"), F.col("rep").alias("low"), "m"))
    groups = components(spark, found.select("rep", "other"), "rep", "other")
    root = store.keep(named.join(groups, F.col("c") == F.col("node"), "left").select(
        "same", "c", "low", "m", F.coalesce("root", "c").alias("root")))
    lows = store.keep(root.groupBy("root").agg(F.min("low").alias("component_id")))
    of_class = root.join(lows, "root").join(weights, F.col("c") == F.col("rep"), "left")
    of_class = store.keep(of_class.select(F.col("same").alias("s"), "component_id", (
        F.col("m") - 1 + F.coalesce("w", F.lit(0))).alias("n_links")))
    linked = every.filter(known).join(of_class, F.col("same") == F.col("s")).select("vec_id", "n_links", "component_id")
    alone = every.filter(~known).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
