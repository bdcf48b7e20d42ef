"""Similar scripts: a set-similarity join over the fragments and tables of scripts.

Scripts with equal feature sets are one class. Of every class only the rarest features are put in an inverted index: two sets
of Jaccard similarity t or more share one of the first n - ceil(t n) + 1 features of each when both are ordered from rare to
frequent. A table that all scripts use stands at the end of every list and is no entry of the index. Where a feature of many
classes is one, its classes are compared as blocks of a matrix, and only similar pairs are written."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scriptmill.operators.scopes import names_table, resolved_names
from scriptmill.operators.tokens import normal_text
from scriptmill.session import shuffle_partitions, store

# Executors need not have this package; what runs there is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words in front of which a statement is cut into fragments, beside commas and semicolons.
CUTS = ["SELECT", "FROM", "WHERE", "AND", "OR", "ON", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "UNION", "WHEN", "SET", "VALUES",
        "PARTITION", "LATERAL", "WITH"]
# Members of an index entry of which pairs are written down. In larger entries they are compared where they meet: members that
# meet in one task, entries with more are split into blocks of that size; columns of the matrix of a block, and rows of it that
# are multiplied at once.
FEW, BLOCK, WIDTH, TILE = 16, 32768, 1024, 2048
# Features whose frequency (16 bytes a line) is told to all tasks.
FREQUENT = 100_000


def fragments(sql: Column) -> Column:
    """The different pieces of a script in normal form (``normal_text``) between commas, semicolons and clause words."""
    cut = F.regexp_replace(normal_text(sql), "(^| )(" + "|".join(CUTS) + ")(?= |$)", "\n$2")
    return F.array_distinct(F.filter(F.transform(F.split(cut, "[,;\n]"), lambda p: F.trim(p)), lambda p: p != ""))


def script_features(scripts: DataFrame) -> DataFrame:
    """(path, feature), each feature once per row: hashes of its fragments and of the tables it touches. Both are found where
    the text is, which is read once and not shuffled."""
    parts = F.transform(fragments(F.col("sql")), lambda p: F.xxhash64(F.lit("part"), p))
    names = resolved_names(scripts.select(F.struct("path", parts.alias("parts")).alias("script_id"), "sql"))
    tables = F.transform(F.filter("refs", names_table), lambda r: F.xxhash64(F.lit("table"), r["table_name"]))
    return names.select("script_id.path", F.explode(F.array_union("script_id.parts", tables)).alias("feature"))


def classes(features: DataFrame) -> DataFrame:
    """(path, class, n, n_scripts, features): scripts with equal sets, the class named by its smallest path. The set of one
    script is part of its text."""
    sets = store(features.groupBy("path").agg(F.array_sort(F.collect_set("feature")).alias("features")))
    named = sets.groupBy("features").agg(F.min("path").alias("class"), F.count(F.lit(1)).alias("n_scripts"))
    return store(sets.join(named, "features").select("path", "class", F.size("features").alias("n"), "n_scripts", "features"))


def _ordered(sets: DataFrame) -> DataFrame:
    """(class, n, features) with the features of each class from rare to frequent, ties by value. The FREQUENT most frequent
    ones at most are told to all tasks with their frequencies; the others come first, by value. Sets are put in order where
    they are read."""
    counts = store(sets.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("m")))
    least, told = 2, 0
    # a line per frequency; the different ones are fewer than the root of twice the number of all entries
    for m, features in counts.where("m > 1").groupBy("m").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("m")).collect():
        told += features
        if told > FREQUENT:
            least = m + 1
            break
    often = counts.where(F.col("m") >= least).toArrow().sort_by("feature")
    known, times = np.asarray(often.column("feature").combine_chunks()), np.asarray(often.column("m").combine_chunks())

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            flat, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            m = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                m = np.where(known[at] == flat, times[at], 0)
            flat = flat[np.lexsort((flat, m, np.repeat(np.arange(len(size)), size)))]
            cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))],
                                             ["class", "n", "features"])

    rows = sets.select("class", "n", "features")
    return rows.mapInArrow(order, rows.schema)


def _blocks(entries: DataFrame, role: str) -> DataFrame:
    """Blocks of the members of one role in each entry of the index and size class: (feature, z, g)."""
    return entries.where(role).groupBy("feature", "z").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"))


def _met(entries: DataFrame, many: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (class_a, class_b, n_shared, total) of members of one entry of the index that have Jaccard similarity ``least`` or
    more by what stands from the common feature on (entries: feature, class, n, tail, m, smaller; tail begins with the feature; many: feature, m).
    An entry is cut by size and into blocks. Every two blocks that may hold similar sizes meet in one task, where pairs exist
    only as cells of a matrix; entries of one block are dealt to lots, which a task takes one entry at a time."""
    p, q = least.numerator, least.denominator
    # Sizes n and n * least are one class apart at most; the factor is far above the error of the logarithm.
    step = max(math.log(q / p), 1e-3) * (1 + 1e-6)
    small = F.col("m") <= BLOCK
    entries = entries.withColumn("larger", F.lit(True)).withColumn(
        "z", F.when(small, 0).otherwise(F.floor(F.log("n") / step)).cast("int"))
    mine = lambda g: F.pmod(F.xxhash64("class"), F.col(g)).cast("int")
    keys, rest = ["feature", "lot", "z_a", "i", "z_b", "j"], ["class", "n", "tail"]
    none = F.lit(0)
    lots = max(1, (many.where(small).agg(F.sum("m")).first()[0] or 0) // BLOCK)
    lot = F.pmod(F.xxhash64("feature"), F.lit(lots)).cast("int")
    dealt = entries.where(small).select(
        F.lit(None).cast("long").alias("feature"), lot.alias("lot"), *[none.alias(k) for k in keys[2:]], F.lit(True).alias("is_a"),
        F.col("smaller").alias("is_b"), F.col("feature").alias("entry"), *rest)
    large = entries.where(~small)
    of = {"larger": _blocks(large, "larger"), "smaller": _blocks(large, "smaller")}
    for role, other, apart, a, b in (("larger", "smaller", [0, -1], ("z", "c"), ("y", "o")), ("smaller", "larger", [0, 1], ("y", "o"), ("z", "c"))):
        own = of[role].withColumnRenamed("g", "g_own")
        met = of[other].select(F.col("feature").alias("f"), F.col("z").alias("y"), F.col("g").alias("g_met"))
        # a line per entry, size class and size class it meets: far fewer than members
        both = own.withColumn("y", F.explode(F.array(*[F.col("z") + x for x in apart]))).join(
            met.withColumnRenamed("y", "y_met"), (F.col("feature") == F.col("f")) & (F.col("y") == F.col("y_met"))).select(
            "feature", "z", "y", "g_own", "g_met")
        rows = large.where(role).join(both, ["feature", "z"]).withColumn("c", mine("g_own")).withColumn(
            "o", F.explode(F.sequence(F.lit(0), F.col("g_met") - 1)))
        dealt = dealt.unionByName(rows.select(
            "feature", F.lit(-1).alias("lot"), F.col(a[0]).alias("z_a"), F.col(a[1]).alias("i"), F.col(b[0]).alias("z_b"), F.col(b[1]).alias("j"),
            F.lit(role == "larger").alias("is_a"), F.lit(role == "smaller").alias("is_b"), F.col("feature").alias("entry"), *rest))
    kind = entries.schema["class"]
    out = StructType([StructField("a", kind.dataType), StructField("b", kind.dataType), *StructType.fromDDL("n_shared int, total int")])

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("entry")
        entry, n, is_a, is_b = (np.asarray(table.column(c)) for c in ("entry", "n", "is_a", "is_b"))
        tail, names = table.column("tail").chunk(0), table.column("class").chunk(0)
        values, cut = np.asarray(tail.values), np.asarray(tail.offsets)
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        found: list[tuple] = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(entry)]):
            a, b = np.flatnonzero(is_a[lo:hi]), np.flatnonzero(is_b[lo:hi])
            if len(a) and len(b):
                pairs = _alike(values[cut[lo] : cut[hi]], np.diff(cut[lo : hi + 1]), n[lo:hi], a, b, p, q)
                found += [(lo + x, lo + y) for x, y in pairs]
        keep: list[tuple] = []
        if found:
            left, right = names.take(pa.array([x for x, _ in found])).to_pylist(), names.take(pa.array([y for _, y in found])).to_pylist()
            for (x, y), u, v in zip(found, left, right):
                total = int(n[x]) + int(n[y])
                if n[y] < n[x] or (n[y] == n[x] and v < u):
                    shared = len(np.intersect1d(values[cut[x] : cut[x + 1]], values[cut[y] : cut[y + 1]], assume_unique=True))
                    if shared * (p + q) >= total * p:
                        keep.append((u, v, shared, total))
        columns = list(zip(*keep)) if keep else [()] * 4
        types = [names.type, names.type, pa.int32(), pa.int32()]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("a", "b", "n_shared", "total"), columns, types)})

    # The number of partitions is given, since AQE would merge them by bytes, and the work grows with their square.
    met = dealt.repartition(shuffle_partitions(entries.sparkSession), *keys).groupBy(*keys).applyInArrow(link, out)
    return met.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "n_shared", "total")


def _alike(values: np.ndarray, sizes: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, p: int, q: int) -> Iterator[tuple[int, int]]:
    """Pairs of a row of ``a`` and a row of ``b`` whose lists (one after the other in ``values``) may share enough for a
    similarity of p/q of sets of n features. More than WIDTH different values share columns, which only adds to what two lists
    seem to share."""
    _, column = np.unique(values, return_inverse=True)
    columns = min(WIDTH, int(column.max()) + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = np.bincount(owner * columns + column % columns, minlength=1).max() if int(column.max()) >= columns else 1
    # Whole numbers only; single precision holds them up to 2 ** 24.
    kind = np.float32 if (p + q) * int(n.max()) * int(spread) < 1 << 23 else np.float64
    start = np.concatenate([[0], np.cumsum(sizes)])

    def matrix(rows: np.ndarray) -> np.ndarray:
        at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows.tolist()])
        cell = np.repeat(np.arange(len(rows)) * (columns + 2), sizes[rows]) + column[at] % columns
        return np.bincount(cell, minlength=len(rows) * (columns + 2)).astype(kind).reshape(len(rows), columns + 2)

    for lo in range(0, len(a), TILE):
        rows = a[lo : lo + TILE]
        left = matrix(rows) * (p + q)
        left[:, columns], left[:, columns + 1] = -p * n[rows], 1
        for to in range(0, len(b), TILE):
            others = b[to : to + TILE]
            right = matrix(others)
            right[:, columns], right[:, columns + 1] = 1, -p * n[others]
            x, y = np.nonzero(left @ right.T >= 0)
            yield from zip(rows[x].tolist(), others[y].tolist())


def similar_classes(sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (class_a, class_b, n_shared, similarity), class_a < class_b, of classes (class, n, features) whose sets have
    Jaccard similarity ``least`` or more."""
    p, q = least.numerator, least.denominator
    ordered = store(_ordered(sets))
    prefix = F.col("n") - F.ceil(F.col("n") * p / F.lit(q)).cast("int") + 1
    index = ordered.select("class", "n", F.posexplode(F.slice("features", F.lit(1), prefix)).alias("pos", "feature"))
    counts = store(index.groupBy("feature").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    # The first feature that two sets share is the first of all that they share, so what stands from there on in either must
    # suffice. The smaller set of a pair can be found by the features with which it would suffice for one of its own size.
    smaller = (F.col("n") - F.col("pos")) * (p + q) >= F.col("n") * 2 * p
    # Pairs of an entry with few members are written down and compared as a whole, those of the others where they meet.
    few = index.join(counts.where(F.col("m") <= FEW), "feature").drop("m")
    a, b = few.alias("a"), few.where(smaller).alias("b")
    order = (F.col("b.n") < F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.class") < F.col("a.class")))
    sizes = F.col("b.n") * q >= F.col("a.n") * p
    enough = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) * (p + q) >= (F.col("a.n") + F.col("b.n")) * p
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & order & sizes & enough).select(
        F.least("a.class", "b.class").alias("class_a"), F.greatest("a.class", "b.class").alias("class_b")).distinct()
    side = ordered.select("class", "features")
    both = pairs.join(side.toDF("class_a", "fa"), "class_a").join(side.toDF("class_b", "fb"), "class_b")
    both = both.select("class_a", "class_b", F.size(F.array_intersect("fa", "fb")).alias("n_shared"), (F.size("fa") + F.size("fb")).alias("total"))
    many = counts.where(F.col("m") > FEW)  # fewer than one per FEW entries of the index
    entries = ordered.select("class", "n", "features", F.posexplode(F.slice("features", F.lit(1), prefix)).alias("pos", "feature")).join(
        many, "feature").select("feature", "class", "n", F.slice("features", F.col("pos") + 1, F.col("n")).alias("tail"), "m", smaller.alias("smaller"))
    # By a later feature than the first, two sets seem to share less than they do.
    found = both.where(F.col("n_shared") * (p + q) >= F.col("total") * p).unionByName(_met(entries, many, least))
    found = found.groupBy("class_a", "class_b").agg(F.max("n_shared").alias("n_shared"), F.max("total").alias("total"))
    return found.select("class_a", "class_b", "n_shared", (F.col("n_shared") / (F.col("total") - F.col("n_shared"))).alias("similarity"))


def similar_scripts(scripts: DataFrame, least: Fraction = Fraction(4, 5)) -> tuple[DataFrame, DataFrame]:
    """Near copies among scripts(script_id, path, sql) with unique paths: pairs (path_a, path_b, n_a, n_b, n_shared,
    similarity) of scripts that stand for their class (n_a and n_b scripts have the same features), and one row per script
    (path, class_path, n_scripts, n_links) with its class and the number of other classes similar to it.

    A script without any code has no features and is in neither. Layout, comments and case make no difference."""
    members = classes(script_features(scripts))
    heads = members.where(F.col("path") == F.col("class"))
    links = store(similar_classes(heads.select("class", "n", "features"), least))
    size = heads.select(F.col("class"), F.col("n_scripts"))
    pairs = links.join(size.toDF("class_a", "n_a"), "class_a").join(size.toDF("class_b", "n_b"), "class_b").select(
        F.col("class_a").alias("path_a"), F.col("class_b").alias("path_b"), "n_a", "n_b", "n_shared", "similarity")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    rows = members.join(degree, "class", "left").select(
        "path", F.col("class").alias("class_path"), "n_scripts", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return pairs, rows
