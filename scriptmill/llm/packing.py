"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm.common import Stored, ready

# Characters of a bin, and characters and pieces that one task packs at a time.
CAPACITY, GROUP_CHARS, GROUP_PIECES = 8192, 4 << 20, 32 << 10


def same_text(text: Column) -> Column:
    """Cluster of copies: hash of the text without regard to case and white space."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(text)), r"\s++", " "))


class Bitmaps:
    """A bitmap for every bin: which sources (or clusters) it holds, as many 64-bit words as those that occur more than once
    need. Code -1 and codes that occur once conflict with nothing and have no bit."""

    def __init__(self, codes: np.ndarray):
        values, place, count = np.unique(codes, return_inverse=True, return_counts=True)
        asked = (count > 1) & (values >= 0)
        self.bit = np.where(asked, np.cumsum(asked) - 1, -1)[place]
        self.words = np.zeros((-(-int(asked.sum()) // 64), 64), np.uint64)

    def held(self, piece: int, bins: np.ndarray) -> np.ndarray | None:
        """Which of the bins hold the source of the piece; None if none can."""
        bit = int(self.bit[piece])
        return None if bit < 0 else self.words[bit >> 6][bins] & np.uint64(1 << (bit & 63)) != 0

    def add(self, piece: int, number: int) -> None:
        bit = int(self.bit[piece])
        if number >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        if bit >= 0:
            self.words[bit >> 6, number] |= np.uint64(1 << (bit & 63))


class Bins:
    """Open bins in the order of their residual capacity."""

    def __init__(self, most: int):
        self.n = 0
        self.residual, self.number = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.columns = (self.residual, self.number)

    def find(self, piece: int, size: int, bitmaps: tuple[Bitmaps, ...]) -> int:
        """The tightest bin that has room and whose bitmaps lack the piece's source and cluster: the first one that fits, then
        its successors; -1 if none."""
        at, step = int(np.searchsorted(self.residual[: self.n], size)), 32
        while at < self.n:
            to = min(self.n, at + step)
            free = np.ones(to - at, bool)
            for bitmap in bitmaps:
                held = bitmap.held(piece, self.number[at:to])
                if held is not None:
                    free &= ~held
            first = int(free.argmax())
            if free[first]:
                return at + first
            at, step = to, step * 2
        return -1

    def _move(self, old: int, row: tuple) -> None:
        """Put ``row`` where its residual belongs, left of ``old``, whose place becomes free."""
        new = int(np.searchsorted(self.residual[:old], row[0]))
        for column, value in zip(self.columns, row):
            column[new + 1 : old + 1] = column[new:old]
            column[new] = value

    def put(self, at: int, size: int) -> int:
        number = int(self.number[at])
        self._move(at, (self.residual[at] - size, number))
        return number

    def open(self, number: int, residual: int) -> None:
        self.n += 1
        self._move(self.n - 1, (residual, number))


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every piece; pieces are placed by falling size, ties in their given order."""
    bitmaps = (Bitmaps(sources), Bitmaps(clusters))
    out = np.zeros(len(sizes), np.int64)
    bins, opened = Bins(len(sizes)), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bins.find(i, size, bitmaps)
        if at >= 0:
            out[i] = bins.put(at, size)
        else:
            bins.open(opened, capacity - size)
            out[i] = opened
            opened += 1
        for bitmap in bitmaps:
            bitmap.add(i, int(out[i]))
    return out


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
         source: str | None = "source", cluster: str | None = None, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per piece of a document: doc_id, text_key (hash of the text), piece, start and length (characters of the
    text), bin_id, bin_place and bin_start (order and offset in the bin).

    A piece takes its characters and one for an end mark. Longer texts are cut into pieces that fill a bin and a rest. No
    bin holds two pieces of one source or of one cluster (by default: of copies). Pieces are dealt by a hash to groups of
    about ``group_chars`` characters and no more than some 32 000 pieces, each packed in one task, so sources and clusters of any size spread over all groups;
    bins do not cross groups.

    Nulls: a null text counts as empty, an empty one takes its end mark only; a null source conflicts with nothing; a null
    id is packed like any other. Repeated rows are packed each, in different bins. An empty table gives an empty result;
    other columns are ignored."""
    ready(spark)
    store = Stored(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = store.keep(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.length(body).cast("long").alias("chars"),
        (F.xxhash64(F.col(source).cast("string")) if source else F.lit(None).cast("long")).alias("s0"),
        (F.col(source).isNull() if source else F.lit(True)).alias("no_source"),
        (F.xxhash64(F.col(cluster).cast("string")) if cluster else same_text(body)).alias("c0")))
    room = capacity - 1
    total, n = slim.agg(F.sum(F.col("chars") + 1), F.sum(F.expr(f"(greatest(chars, 1L) - 1) div {room}L + 1"))).first()
    groups = max(1, -(-(total or 0) // group_chars), -(-(n or 0) // GROUP_PIECES))
    pieces = slim.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "piece", F.explode(F.expr(f"sequence(0L, (greatest(chars, 1L) - 1) div {room}L)")))
    pieces = pieces.withColumn("start", F.col("piece") * room).withColumn(
        "length", F.least(F.lit(room), F.col("chars") - F.col("start")))
    positive = lambda c: F.shiftrightunsigned(c, 1)
    pieces = pieces.select(
        F.pmod(F.xxhash64("row", "doc_id", "piece"), F.lit(groups)).alias("g"), "doc_id", "text_key", "piece", "start", "length",
        F.when(F.col("no_source"), F.lit(-1)).otherwise(positive(F.col("s0"))).alias("s"), positive(F.col("c0")).alias("c"))

    def fill(table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by([(k, "ascending") for k in ("doc_id", "text_key", "piece")])
        size = np.asarray(table.column("length")) + 1
        number = best_fit(size, np.asarray(table.column("s")), np.asarray(table.column("c")), capacity)
        order = np.lexsort((np.arange(len(size)), number))
        table, size, number = table.take(pa.array(order)), size[order], number[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        before = np.cumsum(size) - size
        spread = np.diff(np.append(first, len(size)))
        offset = before - np.repeat(before[first], spread)
        place = np.arange(len(size)) - np.repeat(first, spread)
        group = np.asarray(table.column("g"))
        out = table.select(["doc_id", "text_key", "piece", "start", "length"])
        for name, values in (("bin_id", group * (1 << 32) + number), ("bin_place", place), ("bin_start", offset)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return pieces.groupBy("g").applyInArrow(
        fill, "doc_id long, text_key long, piece long, start long, length long, bin_id long, bin_place long, bin_start long")


def packed_texts(docs: DataFrame, packed: DataFrame, end_mark: str = "\u0003", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences themselves: bin_id and its text, each piece followed by the end mark."""
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    pieces = packed.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    part = F.struct("bin_place", F.concat(F.substring(F.col("t"), F.col("start") + 1, F.col("length")), F.lit(end_mark)).alias("x"))
    return pieces.groupBy("bin_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "").alias("text"))
