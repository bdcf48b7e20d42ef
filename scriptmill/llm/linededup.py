"""Removal of repeated line chunks. Chunk borders follow the content: a rolling hash over line hashes decides where a chunk
ends, so inserted or removed lines move only the borders near them. A block of a few lines rarely holds two borders, so pairs
of neighbouring lines are joined as well. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm.common import Stored, ready, with_rolling

# A chunk ends behind the line where the hash of the last two lines is a multiple of four: four lines on average.
WINDOW, DIVISOR = 2, 4
# Lists of units and of removed lines are broadcast up to this size; beyond it, the texts are shuffled to it by id.
BROADCAST_BYTES = 32 << 20


def _row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Id and text hash of a row. A row without an id gets one from its text, behind all real ones."""
    t = F.coalesce(F.xxhash64(text), F.lit(0))
    return F.coalesce(doc_id.cast("long"), F.lit(1 << 62) + F.pmod(t, F.lit(1 << 61))), t


def chunked(rows: DataFrame, text: str, window: int, divisor: int) -> DataFrame:
    """Add ``__lines`` and ``__ends``: the lines of the text and the numbers (from 1) of the lines that end a chunk."""
    out = rows.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    out = out.withColumn("__h", F.transform("__lines", lambda x: F.xxhash64(x)))
    out = with_rolling(out, "__h", window, "__r")
    # No lambda refers to another array here: the optimizer would compute that array anew for every element.
    ends = F.transform("__r", lambda r, i: F.when(F.pmod(r, F.lit(divisor)) == 0, i + window))
    return out.withColumn("__ends", F.array_distinct(F.concat(F.array_compact(ends), F.array(F.size("__lines"))))).drop("__r")


def _units(rows: DataFrame, text: str, window: int, divisor: int) -> DataFrame:
    """One row per chunk of two lines or more and per pair of neighbouring lines that are not blank: start and end (line
    numbers from 1), h, pair."""
    shape = "struct<start:int,end:int,h:bigint,pair:boolean>"
    out = chunked(rows, text, window, divisor)
    filled = F.transform("__lines", lambda x, i: F.when(F.trim(x, F.lit(" \t\r")) != "", F.struct(
        (i + 1).alias("n"), F.xxhash64(x).alias("h"))))
    out = out.withColumn("__filled", F.array_compact(filled))
    fewer = F.greatest(F.size("__filled") - 1, F.lit(0))
    # the hash of a pair must differ from that of a chunk of the same two lines
    pairs = F.zip_with(F.slice("__filled", F.lit(1), fewer), F.slice("__filled", F.lit(2), fewer), lambda a, b: F.struct(
        a["n"].alias("start"), b["n"].alias("end"), F.xxhash64(F.lit("pair"), a["h"], b["h"]).alias("h"), F.lit(True).alias("pair")).cast(shape))
    begins = F.concat(F.array(F.lit(0)), F.slice("__ends", F.lit(1), F.size("__ends") - 1))
    chunks = F.zip_with(begins, F.col("__ends"), lambda a, b: F.struct(
        (a + 1).alias("start"), b.alias("end"), F.lit(None).cast("long").alias("h"), F.lit(False).alias("pair")).cast(shape))
    out = out.withColumn("__units", F.concat(chunks, pairs)).drop("__filled")
    # the outer form, since the other one filters by the size of the array, and that filter would compute it once more
    out = out.select(*rows.columns, "__h", F.explode_outer("__units").alias("u")).filter(F.col("u.end") > F.col("u.start"))
    chunk = F.xxhash64(F.slice("__h", F.col("u.start"), F.col("u.end") - F.col("u.start") + 1))
    return out.select(*rows.columns, "u.start", "u.end", F.coalesce("u.h", chunk).alias("h"), "u.pair")


def _lines_of(spans: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"]))))


def _runs(lines: Column) -> Column:
    """First and last of every run of successive numbers in a sorted array."""
    fewer = F.greatest(F.size(lines) - 1, F.lit(0))
    before = F.concat(F.array(F.lit(-1)), F.slice(lines, F.lit(1), fewer))
    after = F.concat(F.slice(lines, F.lit(2), fewer), F.array(F.lit(-1)))
    first = F.array_compact(F.zip_with(lines, before, lambda a, b: F.when(a != b + 1, a)))
    last = F.array_compact(F.zip_with(lines, after, lambda a, b: F.when(b != a + 1, a)))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def without_repeated_chunks(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                            window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """The rows of ``docs`` with all their columns; ``text`` has lost the lines that an earlier document holds too, in a chunk
    or beside the same neighbour. Added: __n_lines, __n_removed (lines) and __removed (first and last line of every run of
    removed lines, from 1).

    A unit is a content-defined chunk of two lines or more, or a pair of lines that are not blank with only blank lines
    between them. Of a repeated unit the document with the smallest id is the holder; in all others its lines go. Where a
    holder repeats a unit itself, its lines go but for the first place, unless they belong to a first place of another one.
    So every line that goes stays in an earlier document or at an earlier place, and single equal lines stay. Units count as
    equal only if their bytes are: those found by hash are compared, and where different bytes share a hash none goes.
    Units are counted before the shuffle, so one that a third of the documents share is a few rows. A row is found again by
    its id and the hash of its text.

    Nulls: a null text stays null, an empty one is one empty line; a row without an id ranks behind all others and is told
    from them by its text. Repeated rows of one id are one document and keep the same lines. A text whose lines all go
    becomes empty, its row stays. An empty table gives an empty result. Columns may have any name that does not start with
    two underscores."""
    ready(spark)
    store = Stored(spark)
    key, mark = _row_key(F.col(doc_id), F.col(text))
    slim = docs.select(key.alias("id"), mark.alias("t"), F.col(text).alias("text"))
    spots = _units(slim, "text", window, divisor).drop("text")
    same = spots.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("holder"))
    repeated = store.keep(same.filter("m > 1").select(F.col("h").alias("g"), "holder"))
    place = F.struct("start", "end", "pair")
    shared = store.keep(spots.join(repeated, F.col("h") == F.col("g")).groupBy("id", "t", "h", "holder").agg(
        F.collect_set(place).alias("at")))
    shared = _without_collisions(store, slim, shared)

    first = F.slice("at", 1, 1)
    none = F.array().cast("array<struct<start:int,end:int,pair:boolean>>")
    late = F.col("holder") < F.col("id")
    spans = shared.withColumn("at", F.array_sort("at")).select(
        "id", "t", F.when(late, F.col("at")).otherwise(none).alias("late"), F.when(late, none).otherwise(first).alias("stay"),
        F.when(late, none).otherwise(F.slice("at", F.lit(2), F.size("at"))).alias("again"))
    lines = spans.groupBy("id", "t").agg(*[_lines_of(F.flatten(F.collect_list(c))).alias(c) for c in ("late", "stay", "again")])
    gone = lines.select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.array_sort(
        F.array_union("late", F.array_except("again", "stay"))).alias("__gone"))
    gone = store.keep(gone.filter(F.size("__gone") > 0))
    gone = _small(gone, F.size("__gone"))

    rows = docs.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    rows = rows.withColumns({"__my_id": key, "__my_t": mark})
    rows = rows.join(gone, (F.col("__my_id") == F.col("__id")) & (F.col("__my_t") == F.col("__t")), "left")
    nothing = F.array().cast("array<struct<first:int,last:int>>")
    rows = rows.withColumn("__removed", F.when(F.col("__gone").isNull(), nothing).otherwise(_runs(F.col("__gone"))))
    rows = rows.withColumn("__n_lines", F.size("__lines"))
    stays = F.array_except(F.sequence(F.lit(1), F.col("__n_lines")), F.col("__gone"))
    rest = F.array_join(F.flatten(F.transform(_runs(stays), lambda r: F.slice("__lines", r["first"], r["last"] - r["first"] + 1))), "\n")
    rows = rows.withColumns({text: F.when(F.col("__gone").isNull(), F.col(text)).when(
        F.size("__gone") == F.col("__n_lines"), "").otherwise(rest), "__n_removed": F.coalesce(F.size("__gone"), F.lit(0))})
    return rows.select(*docs.columns, "__n_lines", "__n_removed", "__removed")


def _small(rows: DataFrame, entries: Column) -> DataFrame:
    """Rows of two longs and some 4-byte entries, to be broadcast if they are few; beyond that their join shuffles."""
    n, m = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(entries), F.lit(0))).first()
    return F.broadcast(rows) if 64 * n + 4 * m <= BROADCAST_BYTES else rows


def _without_collisions(store: Stored, slim: DataFrame, shared: DataFrame) -> DataFrame:
    """The shared units without those whose hash stands for different bytes."""
    mine = shared.select(F.col("id").alias("i"), F.col("t").alias("k"), F.col("h").alias("g"), "at")
    per_row = store.keep(mine.groupBy("i", "k").agg(F.collect_list(F.struct("g", "at")).alias("units")))
    per_row = _small(per_row, F.aggregate("units", F.lit(0), lambda a, u: a + 4 + 4 * F.size(u["at"])))
    rows = slim.join(per_row, (F.col("id") == F.col("i")) & (F.col("t") == F.col("k")))
    rows = rows.withColumn("__lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    rows = rows.select("__lines", F.explode_outer("units").alias("u")).select("__lines", "u.g", F.explode_outer("u.at").alias("p"))
    both = F.concat_ws("\n", F.get("__lines", F.col("p.start") - 1), F.get("__lines", F.col("p.end") - 1))
    chunk = F.array_join(F.slice("__lines", F.col("p.start"), F.col("p.end") - F.col("p.start") + 1), "\n")
    texts = rows.select("g", F.when(F.col("p.pair"), both).otherwise(chunk).alias("bytes")).groupBy("g", "bytes").agg(
        F.count(F.lit(1)).alias("m"))
    clash = store.keep(texts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"))
    return shared.join(clash, F.col("h") == F.col("g"), "left_anti") if clash.limit(1).count() else shared
