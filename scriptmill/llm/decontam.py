"""Benchmark decontamination by template windows: numbers, names and units become typed slots, windows of the template are
joined by hash, and the values in the slots must be replaced consistently. Windows of the plain tokens are joined beside them,
so that copies are found whatever their tokens are. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptmill.llm.common import Stored, ready, with_rolling

WINDOW = 8
# Literal words that a window of an item needs; windows of little but slots would match any table of numbers.
LITERALS = 4
# A hit covers so many tokens of an item, or this share of one with fewer.
COVERED, SHARE = 13, 0.8
# Items with fewer tokens than a window, but no fewer than these, are looked for inside longer texts too.
SHORTEST = 5
BROADCAST_ROWS = 1_000_000

UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs min mins h hr hrs second seconds minute minutes "
         "hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros pound pounds "
         "usd eur gbp mph kmh meter meters metre metres kilometer kilometers inch inches foot feet mile miles gram grams "
         "kilogram kilograms liter liters litre litres")
_NUMBER, _NAME, _UNIT, _LAST = "\u0001", "\u0002", "\u0003", "\u0004"


def template_tokens(text: Column) -> Column:
    """Lower-cased tokens; a number, a name (a capitalised word that follows a word or a comma, not the start of a
    sentence) and a unit behind a number start with the mark of their slot and keep their value behind it."""
    s = F.translate(text, _NUMBER + _NAME + _UNIT, "   ")
    s = F.regexp_replace(s, r"[$€£]?\d++(?:[.,:/]\d++)*+", _NUMBER + "$0 ")
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    s = F.regexp_replace(s, rf"({_NUMBER}\S++) *+(%|(?i:{units}))(?![\p{{L}}\p{{M}}])", f"$1 {_UNIT}$2")
    s = F.regexp_replace(s, r"\p{Lu}(?<=[\p{L}\p{M},;:] .)\p{Ll}++(?![\p{L}\p{M}])", _NAME + "$0")
    tokens = rf"({_NUMBER}[$€£\d.,:/]++|{_UNIT}%|[{_NAME}{_UNIT}]?[\p{{L}}\p{{M}}]++)"
    return F.regexp_extract_all(F.lower(s), F.lit(tokens), F.lit(1))


def _hashes(plain: bool) -> Column:
    """Hashes of ``tokens``. Plain: of what stands in a slot; else of the kind of the slot. Words have the same in both."""
    return F.transform("tokens", lambda t: F.when(t >= _LAST, F.xxhash64(t)).otherwise(
        F.xxhash64(F.substring(t, 2, 1 << 30) if plain else F.substring(t, 1, 1))))


def _rolled(rows: DataFrame, width: int, plain: bool, out: str) -> DataFrame:
    """Add hashes of all windows of ``tokens`` in order; a shorter text has one window, all of it."""
    rolled = with_rolling(rows.withColumn("hashes", _hashes(plain)), "hashes", width, out)
    whole = F.array(F.xxhash64("hashes", F.size("hashes")))
    n = F.size("hashes")
    return rolled.withColumn(out, F.when(n >= width, F.col(out)).when(n > 0, whole)).drop("hashes")


def _windows(rows: DataFrame, width: int, *columns: str) -> DataFrame:
    """One row per window of ``tokens``: the columns, pos, h and plain. Template windows come first, then the plain ones that
    differ from them; a template window without slots is a plain one too, but not marked as such."""
    rows = _rolled(_rolled(rows, width, False, "windows"), width, True, "plain")
    rows = rows.withColumn("plain", F.zip_with("windows", "plain", lambda w, p: F.when(w != p, p)))
    rows = rows.select(*columns, F.size("windows").alias("__n"), F.concat("windows", "plain").alias("both"))
    # the outer form, since the other one filters by the size of the array, and that filter would compute it once more
    out = rows.select(*columns, "__n", F.posexplode_outer("both").alias("at", "h")).filter("h IS NOT NULL")
    return out.select(*columns, F.expr("cast(at % __n AS int)").alias("pos"), "h", F.expr("at >= __n").alias("plain"))


def _short_hits(items: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Places inside texts of whole items with ``width`` tokens, fewer than a window has."""
    few = _rolled(items.filter(F.size("tokens") == width), width, True, "w").select(
        "item_id", F.lit(width).alias("n_tokens"), F.lit(0).alias("item_pos"), F.explode("w").alias("h"))
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    seen = _rolled(docs, width, True, "w").select("doc_id", "text_key", F.posexplode_outer("w").alias("doc_pos", "h"))
    return seen.join(few, "h").select("doc_id", "text_key", "doc_pos", "item_id", "item_pos", "n_tokens").distinct()


def _verbatim(hits: DataFrame, item_slots: DataFrame, width: int) -> DataFrame:
    """Pairs whose plain hits cover enough neighbouring tokens of an item in one stretch."""
    who = ["doc_id", "text_key", "item_id", "n_tokens"]
    length = F.least(F.lit(width), F.col("n_tokens"))
    rows = hits.withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    order = Window.partitionBy(*who, "diagonal").orderBy("item_pos")
    runs = rows.withColumn("run", F.col("item_pos") - F.row_number().over(order)).groupBy(*who, "diagonal", "run").agg(
        F.min("item_pos").alias("first"), F.max(F.col("item_pos") + length).alias("end"))
    runs = runs.filter(F.col("end") - F.col("first") >= F.least(F.lit(COVERED), F.ceil(F.col("n_tokens") * SHARE)))
    found = runs.select(*who, F.explode(F.sequence("first", F.col("end") - 1)).alias("item_pos")).distinct()
    found = found.join(item_slots, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_pos") == F.col("p")), "left")
    return found.groupBy(*who).agg(F.countDistinct("item_pos").cast("int").alias("covered"), F.count("p").alias("n_slots"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per pair of a document and a benchmark item found in it: doc_id, text_key (hash of the text), item_id,
    n_tokens (of the item), covered (its tokens found), n_slots, n_changed (slots with another value), kind ('verbatim' or
    're-parameterised').

    All windows of all documents meet the windows of the items by hash; only hits leave the scan. Hits on one diagonal
    (position in the document less position in the item) are an occurrence. Its slots are consistent if a value of the
    item is always replaced by the same value and different values by different ones; other occurrences do not count.
    The pair is reported if the occurrences left cover 13 tokens, or four fifths of a shorter item.

    Template windows of an item with fewer than four words outside slots are left to the plain ones: whatever its tokens are
    and in whatever case, a stretch of 13 equal tokens (four fifths of a shorter item) is a verbatim hit. A pair that is
    found both ways is verbatim.

    Nulls: null or wordless texts and items match nothing; rows with a null id are reported under null, and text_key tells
    them apart. Repeated rows of documents give one line. Items of five tokens or more, but fewer than a window, are found
    inside longer texts as a whole; shorter ones only where a whole document is the item. Empty tables give an empty result;
    other columns are ignored."""
    ready(spark)
    store = Stored(spark)
    items = store.keep(benchmark.select(F.col(item_id).alias("item_id"), template_tokens(F.col(item_text)).alias("tokens"))
                       .distinct())
    spots = _windows(items, width, "item_id", "tokens").withColumnsRenamed({"pos": "item_pos"}).withColumn("n_tokens", F.size("tokens"))
    part = F.slice("tokens", F.col("item_pos") + 1, width)
    literals = F.size(F.filter(part, lambda t: t >= _LAST))
    typed = ~F.col("plain") & ((literals >= LITERALS) | (F.col("n_tokens") < width))
    spots = spots.withColumns({"typed": typed, "plain": F.col("plain") | (literals == F.size(part))})
    spots = store.keep(spots.filter("typed OR plain").select("item_id", "n_tokens", "item_pos", "h", "typed", "plain"))
    # 40 bytes a row: broadcast if there are few, else both sides shuffle and skewed windows are split
    side = F.broadcast(spots) if spots.count() <= BROADCAST_ROWS else spots

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = F.xxhash64("text").alias("text_key")
    tokens = docs.select("doc_id", key, template_tokens(F.col("text")).alias("tokens"))
    seen = _windows(tokens, width, "doc_id", "text_key").select("doc_id", "text_key", F.col("pos").alias("doc_pos"), "h")
    place = ["doc_id", "text_key", "doc_pos", "item_id", "item_pos", "n_tokens"]
    both = store.keep(seen.join(side, "h").select(*place, "typed", "plain").distinct())
    hits, copies = both.filter("typed").select(*place).distinct(), both.filter("plain").select(*place)
    sizes = items.select(F.size("tokens").alias("n")).filter(F.col("n").between(SHORTEST, width - 1)).distinct()
    for (n,) in sizes.collect():  # three widths at most
        copies = copies.unionByName(store.keep(_short_hits(items, tokens, n)))

    who = ["doc_id", "text_key", "item_id", "diagonal"]
    found = hits.withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    length = F.least(F.lit(width), F.col("n_tokens"))
    covered = found.withColumn("k", F.explode(F.sequence(F.lit(0), length - 1))).select(
        *who, "n_tokens", (F.col("item_pos") + F.col("k")).alias("item_pos")).distinct()

    # values in the slots of the hits: only documents with hits are read again
    wanted = store.keep(hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    again = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), "left_semi")
    doc_slots = again.distinct().select("doc_id", key, F.posexplode_outer(template_tokens(F.col("text"))).alias("doc_pos", "new"))
    doc_slots = store.keep(doc_slots.filter(F.col("new") < _LAST)).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    item_slots = items.select(F.col("item_id").alias("i"), F.posexplode("tokens").alias("p", "old")).filter(F.col("old") < _LAST)
    slots = covered.join(item_slots, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_pos") == F.col("p")))
    slots = slots.withColumn("at", F.col("item_pos") + F.col("diagonal")).join(
        doc_slots, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("at") == F.col("doc_pos")))
    pairs = store.keep(slots.groupBy(*who, "old", "new").agg(F.count(F.lit(1)).alias("m")))
    per_old = pairs.groupBy(*who, "old").agg(F.count(F.lit(1)).alias("news"), F.sum("m").alias("m"),
                                             F.sum(F.when(F.col("old") != F.col("new"), F.col("m")).otherwise(0)).alias("c"))
    per_new = pairs.groupBy(*who, "new").agg(F.count(F.lit(1)).alias("olds"))
    verdict = per_old.groupBy(*who).agg(F.max("news").alias("news"), F.sum("m").alias("n_slots"), F.sum("c").alias("n_changed"))
    verdict = _null_safe(verdict, per_new.groupBy(*who).agg(F.max("olds").alias("olds")), who, "inner")
    good = _null_safe(covered, verdict, who, "left").filter("coalesce(news, 1) = 1 and coalesce(olds, 1) = 1")
    best = good.groupBy(*who, "n_tokens").agg(F.collect_set("item_pos").alias("places"), F.first("n_slots").alias("n_slots"),
                                              F.first("n_changed").alias("n_changed"))
    pair = best.groupBy("doc_id", "text_key", "item_id", "n_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.sum("n_changed"), F.lit(0)).alias("n_changed"))
    least = F.least(F.lit(COVERED), F.ceil(F.col("n_tokens") * SHARE))
    pair = pair.filter(F.col("covered") >= least).withColumn("same", F.col("n_changed") == 0)
    copied = _verbatim(copies.distinct(), item_slots, width).withColumns({"n_changed": F.lit(0).cast("long"), "same": F.lit(True)})
    best = F.max(F.struct("same", "covered", "n_slots", "n_changed")).alias("b")
    pair = pair.unionByName(copied).groupBy("doc_id", "text_key", "item_id", "n_tokens").agg(best)
    return pair.select("doc_id", "text_key", "item_id", "n_tokens", "b.covered", "b.n_slots", "b.n_changed",
                       F.when(F.col("b.same"), "verbatim").otherwise("re-parameterised").alias("kind"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    names = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, other in names.items():
        on = on & F.col(k).eqNullSafe(F.col(other))
    return left.join(right, on, how).drop(*names.values())


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no item of the benchmark."""
    ready(spark)
    store = Stored(spark)
    hits = store.keep(contaminated(spark, docs, benchmark, doc_id, text).select(
        F.col("doc_id").alias("__leak_id"), F.col("text_key").alias("__leak_text")).distinct())
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    return docs.join(hits, docs[doc_id].eqNullSafe(F.col("__leak_id")) & (F.xxhash64(docs[text]) == F.col("__leak_text")),
                     "left_anti")
