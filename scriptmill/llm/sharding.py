"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm.common import Stored, fresh_folder, partitions, ready, running_totals, unsigned_crc32, utf8_bytes

ROW_BYTES = 8


def assign_shards(spark: SparkSession, docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The rows are range-partitioned by (doc_id, text checksum, size, place in the input), so one id that fills a third of
    the table is cut like any other, and stored with the number of their partition; only numbers are, the text is read
    once. Totals per partition give offsets, a window inside a partition the rest of the prefix sum. A row belongs to the
    shard in which the middle of its bytes lies, so shards are contiguous and differ from the equal target by less than
    one row at either end.

    Nulls: a null text has no bytes and the checksum of the empty text; null ids come first. Ties and repeated rows are
    kept, each with a slot of its own. An empty table gives an empty result; shards may be empty if there are few rows.
    Other columns are ignored, whatever their names."""
    ready(spark)
    store = Stored(spark)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        (utf8_bytes(F.col(text)) + ROW_BYTES).alias("size"),
        unsigned_crc32(F.col(text)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "text_crc32", "size", "place"]
    placed = store.keep(
        sized.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    summed = store.keep(running_totals(placed, "part", order, "size", "before", "number"))
    total = summed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    cut = summed.withColumn("shard", F.expr(f"(2 * before + size) * {n_shards}L div {2 * total}L").cast("int"))
    first = cut.groupBy("shard").agg(F.min("number").alias("first"))  # a row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(spark: SparkSession, docs: DataFrame, n_shards: int, path: str | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> str:
    """Write the rows themselves into folders ``shard=i`` in the order of their slots; returns the folder. Ids must be
    unique and not null here, since rows are found again by their id."""
    path = path or fresh_folder(spark)
    place = assign_shards(spark, docs, n_shards, doc_id, text).select(F.col("doc_id").alias(doc_id), "shard", "slot")
    rows = docs.drop("shard", "slot").join(place, doc_id)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy(
        "shard").parquet(path)
    return path
