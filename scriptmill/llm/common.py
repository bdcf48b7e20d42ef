"""What the operators share: session settings, stored intermediate tables, prefix sums, groups, components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptmill.session import prepare, scratch_dir

# Arrow batches stay small in bytes also where texts are long; a Python task then holds a few MB of text at a time.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    prepare(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; it goes with the session, or earlier by ``forget``."""
    return scratch_dir(spark)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Stored:
    """Tables that one operator writes to the shared folder and reads again: a lost executor loses nothing, and what a
    later step reads is the same as what an earlier one has read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write and read again. The schema is taken from the frame, so an empty one can be read too."""
        path = fresh_folder(self.spark)
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames_from: int) -> None:
        """Delete the tables with these numbers (all without any); the caller must have read them for the last time."""
        chosen = [self.paths[i] for i in frames_from] if frames_from else list(self.paths)
        forget(self.spark, *chosen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def running_totals(rows: DataFrame, part: str, order: list[str], value: str, before: str, number: str) -> DataFrame:
    """Add ``before`` (sum of ``value`` of all earlier rows) and ``number`` (count of earlier rows) in the order of
    (``part``, ``order``). ``rows`` must be a stored table. Only one row per part meets in one task: parts are as many as
    the partitions that wrote the table, and within a part a window counts."""
    totals = rows.groupBy(F.col(part).alias("__p")).agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__p",
        F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("__v0"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
    )
    inside = Window.partitionBy(part).orderBy(*order)
    local = rows.withColumn("__i", F.row_number().over(inside).cast("long") - 1).withColumn(
        "__s", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row per partition of a stored table: the driver schedules each of them, so they always fit in a broadcast.
    joined = local.join(F.broadcast(offsets), F.col(part) == F.col("__p"))
    return joined.withColumn(before, F.col("__v0") + F.col("__s")).withColumn(
        number, F.col("__n0") + F.col("__i")).drop("__p", "__v0", "__n0", "__i", "__s")


def with_rolling(df: DataFrame, hashes: str, n: int, out: str) -> DataFrame:
    """Add hashes of all runs of ``n`` entries of an array of longs, by doubling: runs of 2, of 4, ... and two overlapping
    runs for the rest. A shorter array gives an empty one. Each step is a column, so nothing is computed twice."""
    df, width = df.withColumn(out, F.col(hashes)), 1
    while width < n:
        step = min(width, n - width)
        keep = F.greatest(F.size(out) - step, F.lit(0))
        shifted = F.slice(out, F.lit(step + 1), keep)
        df = df.withColumn(out, F.zip_with(F.slice(out, F.lit(1), keep), shifted, lambda a, b: F.xxhash64(a, b)))
        width += step
    return df


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), the root being the smallest node reachable.

    Alternating large-star and small-star steps: every step hangs the neighbours of a node below the smallest of them,
    until nothing moves. Neighbours are aggregated, never collected in a list, and each step is stored. Nodes may be of
    any ordered type. Edges with a null end and loops carry nothing and are left out."""
    store = Stored(spark)
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = store.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        large = store.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v"))
        now = store.keep(small.distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    store.drop(*range(len(store.paths) - 1))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """One row that changes with the edge list."""
    n = F.count(F.lit(1))
    return tuple(edges.agg(n, F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("u", "v"))).first())


def code_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), T.StructType.fromDDL(schema))
