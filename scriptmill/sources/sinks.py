"""Tables that a job writes: typed, partitioned, reloaded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.session import scratch_dir


def work_database(spark: SparkSession) -> str:
    """A fresh database whose managed tables live in the shared scratch folder."""
    name = f"work_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_dir(spark)}'")
    return name


def create_typed_table(spark: SparkSession, name: str, columns: list[tuple[str, str, str]], comment: str = "",
                       partitioned_by: list[str] | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS with column comments; ``columns`` are (name, type, comment)."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    body = ", ".join(f"{n} {t} COMMENT '{quote(c)}'" for n, t, c in columns)
    by = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING parquet{by} COMMENT '{quote(comment)}'")


def spread_by(df: DataFrame, by: list[str]) -> DataFrame:
    """Partition for a partitioned write: the rows of a partition value meet, and AQE splits a value with many bytes over
    several tasks and merges rare ones into one, by the advisory partition size."""
    return df.hint("rebalance", *by)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Partitioned Parquet; ``overwrite`` replaces only the partitions that occur in ``df``."""
    spread_by(df, by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_files(df: DataFrame, path: str, files: int) -> None:
    """The rows dealt evenly over so many files."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def reload_partition(spark: SparkSession, table: str, partition: dict[str, str], rows: DataFrame) -> None:
    """Replace one partition by the rows (the table's other columns, in order). The new files take the old ones' place when
    all are written: a failed run leaves the old partition, and rows may be derived from the table itself. Without rows the
    partition goes. Running it again gives the same table."""
    if rows.isEmpty():
        quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
        spec = ", ".join(f"`{k}` = '{quote(v)}'" for k, v in partition.items())
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
    else:
        columns = [c for c in spark.table(table).columns if c not in partition]
        reload_partitions(rows.toDF(*columns).withColumns({k: F.lit(v) for k, v in partition.items()}), table)


def reload_partitions(df: DataFrame, table: str) -> None:
    """Replace every partition that occurs in the rows, in one job; the other ones stay. The rows have the table's columns
    in their order."""
    spark = df.sparkSession
    by = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    df = spread_by(df.select(*spark.table(table).columns), by)
    view = f"reload_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(view)
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {table} SELECT * FROM {view}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", kept)
        spark.catalog.dropTempView(view)


def write_delimited(df: DataFrame, path: str, sep: str = "\u0001") -> None:
    """Delimited text with NULL written as an empty field."""
    df.write.mode("overwrite").option("sep", sep).option("nullValue", "").option("emptyValue", "").csv(path)


def read_dated_copies(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Copies of one table in folders that carry a date in their name, as one table with the date as column ``dt``."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return files.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias("dt"))
