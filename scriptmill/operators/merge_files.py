"""MERGE on a table of files that writes only the files it changes. A table is a folder of Parquet files and a folder
``_versions`` with a list of files for each version; a merge adds files and, last of all, a list."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptmill.operators.merge import When, first_branch, inserted_rows, merged_rows
from scriptmill.session import small_tasks, store


class VersionedFiles:
    """The versions of one table. A list holds the schema in its first line and a file (folder/name) in each other one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """Number of the latest version, 0 before the first one."""
        folder = self._place("_versions")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def files(self, version: int) -> tuple[StructType, list[str]]:
        """Schema and files of a version."""
        text = self.spark.read.text(f"{self.path}/_versions/{version:08d}", wholetext=True).first().value
        schema, *names = text.splitlines()
        return StructType.fromJson(json.loads(schema)), names

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest one by default."""
        schema, names = self.files(version or self.version())
        return self.rows(schema, names)

    def rows(self, schema: StructType, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def write(self, rows: DataFrame) -> list[str]:
        """Write rows to a folder that no version names yet."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._place(folder))]
        return [f"{folder}/{n}" for n in sorted(names) if n.endswith(".parquet")]

    def commit(self, version: int, schema: StructType, names: list[str]) -> None:
        """Make the files a version. The list gets its name when it is whole, and only if no other writer has taken that."""
        draft, final = self._place(f"_versions/.{uuid.uuid4().hex}"), self._place(f"_versions/{version:08d}")
        out = self._files.create(draft, False)
        out.write(bytearray("\n".join([schema.json(), *names]), "utf-8"))
        out.close()
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        qualified = self._files.makeQualified
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(qualified(draft), qualified(final), options)


def create_files(rows: DataFrame, path: str) -> VersionedFiles:
    """A new table with the rows as its first version. It pays to have rows sorted or range-partitioned by the merge key."""
    table = VersionedFiles(rows.sparkSession, path)
    table.commit(1, rows.schema, table.write(rows))
    return table


def merge_files(table: VersionedFiles, source: DataFrame, on: list[str], branches: list[When]) -> dict[str, int]:
    """Merge into the latest version as ``merge_frames`` does; returns the new version and the numbers of files kept,
    replaced and added.

    Files in which a branch applies to some row are found by a join over the columns that keys and conditions name, with
    the range of the source's keys pushed to the scan. Only those files are read whole and written anew; all others keep name
    and time. New rows meet the keys of the target only. The list of files is the commit: a run that fails before leaves the
    latest version as it was, and its files are named by no list. Of two merges that run at once the second to commit fails.

    Null keys match nothing, so source rows with one are inserted if a branch says so. An empty source changes nothing."""
    before = table.version()
    schema, names = table.files(before)
    matched = [b for b in branches if b.action != "insert"]
    inserts = [b for b in branches if b.action == "insert"]
    source = store(source)
    target = table.rows(schema, names)

    bounds = source.agg(*[F.struct(F.min(k), F.max(k)) for k in on]).first()
    near = target
    for k, (low, high) in zip(on, bounds):
        near = near.where(F.lit(False) if low is None else F.col(k).between(low, high))
    touched: set[str] = set()
    if matched and names:
        file = F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1)
        same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]
        pairs = near.withColumn("__file", file).alias("t").join(source.alias("s"), same).where(first_branch(matched) >= 0)
        touched = {r[0] for r in pairs.select("t.__file").distinct().collect()}  # names of files, as many as the list has at most

    old = [n for n in names if n in touched]
    new: list[str] = []
    if old:
        with small_tasks(table.spark):
            new += table.write(merged_rows(table.rows(schema, old), source, on, matched))
    if inserts:
        fresh = store(inserted_rows(near, source, on, inserts))
        if not fresh.isEmpty():
            new += table.write(fresh)
    if not old and not new:
        return {"version": before, "kept": len(names), "replaced": 0, "added": 0}
    kept = [n for n in names if n not in touched]
    table.commit(before + 1, schema, kept + new)
    return {"version": before + 1, "kept": len(kept), "replaced": len(old), "added": len(new)}
