"""Findings of the files that have not been seen yet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from scriptmill.operators.lint import findings
from scriptmill.sources.corpus import FILE_SCHEMA, as_scripts

UNREADABLE = "UNREADABLE_FILE"


def findings_of_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.sql",
                          separator: str | None = None, max_files: int = 10_000) -> StreamingQuery:
    """Read the files that arrived since the last run, append their findings to ``out`` and stop.

    The checkpoint remembers the files, the file sink commits each batch once, so a run that is started again after a
    failure neither loses nor repeats findings. Nothing else is kept between runs. A file that is no UTF-8 text gives one
    row with the rule UNREADABLE_FILE, and the others go on.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)
    )
    readable = F.is_valid_utf8(F.col("content"))
    found = findings(as_scripts(files.where(readable), separator))
    error = {"rule": F.lit(UNREADABLE), "severity": F.lit("HIGH"), "script_id": F.col("path"), "path": F.col("path")}
    broken = files.where(~readable).select(*[
        error.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema])
    return (
        found.unionByName(broken).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
