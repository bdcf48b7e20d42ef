"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join that feeds a grouping on the same key is split too, at the price of one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


# Shuffled bytes that AQE gives to one task inside ``small_tasks``; sorted rows take about thirty times as much memory.
TASK_BYTES = 8 << 20

# Those that a running session can take over; queries rely on them for time zones and for skewed joins.
RUNTIME = ["spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
           "spark.sql.adaptive.forceOptimizeSkewedJoin"]


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the queries rely on in a session that somebody else has built."""
    for key in RUNTIME:
        spark.conf.set(key, DEFAULTS[key])
    return spark


def sized_for(input_bytes: int) -> dict[str, str]:
    """Settings for an input of that size. A partition holds about 64 MB of text (whose tokens sort in a few GB) as long as
    there are fewer than 20 000 of them, and more of a larger input: the driver keeps track of map times reduce blocks. AQE
    merges partitions that turn out small and splits skewed ones."""
    target = max(64 << 20, -(-input_bytes // 20_000))
    return {
        "spark.sql.shuffle.partitions": str(max(200, -(-input_bytes // target))),
        "spark.sql.files.maxPartitionBytes": str(min(target, 512 << 20)),
    }


def build_session(app: str = "scriptmill", master: str | None = None, input_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the defaults above, sized for the input if its bytes are given; ``conf`` uses ``__`` for the dots of
    a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | (sized_for(input_bytes) if input_bytes else {}) | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a folder of our own only where none is set (tests, one machine)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
        shared = tempfile.mkdtemp(prefix="scriptmill-ckpt-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder, for tables that a job writes and reads again. It is deleted when
    the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only a folder that exists can be marked
    files.deleteOnExit(place)
    return f"{path}/table"


def store(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them again: what is read later is what was read first, its size is
    known to the planner, and it survives the loss of executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside have AQE merge shuffle partitions to TASK_BYTES at most, so that what a task sorts does not grow
    with the input. By default AQE merges them to one per core, and up to 64 MB."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(key, None)
    spark.conf.set(key, str(TASK_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if kept is None else spark.conf.set(key, kept)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives the loss of executors. Its files go when the frame does."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
