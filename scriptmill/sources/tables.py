"""Parquet star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; named columns are the only ones read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over the scans, for queries written as SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def code_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written in code. It becomes a local relation whose size the planner knows, so a join with it is
    broadcast by size and not by hint."""
    types = T.StructType.fromDDL(schema)
    columns = [list(c) for c in zip(*rows)]
    local = spark.createDataFrame(pa.table(dict(zip(types.names, columns))))
    return local.select(*[local[f.name].cast(f.dataType) for f in types])
