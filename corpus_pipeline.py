"""Five stages from raw documents to packed sequences. Each stage is one operator whose decisions take effect; what it keeps
is written as Parquet and read again as the input of the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import decontam, linededup, minhash, packing, quality
from scriptmill.llm.common import fresh_folder, ready, table
from scriptmill.plans.registry import query


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones among them."""
    return quality.with_scores(spark, docs, table(spark, sf_dir, "labels")).filter("__predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without line chunks that an earlier one holds; n_chars follows the text where there is one. Rows of
    which removal has left nothing go; texts that were empty before stay."""
    rows = linededup.without_repeated_chunks(spark, docs)
    rows = rows.filter((F.col("__n_removed") == 0) | (F.regexp_replace("text", r"\s++", "") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; five words a shingle."""
    return minhash.first_of_each(spark, docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in packed sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Neither a fitted classifier nor MinHash buckets nor best-fit bins can be written as one SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_folder(spark)
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


query("pipeline", ORACLE_SQL)(run)
