"""The registered queries of the operators and the pipeline over small tables."""

import pytest
from cases import DOCS, table
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scriptmill.llm.common import fresh_folder

QUERIES, TWINS = entry.queries(), entry.oracle_sql()
MINE = [q for q in QUERIES if q == "pipeline" or q.startswith("op")]


def test_one_query_for_each_operator():
    assert len(MINE) == 14 and {q.split("_")[0] for q in MINE} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


@pytest.mark.parametrize("name", [q for q in MINE if q in TWINS])
def test_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    difference, n = compare(spark, connect(sf), QUERIES[name], TWINS[name], sf)
    assert difference == "" and n > 0


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_dedup", "decontamination", "best_fit_packing"]
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_folder(spark)
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns and 0 < out.count() <= n
        docs, n = out, out.count()
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == n


def test_stages_take_awkward_rows(spark):
    sf = "/root/testdata/sf0.001"
    for rows in (DOCS, []):
        docs = table(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= len(rows)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("source", F.lit(None).cast("string")), sf).count() > 0) == bool(rows)
