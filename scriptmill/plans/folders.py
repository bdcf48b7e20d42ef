"""Script folders read whole, checked, and file by file as they arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptmill.operators import lint
from scriptmill.plans.corpus_lint import CORPUS, FINDINGS
from scriptmill.plans.registry import query
from scriptmill.session import scratch_dir
from scriptmill.sources import corpus
from scriptmill.sources.tables import table
from scriptmill.streaming.incremental import findings_of_new_files

# Closes each script of a bundle file.
END_OF_SCRIPT = "\n\u0001\n"


@query("s01_folder_scan", f"{CORPUS} SELECT length(sql) AS n_chars, count(*) AS n_scripts FROM scripts GROUP BY 1")
def s01(spark, d):
    folder = scratch_dir(spark)
    corpus.write_bundles(corpus.scripts_from_orders(spark, d), folder, END_OF_SCRIPT)
    scripts = corpus.scan_folder(spark, folder, "*.txt", END_OF_SCRIPT)
    return scripts.groupBy(F.length("sql").cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("n_scripts"))


@query("s02_checked_scan", "SELECT lang, lang = 'fr' AS has_errors FROM documents GROUP BY lang")
def s02(spark, d):
    """French texts are written in another encoding; their files become error rows and the others are read."""
    folder = scratch_dir(spark)
    docs = table(spark, d, "documents", "lang", "text")
    docs.where("lang <> 'fr'").write.partitionBy("lang").text(folder)
    docs.where("lang = 'fr'").write.mode("append").partitionBy("lang").option("encoding", "ISO-8859-1").csv(folder)
    rows = corpus.scan_folder_checked(spark, folder, "part-*")
    return rows.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")).agg(
        F.bool_or(F.col("error").isNotNull() & F.col("sql").isNull()).alias("has_errors"))


@query("s02_every_file", """SELECT o_orderstatus AS status, count(*) AS n_orders, true AS has_empty_file FROM orders GROUP BY 1
UNION ALL SELECT 'none', 0, true""")
def s02_every(spark, d):
    """A folder per order status with the keys of its orders, and an empty file in each; one folder has nothing else."""
    folder = scratch_dir(spark)
    orders = table(spark, d, "orders", "o_orderstatus", "o_orderkey").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("k"))
    orders.write.partitionBy("o_orderstatus").text(folder)
    for status in [*(r[0] for r in orders.select("o_orderstatus").distinct().collect()), "none"]:  # few values
        orders.where("k IS NULL").select("k").coalesce(1).write.mode("append").text(f"{folder}/o_orderstatus={status}")
    rows = corpus.scan_folder_checked(spark, folder, "part-*")
    lines = F.size(F.filter(F.split("sql", "\n"), lambda x: x != ""))
    return rows.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]+)", 1).alias("status")).agg(
        F.sum(lines).cast("bigint").alias("n_orders"), F.bool_or(F.col("sql") == "").alias("has_empty_file"))


@query("s01_folder_findings", f"{FINDINGS} SELECT rule, severity, count(*) AS n FROM findings GROUP BY 1, 2")
def s01_findings(spark, d):
    folder = scratch_dir(spark)
    corpus.write_bundles(corpus.scripts_from_orders(spark, d), folder, END_OF_SCRIPT)
    scripts = corpus.scan_folder(spark, folder, "*.txt", END_OF_SCRIPT)
    return lint.findings(scripts).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("s21_incremental_scan", f"{FINDINGS} SELECT rule, severity, count(*) AS n FROM findings GROUP BY 1, 2")
def s21(spark, d):
    """The corpus arrives in two deliveries; each run handles the files that are new."""
    folder, out, checkpoint = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    scripts = corpus.scripts_from_orders(spark, d).withColumn("late", F.col("sql").contains("merge"))
    for late in (False, True):
        corpus.write_bundles(scripts.where(F.col("late") == late), folder, END_OF_SCRIPT)
        findings_of_new_files(spark, folder, out, checkpoint, "*.txt", END_OF_SCRIPT).awaitTermination()
    return spark.read.parquet(out).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
