"""Joins, counts and profiles for keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.session import shuffle_partitions, store

def group_key(keys: list[str]) -> Column:
    """The keys as one struct. Structs are equal also where they hold NULLs, as groups are."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def hot_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(__group, __n): the groups with more rows than a shuffle partition holds on average. There are fewer of them than
    partitions, so the table can be broadcast. Counted map-side."""
    counts = df.groupBy(group_key(keys).alias("__group")).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") * shuffle_partitions(df.sparkSession) > F.lit(df.count()))


def with_group_stats(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Every row of ``df`` with its group's aggregates; NULL keys form a group.

    The aggregates are combined map-side and stored, and the rows meet them in a join of which each side comes straight
    from a table, so that a hot group's rows are split by size while the query runs.
    """
    stats = store(df.groupBy(group_key(keys).alias("__group")).agg(*aggs))
    names = [c for c in stats.columns if c != "__group"]
    return df.withColumn("__key", group_key(keys)).join(stats, F.col("__key") == F.col("__group")).select(*df.columns, *names)


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: number of keys, rows, the largest key's rows, the average and their ratio, and the rows per key that half,
    95 % and 99 % of the keys do not exceed. Keys are counted by their rows first, so the percentiles look at one line per
    different count."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    return sizes.agg(
        F.sum("m").alias("n_keys"), F.sum(F.col("n") * F.col("m")).alias("n_rows"), F.max("n").alias("max_rows"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("m")).alias("avg_rows"),
        (F.max("n") * F.sum("m") / F.sum(F.col("n") * F.col("m"))).alias("max_to_avg"),
        F.array_sort(F.collect_list(F.struct("n", "m"))).alias("sizes"),
    ).select("n_keys", "n_rows", "max_rows", "avg_rows", "max_to_avg", *[
        _reached("sizes", F.col("n_keys"), p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


def _reached(sizes: str, n_keys: Column, share: float) -> Column:
    """The smallest size up to which that share of the keys lies; ``sizes`` holds a line per different size, whose number
    grows with the square root of the rows at most."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("n"))
    step = F.aggregate(sizes, start, lambda a, x: F.struct(
        (a["seen"] + x["m"]).alias("seen"),
        F.coalesce(a["n"], F.when(a["seen"] + x["m"] >= F.ceil(n_keys * F.lit(share)), x["n"])).alias("n")))
    return step["n"]


def top_keys(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys with the most rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def two_phase_distinct(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key in two groupings: the first shuffles on (key, value), the second adds up partial counts,
    so a hot key is spread over its values."""
    return df.select(key, value).distinct().where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count(value).alias("n_distinct")
    )


def salted_distinct(df: DataFrame, key: str, value: str, salts: int) -> DataFrame:
    """Distinct values per key, counted inside salts of the value's hash and then added up."""
    salt = F.pmod(F.xxhash64(value), F.lit(salts))
    return (
        df.select(key, value, salt.alias("salt")).groupBy(key, "salt").agg(F.count_distinct(value).alias("n"))
        .groupBy(key).agg(F.sum("n").alias("n_distinct"))
    )


def join_fanout(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows an equi join on the key would give, per key, without running the join on the rows: both sides are counted
    first. (key, n_left, n_right, n_output), keys of both sides only."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    return a.join(b, key).select(key, "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("n_output"))


def copy_groups(df: DataFrame, signature: str, name: str) -> DataFrame:
    """Groups of rows with the same signature, one row per member: (name, n_copies, first_name), groups of one left out."""
    stats = [F.count(F.lit(1)).alias("n_copies"), F.min(name).alias("first_name")]
    return with_group_stats(df.select(name, signature), [signature], stats).where("n_copies > 1").select(
        name, "n_copies", "first_name"
    )
