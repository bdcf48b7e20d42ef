"""MERGE on tables that have no MERGE: target and source in, the new target out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.session import small_tasks, store


@dataclass(frozen=True)
class When:
    """One WHEN branch. Conditions and values name columns as ``t.x`` (target) and ``s.x`` (source).

    action: update or delete of matched rows, insert of source rows without a match. ``values`` maps target columns to
    expressions; an insert leaves the columns it does not name NULL.
    """

    action: str
    condition: Column | None = None
    values: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.action not in ("update", "delete", "insert"):
            raise ValueError(f"unknown action {self.action}")


def first_branch(branches: list[When]) -> Column:
    """Number of the first branch whose condition holds; NULL conditions do not hold."""
    return F.coalesce(*[
        F.when(F.lit(True) if b.condition is None else F.coalesce(b.condition, F.lit(False)), F.lit(i))
        for i, b in enumerate(branches)
    ], F.lit(-1))


def merge_frames(target: DataFrame, source: DataFrame, on: list[str], branches: list[When]) -> DataFrame:
    """The target after the merge. The first branch that applies to a pair of a target and a source row is the only one
    carried out; several source rows of which a branch applies to one target row are an error, those to which none applies
    do nothing. The order of rows plays no part.

    Keys with one source row, nearly all, are decided in one left join. Only keys with several are paired, counted per
    target row and checked. Both joins keep the large side on the side that AQE can split when a key is hot. The result is
    stored, by tasks whose memory does not grow with the input.
    """
    with small_tasks(target.sparkSession):
        return store(merged_rows(target, source, on, branches))


def merged_rows(target: DataFrame, source: DataFrame, on: list[str], branches: list[When]) -> DataFrame:
    """``merge_frames`` as a plan, for a caller that writes the rows itself, inside ``small_tasks``."""
    matched = [b for b in branches if b.action != "insert"]
    inserts = [b for b in branches if b.action == "insert"]
    result = _matched(target, source, on, matched) if matched else target
    return result.unionByName(inserted_rows(target, source, on, inserts)) if inserts else result


def inserted_rows(target: DataFrame, source: DataFrame, on: list[str], inserts: list[When]) -> DataFrame:
    """Rows that the insert branches make of the source rows without a match."""
    same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]
    keys = target.select(*on).distinct().alias("t")
    fresh = source.alias("s").join(keys, same, "left_anti").withColumn("__branch", first_branch(inserts))

    def inserted(c: str) -> Column:
        value = F.lit(None)
        for i, b in enumerate(inserts):
            if c in b.values:
                value = F.when(F.col("__branch") == i, b.values[c]).otherwise(value)
        return value.cast(target.schema[c].dataType).alias(c)

    return fresh.where("__branch >= 0").select(*[inserted(c) for c in target.columns])


def _matched(target: DataFrame, source: DataFrame, on: list[str], matched: list[When]) -> DataFrame:
    """The target rows after updates and deletes."""
    columns = target.columns
    deletes = [i for i, b in enumerate(matched) if b.action == "delete"]

    def changed(rows: DataFrame) -> DataFrame:
        """Rows with the columns of t, s and __branch."""
        def new_value(c: str) -> Column:
            value = F.col(f"t.{c}")
            for i, b in enumerate(matched):
                if c in b.values:
                    value = F.when(F.col("__branch") == i, b.values[c]).otherwise(value)
            return value.cast(target.schema[c].dataType).alias(c)

        kept = rows.where(~F.col("__branch").isin(deletes) if deletes else F.lit(True))
        return kept.select(*[new_value(c) for c in columns])

    keyed = source.groupBy(*on).agg(F.first(F.struct(*source.columns)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    keyed = store(keyed)
    same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]
    # keys with one source row: the usual case, decided where the target row meets it
    one = keyed.where("__n = 1").select("__row.*", F.lit(True).alias("__hit")).alias("s")
    several = keyed.where("__n > 1").select(*on)
    some = not several.isEmpty()
    plain = target.alias("t").join(several.alias("s"), same, "left_anti") if some else target
    rows = plain.alias("t").join(one, same, "left")
    result = changed(rows.withColumn("__branch", F.when(F.col("s.__hit"), first_branch(matched)).otherwise(-1)))
    if not some:
        return result

    # keys with several: every pair is decided, and of a target row's pairs one may apply
    names = [F.col(f"t.{c}").alias(c) for c in columns]
    number = target.join(several, on, "left_semi").withColumn("__id", F.monotonically_increasing_id())
    number = store(number)
    pairs = number.alias("t").join(source.join(several, on, "left_semi").alias("s"), same).withColumn("__branch", first_branch(matched))
    applied = pairs.where("__branch >= 0")
    counts = applied.groupBy(F.col("t.__id").alias("__id")).agg(F.count(F.lit(1)).alias("__m"))
    idle = number.join(counts, "__id", "left_anti").select(*columns)
    checked = applied.select(F.struct(*names, F.col("t.__id").alias("__id")).alias("t"),
                             F.struct(*[F.col(f"s.{c}").alias(c) for c in source.columns]).alias("s"), "__branch")
    checked = checked.join(counts, F.col("t")["__id"] == F.col("__id")).withColumn("__branch", F.when(
        F.col("__m") > 1, F.raise_error(F.lit("merge: several source rows match one target row")).cast("int")).otherwise(
        F.col("__branch")))
    return result.unionByName(changed(checked)).unionByName(idle)
