"""Integrity and freshness: what must be empty, and how an inventory compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["repository_id", "worktree_id"]
FACT = [*PLACE, "fact_kind", "fact_id"]


def history_violations(versions: DataFrame) -> DataFrame:
    """Overlapping, empty or doubly open versions of a fact: (FACT, valid_from_sequence, violation)."""
    by = Window.partitionBy(*FACT).orderBy("valid_from_sequence", F.col("valid_until_sequence").asc_nulls_last())
    nxt = F.lead("valid_from_sequence").over(by)
    open_ = F.sum(F.when(F.col("valid_until_sequence").isNull(), 1).otherwise(0)).over(Window.partitionBy(*FACT))
    rows = versions.withColumn("n", nxt).withColumn("open", open_)
    kind = (
        F.when(F.col("valid_until_sequence") <= F.col("valid_from_sequence"), "empty")
        .when(F.col("open") > 1, "several_open")
        .when(F.coalesce("valid_until_sequence", F.lit(2**63 - 1)) > F.col("n"), "overlap")
    )
    return rows.withColumn("violation", kind).where(F.col("violation").isNotNull()).select(*FACT, "valid_from_sequence", "violation")


def chain_gaps(generations: DataFrame) -> DataFrame:
    """Generations whose sequence does not follow the one before, or whose parent is not that one."""
    by = Window.partitionBy(*PLACE).orderBy("generation_sequence")
    g = generations.select(*PLACE, "generation", "parent_generation", "generation_sequence").distinct()
    rows = g.withColumn("before", F.lag("generation").over(by)).withColumn("previous", F.lag("generation_sequence").over(by))
    broken = (F.col("generation_sequence") != F.coalesce(F.col("previous"), F.lit(0)) + 1) | ~F.col("parent_generation").eqNullSafe(F.col("before"))
    return rows.where(broken).select(*PLACE, "generation", "generation_sequence")


def freshness(indexed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Counts of unindexed, changed and removed files per place: (place, file_id, content_hash) on both sides."""
    a = indexed.select(*PLACE, "file_id", F.col("content_hash").alias("was"))
    b = inventory.select(*PLACE, "file_id", F.col("content_hash").alias("now"))
    state = F.when(F.col("was").isNull(), "unindexed").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return (
        a.join(b, [*PLACE, "file_id"], "full_outer")
        .withColumn("state", state)
        .groupBy(*PLACE)
        .agg(*[F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(s) for s in ("unindexed", "changed", "removed", "same")])
    )


def processing_coverage(files: DataFrame) -> DataFrame:
    """Each file version as completed, syntax_failed or unclassified, counted by place."""
    state = (
        F.when(F.col("language").isNull(), "unclassified")
        .when(F.length(F.coalesce("diagnostic_message", F.lit(""))) > 0, "syntax_failed")
        .otherwise("completed")
    )
    return files.withColumn("state", state).groupBy(*PLACE, "state").agg(F.count("*").alias("files"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, which is an error wherever evidence must be single."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def root_check(roots: DataFrame, manifest: DataFrame) -> DataFrame:
    """(place, holds): whether each worktree's root and number of facts are those of its manifest; one without either side does not hold."""
    a = roots.select(*PLACE, F.struct("root", "facts").alias("__a"))
    b = manifest.select(*PLACE, F.struct("root", "facts").alias("__b"))
    return a.join(b, PLACE, "full_outer").select(*PLACE, F.col("__a").eqNullSafe(F.col("__b")).alias("holds"))
