"""Documents as rows of a unique doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialize


def unique_documents(documents: DataFrame) -> DataFrame:
    """Each doc_id once; rows with a null doc_id are left out. Of rows with one doc_id, any one is kept.

    Only ids are shuffled to find repeats. Texts move only where there are some, and then only those of repeated ids.
    """
    known = documents.where(F.col("doc_id").isNotNull())
    repeated = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return known
    once = known.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.join(repeated, "doc_id", "left_anti").unionByName(once)


#: Bytes that a Python task should have at least before its input is left as it is read.
SPREAD_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores where the planner's size estimate says that they would make too few tasks.

    A small table comes in one split, or is coalesced to one, though Python work on it is long. Larger inputs stay as
    they are split, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows
