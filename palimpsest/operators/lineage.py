"""Change sets and consequences.

A change set groups events; its declarations and memberships are versioned by the sequence at which they were stated.
A consequence is a versioned relation between endpoints, read as of a generation, over a range, or as a trace in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.intervals import levels_of, nodes_over, nodes_within

PLACE = ["repository_id", "worktree_id"]
OPEN = 2**63 - 1


def declaration_versions(declarations: DataFrame, keys: list[str]) -> DataFrame:
    """Each declaration holds until the next of the same set: (keys, sequence, ..., valid_until_sequence)."""
    by = Window.partitionBy(*keys).orderBy("sequence")
    return declarations.withColumn("valid_until_sequence", F.lead("sequence").over(by)).withColumnRenamed("sequence", "valid_from_sequence")


def memberships_as_of(memberships: DataFrame, keys: list[str], sequence: int) -> DataFrame:
    """Members at a sequence: the last add or remove of each by then is an add. memberships: (keys, event_id, sequence, op)."""
    last = memberships.where(F.col("sequence") <= sequence).groupBy(*keys, "event_id").agg(F.max_by("op", F.struct("sequence", "op")).alias("op"))
    return last.where(F.col("op") == "add").drop("op")


def overlapping(versions: DataFrame, first: int, last: int) -> DataFrame:
    """Versions that overlap the inclusive range of sequences."""
    return versions.where(
        (F.col("valid_from_sequence") <= last) & (F.col("valid_until_sequence").isNull() | (F.col("valid_until_sequence") > first))
    )


def interval_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of overlapping versions of equal keys, by equi-joins on dyadic ranges of sequences.

    Both sides: (keys, valid_from_sequence, valid_until_sequence, ...), the right's other columns distinct from the left's. Two versions overlap
    where the right begins within the left, or the left begins within the right and not at its start; each pair is of one of these kinds
    and meets in one range. A version takes part in at most two ranges per level of the tree over the sequences, however long it is.
    Versions with a null key or start, or that end where they begin, overlap nothing.
    """
    columns = ["valid_from_sequence", "valid_until_sequence"]
    span = left.select(*columns).unionByName(right.select(*columns)).agg(
        F.min(columns[0]).alias("low"), F.max(F.greatest(*columns)).alias("high")
    ).first()
    low = span["low"] or 0
    top = (span["high"] or 0) - low + 1
    levels = levels_of(top + 1)

    def named(d: DataFrame, f: str, u: str) -> DataFrame:
        d = d.where(F.col(columns[0]).isNotNull() & (F.col(columns[0]) < F.coalesce(columns[1], F.lit(OPEN))))
        return d.withColumnsRenamed({columns[0]: f, columns[1]: u})

    def within(d: DataFrame, start: Column, u: str) -> DataFrame:
        end = F.least(F.coalesce(u, F.lit(OPEN)) - low, F.lit(top)).cast("bigint")
        return d.withColumn("__n", F.explode(nodes_within(start - low, end, levels)))

    def begun(d: DataFrame, f: str) -> DataFrame:
        return d.withColumn("__n", F.explode(nodes_over(F.col(f) - low, levels)))

    a, b = named(left, "lf", "lu"), named(right, "rf", "ru")
    order = [*a.columns, *[c for c in b.columns if c not in keys]]
    first = within(a, F.col("lf"), "lu").join(begun(b, "rf"), [*keys, "__n"])
    second = begun(a, "lf").join(within(b, F.col("rf") + 1, "ru"), [*keys, "__n"])
    return first.select(*order).unionByName(second.select(*order))


def invalid_memberships(memberships: DataFrame, keys: list[str], events: DataFrame) -> DataFrame:
    """Memberships that both add and remove at one sequence, or name an unknown event: (keys, event_id, sequence, problem)."""
    both = memberships.groupBy(*keys, "event_id", "sequence").agg(F.countDistinct("op").alias("n")).where("n > 1")
    lost = memberships.join(events.select("event_id").distinct(), "event_id", "left_anti")
    return both.select(*keys, "event_id", "sequence", F.lit("add_and_remove").alias("problem")).unionByName(
        lost.select(*keys, "event_id", "sequence", F.lit("unknown_event").alias("problem")).distinct()
    )
