"""History of changing entity attributes (problem 6).

A bitemporal ledger: every row says that an entity had some attributes over a period of
validity, and from when to when that was the recorded belief. A later statement about a
period that is already described splits the periods at its borders (sweep line over the
borders of the entity) and supersedes the earlier rows by closing their recorded period;
nothing is overwritten. The current history is the slice of rows whose recorded period is
open, with touching equal neighbours joined.

Edge cases: rows with a null key or null start or an empty period are left out; a null end is open; statements
recorded at the same time about the same period are decided by the greater payload, a null
field being least; null attributes equal null; repeated rows change nothing; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize

PLACE = ["repository_id", "worktree_id"]
#: An end that is open: beyond any sequence, with room for arithmetic.
OPEN = 2**62


def bitemporal_ledger(statements: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Rows (keys, valid_from, valid_until, payload, recorded_from, recorded_until) from
    statements (keys, valid_from, valid_until, recorded_at, payload).

    Sweep line: the borders of all statements of a key cut it into elementary periods, and a statement is laid over the periods that
    it covers. The sweep goes over the distinct periods stated, not over the statements: each looks for the next border after
    its start, and only those that go on past it are split, by the numbers of their two borders. So the work is that of the ledger's own
    rows, and statements that cover one period, as those of periodic snapshots do, are neither joined nor copied. Within a period
    the statements are ordered by recorded time and each is superseded by the next. Statements are windowed within one period of
    one key; over a whole key only its distinct periods and borders are.
    """
    said = statements.select(
        *keys,
        "valid_from",
        F.coalesce("valid_until", F.lit(OPEN)).alias("valid_until"),
        "recorded_at",
        F.struct(*payload).alias("payload"),
    ).where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x) & (F.col("valid_from") < F.coalesce("valid_until", F.lit(OPEN))))
    parts = _split_periods(said.select(*keys, "valid_from", "valid_until").distinct(), keys)
    if parts is None:
        laid = said.withColumn("p_from", F.col("valid_from")).withColumn("p_until", F.col("valid_until"))
    else:
        laid = said.join(parts, [*keys, "valid_from", "valid_until"], "left")
        laid = laid.withColumn("p_from", F.coalesce("p_from", "valid_from")).withColumn("p_until", F.coalesce("p_until", "valid_until"))
    return supersede(laid, keys, payload)


def _split_periods(spans: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, valid_from, valid_until, p_from, p_until): the elementary periods of each span that has several; None if none has."""
    ends = F.array(F.struct(F.col("valid_from").alias("at"), F.col("valid_until").alias("until")), F.struct(F.col("valid_until").alias("at"), F.lit(None).cast("bigint").alias("until")))
    borders = spans.select(*keys, F.explode(ends).alias("b")).select(*keys, "b.*")
    beyond = Window.partitionBy(*keys).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    long = borders.withColumn("next", F.min("at").over(beyond)).where("next < until").select(*keys, F.col("at").alias("valid_from"), F.col("until").alias("valid_until"))
    long = materialize(long, "long")
    if long.isEmpty():
        return None
    cut = borders.join(long.select(*keys).distinct(), keys, "left_semi").select(*keys, "at").distinct()
    after = Window.partitionBy(*keys).orderBy("at")
    periods = cut.select(*keys, F.col("at").alias("p_from"), F.lead("at").over(after).alias("p_until"), F.row_number().over(after).alias("p"))
    number = lambda c, n: periods.select(*keys, F.col("p_from").alias(c), F.col("p").alias(n))
    between = long.join(number("valid_from", "i"), [*keys, "valid_from"]).join(number("valid_until", "j"), [*keys, "valid_until"])
    between = between.withColumn("p", F.explode(F.sequence(F.col("i"), F.col("j") - 1))).drop("i", "j")
    return between.join(periods, [*keys, "p"]).select(*keys, "valid_from", "valid_until", "p_from", "p_until")


def supersede(laid: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Close each statement's recorded period at the next statement about the same elementary period; repeats count once."""
    within = Window.partitionBy(*keys, "p_from").orderBy("recorded_at", "payload")
    told = F.struct("recorded_at", "payload")
    # The order serves both windows, so that repeats go without a sort or a shuffle of their own.
    once = laid.withColumn("again", F.coalesce(F.lag(told).over(within).eqNullSafe(told), F.lit(False))).where("not again")
    following = F.lead(F.struct("recorded_at")).over(within)
    return once.withColumn("following", following).select(
        *keys,
        F.col("p_from").alias("valid_from"),
        F.when(F.col("p_until") != OPEN, F.col("p_until")).alias("valid_until"),
        *[F.col(f"payload.{c}").alias(c) for c in payload],
        F.col("recorded_at").alias("recorded_from"),
        F.col("following.recorded_at").alias("recorded_until"),
        F.col("following").isNull().alias("is_current"),
    )


def believed_at(ledger: DataFrame, recorded) -> DataFrame:
    """The slice of the ledger that was the recorded belief at a time."""
    return ledger.where(
        (F.col("recorded_from") <= F.lit(recorded))
        & (F.col("recorded_until").isNull() | (F.col("recorded_until") > F.lit(recorded)))
    )


def merged_history(slice_: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Join touching periods with equal attributes: (keys, payload, valid_from, valid_until)."""
    by = Window.partitionBy(*keys).orderBy("valid_from")
    state = F.struct(*payload)
    same = (F.lag("valid_until").over(by) == F.col("valid_from")) & F.lag(state).over(by).eqNullSafe(state)
    starts = slice_.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = starts.withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy(*keys, "__run")
        .agg(
            F.min("valid_from").alias("valid_from"),
            F.max(F.coalesce("valid_until", F.lit(OPEN))).alias("__end"),
            *[F.first(c).alias(c) for c in payload],
        )
        .select(*keys, *payload, "valid_from", F.when(F.col("__end") != OPEN, F.col("__end")).alias("valid_until"))
    )


EXTERNAL_KEY = [*PLACE, "node_id"]
EXTERNAL_PAYLOAD = ["namespace", "external_kind", "name", "stage", "schema_version"]


def snapshot_statements(snapshots: DataFrame) -> DataFrame:
    """Each snapshot row says that its node holds from the snapshot to the worktree's next one.

    The worktree's snapshots are reduced to their distinct sequences before the window, so the window's
    groups are as long as a worktree has snapshots, whatever the number of rows.
    """
    slots = snapshots.select(*PLACE, "as_of_sequence").where(F.col("as_of_sequence").isNotNull()).distinct()
    slots = slots.withColumn(
        "valid_until", F.lead("as_of_sequence").over(Window.partitionBy(*PLACE).orderBy("as_of_sequence"))
    )
    # Written first, so that the planner knows their size when it chooses the join.
    slots = materialize(slots, "slots")
    return snapshots.join(slots, [*PLACE, "as_of_sequence"]).select(
        *EXTERNAL_KEY,
        F.col("as_of_sequence").alias("valid_from"),
        "valid_until",
        F.col("loaded_at").alias("recorded_at"),
        *EXTERNAL_PAYLOAD,
    )


def external_ledger(snapshots: DataFrame) -> DataFrame:
    """The bitemporal ledger of External nodes from their periodic snapshots."""
    return bitemporal_ledger(
        snapshot_statements(snapshots).where(F.col("node_id").isNotNull()), EXTERNAL_KEY, EXTERNAL_PAYLOAD
    )


def external_versions(snapshots: DataFrame) -> DataFrame:
    """Every version of each External node, from the ledger's current slice."""
    current = external_ledger(snapshots).where("is_current").drop("is_current", "recorded_from", "recorded_until")
    return merged_history(current, EXTERNAL_KEY, EXTERNAL_PAYLOAD)


def version_counts(versions: DataFrame) -> DataFrame:
    """Versions by worktree and the sequence at which they begin."""
    return versions.groupBy(*PLACE, F.col("valid_from").alias("valid_from_sequence")).agg(F.count("*").alias("facts"))
