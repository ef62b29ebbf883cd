"""Processing only new or changed records (problem 3).

A record is one (change_id, revision) of a worktree; its position in commit order is the
earliest time it arrived. A run fixes an upper limit of that position when it starts, takes
the records between each consumer's high watermark and the limit, and commits its output
and the new watermark by one manifest that names both. Whatever fails before that leaves no trace
that a reader can see, so nothing is skipped and nothing comes out twice.

Edge cases: a record without any arrival time has been processed by no one, so it is pending for every consumer, once; repeated deliveries
count once at their earliest arrival; equal finish times of two runs are decided by the greater
run_id; empty tables give empty results (an empty watermark table makes every record a
case); extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import list_names, read_text, write_once

WORKTREE = ["repository_id", "worktree_id"]
RECORD = [*WORKTREE, "change_id", "revision"]

#: The order of fact kinds within a generation.
FACT_KINDS = ["file", "provenance", "node", "edge"]


def kind_rank(kind: Column) -> Column:
    """Position of a fact kind in the global fact order; null for any other text."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(FACT_KINDS))):
        rank = F.when(kind == name, i).otherwise(rank)
    return rank


def upper_limit(feed: DataFrame, arrival: str = "arrived_at") -> str | None:
    """The greatest arrival now present, as text: fixed once, at a run's start. None if there is none."""
    return feed.agg(F.max(arrival).cast("string").alias("upper")).first()["upper"]


def records_by_arrival(feed: DataFrame, upper: str | None = None) -> DataFrame:
    """One row per record that arrived at or before ``upper``, at its earliest arrival."""
    if upper is not None:
        # Cast to the column's own type, so that no time zone comes in.
        limit = F.lit(upper).cast(dict(feed.dtypes)["arrived_at"])
        feed = feed.where((F.col("arrived_at") <= limit) | F.col("arrived_at").isNull())
    return feed.groupBy(*RECORD).agg(
        F.min("arrived_at").alias("arrived_at"),
        F.min("generation_sequence").alias("generation_sequence"),
        F.min("fact_kind").alias("fact_kind"),
        F.min("fact_id").alias("fact_id"),
    )


def committed_positions(watermarks: DataFrame) -> DataFrame:
    """Per worktree the committed run with the greatest finished_at; other runs left nothing."""
    run = F.struct(
        "finished_at", "run_id", "started_at", "generation_sequence",
        "pending_sequence", "cursor_fact_kind", "cursor_fact_id",
    )
    return (
        watermarks.where((F.col("status") == "committed") & F.col("finished_at").isNotNull())
        .groupBy(*WORKTREE)
        .agg(F.max(run).alias("run"))
        .select(
            *WORKTREE,
            F.col("run.started_at").alias("run_started_at"),
            F.col("run.generation_sequence").alias("run_sequence"),
            F.col("run.pending_sequence").alias("run_pending"),
            kind_rank(F.col("run.cursor_fact_kind")).alias("cursor_rank"),
            F.col("run.cursor_fact_id").alias("cursor_id"),
        )
    )


def checkpoint_positions(checkpoints: DataFrame, stream: str = "inference") -> DataFrame:
    """Per worktree and generation sequence the latest time that the stream checkpointed it."""
    return (
        checkpoints.where(F.col("stream") == stream)
        .groupBy(*WORKTREE, F.col("sequence").alias("generation_sequence"))
        .agg(F.max("checkpointed_at").alias("checkpointed_at"))
    )


def pending_records(
    feed: DataFrame, watermarks: DataFrame, checkpoints: DataFrame, upper: str | None = None, stream: str = "inference"
) -> DataFrame:
    """(consumer, record, position) of every record that a consumer has still to process.

    One pass over the feed serves both consumers: the records are grouped once, the two
    position tables are joined to them, and the consumers for which a record is
    pending are exploded.
    """
    return _pending_of(records_by_arrival(feed, upper), watermarks, checkpoints, stream)


def _pending_of(records: DataFrame, watermarks: DataFrame, checkpoints: DataFrame, stream: str) -> DataFrame:
    rows = (
        records
        .join(committed_positions(watermarks), WORKTREE, "left")
        .join(checkpoint_positions(checkpoints, stream), [*WORKTREE, "generation_sequence"], "left")
    )
    rank = kind_rank(F.col("fact_kind"))
    seen = F.col("arrived_at") <= F.col("run_started_at")
    in_partial = (F.col("generation_sequence") == F.col("run_pending")) & (
        (rank < F.col("cursor_rank")) | ((rank == F.col("cursor_rank")) & (F.col("fact_id") <= F.col("cursor_id")))
    )
    by_run = F.coalesce(seen & ((F.col("generation_sequence") <= F.col("run_sequence")) | in_partial), F.lit(False))
    by_stream = F.coalesce(F.col("checkpointed_at") >= F.col("arrived_at"), F.lit(False))
    consumers = F.array_compact(
        F.array(F.when(~by_run, F.lit("materializer")), F.when(~by_stream, F.lit("inference")))
    )
    return rows.where(F.size(consumers) > 0).select(
        F.explode(consumers).alias("consumer"), *RECORD, "generation_sequence", "fact_kind", "fact_id", "arrived_at"
    )


def not_yet_seen(rows: DataFrame, seen: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key is not among ``seen``; null keys are equal to each other."""
    if seen is None:
        return rows
    a, b = rows.alias("a"), seen.select(*keys).distinct().alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left_anti")


class IncrementalRun:
    """Exactly-once runs of one consumer over a growing table with a monotonic position column.

    ``root`` holds ``data/run-N`` (outputs) and ``commits/N.json`` (manifests). A manifest names
    its output and the watermark reached, so both become visible together; an output without
    a manifest belongs to a run that failed and is never read.

    Rows may come later with the watermark's own position. With ``keys``, which outputs then carry beside the position,
    such rows are told from those already committed, and so are rows without a position. Without keys
    positions must be a commit sequence: a null or repeated position is an error, and so is a row that turns up at or below the watermark.
    """

    def __init__(self, spark: SparkSession, root: str, position: str, keys: list[str] = ()):
        self.spark, self.root, self.position, self.keys = spark, root.rstrip("/"), position, list(keys)

    def _names(self) -> list[str]:
        return [n for n in list_names(self.spark, f"{self.root}/commits") if n.endswith(".json")]

    def _read(self, name: str) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/commits/{name}"))

    def commits(self) -> list[dict]:
        return [self._read(n) for n in self._names()]

    def last(self) -> dict | None:
        """The last commit; one manifest is read, whatever their number."""
        names = self._names()
        return self._read(names[-1]) if names else None

    def watermark(self):
        done = self.last()
        return done["watermark"] if done else None

    def _committed_at(self, low: str) -> list[str]:
        """Outputs of the runs that ended at this watermark."""
        out = []
        for name in reversed(self._names()):
            if (c := self._read(name))["watermark"] != low:
                break
            out.append(c["output"])
        return out

    def take(self, source: DataFrame, high: str | None = None) -> tuple[DataFrame, dict]:
        """The rows of this run and its ticket: the limits, fixed here, before anything is computed.

        ``high`` is the upper limit as text, if the caller has fixed it; else it is the greatest position now present.
        """
        done, pos = self.last(), F.col(self.position)
        low = done["watermark"] if done else None
        kind = dict(source.dtypes)[self.position]
        at = lambda text: F.lit(text).cast(kind)
        if high is None:
            high = source.agg(F.max(self.position).cast("string").alias("m")).first()["m"]
        if high is None or (low is not None and self.spark.range(1).select(at(high) < at(low)).first()[0]):
            high = low  # a watermark never goes back
        ticket = {"run": done["run"] + 1 if done else 1, "low": low, "watermark": high}
        if not self.keys:
            rows = source.where("false") if high is None else source.where(pos <= at(high))
            rows = rows if low is None else rows.where(pos > at(low))
            self._refuse_unordered(source, rows, done, kind, ticket)
            return rows, ticket
        reach = F.lit(False) if high is None else pos <= at(high)
        if done is None:
            return source.where(reach | pos.isNull()), ticket
        # Of what has been committed only rows without a position and those at the watermark itself can be met again.
        seen = self.spark.read.parquet(*[c["output"] for c in self.commits()]).where(pos.isNull())
        if low is not None:
            reach = reach & (pos >= at(low))
            seen = seen.select(self.position, *self.keys).unionByName(
                self.spark.read.parquet(*self._committed_at(low)).where(pos == at(low)).select(self.position, *self.keys)
            )
        return not_yet_seen(source.where(reach | pos.isNull()), seen, [self.position, *self.keys]), ticket

    def _refuse_unordered(self, source: DataFrame, rows: DataFrame, done: dict | None, kind: str, ticket: dict) -> None:
        pos = F.col(self.position)
        below = F.lit(0) if done is None else F.count_if(pos <= F.lit(done["watermark"]).cast(kind))
        found = source.agg(F.count_if(pos.isNull()).alias("nulls"), below.alias("below")).first()
        if found["nulls"]:
            raise ValueError(f"{found['nulls']} rows have no {self.position}")
        if done is not None and found["below"] > done["through"]:
            raise ValueError(f"{found['below'] - done['through']} rows came late, at or below the watermark {done['watermark']}")
        if not rows.groupBy(self.position).count().where("count > 1").isEmpty():
            raise ValueError(f"{self.position} is not unique")
        # Positions are unique, so this counts the rows that the watermark covers.
        ticket["through"] = found["below"] + rows.count()

    def commit(self, output: DataFrame, ticket: dict) -> bool:
        """Write the output, then publish it with the watermark. False if another run won."""
        path = f"{self.root}/data/run-{ticket['run']}-{uuid.uuid4().hex[:8]}"
        output.write.parquet(path)
        return write_once(
            self.spark, f"{self.root}/commits/{ticket['run']:08d}.json", json.dumps(ticket | {"output": path})
        )

    def output(self) -> DataFrame | None:
        """All that was committed."""
        paths = [c["output"] for c in self.commits()]
        return self.spark.read.parquet(*paths) if paths else None


def run_pending(
    feed: DataFrame, watermarks: DataFrame, checkpoints: DataFrame, root: str, upper: str | None = None, stream: str = "inference"
) -> bool:
    """One run over the feed: commits the records that each consumer has still to process together with the arrival reached.

    The upper limit is fixed first. Records that an earlier run under ``root`` has committed do not come again, those that arrived
    since, also within the watermark's own microsecond, do. False if another run committed meanwhile; then nothing of this one is seen.
    """
    run = IncrementalRun(feed.sparkSession, root, "arrived_at", RECORD)
    upper = upper_limit(feed) if upper is None else upper
    rows, ticket = run.take(records_by_arrival(feed, upper), upper)
    found = _pending_of(rows, watermarks, checkpoints, stream).select("consumer", *RECORD, "arrived_at")
    return run.commit(found, ticket)


def committed_pending(spark: SparkSession, root: str) -> DataFrame:
    """What the runs under ``root`` have committed, as their manifests name it."""
    return IncrementalRun(spark, root, "arrived_at", RECORD).output()
