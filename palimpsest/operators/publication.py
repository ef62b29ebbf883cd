"""Publishing deltas: set-based application with cascade, change kinds, incremental materialization and hash chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import discard, file_system, materialize, scratch_path

PLACE = ["repository_id", "worktree_id"]


class StaleBase(RuntimeError):
    """The delta was prepared against a generation that is no longer the current one."""


class InvalidDelta(RuntimeError):
    """The delta breaks an invariant; nothing was published."""


def _none(rows: DataFrame, what: str) -> None:
    if not rows.isEmpty():
        raise InvalidDelta(what)


def apply_delta(
    state: dict[str, DataFrame], delta: dict[str, DataFrame], base: int | DataFrame | None, sequence: int | None = None, scope: list[str] = ()
) -> dict[str, DataFrame]:
    """The version tables after a delta at ``sequence``.

    state: nodes, edges, provenance, files, each with its id column, payload, valid_from_sequence and valid_until_sequence, for one
    worktree, and the delta's upsert_nodes, upsert_edges, upsert_provenance, remove_nodes, remove_edges, changed_files,
    removed_files. Missing parts of the delta are empty. An upsert wins over a remove for nodes and edges, a removed file over a
    changed one. Removing a node closes its edges, also if the delta brings the node back, unless it brings the edge back too.

    With ``scope`` (columns of every table) the deltas of many worktrees are applied at once, and ``base`` has a row (scope, base, sequence) for each.
    Any that is stale or breaks an invariant refuses all.
    """
    if not scope:
        spark = next(iter(state.values())).sparkSession
        bases = spark.createDataFrame([(0, base, sequence)], "__scope int, base bigint, sequence bigint")
        one = lambda tables: {p: t.withColumn("__scope", F.lit(0)) for p, t in tables.items() if t is not None}
        out = apply_delta(one(state), one(delta), bases, scope=["__scope"])
        return {p: t.drop("__scope") for p, t in out.items()}
    scope = list(scope)
    marks = None
    for t in state.values():
        part = t.select(*scope, F.greatest("valid_from_sequence", "valid_until_sequence").alias("at"))
        marks = part if marks is None else marks.unionByName(part)
    now = base.join(marks.groupBy(*scope).agg(F.max("at").alias("at")), scope, "left")
    now = materialize(now.select(*scope, F.coalesce("base", F.lit(0)).alias("base"), "sequence", F.coalesce("at", F.lit(0)).alias("at")), "bases")
    if stale := now.where("base <> at").first():
        raise StaleBase(f"base {stale['base']}, current {stale['at']}")
    _none(now.where("sequence <= at"), "a delta may not reuse its base generation")
    at = now.select(*scope, F.col("sequence").cast("bigint").alias("__at"))
    ids = {"files": "file_id", "provenance": "provenance_id", "nodes": "node_id", "edges": "edge_id"}
    ups = {"files": "changed_files", "provenance": "upsert_provenance", "nodes": "upsert_nodes", "edges": "upsert_edges"}
    for rows in delta.values():
        _none(rows.join(at, scope, "left_anti"), "a delta without a base")
    for part, key in ids.items():
        if ups[part] in delta:
            _none(delta[ups[part]].groupBy(*scope, key).count().where("count > 1"), f"duplicate ids in {ups[part]}")
    live = {p: t.where("valid_until_sequence is null") for p, t in state.items()}
    gone: dict[str, DataFrame | None] = {
        "files": delta.get("removed_files"), "provenance": None, "nodes": delta.get("remove_nodes"), "edges": delta.get("remove_edges"),
    }
    if gone["nodes"] is not None:
        # The removed nodes are joined to each end separately.
        n = gone["nodes"].select(*scope, "node_id").distinct()
        ends = [live["edges"].join(n.withColumnRenamed("node_id", e), [*scope, e], "left_semi").select(*scope, "edge_id") for e in ("source", "target")]
        cascade = ends[0].unionByName(ends[1]).distinct()
        gone["edges"] = cascade if gone["edges"] is None else cascade.unionByName(gone["edges"].select(*scope, "edge_id")).distinct()
    out = {}
    for part, key in ids.items():
        new = delta.get(ups[part])
        if part == "files" and new is not None and gone["files"] is not None:
            new = new.join(gone["files"].select(*scope, key), [*scope, key], "left_anti")
        closing = None
        for rows in (new, gone[part]):
            if rows is not None:
                closing = rows.select(*scope, key) if closing is None else closing.unionByName(rows.select(*scope, key))
        table = state[part]
        if closing is not None:
            table = table.join(closing.distinct().join(at, scope), [*scope, key], "left").withColumn(
                "valid_until_sequence", F.coalesce("valid_until_sequence", "__at")
            )
        if new is not None:
            opened = new.join(at, scope).withColumn("valid_from_sequence", F.col("__at")).withColumn("valid_until_sequence", F.lit(None).cast("bigint"))
            table = table.select(*state[part].columns).unionByName(opened.select(*state[part].columns))
        out[part] = materialize(table.select(*state[part].columns), f"delta-{part}")
    after = {p: t.where("valid_until_sequence is null") for p, t in out.items()}
    known = after["provenance"].select(*scope, F.col("provenance_id").alias("provenance"))
    for part in ("nodes", "edges"):
        _none(after[part].join(known, [*scope, "provenance"], "left_anti"), f"{part} without provenance")
    for end in ("source", "target"):
        _none(after["edges"].join(after["nodes"].select(*scope, F.col("node_id").alias(end)), [*scope, end], "left_anti"), f"edges without {end}")
    return out


def chain_digest(entries: list[tuple[int, str]], start: str = "") -> list[str]:
    """Digest of each generation over the one before: sha256(previous || sequence || root), in order."""
    out, last = [], start
    for sequence, root in sorted(entries):
        last = hashlib.sha256(f"{last}|{sequence}|{root}".encode()).hexdigest()
        out.append(last)
    return out


def verify_chain(entries: list[tuple[int, str]], digests: list[str]) -> bool:
    return chain_digest(entries) == digests


def chain_digests(roots: DataFrame) -> DataFrame:
    """chain_digest for each place at once: rows (place, sequence, root) folded in order within a place's generations."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "root")))
    step = lambda last, x: F.sha2(F.concat_ws("|", last, x["sequence"].cast("string"), x["root"]), 256)
    return roots.groupBy(*PLACE).agg(F.aggregate(ordered, F.lit(""), step).alias("digest"), F.count("*").alias("generations"))


class Materializer:
    """The attribute feed under one folder, a write per sequence of a scope and a control record that names the writes.

    ``synchronize`` takes the watermark's next sequence only, is a no-op when it is already there, and is invisible until its
    commit; ``rebuild`` replaces a scope. Rows of a later write replace those with the same key.
    """

    KEY = [*PLACE, "fact_kind", "fact_id", "valid_from_sequence", "attribute", "ordinal"]

    def __init__(self, spark: SparkSession, root: str):
        from palimpsest.operators.incremental import IncrementalRun

        self.spark, self.runs = spark, IncrementalRun(spark, root, "as_of_sequence")

    def watermark(self) -> int:
        return int(self.runs.watermark() or 0)

    def synchronize(self, changes: DataFrame, sequence: int) -> bool:
        """Commit the changed feed rows of ``sequence``. False if it was committed before."""
        done = self.runs.last()
        at = int(done["watermark"]) if done else 0
        if sequence == at:
            return False
        if sequence != at + 1:
            raise ValueError(f"sequence {sequence} does not follow {at}")
        rows = changes.withColumn("as_of_sequence", F.lit(sequence).cast("bigint"))
        ticket = {"run": done["run"] + 1 if done else 1, "low": str(at), "watermark": str(sequence)}
        return self.runs.commit(rows, ticket)

    def catch_up(self, changes: DataFrame) -> int:
        """Synchronize each sequence of ``changes`` (``history.feed_changes``) past the watermark, in order. The watermark reached."""
        at, path = self.watermark(), scratch_path(self.spark, "changes")
        # Laid out by sequence once, so that a step reads its own rows only.
        changes.where(F.col("as_of_sequence") > at).hint("rebalance", "as_of_sequence").write.partitionBy("as_of_sequence").parquet(path)
        found = self.spark.read.schema(changes.schema).parquet(path)
        last = found.agg(F.max("as_of_sequence")).first()[0] or at
        for sequence in range(at + 1, last + 1):
            self.synchronize(found.where(F.col("as_of_sequence") == sequence), sequence)
        fs, where = file_system(self.spark, path)
        fs.delete(where, True)
        return self.watermark()

    def rebuild(self, feed: DataFrame, repository_id: str, worktree_id: str, sequence: int) -> bool:
        """Replace all rows of a scope by ``feed``, its whole feed as known at ``sequence``; other scopes stay.

        That is the watermark, so that the scope goes on with the others; only the first commit of all may set it. Rows of another
        scope, rows that begin or end later and repeated keys are refused before anything is written.
        """
        done = self.runs.last()
        at = int(done["watermark"]) if done else sequence
        if sequence != at:
            raise ValueError(f"a rebuild at {sequence} does not meet the watermark {at}")
        of = F.col("repository_id").eqNullSafe(F.lit(repository_id)) & F.col("worktree_id").eqNullSafe(F.lit(worktree_id))
        feed = materialize(feed, "rebuild")
        _none(feed.where(~of), "rows of another scope")
        _none(feed.where((F.col("valid_from_sequence") > sequence) | (F.col("valid_until_sequence") > sequence)), f"rows later than {sequence}")
        _none(feed.groupBy(*self.KEY).count().where("count > 1"), "repeated keys")
        rows = feed.withColumn("as_of_sequence", F.lit(sequence).cast("bigint"))
        ticket = {"run": done["run"] + 1 if done else 1, "low": str(at), "watermark": str(sequence), "rebuilt": [repository_id, worktree_id]}
        won = self.runs.commit(rows, ticket)
        discard(feed)
        return won

    def _committed(self) -> DataFrame | None:
        """All committed rows but those of scopes that a later commit has rebuilt."""
        out, paths, rebuilt, commits = None, [], [], self.runs.commits()
        for c in reversed(commits):
            paths.append(c["output"])
            if "rebuilt" not in c and c is not commits[0]:
                continue
            part = self.spark.read.parquet(*paths)
            for r, w in rebuilt:
                part = part.where(~(F.col("repository_id").eqNullSafe(F.lit(r)) & F.col("worktree_id").eqNullSafe(F.lit(w))))
            out, paths = part if out is None else out.unionByName(part), []
            if "rebuilt" in c and c["rebuilt"] not in rebuilt:
                rebuilt.append(c["rebuilt"])
        return out

    def view(self) -> DataFrame | None:
        """The feed as of the watermark."""
        rows = self._committed()
        if rows is None:
            return None
        payload = [c for c in rows.columns if c not in self.KEY and c != "as_of_sequence"]
        return (
            rows.groupBy(*self.KEY).agg(F.max_by(F.struct(*payload), F.col("as_of_sequence")).alias("p")).select(*self.KEY, "p.*")
        )
