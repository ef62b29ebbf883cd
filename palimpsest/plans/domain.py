"""Queries of the general problems 3 to 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import asof, changefeed, incremental, ledger, references
from palimpsest.session import scratch_path
from palimpsest.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows come from the files that a run has committed together with its watermark."""
    root = scratch_path(spark, "pending")
    feed = table(spark, sf_dir, "change_feed")
    incremental.run_pending(feed, table(spark, sf_dir, "watermarks"), table(spark, sf_dir, "stream_checkpoints"), root)
    return incremental.committed_pending(spark, root).select("consumer", "change_id", "revision")


P3_FOUND = """
with rec as (
  select repository_id, worktree_id, change_id, revision, min(arrived_at) arrived_at,
         min(generation_sequence) seq, min(fact_kind) fact_kind, min(fact_id) fact_id
  from change_feed group by 1, 2, 3, 4),
run as (
  select * from (select *, row_number() over (partition by repository_id, worktree_id order by finished_at desc, run_id desc) rn
                 from watermarks where status = 'committed' and finished_at is not null) where rn = 1),
cp as (
  select repository_id, worktree_id, sequence seq, max(checkpointed_at) done_at from stream_checkpoints
  where stream = 'inference' group by 1, 2, 3)
select 'materializer' consumer, rec.change_id, rec.revision from rec left join run using (repository_id, worktree_id)
where not coalesce(rec.arrived_at <= run.started_at and (rec.seq <= run.generation_sequence
  or (rec.seq = run.pending_sequence and (list_position(['file','provenance','node','edge'], rec.fact_kind), rec.fact_id)
      <= (list_position(['file','provenance','node','edge'], run.cursor_fact_kind), run.cursor_fact_id))), false)
union all
select 'inference', rec.change_id, rec.revision from rec left join cp using (repository_id, worktree_id, seq)
where not coalesce(cp.done_at >= rec.arrived_at, false)
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_attributes(spark, sf_dir, ["version_id"])


def p4_attributes(
    spark: SparkSession,
    sf_dir: str,
    attributes: tuple = ("version_id", "source", "target", "relation", "provenance", "extension_namespace"),
) -> DataFrame:
    return asof.premise_attributes(
        table(spark, sf_dir, "premises"),
        table(spark, sf_dir, "generations"),
        table(spark, sf_dir, "edge_versions"),
        list(attributes),
    )


def _p4_sql(columns: str) -> str:
    return f"""
with g as (select distinct repository_id, worktree_id, generation, generation_sequence from generations),
m as (
  select p.premise_id, e.*, row_number() over (partition by p.premise_id order by e.accepted_at desc, e.version_id desc) rn
  from (select distinct * from premises) p
  join g using (repository_id, worktree_id, generation)
  join (select distinct * from edge_versions) e
    on e.repository_id = p.repository_id and e.worktree_id = p.worktree_id and e.edge_id = p.edge_id
   and e.valid_from_sequence <= g.generation_sequence
   and (e.valid_until_sequence is null or g.generation_sequence < e.valid_until_sequence)
   and e.accepted_at <= p.drawn_at)
select premise_id, {columns} from m where rn = 1
"""


def _reference_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("edge_versions", "node_versions", "file_versions", "provenance")}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_references(_reference_tables(spark, sf_dir)).select(
        "record_table", "version_id", "field", "reason"
    )


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(_reference_tables(spark, sf_dir), table(spark, sf_dir, "generations"))


P5_CASES = """
with r as (
  select distinct repository_id, worktree_id, 'edge_versions' record_table, version_id, 'source' field, 'node' parent, source key, valid_from_sequence seq from edge_versions
  union all select distinct repository_id, worktree_id, 'edge_versions', version_id, 'target', 'node', target, valid_from_sequence from edge_versions
  union all select distinct repository_id, worktree_id, 'node_versions', version_id, 'owner_file', 'file', owner_file, valid_from_sequence from node_versions
  union all select distinct repository_id, worktree_id, 'node_versions', version_id, 'provenance', 'provenance', provenance, valid_from_sequence from node_versions),
p as (
  select repository_id, worktree_id, 'node' parent, node_id key, valid_from_sequence f, valid_until_sequence u from node_versions
  union all select repository_id, worktree_id, 'file', file_id, valid_from_sequence, valid_until_sequence from file_versions
  union all select repository_id, worktree_id, 'provenance', provenance_id, valid_from_sequence, null from provenance),
b as (select repository_id, worktree_id, parent, key, min(f) first from p group by 1, 2, 3, 4),
o as (select * from r where key is not null and not exists (
  select 1 from p where p.repository_id = r.repository_id and p.worktree_id = r.worktree_id and p.parent = r.parent
    and p.key = r.key and p.f <= r.seq and (p.u is null or r.seq < p.u))),
found as (select o.*, case when b.first is null then 'missing' when b.first > o.seq then 'late' else 'deleted' end reason
  from o left join b using (repository_id, worktree_id, parent, key))
"""
P5_FOUND = P5_CASES + "select record_table, version_id, field, reason from found"
P5_COUNTS = (
    P5_CASES
    + """, g as (select repository_id, worktree_id, generation_sequence seq, min(generation) generation from generations group by 1, 2, 3)
select record_table, field, reason, repository_id, worktree_id, seq valid_from_sequence, generation, count(*) orphans
from found left join g using (repository_id, worktree_id, seq) group by all"""
)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.external_versions(table(spark, sf_dir, "external_snapshots")).select(
        "node_id",
        F.col("valid_from").alias("valid_from_sequence"),
        F.coalesce("valid_until", F.lit(-1)).alias("valid_until_sequence"),
    )


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ledger.version_counts(ledger.external_versions(table(spark, sf_dir, "external_snapshots")))
    ids = (
        table(spark, sf_dir, "generations")
        .groupBy("repository_id", "worktree_id", F.col("generation_sequence").alias("valid_from_sequence"))
        .agg(F.min("generation").alias("valid_from_generation"))
    )
    return counts.join(ids, ["repository_id", "worktree_id", "valid_from_sequence"], "left").select(
        "repository_id", "worktree_id", "valid_from_sequence", "valid_from_generation", "facts"
    )


def p6_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.external_ledger(table(spark, sf_dir, "external_snapshots")).drop("is_current")


P6_BASE = """
with s as (select distinct * from external_snapshots),
slot as (select *, lead(as_of_sequence) over (partition by repository_id, worktree_id order by as_of_sequence) nxt
  from (select distinct repository_id, worktree_id, as_of_sequence from external_snapshots)),
said as (select s.*, slot.nxt from s join slot using (repository_id, worktree_id, as_of_sequence)),
cur as (select * from (select *, row_number() over (partition by repository_id, worktree_id, node_id, as_of_sequence
    order by loaded_at desc, namespace desc, external_kind desc, name desc, stage desc nulls last, schema_version desc) rn from said) where rn = 1),
f as (select *, case when lag(nxt) over w = as_of_sequence and lag(namespace) over w is not distinct from namespace
    and lag(external_kind) over w is not distinct from external_kind and lag(name) over w is not distinct from name
    and lag(stage) over w is not distinct from stage and lag(schema_version) over w is not distinct from schema_version
    then 0 else 1 end isnew from cur window w as (partition by repository_id, worktree_id, node_id order by as_of_sequence)),
i as (select *, sum(isnew) over (partition by repository_id, worktree_id, node_id order by as_of_sequence) run from f),
v as (select repository_id, worktree_id, node_id, run, min(as_of_sequence) valid_from_sequence,
    case when bool_or(nxt is null) then -1 else max(nxt) end valid_until_sequence from i group by 1, 2, 3, 4)
"""
P6_FOUND = P6_BASE + "select node_id, valid_from_sequence, valid_until_sequence from v"
P6_COUNTS = (
    P6_BASE
    + """, g as (select repository_id, worktree_id, generation_sequence valid_from_sequence, min(generation) valid_from_generation from generations group by 1, 2, 3)
select repository_id, worktree_id, valid_from_sequence, valid_from_generation, count(*) facts from v
left join g using (repository_id, worktree_id, valid_from_sequence) group by all"""
)
P6_LEDGER = (
    P6_BASE
    + """select repository_id, worktree_id, node_id, as_of_sequence valid_from, nxt valid_until, namespace, external_kind, name, stage, schema_version,
  loaded_at recorded_from, lead(loaded_at) over (partition by repository_id, worktree_id, node_id, as_of_sequence order by loaded_at, namespace, external_kind, name, stage nulls first, schema_version) recorded_until
from (select distinct repository_id, worktree_id, node_id, as_of_sequence, nxt, namespace, external_kind, name, stage, schema_version, loaded_at from said)"""
)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_facts(table(spark, sf_dir, "change_feed")).select(
        "fact_kind", "fact_id", "change_id", "revision"
    )


P7_FOUND = """
with top as (select * from (select *, row_number() over (partition by repository_id, worktree_id, change_id order by revision desc) rn from change_feed) where rn = 1),
last as (select * from (select *, row_number() over (partition by repository_id, worktree_id, fact_kind, fact_id order by generation_sequence desc, change_id desc) k from top) where k = 1)
select fact_kind, fact_id, change_id, revision from last where kind <> 'Removed'
"""

QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_attributes": p4_attributes,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p6_ledger": p6_ledger,
    "p7_found": p7_found,
}

SQL = {
    "p3_found": P3_FOUND,
    "p4_found": _p4_sql("version_id"),
    "p4_attributes": _p4_sql("version_id, source, target, relation, provenance, extension_namespace"),
    "p5_found": P5_FOUND,
    "p5_counts": P5_COUNTS,
    "p6_found": P6_FOUND,
    "p6_counts": P6_COUNTS,
    "p6_ledger": P6_LEDGER,
    "p7_found": P7_FOUND,
}
