"""Queries of the graph engine's operators over the domain tables, each with its SQL. Keys begin with the operator's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.stem import stemmed
from palimpsest.operators import graph, history, inference, lexical, lineage, publication, resolution, validation
from palimpsest.session import materialize, scratch_path
from palimpsest.sources import scan
from palimpsest.sources.tables import table

PLACE = history.PLACE
FACT = history.FACT
#: The sequence at which the as-of queries read, and the range of the range queries.
AT, AFTER, UNTIL = 20, 10, 20
KNOWN_BY = 1_867_500_000_000_000_000
TERMS = ["ledger", "edge", "stale", "resolve", "span"]
EXTENSIONS = ["md", "markdown"]
MODULE_KINDS = ["Module", "Import", "Export", "ModuleResolutionDiagnostic"]
QUERIES: dict = {}
SQL: dict[str, str] = {}

BASE = """
with nv as (select distinct * from node_versions), ev as (select distinct * from edge_versions), pv as (select distinct * from provenance),
fv as (select distinct repository_id, worktree_id, file_id, valid_from_sequence, valid_until_sequence, normalized_path, content_hash, size_bytes, language from file_versions),
g as (select repository_id, worktree_id, generation, max(parent_generation) parent_generation, max(generation_sequence) generation_sequence, max(status) status, max(accepted_at) accepted_at, max(accepted_at_unix_nanos) nanos
  from generations group by 1, 2, 3),
facts as (select repository_id, worktree_id, 'file' fact_kind, file_id fact_id, valid_from_sequence, valid_until_sequence from fv
  union select repository_id, worktree_id, 'provenance', provenance_id, valid_from_sequence, null from pv
  union select repository_id, worktree_id, 'node', node_id, valid_from_sequence, valid_until_sequence from nv
  union select repository_id, worktree_id, 'edge', edge_id, valid_from_sequence, valid_until_sequence from ev),
ch as (select repository_id, worktree_id, fact_kind, fact_id, generation_sequence, change_id, revision, event_id, kind, content_hash from
  (select *, row_number() over (partition by repository_id, worktree_id, fact_kind, fact_id, generation_sequence, change_id order by revision desc, event_id desc, kind desc) rn from change_feed) where rn = 1),
cn as (select * from nv where valid_until_sequence is null), ce as (select * from ev where valid_until_sequence is null),
seed as (select repository_id, worktree_id, node_id from (select repository_id, worktree_id, source node_id, row_number() over (partition by repository_id, worktree_id order by count(*) desc, source) rn from ce group by 1, 2, 3) where rn = 1)
"""
PL = "repository_id, worktree_id"
FA = f"{PL}, fact_kind, fact_id"


def query(name: str, sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return f

    return register


class Tables:
    """The domain tables of a folder, their repeats taken out."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        t = table(self.spark, self.sf_dir, name)
        if name == "file_versions":
            t = t.select(*PLACE, "file_id", "valid_from_sequence", "valid_until_sequence", "normalized_path", "content_hash", "size_bytes", "language")
        return t.distinct()

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def facts(self) -> DataFrame:
        return history.fact_versions({name: self.raw(name) for _, name, _ in history.FAMILIES})

    @property
    def changes(self) -> DataFrame:
        return history.effective_changes(self.raw("change_feed"))

    @property
    def nodes(self) -> DataFrame:
        return history.current(self["node_versions"])

    @property
    def edges(self) -> DataFrame:
        return history.current(self["edge_versions"])

    @property
    def seeds(self) -> DataFrame:
        """Per place the node with most outgoing edges, ties by id."""
        degree = self.edges.groupBy(*PLACE, F.col("source").alias("node_id")).agg(F.count("*").alias("n"))
        return degree.groupBy(*PLACE).agg(F.min(F.struct((-F.col("n")).alias("o"), "node_id")).alias("m")).select(*PLACE, "m.node_id")


def _wide(df: DataFrame, *columns: str) -> DataFrame:
    """Row numbers and lines as bigint, as SQL has them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# --- Scans, sources, sinks --------------------------------------------------------------------------------------


@query("s01_source_inventory", "select path, sha256(encode(text)) content_hash, strlen(text) size_bytes from documents where text is not null and regexp_matches(path, '(?i)\\.(md|markdown)$')", base=False)
def s01(spark, d):
    return scan.inventory(table(spark, d, "documents"), "path", "text", EXTENSIONS)


@query("s02_scan_metrics", "select count(*) visited, count(*) filter (k) as \"read\", coalesce(sum(strlen(text)) filter (k), 0)::bigint bytes from (select *, coalesce(text is not null and regexp_matches(path, '(?i)\\.(md|markdown)$'), false) k from documents)", base=False)
def s02(spark, d):
    return scan.scan_metrics(table(spark, d, "documents"), "path", "text", EXTENSIONS)


@query("s03_node_point_read", f"select cn.* from cn join seed using ({PL}, node_id)")
def s03(spark, d):
    t = Tables(spark, d)
    return t.nodes.join(t.seeds, [*PLACE, "node_id"], "left_semi")


@query("s04_current_facts", f"select {FA}, valid_from_sequence from facts where valid_until_sequence is null")
def s04(spark, d):
    return history.current(Tables(spark, d).facts).select(*FACT, "valid_from_sequence")


@query("s05_provenance_by_ids", f"select * from pv where exists (select 1 from cn where cn.repository_id = pv.repository_id and cn.worktree_id = pv.worktree_id and cn.provenance = pv.provenance_id and cn.kind = 'Function')")
def s05(spark, d):
    t = Tables(spark, d)
    wanted = t.nodes.where("kind = 'Function'").select(*PLACE, F.col("provenance").alias("provenance_id"))
    return t["provenance"].join(wanted, [*PLACE, "provenance_id"], "left_semi")


@query("s06_nodes_for_files", f"select n.{PL.replace(', ', ', n.')}, n.node_id, n.owner_file, f.normalized_path from cn n join (select * from fv where valid_until_sequence is null and normalized_path like 'src/core/%') f on n.repository_id = f.repository_id and n.worktree_id = f.worktree_id and n.owner_file = f.file_id")
def s06(spark, d):
    t = Tables(spark, d)
    files = history.current(t["file_versions"]).where(F.col("normalized_path").startswith("src/core/"))
    return t.nodes.join(files.select(*PLACE, F.col("file_id").alias("owner_file"), "normalized_path"), [*PLACE, "owner_file"]).select(*PLACE, "node_id", "owner_file", "normalized_path")


@query("s07_module_nodes", "select * from cn where kind in ('Module', 'Import', 'Export', 'ModuleResolutionDiagnostic')")
def s07(spark, d):
    return Tables(spark, d).nodes.where(F.col("kind").isin(MODULE_KINDS))


@query("s08_visit_within_budget", f"select {PL}, node_id, version_id from nv where valid_from_sequence <= {AT} and (valid_until_sequence is null or valid_until_sequence > {AT})")
def s08(spark, d):
    return history.within_budget(history.as_of(Tables(spark, d)["node_versions"], AT).select(*PLACE, "node_id", "version_id"), 10**15)


@query("s10_records_last_with_prefix", f"""with w as (select distinct {PL}, run_id, status from watermarks), k as (select {PL}, 'run/' || repository_id || '/' || worktree_id || '/' || lpad(run_id::varchar, 12, '0') k, bool_or(status = 'committed') c from w group by all)
select {PL}, max(k) last_key, arg_max(case when c then 'committed' else 'seen' end, k) last_value, count(*) records from k group by 1, 2""", base=False)
def s10(spark, d):
    """Every run is put as seen, then the committed ones again; what is read is the last write of each key, by prefix."""
    runs = table(spark, d, "watermarks")
    key = F.concat_ws("/", F.lit("run"), *PLACE, F.lpad(F.col("run_id").cast("string"), 12, "0")).alias("key")
    records = scan.RecordTable(spark, scratch_path(spark, "records"))
    records.put(runs.select(key, F.lit("seen").alias("value")))
    records.put(runs.where("status = 'committed'").select(key, F.col("status").alias("value")))
    parts = F.split("key", "/")
    rows = records.scan("run/").select(F.element_at(parts, 2).alias("repository_id"), F.element_at(parts, 3).alias("worktree_id"), "key", "value")
    return rows.groupBy(*PLACE).agg(F.max("key").alias("last_key"), F.max_by("value", "key").alias("last_value"), F.count("*").alias("records"))


@query("s12_export_and_audit", f"select fact_kind, count(*) as \"rows\", 'ok' audit from facts group by 1")
def s12(spark, d):
    path = scratch_path(spark, "export")
    scan.export_parquet(Tables(spark, d).facts, path)
    wrong = scan.audit_export(spark, path)
    data = spark.read.parquet(f"{path}/data")
    return data.groupBy("fact_kind").agg(F.count("*").alias("rows")).withColumn("audit", F.lit("; ".join(wrong) or "ok"))


def _ndjson(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return scan.ndjson([
        ("node", nodes.select(*PLACE, "node_id", "kind", "provenance", "valid_from_sequence"), "node_id"),
        ("edge", edges.select(*PLACE, "edge_id", "source", "target", "relation", "provenance", "valid_from_sequence"), "edge_id"),
    ])


_NDJSON = """select 0 section, node_id id, json_object('record', 'node', 'repository_id', repository_id, 'worktree_id', worktree_id, 'node_id', node_id, 'kind', kind, 'provenance', provenance, 'valid_from_sequence', valid_from_sequence)::varchar line from {n}
union all select 1, edge_id, json_object('record', 'edge', 'repository_id', repository_id, 'worktree_id', worktree_id, 'edge_id', edge_id, 'source', source, 'target', target, 'relation', relation, 'provenance', provenance, 'valid_from_sequence', valid_from_sequence)::varchar from {e}"""
_ASOF = f"valid_from_sequence <= {AT} and (valid_until_sequence is null or valid_until_sequence > {AT})"


@query("s15_graph_export", _NDJSON.format(n="cn", e="ce"))
def s15(spark, d):
    t = Tables(spark, d)
    return _ndjson(t.nodes, t.edges)


@query("s16_graph_export_at", _NDJSON.format(n=f"(select * from nv where {_ASOF})", e=f"(select * from ev where {_ASOF})"))
def s16(spark, d):
    t = Tables(spark, d)
    return _ndjson(history.as_of(t["node_versions"], AT), history.as_of(t["edge_versions"], AT))


def _utc_micros(name: str):
    """Microseconds since the epoch of a time without zone, read as UTC whatever the session's zone."""
    return F.unix_micros(F.to_timestamp_ltz(F.concat(F.col(name).cast("timestamp_ntz").cast("string"), F.lit("Z"))))


def _observations(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("relation"),
        F.get_json_object("props", "$.k").alias("object"), (_utc_micros("ts") * 1000).alias("observed_at_nanos"), F.lit("events").alias("producer_namespace"),
    )


_OBS = """with o as (select 'user:' || user_id subject, event_type relation, json_extract_string(props, '$.k') object, epoch_us(ts) * 1000 observed_at_nanos from events)
"""


@query("s18_fact_batch", _OBS + "select distinct sha256('events|' || subject || '|' || relation || '|' || object || '|' || observed_at_nanos) node_id, 'RuntimeObservation' kind, subject, relation, object, observed_at_nanos from o where relation in ('view', 'click', 'purchase') and object is not null", base=False)
def s18(spark, d):
    return scan.observation_nodes(_observations(spark, d), ["view", "click", "purchase"], "events")[0]


@query("s19_source_bytes", f"select f.{PL.replace(', ', ', f.')}, f.file_id, f.valid_from_sequence, t.bytes, f.size_bytes = t.bytes size_holds from fv f join (select distinct {PL}, file_id, content_hash, strlen(text) bytes from file_versions) t using ({PL}, file_id, content_hash)")
def s19(spark, d):
    t = Tables(spark, d)
    texts = t.raw("file_versions").select(*PLACE, "file_id", "content_hash", F.octet_length("text").cast("bigint").alias("bytes")).distinct()
    return t["file_versions"].join(texts, [*PLACE, "file_id", "content_hash"]).select(*PLACE, "file_id", "valid_from_sequence", "bytes", (F.col("size_bytes") == F.col("bytes")).alias("size_holds"))


# --- Projections and predicates ------------------------------------------------------------------------------------


@query("p-01_search_nodes", "select node_id, name from cn where contains(lower(name), 'ledger')")
def p01(spark, d):
    return lexical.search_nodes(Tables(spark, d).nodes, "Ledger").select("node_id", "name")


@query("p-03_search_nodes_at", f"select node_id, name, version_id from nv where {_ASOF} and contains(lower(name), 'edge')")
def p03(spark, d):
    return lexical.search_nodes(history.as_of(Tables(spark, d)["node_versions"], AT), "EDGE").select("node_id", "name", "version_id")


@query("p-04_symbol_candidates", "select node_id, name from cn where name in ('settle_node', 'StaleToken') or list_last(string_split(name, '::')) in ('settle_node', 'StaleToken')")
def p04(spark, d):
    return lexical.symbol_candidates(Tables(spark, d).nodes, ["settle_node", "StaleToken"]).select("node_id", "name")


@query("p-05_diagnostics", f"select distinct {PL}, file_id, valid_from_sequence, diagnostic_message, diagnostic_truncated from file_versions where length(diagnostic_message) > 0", base=False)
def p05(spark, d):
    t = Tables(spark, d).raw("file_versions")
    return t.where(F.length("diagnostic_message") > 0).select(*PLACE, "file_id", "valid_from_sequence", "diagnostic_message", "diagnostic_truncated").distinct()


@query("p-06_evidence_filter", f"select ce.{PL.replace(', ', ', ce.')}, edge_id, evidence_class from ce join pv on pv.repository_id = ce.repository_id and pv.worktree_id = ce.worktree_id and pv.provenance_id = ce.provenance where evidence_class in ('SourceFact', 'UserAsserted')")
def p06(spark, d):
    t = Tables(spark, d)
    p = t["provenance"].where(F.col("evidence_class").isin("SourceFact", "UserAsserted")).select(*PLACE, F.col("provenance_id").alias("provenance"), "evidence_class")
    return t.edges.join(p, [*PLACE, "provenance"]).select(*PLACE, "edge_id", "evidence_class")


@query("p-07_relation_filter", f"select 'some' wanted, {PL}, edge_id, relation, version_id from ce where relation in ('Calls', 'Imports') union all select 'all', {PL}, edge_id, relation, version_id from ce")
def p07(spark, d):
    """Edges of two relations, and of all where none is asked for."""
    e = Tables(spark, d).edges.select(*PLACE, "edge_id", "relation", "version_id")
    some = graph.with_relations(e, ["Calls", "Imports"]).withColumn("wanted", F.lit("some"))
    return some.unionByName(graph.with_relations(e, None).withColumn("wanted", F.lit("all")))


_FAMILY = "case when kind in ('Module','Function','Struct','Enum','Trait','Test','Class','Script') then 'Code' when kind in ('Document','Section','DocumentChunk') then 'Documentation' when kind in ('Reference','UnresolvedReference','AmbiguousReference','Import','Export') then 'Reference' else 'Other' end"


@query("p-10_lexical_family", f"select {_FAMILY} family, kind, count(*) nodes from cn group by all")
def p10(spark, d):
    return Tables(spark, d).nodes.groupBy(T.lexical_family(F.col("kind")).alias("family"), "kind").agg(F.count("*").alias("nodes"))


@query("p-09_source_content", f"select {PL}, kind, count(*) nodes from cn where kind in ('Function', 'Struct', 'Enum', 'Trait', 'Test', 'Class', 'Import', 'Export', 'Section', 'DocumentChunk') group by all")
def p09(spark, d):
    return Tables(spark, d).nodes.where(T.is_source_content(F.col("kind"))).groupBy(*PLACE, "kind").agg(F.count("*").alias("nodes"))


@query("p-11_reference_targets", f", a as (select distinct {PL}, node_id, namespace = 'syntax' and external_kind = 'anchor' anchor from external_snapshots), x as (select {PL}, node_id, kind in ('Function', 'Test', 'Class', 'Struct', 'Trait', 'File', 'Document') target, false anchor, case when kind = 'Test' then 'TestIntent' end as \"role\" from cn union all select {PL}, node_id, anchor, anchor, null from a) select target, anchor, \"role\", count(*) nodes from x group by all")
def p11(spark, d):
    t = Tables(spark, d)
    anchor = T.is_source_anchor(F.col("kind"), F.col("namespace"), F.col("external_kind"), "syntax")
    external = t.raw("external_snapshots").withColumn("kind", F.lit("External")).select(*PLACE, "node_id", "kind", anchor.alias("anchor")).distinct()
    rows = t.nodes.select(*PLACE, "node_id", "kind", F.lit(False).alias("anchor")).unionByName(external)
    target = T.is_reference_target(F.col("kind"), F.col("anchor"))
    return rows.groupBy(target.alias("target"), "anchor", T.source_role(F.col("kind")).alias("role")).agg(F.count("*").alias("nodes"))


@query("p-12_known_by", f", r as (select *, max(nanos) over w m, min((nanos is not null)::int) over w k from g window w as (partition by {PL} order by generation_sequence)) select {PL}, max(generation_sequence) known_sequence from r where k = 1 and m <= {KNOWN_BY} group by 1, 2")
def p12(spark, d):
    return history.known_sequences(Tables(spark, d).raw("generations"), KNOWN_BY)


@query("p-13_candidate_paths", "select doc_id, array_to_string(list_sort(list_distinct(list_filter([path, replace(path, '/', '\\'), '/' || path, 'x/../' || path], lambda x: x is not null and not regexp_matches(replace(x, '\\', '/'), '^/|^[A-Za-z]:|(^|/)\\.{0,2}(/|$)')).list_transform(lambda x: replace(x, '\\', '/')))), ';') paths from documents", base=False)
def p13(spark, d):
    p = F.col("path")
    tried = F.array(p, F.replace(p, F.lit("/"), F.lit("\\")), F.concat(F.lit("/"), p), F.concat(F.lit("x/../"), p))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.candidate_paths(tried), ";").alias("paths"))


@query("p-14_static_commands", "select name, count(*) n from cn where regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_./-]*$') group by 1")
def p14(spark, d):
    return Tables(spark, d).nodes.where(T.is_static_command(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


# --- Joins ---------------------------------------------------------------------------------------------------------


@query("j01_neighbors", f"select ce.{PL.replace(', ', ', ce.')}, edge_id, source, target, n.kind target_kind, n.name target_name from ce join cn n on n.repository_id = ce.repository_id and n.worktree_id = ce.worktree_id and n.node_id = target")
def j01(spark, d):
    t = Tables(spark, d)
    return graph.neighbors(t.edges, t.nodes).select(*PLACE, "edge_id", "source", "target", "target_kind", "target_name")


@query("j02_edges_by_endpoint", f"select distinct ce.{PL.replace(', ', ', ce.')}, edge_id, source, target from ce join seed on seed.repository_id = ce.repository_id and seed.worktree_id = ce.worktree_id and seed.node_id in (source, target)")
def j02(spark, d):
    t = Tables(spark, d)
    return graph.incident(t.edges, t.seeds).select(*PLACE, "edge_id", "source", "target").distinct()


@query("j03_missing_endpoints_at", f", n as (select * from nv where {_ASOF}), e as (select * from ev where {_ASOF}) select {PL}, edge_id, 'source' field from e where not exists (select 1 from n where n.repository_id = e.repository_id and n.worktree_id = e.worktree_id and n.node_id = e.source) union all select {PL}, edge_id, 'target' from e where not exists (select 1 from n where n.repository_id = e.repository_id and n.worktree_id = e.worktree_id and n.node_id = e.target)")
def j03(spark, d):
    t = Tables(spark, d)
    return graph.dangling(history.as_of(t["edge_versions"], AT), history.as_of(t["node_versions"], AT))


@query("j05_interval_overlap", f"select ev.{PL.replace(', ', ', ev.')}, ev.version_id edge_version, nv.version_id node_version from ev join nv on nv.repository_id = ev.repository_id and nv.worktree_id = ev.worktree_id and nv.node_id = ev.source and coalesce(ev.valid_until_sequence, 9e18) > nv.valid_from_sequence and coalesce(nv.valid_until_sequence, 9e18) > ev.valid_from_sequence")
def j05(spark, d):
    t = Tables(spark, d)
    cols = ["valid_from_sequence", "valid_until_sequence"]
    e = t["edge_versions"].select(*PLACE, F.col("source").alias("node_id"), F.col("version_id").alias("edge_version"), *cols)
    n = t["node_versions"].select(*PLACE, "node_id", F.col("version_id").alias("node_version"), *cols)
    return lineage.interval_join(e, n, [*PLACE, "node_id"]).select(*PLACE, "edge_version", "node_version")


@query("j07_versions_with_acceptance", f"select f.*, a.generation from_generation, a.accepted_at from_accepted, b.generation until_generation from facts f left join g a on a.repository_id = f.repository_id and a.worktree_id = f.worktree_id and a.generation_sequence = f.valid_from_sequence left join g b on b.repository_id = f.repository_id and b.worktree_id = f.worktree_id and b.generation_sequence = f.valid_until_sequence")
def j07(spark, d):
    t = Tables(spark, d)
    g = history.chain(t.raw("generations"))
    a = g.select(*PLACE, F.col("generation_sequence").alias("valid_from_sequence"), F.col("generation").alias("from_generation"), F.col("accepted_at").alias("from_accepted"))
    b = g.select(*PLACE, F.col("generation_sequence").alias("valid_until_sequence"), F.col("generation").alias("until_generation"))
    return t.facts.join(a, [*PLACE, "valid_from_sequence"], "left").join(b, [*PLACE, "valid_until_sequence"], "left")


@query("j08_view_without_pending", f", w as (select * from (select *, row_number() over (partition by {PL} order by finished_at desc, run_id desc) rn from watermarks where status = 'committed') where rn = 1 and pending_generation is null) select facts.{FA.replace(', ', ', facts.')}, valid_from_sequence from facts join w using ({PL})")
def j08(spark, d):
    t = Tables(spark, d)
    last = t.raw("watermarks").where("status = 'committed'").groupBy(*PLACE).agg(F.max(F.struct("finished_at", "run_id", "pending_generation")).alias("r"))
    settled = last.where(F.col("r.pending_generation").isNull()).select(*PLACE)
    return t.facts.join(settled, PLACE).select(*FACT, "valid_from_sequence")


@query("j11_premise_dependants", f"select premise_edge, count(*) premises from (select distinct p.premise_id, p.edge_id premise_edge from premises p join ev e on e.repository_id = p.repository_id and e.worktree_id = p.worktree_id and e.edge_id = p.edge_id where e.valid_until_sequence is not null) group by 1")
def j11(spark, d):
    t = Tables(spark, d)
    closed = t["edge_versions"].where("valid_until_sequence is not null").select(*PLACE, "edge_id")
    p = t.raw("premises").select(*PLACE, "premise_id", "edge_id").distinct()
    return p.join(closed, [*PLACE, "edge_id"], "left_semi").groupBy(F.col("edge_id").alias("premise_edge")).agg(F.count("*").alias("premises"))


@query("j13_owning_section", "", base=False)
def j13(spark, d):
    return _wide(resolution.owning_sections(table(spark, d, "documents")), "paragraph", "section_line")


@query("j14_fact_change_events", f"select {FA}, count(*) events, min(generation_sequence) first_sequence, max(generation_sequence) last_sequence from ch group by all")
def j14(spark, d):
    return Tables(spark, d).changes.groupBy(*FACT).agg(F.count("*").alias("events"), F.min("generation_sequence").alias("first_sequence"), F.max("generation_sequence").alias("last_sequence"))


@query("j16_freshness", f", a as (select {PL}, file_id, content_hash was from fv where {_ASOF}), b as (select {PL}, file_id, content_hash now from fv where valid_until_sequence is null), j as (select *, case when was is null then 'unindexed' when now is null then 'removed' when was <> now then 'changed' else 'same' end state from a full join b using ({PL}, file_id)) select {PL}, count(*) filter (state = 'unindexed') unindexed, count(*) filter (state = 'changed') changed, count(*) filter (state = 'removed') removed, count(*) filter (state = 'same') same from j group by 1, 2")
def j16(spark, d):
    f = Tables(spark, d)["file_versions"]
    return validation.freshness(history.as_of(f, AT), history.current(f))


@query("j17_removed_files", f"select {PL}, file_id from fv a where {_ASOF} and not exists (select 1 from fv b where b.valid_until_sequence is null and b.repository_id = a.repository_id and b.worktree_id = a.worktree_id and b.file_id = a.file_id)")
def j17(spark, d):
    f = Tables(spark, d)["file_versions"]
    return history.as_of(f, AT).join(history.current(f), [*PLACE, "file_id"], "left_anti").select(*PLACE, "file_id")


@query("j20_cascade", f", gone as (select {PL}, node_id from cn where kind = 'Test') select distinct ce.{PL.replace(', ', ', ce.')}, edge_id from ce join gone on gone.repository_id = ce.repository_id and gone.worktree_id = ce.worktree_id and gone.node_id in (source, target)")
def j20(spark, d):
    t = Tables(spark, d)
    return graph.incident(t.edges, t.nodes.where("kind = 'Test'")).select(*PLACE, "edge_id").distinct()


# --- Aggregations --------------------------------------------------------------------------------------------------


@query("a01_fact_counts", f"select {PL}, generation valid_from_generation, valid_from_sequence, facts from (select {PL}, valid_from_sequence, count(*) facts from (select distinct {FA}, valid_from_sequence from facts) group by 1, 2, 3) join (select {PL}, generation, generation_sequence valid_from_sequence from g) using ({PL}, valid_from_sequence)")
def a01(spark, d):
    t = Tables(spark, d)
    return history.fact_counts(t.facts, t.raw("generations"))


@query("a02_fact_counts_by_kind", f"select {PL}, fact_kind, valid_from_sequence, count(distinct fact_id) facts from facts group by all")
def a02(spark, d):
    return Tables(spark, d).facts.groupBy(*PLACE, "fact_kind", "valid_from_sequence").agg(F.countDistinct("fact_id").alias("facts"))


def _eav_sql() -> str:
    wide = {
        "fv": ("file", "file_id", ["normalized_path", "content_hash", "language"]), "pv": ("provenance", "provenance_id", ["producer_namespace", "producer_version", "evidence_class"]),
        "nv": ("node", "node_id", ["kind", "name", "owner_file", "provenance"]), "ev": ("edge", "edge_id", ["source", "target", "relation", "provenance", "extension_namespace"]),
    }
    parts = [
        f"select distinct {PL}, '{kind}' fact_kind, {key} fact_id, valid_from_sequence, {'null' if t == 'pv' else 'valid_until_sequence'} valid_until_sequence, '{c}' attribute, 1 value_kind, {c} value_text, null::bigint value_uint64 from {t} where {c} is not null"
        for t, (kind, key, columns) in wide.items() for c in columns
    ]
    parts.append(f"select distinct {PL}, 'file', file_id, valid_from_sequence, valid_until_sequence, 'size_bytes', 3, null, size_bytes from fv where size_bytes is not null")
    return f", a as ({' union all '.join(parts)}) select *, row_number() over (partition by {FA}, valid_from_sequence, attribute order by value_text nulls first, value_uint64 nulls first, valid_until_sequence nulls first) - 1 ordinal, 2 schema_version from a"


@query("a03_attribute_feed", _eav_sql())
def a03(spark, d):
    t = Tables(spark, d)
    return _wide(history.attributes({name: t.raw(name) for _, name, _ in history.FAMILIES}), "ordinal")


@query("a04_staging_identity", "select count(*) as \"rows\", count(distinct repository_id) repositories, count(distinct worktree_id) worktrees, min(valid_from_sequence) first_sequence, max(valid_from_sequence) last_sequence from facts")
def a04(spark, d):
    return Tables(spark, d).facts.agg(
        F.count("*").alias("rows"), F.countDistinct("repository_id").alias("repositories"), F.countDistinct("worktree_id").alias("worktrees"),
        F.min("valid_from_sequence").alias("first_sequence"), F.max("valid_from_sequence").alias("last_sequence"),
    )


@query("a05_graph_status", f"select {PL}, count(*) filter (fact_kind = 'file') files, count(*) filter (fact_kind = 'node') nodes, count(*) filter (fact_kind = 'edge') edges, count(*) filter (fact_kind = 'provenance') provenance from facts where valid_until_sequence is null group by 1, 2")
def a05(spark, d):
    one = lambda k: F.sum(F.when(F.col("fact_kind") == k, 1).otherwise(0))
    return history.current(Tables(spark, d).facts).groupBy(*PLACE).agg(one("file").alias("files"), one("node").alias("nodes"), one("edge").alias("edges"), one("provenance").alias("provenance"))


@query("a06_processing_coverage", f"select {PL}, case when language is null then 'unclassified' when length(coalesce(diagnostic_message, '')) > 0 then 'syntax_failed' else 'completed' end state, count(*) files from (select distinct * from file_versions) where valid_until_sequence is null group by all", base=False)
def a06(spark, d):
    # The digest stands for the text, which is not read.
    rows = Tables(spark, d).raw("file_versions").drop("text").distinct()
    return validation.processing_coverage(history.current(rows))


_TERMS_SQL = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(name, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 0)))"
_INDEX_SQL = f", ix as (select distinct {PL}, node_id, unnest({_TERMS_SQL}) term from cn), pop as (select {PL}, count(distinct node_id) population from cn group by 1, 2), wanted as (select unnest(['ledger','edge','stale','resolve','span']) term), df as (select {PL}, term, count(distinct node_id) frequency from ix join wanted using (term) group by all), wt as (select {PL}, term, length(bin(population // (frequency + 1) + 1)) w from df join pop using ({PL})), rk as (select {PL}, node_id, count(*) matched, sum(w)::bigint weight, (sum(w) * count(*))::bigint score from ix join wt using ({PL}, term) group by all)"


@query("a07_term_frequency", _INDEX_SQL + " select * from df")
def a07(spark, d):
    return lexical.term_statistics(lexical.postings(Tables(spark, d).nodes), TERMS)


@query("a09_observation_bounds", "select user_id, min(ts) first_observed, max(ts) last_observed, count(*) observations from events group by 1", base=False)
def a09(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_observed"), F.max("ts").alias("last_observed"), F.count("*").alias("observations"))


@query("a11_run_phases", f"select {PL}, status, count(distinct run_id) runs from watermarks group by all", base=False)
def a11(spark, d):
    return table(spark, d, "watermarks").groupBy(*PLACE, "status").agg(F.countDistinct("run_id").alias("runs"))


@query("a14_graph_root", f"select {PL}, bit_xor(('0x' || substr(md5(fact_kind || '|' || fact_id || '|' || valid_from_sequence || '|' || coalesce(valid_until_sequence::varchar, '-')), 1, 15))::bigint) root, count(*) facts from facts group by 1, 2")
def a14(spark, d):
    return history.roots(Tables(spark, d).facts)


# --- Windows -------------------------------------------------------------------------------------------------------

_DERIVED = f", dv as (select {FA}, generation_sequence valid_from_sequence, lead(generation_sequence) over w valid_until_sequence, event_id introduced_by, kind introduced_kind, lead(event_id) over w retired_by, lead(kind) over w retired_kind, content_hash from ch window w as (partition by {FA} order by generation_sequence, change_id)), dvv as (select * from dv where introduced_kind <> 'Removed')"


@query("w01_interval_derivation", _DERIVED + " select * from dvv")
def w01(spark, d):
    return history.derived_versions(Tables(spark, d).changes)


@query("w02_chain_place", f"select {PL}, generation, generation_sequence, row_number() over (partition by {PL} order by generation_sequence) place from g")
def w02(spark, d):
    return _wide(history.chain(Tables(spark, d).raw("generations")).select(*PLACE, "generation", "generation_sequence", "place"), "place")


@query("w04_accepted_through", f"select {PL}, generation, generation_sequence, case when min((nanos is not null)::int) over w = 1 then max(nanos) over w end through from g window w as (partition by {PL} order by generation_sequence)")
def w04(spark, d):
    return history.accepted_through(Tables(spark, d).raw("generations"))


_DIVERSE = _INDEX_SQL + f", c as (select rk.*, coalesce(owner_file, 'node:' || node_id) file, owner_file from rk join (select distinct {PL}, node_id, owner_file from cn) using ({PL}, node_id)), f as (select *, row_number() over (partition by {PL}, file order by score desc, node_id) = 1 lead from c), t as (select *, lead and row_number() over (partition by {PL}, lead order by score desc, node_id) <= 5 turn from f), r as (select *, row_number() over (partition by {PL} order by turn desc, score desc, node_id) rank from t) select {PL}, node_id, owner_file, score, rank from r where rank <= 10"


def _ranked(t: Tables) -> DataFrame:
    return lexical.ranked(lexical.postings(t.nodes), lexical.populations(t.nodes), TERMS)


@query("w05_file_diversity", _DIVERSE)
def w05(spark, d):
    t = Tables(spark, d)
    rows = _ranked(t).join(t.nodes.select(*PLACE, "node_id", "owner_file").distinct(), [*PLACE, "node_id"])
    return _wide(lexical.first_per_file(rows, 10).select(*PLACE, "node_id", "owner_file", "score", "rank"), "rank")


_LINES = "with l as (select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) txt, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) - 1 line from documents where text is not null), "
_HEADS = _LINES + "m as (select *, regexp_matches(txt, '^\\s*(```|~~~)') fence from l), k as (select *, fence or (sum(fence::int) over (partition by doc_id order by line)) % 2 = 1 fenced from m), h as (select doc_id, line, case when fenced then 0 else length(regexp_extract(txt, '^(#{1,6})[ \\t]+\\S', 1)) end as level, trim(regexp_replace(txt, '^#{1,6}[ \\t]+', '')) title from k)"


@query("w07_duplicate_ordinals", _HEADS + " select doc_id, line, title, row_number() over (partition by doc_id, title order by line) - 1 ordinal from h where level > 0", base=False)
def w07(spark, d):
    h = resolution.document_lines(table(spark, d, "documents")).where("level > 0")
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "title").orderBy("line")) - 1
    return _wide(h.select("doc_id", "line", "title", ordinal.alias("ordinal")), "line", "ordinal")


@query("w08_line_windows", _LINES + "s as (select doc_id, line, (contains(lower(txt), 'cursor'))::int c, (contains(lower(txt), 'index'))::int i, (contains(lower(txt), 'node'))::int n from l), w as (select doc_id, line, (max(c) over x + max(i) over x + max(n) over x)::bigint score from s window x as (partition by doc_id order by line rows between 5 preceding and current row)) select * from w where score > 0", base=False)
def w08(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line", "text"))
    mask = lambda term, bit: F.when(F.contains(F.lower("text"), F.lit(term)), bit).otherwise(0)
    frame = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-5, 0)
    masks = lines.withColumn("m", mask("cursor", 1).bitwiseOR(mask("index", 2)).bitwiseOR(mask("node", 4)))
    return _wide(masks, "line").select("doc_id", "line", F.bit_count(F.bit_or("m").over(frame)).cast("bigint").alias("score")).where("score > 0")


# --- Top-k and pages ------------------------------------------------------------------------------------------------


@query("l01_keyset_page", f"select {FA}, valid_from_sequence, ord from (select *, case fact_kind when 'file' then 0 when 'provenance' then 1 when 'node' then 2 else 3 end ord from facts) where (ord, fact_id, valid_from_sequence) > (1, 'prv_8', 0) order by ord, fact_id, valid_from_sequence, {PL} limit 1001")
def l01(spark, d):
    rows = Tables(spark, d).facts.select(*FACT, "valid_from_sequence", history.fact_order(F.col("fact_kind")).alias("ord"))
    rows = rows.where(F.struct("ord", "fact_id", "valid_from_sequence") > F.struct(F.lit(1).alias("ord"), F.lit("prv_8").alias("fact_id"), F.lit(0).cast("bigint").alias("valid_from_sequence")))
    return history.page(rows, ["ord", "fact_id", "valid_from_sequence", *PLACE], 1000)


@query("l04_incident_edge_page", f"select edge_id, source, target, version_id from ev where {_ASOF} and edge_id > 'edg_4' order by edge_id, version_id limit 1001")
def l04(spark, d):
    rows = history.as_of(Tables(spark, d)["edge_versions"], AT).where("edge_id > 'edg_4'").select("edge_id", "source", "target", "version_id")
    return history.page(rows, ["edge_id", "version_id"], 1000)


@query("l06_acceptance_timeline", "select accepted_at, generation, generation_sequence from g where accepted_at >= timestamp '2029-03-01' and accepted_at < timestamp '2029-03-10'")
def l06(spark, d):
    g = history.chain(Tables(spark, d).raw("generations"))
    return g.where("accepted_at >= timestamp_ntz'2029-03-01' and accepted_at < timestamp_ntz'2029-03-10'").select("accepted_at", "generation", "generation_sequence")


@query("l08_top_candidates", _INDEX_SQL + f" select {PL}, node_id, score, rank from (select *, row_number() over (partition by {PL} order by score desc, node_id) rank from rk) where rank <= 20")
def l08(spark, d):
    return _wide(lexical.top(_ranked(Tables(spark, d)), 20).select(*PLACE, "node_id", "score", "rank"), "rank")


# --- Set operations -------------------------------------------------------------------------------------------------


@query("u03_unranked_rest", _INDEX_SQL + f" select {PL}, node_id from cn except select {PL}, node_id from rk")
def u03(spark, d):
    t = Tables(spark, d)
    return t.nodes.select(*PLACE, "node_id").distinct().join(_ranked(t), [*PLACE, "node_id"], "left_anti")


@query("u04_term_overlap", f", m as (select version_id, list_sort(list_intersect({_TERMS_SQL}, ['edge','ledger','resolve','span','stale'])) x from cn) select version_id, array_to_string(x, ' ') shared from m where len(x) > 0")
def u04(spark, d):
    shared = F.array_sort(F.array_intersect(T.identifier_terms(F.col("name")), F.array(*[F.lit(t) for t in TERMS])))
    return Tables(spark, d).nodes.select("version_id", F.array_join(shared, " ").alias("shared")).where("shared <> ''")


@query("u06_dedupe_by_rank", f"select {PL}, name, node_id from (select *, row_number() over (partition by {PL}, name order by valid_from_sequence, node_id) rn from cn where name is not null) where rn = 1")
def u06(spark, d):
    rows = Tables(spark, d).nodes.where("name is not null")
    return rows.groupBy(*PLACE, "name").agg(F.min(F.struct("valid_from_sequence", "node_id")).alias("m")).select(*PLACE, "name", "m.node_id")


@query("u07_coalesced_excerpts", "with f as (select distinct md5(text) excerpt, file_id from file_versions where length(text) > 0), n as (select excerpt, count(*) files from f group by 1), p as (select f.*, files, ('0x' || substr(md5(file_id), 1, 8))::bigint % ((files + 255) // 256) part from f join n using (excerpt)) select excerpt, part, files, string_agg(file_id, ' ' order by file_id) file_ids from p group by all", base=False)
def u07(spark, d):
    """The ids of an excerpt come in parts of about 256, so that no text's list grows without bound."""
    f = table(spark, d, "file_versions").where(F.length("text") > 0).select(F.md5(F.encode("text", "UTF-8")).alias("excerpt"), "file_id").distinct()
    n = f.groupBy("excerpt").agg(F.count("*").alias("files"))
    part = F.conv(F.substring(F.md5("file_id"), 1, 8), 16, 10).cast("bigint") % F.floor((F.col("files") + 255) / 256)
    rows = f.join(n, "excerpt").withColumn("part", part)
    return rows.groupBy("excerpt", "part", "files").agg(F.array_join(F.array_sort(F.collect_list("file_id")), " ").alias("file_ids"))


# --- Temporal -------------------------------------------------------------------------------------------------------


@query("t01_graph_at", f"select {FA}, valid_from_sequence from facts where {_ASOF}")
def t01(spark, d):
    return history.as_of(Tables(spark, d).facts, AT).select(*FACT, "valid_from_sequence")


@query("t02_graph_known_by", f", r as (select *, max(nanos) over w m, min((nanos is not null)::int) over w k from g window w as (partition by {PL} order by generation_sequence)), ks as (select {PL}, max(generation_sequence) s from r where k = 1 and m <= {KNOWN_BY} group by 1, 2) select {FA}, valid_from_sequence from facts join ks using ({PL}) where valid_from_sequence <= s and (valid_until_sequence is null or valid_until_sequence > s)")
def t02(spark, d):
    t = Tables(spark, d)
    return history.known_graph(t.facts, t.raw("generations"), KNOWN_BY).select(*FACT, "valid_from_sequence")


@query("t03_nodes_at", f"select * from nv where {_ASOF}")
def t03(spark, d):
    return history.as_of(Tables(spark, d)["node_versions"], AT)


@query("t04_node_history", f"select {PL}, node_id, version_id, valid_from_sequence, valid_until_sequence, row_number() over (partition by {PL}, node_id order by valid_from_sequence, version_id) version from nv")
def t04(spark, d):
    by = Window.partitionBy(*PLACE, "node_id").orderBy("valid_from_sequence", "version_id")
    return Tables(spark, d)["node_versions"].select(*PLACE, "node_id", "version_id", "valid_from_sequence", "valid_until_sequence", F.row_number().over(by).cast("bigint").alias("version"))


@query("t06_history_as_of", f"select {FA}, valid_from_sequence, case when valid_until_sequence <= {AT} then valid_until_sequence end valid_until_sequence from facts where valid_from_sequence <= {AT}")
def t06(spark, d):
    return history.history_as_of(Tables(spark, d).facts, AT)


@query("t07_version_validity", f", p as (select distinct {PL}, premise_id, edge_id, valid_from from premises) select p.premise_id, bool_or(e.version_id is not null) as \"exists\" from p left join g on g.repository_id = p.repository_id and g.worktree_id = p.worktree_id and g.generation = p.valid_from left join ev e on e.repository_id = p.repository_id and e.worktree_id = p.worktree_id and e.edge_id = p.edge_id and e.valid_from_sequence = g.generation_sequence group by 1")
def t07(spark, d):
    t = Tables(spark, d)
    g = history.chain(t.raw("generations")).select(*PLACE, F.col("generation").alias("valid_from"), F.col("generation_sequence").alias("valid_from_sequence"))
    stated = t.raw("premises").select(*PLACE, "premise_id", "edge_id", "valid_from").distinct().join(g, [*PLACE, "valid_from"], "left")
    there = t["edge_versions"].select(*PLACE, "edge_id", "valid_from_sequence").distinct().withColumn("e", F.lit(True))
    return stated.join(there, [*PLACE, "edge_id", "valid_from_sequence"], "left").groupBy("premise_id").agg(F.bool_or(F.coalesce("e", F.lit(False))).alias("exists"))


@query("t08_changed_at", f"select *, valid_from_sequence = {AT} opened from facts where valid_from_sequence = {AT} or valid_until_sequence = {AT}")
def t08(spark, d):
    return history.changed_at(Tables(spark, d).facts, AT)


@query("t09_changes_between", f"select {FA}, generation_sequence, change_id, kind from ch where generation_sequence > {AFTER} and generation_sequence <= {UNTIL}")
def t09(spark, d):
    return Tables(spark, d).changes.where((F.col("generation_sequence") > AFTER) & (F.col("generation_sequence") <= UNTIL)).select(*FACT, "generation_sequence", "change_id", "kind")


@query("t10_change_events", f"select {PL}, generation_sequence, event_id, count(*) filter (kind = 'Added') added, count(*) filter (kind = 'Updated') updated, count(*) filter (kind = 'Removed') removed from ch group by all")
def t10(spark, d):
    one = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k.lower())
    return Tables(spark, d).changes.groupBy(*PLACE, "generation_sequence", "event_id").agg(one("Added"), one("Updated"), one("Removed"))


_KINDS = f", b as (select {FA}, valid_from_sequence sequence, 1 o, 0 c from facts union all select {FA}, valid_until_sequence, 0, 1 from facts where valid_until_sequence is not null), s as (select {FA}, sequence, sum(o) opened, sum(c) closed from b group by all), h as (select *, sum(opened - closed) over (partition by {FA} order by sequence) held from s), k as (select {FA}, sequence, case when held - opened + closed <= 0 and opened > 0 then 'Added' when held - opened + closed > 0 and opened > 0 then 'Updated' when closed > 0 and held <= 0 then 'Removed' end kind from h) select * from k where kind is not null"


@query("t11_change_kinds", _KINDS)
def t11(spark, d):
    return history.change_kinds(Tables(spark, d).facts)


@query("t12_fact_lineage", f"select * from (select {FA}, valid_from_sequence, lag(valid_from_sequence) over (partition by {FA} order by valid_from_sequence, valid_until_sequence nulls last) supersedes from facts) where supersedes is not null")
def t12(spark, d):
    return history.supersessions(Tables(spark, d).facts)


@query("t13_version_introduction", _DERIVED + f" select {FA}, valid_from_sequence, introduced_by, introduced_kind from dvv")
def t13(spark, d):
    return history.derived_versions(Tables(spark, d).changes).select(*FACT, "valid_from_sequence", "introduced_by", "introduced_kind")


@query("t14_version_retirement", _DERIVED + f" select {FA}, valid_from_sequence, valid_until_sequence, retired_by, coalesce(retired_kind, 'open') retired_kind from dvv")
def t14(spark, d):
    return history.derived_versions(Tables(spark, d).changes).select(*FACT, "valid_from_sequence", "valid_until_sequence", "retired_by", F.coalesce("retired_kind", F.lit("open")).alias("retired_kind"))


@query("t16_observed_between", _OBS + "select subject, relation, object, observed_at_nanos from o where observed_at_nanos >= (select min(observed_at_nanos) from o) + 86400000000000 and observed_at_nanos < (select min(observed_at_nanos) from o) + 10 * 86400000000000", base=False)
def t16(spark, d):
    o = _observations(spark, d).drop("producer_namespace")
    first = o.agg(F.min("observed_at_nanos")).first()[0] or 0
    day = 86_400_000_000_000
    return o.where((F.col("observed_at_nanos") >= first + day) & (F.col("observed_at_nanos") < first + 10 * day))


@query("t17_correlated_events", f", an as (select {PL}, event_id from (select *, row_number() over (partition by {PL} order by generation_sequence, event_id) rn from (select distinct {PL}, generation_sequence, event_id from ch)) where rn = 1), a as (select distinct ch.{FA.replace(', ', ', ch.')}, ch.event_id anchor, ch.generation_sequence anchored from ch join an using ({PL}, event_id)) select {PL}, anchor, event_id, generation_sequence, count(distinct (fact_kind, fact_id)) shared_facts from ch join a using ({FA}) where generation_sequence > anchored and event_id <> anchor group by all")
def t17(spark, d):
    c = Tables(spark, d).changes
    anchors = c.groupBy(*PLACE).agg(F.min(F.struct("generation_sequence", "event_id")).alias("m")).select(*PLACE, "m.event_id")
    return history.correlated_events(c, anchors)


@query("t18_current_generation", f"select {PL}, arg_max(generation, generation_sequence) generation, max(generation_sequence) generation_sequence, arg_max(status, generation_sequence) status from g group by 1, 2")
def t18(spark, d):
    g = history.chain(Tables(spark, d).raw("generations"))
    return g.groupBy(*PLACE).agg(F.max(F.struct("generation_sequence", "generation", "status")).alias("m")).select(*PLACE, "m.generation", "m.generation_sequence", "m.status")


# --- Graph ----------------------------------------------------------------------------------------------------------

_REACH = ", st as ({step}), b as (select repository_id, worktree_id, node_id, 0 depth from seed union select b.repository_id, b.worktree_id, st.b, b.depth + 1 from b join st on st.repository_id = b.repository_id and st.worktree_id = b.worktree_id and st.a = b.node_id where b.depth < 3), r as (select repository_id, worktree_id, node_id, min(depth) depth from b group by 1, 2, 3)"
_OUT = f"select distinct {PL}, source a, target b from ce"
_IN = f"select distinct {PL}, target a, source b from ce"
RECURSIVE = BASE.replace("\nwith ", "\nwith recursive ", 1)


@query("g03_shortest_paths", RECURSIVE + f", b as (select {PL}, node_id, 0 hops, []::varchar[] path from seed union all select b.repository_id, b.worktree_id, ce.target, hops + 1, list_append(path, edge_id) from b join (select distinct {PL}, edge_id, source, target from ce) ce on ce.repository_id = b.repository_id and ce.worktree_id = b.worktree_id and ce.source = b.node_id where hops < 3) select {PL}, node_id, hops, array_to_string(path, ' ') path from (select *, row_number() over (partition by {PL}, node_id order by hops, path) rn from b) where rn = 1", base=False)
def g03(spark, d):
    t = Tables(spark, d)
    return graph.shortest_paths(t.edges, t.seeds, 3).withColumn("path", F.array_join("path", " "))


@query("g04_impact", RECURSIVE + _REACH.format(step=_IN) + " select * from r where depth > 0", base=False)
def g04(spark, d):
    t = Tables(spark, d)
    return graph.reach(t.edges, t.seeds, 3, "in").where("depth > 0")


@query("g05_neighborhood", RECURSIVE + _REACH.format(step=f"{_OUT} union {_IN}") + f" select {PL}, edge_id, least(x.depth, y.depth) + 1 depth from (select distinct {PL}, edge_id, source, target from ce) e join (select {PL}, node_id source, depth from r) x using ({PL}, source) join (select {PL}, node_id target, depth from r) y using ({PL}, target) where least(x.depth, y.depth) < 3", base=False)
def g05(spark, d):
    t = Tables(spark, d)
    e = t.edges.select(*PLACE, "edge_id", "source", "target").distinct()
    return graph.neighborhood_edges(e, graph.reach(e, t.seeds, 3, "both"), 3).select(*PLACE, "edge_id", "depth")


@query("g07_subgraph", RECURSIVE + _REACH.format(step=f"{_OUT} union {_IN}") + f" select distinct {PL}, edge_id from ce where ({PL}, source) in (select {PL}, node_id from r) and ({PL}, target) in (select {PL}, node_id from r)", base=False)
def g07(spark, d):
    t = Tables(spark, d)
    e = t.edges.select(*PLACE, "edge_id", "source", "target").distinct()
    return graph.induced_edges(e, graph.reach(e, t.seeds, 3, "both")).select(*PLACE, "edge_id").distinct()


@query("g08_simple_paths", RECURSIVE + f", s as (select distinct {PL}, edge_id, source, target from ce where relation = 'References'), p as (select {PL}, source start, target as last, [source, target] nodes, [edge_id] edge_ids from s where source <> target union all select p.repository_id, p.worktree_id, start, s.target, list_append(nodes, s.target), list_append(edge_ids, s.edge_id) from p join s on s.repository_id = p.repository_id and s.worktree_id = p.worktree_id and s.source = p.last where not list_contains(nodes, s.target)) select {PL}, start, last as \"end\", array_to_string(edge_ids, ' ') path from p", base=False)
def g08(spark, d):
    paths = graph.simple_paths(Tables(spark, d).edges, "References", 24)
    return paths.select(*PLACE, "start", "end", F.array_join("edge_ids", " ").alias("path"))


@query("g09_cyclic_components", RECURSIVE + f", s as (select distinct {PL}, source, target from ce), c as (select * from s union select c.repository_id, c.worktree_id, c.source, s.target from c join s on s.repository_id = c.repository_id and s.worktree_id = c.worktree_id and s.source = c.target), m as (select a.repository_id, a.worktree_id, a.source node_id, a.target other from c a join c b on a.repository_id = b.repository_id and a.worktree_id = b.worktree_id and a.source = b.target and a.target = b.source) select {PL}, node_id, min(other) component from m group by 1, 2, 3", base=False)
def g09(spark, d):
    return graph.cyclic_components(Tables(spark, d).edges)


@query("g10_adjacency", f", e as (select * from ev where {_ASOF}) select distinct {PL}, source node_id, 'out' direction, target other, edge_id from e union select {PL}, target, 'in', source, edge_id from e")
def g10(spark, d):
    return graph.adjacency(history.as_of(Tables(spark, d)["edge_versions"], AT))


@query("g11_incidence_index", f", a as (select distinct {PL}, source node_id, 'out' direction, target other, edge_id from ce union select {PL}, target, 'in', source, edge_id from ce) select * from a where ({PL}, node_id) in (select {PL}, node_id from seed)")
def g11(spark, d):
    """The edges of each worktree's busiest node, looked up in a written index."""
    t = Tables(spark, d)
    return graph.IncidenceIndex(t.edges).edges(t.seeds)


# --- Change sets and consequences -------------------------------------------------------------------------------------


def _declarations(t: Tables) -> DataFrame:
    return t.raw("watermarks").groupBy(*PLACE, "run_id").agg(F.max("status").alias("title"), F.max("generation_sequence").alias("sequence")).groupBy(*PLACE, "sequence").agg(F.max("title").alias("title"), F.max("run_id").alias("run_id"))


_DECL = f", de as (select {PL}, sequence, max(title) title, max(run_id) run_id from (select {PL}, run_id, max(status) title, max(generation_sequence) sequence from watermarks group by 1, 2, 3) group by 1, 2, 3)"


@query("c01_change_set_at", _DECL + f", v as (select *, lead(sequence) over (partition by {PL} order by sequence) u from de) select {PL}, run_id, title, sequence valid_from_sequence, u valid_until_sequence from v where sequence <= {AT} and (u is null or u > {AT})")
def c01(spark, d):
    v = lineage.declaration_versions(_declarations(Tables(spark, d)), PLACE)
    return history.as_of(v, AT).select(*PLACE, "run_id", "title", "valid_from_sequence", "valid_until_sequence")


@query("c02_change_set_events", f", m as (select {PL}, fact_kind change_set, event_id, generation_sequence sequence, case when bool_or(kind = 'Removed') then 'remove' else 'add' end op from ch group by 1, 2, 3, 4, 5), l as (select {PL}, change_set, event_id, arg_max(op, sequence) op from m where sequence <= {AT} group by 1, 2, 3, 4) select {PL}, change_set, event_id from l where op = 'add'")
def c02(spark, d):
    op = F.when(F.bool_or(F.col("kind") == "Removed"), "remove").otherwise("add")
    m = Tables(spark, d).changes.groupBy(*PLACE, F.col("fact_kind").alias("change_set"), "event_id", F.col("generation_sequence").alias("sequence")).agg(op.alias("op"))
    return lineage.memberships_as_of(m, [*PLACE, "change_set"], AT)


@query("c04_consequences_at_endpoint", f"select distinct ev.{PL.replace(', ', ', ev.')}, version_id from ev join seed on seed.repository_id = ev.repository_id and seed.worktree_id = ev.worktree_id and seed.node_id in (source, target) where {_ASOF}")
def c04(spark, d):
    t = Tables(spark, d)
    return graph.incident(history.as_of(t["edge_versions"], AT), t.seeds).select(*PLACE, "version_id").distinct()


@query("c05_consequences_in_range", f"select version_id from ev where valid_from_sequence <= {UNTIL} and (valid_until_sequence is null or valid_until_sequence > {AFTER})")
def c05(spark, d):
    return lineage.overlapping(Tables(spark, d)["edge_versions"], AFTER, UNTIL).select("version_id")


@query("c07_consequence_trace", RECURSIVE + f", e as (select distinct {PL}, source, target, valid_from_sequence vf, valid_until_sequence vu from ev), s as (select {PL}, node_id, {AFTER}::bigint arrival, 0 depth from seed union select s.repository_id, s.worktree_id, e.target, greatest(arrival, vf), depth + 1 from s join e on e.repository_id = s.repository_id and e.worktree_id = s.worktree_id and e.source = s.node_id where depth < 4 and greatest(arrival, vf) <= 40 and (vu is null or greatest(arrival, vf) < vu)) select * from s", base=False)
def c07(spark, d):
    t = Tables(spark, d)
    return graph.time_respecting_trace(t["edge_versions"], t.seeds, AFTER, 40, 4)


# --- Lexical retrieval ------------------------------------------------------------------------------------------------


@query("x01_identifier_terms", f"select version_id, array_to_string({_TERMS_SQL}, ' ') terms from nv")
def x01(spark, d):
    return Tables(spark, d)["node_versions"].select("version_id", F.array_join(T.identifier_terms(F.col("name")), " ").alias("terms"))


@query("x02_rarity", _INDEX_SQL + " select * from wt")
def x02(spark, d):
    t = Tables(spark, d)
    df = lexical.term_statistics(lexical.postings(t.nodes), TERMS).join(lexical.populations(t.nodes), PLACE)
    return df.select(*PLACE, "term", T.rarity(F.col("population"), F.col("frequency")).alias("w"))


@query("x03_ranked_candidates", _INDEX_SQL + " select * from rk")
def x03(spark, d):
    return _ranked(Tables(spark, d))


@query("x04_postings", _INDEX_SQL + " select * from ix")
def x04(spark, d):
    return lexical.postings(Tables(spark, d).nodes)


@query("x06_family_channel", _INDEX_SQL + f" select rk.* from rk where exists (select 1 from cn where cn.repository_id = rk.repository_id and cn.worktree_id = rk.worktree_id and cn.node_id = rk.node_id and ({_FAMILY}) = 'Code')")
def x06(spark, d):
    t = Tables(spark, d)
    code = t.nodes.where(T.lexical_family(F.col("kind")) == "Code")
    return lexical.ranked(lexical.postings(t.nodes), lexical.populations(t.nodes), TERMS, code)


@query("x07_stemmed_postings")
def x07(spark, d):
    return lexical.stemmed_postings(lexical.postings(Tables(spark, d).nodes))


@query("x08_document_terms")
def x08(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(T.identifier_terms(F.col("text"), 2)).alias("term"))
    stems = docs.select("term").distinct().select("term", stemmed("term").alias("stem"))
    return docs.join(stems, "term").groupBy("stem").agg(F.countDistinct("doc_id").alias("documents"))


# --- Contracts and ontologies --------------------------------------------------------------------------------------


def _contracts(t: Tables) -> DataFrame:
    kind = F.when(F.col("premise_id") % 2 == 0, "required").otherwise("forbidden")
    return t.raw("premises").where("relation is not null").select(
        *PLACE, F.col("premise_id").alias("contract_id"), "source", "target", "relation", kind.alias("expectation")
    ).distinct()


_CONTRACTS = f", k as (select distinct {PL}, premise_id contract_id, source, target, relation, case when premise_id % 2 = 0 then 'required' else 'forbidden' end expectation from premises where relation is not null), x as (select {PL}, source, target, relation, min(edge_id) evidence from ce group by all), o as (select k.*, evidence, case when evidence is null then 'InsufficientEvidence' when expectation = 'required' then 'Supported' else 'Contradicted' end outcome from k left join x using ({PL}, source, target, relation))"


@query("i11_contracts", _CONTRACTS + " select * from o")
def i11(spark, d):
    t = Tables(spark, d)
    return inference.evaluate_contracts(_contracts(t), t.edges)


@query("a13_contract_gate", _CONTRACTS + f" select {PL}, not bool_or(outcome = 'Contradicted') passes, count(*) contracts from o group by 1, 2")
def a13(spark, d):
    t = Tables(spark, d)
    return inference.contract_gate(inference.evaluate_contracts(_contracts(t), t.edges))


def _evaluations(t: Tables) -> DataFrame:
    return t.raw("external_snapshots").groupBy(*PLACE, F.col("as_of_sequence").alias("sequence"), F.col("node_id").alias("contract_id")).agg(
        F.max(F.coalesce("stage", F.lit("none"))).alias("outcome")
    )


_EPISODES = f", e as (select {PL}, as_of_sequence sequence, node_id contract_id, max(coalesce(stage, 'none')) outcome from external_snapshots group by 1, 2, 3, 4), s as (select *, lead(sequence) over (partition by {PL} order by sequence) nxt from (select distinct {PL}, sequence from e)), r as (select e.*, nxt from e join s using ({PL}, sequence)), f as (select *, case when lag(nxt) over w = sequence and lag(outcome) over w = outcome then 0 else 1 end fresh from r window w as (partition by {PL}, contract_id order by sequence)), q as (select *, sum(fresh) over (partition by {PL}, contract_id order by sequence) run from f), ep as (select {PL}, contract_id, outcome, min(sequence) first_sequence, max(sequence) last_sequence, arg_max(coalesce(nxt, -1), sequence) ended_sequence from q group by {PL}, contract_id, run, outcome)"


@query("a12_contract_episodes", _EPISODES + f" select {PL}, contract_id, outcome, first_sequence, last_sequence, nullif(ended_sequence, -1) ended_sequence from ep")
def a12(spark, d):
    return inference.episodes(_evaluations(Tables(spark, d)))


@query("w09_outcome_as_of", _EPISODES + f" select {PL}, contract_id, outcome, first_sequence from ep where first_sequence <= {AT} and (ended_sequence = -1 or ended_sequence > {AT})")
def w09(spark, d):
    return inference.outcome_as_of(inference.episodes(_evaluations(Tables(spark, d))), AT).select(*PLACE, "contract_id", "outcome", "first_sequence")


@query("i12_latest_evaluations", f", e as (select {PL}, as_of_sequence sequence, node_id contract_id, max(coalesce(stage, 'none')) outcome from external_snapshots group by 1, 2, 3, 4) select e.* from e join (select {PL}, max(sequence) sequence from e where sequence <= {AT} group by 1, 2) using ({PL}, sequence)")
def i12(spark, d):
    return inference.latest_evaluations(_evaluations(Tables(spark, d)), AT)


@query("i13_ontology_violations", f", c as (select distinct {PL}, edge_id claim_id, source, target from ce where relation = 'Calls') select {PL}, claim_id, 'domain' violates from c where not exists (select 1 from cn n where n.repository_id = c.repository_id and n.worktree_id = c.worktree_id and n.node_id = c.source and n.kind = 'Function') union select {PL}, claim_id, 'range' from c where not exists (select 1 from cn n where n.repository_id = c.repository_id and n.worktree_id = c.worktree_id and n.node_id = c.target and n.kind = 'Function')")
def i13(spark, d):
    t = Tables(spark, d)
    signatures = spark.createDataFrame([("Calls", "Function", "Function")], "relation string, domain string, range string")
    claims = t.edges.select(*PLACE, F.col("edge_id").alias("claim_id"), "source", "target", "relation").distinct()
    return inference.ontology_violations(claims, t.nodes.select(*PLACE, "node_id", F.col("kind").alias("concept")), signatures)


# --- Resolution and documents ---------------------------------------------------------------------------------------------

_DEFS = "('Module','Function','Struct','Enum','Trait','Class')"


@query("r01_resolve_references", f", df as (select distinct {PL}, node_id, kind, name key from cn where kind in {_DEFS} and name is not null), rf as (select distinct n.repository_id, n.worktree_id, n.node_id reference_id, n.name key, coalesce(e.relation, 'Unresolved') relation from cn n left join (select distinct {PL}, target, relation from ce) e on e.repository_id = n.repository_id and e.worktree_id = n.worktree_id and e.target = n.node_id where kind = 'UnresolvedReference'), m as (select rf.{PL.replace(', ', ', rf.')}, reference_id, rf.relation, rf.key, count(distinct df.node_id) targets, min(df.node_id) who from rf left join df on df.repository_id = rf.repository_id and df.worktree_id = rf.worktree_id and df.key = rf.key and rf.relation not in ('Imports', 'Unresolved') and (rf.relation <> 'Implements' or df.kind = 'Trait') group by all) select {PL}, reference_id, relation, case when targets = 1 then 'Reference' when targets > 1 then 'Ambiguous' else 'Unresolved' end status, targets, case when targets = 1 then who end resolved from m")
def r01(spark, d):
    """Unresolved references by each relation that leads to them; one that nothing leads to has no static target."""
    t = Tables(spark, d)
    n = t.nodes
    by = t.edges.select(*PLACE, F.col("target").alias("node_id"), "relation").distinct()
    refs = n.where("kind = 'UnresolvedReference'").join(by, [*PLACE, "node_id"], "left")
    refs = refs.select(*PLACE, F.col("node_id").alias("reference_id"), F.col("name").alias("symbol"), F.coalesce("relation", F.lit("Unresolved")).alias("relation")).distinct()
    return resolution.resolve_references(refs, n.where(F.col("kind").isin(resolution.DEFINITIONS) & F.col("name").isNotNull()))


@query("r04_module_paths", f", f as (select distinct {PL}, file_id, normalized_path path from fv where valid_until_sequence is null), i as (select {PL}, file_id import_id, regexp_replace(path, '^[^/]*/', '') tail, path from f where path like '%.py'), c as (select i.repository_id, i.worktree_id, import_id, r.n, r.root || tail path from i, (values (1, 'src/'), (2, 'pkg/'), (3, 'tools/')) r(n, root)), h as (select c.repository_id, c.worktree_id, import_id, arg_min(c.path, n) path from c join f on f.repository_id = c.repository_id and f.worktree_id = c.worktree_id and f.path = c.path group by 1, 2, 3) select distinct {PL}, import_id, h.path, case when h.path is null then 'unresolved' else 'resolved' end status from (select distinct {PL}, import_id from i) left join h using ({PL}, import_id)")
def r04(spark, d):
    """The module that each current Python file is, below its first folder, looked for under three roots in order."""
    f = history.current(Tables(spark, d)["file_versions"]).select(*PLACE, "file_id", F.col("normalized_path").alias("path")).distinct()
    tail = F.regexp_replace(F.regexp_replace("path", r"^[^/]*/", ""), r"\.py$", "")
    i = f.where(F.col("path").endswith(".py")).select(*PLACE, F.col("file_id").alias("import_id"), F.replace(tail, F.lit("/"), F.lit(".")).alias("module"), F.col("path").alias("source_path"))
    return resolution.resolve_modules(i, f, ["src", "pkg", "tools"]).distinct()


_JS = "regexp_extract_all(text, 'from \"([^\"]+)\"', 1)"


@query("r05_relative_imports", f"with f as (select distinct {PL}, file_id, normalized_path path, {_JS} modules from file_versions where valid_until_sequence is null), i as (select {PL}, file_id || '#' || m import_id, path, m from (select {PL}, file_id, path, unnest(modules) m from f where regexp_matches(path, '\\.(ts|js|mjs)$'))), c as (select i.*, e.n, regexp_replace(path, '[^/]*$', '') || substr(m, 3) || e.e as pth from i, (values (0, ''), (1, '.ts'), (2, '.js'), (3, '.mjs'), (4, '/index.ts'), (5, '/index.js'), (6, '/index.mjs')) e(n, e) where m like './%'), h as (select c.repository_id, c.worktree_id, import_id, arg_min(pth, n) found from c join f on f.repository_id = c.repository_id and f.worktree_id = c.worktree_id and f.path = c.pth group by 1, 2, 3) select {PL}, import_id, found path, case when found is not null then 'resolved' when m like './%' then 'unresolved' else 'unsupported' end status from (select distinct {PL}, import_id, m from i) left join h using ({PL}, import_id)", base=False)
def r05(spark, d):
    f = history.current(table(spark, d, "file_versions")).select(*PLACE, "file_id", F.col("normalized_path").alias("path"), F.regexp_extract_all("text", F.lit('from "([^"]+)"'), F.lit(1)).alias("modules")).distinct()
    i = f.where(F.col("path").rlike(r"\.(ts|js|mjs)$")).select(*PLACE, "file_id", "path", F.explode("modules").alias("module"))
    i = i.select(*PLACE, F.concat("file_id", F.lit("#"), "module").alias("import_id"), "module", F.col("path").alias("source_path"), F.lit("typescript").alias("language")).distinct()
    return resolution.resolve_modules(i, f.select(*PLACE, "path"), ["src"])


@query("r06_export_bindings", RECURSIVE + ", ex as (select distinct source module, target as name from ce where relation = 'Exports'), sx as (select distinct source module, target source from ce where relation = 'ResolvesTo'), k as (select module, name, module origin from ex union select sx.module, k.name, k.origin from k join sx on sx.source = k.module where name <> 'default' and not exists (select 1 from ex e2 where e2.module = sx.module and e2.name = k.name)) select module, name, min(origin) origin from k group by 1, 2 having count(distinct origin) = 1", base=False)
def r06(spark, d):
    t = Tables(spark, d)
    e = t.edges.where("relation = 'Exports'").select(F.col("source").alias("module"), F.col("target").alias("name"))
    return resolution.export_bindings(e, t.edges.where("relation = 'ResolvesTo'").select(F.col("source").alias("module"), F.col("target").alias("source")))


@query("r08_sections", _HEADS + ", s as (select doc_id, line, level, title, regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}_\\- ]', '', 'g'), ' ', '-', 'g') anchor from h where level > 0) select a.doc_id, a.line, a.level, a.title, a.anchor, row_number() over (partition by a.doc_id, a.anchor order by a.line) - 1 \"duplicate\", (select max(b.line) from s b where b.doc_id = a.doc_id and b.line < a.line and b.level < a.level) parent_line from s a", base=False)
def r08(spark, d):
    return _wide(resolution.sections(table(spark, d, "documents")), "line", "level", "duplicate", "parent_line")


@query("r09_paragraphs", _LINES + "b as (select *, not regexp_matches(txt, '\\S') blank from l), q as (select *, sum(blank::int) over (partition by doc_id order by line) run from b), p as (select doc_id, run, min(line) first_line, max(line) last_line from q where not blank group by 1, 2) select doc_id, row_number() over (partition by doc_id order by first_line) - 1 paragraph, first_line, last_line from p", base=False)
def r09(spark, d):
    return _wide(resolution.paragraphs(table(spark, d, "documents")), "paragraph", "first_line", "last_line")


SQL["j13_owning_section"] = _HEADS + ", b as (select *, not regexp_matches(txt, '\\S') blank from l), q as (select *, sum(blank::int) over (partition by doc_id order by line) run from b), p as (select doc_id, run, min(line) first_line from q where not blank group by 1, 2), n as (select *, row_number() over (partition by doc_id order by first_line) - 1 paragraph from p), hh as (select doc_id, line from h where level > 0) select n.doc_id, n.paragraph, max(hh.line) section_line from n left join hh on hh.doc_id = n.doc_id and hh.line < n.first_line group by all"


# --- Integrity and materialization ------------------------------------------------------------------------------------------


@query("v01_reference_counts", f", e as (select *, exists (select 1 from cn where cn.repository_id = ce.repository_id and cn.worktree_id = ce.worktree_id and cn.node_id = source) s, exists (select 1 from cn where cn.repository_id = ce.repository_id and cn.worktree_id = ce.worktree_id and cn.node_id = target) t from ce) select {PL}, count(*) filter (not s) source_missing, count(*) filter (not t) target_missing from e group by 1, 2")
def v01(spark, d):
    t = Tables(spark, d)
    n = t.nodes.select(*PLACE, "node_id").distinct()
    e = t.edges.join(n.withColumnRenamed("node_id", "source").withColumn("s", F.lit(1)), [*PLACE, "source"], "left")
    e = e.join(n.withColumnRenamed("node_id", "target").withColumn("t", F.lit(1)), [*PLACE, "target"], "left")
    return e.groupBy(*PLACE).agg((F.count("*") - F.count("s")).alias("source_missing"), (F.count("*") - F.count("t")).alias("target_missing"))


@query("v03_history_violations", f", x as (select *, lead(valid_from_sequence) over (partition by {FA} order by valid_from_sequence, valid_until_sequence nulls last) n, count(*) filter (valid_until_sequence is null) over (partition by {FA}) o from facts), y as (select {FA}, valid_from_sequence, case when valid_until_sequence <= valid_from_sequence then 'empty' when o > 1 then 'several_open' when coalesce(valid_until_sequence, 9223372036854775807) > n then 'overlap' end violation from x) select * from y where violation is not null")
def v03(spark, d):
    return validation.history_violations(Tables(spark, d).facts)


@query("v05_rejected_runs", f"select distinct {PL}, run_id, generation from watermarks where status = 'failed'", base=False)
def v05(spark, d):
    return table(spark, d, "watermarks").where("status = 'failed'").select(*PLACE, "run_id", "generation").distinct()


@query("m06_chain_digest", RECURSIVE + f", o as (select {PL}, generation root, generation_sequence sequence, row_number() over (partition by {PL} order by generation_sequence, generation) rn, count(*) over (partition by {PL}) n from g), f as (select {PL}, rn, sha256('|' || sequence || '|' || root) digest from o where rn = 1 union all select o.repository_id, o.worktree_id, o.rn, sha256(f.digest || '|' || o.sequence || '|' || o.root) from f join o on o.repository_id = f.repository_id and o.worktree_id = f.worktree_id and o.rn = f.rn + 1) select {PL}, digest, n generations from f join o using ({PL}, rn) where rn = n", base=False)
def m06(spark, d):
    g = history.chain(Tables(spark, d).raw("generations")).select(*PLACE, F.col("generation_sequence").alias("sequence"), F.col("generation").alias("root"))
    return publication.chain_digests(g)


_STATE_SQL = f""", pn as (select distinct {PL}, provenance_id from pv where valid_from_sequence <= {AT}),
n as (select * from (select {PL}, node_id, arg_max(kind, (valid_from_sequence, version_id)) kind, arg_max(provenance, (valid_from_sequence, version_id)) provenance from nv where {_ASOF} group by 1, 2, 3) x where ({PL}, provenance) in (select {PL}, provenance_id from pn)),
e as (select * from (select {PL}, edge_id, arg_max(source, (valid_from_sequence, version_id)) source, arg_max(target, (valid_from_sequence, version_id)) target, arg_max(relation, (valid_from_sequence, version_id)) relation, arg_max(provenance, (valid_from_sequence, version_id)) provenance from ev where {_ASOF} group by 1, 2, 3) x
  where ({PL}, provenance) in (select {PL}, provenance_id from pn) and ({PL}, source) in (select {PL}, node_id from n) and ({PL}, target) in (select {PL}, node_id from n)),
t as (select {PL}, node_id from n where kind = 'Test'), ec as (select *, ({PL}, source) in (select * from t) or ({PL}, target) in (select * from t) casc from e)"""


@query("m04_applied_delta", _STATE_SQL + f" select {PL}, 'nodes' part, count(*) filter (kind in ('Test', 'Module')) closed, count(*) filter (kind = 'Module') opened, count(*) filter (kind <> 'Test') live from n group by {PL} union all select {PL}, 'edges', count(*) filter (casc or relation in ('Contains', 'Defines')), count(*) filter (relation = 'Defines' and not casc), count(*) filter (not casc and relation <> 'Contains') from ec group by {PL}")
def m04(spark, d):
    """On the graph of each worktree as of a sequence: tests and Contains edges go, with what hangs on them, modules and Defines edges are written anew."""
    t = Tables(spark, d)
    last = lambda df, key, *columns: df.groupBy(*PLACE, key).agg(
        F.max_by(F.struct(*columns, "valid_from_sequence"), F.struct("valid_from_sequence", "version_id")).alias("v")
    ).select(*PLACE, key, "v.*", F.lit(None).cast("bigint").alias("valid_until_sequence"))
    p = history.as_of(t["provenance"].withColumn("valid_until_sequence", F.lit(None).cast("bigint")), AT).groupBy(*PLACE, "provenance_id").agg(F.max("valid_from_sequence").alias("valid_from_sequence"))
    p = p.withColumn("valid_until_sequence", F.lit(None).cast("bigint"))
    has = p.select(*PLACE, F.col("provenance_id").alias("provenance"))
    n = last(history.as_of(t["node_versions"], AT), "node_id", "kind", "provenance").join(has, [*PLACE, "provenance"], "left_semi")
    e = last(history.as_of(t["edge_versions"], AT), "edge_id", "source", "target", "relation", "provenance").join(has, [*PLACE, "provenance"], "left_semi")
    for end in ("source", "target"):
        e = e.join(n.select(*PLACE, F.col("node_id").alias(end)), [*PLACE, end], "left_semi")
    none = n.where("false").select(*PLACE, F.lit("").alias("file_id"), "valid_from_sequence", "valid_until_sequence")
    state = {"nodes": materialize(n, "nodes"), "edges": materialize(e, "edges"), "provenance": materialize(p, "provenance"), "files": none}
    tests = state["nodes"].where("kind = 'Test'")
    kept = state["edges"]
    for end in ("source", "target"):
        kept = kept.join(tests.select(*PLACE, F.col("node_id").alias(end)), [*PLACE, end], "left_anti")
    delta = {
        "remove_nodes": tests, "upsert_nodes": state["nodes"].where("kind = 'Module'"),
        "remove_edges": state["edges"].where("relation = 'Contains'"), "upsert_edges": kept.where("relation = 'Defines'"),
    }
    rows = None
    for part in ("nodes", "edges", "provenance"):
        rows = state[part].select(*PLACE, "valid_from_sequence") if rows is None else rows.unionByName(state[part].select(*PLACE, "valid_from_sequence"))
    bases = rows.groupBy(*PLACE).agg(F.max("valid_from_sequence").alias("base")).withColumn("sequence", F.col("base") + 1)
    after = publication.apply_delta(state, delta, bases, scope=PLACE)
    counts = None
    for part in ("nodes", "edges"):
        x = after[part].join(bases, PLACE).groupBy(*PLACE).agg(
            F.count("valid_until_sequence").alias("closed"), F.count_if(F.col("valid_from_sequence") == F.col("sequence")).alias("opened"),
            F.count_if(F.col("valid_until_sequence").isNull()).alias("live"),
        ).withColumn("part", F.lit(part))
        counts = x if counts is None else counts.unionByName(x)
    return counts


@query("m02_incremental_equals_rebuild", f"select fact_kind, count(*) as \"rows\", true same from facts where valid_from_sequence <= 3 group by 1")
def m02(spark, d):
    # The SQL counts the versions of the first three sequences; what is compared is the feed of all.
    begun = Tables(spark, d).facts.where("valid_from_sequence <= 3").groupBy("fact_kind").agg(F.count("*").alias("rows"))
    return begun.join(_materialized(spark, d).select("fact_kind", "same"), "fact_kind")


@query("m02_feed_equals_rebuild", f"{_eav_sql().replace('select *, row_number()', ', feed as (select *, row_number()', 1)}) select fact_kind, count(*) as \"rows\", true same from feed group by 1")
def m02_feed(spark, d):
    return _materialized(spark, d)


def _materialized(spark: SparkSession, d: str) -> DataFrame:
    """(fact_kind, rows, same): the attribute feed synchronized over all sequences, row by row against a rebuild from all facts."""
    t = Tables(spark, d)
    feed = history.attributes({name: t.raw(name) for _, name, _ in history.FAMILIES})
    m = publication.Materializer(spark, scratch_path(spark, "feed"))
    m.catch_up(history.feed_changes(feed))
    side = lambda rows, rebuilt: rows.select(*feed.columns, F.lit(rebuilt).alias("rebuilt"), F.lit(1 - rebuilt).alias("viewed"))
    both = side(feed, 1) if (view := m.view()) is None else side(feed, 1).unionByName(side(view, 0))
    rows = both.groupBy(*feed.columns).agg(F.sum("rebuilt").alias("rebuilt"), F.sum("viewed").alias("viewed"))
    return rows.groupBy("fact_kind").agg(F.sum("rebuilt").alias("rows"), F.min((F.col("rebuilt") == 1) & (F.col("viewed") == 1)).alias("same"))


#: Keys that would look like a numbered problem's are spelled with their table section in front.
QUERIES = {("projection_" + k.replace("p-", "") if k.startswith("p-") else k): v for k, v in QUERIES.items()}
SQL = {("projection_" + k.replace("p-", "") if k.startswith("p-") else k): v for k, v in SQL.items()}
