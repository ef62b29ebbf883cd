"""More queries of the graph engine's operators: pages, retrieval, neighbourhoods as records, plans and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import context, graph, history, inference, lexical, lineage, resolution, validation
from palimpsest.plans import reference as R
from palimpsest.plans.reference import _ASOF, _CONTRACTS, _FAMILY, _INDEX_SQL, _IN, _OUT, _REACH, AFTER, AT, BASE, FA, FACT, PL, PLACE, RECURSIVE, TERMS, UNTIL, Tables
from palimpsest.sources import scan
from palimpsest.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return f

    return register


# --- Joins and set operations ------------------------------------------------------------------------------------


@query("j04_as_of_lookup", f"select {PL}, node_id, max(valid_from_sequence) valid_from_sequence from nv where {_ASOF} group by 1, 2, 3")
def j04(spark, d):
    return history.as_of(Tables(spark, d)["node_versions"], AT).groupBy(*PLACE, "node_id").agg(F.max("valid_from_sequence").alias("valid_from_sequence"))


@query("j06_either_endpoint", f", i as (select distinct {PL}, node_id from cn where kind = 'Trait') select distinct ev.{PL.replace(', ', ', ev.')}, version_id from ev join i on i.repository_id = ev.repository_id and i.worktree_id = ev.worktree_id and i.node_id in (source, target) where valid_from_sequence <= {UNTIL} and (valid_until_sequence is null or valid_until_sequence > {AFTER})")
def j06(spark, d):
    t = Tables(spark, d)
    e = lineage.overlapping(t["edge_versions"], AFTER, UNTIL)
    return graph.incident(e, t.nodes.where("kind = 'Trait'")).select(*PLACE, "version_id").distinct()


@query("j12_contract_evidence", _CONTRACTS + f" select {PL}, contract_id, evidence from o where evidence is not null")
def j12(spark, d):
    t = Tables(spark, d)
    return inference.evaluate_contracts(R._contracts(t), t.edges).where("evidence is not null").select(*PLACE, "contract_id", "evidence")


@query("j15_change_set_generations", f", e as (select {PL}, event_id, fact_kind change_set, min(generation_sequence) generation_sequence from ch where generation_sequence <= {AT} group by 1, 2, 3, 4) select e.*, generation from e join g using ({PL}, generation_sequence)".replace("group by 1, 2, 3, 4", "group by repository_id, worktree_id, event_id, fact_kind"))
def j15(spark, d):
    t = Tables(spark, d)
    e = t.changes.where(F.col("generation_sequence") <= AT).groupBy(*PLACE, "event_id", F.col("fact_kind").alias("change_set")).agg(F.min("generation_sequence").alias("generation_sequence"))
    return e.join(history.chain(t.raw("generations")).select(*PLACE, "generation_sequence", "generation"), [*PLACE, "generation_sequence"])


@query("j19_merged_incidence", f"select {PL}, node_id, edge_id, direction from (select {PL}, source node_id, edge_id, 'out' direction from ce union select {PL}, target, edge_id, 'in' from ce)")
def j19(spark, d):
    e = Tables(spark, d).edges
    out = e.select(*PLACE, F.col("source").alias("node_id"), "edge_id", F.lit("out").alias("direction"))
    return out.unionByName(e.select(*PLACE, F.col("target").alias("node_id"), "edge_id", F.lit("in").alias("direction"))).distinct()


@query("u01_starts_and_ends", f"select {FA}, {AT} \"at\", 'start' side from facts where valid_from_sequence = {AT} union all select {FA}, {AT}, 'end' from facts where valid_until_sequence = {AT} and valid_from_sequence <> {AT}")
def u01(spark, d):
    f = Tables(spark, d).facts
    at = F.lit(AT).alias("at")
    starts = f.where(F.col("valid_from_sequence") == AT).select(*FACT, at, F.lit("start").alias("side"))
    ends = f.where((F.col("valid_until_sequence") == AT) & (F.col("valid_from_sequence") != AT)).select(*FACT, at, F.lit("end").alias("side"))
    return starts.unionByName(ends)


@query("u02_ordered_feed", f"select *, case fact_kind when 'file' then 0 when 'provenance' then 1 when 'node' then 2 else 3 end family from facts")
def u02(spark, d):
    return Tables(spark, d).facts.withColumn("family", history.fact_order(F.col("fact_kind")))


@query("u05_lost_concepts", f", a as (select distinct {PL}, kind from nv where {_ASOF}) select {PL}, kind from a except select {PL}, kind from cn")
def u05(spark, d):
    t = Tables(spark, d)
    then = history.as_of(t["node_versions"], AT).select(*PLACE, "kind").distinct()
    return then.join(t.nodes.select(*PLACE, "kind").distinct(), [*PLACE, "kind"], "left_anti")


# --- Pages -------------------------------------------------------------------------------------------------------


@query("l02_node_page", f"select node_id, version_id from nv where {_ASOF} and node_id > 'nod_3' order by node_id, version_id limit 1001")
def l02(spark, d):
    rows = history.as_of(Tables(spark, d)["node_versions"], AT).where("node_id > 'nod_3'").select("node_id", "version_id")
    return history.page(rows, ["node_id", "version_id"], 1000)


@query("l03_file_page", f"select file_id, valid_from_sequence, {PL} from fv where {_ASOF} and file_id > 'fil_3' order by file_id, valid_from_sequence, {PL} limit 1001")
def l03(spark, d):
    rows = history.as_of(Tables(spark, d)["file_versions"], AT).where("file_id > 'fil_3'").select("file_id", "valid_from_sequence", *PLACE)
    return history.page(rows, ["file_id", "valid_from_sequence", *PLACE], 1000)


@query("l05_change_page", f"select generation_sequence, fact_id, change_id from ch where (generation_sequence, fact_id, change_id) > ({AFTER}, 'edg_2', 0) order by 1, 2, 3 limit 257")
def l05(spark, d):
    rows = Tables(spark, d).changes.select("generation_sequence", "fact_id", "change_id")
    return history.page(rows, ["generation_sequence", "fact_id", "change_id"], 256, (AFTER, "edg_2", 0))


@query("l07_observation_page", R._OBS + "select observed_at_nanos, subject, relation, object from o order by 1, 2, 3, 4 limit 513", base=False)
def l07(spark, d):
    return history.page(R._observations(spark, d).drop("producer_namespace"), ["observed_at_nanos", "subject", "relation", "object"], 512)


@query("l09_nodes_by_ids", f"select distinct cn.{PL.replace(', ', ', cn.')}, node_id, kind from cn join (select distinct {PL}, target node_id from ce where relation = 'Implements') using ({PL}, node_id)")
def l09(spark, d):
    t = Tables(spark, d)
    ids = t.edges.where("relation = 'Implements'").select(*PLACE, F.col("target").alias("node_id"))
    return t.nodes.join(ids, [*PLACE, "node_id"], "left_semi").select(*PLACE, "node_id", "kind").distinct()


# --- Neighbourhoods and traces as records --------------------------------------------------------------------------


@query("g02_neighbors_at", f", n as (select * from nv where {_ASOF}), e as (select * from ev where {_ASOF}) select e.{PL.replace(', ', ', e.')}, edge_id, e.version_id, n.version_id node_version from e join n on n.repository_id = e.repository_id and n.worktree_id = e.worktree_id and n.node_id = e.target")
def g02(spark, d):
    t = Tables(spark, d)
    n = history.as_of(t["node_versions"], AT).select(*PLACE, F.col("node_id").alias("target"), F.col("version_id").alias("node_version"))
    return history.as_of(t["edge_versions"], AT).join(n, [*PLACE, "target"]).select(*PLACE, "edge_id", "version_id", "node_version")


_LINE = "json_object('edge_id', edge_id, 'source', source, 'target', target, 'depth', depth)::varchar"


@query("g06_neighborhood_records", RECURSIVE + _REACH.format(step=f"{_OUT} union {_IN}") + f", h as (select {PL}, edge_id, source, target, least(x.depth, y.depth) + 1 depth from (select distinct {PL}, edge_id, source, target from ce) e join (select {PL}, node_id source, depth from r) x using ({PL}, source) join (select {PL}, node_id target, depth from r) y using ({PL}, target) where least(x.depth, y.depth) < 3), z as (select {PL}, {_LINE} line, sum(strlen({_LINE})) over (partition by {PL} order by depth, edge_id) bytes from h) select {PL}, line, bytes::bigint bytes from z where bytes <= 2048", base=False)
def g06(spark, d):
    return _neighborhood_records(spark, d).where("kept").select(*PLACE, "line", "bytes")


@query("g06_neighborhood_all_records", SQL["g06_neighborhood_records"].removesuffix(f" select {PL}, line, bytes::bigint bytes from z where bytes <= 2048") + f" select {PL}, line, bytes::bigint bytes, bytes <= 2048 kept, (count(*) filter (bytes > 2048) over (partition by {PL}))::bigint omitted, max(bytes) over (partition by {PL}) > 2048 truncated from z", base=False)
def g06_all(spark, d):
    return _neighborhood_records(spark, d).select(*PLACE, "line", "bytes", "kept", "omitted", "truncated")


def _neighborhood_records(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    e = t.edges.select(*PLACE, "edge_id", "source", "target").distinct()
    rows = graph.neighborhood_edges(e, graph.reach(e, t.seeds, 3, "both"), 3)
    lines = rows.withColumn("line", F.to_json(F.struct("edge_id", "source", "target", "depth")))
    return graph.within_bytes(lines, ["depth", "edge_id"], 2048)


@query("c06_consequence_neighborhood", RECURSIVE + _REACH.format(step=f"select distinct {PL}, source a, target b from ev where {_ASOF} union select distinct {PL}, target, source from ev where {_ASOF}") + " select * from r", base=False)
def c06(spark, d):
    t = Tables(spark, d)
    return graph.reach(history.as_of(t["edge_versions"], AT), t.seeds, 3, "both")


@query("c08_trace_records", RECURSIVE + f", e as (select distinct {PL}, source, target, valid_from_sequence vf, valid_until_sequence vu from ev), s as (select {PL}, node_id, {AFTER}::bigint arrival, 0 depth from seed union select s.repository_id, s.worktree_id, e.target, greatest(arrival, vf), depth + 1 from s join e on e.repository_id = s.repository_id and e.worktree_id = s.worktree_id and e.source = s.node_id where depth < 2 and greatest(arrival, vf) <= 40 and (vu is null or greatest(arrival, vf) < vu)) select {PL}, json_object('node_id', node_id, 'arrival', arrival, 'depth', depth)::varchar line from s", base=False)
def c08(spark, d):
    t = Tables(spark, d)
    states = graph.time_respecting_trace(t["edge_versions"], t.seeds, AFTER, 40, 2)
    return states.select(*PLACE, F.to_json(F.struct("node_id", "arrival", "depth")).alias("line"))


@query("c03_invalid_memberships", f", m as (select {PL}, fact_kind change_set, event_id, generation_sequence sequence, case when kind = 'Removed' then 'remove' else 'add' end op from ch) select {PL}, change_set, event_id, sequence, 'add_and_remove' problem from m group by 1, 2, 3, 4, 5 having count(distinct op) > 1".replace("group by 1, 2, 3, 4, 5", "group by repository_id, worktree_id, change_set, event_id, sequence"))
def c03(spark, d):
    c = Tables(spark, d).changes
    op = F.when(F.col("kind") == "Removed", "remove").otherwise("add")
    m = c.select(*PLACE, F.col("fact_kind").alias("change_set"), "event_id", F.col("generation_sequence").alias("sequence"), op.alias("op"))
    return lineage.invalid_memberships(m, [*PLACE, "change_set"], c.select("event_id"))


@query("c09_reused_edges", f"select {PL}, edge_id, count(*) versions from ev group by {PL}, edge_id having count(*) filter (valid_until_sequence is not null) > 0 and count(*) > 1")
def c09(spark, d):
    g = Tables(spark, d)["edge_versions"].groupBy(*PLACE, "edge_id").agg(F.count("*").alias("versions"), F.count("valid_until_sequence").alias("closed"))
    return g.where("closed > 0 and versions > 1").drop("closed")


# --- Retrieval ---------------------------------------------------------------------------------------------------------


@query("x05_index_equals_scan", _INDEX_SQL + " select count(*) candidates, true same from rk")
def x05(spark, d):
    """Ranking over a written index against ranking over the nodes themselves."""
    from palimpsest.session import materialize

    t = Tables(spark, d)
    kept = materialize(lexical.postings(t.nodes), "postings")
    a = lexical.ranked(kept, lexical.populations(t.nodes), TERMS).select(*PLACE, "node_id", F.col("score").alias("a"))
    both = a.join(R._ranked(t).select(*PLACE, "node_id", F.col("score").alias("b")), [*PLACE, "node_id"], "full_outer")
    return both.agg(F.count("*").alias("candidates"), F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("same"))


_FILES = f"(select distinct {PL}, file_id, text from file_versions where valid_until_sequence is null and starts_with(sha256(text), content_hash) and length(content_hash) > 0)"
_BODY_SQL = _INDEX_SQL + f", ft as (select distinct {PL}, file_id owner_file, term from (select {PL}, file_id, unnest({R._TERMS_SQL.replace('coalesce(name', 'coalesce(text')}) term from {_FILES} x) join wanted using (term)), bx as (select distinct cn.repository_id, cn.worktree_id, node_id, term from cn join ft on ft.repository_id = cn.repository_id and ft.worktree_id = cn.worktree_id and ft.owner_file = cn.owner_file where kind in ('Function', 'Struct', 'Enum', 'Trait', 'Test', 'Class', 'Import', 'Export', 'Section', 'DocumentChunk')), bw as (select {PL}, term, length(bin(population // (frequency + 1) + 1)) w from (select {PL}, term, count(distinct node_id) frequency from bx group by all) join pop using ({PL})), bk as (select {PL}, node_id, (sum(w) * count(*))::bigint score from bx join bw using ({PL}, term) group by all)"


def _body(t: Tables) -> DataFrame:
    """Postings of the terms in the text behind each node."""
    files = history.current(t.raw("file_versions")).select(*PLACE, "file_id", "content_hash", "text")
    return lexical.body_postings(t.nodes, files, TERMS)


@query("x08_body_postings", _BODY_SQL + " select * from bx")
def x08_body(spark, d):
    return _body(Tables(spark, d))


@query("x09_fused_scores", _BODY_SQL + f", fam as (select {PL}, node_id, owner_file, {_FAMILY} family from cn), f as (select fam.*, coalesce(rk.score, 0) + coalesce(bk.score, 0) score, case when family in ('Code', 'Documentation') then 0 else 1 end tier from fam left join rk using ({PL}, node_id) left join bk using ({PL}, node_id)) select {PL}, node_id, family, score::bigint score, tier from f where score > 0")
def x09(spark, d):
    """Name and body; where no stem is asked for, the greater of body and stems is the body."""
    t = Tables(spark, d)
    body = lexical.ranked(_body(t), lexical.populations(t.nodes), TERMS)
    return lexical.fused(t.nodes, R._ranked(t), body, body.where("false")).select(*PLACE, "node_id", "family", "score", "tier")


@query("x09_fused_with_stems")
def x09_stems(spark, d):
    """Name, body and stems together, then the first of each file."""
    from palimpsest.functions.stem import stem

    t = Tables(spark, d)
    people = lexical.populations(t.nodes)
    stems = lexical.ranked(lexical.stemmed_postings(lexical.postings(t.nodes)), people, sorted({stem(x) for x in TERMS}))
    fused = lexical.fused(t.nodes, R._ranked(t), lexical.ranked(_body(t), people, TERMS), stems)
    best = fused.groupBy(*PLACE, "node_id").agg(F.max(F.struct("score", "owner_file", "tier")).alias("b")).select(*PLACE, "node_id", "b.*")
    return lexical.first_per_file(best, 32).select(*PLACE, "node_id", "owner_file", "score", "tier", "rank")


@query("w06_refilled_plan")
def w06(spark, d):
    """Channels of names, bodies and stems by family, refilled in turn."""
    from palimpsest.functions.stem import stem

    t = Tables(spark, d)
    people, family = lexical.populations(t.nodes), t.nodes.groupBy(*PLACE, "node_id").agg(F.min(T.lexical_family(F.col("kind"))).alias("family"))
    stems = lexical.ranked(lexical.stemmed_postings(lexical.postings(t.nodes)), people, sorted({stem(x) for x in TERMS}))
    out = None
    for name, scores in (("1 name", R._ranked(t)), ("2 body", lexical.ranked(_body(t), people, TERMS)), ("3 stem", stems)):
        rows = scores.join(family, [*PLACE, "node_id"])
        position = F.row_number().over(Window.partitionBy(*PLACE, "family").orderBy(F.desc("score"), "node_id"))
        part = rows.select(*PLACE, F.concat(F.lit(f"{name} "), "family").alias("channel"), position.alias("position"), "node_id")
        out = part if out is None else out.unionByName(part)
    return lexical.refilled(out, 256)


@query("x10_seed_plan", _INDEX_SQL + f", fam as (select {PL}, node_id, min({_FAMILY}) family from cn group by {PL}, node_id), t as (select rk.*, family, row_number() over (partition by {PL}, family order by score desc, node_id) turn from rk join fam using ({PL}, node_id)), o as (select *, row_number() over (partition by {PL} order by turn, list_position(['Code','Documentation','Reference','Other'], family)) rank from t) select {PL}, node_id, family, turn, rank from o where rank <= 32")
def x10(spark, d):
    t = Tables(spark, d)
    return context.seed_plan(R._ranked(t), t.nodes)


_SEEDS_SQL = f", m as (select {PL}, node_id, kind, contains(lower(name), 'edge')::int + contains(lower(name), 'resolve')::int matched from cn), c as (select {PL}, node_id, max(matched + case when matched = 2 and kind = 'Function' then 1 else 0 end)::bigint relevance from m where matched > 0 group by {PL}, node_id), sd as (select *, row_number() over (partition by {PL} order by relevance desc, node_id) rank from c), seeds as (select * from sd where rank <= 8)"


@query("x12_lexical_seeds", _SEEDS_SQL + " select * from seeds")
def x12(spark, d):
    return context.lexical_seeds(Tables(spark, d).nodes, context.query_terms("Resolve edge"), 8)


@query("x13_context_expansion", RECURSIVE + _SEEDS_SQL + f", st as ({_OUT} union {_IN}), b as (select {PL}, node_id, 0 depth from seeds union select b.repository_id, b.worktree_id, st.b, b.depth + 1 from b join st on st.repository_id = b.repository_id and st.worktree_id = b.worktree_id and st.a = b.node_id where b.depth < 1) select {PL}, node_id, min(depth) depth from b group by 1, 2, 3", base=False)
def x13(spark, d):
    t = Tables(spark, d)
    return context.expand(t.edges, context.lexical_seeds(t.nodes, ["edge", "resolve"], 8), 1)


@query("x11_preferred_plan", _INDEX_SQL + f", fam as (select {PL}, node_id, min({_FAMILY}) family, bool_or(kind = 'Test') tests from cn group by {PL}, node_id), t as (select rk.*, family, tests, row_number() over (partition by {PL}, family order by score desc, node_id) turn from rk join fam using ({PL}, node_id)), o as (select *, row_number() over (partition by {PL} order by turn, list_position(['Code','Documentation','Reference','Other'], family)) rank from t), p as (select * from o where rank <= 32) select {PL}, node_id, row_number() over (partition by {PL} order by matched < 2, tests, rank) place from p")
def x11(spark, d):
    """The seed plan with nodes that match two terms first, tests last."""
    t = Tables(spark, d)
    ranked = R._ranked(t)
    return context.preferred(context.seed_plan(ranked, t.nodes), ranked.where("matched >= 2"), t.nodes, "last", True)


@query("x20_selection_report", SQL["x13_context_expansion"].replace(f" select {PL}, node_id, min(depth) depth from b group by 1, 2, 3", f", m2 as (select {PL}, node_id, min(depth) depth from b group by 1, 2, 3) select {PL}, (select count(*) from seeds z where z.repository_id = m2.repository_id and z.worktree_id = m2.worktree_id) seeds, count(*) nodes, max(depth)::bigint deepest from m2 group by 1, 2"), base=False)
def x20(spark, d):
    t = Tables(spark, d)
    seeds = context.lexical_seeds(t.nodes, context.query_terms("Resolve edge"), 8)
    return context.selection_report(seeds, context.expand(t.edges, seeds, 1))


def _candidates(t: Tables):
    seeds = context.lexical_seeds(t.nodes, ["edge", "resolve"], 8)
    near = context.expand(t.edges, seeds, 1)
    # Only the texts of files that own a node in reach are read on.
    owners = t.nodes.join(near.select(*PLACE, "node_id"), [*PLACE, "node_id"], "left_semi").select(*PLACE, F.col("owner_file").alias("file_id")).distinct()
    files = history.current(t.raw("file_versions")).join(owners, [*PLACE, "file_id"], "left_semi")
    return context.candidates(seeds, near, t.nodes, t.edges, files.groupBy(*PLACE, "file_id").agg(F.min("text").alias("text")))


_NEAR_SQL = SQL["x13_context_expansion"].replace(f" select {PL}, node_id, min(depth) depth from b group by 1, 2, 3", f", ex as (select {PL}, node_id, min(depth) depth from b group by 1, 2, 3)")
_CANDIDATES_SQL = _NEAR_SQL + f""", nn as (select {PL}, node_id, kind, name, owner_file from (select *, row_number() over (partition by {PL}, node_id order by kind nulls first, name nulls first, owner_file nulls first) rn from cn) where rn = 1),
n0 as (select {PL}, node_id, depth, coalesce(relevance, 0) relevance, kind, name, owner_file from ex left join (select {PL}, node_id, relevance from seeds) using ({PL}, node_id) join nn using ({PL}, node_id)),
inh as (select c.repository_id, c.worktree_id, c.source node_id, max(relevance) inherited from ce c join n0 on n0.repository_id = c.repository_id and n0.worktree_id = c.worktree_id and n0.node_id = c.target where c.relation = 'Contains' and kind = 'DocumentChunk' group by 1, 2, 3),
near as (select {PL}, node_id, depth, case when kind = 'Section' then greatest(relevance, coalesce(inherited, relevance)) else relevance end relevance, kind, name, owner_file from n0 left join inh using ({PL}, node_id)),
tx as (select {PL}, file_id owner_file, min(text) text from file_versions where valid_until_sequence is null group by 1, 2, 3),
pe as (select {PL}, source, target, min(relation) relation, min(edge_id) edge_id from ce group by 1, 2, 3, 4),
al as (select {PL}, 0 o, case when kind in ('Reference', 'UnresolvedReference', 'AmbiguousReference', 'Import', 'Export', 'ModuleResolutionDiagnostic') then 1 when kind in ('File', 'Module', 'Script', 'Document') then 2 else 0 end gr, node_id key, text, node_id node_ids, relevance, depth from near join tx using ({PL}, owner_file)
  union all select {PL}, 1, 0, node_id, kind || ' ' || coalesce(name, ''), node_id, relevance, depth from near
  union all select near.repository_id, near.worktree_id, 2, 0, edge_id, source || ' ' || relation || ' ' || target, node_id, relevance, depth from pe join near on near.repository_id = pe.repository_id and near.worktree_id = pe.worktree_id and near.node_id = pe.source where (pe.repository_id, pe.worktree_id, pe.target) in (select ({PL}, node_id) from ex)
  union all select {PL}, 3, 0, 'total', count(*) || ' nodes', min(node_id), max(relevance), 0 from near group by {PL})
select {PL}, ['source_evidence', 'signature', 'graph_path', 'summary'][o + 1] kind, key, text, node_ids, relevance::bigint relevance, depth::bigint distance, position from (select *, row_number() over (partition by {PL} order by o, relevance desc, depth, gr, key, text) position from al) where position <= 256"""


@query("x14_context_candidates", _CANDIDATES_SQL, base=False)
def x14(spark, d):
    return _candidates(Tables(spark, d)).withColumn("node_ids", F.array_join("node_ids", " "))


@query("x17_packed_context")
def x17(spark, d):
    return context.packed(_candidates(Tables(spark, d)), 8192, ["edge", "resolve"])


@query("a10_omitted_by_family", _INDEX_SQL + f", q as (select rk.*, row_number() over (partition by {PL} order by score desc, node_id) rank from rk), fam as (select {PL}, node_id, min({_FAMILY}) family from cn group by {PL}, node_id) select {PL}, family, count(*) omitted from q join fam using ({PL}, node_id) where rank > 20 group by {PL}, family")
def a10(spark, d):
    t = Tables(spark, d)
    kept = lexical.top(R._ranked(t), 20).select(*PLACE, "node_id")
    family = t.nodes.groupBy(*PLACE, "node_id").agg(F.min(T.lexical_family(F.col("kind"))).alias("family"))
    return R._ranked(t).join(kept, [*PLACE, "node_id"], "left_anti").join(family, [*PLACE, "node_id"]).groupBy(*PLACE, "family").agg(F.count("*").alias("omitted"))


@query("x19_line_of_span", "with t as (select distinct file_id, valid_from_sequence, text, strlen(substr(text, 1, instr(text, '{') - 1)) a, strlen(text) n, hex(encode(text)) h from file_versions where instr(text, '{') > 0), s as (select *, a + x.w b from t, (values (1), (40), (200)) x(w)), k as (select *, b <= n and coalesce(substr(h, 2 * b + 1, 1), '') not in ('8', '9', 'A', 'B') ok from s), l as (select *, len(list_filter(regexp_extract_all(substr(h, 1, 2 * a), '..'), lambda x: x = '0A')) + 1 f, len(list_filter(regexp_extract_all(substr(h, 1, 2 * (b - case when substr(h, 2 * b - 1, 2) = '0A' then 1 else 0 end)), '..'), lambda x: x = '0A')) + 1 e from k) select file_id, valid_from_sequence, a start_byte, b end_byte, case when ok then f end first_line, case when ok then e end last_line, case when ok then md5(array_to_string(list_slice(string_split(text, chr(10)), f, e), chr(10))) end lines from l", base=False)
def x19(spark, d):
    """The lines of three spans from each file's first brace; spans that end inside a character or beyond the text are refused."""
    start = F.octet_length(F.substring(F.col("text"), F.lit(1), F.instr("text", "{") - 1))
    f = table(spark, d, "file_versions").where(F.instr("text", "{") > 0).select("file_id", "valid_from_sequence", "text").distinct()
    spans = f.select("*", start.cast("bigint").alias("start_byte"), F.explode(F.array(F.lit(1), F.lit(40), F.lit(200))).alias("w")).withColumn("end_byte", F.col("start_byte") + F.col("w"))
    lines = spans.withColumn("l", T.span_lines(F.col("text"), F.col("start_byte").cast("int"), F.col("end_byte").cast("int")))
    return lines.select("file_id", "valid_from_sequence", "start_byte", "end_byte", "l.first_line", "l.last_line", F.md5(F.encode("l.text", "UTF-8")).alias("lines"))


# --- Inference and resolution --------------------------------------------------------------------------------------------


@query("i10_claim_evidence", f", p as (select distinct {PL}, premise_id, edge_id from premises), e as (select distinct {PL}, edge_id, provenance from ev), q as (select {PL}, provenance_id provenance, evidence_class from pv) select evidence_class, count(distinct premise_id) claims from p join e using ({PL}, edge_id) join q using ({PL}, provenance) group by 1")
def i10(spark, d):
    t = Tables(spark, d)
    p = t.raw("premises").select(*PLACE, "premise_id", "edge_id").distinct()
    e = t["edge_versions"].select(*PLACE, "edge_id", "provenance").distinct()
    q = t["provenance"].select(*PLACE, F.col("provenance_id").alias("provenance"), "evidence_class")
    return p.join(e, [*PLACE, "edge_id"]).join(q, [*PLACE, "provenance"]).groupBy("evidence_class").agg(F.countDistinct("premise_id").alias("claims"))


@query("r07_resolution_status", R.SQL["r01_resolve_references"][len(BASE) :].replace("select repository_id, worktree_id, reference_id, relation, case", "select relation, status, count(*) n from (select repository_id, worktree_id, reference_id, relation, case") + ") group by 1, 2")
def r07(spark, d):
    return R.r01(spark, d).groupBy("relation", "status").agg(F.count("*").alias("n"))


@query("r15_files_to_extract", f", a as (select {PL}, file_id, max(content_hash) was from fv where {_ASOF} group by all), b as (select {PL}, file_id, max(content_hash) now from fv where valid_until_sequence is null group by all) select {PL}, file_id, was is null \"new\" from b left join a using ({PL}, file_id) where was is distinct from now")
def r15(spark, d):
    f = Tables(spark, d)["file_versions"]
    a = history.as_of(f, AT).groupBy(*PLACE, "file_id").agg(F.max("content_hash").alias("was"))
    b = history.current(f).groupBy(*PLACE, "file_id").agg(F.max("content_hash").alias("now"))
    return b.join(a, [*PLACE, "file_id"], "left").where(~F.col("was").eqNullSafe(F.col("now"))).select(*PLACE, "file_id", F.col("was").isNull().alias("new"))


@query("r16_inventory_fingerprint", f"select {PL}, bit_xor(('0x' || substr(md5(file_id || '|' || normalized_path || '|' || content_hash), 1, 15))::bigint) fingerprint from fv where valid_until_sequence is null group by 1, 2")
def r16(spark, d):
    f = history.current(Tables(spark, d)["file_versions"])
    word = F.conv(F.substring(F.md5(F.concat_ws("|", "file_id", "normalized_path", "content_hash")), 1, 15), 16, 10).cast("bigint")
    return f.withColumn("w", word).groupBy(*PLACE).agg(F.bit_xor("w").alias("fingerprint"))


@query("r17_imports_and_exports", f"select {PL}, kind, name, count(*) n from cn where kind in ('Import', 'Export') group by all")
def r17(spark, d):
    return Tables(spark, d).nodes.where(F.col("kind").isin("Import", "Export")).groupBy(*PLACE, "kind", "name").agg(F.count("*").alias("n"))


_TYPES = "[A-Z][A-Za-z0-9]*<[^;{}()=\\n]*>"


@query("r02_canonical_symbols", "with s as (select distinct unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*<[^;{}()=\\n]*>')) written from file_versions where normalized_path like '%.rs'), b as (select written from s where length(replace(written, '<', '')) = length(replace(written, '>', '')) and not regexp_matches(written, '->|=>|[<>][^A-Za-z<> ]')) select written, " + "regexp_replace(" * 8 + "regexp_replace(written, '\\s+', '', 'g')" + ", '<[^<>]*>', '', 'g')" * 8 + " symbol from b", base=False)
def r02(spark, d):
    """The types with arguments that Rust texts write, without them."""
    f = table(spark, d, "file_versions").where("normalized_path like '%.rs'")
    s = f.select(F.explode(F.regexp_extract_all("text", F.lit(_TYPES), F.lit(0))).alias("written")).distinct()
    even = F.length(F.replace("written", F.lit("<"), F.lit(""))) == F.length(F.replace("written", F.lit(">"), F.lit("")))
    s = s.where(even & ~F.col("written").rlike("->|=>|[<>][^A-Za-z<> ]"))
    return s.select("written", T.canonical_symbol(F.col("written")).alias("symbol"))


@query("r10_normal_links", "with l as (select distinct doc_id, path, unnest(regexp_extract_all(text, '\\[([A-Za-z0-9_./-]+\\.[a-z]+)\\]', 1)) link from documents where path is not null and text is not null) select doc_id, link, regexp_replace(path, '[^/]*$', '') || link beside, case when regexp_matches(path, '/') then regexp_replace(path, '[^/]+/[^/]*$', '') || link end above, link as root, null::varchar outside from l where not regexp_matches('/' || link, '/\\.{0,2}/|/\\.{0,2}$')", base=False)
def r10(spark, d):
    """The paths that documents mention in brackets, as links beside the document, from the folder above, from the root, and of another host."""
    link = F.explode(F.regexp_extract_all("text", F.lit(r"\[([A-Za-z0-9_./-]+\.[a-z]+)\]"), F.lit(1))).alias("link")
    l = table(spark, d, "documents").where("path is not null and text is not null").select("doc_id", "path", link).distinct()
    l = l.where(~F.concat(F.lit("/"), "link").rlike(r"/\.{0,2}/|/\.{0,2}$"))
    to = lambda before, after="": resolution.normal_link(F.col("path"), F.concat(F.lit(before), "link", F.lit(after)))
    return l.select("doc_id", "link", to("./", "#top").alias("beside"), to("x/../../", "?a=1").alias("above"), to("/").alias("root"), to("https://host/").alias("outside"))


@query("v02_root_moved", f", a as (select {PL}, bit_xor(('0x' || substr(md5(fact_kind || '|' || fact_id || '|' || valid_from_sequence || '|-'), 1, 15))::bigint) root from facts where {_ASOF} group by 1, 2), b as (select {PL}, bit_xor(('0x' || substr(md5(fact_kind || '|' || fact_id || '|' || valid_from_sequence || '|-'), 1, 15))::bigint) root from facts where valid_until_sequence is null group by 1, 2) select {PL}, a.root is distinct from b.root moved, a.root is not null holds from a full join b using ({PL})")
def v02(spark, d):
    """Roots of an earlier graph, written as a manifest, against the graph as it is read again then and against that of now."""
    f = Tables(spark, d).facts
    bare = lambda x: x.withColumn("valid_until_sequence", F.lit(None).cast("bigint"))
    a = history.roots(bare(history.as_of(f, AT))).select(*PLACE, F.col("root").alias("a"))
    b = history.roots(bare(history.current(f))).select(*PLACE, F.col("root").alias("b"))
    from palimpsest.session import materialize

    manifest = materialize(history.roots(bare(history.as_of(f, AT))), "manifest")
    held = validation.root_check(history.roots(bare(history.as_of(f, AT))), manifest)
    rows = a.join(b, PLACE, "full_outer").select(*PLACE, (~F.col("a").eqNullSafe(F.col("b"))).alias("moved"))
    return rows.join(held, PLACE, "left").select(*PLACE, "moved", F.coalesce("holds", F.lit(False)).alias("holds"))


@query("t05_fact_history_times", f"select {FA}, valid_from_sequence, nanos accepted_nanos from facts left join (select {PL}, generation_sequence valid_from_sequence, nanos from g) using ({PL}, valid_from_sequence)")
def t05(spark, d):
    t = Tables(spark, d)
    g = history.chain(t.raw("generations")).select(*PLACE, F.col("generation_sequence").alias("valid_from_sequence"), F.col("nanos").alias("accepted_nanos"))
    return t.facts.join(g, [*PLACE, "valid_from_sequence"], "left").select(*FACT, "valid_from_sequence", "accepted_nanos")


@query("t19_status_counts", f", d as (select {PL}, generation, case when bool_or(status = 'committed') then 'Verified' else 'Rejected' end st from watermarks group by all) select {PL}, coalesce(st, status) status, count(*) generations from g left join d using ({PL}, generation) group by all")
def t19(spark, d):
    """Generations after each run has set the status of the one that it was for."""
    t = Tables(spark, d)
    g = history.chain(t.raw("generations"))
    st = F.when(F.bool_or(F.col("status") == "committed"), "Verified").otherwise("Rejected")
    runs = t.raw("watermarks").groupBy(*PLACE, "generation").agg(st.alias("status"))
    decided = runs.join(g.select(*PLACE, "generation"), [*PLACE, "generation"], "left_semi")
    return history.with_status(g, decided).groupBy(*PLACE, "status").agg(F.count("*").alias("generations"))


@query("s11_feed_pages", f", o as (select *, (row_number() over (partition by {PL} order by case fact_kind when 'file' then 0 when 'provenance' then 1 when 'node' then 2 else 3 end, fact_id, valid_from_sequence, valid_until_sequence nulls last) - 1) // 256 page from facts) select {PL}, page, count(*) as \"rows\", min(fact_id) first_id, max(fact_id) last_id, max(valid_from_sequence) last_sequence from o group by 1, 2, 3")
def s11(spark, d):
    pages = history.feed_pages(Tables(spark, d).facts, 256)
    return pages.groupBy(*PLACE, "page").agg(F.count("*").alias("rows"), F.min("fact_id").alias("first_id"), F.max("fact_id").alias("last_id"), F.max("valid_from_sequence").alias("last_sequence"))


_STATED = r"\[([A-Za-z0-9_./-]+\.[a-z]+)\]"


@query("i17_document_claims", f"with l as (select distinct doc_id, path, text, unnest(regexp_extract_all(text, '{_STATED}', 1)) link from documents where path is not null and text is not null), c as (select doc_id, path subject, link as object, text, v.q, case v.q when 'as_is' then '[' || link || ']' when 'altered' then '[' || link || ']!?' else '' end quote from l, (values ('as_is'), ('altered'), ('empty')) v(q)), j as (select *, case when quote = '' then 'incomplete' when instr(text, quote) = 0 then 'quote' end reason from c) select doc_id, subject, object, reason, case when reason is null then sha256('claim|' || doc_id || '|' || subject || '|mentions|' || object) end claim_id, case when reason is null then strlen(substr(text, 1, instr(text, quote) - 1)) end start_byte from j", base=False)
def i17(spark, d):
    """That documents mention paths, with the mention as quote; then with an altered quote and with none."""
    docs = table(spark, d, "documents").where("path is not null and text is not null")
    l = docs.select("doc_id", F.col("path").alias("subject"), F.explode(F.regexp_extract_all("text", F.lit(_STATED), F.lit(1))).alias("object")).distinct()
    quotes = F.array(F.concat(F.lit("["), "object", F.lit("]")), F.concat(F.lit("["), "object", F.lit("]!?")), F.lit(""))
    accepted, rejected = inference.document_claims(l.select("*", F.lit("mentions").alias("relation"), F.explode(quotes).alias("quote")), docs)
    none = F.lit(None)
    return accepted.select("doc_id", "subject", "object", none.cast("string").alias("reason"), "claim_id", "start_byte").unionByName(
        rejected.select("doc_id", "subject", "object", "reason", none.cast("string").alias("claim_id"), none.cast("bigint").alias("start_byte"))
    )


@query("r12_python_symbols")
def r12(spark, d):
    f = history.current(table(spark, d, "file_versions")).where("normalized_path like '%.py'").select(*PLACE, "file_id", "valid_from_sequence", "text").distinct()
    return resolution.python_symbols(f, [*PLACE, "file_id", "valid_from_sequence"])


__all__ = ["QUERIES", "SQL", "scan"]
