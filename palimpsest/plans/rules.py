"""Queries of rule evaluation: claims, discovery, verification, dependencies and lifecycle, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import history, inference
from palimpsest.plans.reference import _ASOF, AFTER, AT, BASE, PL, PLACE, RECURSIVE, UNTIL, Tables

RULE = {
    "id": "references-caller", "version": "1", "path_relation": "References", "join_relation": "Calls", "declaration_relation": "References",
    "concept": None, "output_relation": "DependsOn",
}
SECOND = {
    "id": "imports-caller", "version": "1", "path_relation": "Imports", "join_relation": "Calls", "declaration_relation": "Calls",
    "concept": None, "output_relation": "Reaches",
}
#: Longer paths of a rule are an error.
DEPTH = 24

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _rule_sql(edges: str = "ce", rules: tuple = (RULE,)) -> str:
    """The claims of the rules as ``cl``: place, rule, source, relation, target, concept, premises, claim_id."""
    parts = [f"{RECURSIVE}, s as (select distinct {PL}, edge_id, source, target, relation from {edges})"]
    names = []
    for i, r in enumerate(rules):
        parts.append(f"""p{i} as (select {PL}, source start, target as last, [source, target] nodes, [edge_id] ids from s where relation = '{r["path_relation"]}' and source <> target
  union all select p.repository_id, p.worktree_id, start, s.target, list_append(nodes, s.target), list_append(ids, s.edge_id) from p{i} p join s on s.repository_id = p.repository_id and s.worktree_id = p.worktree_id and s.source = p.last
  where s.relation = '{r["path_relation"]}' and not list_contains(nodes, s.target)),
c{i} as (select p.repository_id, p.worktree_id, '{r["id"]}' rule_id, '{r["version"]}' version, start source, '{r["output_relation"]}' relation, a.target, b.target concept, list_append(list_append(ids, a.edge_id), b.edge_id) premises from p{i} p
  join s a on a.repository_id = p.repository_id and a.worktree_id = p.worktree_id and a.source = p.last and a.relation = '{r["join_relation"]}'
  join s b on b.repository_id = p.repository_id and b.worktree_id = p.worktree_id and b.source = a.target and b.relation = '{r["declaration_relation"]}')""")
        names.append(f"select * from c{i}")
    parts.append(f"cl as (select *, sha256(concat_ws('|', rule_id, version, {PL}, source, target, array_to_string(premises, ','))) claim_id from ({' union all '.join(names)}))")
    return ", ".join(parts)


_THEN = f"(select * from ev where valid_from_sequence <= {AFTER} and (valid_until_sequence is null or valid_until_sequence > {AFTER}))"
_BEFORE = f"(select * from ev where valid_from_sequence <= {AT - 1} and (valid_until_sequence is null or valid_until_sequence > {AT - 1}))"


def _claims(t: Tables) -> DataFrame:
    return inference.rule_claims(t.edges, RULE, DEPTH)


def _claims_at(t: Tables, sequence: int) -> DataFrame:
    return inference.rule_claims(history.as_of(t["edge_versions"], sequence), RULE, DEPTH)


@query("i01_rule_claims", _rule_sql() + f" select {PL}, source, relation, target, claim_id, array_to_string(premises, ' ') premises from cl")
def i01(spark, d):
    return _claims(Tables(spark, d)).select(*PLACE, "source", "relation", "target", "claim_id", F.array_join("premises", " ").alias("premises"))


@query("i02_rule_set", _rule_sql(rules=(RULE, SECOND)) + f" select {PL}, rule_id, relation, count(*) claims, max(len(premises)) longest from cl group by all")
def i02(spark, d):
    claims = inference.evaluate_rules(Tables(spark, d).edges, [RULE, SECOND], DEPTH)
    return claims.groupBy(*PLACE, "rule_id", "relation").agg(F.count("*").alias("claims"), F.max(F.size("premises")).cast("bigint").alias("longest"))


@query("i03_discovered_claims", _rule_sql() + f", seeds as (select distinct {PL}, edge_id from ce where valid_from_sequence > 20), hit as (select distinct cl.claim_id from (select claim_id, {PL}, unnest(premises) edge_id from cl) cl join seeds using ({PL}, edge_id)) select {PL}, source, target, claim_id, array_to_string(premises, ' ') premises from cl where claim_id in (select claim_id from hit)")
def i03(spark, d):
    """Found from the changed edges backwards; the SQL derives all claims and filters."""
    t = Tables(spark, d)
    found = inference.discover_claims(t.edges, RULE, t.edges.where("valid_from_sequence > 20"), DEPTH)
    return found.select(*PLACE, "source", "target", "claim_id", F.array_join("premises", " ").alias("premises"))


@query("i05_verified_witnesses", _rule_sql() + f", v as (select unnest(['as_is', 'other_id', 'other_target', 'other_premise', 'short']) variant, unnest(['sound', 'identity', 'disconnected', 'premise', 'shape']) problem) select {PL}, variant, problem, count(*) claims from cl, v group by all")
def i05(spark, d):
    """Each claim as it is, and spoilt in four ways that the verification has to name."""
    t = Tables(spark, d)
    claims = _claims(t)
    none = F.array(F.lit("edg_none"))
    cut = F.slice("premises", 2, F.greatest(F.size("premises") - 1, F.lit(0)))
    last = F.slice("premises", F.size("premises") - 1, F.lit(2))
    spoilt = [
        ("as_is", claims), ("other_id", claims.withColumn("claim_id", F.concat("claim_id", F.lit("0")))), ("other_target", claims.withColumn("target", F.lit("nod_none"))),
        ("other_premise", claims.withColumn("premises", F.concat(none, cut))), ("short", claims.withColumn("premises", last)),
    ]
    out = None
    for variant, rows in spoilt:
        part = inference.verify_witnesses(rows, t.edges, RULE, DEPTH).select(*PLACE, F.lit(variant).alias("variant"), F.coalesce("problem", F.lit("sound")).alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*PLACE, "variant", "problem").agg(F.count("*").alias("claims"))


@query("i06_premise_dependencies", _rule_sql() + f", x as (select distinct {PL}, unnest(premises) premise, claim_id from cl) select {PL}, premise, count(*) claims from x group by all")
def i06(spark, d):
    return inference.dependencies(_claims(Tables(spark, d))).groupBy(*PLACE, "premise").agg(F.count("*").alias("claims"))


def _affected_sql(edges: str, changed: str) -> str:
    return (
        _rule_sql(edges) + f", x as (select distinct {PL}, claim_id, unnest(premises) edge_id from cl), c as (select distinct {PL}, edge_id from ev where {changed})"
        f" select {PL}, claim_id, string_agg(edge_id, ' ' order by edge_id) changed from x join c using ({PL}, edge_id) group by all"
    )


@query("i07_affected_explanations", _affected_sql(_BEFORE, f"valid_from_sequence = {AT} or valid_until_sequence = {AT}"))
def i07(spark, d):
    """Claims of the graph just before a sequence whose premises that sequence changed."""
    t = Tables(spark, d)
    out = inference.affected_claims(_claims_at(t, AT - 1), history.changed_at(t["edge_versions"], AT))
    return out.select(*PLACE, "claim_id", F.array_join("changed", " ").alias("changed"))


@query("i08_invalidations", _affected_sql(_THEN, f"valid_until_sequence > {AFTER} and valid_until_sequence <= {UNTIL}"))
def i08(spark, d):
    t = Tables(spark, d)
    out = inference.invalidations(_claims_at(t, AFTER), t["edge_versions"], AFTER, UNTIL)
    return out.select(*PLACE, "claim_id", F.array_join("changed", " ").alias("changed"))


@query("i09_invalidation_explanations", _rule_sql(_THEN) + f", x as (select distinct {PL}, claim_id, unnest(premises) premise from cl), c as (select distinct {PL}, edge_id premise, version_id, valid_until_sequence ended_sequence from ev where valid_until_sequence > {AFTER} and valid_until_sequence <= {UNTIL}) select {PL}, claim_id, premise, version_id, ended_sequence from x join c using ({PL}, premise)")
def i09(spark, d):
    t = Tables(spark, d)
    return inference.invalidation_explanations(_claims_at(t, AFTER), t["edge_versions"], AFTER, UNTIL)


def _lives_sql(versions: str) -> str:
    return (
        f", pr as (select distinct {PL}, claim_id, unnest(premises) edge_id from cl), lv as (select {PL}, edge_id, max((valid_from_sequence, coalesce(valid_until_sequence, 9223372036854775807))) v from {versions} group by {PL}, edge_id),"
        f" bo as (select {PL}, claim_id, max(v[1]) born, min(v[2]) closed from pr join lv using ({PL}, edge_id) group by all having min(v[2]) > max(v[1]))"
    )


@query("i15_claim_lifecycle", _rule_sql(_THEN) + _lives_sql(_THEN) + f" select {PL}, claim_id, born born_sequence, nullif(closed, 9223372036854775807) closed_sequence from bo")
def i15(spark, d):
    """When each claim of an earlier graph began to hold and when it ceased, by the versions that it rested on then."""
    t = Tables(spark, d)
    return inference.claim_versions(_claims_at(t, AFTER), history.as_of(t["edge_versions"], AFTER))


@query("i16_active_claims", _rule_sql() + _lives_sql("ev") + f" select {PL}, count(*) claims from bo where born <= 40 and closed > 40 group by {PL}")
def i16(spark, d):
    t = Tables(spark, d)
    v = inference.claim_versions(_claims(t), t["edge_versions"])
    return v.where("born_sequence <= 40 and (closed_sequence is null or closed_sequence > 40)").groupBy(*PLACE).agg(F.count("*").alias("claims"))


def _ontology_sql(name: str, at: str) -> str:
    return (
        f", n{name} as (select distinct {PL}, node_id, kind from nv where {at}), e{name} as (select distinct {PL}, source, target, relation from ev where {at}), i{name} as (select {PL}, max(relation) relation from e{name} group by {PL}),"
        f" k{name} as (select distinct {PL}, kind concept from n{name}), g{name} as (select distinct e.repository_id, e.worktree_id, relation, a.kind \"domain\", b.kind \"range\" from e{name} e"
        f" join n{name} a on a.repository_id = e.repository_id and a.worktree_id = e.worktree_id and a.node_id = e.source join n{name} b on b.repository_id = e.repository_id and b.worktree_id = e.worktree_id and b.node_id = e.target)"
    )


_KEPT = f"({PL}, relation) in (select {PL}, relation from gb)"


@query("i14_ontology_compatibility", BASE + _ontology_sql("a", _ASOF) + _ontology_sql("b", "valid_until_sequence is null") + f""",
issues as (select {PL}, 0 rk, relation as name, 'instance_relation' issue from (select * from ia except select * from ib)
  union all select {PL}, 1, concept, 'removed_concept' from (select * from ka except select * from kb)
  union all select {PL}, 2, relation, 'removed_relation' from (select {PL}, relation from ga except select {PL}, relation from gb)
  union all select {PL}, 3, relation, 'narrowed_domain' from (select {PL}, relation, "domain" from ga except select {PL}, relation, "domain" from gb) where {_KEPT}
  union all select {PL}, 4, relation, 'narrowed_range' from (select {PL}, relation, "range" from ga except select {PL}, relation, "range" from gb) where {_KEPT})
select {PL}, issue, name from (select *, row_number() over (partition by {PL} order by rk, name) rn from issues) where rn = 1""")
def i14(spark, d):
    """The kinds and relations of each worktree's graph at an earlier sequence against those of now."""
    t = Tables(spark, d)

    def ontology(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
        n = nodes.select(*PLACE, "node_id", "kind").distinct()
        e = edges.select(*PLACE, "source", "target", "relation").distinct()
        ends = e.join(n.withColumnsRenamed({"node_id": "source", "kind": "domain"}), [*PLACE, "source"]).join(n.withColumnsRenamed({"node_id": "target", "kind": "range"}), [*PLACE, "target"])
        return {"instances": e.groupBy(*PLACE).agg(F.max("relation").alias("relation")), "concepts": n.select(*PLACE, F.col("kind").alias("concept")).distinct(), "signatures": ends.select(*PLACE, "relation", "domain", "range").distinct()}

    then = ontology(history.as_of(t["node_versions"], AT), history.as_of(t["edge_versions"], AT))
    return inference.compatibility_issues(then, ontology(t.nodes, t.edges), PLACE)
