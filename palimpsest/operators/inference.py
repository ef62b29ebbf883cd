"""Rules, contracts, dependencies and ontologies. Missing evidence is never proof of absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.graph import simple_paths
from palimpsest.session import materialize

PLACE = ["repository_id", "worktree_id"]


def _claim_identity(rule: dict, source: Column, target: Column, premises: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(rule["id"]), F.lit(rule["version"]), *PLACE, source, target, F.array_join(premises, ",")), 256)


def _tails(edges: DataFrame, rule: dict) -> DataFrame:
    """(place, end, e1, x, e2, concept): the last two edges of the rule's witnesses."""
    e = edges.select(*PLACE, "edge_id", "source", "target", "relation").distinct()
    hop = e.where(F.col("relation") == rule["join_relation"]).select(*PLACE, F.col("source").alias("end"), F.col("target").alias("x"), F.col("edge_id").alias("e1"))
    declared = e.where(F.col("relation") == rule["declaration_relation"])
    if rule.get("concept") is not None:
        declared = declared.where(F.col("target") == rule["concept"])
    return hop.join(declared.select(*PLACE, F.col("source").alias("x"), F.col("target").alias("concept"), F.col("edge_id").alias("e2")), [*PLACE, "x"])


def _claims_of(paths: DataFrame, tails: DataFrame, rule: dict) -> DataFrame:
    claims = paths.join(tails, [*PLACE, "end"])
    premises = F.concat("edge_ids", F.array("e1", "e2"))
    identity = _claim_identity(rule, F.col("start"), F.col("x"), premises)
    return claims.select(
        *PLACE, F.lit(rule["id"]).alias("rule_id"), F.col("start").alias("source"), F.lit(rule["output_relation"]).alias("relation"),
        F.col("x").alias("target"), "concept", premises.alias("premises"), identity.alias("claim_id"),
    )


def rule_claims(edges: DataFrame, rule: dict, max_depth: int = 8) -> DataFrame:
    """Claims (place, source, relation, target, premises) of one rule, a row per witness.

    A witness is a simple path of one or more ``path_relation`` edges, then one ``join_relation`` edge to X, then a
    ``declaration_relation`` edge from X to the concept node; the claim is (start, output_relation, X). A path longer than
    ``max_depth`` is an error.
    """
    return _claims_of(simple_paths(edges, rule["path_relation"], max_depth), _tails(edges, rule), rule)


def discover_claims(edges: DataFrame, rule: dict, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """The claims of ``rule_claims`` one of whose premises is a seed edge (place, edge_id), without deriving the others.

    Paths are looked for only where, going backwards from the seeds and from the witnesses' last two edges, one can be in such a claim.
    """
    s = seeds.select(*PLACE, F.col("edge_id").alias("premise")).distinct().withColumn("hit", F.lit(True))
    tails = _tails(edges, rule)
    for e in ("e1", "e2"):
        tails = tails.join(s.withColumnsRenamed({"premise": e, "hit": f"hit_{e}"}), [*PLACE, e], "left")
    tails = materialize(tails.withColumn("seeded", F.coalesce("hit_e1", "hit_e2", F.lit(False))).drop("hit_e1", "hit_e2"), "tails")
    ends = tails.groupBy(*PLACE, F.col("end").alias("node_id")).agg(F.max("seeded").alias("seeded"))
    paths = simple_paths(edges, rule["path_relation"], max_depth, seeds, ends)
    # A path may meet an unseeded tail beside the seeded one that let it in.
    found = _claims_of(paths, tails, rule)
    return discovered_claims(found, seeds)


def verify_witnesses(claims: DataFrame, edges: DataFrame, rule: dict, max_depth: int = 8, premise_budget: int = 64) -> DataFrame:
    """Claims of a rule with ``problem``: null if the premises are a witness of the claim and the claim's id is theirs.

    Else the first of: metadata (of another rule, relation or concept), budget, shape (no path before the last two premises), depth,
    premise (not among the edges), disconnected (no simple path of the rule to the target and its declaration), identity.
    """
    claims = claims.withColumn("__row", F.struct(*claims.columns))
    shape = F.struct("source", "target", "relation")
    shapes = edges.groupBy(*PLACE, F.col("edge_id").alias("__premise")).agg(F.collect_set(shape).alias("__shapes"))
    # Only what the budget allows is looked up; the rows themselves are the group's key, since claim ids are what is in doubt.
    asked = claims.where(F.size("premises") <= premise_budget).select(*PLACE, "__row", F.posexplode("premises").alias("__i", "__premise"))
    steps = asked.join(shapes, [*PLACE, "__premise"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__i", "__shapes"))).alias("__steps"))
    rows = claims.distinct().join(steps, "__row", "left")
    size, steps = F.size("premises"), F.transform("__steps", lambda s: s["__shapes"])
    start = F.array(F.array(F.col("source").cast("string")))

    def onward(paths: Column, found: Column) -> Column:
        fits = lambda p: F.filter(
            found, lambda e: (e["source"] == F.element_at(p, -1)) & (e["relation"] == rule["path_relation"]) & ~F.array_contains(p, e["target"])
        )
        return F.flatten(F.transform(paths, lambda p: F.transform(fits(p), lambda e: F.concat(p, F.array(e["target"])))))

    ends = F.transform(F.aggregate(F.slice(steps, 1, F.greatest(size - 2, F.lit(0))), start, onward), lambda p: F.element_at(p, -1))
    joined = F.exists(
        F.try_element_at(steps, size - 1), lambda e: (e["relation"] == rule["join_relation"]) & (e["target"] == F.col("target")) & F.array_contains(ends, e["source"])
    )
    declared = F.exists(
        F.try_element_at(steps, size),
        lambda e: (e["relation"] == rule["declaration_relation"]) & (e["source"] == F.col("target")) & (e["target"] == F.col("concept")),
    )
    other = (F.col("rule_id") != rule["id"]) | (F.col("relation") != rule["output_relation"])
    if rule.get("concept") is not None:
        other = other | (F.col("concept") != rule["concept"])
    problem = (
        F.when(F.coalesce(other, F.lit(True)), "metadata")
        .when(size > premise_budget, "budget")
        .when(F.coalesce(size < 3, F.lit(True)), "shape")
        .when(size - 2 > max_depth, "depth")
        .when(F.coalesce(F.size("__steps"), F.lit(0)) < size, "premise")
        .when(~F.coalesce(joined & declared, F.lit(False)), "disconnected")
        .when(~F.col("claim_id").eqNullSafe(_claim_identity(rule, F.col("source"), F.col("target"), F.col("premises"))), "identity")
    )
    return rows.withColumn("problem", problem).drop("__row", "__steps")


def evaluate_rules(edges: DataFrame, rules: list[dict], max_depth: int = 8) -> DataFrame:
    """Claims of a rule set in order of (id, version). Rules that ask for different versions of an ontology are refused."""
    wanted: dict[str, str] = {}
    for rule in rules:
        for name, version in rule.get("ontology_versions", {}).items():
            if wanted.setdefault(name, version) != version:
                raise ValueError(f"rules disagree on the version of {name}")
    out = None
    for rule in sorted(rules, key=lambda r: (r["id"], r["version"])):
        part = rule_claims(edges, rule, max_depth)
        out = part if out is None else out.unionByName(part)
    return out


def discovered_claims(claims: DataFrame, seeds: DataFrame) -> DataFrame:
    """Claims one of whose premises is a seed edge (place, edge_id)."""
    s = seeds.select(*PLACE, F.col("edge_id").alias("premise")).distinct()
    hit = dependencies(claims).join(s, [*PLACE, "premise"], "left_semi").select(*PLACE, "claim_id").distinct()
    return claims.join(hit, [*PLACE, "claim_id"], "left_semi")


def dependencies(claims: DataFrame) -> DataFrame:
    """(place, premise, claim_id): which claims rest on which edge."""
    return claims.select(*PLACE, "claim_id", F.explode("premises").alias("premise")).distinct()


def affected_claims(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Claims with a changed premise (place, edge_id), and which premises those are."""
    c = changed.select(*PLACE, F.col("edge_id").alias("premise")).distinct()
    return dependencies(claims).join(c, [*PLACE, "premise"]).groupBy(*PLACE, "claim_id").agg(F.array_sort(F.collect_set("premise")).alias("changed"))


def invalidations(claims: DataFrame, versions: DataFrame, after: int, until: int) -> DataFrame:
    """Claims with a premise whose version ended in (after, until]."""
    return affected_claims(claims, _ended(versions, after, until))


def _ended(versions: DataFrame, after: int, until: int) -> DataFrame:
    return versions.where((F.col("valid_until_sequence") > after) & (F.col("valid_until_sequence") <= until))


def invalidation_explanations(claims: DataFrame, versions: DataFrame, after: int, until: int) -> DataFrame:
    """(place, claim_id, premise, version_id, ended_sequence): each version whose end in (after, until] invalidates a claim."""
    ended = _ended(versions, after, until).select(*PLACE, F.col("edge_id").alias("premise"), "version_id", F.col("valid_until_sequence").alias("ended_sequence"))
    return dependencies(claims).join(ended.distinct(), [*PLACE, "premise"])


def claim_versions(claims: DataFrame, edge_versions: DataFrame) -> DataFrame:
    """(place, claim_id, born_sequence, closed_sequence): a claim lives while the versions of all its premises do."""
    v = edge_versions.select(*PLACE, F.col("edge_id").alias("premise"), "valid_from_sequence", "valid_until_sequence").distinct()
    open_ = F.coalesce("valid_until_sequence", F.lit(2**63 - 1))
    life = v.groupBy(*PLACE, "premise").agg(F.max(F.struct("valid_from_sequence", open_.alias("u"))).alias("v"))
    return (
        dependencies(claims)
        .join(life, [*PLACE, "premise"])
        .groupBy(*PLACE, "claim_id")
        .agg(F.max("v.valid_from_sequence").alias("born_sequence"), F.min("v.u").alias("u"))
        .select(*PLACE, "claim_id", "born_sequence", F.when(F.col("u") < 2**63 - 1, F.col("u")).alias("closed_sequence"))
        .where(F.col("closed_sequence").isNull() | (F.col("closed_sequence") > F.col("born_sequence")))
    )


def evaluate_contracts(contracts: DataFrame, edges: DataFrame) -> DataFrame:
    """Contracts (place, contract_id, source, target, relation, expectation) with outcome and evidence (the least edge id).

    Evidence supports a required contract and contradicts a forbidden one; without evidence it stays undecided.
    """
    found = edges.groupBy(*PLACE, "source", "target", "relation").agg(F.min("edge_id").alias("evidence"))
    outcome = (
        F.when(F.col("evidence").isNull(), "InsufficientEvidence")
        .when(F.col("expectation") == "required", "Supported")
        .otherwise("Contradicted")
    )
    return contracts.join(found, [*PLACE, "source", "target", "relation"], "left").withColumn("outcome", outcome)


def contract_gate(evaluated: DataFrame) -> DataFrame:
    """Whether each place passes: no contract of it is contradicted."""
    return evaluated.groupBy(*PLACE).agg(
        (F.sum(F.when(F.col("outcome") == "Contradicted", 1).otherwise(0)) == 0).alias("passes"), F.count("*").alias("contracts")
    )


def episodes(evaluations: DataFrame) -> DataFrame:
    """Runs of equal outcome per contract over the retained evaluations of its place.

    evaluations: (place, sequence, contract_id, outcome). A retained sequence that omits a contract ends its run there, and a
    different outcome ends a run where the next begins; the last run is open.
    """
    sets = evaluations.select(*PLACE, "sequence").distinct()
    sets = sets.withColumn("next", F.lead("sequence").over(Window.partitionBy(*PLACE).orderBy("sequence")))
    by = Window.partitionBy(*PLACE, "contract_id").orderBy("sequence")
    rows = evaluations.select(*PLACE, "sequence", "contract_id", "outcome").distinct().join(sets, [*PLACE, "sequence"])
    goes_on = (F.lag("next").over(by) == F.col("sequence")) & (F.lag("outcome").over(by) == F.col("outcome"))
    rows = rows.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(by))
    return (
        rows.groupBy(*PLACE, "contract_id", "run", "outcome")
        .agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.max(F.struct("sequence", "next")).alias("m"))
        .select(*PLACE, "contract_id", "outcome", "first_sequence", "last_sequence", F.col("m.next").alias("ended_sequence"))
    )


def outcome_as_of(runs: DataFrame, sequence: int) -> DataFrame:
    """The episode of each contract that holds at a sequence."""
    return runs.where((F.col("first_sequence") <= sequence) & (F.col("ended_sequence").isNull() | (F.col("ended_sequence") > sequence)))


def latest_evaluations(evaluations: DataFrame, sequence: int) -> DataFrame:
    """The last retained set of each place at or before a sequence."""
    upto = evaluations.where(F.col("sequence") <= sequence)
    last = upto.groupBy(*PLACE).agg(F.max("sequence").alias("sequence"))
    return upto.join(last, [*PLACE, "sequence"], "left_semi")


def ontology_violations(claims: DataFrame, memberships: DataFrame, signatures: DataFrame) -> DataFrame:
    """Claims whose source or target is outside the domain or range of their relation.

    memberships: (place, node_id, concept); signatures: (relation, domain, range), a handful of rows.
    """
    m = memberships.select(*PLACE, "node_id", "concept").distinct()
    c = claims.join(signatures, "relation")
    out = None
    for end, of in (("source", "domain"), ("target", "range")):
        inside = m.withColumnsRenamed({"node_id": end, "concept": of})
        part = c.join(inside, [*PLACE, end, of], "left_anti").select(*PLACE, "claim_id", F.lit(of).alias("violates"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def compatibility_issues(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, issue, name): per ontology the first incompatibility of its new version, ontologies without one left out.

    An ontology version is ``instances`` (keys, relation), one row each; ``concepts`` (keys, concept); ``signatures`` (keys, relation, domain, range),
    a relation's domains and ranges being those of its rows. Issues in order: another instance relation, a removed concept, a removed relation, a
    narrowed domain, a narrowed range; the least name of the first kind. An old ontology that is not among the new ones has no instance relation.
    """
    def lost(part: str, *columns: str) -> DataFrame:
        a, b = (side[part].select(*keys, *columns).distinct() for side in (old, new))
        return a.join(b, [*keys, *columns], "left_anti")

    kept = new["signatures"].select(*keys, "relation").distinct()
    parts = [
        ("instance_relation", lost("instances", "relation"), "relation"), ("removed_concept", lost("concepts", "concept"), "concept"),
        ("removed_relation", lost("signatures", "relation"), "relation"),
        ("narrowed_domain", lost("signatures", "relation", "domain").join(kept, [*keys, "relation"], "left_semi"), "relation"),
        ("narrowed_range", lost("signatures", "relation", "range").join(kept, [*keys, "relation"], "left_semi"), "relation"),
    ]
    out = None
    for i, (issue, rows, name) in enumerate(parts):
        part = rows.select(*keys, F.struct(F.lit(i).alias("at"), F.col(name).alias("name"), F.lit(issue).alias("issue")).alias("i"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(F.min("i").alias("i")).select(*keys, "i.issue", "i.name")


def compatibility_issue(old: dict, new: dict) -> tuple[str, str] | None:
    """The first incompatibility of two ontology versions: {instance_relation, concepts, relations: {name: (domains, ranges)}}."""
    if old["instance_relation"] != new["instance_relation"]:
        return "instance_relation", old["instance_relation"]
    for concept in sorted(set(old["concepts"]) - set(new["concepts"])):
        return "removed_concept", concept
    for name in sorted(set(old["relations"]) - set(new["relations"])):
        return "removed_relation", name
    for i, issue in enumerate(("narrowed_domain", "narrowed_range")):
        for name in sorted(old["relations"]):
            if set(old["relations"][name][i]) - set(new["relations"][name][i]):
                return issue, name
    return None


def document_claims(claims: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): statements drawn from documents, as concept and claim records with the place of their quote.

    claims: (doc_id, subject, relation, object, quote); documents: (doc_id, text). A statement is accepted if it is whole and its
    quote stands in the text, word for word; its evidence is the first such place, in UTF-8 bytes. Accepted rows have the ids of both
    concepts and of the claim, digests of their content, so that a repeated statement is one claim. Rejected rows have a reason.
    """
    whole = F.forall(F.array(*[F.coalesce(F.col(c), F.lit("")) != "" for c in ("subject", "relation", "object", "quote")]), lambda x: x)
    rows = claims.select("doc_id", "subject", "relation", "object", "quote").distinct().join(documents.select("doc_id", "text"), "doc_id", "left")
    at = F.instr("text", F.col("quote"))
    reason = F.when(~whole, "incomplete").when(F.col("text").isNull(), "document").when(at == 0, "quote")
    judged = rows.withColumn("reason", reason)
    start = F.octet_length(F.substring(F.col("text"), F.lit(1), at - 1)).cast("bigint")
    concept = lambda c: F.sha2(F.concat_ws("|", F.lit("concept"), c), 256)
    accepted = judged.where(F.col("reason").isNull()).select(
        "doc_id", "subject", "relation", "object", concept("subject").alias("subject_id"), concept("object").alias("object_id"),
        F.sha2(F.concat_ws("|", F.lit("claim"), F.col("doc_id").cast("string"), "subject", "relation", "object"), 256).alias("claim_id"),
        start.alias("start_byte"), (start + F.octet_length("quote")).alias("end_byte"),
    )
    return accepted, judged.where(F.col("reason").isNotNull()).drop("text")
