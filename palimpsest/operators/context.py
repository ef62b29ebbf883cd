"""Context for a text request: seeds, expansion, candidates and packing under a token budget.

Seeds and candidates are chosen per place by ranks with a limit, so that what is packed is bounded; only packing, which
is sequential, runs in Python, on one bounded group per place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import REFERENCE, lexical_family, source_role
from palimpsest.operators.graph import reach
from palimpsest.operators.lexical import pack

PLACE = ["repository_id", "worktree_id"]
#: Candidate kinds in the order of packing.
KINDS = ["source_evidence", "signature", "graph_path", "summary"]
FAMILY_ORDER = ["Code", "Documentation", "Reference", "Other"]
#: Sources of other kinds are local and come first, then mere occurrences, then whole containers.
OCCURRENCES = [*REFERENCE, "ModuleResolutionDiagnostic"]
CONTAINERS = ["File", "Module", "Script", "Document"]


def query_terms(text: str, least: int = 2, most: int = 16) -> list[str]:
    """The first sorted distinct lower-case words of a request."""
    words = set("".join(c if c.isalnum() else " " for c in text).lower().split())
    return sorted(w for w in words if len(w) >= least)[:most]


def lexical_seeds(nodes: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(place, node_id, relevance, rank): nodes whose name holds most terms; all terms in a Function's name count one more."""
    hits = [F.contains(F.lower("name"), F.lit(t)).cast("int") for t in terms]
    matched = sum(hits[1:], hits[0])
    rows = nodes.withColumn("matched", F.coalesce(matched, F.lit(0))).where("matched > 0")
    bonus = F.when((F.col("matched") == len(terms)) & (F.col("kind") == "Function"), 1).otherwise(0)
    scored = rows.groupBy(*PLACE, "node_id").agg(F.max(F.col("matched") + bonus).cast("bigint").alias("relevance"))
    by = Window.partitionBy(*PLACE).orderBy(F.desc("relevance"), "node_id")
    return scored.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= k)


def seed_plan(ranked: DataFrame, nodes: DataFrame, k: int = 32) -> DataFrame:
    """(place, node_id, family, turn, rank): one node of each family in turn. Families are disjoint, so the ranks within them decide."""
    family = nodes.groupBy(*PLACE, "node_id").agg(F.min(lexical_family(F.col("kind"))).alias("family"))
    rows = ranked.join(family, [*PLACE, "node_id"])
    turn = F.row_number().over(Window.partitionBy(*PLACE, "family").orderBy(F.desc("score"), "node_id"))
    place = F.array_position(F.array(*[F.lit(f) for f in FAMILY_ORDER]), F.col("family"))
    order = Window.partitionBy(*PLACE).orderBy("turn", "__f")
    return (
        rows.withColumn("turn", turn.cast("bigint"))
        .where(F.col("turn") <= k)
        .withColumn("__f", place)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
        .select(*PLACE, "node_id", "family", "turn", "rank")
    )


def preferred(plan: DataFrame, originals: DataFrame, nodes: DataFrame, tests: str | None = None, lexical_first: bool = False) -> DataFrame:
    """A plan (place, node_id, rank) in a preferred order, its own order kept otherwise.

    tests: None, ``first`` or ``last`` says where nodes of test intent go; ``lexical_first`` puts the original lexical hits before all else.
    """
    role = nodes.groupBy(*PLACE, "node_id").agg(F.max(F.coalesce(source_role(F.col("kind")) == "TestIntent", F.lit(False))).alias("__test"))
    first = originals.select(*PLACE, "node_id").distinct().withColumn("__original", F.lit(True))
    rows = plan.join(role, [*PLACE, "node_id"], "left").join(first, [*PLACE, "node_id"], "left")
    test, original = F.coalesce("__test", F.lit(False)), F.coalesce("__original", F.lit(False))
    keys = ([~original] if lexical_first else []) + ([~test] if tests == "first" else [test] if tests == "last" else []) + [F.col("rank")]
    by = Window.partitionBy(*PLACE).orderBy(*keys, "node_id")
    return rows.select(*PLACE, "node_id", F.row_number().over(by).cast("bigint").alias("place"))


def selection_report(seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """(place, seeds, nodes, deepest): what a request would take into a context, without packing it."""
    s = seeds.groupBy(*PLACE).agg(F.count("*").alias("seeds"))
    n = expanded.groupBy(*PLACE).agg(F.count("*").alias("nodes"), F.max("depth").cast("bigint").alias("deepest"))
    return s.join(n, PLACE)


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(place, node_id, depth): the seeds' undirected neighbourhood."""
    return reach(edges, seeds, hops, "both")


def section_relevance(near: DataFrame, edges: DataFrame) -> DataFrame:
    """``near`` with the relevance of a Section raised to the greatest of the DocumentChunks in ``near`` that it directly contains."""
    chunks = near.where("kind = 'DocumentChunk'").select(*PLACE, F.col("node_id").alias("target"), F.col("relevance").alias("inherited"))
    contains = edges.where("relation = 'Contains'").select(*PLACE, F.col("source").alias("node_id"), "target")
    best = contains.join(chunks, [*PLACE, "target"]).groupBy(*PLACE, "node_id").agg(F.max("inherited").alias("inherited"))
    raised = F.when(F.col("kind") == "Section", F.greatest("relevance", "inherited")).otherwise(F.col("relevance"))
    return near.join(best, [*PLACE, "node_id"], "left").withColumn("relevance", raised).drop("inherited")


def candidates(seeds: DataFrame, expanded: DataFrame, nodes: DataFrame, edges: DataFrame, texts: DataFrame, most: int = 256) -> DataFrame:
    """(place, kind, key, text, node_ids, relevance, distance, position): at most ``most`` per place, in packing order.

    texts: (place, file_id, text) of current files. Kinds come in KINDS order, then relevance, distance, granularity, key and text (an edge may be there twice with other ends).
    A section counts as relevant as the most relevant chunk in it.
    """
    n = nodes.groupBy(*PLACE, "node_id").agg(F.min(F.struct("kind", "name", "owner_file")).alias("n"))
    near = (
        expanded.join(seeds.select(*PLACE, "node_id", "relevance"), [*PLACE, "node_id"], "left")
        .join(n, [*PLACE, "node_id"])
        .select(*PLACE, "node_id", "depth", F.coalesce("relevance", F.lit(0)).alias("relevance"), "n.*")
    )
    near = section_relevance(near, edges)

    def shaped(rows: DataFrame, kind: int, key: Column, text: Column, granularity: Column | None = None) -> DataFrame:
        return rows.select(
            *PLACE, F.lit(kind).alias("order"), (F.lit(0) if granularity is None else granularity).alias("granularity"), key.alias("key"), text.alias("text"), F.array("node_id").alias("node_ids"),
            F.col("relevance").cast("bigint").alias("relevance"), F.col("depth").cast("bigint").alias("distance"),
        )

    source = near.join(texts.withColumnRenamed("file_id", "owner_file"), [*PLACE, "owner_file"])
    coarse = F.when(F.col("kind").isin(OCCURRENCES), 1).when(F.col("kind").isin(CONTAINERS), 2).otherwise(0)
    signature = F.concat_ws(" ", "kind", F.coalesce("name", F.lit("")))
    ends = edges.groupBy(*PLACE, F.col("source").alias("node_id"), "target").agg(F.min("relation").alias("relation"), F.min("edge_id").alias("edge_id"))
    path = ends.join(near, [*PLACE, "node_id"]).join(expanded.select(*PLACE, F.col("node_id").alias("target")), [*PLACE, "target"], "left_semi")
    totals = near.groupBy(*PLACE).agg(F.count("*").alias("nodes"), F.min("node_id").alias("node_id"), F.max("relevance").alias("relevance"), F.lit(0).alias("depth"))
    all_ = (
        shaped(source, 0, F.col("node_id"), F.col("text"), coarse)
        .unionByName(shaped(near, 1, F.col("node_id"), signature))
        .unionByName(shaped(path, 2, F.col("edge_id"), F.concat_ws(" ", "node_id", "relation", "target")))
        .unionByName(shaped(totals, 3, F.lit("total"), F.concat(F.col("nodes").cast("string"), F.lit(" nodes"))))
    )
    by = Window.partitionBy(*PLACE).orderBy("order", F.desc("relevance"), "distance", "granularity", "key", "text")
    kinds = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("order") + 1)
    return (
        all_.withColumn("position", F.row_number().over(by).cast("bigint")).where(F.col("position") <= most).withColumn("kind", kinds).drop("order", "granularity")
    )


def packed(found: DataFrame, budget: int, terms: list[str]) -> DataFrame:
    """(place, rank, kind, text, node_ids, tokens): what is packed of each place's candidates, under a budget of UTF-8 bytes."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        got = pack([{"kind": r.kind, "text": r.text, "node_ids": list(r.node_ids)} for r in rows.itertuples()], budget, set(terms))
        place = [rows[c].iloc[0] for c in PLACE]
        out = [(*place, i["rank"], i["kind"], i["text"], " ".join(i["node_ids"]), len(i["text"].encode())) for i in got["items"]]
        return pd.DataFrame(out, columns=[*PLACE, "rank", "kind", "text", "node_ids", "tokens"])

    return found.groupBy(*PLACE).applyInPandas(one, "repository_id string, worktree_id string, rank bigint, kind string, text string, node_ids string, tokens bigint")
