"""Graph operators over edges (place, edge_id, source, target, relation) and nodes (place, node_id).

Searches go level by level: a frontier is joined to the edges, what was seen before is anti-joined away, and each
level is written to the shared folder, which ends its lineage. A level's work is that of its edges; nothing
is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import delete, discard, materialize, scratch_path

PLACE = ["repository_id", "worktree_id"]


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing neighbours; edges without a target node drop out, as in the current graph."""
    n = nodes.select(*PLACE, F.col("node_id").alias("target"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"))
    return edges.join(n, [*PLACE, "target"])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node: an integrity error where history is read."""
    n = nodes.select(*PLACE, "node_id").distinct()
    missing = None
    for end in ("source", "target"):
        part = edges.join(n.withColumnRenamed("node_id", end), [*PLACE, end], "left_anti").select(*PLACE, "edge_id", F.lit(end).alias("field"))
        missing = part if missing is None else missing.unionByName(part)
    return missing


def incident(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Edges that touch an endpoint (place, node_id): two equi-joins and a union instead of one join on either end."""
    e = endpoints.select(*PLACE, "node_id").distinct()
    out = edges.join(e.withColumnRenamed("node_id", "source"), [*PLACE, "source"], "left_semi")
    into = edges.join(e.withColumnRenamed("node_id", "target"), [*PLACE, "target"], "left_semi")
    return out.unionByName(into).distinct()


def with_relations(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    """Edges of some relations; None is all of them, an empty list none."""
    return edges if relations is None else edges.where(F.col("relation").isin(relations)) if relations else edges.where("false")


def adjacency(edges: DataFrame) -> DataFrame:
    """(place, node_id, direction, other, edge_id): each edge from both of its ends, a loop from both directions too; rows are distinct."""
    out = edges.select(*PLACE, F.col("source").alias("node_id"), F.lit("out").alias("direction"), F.col("target").alias("other"), "edge_id")
    into = edges.select(*PLACE, F.col("target").alias("node_id"), F.lit("in").alias("direction"), F.col("source").alias("other"), "edge_id")
    return out.unionByName(into).distinct()


class IncidenceIndex:
    """The edges of each endpoint, written once in buckets by endpoint and in order of edge id.

    Lookups join by endpoint without moving the index. Rows with a null place or endpoint are not indexed.
    """

    KEY = [*PLACE, "node_id"]

    def __init__(self, edges: DataFrame, width: int | None = None):
        self.spark = edges.sparkSession
        rows = adjacency(edges).where(F.forall(F.array(*[F.col(k).isNotNull() for k in self.KEY]), lambda x: x))
        self.width = width = width or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.name = scratch_path(self.spark, "incidence"), f"palimpsest_{uuid.uuid4().hex}"
        out = rows.repartition(width, *self.KEY).write.format("parquet").bucketBy(width, *self.KEY).sortBy(*self.KEY, "edge_id")
        out.option("path", self.path).saveAsTable(self.name)

    def edges(self, endpoints: DataFrame) -> DataFrame:
        """The indexed rows of some endpoints (place, node_id).

        The endpoints are brought to the index's own buckets: left to itself the planner moves both sides wherever a session has more
        shuffle partitions than the index has buckets.
        """
        asked = endpoints.select(*self.KEY).distinct().repartition(self.width, *self.KEY)
        return self.spark.table(self.name).join(asked, self.KEY, "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        delete(self.spark, self.path)


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int, direction: str = "out") -> DataFrame:
    """(place, node_id, depth): nodes within ``max_hops`` of the seeds (place, node_id), seeds at depth 0.

    direction: out follows edges, in goes against them, both ignores their direction.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    step = edges.select(*PLACE, F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(*PLACE, F.col("target").alias("a"), F.col("source").alias("b"))
    step = {"out": step, "in": back, "both": step.unionByName(back)}[direction].distinct()
    step = materialize(step, "steps")
    seen = materialize(seeds.select(*PLACE, "node_id").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier = seen
    for depth in range(1, max_hops + 1):
        found = (
            frontier.join(step, (F.col("node_id") == F.col("a")) & (frontier["repository_id"] == step["repository_id"]) & (frontier["worktree_id"] == step["worktree_id"]))
            .select(frontier["repository_id"], frontier["worktree_id"], F.col("b").alias("node_id"))
            .distinct()
            .join(seen.select(*PLACE, "node_id"), [*PLACE, "node_id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = materialize(found, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    discard(step)
    return seen


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(place, node_id, hops, path): to each node in reach of its worktree's seed the shortest path, by edge ids.

    Of several shortest paths the one with the least sequence of edge ids. Every level keeps one path per node.
    """
    e = materialize(edges.select(*PLACE, "edge_id", F.col("source").alias("node_id"), "target").distinct(), "edges")
    start = seeds.select(*PLACE, "node_id").distinct().withColumn("hops", F.lit(0)).withColumn("path", F.array().cast("array<string>"))
    seen = materialize(start, "paths")
    frontier = seen
    for hop in range(1, max_hops + 1):
        found = (
            frontier.join(e, [*PLACE, "node_id"])
            .select(*PLACE, F.col("target").alias("node_id"), F.lit(hop).alias("hops"), F.concat("path", F.array("edge_id")).alias("path"))
            .groupBy(*PLACE, "node_id", "hops")
            .agg(F.min("path").alias("path"))
            .join(seen.select(*PLACE, "node_id"), [*PLACE, "node_id"], "left_anti")
        )
        frontier = materialize(found, "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    discard(e)
    return seen


def neighborhood_edges(edges: DataFrame, reached: DataFrame, max_hops: int) -> DataFrame:
    """Edges seen while the neighbourhood grew: one end nearer than ``max_hops``; depth is that of the nearer end plus one."""
    r = reached.select(*PLACE, "node_id", "depth")
    s, t = r.withColumnsRenamed({"node_id": "source", "depth": "ds"}), r.withColumnsRenamed({"node_id": "target", "depth": "dt"})
    near = F.least("ds", "dt")
    return (
        edges.join(s, [*PLACE, "source"]).join(t, [*PLACE, "target"]).where(near < max_hops).withColumn("depth", near + 1).drop("ds", "dt")
    )


def within_bytes(lines: DataFrame, order: list[str], budget: int) -> DataFrame:
    """Lines with ``bytes`` up to each in their place, whether the byte budget keeps it, and per place how many it omits.

    All lines come out; the kept ones are the answer under the budget, and ``truncated`` says that it is not the whole.
    """
    rows = lines.withColumn("bytes", F.sum(F.octet_length("line")).over(Window.partitionBy(*PLACE).orderBy(*order)))
    rows = rows.withColumn("kept", F.col("bytes") <= budget)
    omitted = F.sum((~F.col("kept")).cast("bigint")).over(Window.partitionBy(*PLACE))
    return rows.withColumn("omitted", omitted).withColumn("truncated", F.col("omitted") > 0)


def induced_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges between two reached nodes."""
    r = reached.select(*PLACE, "node_id")
    return edges.join(r.withColumnRenamed("node_id", "source"), [*PLACE, "source"], "left_semi").join(
        r.withColumnRenamed("node_id", "target"), [*PLACE, "target"], "left_semi"
    )


def simple_paths(edges: DataFrame, relation: str, max_depth: int, seeds: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(place, start, end, nodes, edge_ids) of every path of 1..max_depth edges of a relation without a repeated node.

    A path that could go on past ``max_depth`` is an error, never a silent cut.

    With ``ends`` (place, node_id, seeded) only paths that end at one of these, and of them only those over an edge of ``seeds`` (place,
    edge_id) or to a seeded end. Paths grow only where they can still become such a one, by the nodes found
    backwards from the ends and seeds.
    """
    step = edges.where(F.col("relation") == relation).select(*PLACE, F.col("edge_id").alias("e"), F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    marks = None
    if ends is None:
        step = step.withColumn("seed", F.lit(False))
    else:
        seeded = seeds.select(*PLACE, F.col("edge_id").alias("e")).distinct().withColumn("seed", F.lit(True))
        step = step.join(seeded, [*PLACE, "e"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    step = materialize(step, "steps")
    if ends is not None:
        back = step.select(*PLACE, F.col("s").alias("source"), F.col("t").alias("target"))
        # Nodes from which some end can be reached, and those from which an end can be reached by way of a seed.
        some = reach(back, ends, max_depth, "in").select(*PLACE, "node_id")
        by_seed = step.where("seed").join(some.withColumnRenamed("node_id", "t"), [*PLACE, "t"], "left_semi").select(*PLACE, F.col("s").alias("node_id"))
        wanted = reach(back, by_seed.unionByName(ends.where("seeded").select(*PLACE, "node_id")), max_depth, "in").select(*PLACE, "node_id")
        some, wanted = some.distinct().withColumn("some", F.lit(True)), wanted.distinct().withColumn("wanted", F.lit(True))
        marks = materialize(some.join(wanted, [*PLACE, "node_id"], "full_outer").withColumnRenamed("node_id", "end"), "marks")

    def alive(level: DataFrame) -> DataFrame:
        if marks is None:
            return level
        return level.join(marks, [*PLACE, "end"]).where((F.col("seed") & F.col("some")) | F.col("wanted")).drop("some", "wanted")

    level = alive(step.where("s <> t").select(
        *PLACE, F.col("s").alias("start"), F.col("t").alias("end"), F.array("s", "t").alias("nodes"), F.array("e").alias("edge_ids"), "seed"
    ))
    out = None
    for depth in range(1, max_depth + 2):
        level = materialize(level, "paths")
        if level.isEmpty():
            break
        if depth > max_depth:
            raise RuntimeError(f"a path of {relation} is longer than {max_depth}")
        out = level if out is None else out.unionByName(level)
        level = alive(
            level.join(step.withColumnsRenamed({"s": "end", "seed": "more"}), [*PLACE, "end"])
            .where(~F.array_contains("nodes", F.col("t")))
            .select(
                *PLACE, "start", F.col("t").alias("end"), F.concat("nodes", F.array("t")).alias("nodes"),
                F.concat("edge_ids", F.array("e")).alias("edge_ids"), (F.col("seed") | F.col("more")).alias("seed"),
            )
        )
    out = out if out is not None else level
    discard(step)
    discard(marks)
    if ends is not None:
        at = ends.groupBy(*PLACE, F.col("node_id").alias("end")).agg(F.max("seeded").alias("seeded"))
        out = out.join(at, [*PLACE, "end"]).where("seed or seeded")
    return out.select(*PLACE, "start", "end", "nodes", "edge_ids")


#: Steps along edges that one job takes.
STRIDE = 8


def _numbered(nodes: DataFrame, key: list[str]) -> DataFrame:
    """``nodes`` with ``h``, a number of its own for each: a hash whose seed is changed until no two nodes share one."""
    for seed in range(64):
        numbered = materialize(nodes.select("*", F.xxhash64(F.lit(seed), *key).alias("h")), "numbers")
        if numbered.groupBy("h").count().where("count > 1").isEmpty():
            return numbered
        discard(numbered)
    raise RuntimeError("no seed gives every node a number of its own")


def _walked(edges: DataFrame, into: str, out: str) -> DataFrame:
    """(n): nodes at which a walk of ``STRIDE`` edges into -> out ends."""
    at = edges.select(F.col(out).alias("n")).distinct()
    for _ in range(STRIDE - 1):
        at = edges.join(at, edges[into] == at["n"], "left_semi").select(F.col(out).alias("n")).distinct()
    return at


def _trimmed(rest: DataFrame) -> DataFrame:
    """Edges between nodes that a long walk enters and a long walk leaves: others lie on no cycle."""
    before, after = _walked(rest, "s", "t").withColumnRenamed("n", "s"), _walked(rest, "t", "s").withColumnRenamed("n", "t")
    kept = materialize(rest.join(before, "s", "left_semi").join(after, "t", "left_semi").select("s", "t"), "scc")
    discard(rest)
    return kept


def _least(edges: DataFrame, into: str, out: str) -> DataFrame:
    """(n, c): for each node of the edges the least number among itself and those that reach it along into -> out.

    A job passes the labels ``STRIDE`` edges on; rounds go on until none changes. An edge from each node to itself keeps its own label,
    so that a step needs the labels before it once only.
    """
    ends = edges.select(F.col(into).alias("n")).unionByName(edges.select(F.col(out).alias("n"))).distinct()
    label = materialize(ends.select("n", F.col("n").alias("c")), "labels")
    onward = materialize(edges.select(F.col(into).alias("n"), F.col(out).alias("to")).unionByName(label.select("n", F.col("n").alias("to"))), "onward")
    own = F.min(F.when(F.col("n") == F.col("to"), F.col("c")))
    while True:
        new = label
        for _ in range(STRIDE):
            new = onward.join(new.select("n", "c"), "n").groupBy("to").agg(F.min("c").alias("c"), (F.min("c") < own).alias("moved")).withColumnRenamed("to", "n")
        new = materialize(new, "labels")
        discard(label)
        label = new
        if new.where("moved").isEmpty():
            discard(onward)
            return new


def cyclic_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(place, node_id, component): members of strongly connected components with two members or a loop.

    Nodes get numbers, which are hashes, so that no order of ids makes the rounds many. A round trims nodes that no long walk
    enters or none leaves, gives each node the least number that reaches it, and within the nodes of one such number the least that
    it reaches. Where both are the same, the node is in the component of that one. Components lie within nodes that agree in both, so
    all other edges go, and the rest goes on. There is one way for graphs of every size, every step is a join or a
    grouping by node, and no task holds a place's graph.
    """
    loops = edges.where("source = target").select(*PLACE, F.col("source").alias("node_id")).distinct().withColumn("component", F.col("node_id"))
    ends = edges.where("source <> target").select(*PLACE, F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    key = [*PLACE, "node_id"]
    nodes = ends.select(*PLACE, F.col("s").alias("node_id")).intersect(ends.select(*PLACE, F.col("t").alias("node_id")))
    nodes = _numbered(nodes, key)
    side = lambda c: nodes.select(*PLACE, F.col("node_id").alias(c), F.col("h").alias(f"h{c}"))
    rest = materialize(ends.join(side("s"), [*PLACE, "s"]).join(side("t"), [*PLACE, "t"]).select(F.col("hs").alias("s"), F.col("ht").alias("t")), "scc")
    done, label = None, lambda df, c, at: df.select(F.col("n").alias(at), F.col("c").alias(c))
    for _ in range(max_rounds):
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        fore = _least(rest, "s", "t")
        inner = rest.join(label(fore, "cs", "s"), "s").join(label(fore, "ct", "t"), "t").where("cs = ct").select("s", "t", F.col("cs").alias("c"))
        inner = materialize(inner, "inner")
        discard(rest)
        back = _least(inner, "t", "s")
        whole = inner.join(label(back, "bs", "s"), "s").join(label(back, "bt", "t"), "t").where("bs = bt")
        whole = materialize(whole.select("s", "t", "c", F.col("bs").alias("b")), "whole")
        for x in (fore, inner, back):
            discard(x)
        # An edge with both ends in one component is there for each member of a component of two or more.
        found = materialize(whole.where("b = c").select(F.col("s").alias("h"), F.col("c").alias("root")).distinct(), "members")
        done = found if done is None else done.unionByName(found)
        rest = materialize(whole.where("b <> c").select("s", "t"), "scc")
        discard(whole)
    else:
        raise RuntimeError("components did not settle")
    discard(rest)
    if done is None:
        return loops
    members = done.join(nodes, "h").select(*key, "root")
    named = members.groupBy("root").agg(F.min("node_id").alias("component"))
    members = materialize(members.join(named, "root").select(*key, "component"), "components")
    discard(nodes)
    alone = loops.join(members.select(*key), key, "left_anti")
    return members.unionByName(alone.select(*key, "component"))


def time_respecting_trace(edges: DataFrame, seeds: DataFrame, from_sequence: int, until_sequence: int, max_hops: int) -> DataFrame:
    """(place, node_id, arrival, depth): states reached by following edges forward in time.

    Over an edge one arrives at the later of the present arrival and the edge's start, which must be at most
    ``until_sequence`` and before the edge's end. States are a set, kept distinct level by level.
    """
    e = materialize(
        edges.select(*PLACE, F.col("source").alias("node_id"), "target", F.col("valid_from_sequence").alias("vf"), F.col("valid_until_sequence").alias("vu")).distinct(),
        "edges",
    )
    states = materialize(
        seeds.select(*PLACE, "node_id").distinct().withColumn("arrival", F.lit(from_sequence).cast("bigint")).withColumn("depth", F.lit(0)), "states"
    )
    frontier = states
    for depth in range(1, max_hops + 1):
        at = F.greatest("arrival", "vf")
        found = (
            frontier.join(e, [*PLACE, "node_id"])
            .where((at <= until_sequence) & (F.col("vu").isNull() | (at < F.col("vu"))))
            .select(*PLACE, F.col("target").alias("node_id"), at.alias("arrival"), F.lit(depth).alias("depth"))
            .distinct()
        )
        frontier = materialize(found, "states")
        if frontier.isEmpty():
            break
        states = states.unionByName(frontier)
    discard(e)
    return states
