"""Graph operators against brute force on all directed graphs of three nodes and on random ones."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph

SCHEMA = "repository_id string, worktree_id string, edge_id string, source string, target string, relation string"


def many(spark):
    """Each graph is a worktree of its own, so one run covers all."""
    pairs = [(a, b) for a in "abc" for b in "abc"]
    graphs = {}
    for i, mask in enumerate(itertools.product([0, 1], repeat=9)):
        graphs[f"w{i}"] = [(f"e{j}", *p) for j, (p, m) in enumerate(zip(pairs, mask)) if m]
    rng = random.Random(1)
    for i in range(30):
        ns = [f"n{k}" for k in range(8)]
        graphs[f"r{i}"] = [(f"e{k:02d}", rng.choice(ns), rng.choice(ns)) for k in range(rng.randint(1, 16))]
    rows = [("r", w, e, s, t, "Calls") for w, es in graphs.items() for e, s, t in es]
    return graphs, spark.createDataFrame(rows, SCHEMA).repartition(4)


def bfs(edges, seed, hops, turn=lambda s, t: [(s, t)]):
    step = {}
    for e, s, t in edges:
        for a, b in turn(s, t):
            step.setdefault(a, set()).add(b)
    depth, todo = {seed: 0}, deque([seed])
    while todo:
        x = todo.popleft()
        for y in step.get(x, ()):
            if depth[x] < hops and y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth


@pytest.fixture(scope="module")
def case(spark):
    graphs, edges = many(spark)
    seeds = {w: (es[0][1] if es else "a") for w, es in graphs.items()}
    return graphs, edges, seeds, spark.createDataFrame([("r", w, s) for w, s in seeds.items()], "repository_id string, worktree_id string, node_id string")


def test_reach(case):
    graphs, edges, seeds, s = case
    for direction, turn in (("out", lambda a, b: [(a, b)]), ("in", lambda a, b: [(b, a)]), ("both", lambda a, b: [(a, b), (b, a)])):
        got = {(r.worktree_id, r.node_id): r.depth for r in graph.reach(edges, s, 2, direction).collect()}
        want = {(w, n): d for w, es in graphs.items() for n, d in bfs(es, seeds[w], 2, turn).items()}
        assert got == want


def test_shortest_paths(case):
    graphs, edges, seeds, s = case
    got = {(r.worktree_id, r.node_id): list(r.path) for r in graph.shortest_paths(edges, s, 4).collect()}
    want = {}
    for w, es in graphs.items():
        seen, todo = {seeds[w]: []}, deque([seeds[w]])
        while todo:
            x = todo.popleft()
            for e, a, b in sorted(es):
                if a == x and b not in seen and len(seen[x]) < 4:
                    seen[b] = [*seen[x], e]
                    todo.append(b)
        want |= {(w, n): p for n, p in seen.items()}
    assert got == want


def test_cyclic_components(case):
    graphs, edges, _, _ = case
    want = {}
    for w, es in graphs.items():
        nodes = {x for _, a, b in es for x in (a, b)}
        to = {n: set(bfs(es, n, 99)) for n in nodes}
        loops = {a for _, a, b in es if a == b}
        for n in nodes:
            group = {m for m in nodes if m in to[n] and n in to[m]}
            if len(group) > 1 or n in loops:
                want[w, n] = min(group)
    got = {(r.worktree_id, r.node_id): r.component for r in graph.cyclic_components(edges).collect()}
    assert got == want


def test_components_beyond_one_stride(spark):
    """A long chain into a long ring, and a chain on to another ring."""
    n = 3 * graph.STRIDE + 2
    ring = lambda x: [(f"{x}{i:02d}", f"{x}{(i + 1) % n:02d}") for i in range(n)]
    chain = lambda x: [(f"{x}{i:02d}", f"{x}{i + 1:02d}") for i in range(n)]
    pairs = chain("a") + [(f"a{n:02d}", "m05")] + ring("m") + [("m01", "b00")] + chain("b") + [(f"b{n:02d}", "c03")] + ring("c") + chain("z")
    e = spark.createDataFrame([("r", "w", f"e{i}", s, t, "Calls") for i, (s, t) in enumerate(pairs)], SCHEMA)
    got = {(r.node_id, r.component) for r in graph.cyclic_components(e).collect()}
    assert got == {(x, y) for r, y in ((ring("m"), "m00"), (ring("c"), "c00")) for x, _ in r}


def test_simple_paths_and_overflow(spark):
    rows = [("r", "w", f"e{i}", f"n{i}", f"n{i + 1}", "Calls") for i in range(4)]
    e = spark.createDataFrame(rows, SCHEMA)
    assert graph.simple_paths(e, "Calls", 4).count() == 10
    with pytest.raises(RuntimeError):
        graph.simple_paths(e, "Calls", 3)
    assert graph.simple_paths(e, "Imports", 3).count() == 0


def test_trace_respects_time(spark):
    rows = [("r", "w", "a", "b", 5, 9), ("r", "w", "b", "c", 1, 6), ("r", "w", "b", "d", 1, 5), ("r", "w", "c", "e", 30, None)]
    e = spark.createDataFrame(rows, "repository_id string, worktree_id string, source string, target string, valid_from_sequence bigint, valid_until_sequence bigint")
    s = spark.createDataFrame([("r", "w", "a")], "repository_id string, worktree_id string, node_id string")
    got = sorted((r.node_id, r.arrival, r.depth) for r in graph.time_respecting_trace(e, s, 2, 20, 5).collect())
    assert got == [("a", 2, 0), ("b", 5, 1), ("c", 5, 2)]


def test_incident_counts_loops_once(spark):
    e = spark.createDataFrame([("r", "w", "e", "a", "a", "Calls")], SCHEMA)
    n = e.select("repository_id", "worktree_id", F.col("source").alias("node_id"))
    assert graph.incident(e, n).count() == 1


def test_incidence_index_is_not_moved(spark):
    rows = [("r", "w", "e1", "a", "b", "Calls"), ("r", "w", "e2", "b", "a", "Imports"), ("r", "w", "e3", "a", "a", "Calls"), ("r", "v", "e4", "a", "c", "Calls"), ("r", None, "e5", "a", "c", "Calls"), ("r", "w", "e6", "a", None, "Calls")]
    e = spark.createDataFrame(rows + rows[:2], SCHEMA)
    index = graph.IncidenceIndex(e, 3)
    ends = spark.createDataFrame([("r", "w", "a"), ("r", "w", "a"), ("r", "v", "z")], "repository_id string, worktree_id string, node_id string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = index.edges(ends)
    assert sorted((r.edge_id, r.direction, r.other) for r in found.collect() if r.other) == [("e1", "out", "b"), ("e2", "in", "b"), ("e3", "in", "a"), ("e3", "out", "a")]
    # Only the endpoints are brought to the index's buckets.
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Bucketed: true" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    index.drop()
    assert [graph.with_relations(e.distinct(), r).count() for r in (None, [], ["Calls"])] == [6, 0, 5]


def test_byte_budget_says_what_it_omits(spark):
    rows = [("r", "w", i, "é" * 5) for i in range(4)] + [("r", "big", 0, "x" * 30), ("r", "small", 0, "x")]
    lines = spark.createDataFrame(rows, "repository_id string, worktree_id string, at int, line string")
    got = graph.within_bytes(lines, ["at"], 25).collect()
    assert {(r.worktree_id, r.truncated, r.omitted) for r in got} == {("w", True, 2), ("big", True, 1), ("small", False, 0)}
    assert sorted((r.worktree_id, r.at, r.bytes) for r in got if r.kept) == [("small", 0, 1), ("w", 0, 10), ("w", 1, 20)] and len(got) == 6
