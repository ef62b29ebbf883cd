"""Problems 3 to 7: brute force, nulls, ties, repeats, empty tables, clashing extra columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import asof, changefeed, incremental, ledger, references

T0 = dt.datetime(2029, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(minutes=n)


FEED = "repository_id string, worktree_id string, change_id bigint, revision int, event_id string, generation_sequence bigint, fact_kind string, fact_id string, kind string, name string, content_hash string, size_bytes bigint, arrived_at timestamp_ntz"
MARKS = "repository_id string, worktree_id string, run_id bigint, status string, generation string, generation_sequence bigint, pending_generation string, pending_sequence bigint, cursor_fact_kind string, cursor_fact_id string, started_at timestamp_ntz, finished_at timestamp_ntz"
CHECKS = "stream string, repository_id string, worktree_id string, sequence bigint, checkpointed_at timestamp_ntz"


def change(cid, rev=0, seq=1, kind="node", fact="a", what="Added", when=1, wt="w"):
    return ("r", wt, cid, rev, "e", seq, kind, fact, what, None, None, None, at(when))


def pending(spark, feed, marks, checks, upper=None):
    rows = incremental.pending_records(
        spark.createDataFrame(feed, FEED), spark.createDataFrame(marks, MARKS), spark.createDataFrame(checks, CHECKS), upper
    ).collect()
    return sorted((r.consumer, r.change_id, r.revision) for r in rows)


def test_pending_by_cursor_and_arrival(spark):
    run = ("r", "w", 2, "committed", "g", 1, "g2", 2, "node", "b", at(10), at(11))
    older = ("r", "w", 1, "committed", "g", 9, None, None, None, None, at(9), at(10))
    failed = ("r", "w", 3, "failed", "g", 9, None, None, None, None, at(90), at(91))
    feed = [
        change(1, seq=1, when=10), change(1, seq=1, when=99), change(2, seq=1, when=11), change(3, seq=2, fact="b", when=1),
        change(4, seq=2, fact="c", when=1), change(5, seq=2, kind="file", fact="z", when=1), change(6, seq=2, kind="edge", fact="a", when=1), change(7, seq=3, when=1),
    ]
    got = [x for x in pending(spark, feed, [run, run, older, failed], []) if x[0] == "materializer"]
    assert got == [("materializer", c, 0) for c in (2, 4, 6, 7)]


def test_pending_without_run_and_checkpoints(spark):
    feed = [change(1, when=5), change(1, rev=1, when=20), change(2, seq=2, when=5), change(3, when=None)]
    checks = [("inference", "r", "w", 1, at(5)), ("inference", "r", "w", 1, at(7)), ("other", "r", "w", 2, at(99))]
    got = pending(spark, feed, [], checks)
    assert [x for x in got if x[0] == "inference"] == [("inference", 1, 1), ("inference", 2, 0), ("inference", 3, 0)]
    assert len([x for x in got if x[0] == "materializer"]) == 4
    assert pending(spark, [], [], []) == []
    upper = incremental.upper_limit(spark.createDataFrame(feed[:1], FEED))
    assert ("inference", 1, 1) not in pending(spark, feed, [], checks, upper)


def test_incremental_runs_neither_skip_nor_repeat(spark, tmp_path):
    run = incremental.IncrementalRun(spark, f"file://{tmp_path}/runs", "n")
    src = lambda k: spark.createDataFrame([(i,) for i in range(k)], "n bigint")
    rows, ticket = run.take(src(5))
    rows.write.parquet(f"file://{tmp_path}/runs/data/lost")  # a run that fails before its commit
    rows, ticket = run.take(src(5))
    other_rows, other = run.take(src(6))
    assert run.commit(rows, ticket) and not run.commit(other_rows, other)
    rows, ticket = run.take(src(9))
    assert sorted(r.n for r in rows.collect()) == [5, 6, 7, 8]
    assert run.commit(rows, ticket)
    assert sorted(r.n for r in run.output().collect()) == list(range(9))


def test_late_rows_at_the_watermark(spark, tmp_path):
    src = lambda *rows: spark.createDataFrame(list(rows), "id string, n bigint")
    run = incremental.IncrementalRun(spark, f"file://{tmp_path}/keyed", "n", ["id"])
    first = [("a", 1), ("b", 5), ("x", None), (None, 5)]
    for rows, want in ((first, ["None", "a", "b", "x"]), ([*first, ("c", 5), ("y", None)], ["c", "y"]), ([*first, ("c", 5), ("y", None), ("d", 5), ("e", 6)], ["d", "e"])):
        got, ticket = run.take(src(*rows))
        assert sorted(str(r.id) for r in got.collect()) == want
        assert run.commit(got, ticket)
    assert run.output().count() == 8
    assert run.take(src())[0].isEmpty()
    assert run.take(src(("z", 3)), "4")[1]["watermark"] == "6" and run.take(src(("z", 3)), "4")[0].isEmpty()
    strict = incremental.IncrementalRun(spark, f"file://{tmp_path}/strict", "n")
    for bad in (first, [("a", 1), ("b", 1)]):
        with pytest.raises(ValueError):
            strict.take(src(*bad))
    got, ticket = strict.take(src(("a", 1), ("b", 2)))
    assert strict.commit(got, ticket)
    for late in (("c", 2), ("c", 0)):
        with pytest.raises(ValueError, match="late"):
            strict.take(src(("a", 1), ("b", 2), late))
    assert [r.id for r in strict.take(src(("a", 1), ("b", 2), ("c", 3)))[0].collect()] == ["c"]


def test_pending_runs_commit_output_with_watermark(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    marks, checks = spark.createDataFrame([], MARKS), spark.createDataFrame([], CHECKS)
    feed = [change(1, when=5), change(1, when=9), change(2, when=6), change(3, when=None)]
    got = lambda: sorted((r.consumer[0], r.change_id, r.revision) for r in incremental.committed_pending(spark, root).collect())
    real, incremental.write_once = incremental.write_once, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            incremental.run_pending(spark.createDataFrame(feed, FEED), marks, checks, root)
    finally:
        incremental.write_once = real
    assert incremental.committed_pending(spark, root) is None
    assert incremental.run_pending(spark.createDataFrame(feed, FEED), marks, checks, root)
    first = [(c, i, 0) for c in "im" for i in (1, 2, 3)]
    assert got() == first
    # A repeat, a record that arrives in the watermark's own microsecond and a new revision.
    feed += [change(2, when=30), change(4, when=9), change(1, rev=1, when=31)]
    assert incremental.run_pending(spark.createDataFrame(feed, FEED), marks, checks, root)
    assert got() == sorted(first + [(c, *x) for c in "im" for x in ((4, 0), (1, 1))])


def test_one_of_eight_writers_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from palimpsest.session import read_text, write_once

    for i in range(20):
        path = f"file://{tmp_path}/m/{i}.json"
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda n: write_once(spark, path, str(n)), range(8)))
        assert sum(won) == 1 and read_text(spark, path) == str(won.index(True))


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    from palimpsest.session import shared_dir

    class Conf(dict):
        def get(self, k, d=None):
            return None

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, getConf=Conf))
        with pytest.raises(ValueError):
            shared_dir(fake)


VERSIONS = "repository_id string, worktree_id string, edge_id string, version_id bigint, color string, valid_from_sequence bigint, valid_until_sequence bigint, accepted_at timestamp_ntz, drawn_at int"


def test_attributes_at_event_equals_brute_force(spark):
    rng = random.Random(3)
    versions = [("r", rng.choice("wv"), rng.choice("ab"), i, rng.choice([None, "x", "y"]), f := rng.randint(1, 6), rng.choice([None, f + rng.randint(1, 4)]), at(rng.randint(0, 20)), 1) for i in range(60)]
    versions += versions[:10] + [("r", "w", None, 99, "x", 1, None, at(0), 1), ("r", "w", "a", 98, "x", None, None, at(0), 1)]
    events = [("r", rng.choice("wv"), i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(1, 8)]), at(rng.choice([None, *range(20)]))) for i in range(60)]
    v = spark.createDataFrame(versions, VERSIONS)
    e = spark.createDataFrame(events + events[:5], "repository_id string, worktree_id string, premise_id bigint, edge_id string, seq bigint, drawn_at timestamp_ntz")
    got = asof.attributes_at_event(e, v, ["repository_id", "worktree_id", "edge_id"], "premise_id", "seq", "drawn_at", ["version_id", "color"])
    want = {}
    for _, w, p, edge, seq, by in events:
        fit = [x for x in versions if None not in (edge, seq, by, x[5]) and x[1] == w and x[2] == edge and x[5] <= seq and (x[6] is None or seq < x[6]) and x[7] <= by]
        if fit:
            best = max(fit, key=lambda x: (x[7], x[3]))
            want[p] = (best[3], best[4])
    assert {r.premise_id: (r.version_id, r.color) for r in got.collect()} == want
    assert got.count() == len(want)
    # Entities cut into many time blocks or few.
    for rows in (1, 9):
        cut = asof.attributes_at_event(e, v, ["repository_id", "worktree_id", "edge_id"], "premise_id", "seq", "drawn_at", ["version_id", "color"], block_rows=rows)
        assert {r.premise_id: (r.version_id, r.color) for r in cut.collect()} == want
    # A history that never changes and one that does are matched by themselves.
    color = asof.attributes_at_event(e, v, ["repository_id", "worktree_id", "edge_id"], "premise_id", "seq", "drawn_at", ["color"])
    assert sorted(((r.premise_id, r.color) for r in color.collect()), key=str) == sorted(((p, x[1]) for p, x in want.items()), key=str)
    none = asof.attributes_at_event(e.where("false"), v, ["repository_id", "worktree_id", "edge_id"], "premise_id", "seq", "drawn_at", ["color"])
    assert none.count() == 0
    none = asof.attributes_at_event(e, v.where("false"), ["repository_id", "worktree_id", "edge_id"], "premise_id", "seq", "drawn_at", ["color"])
    assert none.count() == 0


def tables(spark, nodes, edges, files=(), provenance=()):
    return {
        "node_versions": spark.createDataFrame(nodes, "repository_id string, worktree_id string, version_id bigint, node_id string, owner_file string, provenance string, valid_from_sequence bigint, valid_until_sequence bigint"),
        "edge_versions": spark.createDataFrame(edges, "repository_id string, worktree_id string, version_id bigint, source string, target string, valid_from_sequence bigint, key string"),
        "file_versions": spark.createDataFrame(list(files), "repository_id string, worktree_id string, file_id string, valid_from_sequence bigint, valid_until_sequence bigint"),
        "provenance": spark.createDataFrame(list(provenance), "repository_id string, worktree_id string, provenance_id string, valid_from_sequence bigint"),
    }


def test_orphan_references(spark):
    nodes = [("r", "w", 1, "a", None, "p", 1, 5), ("r", "w", 2, "a", "f", "p", 7, None), ("r", "w", 3, "late", "f", None, 9, None), ("r", "x", 4, "other", None, None, 1, None)]
    edges = [("r", "w", 10, "a", "a", 4, "k"), ("r", "w", 11, "a", "late", 5, "k"), ("r", "w", 12, "other", None, 7, "k"), ("r", "w", 12, "other", None, 7, "k"), ("r", "w", 13, "a", "a", None, "k")]
    t = tables(spark, nodes, edges, [("r", "w", "f", 1, 8)], [("r", "w", "p", 1)])
    found = {(r.record_table, r.version_id, r.field, r.reason) for r in references.orphan_references(t).collect()}
    assert found == {
        ("edge_versions", 11, "source", "deleted"), ("edge_versions", 11, "target", "late"), ("edge_versions", 12, "source", "missing"),
        ("node_versions", 3, "owner_file", "deleted"), ("edge_versions", 13, "source", "deleted"), ("edge_versions", 13, "target", "deleted"),
    }
    assert references.orphan_references(tables(spark, [], [])).count() == 0
    assert references.orphan_references(t).count() == len(found)


SNAP = "repository_id string, worktree_id string, node_id string, as_of_sequence bigint, namespace string, external_kind string, name string, stage string, schema_version int, loaded_at timestamp_ntz, valid_from string"


def snap(node, seq, name="n", stage=None, load=0, wt="w"):
    return ("r", wt, node, seq, "ns", "k", name, stage, 1, at(load), "clash")


def test_external_versions(spark):
    rows = [
        snap("a", 1), snap("a", 1), snap("a", 3, stage=None), snap("a", 6, name="m"), snap("a", 6, name="n", load=-5),
        snap("b", 1, name="old", load=1), snap("b", 1, name="new", load=2), snap("b", 6, name="new"), snap("c", 3), snap(None, 9), snap("z", 2, wt="v"),
    ]
    got = sorted((r.node_id, r.name, r.valid_from, r.valid_until) for r in ledger.external_versions(spark.createDataFrame(rows, SNAP)).collect())
    assert got == [("a", "m", 6, 9), ("a", "n", 1, 6), ("b", "new", 1, 3), ("b", "new", 6, 9), ("c", "n", 3, 6), ("z", "n", 2, None)]
    assert ledger.external_versions(spark.createDataFrame([], SNAP)).count() == 0


def test_ledger_splits_and_supersedes(spark):
    said = [("k", 1, None, at(0), "a"), ("k", 3, 6, at(5), "b"), ("k", 5, 8, at(3), "c"), ("k", 5, 8, at(3), "c")]
    led = ledger.bitemporal_ledger(spark.createDataFrame(said, "key string, valid_from bigint, valid_until bigint, recorded_at timestamp_ntz, v string"), ["key"], ["v"])
    believed = lambda n: sorted((r.valid_from, r.valid_until, r.v) for r in ledger.merged_history(
        ledger.believed_at(led, at(n)).withColumn("x", F.lit(1)), ["key"], ["v"]).collect())
    assert believed(1) == [(1, None, "a")]
    assert believed(4) == [(1, 5, "a"), (5, 8, "c"), (8, None, "a")]
    assert believed(6) == [(1, 3, "a"), (3, 6, "b"), (6, 8, "c"), (8, None, "a")]


def test_ledger_of_one_key_with_many_statements(spark):
    """Statements that each cover one period, and one over all of them: rows grow with what is written, not with its square."""
    n = 20_000
    said = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("valid_from"), (F.col("id") + 1).alias("valid_until"), F.lit(at(5)).alias("recorded_at"), (F.col("id") % 2).alias("v"))
    whole = spark.createDataFrame([("k", 0, None, at(1), 7)], "key string, valid_from bigint, valid_until bigint, recorded_at timestamp_ntz, v bigint")
    led = ledger.bitemporal_ledger(said.unionByName(whole), ["key"], ["v"])
    got = led.agg(F.count("*").alias("n"), F.count_if("is_current").alias("c"), F.count_if((F.col("v") == 7) & F.col("is_current")).alias("w")).first()
    assert (got.n, got.c, got.w) == (2 * n + 1, n + 1, 1)
    rng = random.Random(8)
    brute = [("k", f, rng.choice([None, f + rng.randint(1, 5)]), at(rng.randint(0, 20)), i) for i, f in enumerate(rng.randint(0, 9) for _ in range(25))]
    led = ledger.bitemporal_ledger(spark.createDataFrame(brute, "key string, valid_from bigint, valid_until bigint, recorded_at timestamp_ntz, v bigint"), ["key"], ["v"])
    now = ledger.merged_history(led.where("is_current"), ["key"], ["v"]).collect()
    for s in range(16):
        want = max(((r, v) for _, f, u, r, v in brute if f <= s and (u is None or s < u)), default=(None, None))[1]
        got = [r.v for r in now if r.valid_from <= s and (r.valid_until is None or s < r.valid_until)]
        assert got == ([] if want is None else [want])


def brute_state(feed):
    last = {}
    for x in feed:
        if x[5] is None or x[7] is None or x[8] not in changefeed.KINDS:
            continue
        key = (x[0], x[1], x[6], x[7])
        last[key] = max(last.get(key, ()), (x[5], x[2], x[3], x[8]))
    return {(k[1], k[2], k[3], v[1], v[2]) for k, v in last.items() if v[3] != "Removed"}


def test_change_feed_in_any_order_and_in_parts(spark, tmp_path):
    rng = random.Random(5)
    feed = [change(i, rng.randint(0, 2), i // 7, rng.choice(["node", "edge"]), rng.choice("abcdefgh"), rng.choice(changefeed.KINDS), rng.randint(0, 9), rng.choice("wv")) for i in range(150)]
    # A change_id keeps its fact and generation over its revisions.
    feed += [x[:3] + (x[3] + 1,) + x[4:8] + ("Removed",) + x[9:] for x in feed[::5]] + feed[:20]
    feed += [change(900, fact=None), change(901, what="Odd"), change(902, seq=None)]
    rng.shuffle(feed)
    table = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", 4)
    for part in (feed[:70], feed[70:90], feed[90:], feed[:30]):
        table.apply(spark.createDataFrame(part, FEED))
    got = {(r.worktree_id, r.fact_kind, r.fact_id, r.change_id, r.revision) for r in table.current().collect()}
    assert got == brute_state(feed)
    whole = changefeed.current_facts(spark.createDataFrame(feed, FEED), 3)
    assert {(r.worktree_id, r.fact_kind, r.fact_id, r.change_id, r.revision) for r in whole.collect()} == got
    assert changefeed.current_facts(spark.createDataFrame([], FEED)).count() == 0


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", 8)
    table.apply(spark.createDataFrame([change(i, fact=f"f{i}") for i in range(40)], FEED))
    before = table.manifest()["buckets"]
    table.apply(spark.createDataFrame([change(99, seq=2, fact="f1", what="Removed")], FEED))
    after = table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.current().count() == 39


def test_later_parts_are_merged_bucket_by_bucket(spark, tmp_path):
    """Without a merge of the touched buckets the facts of the first part would be lost, and without bucketed files both would be shuffled."""
    feed = [change(i, rev=i % 2, seq=i % 5, fact=f"f{i % 60}", what=changefeed.KINDS[i % 3], when=i) for i in range(200)] + [change(900, when=None, wt=None), change(901, wt="", when=1)]
    df = spark.createDataFrame(feed, FEED)
    parts = changefeed.parts_by_arrival(df, 3)
    assert [p.count() > 40 for p in parts] == [True] * 3 and sum(p.count() for p in parts) == len(feed)
    table = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", 3)
    plans, merged = [], table.merged
    table.merged = lambda *a: plans.append((r := merged(*a))[0]._jdf.queryExecution().executedPlan().toString()) or r
    for p in parts:
        table.apply(p)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Exchange" not in p for p in plans)
    got = sorted((str(r.worktree_id), r.fact_id, r.change_id, r.revision) for r in table.current().collect())
    assert got == sorted((str(w), f, c, v) for w, _, f, c, v in brute_state(feed))
    # Old folders go, the state stays; a table that has outgrown its buckets is laid out anew.
    table.vacuum()
    small = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", bucket_rows=3)
    small.apply(df)
    assert small.manifest()["width"] > 3 and small.current().count() == len(got)


def test_two_writers_of_one_version(spark, tmp_path):
    a = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", 2)
    stale = a.manifest()
    a.apply(spark.createDataFrame([change(1)], FEED))
    b = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", 2)
    b.manifest = lambda: stale
    with pytest.raises(RuntimeError):
        b.apply(spark.createDataFrame([change(2)], FEED))
