"""Publication, sources, lexical search, inference, lineage and documents."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.stem import stem
from palimpsest.operators import context, history, inference, lexical, lineage, publication, resolution, validation
from palimpsest.sources import scan
from palimpsest.streaming import observations

NODE = "node_id string, provenance string, valid_from_sequence bigint, valid_until_sequence bigint"
EDGE = "edge_id string, source string, target string, provenance string, valid_from_sequence bigint, valid_until_sequence bigint"


def state(spark, nodes=(), edges=(), provenance=(), files=()):
    return {
        "nodes": spark.createDataFrame(list(nodes), NODE), "edges": spark.createDataFrame(list(edges), EDGE),
        "provenance": spark.createDataFrame(list(provenance), "provenance_id string, valid_from_sequence bigint, valid_until_sequence bigint"),
        "files": spark.createDataFrame(list(files), "file_id string, content_hash string, valid_from_sequence bigint, valid_until_sequence bigint"),
    }


def test_apply_delta_cascade_and_guards(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    s = state(spark, [("a", "p", 1, None), ("b", "p", 1, None)], [("e", "a", "b", "p", 1, None)], [("p", 1, None)])
    with pytest.raises(publication.StaleBase):
        publication.apply_delta(s, {}, 0, 2)
    # b is removed and brought back: its edge still closes.
    d = {"remove_nodes": one([("b",)], "node_id string"), "upsert_nodes": one([("b", "p")], "node_id string, provenance string")}
    out = publication.apply_delta(s, d, 1, 2)
    assert [(r.edge_id, r.valid_until_sequence) for r in out["edges"].collect()] == [("e", 2)]
    assert sorted((r.node_id, r.valid_from_sequence, r.valid_until_sequence) for r in out["nodes"].where("node_id = 'b'").collect()) == [("b", 1, 2), ("b", 2, None)]
    with pytest.raises(publication.InvalidDelta):
        publication.apply_delta(out, {"upsert_edges": one([("x", "a", "none", "p")], "edge_id string, source string, target string, provenance string")}, 2, 3)
    with pytest.raises(publication.InvalidDelta):
        publication.apply_delta(out, {"upsert_nodes": one([("c", "p"), ("c", "p")], "node_id string, provenance string")}, 2, 3)
    # A removed file wins over a changed one.
    f = {"changed_files": one([("f", "h")], "file_id string, content_hash string"), "removed_files": one([("f",)], "file_id string")}
    assert publication.apply_delta(out, f, 2, 3)["files"].count() == 0


def test_materializer(spark, tmp_path):
    m = publication.Materializer(spark, f"file://{tmp_path}/m")
    row = lambda v: spark.createDataFrame([("r", "w", "node", "a", 1, "name", 0, v)], "repository_id string, worktree_id string, fact_kind string, fact_id string, valid_from_sequence bigint, attribute string, ordinal int, value_text string")
    assert m.view() is None and m.synchronize(row("x"), 1) and not m.synchronize(row("y"), 1)
    with pytest.raises(ValueError):
        m.synchronize(row("y"), 3)
    m.synchronize(row("y"), 2)
    assert [r.value_text for r in m.view().collect()] == ["y"] and m.watermark() == 2


def test_materializer_follows_every_sequence(spark, tmp_path):
    place = "repository_id string, worktree_id string, "
    life = ", valid_from_sequence bigint, valid_until_sequence bigint"
    one = lambda rows, schema: spark.createDataFrame([("r", "w", *x) for x in rows], place + schema + life)
    # Sequence 5 brings nothing; e is there twice from 2, and the copy that ends first is numbered last once it has ended.
    nodes = [("a", "Module", "m", None, "p", 1, 4), ("a", "Module", "n", None, "p", 4, None), ("b", "Test", "t", None, "p", 7, 9)]
    edges = [("e", "a", "b", "Calls", "p", None, 2, None), ("e", "a", "b", "Calls", "p", None, 2, 6), ("e", "a", "c", "Calls", "p", None, 2, 8)]
    tables = {
        "file_versions": one([("f", "x.rs", "h", 3, None, 1, 8)], "file_id string, normalized_path string, content_hash string, size_bytes bigint, language string"),
        "provenance": one([("p", "ns", "1", "c", 1, None)], "provenance_id string, producer_namespace string, producer_version string, evidence_class string"),
        "node_versions": one(nodes, "node_id string, kind string, name string, owner_file string, provenance string"),
        "edge_versions": one(edges, "edge_id string, source string, target string, relation string, provenance string, extension_namespace string"),
    }
    feed = history.attributes(tables)
    found = sorted(map(str, feed.collect()))
    changes = history.feed_changes(feed).cache()
    m = publication.Materializer(spark, f"file://{tmp_path}/all")
    for sequence in range(1, 10):
        m.synchronize(changes.where(F.col("as_of_sequence") == sequence), sequence)
        known = history.attributes({n: history.history_as_of(t, sequence) for n, t in tables.items()})
        assert sorted(map(str, m.view().select(*feed.columns).collect())) == sorted(map(str, known.collect())), sequence
    once = publication.Materializer(spark, f"file://{tmp_path}/once")
    assert once.catch_up(changes) == 9 and once.catch_up(changes) == 9 and len(once.runs.commits()) == 9
    assert sorted(map(str, once.view().select(*feed.columns).collect())) == found


def test_materializer_rebuilds_one_scope(spark, tmp_path):
    m = publication.Materializer(spark, f"file://{tmp_path}/m")
    schema = "repository_id string, worktree_id string, fact_kind string, fact_id string, valid_from_sequence bigint, valid_until_sequence bigint, attribute string, ordinal int, value_text string"
    rows = lambda *x: spark.createDataFrame([("r", w, "node", n, s, u, "name", 0, v) for w, n, s, u, v in x], schema)
    found = lambda: sorted((r.worktree_id, r.fact_id, r.value_text) for r in m.view().collect())
    m.synchronize(rows(("w", "a", 1, None, "x"), ("w", "stray", 1, None, "x"), ("v", "a", 1, None, "y")), 1)
    whole = rows(("w", "a", 1, None, "z"), ("w", "b", 1, None, "z"))
    for bad in (rows(("v", "a", 1, None, "z")), rows(("w", "a", 2, None, "z")), rows(("w", "a", 1, 2, "z")), whole.union(whole)):
        with pytest.raises(publication.InvalidDelta):
            m.rebuild(bad, "r", "w", 1)
    with pytest.raises(ValueError):
        m.rebuild(whole, "r", "w", 2)
    assert m.rebuild(whole, "r", "w", 1) and m.watermark() == 1
    assert found() == [("v", "a", "y"), ("w", "a", "z"), ("w", "b", "z")]
    m.synchronize(rows(("w", "b", 1, 2, "q"), ("v", "c", 2, None, "y")), 2)
    assert found() == [("v", "a", "y"), ("v", "c", "y"), ("w", "a", "z"), ("w", "b", "q")]
    m.rebuild(rows(), "r", "w", 2)
    assert found() == [("v", "a", "y"), ("v", "c", "y")]


def test_sections_inherit_and_sources_come_by_granularity(spark):
    place = "repository_id string, worktree_id string, "
    one = lambda rows, schema: spark.createDataFrame([("r", "w", *x) for x in rows], place + schema)
    kinds = {"a": "Module", "b": "Import", "c": "Function", "s": "Section", "t": "Section", "k1": "DocumentChunk", "k2": "DocumentChunk", "far": "DocumentChunk"}
    nodes = one([(n, k, n, "f" if n in "abc" else None) for n, k in kinds.items()], "node_id string, kind string, name string, owner_file string")
    edges = one([("e1", "s", "k1", "Contains"), ("e2", "s", "k2", "Contains"), ("e3", "t", "k2", "Cites"), ("e4", "t", "far", "Contains"), ("e5", "a", "k2", "Contains")], "edge_id string, source string, target string, relation string")
    seeds = one([("k1", 1), ("k2", 5), ("t", 2), ("far", 9)], "node_id string, relevance bigint")
    got = context.candidates(seeds, one([(n, 0) for n in kinds if n != "far"], "node_id string, depth int"), nodes, edges, one([("f", "text")], "file_id string, text string")).collect()
    assert {r.key: r.relevance for r in got if r.kind == "signature"} == {"a": 0, "b": 0, "c": 0, "s": 5, "t": 2, "k1": 1, "k2": 5}
    assert [r.key for r in sorted(got, key=lambda r: r.position) if r.kind == "source_evidence"] == ["c", "b", "a"]


def test_witnesses_are_verified(spark):
    place = "repository_id string, worktree_id string, "
    edges = [("p1", "a", "b", "A"), ("p2", "b", "c", "A"), ("p3", "b", "a", "A"), ("j", "c", "x", "B"), ("j2", "a", "x", "B"), ("d", "x", "k", "C"), ("d2", "x", "l", "C")]
    e = spark.createDataFrame([("r", "w", *x) for x in edges], place + "edge_id string, source string, target string, relation string")
    rule = {"id": "u", "version": "1", "path_relation": "A", "join_relation": "B", "declaration_relation": "C", "concept": "k", "output_relation": "D"}
    claims = inference.rule_claims(e, rule)
    good = {r.source: r for r in inference.verify_witnesses(claims, e, rule).collect()}
    assert claims.count() == 3 and inference.verify_witnesses(claims, e, rule).where("problem is not null").count() == 0
    base = next(r.asDict() for r in claims.collect() if list(r.premises) == ["p1", "p2", "j", "d"])
    wrong = [
        ({"rule_id": "v"}, "metadata"), ({"relation": "E"}, "metadata"), ({"concept": "l"}, "metadata"), ({"premises": ["j", "d"]}, "shape"), ({"premises": ["p1", "none", "j", "d"]}, "premise"),
        ({"premises": ["p1", "j", "d"]}, "disconnected"), ({"premises": ["p1", "p3", "j2", "d"]}, "disconnected"), ({"premises": ["p1", "p2", "j", "d2"]}, "disconnected"),
        ({"target": "y"}, "disconnected"), ({"claim_id": "0"}, "identity"), ({"premises": ["p1"] * 9 + ["j", "d"]}, "depth"), ({"premises": ["p1"] * 65}, "budget"),
    ]
    for change, problem in wrong:
        bad = spark.createDataFrame([base | change], claims.schema)
        assert [r.problem for r in inference.verify_witnesses(bad, e, rule).collect()] == [problem], change
    assert set(good) == {"a", "b"}


def test_discovery_equals_filtered_evaluation(spark):
    import random

    rng = random.Random(4)
    place = "repository_id string, worktree_id string, "
    edges = [("r", f"w{w}", f"e{i:02d}", *(f"n{rng.randint(0, 7)}" for _ in range(2)), rng.choice("AAB")) for w in range(12) for i in range(16)]
    e = spark.createDataFrame(edges, place + "edge_id string, source string, target string, relation string")
    rule = {"id": "u", "version": "1", "path_relation": "A", "join_relation": "B", "declaration_relation": "A", "concept": None, "output_relation": "D"}
    claims = inference.rule_claims(e, rule, 8)
    for seeds in (e.where("edge_id in ('e03', 'e11')"), e.where("edge_id = 'e05' and worktree_id <> 'w3'"), e.where("false")):
        got = {r.claim_id for r in inference.discover_claims(e, rule, seeds, 8).collect()}
        assert got == {r.claim_id for r in inference.discovered_claims(claims, seeds).collect()}
    assert claims.count() > 100
    sound = inference.verify_witnesses(claims, e, rule)
    assert sound.where("problem is not null").count() == 0


def test_ontology_compatibility(spark):
    k = "o string, "
    make = lambda i, c, s: {"instances": spark.createDataFrame(i, k + "relation string"), "concepts": spark.createDataFrame(c, k + "concept string"), "signatures": spark.createDataFrame(s, k + "relation string, domain string, range string")}
    old = make([(o, "is") for o in "abcdef"], [(o, c) for o in "abcdef" for c in "XYZ"], [(o, r, d, "X") for o in "abcdef" for r, d in (("r", "X"), ("r", "Y"), ("s", "X"))])
    new = make(
        [("a", "is"), *((o, "isa" if o == "b" else "is") for o in "bcde")], [(o, c) for o in "abcde" for c in ("XY" if o in "bc" else "XYZW")],
        [(o, r, d, g) for o in "abcde" for r, d, g in (("r", "X", "X"), ("r", "Y", "X"), ("s", "X", "X"), ("t", "X", "X")) if not (o == "d" and r == "s") and not (o == "e" and d == "Y")],
    )
    got = {(r.o, r.issue, r.name) for r in inference.compatibility_issues(old, new, ["o"]).collect()}
    assert got == {("b", "instance_relation", "is"), ("c", "removed_concept", "Z"), ("d", "removed_relation", "s"), ("e", "narrowed_domain", "r"), ("f", "instance_relation", "is")}


def test_spans_and_predicates(spark):
    text = "aé\nb{c\nd}\n"  # bytes: a 0, é 1-2, \n 3, b 4, { 5, c 6, \n 7, d 8, } 9, \n 10
    spans = [(0, 1, (1, 1, "aé")), (1, 3, (1, 1, "aé")), (3, 4, (1, 1, "aé")), (4, 8, (2, 2, "b{c")), (5, 10, (2, 3, "b{c\nd}")), (0, 11, (1, 3, "aé\nb{c\nd}")), (2, 5, None), (0, 2, None), (4, 4, None), (9, 12, None), (-1, 3, None), (None, 3, None)]
    rows = spark.createDataFrame([(i, text, a, b) for i, (a, b, _) in enumerate(spans)], "i int, t string, a int, b int")
    got = {r.i: r.s and (r.s.first_line, r.s.last_line, r.s.text) for r in rows.select("i", T.span_lines(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(spans)}
    kinds = spark.createDataFrame([("Test",), ("Import",), (None,), ("File",)], "k string")
    assert [tuple(r) for r in kinds.select(T.is_source_content(F.col("k")), T.is_reference_target(F.col("k")), T.source_role(F.col("k"))).collect()] == [(True, True, "TestIntent"), (True, False, None), (False, False, None), (False, True, None)]


def test_record_table(spark, tmp_path):
    t = scan.RecordTable(spark, f"file://{tmp_path}/records")
    df = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    assert t.scan().count() == 0 and t.last("a") is None
    assert t.put(df(("a/1", "x"), ("a/2", "y"), ("a/2", "z"), ("b/1", None), (None, "n"))) == 1
    assert t.put(df(("a/1", "w"), ("a/10", "v"))) == 2
    assert {(r.key, r.value) for r in t.scan("a/").collect()} == {("a/1", "w"), ("a/2", "z"), ("a/10", "v")}
    assert [r.key for r in t.page("", 2, "a/1").collect()] == ["a/10", "a/2"] and t.last("a/") == "a/2"
    other = scan.RecordTable(spark, f"file://{tmp_path}/records")
    other._batches = lambda: ["1"]
    with pytest.raises(RuntimeError):
        other.put(df(("c", "d")))


def test_feed_pages_and_status(spark):
    place = "repository_id string, worktree_id string, "
    rows = [("r", w, k, f"{k[0]}{i:03d}", 1, None) for w in "ab" for k in ("edge", "file", "node") for i in range(7)]
    pages = history.feed_pages(spark.createDataFrame(rows, place + "fact_kind string, fact_id string, valid_from_sequence bigint, valid_until_sequence bigint"), 4, 3)
    got = sorted((r.worktree_id, r.page, ["file", "node", "edge"].index(r.fact_kind), r.fact_id) for r in pages.collect())
    want = [(w, i // 4, "fne".index(f[0]), f) for w in "ab" for i, f in enumerate([f"{k}{i:03d}" for k in "fne" for i in range(7)])]
    assert got == sorted(want)
    g = spark.createDataFrame([("r", "w", "g1", "Accepted"), ("r", "w", "g2", "Accepted")], place + "generation string, status string")
    set_to = spark.createDataFrame([("r", "w", "g2", "Rejected"), ("r", "w", "g2", "Verified")], g.schema)
    assert sorted((r.generation, r.status) for r in history.with_status(g, set_to).collect()) == [("g1", "Accepted"), ("g2", "Verified")]
    with pytest.raises(ValueError):
        history.with_status(g, spark.createDataFrame([("r", "w", "g9", "Verified")], g.schema))


def test_refill_and_preferences(spark):
    import random

    rng, place = random.Random(6), "repository_id string, worktree_id string, "
    lists = {(w, c): rng.sample([f"n{i}" for i in range(20)], rng.randint(0, 15)) for w in "ab" for c in "xyz"}
    rows = [("r", w, c, i, n) for (w, c), ids in lists.items() for i, n in enumerate(ids)]
    got = lexical.refilled(spark.createDataFrame(rows, place + "channel string, position int, node_id string"), 9).orderBy("rank").collect()
    for w in "ab":
        assert [r.node_id for r in got if r.worktree_id == w] == lexical.round_robin([lists[w, c] for c in "xyz" if lists[w, c]], 9)
    plan = spark.createDataFrame([("r", "w", f"n{i}", i) for i in range(1, 5)], place + "node_id string, rank int")
    nodes = spark.createDataFrame([("r", "w", "n1", "Test"), ("r", "w", "n2", "Function"), ("r", "w", "n3", "Test")], place + "node_id string, kind string")
    hits = plan.where("node_id in ('n3', 'n4')")
    order = lambda **k: [r.node_id for r in context.preferred(plan, hits, nodes, **k).orderBy("place").collect()]
    assert order() == ["n1", "n2", "n3", "n4"] and order(tests="first") == ["n1", "n3", "n2", "n4"] and order(tests="last") == ["n2", "n4", "n1", "n3"]
    assert order(tests="last", lexical_first=True) == ["n4", "n3", "n2", "n1"]


def test_body_terms_of_unchanged_texts(spark):
    import hashlib

    place = "repository_id string, worktree_id string, "
    text = "def resolve_edge(): pass"
    digest = hashlib.sha256(text.encode()).hexdigest()[:16]
    files = spark.createDataFrame([("r", "w", "f", digest, text), ("r", "w", "g", "0" * 16, text), ("r", "w", "h", digest, None)], place + "file_id string, content_hash string, text string")
    nodes = spark.createDataFrame([("r", "w", "a", "Function", "f"), ("r", "w", "b", "Module", "f"), ("r", "w", "c", "Function", "g"), ("r", "w", "d", "Function", None)], place + "node_id string, kind string, owner_file string")
    assert sorted((r.node_id, r.term) for r in lexical.body_postings(nodes, files, ["edge", "resolve", "no"]).collect()) == [("a", "edge"), ("a", "resolve")]


def test_packing_cuts_earlier_sources(spark):
    whole = "\n".join(["filler line of text"] * 20 + ["the needle is here"] + ["more filler"] * 9)
    found = [{"kind": "source_evidence", "text": whole, "node_ids": ["a"]}, {"kind": "signature", "text": "x" * 80, "node_ids": ["b"]}]
    got = lexical.pack(found, len(whole) + 10, {"needle"})
    assert [i["kind"] for i in got["items"]] == ["source_evidence", "signature"] and "needle" in got["items"][0]["text"]
    assert got["tokens"] == sum(len(i["text"]) for i in got["items"]) <= len(whole) + 10 and not got["omitted"]
    # Where no cut makes room, all stays as it was.
    kept = lexical.pack([found[0], found[1] | {"text": "y" * (len(whole) + 5)}], len(whole) + 10, {"needle"})
    assert [i["text"] for i in kept["items"]] == [whole] and kept["omitted"] == {"signature": 1}


def test_document_claims_and_python_symbols(spark):
    docs = spark.createDataFrame([(1, "é: the index keeps edges."), (2, None)], "doc_id int, text string")
    claims = [(1, "index", "keeps", "edges", "index keeps"), (1, "index", "keeps", "edges", "index keeps"), (1, "index", "loses", "edges", "index loses"), (1, "index", "keeps", None, "index"), (2, "a", "b", "c", "d"), (3, "a", "b", "c", "d")]
    accepted, rejected = inference.document_claims(spark.createDataFrame(claims, "doc_id int, subject string, relation string, object string, quote string"), docs)
    assert [(r.doc_id, r.start_byte, r.end_byte) for r in accepted.collect()] == [(1, 8, 19)]
    assert sorted((r.doc_id, r.reason) for r in rejected.collect()) == [(1, "incomplete"), (1, "quote"), (2, "document"), (3, "document")]
    text = "import a.b as c\nfrom ..d import e, f\n\nclass A:\n    async def m(self):\n        def inner(): pass\n\ndef g(): ...\n"
    files = spark.createDataFrame([(1, text), (2, "def ("), (3, None), (4, "")], "file int, text string")
    got = sorted((r.file, r.kind, r.name, r.first_line, r.last_line) for r in resolution.python_symbols(files, ["file"]).collect() if r.kind != "Diagnostic")
    assert got == [(1, "Class", "A", 4, 6), (1, "Function", "A::m", 5, 6), (1, "Function", "A::m::inner", 6, 6), (1, "Function", "g", 8, 8), (1, "Import", "..d::e", 2, 2), (1, "Import", "..d::f", 2, 2), (1, "Import", "a.b", 1, 1)]
    assert [(r.file, r.name) for r in resolution.python_symbols(files, ["file"]).where("kind = 'Diagnostic'").collect()] == [(2, "SyntaxError")]


def test_hash_chain():
    entries = [(1, "a"), (2, "b")]
    digests = publication.chain_digest(entries)
    assert publication.verify_chain(entries, digests) and not publication.verify_chain([(1, "a"), (2, "c")], digests)


def test_scan_and_exports(spark, tmp_path):
    (tmp_path / "src" / "skip").mkdir(parents=True)
    (tmp_path / "src" / "a.RS").write_text("fn a() {}")
    (tmp_path / "src" / "b.txt").write_text("x")
    (tmp_path / "src" / "skip" / "c.rs").write_text("y")
    got = scan.scan_tree(spark, f"file://{tmp_path}/src", ["rs"], ["^skip/"]).collect()
    assert [(r.path, r.size_bytes) for r in got] == [("a.RS", 9)]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    path = f"file://{tmp_path}/out"
    assert scan.export_parquet(rows, path)["rows"] == 2 and scan.audit_export(spark, path) == []
    assert scan.export_parquet(rows.limit(1), path)["rows"] == 2  # an export that has its manifest is kept
    extra = next((tmp_path / "out" / "data").glob("*.parquet"))
    extra.rename(extra.with_name("renamed.parquet"))
    assert [w.split()[0] for w in scan.audit_export(spark, path)] == ["missing", "unknown"]
    # Another row in a file of the same name.
    spark.createDataFrame([(1, "y"), (2, None)], rows.schema).coalesce(1).write.parquet(f"{path}/other")
    extra.with_name("renamed.parquet").unlink()
    next((tmp_path / "out" / "other").glob("*.parquet")).rename(extra)
    assert scan.audit_export(spark, path)[0].startswith("unreadable")  # the file system's own checksum is of the file before
    extra.with_name(f".{extra.name}.crc").unlink()
    assert "changed" in {w.split()[0] for w in scan.audit_export(spark, path)}
    # The only file is damaged, so that even the schema cannot be read.
    single = f"file://{tmp_path}/single"
    assert scan.export_parquet(rows.coalesce(1), single)["files"] == 1 and scan.audit_export(spark, single) == []
    only = next((tmp_path / "single" / "data").glob("*.parquet"))
    only.with_name(f".{only.name}.crc").unlink()
    only.write_bytes(only.read_bytes()[:-20])
    assert scan.audit_export(spark, single)[0].startswith("unreadable")
    empty = f"file://{tmp_path}/empty"
    assert scan.export_parquet(rows.where("false"), empty)["rows"] == 0 and scan.audit_export(spark, empty) == []
    r = scan.Records(spark, f"file://{tmp_path}/records")
    assert r.compare_exchange("a/1", 0, "x") and not r.compare_exchange("a/1", 0, "y") and r.compare_exchange("a/1", 1, "z")
    r.compare_exchange("a/2", 0, "w")
    assert r.read("a/1") == (2, "z") and r.keys("a/", limit=1) == ["a/1"] and r.last("a/") == "a/2" and r.read("q") == (0, None)


def test_observations_batch_and_stream(spark, tmp_path):
    schema = "subject string, relation string, object string, observed_at_nanos bigint, producer_namespace string"
    rows = [("s", "view", "o", 10**15, "n"), ("s", "view", "o", 10**15, "n"), ("s", "hack", "o", 1, "n"), ("s", "view", None, 1, "n"), ("s", "view", "o", 1, "m"), ("s", "view", "o", -1, "n")]
    ok, bad = scan.observation_nodes(spark.createDataFrame(rows, schema), ["view"], "n")
    assert ok.count() == 1 and sorted(r.reason for r in bad.collect()) == ["capability", "incomplete", "namespace", "time"]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = observations.stream_observations(stream, ["view"], "n").writeStream.format("memory").queryName("obs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("obs").count() == 1


def test_stream_of_changes(spark, tmp_path):
    schema = "repository_id string, worktree_id string, change_id bigint, revision int, generation_sequence bigint, fact_kind string, fact_id string, kind string, name string, content_hash string, size_bytes bigint"
    spark.createDataFrame([("r", "w", 1, 0, 1, "node", "a", "Added", None, None, None), ("r", "w", 2, 0, 2, "node", "a", "Removed", None, None, None), ("r", "w", 3, 0, 1, "node", "b", "Added", None, None, None)], schema).write.parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/t"
    observations.materialize_feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), root, 2, f"{tmp_path}/cp").awaitTermination()
    assert [r.fact_id for r in observations.BucketedTable(spark, root, 2).current().collect()] == ["b"]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.identifier_terms(F.lit("HTTPRequest_toJson2x été")).alias("a"), T.canonical_symbol(F.lit("a::B < C<D> > ::e")).alias("b"),
        T.slug(F.lit(" A Title, (x) ")).alias("c"), T.normal_path(F.lit("a\\b.md")).alias("d"), T.normal_path(F.lit("a/../b")).alias("e"),
        T.rarity(F.lit(100), F.lit(3)).alias("f"), resolution.normal_link(F.lit("docs/a/b.md"), F.lit("../c%20d.md#x")).alias("g"),
        resolution.normal_link(F.lit("a.md"), F.lit("../../x")).alias("h"), resolution.normal_link(F.lit("a.md"), F.lit("https://x.y")).alias("i"),
    ).first()
    assert list(row.a) == ["2x", "http", "json", "request", "to", "été"] or "http" in row.a
    assert (row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i) == ("a::B::e", "a-title-x", "a/b.md", None, 5, "docs/c d.md", None, None)


def test_symbols_of_any_nesting(spark):
    deep = "a::" + "M< " * 12 + "x, y" + ">" * 12 + "::b"
    for symbol, want in {deep: "a::M::b", "V<" * 40 + ">" * 40: "V", "a -> b": "a-b", "a<b": "a", "a b": "ab", "": "", "a<b<c>::d": "a", "<T as U<V>>::f<W>": "::f"}.items():
        assert spark.range(1).select(T.canonical_symbol(F.lit(symbol)).alias("s")).first().s == want, symbol
    assert spark.range(1).select(T.canonical_symbol(F.lit(None).cast("string")).alias("s")).first().s is None
    place = "repository_id string, worktree_id string, "
    defs = spark.createDataFrame([("r", "w", "n", "M::f", "Function")], place + "node_id string, name string, kind string")
    refs = spark.createDataFrame([("r", "w", "q", "M" + "<A" * 9 + ">" * 9 + "::f", "Calls")], place + "reference_id string, symbol string, relation string")
    assert [(x.status, x.resolved) for x in resolution.resolve_references(refs, defs).collect()] == [("Reference", "n")]


def test_stemmer():
    for word, want in {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "hoped": "hope", "relational": "relat", "generate": "generat", "happily": "happili", "skies": "sky", "national": "nation", "cried": "cri", "by": "by"}.items():
        assert stem(word) == want, word


def test_packing_and_round_robin():
    assert lexical.round_robin([["a", "b", "c"], ["a", "d"], []], 4) == ["a", "d", "b", "c"]
    c = [{"kind": "source_evidence", "text": "one\ntwo needle\nthree", "node_ids": ["n"]}, {"kind": "signature", "text": "sig", "node_ids": ["m"]}, {"kind": "signature", "text": "sig", "node_ids": ["k"]}, {"kind": "summary", "text": "x" * 99, "node_ids": []}]
    packed = lexical.pack(c, 14, {"needle"})
    assert [i["text"] for i in packed["items"]] == ["two needle", "sig"] and packed["items"][1]["node_ids"] == ["k", "m"]
    assert packed["tokens"] == 13 and packed["omitted"] == {"summary": 1}


def test_rules_refuse_other_ontologies(spark):
    e = spark.createDataFrame([], "repository_id string, worktree_id string, edge_id string, source string, target string, relation string")
    rule = {"id": "a", "version": "1", "path_relation": "A", "join_relation": "B", "declaration_relation": "C", "output_relation": "D", "ontology_versions": {"o": "1"}}
    with pytest.raises(ValueError):
        inference.evaluate_rules(e, [rule, rule | {"id": "b", "ontology_versions": {"o": "2"}}])
    assert inference.evaluate_rules(e, [rule]).count() == 0
    old = {"instance_relation": "i", "concepts": {"a", "b"}, "relations": {"r": ({"a", "b"}, {"b"})}}
    assert inference.compatibility_issue(old, old) is None
    assert inference.compatibility_issue(old, old | {"concepts": {"a"}}) == ("removed_concept", "b")
    assert inference.compatibility_issue(old, old | {"relations": {"r": ({"a"}, {"b"})}}) == ("narrowed_domain", "r")


def test_budgets_and_cursors(spark):
    r = spark.range(5)
    assert history.within_budget(r, 5).count() == 5
    with pytest.raises(RuntimeError):
        history.within_budget(r, 4)
    assert [x.id for x in history.page(r, ["id"], 2, (1,)).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        history.page(r, ["id"], 2, (1, 2))


def test_interval_join_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    side = lambda n: [("k", i, f := rng.randint(1, 60), rng.choice([None, f + rng.randint(1, 40)])) for i in range(n)]
    a, b = side(40), side(40)
    df = lambda rows, c: spark.createDataFrame(rows, f"key string, {c} int, valid_from_sequence bigint, valid_until_sequence bigint")
    got = sorted((r.x, r.y) for r in lineage.interval_join(df(a, "x"), df(b, "y"), ["key"]).collect())
    inf = float("inf")
    assert got == sorted((p[1], q[1]) for p in a for q in b if (p[3] or inf) > q[2] and (q[3] or inf) > p[2])


def test_lineage_guards(spark):
    m = spark.createDataFrame([("s", "e1", 1, "add"), ("s", "e1", 1, "remove"), ("s", "e9", 2, "add")], "set string, event_id string, sequence bigint, op string")
    ev = spark.createDataFrame([("e1",)], "event_id string")
    assert {(r.event_id, r.problem) for r in lineage.invalid_memberships(m, ["set"], ev).collect()} == {("e1", "add_and_remove"), ("e9", "unknown_event")}
    g = spark.createDataFrame([("r", "w", "g1", None, 1), ("r", "w", "g3", "g2", 3)], "repository_id string, worktree_id string, generation string, parent_generation string, generation_sequence bigint")
    assert [r.generation for r in validation.chain_gaps(g).collect()] == ["g3"]


def test_modules_and_exports(spark):
    files = spark.createDataFrame([("r", "w", p) for p in ("pkg/a.py", "pkg/sub/__init__.py", "lib/b.py")], "repository_id string, worktree_id string, path string")
    imports = spark.createDataFrame([("r", "w", 1, ".a", "pkg/x.py"), ("r", "w", 2, "..a", "pkg/sub/y.py"), ("r", "w", 3, "pkg.sub", "q.py"), ("r", "w", 4, "b", "q.py"), ("r", "w", 5, "none", "q.py")], "repository_id string, worktree_id string, import_id int, module string, source_path string")
    got = {r.import_id: r.path for r in resolution.resolve_modules(imports, files, ["", "lib"]).collect()}
    assert got == {1: "pkg/a.py", 2: "pkg/a.py", 3: "pkg/sub/__init__.py", 4: "lib/b.py", 5: None}
    e = spark.createDataFrame([("m", "x"), ("m", "default"), ("n", "x"), ("top", "y")], "module string, name string")
    s = spark.createDataFrame([("mid", "m"), ("top", "mid"), ("both", "m"), ("both", "n")], "module string, source string")
    got = {(r.module, r.name): r.origin for r in resolution.export_bindings(e, s).collect()}
    assert got["top", "x"] == "m" and ("mid", "default") not in got and ("both", "x") not in got


def test_references_prefer_exact(spark):
    d = spark.createDataFrame([("r", "w", "n1", "a::f", "Function"), ("r", "w", "n2", "b::f", "Function"), ("r", "w", "n3", "g<T>", "Trait"), ("r", "w", "n4", "c::g", "Function")], "repository_id string, worktree_id string, node_id string, name string, kind string")
    refs = [("1", "a::f", "Calls"), ("2", "f", "Calls"), ("3", "z::f", "Calls"), ("4", "g", "Calls"), ("5", "g", "Implements"), ("6", "a::f", "Imports"), ("7", None, "Calls")]
    r = spark.createDataFrame([("r", "w", *x) for x in refs], "repository_id string, worktree_id string, reference_id string, symbol string, relation string")
    got = {x.reference_id: (x.status, x.resolved) for x in resolution.resolve_references(r, d).collect()}
    assert got == {"1": ("Reference", "n1"), "2": ("Ambiguous", None), "3": ("Unresolved", None), "4": ("Reference", "n3"), "5": ("Reference", "n3"), "6": ("Unresolved", None), "7": ("Unresolved", None)}
