"""Problems 1, 2, 8, 9 and 10: exact round trips, brute force, other libraries, and the defined cases at the edges."""

import ast
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from palimpsest.llm import bpe, chunking, language, mixing  # noqa: E402
from palimpsest.llm.syntax import check, lexers, rules  # noqa: E402
from palimpsest.llm.syntax.grammar import Grammar  # noqa: E402

# --- Source files that do not parse ------------------------------------------------------------------------------

GOOD = {
    "rs": [
        "", "//! doc\nuse std::{fmt, io::{self, Read as R}};\n", "fn f<'a, T: Into<Vec<Vec<u8>>>>(x: &'a mut T) -> Option<&'a str> where T: 'a { None }\n",
        "#[derive(Debug)]\npub(crate) struct S<T>(pub T);\nimpl<T> S<T> { const N: usize = 1 << 3; fn g(&self) -> bool { self.0 >> 1 >= 2 && a::<u8>() } }\n",
        'const R: &str = r#"\n<<<<<<< x\n{ ( "quote" \n"#;\nmacro_rules! m { ($x:expr) => { $x }; }\n', "/* nested /* ( */ { */ static X: char = '(';\n",
        'fn m() { match x { Some(1..=5) | None if y => { a() } K { a, .. } => return, _ => println!("{}", z), } let Some(v) = w else { return }; for (i, b) in v.iter().enumerate() { t += usize::from(*b) * 3; } }\n',
        "async fn z() -> Result<(), Box<dyn std::error::Error + Send>> { let c = move |a: u8, b| a + b; loop { break } while let Some(x) = it.next() {} Ok(()) }\n",
        "pub enum E { A(u32), B { start: u64 }, C = 3 }\ntype M = std::collections::BTreeMap<String, Vec<u8>>;\n",
    ],
    "ts": [
        "", "import { a, type B } from './x';\nexport interface I<T> extends J { readonly n: string; o?: number[]; on(e: 'x'): void; [k: string]: any }\n",
        "export const f = async (p: string): Promise<number> => {\n  const s: number = await m(p)\n  return s * 2\n}\n", "type U = 'a' | { kind: 'b'; at: number } | Array<Map<string, number[]>>\n",
        "enum E { A = 1, B }\nabstract class C<T> extends D<T> implements F { private x?: number = 1; constructor(readonly y: string) { super() } get z(): T { return this.q as T } }\n",
        "function g<T extends { id: string }>(r: readonly T[], n = 1): r is T[] { for (const x of r.slice(0, n)) { o.set(x.id, x); } return `a ${n + `b ${n}`}` !== '' }\n",
    ],
    "js": [
        "", "#!/usr/bin/env node\n'use strict';\nconst p = /[({]\\s*x/g;\n// <<<<<<< not a conflict\nconst t = `\n<<<<<<< left\n${1 + 2}\n=======\n>>>>>>> right (\n`\n",
        "class A extends B { #p = 1; static async *g() { yield* x } set v(q) { this.#p = q } }\nlabel: for (let i = 0, n = a.length; i < n; i++) { if (a / b / c) continue label; else break }\n",
        "const { a, b: [c, ...d], ...e } = f ?? {};\nexport default function () { return a?.b?.[c]?.(d) }\nswitch (x) { case 1: y(); break; default: z() }\ntry { q() } catch { r() } finally { s() }\n",
        "const o = {\n  a: [1, 2],\n  b: { c: '{', d: ']' },\n  async e() { await f; },\n  get g() { return 1 },\n  [h]: i => ({ j: i }),\n}\nif (a)\n  b()\nelse\n  c()\n",
    ],
    "py": ["", "# only\n", "def f(a, /, b=1, *, c: int = 2) -> None:\n    \"\"\"<<<<<<< x\n    \"\"\"\n    return [x for x in y if x]\n", "if a:\r\n    b()\r\nelif c:\r\n    pass\r\nelse:\r\n    d = {**e, 'f': lambda g: g}\r\n", "@d\nclass A(B):\n    x: int = 1\n\n    async def m(self):\n        async with a as b:\n            await c\n        match x:\n            case 1: pass\n"],
    "sh": [
        "", "#!/usr/bin/env bash\nset -euo pipefail\ncase \"$1\" in\n  a|b) x ;;\n  --l) shift; l=\"$1\" ;;\n  *) echo \"usage (x\" >&2 ;;\nesac\n", "f() {\n  local a=\"${1:-5}\"\n  if [[ \"$a\" -gt 3 && -n $b ]]; then\n    echo \"x $(wc -c < \"$f\")\"\n  fi\n  return 0\n}\n",
        "cat <<'END' > o.txt\n<<<<<<< x\nif [ \"open\"\n=======\nEND\nfor i in *.x; do\n  y=$((i + 1))\ndone | sort && z || { w; }\n", "a=(1 2\n 3)\nwhile read -r l; do :; done < <(ls)\nfor ((i=0; i<3; i++)); do echo $i; done\nif ! x; then y; elif z; then w; else v; fi\n",
    ],
}
BAD = {
    "rs": ["fn f( {", "pub fn", "struct S {", "let x = 1;", "function f(a) {}", "<<<<<<< HEAD\nfn a() {}\n=======\n>>>>>>> x\n", "fn f() { a b }", "use a::;", "/* open", "const X: &str = \"open", "import json\n", "fn f() ]"],
    "ts": ["const x: = 1;", "interface I { a: string", "type = ;", "def f(x):\n    pass\n", "<!DOCTYPE html>\n<html></html>", "pub fn a() {}", "const t = `open ${a"],
    "js": ["const x: number = 1;", "interface I { a: string }", "function (", "const a = {", "class A { b( }", "a b", "<<<<<<< ours\n=======\n>>>>>>> theirs\n", "if (a {", "return 1 +", "'open", "const a;"],
    "py": ["def f(:\n    pass\n", "if a:\nb\n", "  x = 1\n", "x = = 1\n", "def f():\n", "x = (1,\n", "'open\n", "a b\n", "<<<<<<< x\na\n=======\n>>>>>>> y\n", "fn f() {}\n", "1abc = 2\n"],
    "sh": ["if true; then\n", "case x in\n a) b ;;\n", "f() {\n echo\n", "echo \"open\n", "for i in a; do\n", "done\n", "pub enum X {\n    A(u32),\n}\n", "def f(x):\n", "<<<<<<< a\n>>>>>>> b\n", "x=$(ls\n", "a && \n", ")"],
}
FILES = "repository_id string, worktree_id string, file_id string, valid_from_sequence bigint, normalized_path string, text string, lang string, pos int"


def test_syntax_operator(spark):
    rows, want = [], set()
    for group, bad in ((GOOD, False), (BAD, True)):
        for ext, texts in group.items():
            for i, text in enumerate(texts):
                for e in (ext, *({"js": ["mjs"], "sh": ["bash"]}.get(ext, [])), ext.upper()):
                    rows.append(("r", "w", f"{e}{bad}{i}", 1, f"a.b/x.{e}", text, "clash", 7))
                    if bad:
                        want.add(f"{e}{bad}{i}")
    rows += [("r", "w", "md", 1, "x.md", "fn f( {", "", 0), ("r", "w", "null", 1, "x.rs", None, "", 0), ("r", "w", "nopath", 1, None, "fn f( {", "", 0), ("r", "w", "dots", 1, "rs/file", "(", "", 0)] + rows[:6]
    files = spark.createDataFrame(rows, FILES)
    found = check.diagnostics(files).collect()
    assert {r.file_id for r in found} == want
    assert len(found) == len(want) and all(r.message and r.truncated is False for r in found)
    assert check.rates(files).agg({"failing": "sum"}).first()[0] == len(want)
    assert check.diagnostics(spark.createDataFrame([], FILES)).count() == 0


def test_python_verdict_is_the_parsers(spark):
    """Every prefix of the good Python texts, cut by lines and by characters."""
    texts = sorted({t[:n] for t in GOOD["py"] for n in range(0, len(t) + 1, 3)} | {t[:n] + t[n + 1 :] for t in GOOD["py"] for n in range(0, len(t), 4)})
    files = spark.createDataFrame([("r", "w", str(i), 1, "x.py", t, "", 0) for i, t in enumerate(texts)], FILES)
    found = {int(r.file_id) for r in check.diagnostics(files).collect()}
    want = set()
    for i, t in enumerate(texts):
        try:
            ast.parse(t)
        except SyntaxError:
            want.add(i)
    assert found == want


def test_members_of_classes_end_by_line_or_semicolon():
    good = {
        "javascript": ["class A { x = 1; y }", "class A {\n x = 1\n static y = 2\n #z\n [k] = 3\n async f() {}\n get\n g\n}", "class A {\n y = () => { a() }\n from\n of() {}\n catch() {} }", "const o = { class: { a: b >\n c } }"],
        "typescript": [
            "class A<in T, out U, in out V> extends B<{ a: T }> {\n z?: Map<string, number>\n w: Array<string>\n v!: string\n [key: string]: any\n abstract g(): T<U>\n h(): void\n}",
            "class A { override async f() {} accessor r = 1; override: string; out() {} constructor(private readonly a: string, override b: number) {} }", "class A {\n a = 1 as const\n b = x!\n @d() c = y\n}", "let override = out + accessor",
        ],
    }
    bad = {
        "javascript": ["class A { x = 1 y = 2 }", "class A { asnyc load() {} }", "class A { x y }", "class A { x = () => {} y() {} }"],
        "typescript": ["class A { x: number y: string }", "class A { x: B<C> y: string }", "class A { asnyc load() {} }", "function f(a b) {}", "const f = (a b) => a", "class A { f(a b: string) {} }", "class A<foo T> {}"],
    }
    for texts, fine in ((good, True), (bad, False)):
        for lang, each in texts.items():
            for text in each:
                assert rules.grammar(lang).accepts(list(lexers.lex(lang, text).cls)) is fine, text


def test_pairs_and_recognition_agree():
    g = Grammar("shape: item*\nitem: 'a' 'b'? | '(' shape ')'", "shape")
    assert ("a", "(") in g.pairs() and ("b", "b") not in g.pairs() and ("^", "$") in g.pairs() and ("(", ")") in g.pairs()
    assert g.accepts("a ( a b ) a".split()) and not g.accepts("a b b".split()) and g.accepts([])
    for lang, text in (("rust", GOOD["rs"][2]), ("javascript", GOOD["js"][2]), ("typescript", GOOD["ts"][1])):
        t = ["^", *lexers.lex(lang, text).cls, "$"]
        assert set(zip(t, t[1:])) <= rules.grammar(lang).pairs()


# --- Splitting oversized items -------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, context array<string>, profile string, room string, source string"
PROFILES = [("small", 600, 60), ("none", 600, None)]


def test_context_stays_while_a_run_fits_beside_it(spark):
    text = "a few words here. " * 40
    docs = [(1, text, ["h" * 200, "i" * 300], "small", "", ""), (2, text, ["h" * 100, None, "i" * 404], "small", "", ""), (3, text, ["h" * 101, None, "i" * 404], "small", "", ""), (4, "\U0001f600" * 99, ["h" * 504], "small", "", ""), (5, text, None, "none", "", ""), (6, "x", ["c" * 599], "small", "", "")]
    profiles = spark.createDataFrame(PROFILES, "profile string, max_bytes int, overlap_bytes int")
    got = {}
    for r in chunking.split_documents(spark.createDataFrame(docs, DOCS), profiles).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {k: {(len(r.context), r.left_out) for r in v} for k, v in got.items()} == {1: {(2, 0)}, 2: {(2, 0)}, 3: {(1, 1)}, 4: {(1, 0)}, 5: {(0, 0)}, 6: {(1, 0)}}
    for doc_id, whole, *_ in docs:
        end = 0
        for r in sorted(got[doc_id], key=lambda r: r.piece):
            assert r.start_byte <= end and len(r.text.encode()) + sum(map(len, r.context)) <= 600
            end = r.start_byte + len(r.text.encode())
        assert end == len(whole.encode())


def test_chunks_cover_fit_and_overlap(spark):
    rng = random.Random(4)
    words = ["alpha", "béta", "längeres", "слово", "x" * 40, "日本語。", "end.\n", "\n\n", "next! ", "e\u0301" * 20]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 400))), rng.choice([None, [], [None, "head"], ["h" * 200, "i" * 300]]), rng.choice(["small", "none"]), "", "") for i in range(40)]
    docs += [(100, None, ["c"], "small", "", ""), (101, "", [], "small", "", ""), (102, "", ["c" * 700], "small", "", ""), (103, "q" * 5000, None, "small", "", ""), (104, "a b " * 500, None, "gone", "", ""), (105, "a b " * 500, None, None, "", ""), (106, "x", ["c" * 599], "small", "", ""), (107, "x", ["c" * 600, None], "small", "", "")]
    profiles = spark.createDataFrame(PROFILES * 2, "profile string, max_bytes int, overlap_bytes int")
    got = {}
    rows = docs + docs[:30] + docs[-3:] + [(None, "x" * 2000, None, "small", "", "")] * 2
    for r in chunking.split_documents(spark.createDataFrame(rows, DOCS), profiles).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {d[0] for d in docs if d[1] is not None}
    limit = {p: (m, o or 0) for p, m, o in PROFILES}
    for doc_id, text, context, profile, *_ in docs:
        if text is None:
            continue
        raw, parts = text.encode(), sorted(got[doc_id], key=lambda r: r.piece)
        size = len(raw) + sum(len(c.encode()) for c in context or [] if c)
        most, overlap = limit.get(profile, (10**9, 0))
        assert all(r.oversized == (size > most) for r in parts) and [r.piece for r in parts] == list(range(parts[0].pieces))
        end = 0
        for i, r in enumerate(parts):
            piece = r.text.encode()
            assert raw[r.start_byte : r.start_byte + len(piece)] == piece
            assert end - overlap <= r.start_byte <= end and (i == 0 or r.start_byte + len(piece) > end)
            assert r.overlap == (end - r.start_byte if i else 0) and r.refused is False
            if size > most:
                assert len(piece) + sum(len(c.encode()) for c in r.context) <= most
            end = r.start_byte + len(piece)
        assert end == len(raw)
    assert chunking.split_documents(spark.createDataFrame([], DOCS), profiles).count() == 0
    tiny = spark.createDataFrame([("small", 100, 1), ("none", 600, 0)], "profile string, max_bytes int, overlap_bytes int")
    left = {r.doc_id: r for r in chunking.split_documents(spark.createDataFrame(docs, DOCS), tiny).where("piece = 0").collect()}
    assert all(r.refused == (d[3] == "small" and r.oversized) and (not r.refused or (r.pieces == 1 and r.text == d[1])) for d in docs if d[1] is not None for r in [left[d[0]]])


def test_overlaps_go_back_to_words_where_sentences_are_long(spark):
    sentence = " ".join(f"word{i:03d}" for i in range(18)) + ". "  # longer than the overlap, shorter than a quarter of the room
    profiles = spark.createDataFrame([("p", 1200, 120)], "profile string, max_bytes int, overlap_bytes int")
    parts = chunking.split_documents(spark.createDataFrame([(1, sentence * 40, None, "p", "", "")], DOCS), profiles).orderBy("piece").collect()
    assert len(parts) > 5 and all(100 <= r.overlap <= 120 and r.text.startswith("word") for r in parts[1:])
    short = "A short sentence stands here. "
    parts = chunking.split_documents(spark.createDataFrame([(1, short * 200, None, "p", "", "")], DOCS), profiles).orderBy("piece").collect()
    assert all(r.overlap == 120 and r.text.startswith("A short") for r in parts[1:])


def test_cuts_prefer_paragraphs(spark):
    text = ("word " * 70).strip() + ".\n\n" + "more " * 100
    profiles = spark.createDataFrame(PROFILES, "profile string, max_bytes int, overlap_bytes int")
    first = chunking.split_documents(spark.createDataFrame([(1, text, None, "none", "", "")], DOCS), profiles).where("piece = 0").first()
    assert first.text.endswith(".\n\n")


# --- Encoding --------------------------------------------------------------------------------------------------------


def test_encoding_equals_other_library(spark):
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(path)
    other = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [None, "", " ", "\n\n  x", "a" * 3000, "<|endoftext|>", "e\u0301\u0301 ñandú 你好，世界 🙂🙂", "0123456789" * 200] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF)])) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, ids int")
    got = bpe.encode_documents(df).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert list(r.ids) == (other.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
    assert bpe.encode_documents(df.where("false")).count() == 0


def test_segment_tree_equals_plain_merging():
    ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate([b"ab", b"bc", b"abab", b"cc", b"aba", b"bcc", b"aa"])}
    tokenizer = bpe.SegmentTreeBPE(ranks, r"\w+")
    rng = random.Random(0)
    for _ in range(500):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 30)))
        parts = [bytes([b]) for b in word]
        while True:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)) if len(parts) > 1 else (1 << 30, 0)
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want = [ranks[p] for p in parts] if word not in ranks else [ranks[word]]
        assert tokenizer.merge(word) == want


# --- Mixing -----------------------------------------------------------------------------------------------------------


def test_mixture_meets_targets_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 6 + ["mid"] * 2 + ["small", "other", None]), " ".join(["word"] * rng.randint(0, 40)), 0) for i in range(900)]
    docs += [(9000, "big", None, 0), (9001, "big", "", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens int")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixing.shares(d, t).collect()}
    for name, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(s[name].actual_share - share) < 0.01 and s[name].times_used <= s[name].max_repeats
    assert s["absent"].used_tokens == 0
    uses = mixing.mixed(d, t).collect()
    assert len({(r.doc_id, r.epoch) for r in uses}) == len(uses) and {r.source for r in uses} == {"big", "mid", "small"}
    assert sum(r.tokens for r in uses) == sum(r.used_tokens for r in s.values())
    assert max(r.epoch for r in uses if r.source == "small") < 3
    assert mixing.mixed(d.where("false"), t).count() == 0 and mixing.mixed(d, t.where("false")).count() == 0


def test_exponent_is_the_least_that_fits():
    n, t, m = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    weights, total, x = mixing.mixing_weights(n, t, m)
    assert (total, x) == (400, 0.0)
    weights, total, x = mixing.mixing_weights(n, t, m, 800)
    assert 0 < x < 1 and abs(weights["b"] * 800 - 200) < 0.01
    with pytest.raises(ValueError):
        mixing.mixing_weights(n, t, m, 5000)


def test_exponent_meets_an_entropy():
    n, m = {"a": 1000, "b": 100, "c": 10, "none": 0}, {"a": 1, "b": 2, "c": 3, "none": 1}
    t = {"a": 0.2, "b": 0.2, "c": 0.5, "none": 0.1}
    for wanted in (0.4, 0.8, 1.05):
        weights, total, x = mixing.mixing_weights(n, t, m, wanted_entropy=wanted)
        assert 0 < x < 1 and abs(mixing.entropy(weights) - wanted) < 1e-9 and set(weights) == {"a", "b", "c"}
        whole = sum(n[s] ** x for s in weights)
        assert all(abs(w - n[s] ** x / whole) < 1e-12 and w * total <= m[s] * n[s] + 1 for s, w in weights.items())
    for bad in (1.2, 0.1):
        with pytest.raises(ValueError):
            mixing.mixing_weights(n, t, m, wanted_entropy=bad)


def test_registered_mixture_of_an_entropy(spark):
    import math

    import __spark_entry__ as entry

    rows = [r for r in entry.queries()["p9_even_shares"](spark, "/root/testdata/sf0.001").collect() if r.available_tokens]
    natural = mixing.entropy({r.source: r.available_tokens / sum(x.available_tokens for x in rows) for r in rows})
    reached = mixing.entropy({r.source: r.actual_share for r in rows})
    assert 0 < rows[0].exponent < 1 and abs(reached - (natural + math.log(len(rows))) / 2) < 0.05
    assert all(r.times_used <= r.max_repeats for r in rows)


def test_registered_mixture_is_tempered(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["p9_tempered_shares"](spark, "/root/testdata/sf0.001").collect()
    wanted = int(0.5 * sum(r.available_tokens for r in rows if r.target_share > 0))
    n, t, m = ({r.source: r[c] for r in rows} for c in ("available_tokens", "target_share", "max_repeats"))
    assert wanted > mixing.mixing_weights(n, t, m)[1]
    weights, _, x = mixing.mixing_weights(n, t, m, wanted)
    assert 0 < x < 1 and all(abs(r.exponent - x) < 1e-12 and r.times_used <= r.max_repeats for r in rows)
    assert all(0 <= weights.get(r.source, 0) * wanted - r.used_tokens < 3000 for r in rows) and sum(r.used_tokens for r in rows) > 0.8 * wanted
    uses = entry.queries()["p9_tempered_mix"](spark, "/root/testdata/sf0.001").agg({"tokens": "sum"}).first()[0]
    assert uses == sum(r.used_tokens for r in rows)


# --- Languages --------------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": ["The index keeps every edge of the module.", "Nobody should rely on the order of these rows.", "We measured this twice and the numbers were the same."],
    "de": ["Der Index behält alle Kanten des Moduls.", "Niemand sollte sich auf die Reihenfolge dieser Zeilen verlassen.", "Wir haben das zweimal gemessen und die Zahlen waren gleich."],
    "fr": ["L'index conserve toutes les arêtes du module.", "Personne ne devrait compter sur l'ordre de ces lignes.", "Nous avons mesuré cela deux fois et les nombres étaient égaux."],
    "ru": ["Индекс хранит все рёбра модуля.", "Никто не должен полагаться на порядок этих строк.", "Мы измерили это дважды, и числа совпали."],
    "ja": ["索引はモジュールのすべての辺を保持します。", "誰もこれらの行の順序に頼るべきではありません。", "二回測定しましたが数値は同じでした。"],
    "zh": ["索引保存模块的所有边。", "谁也不应该依赖这些行的顺序。", "我们测量了两次，数字是一样的。"],
}


def documents(spark, rows):
    return spark.createDataFrame([(*r, "src", "repo", "a/b.md", 5) for r in rows], "doc_id bigint, text string, lang string, source string, repository_id string, path string, n int")


def test_languages(spark):
    train = [(1000 + 100 * k + i, " ".join(SENTENCES[c][i % 3 :] + SENTENCES[c][: i % 3]), c) for k, c in enumerate(SENTENCES) for i in range(12)]
    e, d, r, j = (SENTENCES[c] for c in ("en", "de", "ru", "ja"))
    cases = [
        (1, e[0] + " " + e[1], "en"), (2, e[0] + " " + e[1], "English"), (3, d[0] + " " + d[1], "ger"), (4, d[0] + " " + d[1], "de_AT"), (5, d[1], "en"), (6, r[1], None), (7, j[1], "n/a"),
        (8, None, None), (9, "", "en"), (10, " \n ", None), (11, "fn main() { return; }\n```\n" + e[0] + "\n```\n# " + d[0], None),
        (12, e[1] + "\n\n \n" + d[1] + " " + r[1] + "\n\n```\n" + j[1] + "\n\n```\n\n" + e[2], "mul"), (13, e[1] + ' It said "' + d[1] + '" and ended there.', "en"), (14, (d[1] + " ") * 3000, "de"),
        (15, e[1] + "\r\n\r\n> " + d[1], "en"),
    ]
    df = documents(spark, train + cases + cases[:1])
    assigned = language.assign(df).where("doc_id < 1000")
    found = sorted((x.doc_id, x.paragraph, x.lang) for x in language.mislabelled(assigned).distinct().collect())
    assert found == [(5, -1, "de"), (6, -1, "ru"), (7, -1, "ja"), (12, 0, "en"), (12, 1, "de"), (12, 1, "ru"), (12, 4, "en"), (15, 0, "en"), (15, 1, "de")]
    assert all(0 < x.confidence <= 1 for x in assigned.collect())
    assert language.assign(df.where("false")).count() == 0


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.sample(SENTENCES[c], 2)), c if rng.random() < 0.8 else rng.choice(list(SENTENCES))) for i, c in enumerate(list(SENTENCES) * 20)]
    truth = {i: c for i, c in enumerate(list(SENTENCES) * 20)}
    model = language.train(documents(spark, docs[:60]))
    got = language.assign(documents(spark, docs[60:]), model=model).collect()
    assert sum(truth[x.doc_id] == x.lang for x in got) / len(got) >= 0.98


def test_a_language_that_is_not_modelled(spark):
    """A language outside the model keeps its label, or stays undetermined; without training texts nothing is called foreign."""
    rng = random.Random(2)
    known = [(i, " ".join(rng.sample(SENTENCES[c], 2)), c) for i, c in enumerate(list(SENTENCES) * 30)]
    korean = "각 세대는 생산자가 마지막 실행 중에 관찰한 간선을 유지한다. 아무도 이 행들의 순서에 의존해서는 안 된다."
    docs = known + [(1001, korean, "ko"), (1002, korean, None), (1003, korean, "de")]
    model = language.train(documents(spark, known))
    got = {x.doc_id: x for x in language.assign(documents(spark, docs), model=model).collect()}
    assert {i: (got[i].lang, got[i].paragraph) for i in (1001, 1002, 1003)} == {1001: ("ko", -1), 1002: ("und", -1), 1003: ("und", -1)}
    assert all(x.lang in language.LANGUAGES for i, x in got.items() if i < 1000)
    assert 1001 not in {x.doc_id for x in language.mislabelled(language.assign(documents(spark, docs), model=model)).collect()}
    alone = language.assign(documents(spark, [(1, "the of and to in that is was for it.", None)])).collect()
    assert [x.lang for x in alone] == ["en"]


def test_labels(spark):
    known = language.label_codes(spark)
    for label, want in {"en": "en", "EN-us": "en", "zh_Hans": "zh", "fre": "fr", "FRA": "fr", "Dutch": "nl", " Polish ": "pl", "und": None, "": None, "??": None, "n/a": None, "unknown": None, None: None}.items():
        assert language.canonical_label(label, known) == want, label
