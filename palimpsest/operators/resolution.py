"""Resolving references by name, module paths and re-exports, and extracting structure from documents."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import canonical_symbol, slug, terminal_segment

PLACE = ["repository_id", "worktree_id"]

#: Kinds that define a symbol.
DEFINITIONS = ["Module", "Function", "Struct", "Enum", "Trait", "Class"]


def resolve_references(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """(place, reference_id, relation, status, targets, resolved): by exact canonical name, else, if unqualified, by the last segment.

    references: (place, reference_id, symbol, relation); definitions: (place, node_id, name, kind). Only traits answer Implements; imports and
    references marked Unresolved match nothing. One match is a Reference, none Unresolved, more Ambiguous.
    Definitions are keyed and counted before the join, so a common name is one row.
    """
    d = definitions.select(*PLACE, "node_id", canonical_symbol(F.col("name")).alias("exact"), (F.col("kind") == "Trait").alias("trait"))
    keyed = d.select(*PLACE, "node_id", "trait", F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("exact").alias("key")),
        F.struct(F.lit(1).alias("level"), terminal_segment(F.col("exact")).alias("key")),
    )).alias("k")).select(*PLACE, "node_id", "trait", "k.level", "k.key").distinct()
    count = lambda c: F.countDistinct(F.when(c, F.col("node_id")))
    index = keyed.groupBy(*PLACE, "key").agg(
        *[count((F.col("level") == lv) & c).alias(f"n{lv}{s}") for lv in (0, 1) for s, c in (("", F.lit(True)), ("t", F.col("trait")))],
        *[F.min(F.when((F.col("level") == lv) & c, F.col("node_id"))).alias(f"m{lv}{s}") for lv in (0, 1) for s, c in (("", F.lit(True)), ("t", F.col("trait")))],
    )
    r = references.select(*PLACE, "reference_id", "relation", canonical_symbol(F.col("symbol")).alias("key")).join(index, [*PLACE, "key"], "left")
    trait = F.col("relation") == "Implements"
    pick = lambda p, lv: F.coalesce(F.when(trait, F.col(f"{p}{lv}t")).otherwise(F.col(f"{p}{lv}")), F.lit(0) if p == "n" else F.lit(None))
    never = F.col("relation").isin("Imports", "Unresolved")
    qualified = F.contains(F.col("key"), F.lit("::"))
    n = F.when(never, 0).when(pick("n", 0) > 0, pick("n", 0)).when(qualified, 0).otherwise(pick("n", 1))
    who = F.when(pick("n", 0) > 0, pick("m", 0)).otherwise(pick("m", 1))
    status = F.when(F.col("targets") == 1, "Reference").when(F.col("targets") > 1, "Ambiguous").otherwise("Unresolved")
    return r.withColumn("targets", n).withColumn("status", status).select(
        *PLACE, "reference_id", "relation", "status", F.col("targets").cast("bigint").alias("targets"), F.when(F.col("targets") == 1, who).alias("resolved")
    )


def python_module_paths(module: Column, source: Column, roots: list[str]) -> Column:
    """Paths that a Python import may mean, in order: dots climb from the source's folder, else each root is tried."""
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    tail = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    folders = F.slice(F.split(source, "/"), 1, F.greatest(F.size(F.split(source, "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    here = F.array_join(folders, "/")
    stem = lambda base: F.array_join(F.filter(F.array(base, tail), lambda x: x != ""), "/")
    both = lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))
    return F.when(dots > 0, both(stem(here))).otherwise(F.flatten(F.array(*[both(stem(F.lit(r))) for r in roots])) if roots else F.array().cast("array<string>"))


#: What an ECMAScript import leaves out.
ECMASCRIPT_ENDS = [".ts", ".js", ".mjs", "/index.ts", "/index.js", "/index.mjs"]


def ecmascript_module_paths(module: Column, source: Column) -> Column:
    """Paths that a relative ECMAScript import may mean, in order: as written, then with each ending. Others have none: they need a package resolver."""
    at = normal_link(source, module)
    return F.when(module.rlike(r"^\.\.?/") & at.isNotNull(), F.flatten(F.array(F.array(at), F.array(*[F.concat(at, F.lit(e)) for e in ECMASCRIPT_ENDS]))))


def resolve_modules(imports: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """(place, import_id, path, status): the first candidate path that is a file; status resolved, unresolved, or unsupported without candidates.

    imports: (place, import_id, module, source_path), and language, where there are others than python; each language has its own candidates.
    """
    language = F.col("language") if "language" in imports.columns else F.lit("python")
    paths = F.when(language == "python", python_module_paths(F.col("module"), F.col("source_path"), roots)).when(
        language.isin("typescript", "javascript"), ecmascript_module_paths(F.col("module"), F.col("source_path"))
    )
    c = imports.select(*PLACE, "import_id", F.posexplode(paths).alias("i", "path"))
    hit = c.join(files.select(*PLACE, "path").distinct(), [*PLACE, "path"]).groupBy(*PLACE, "import_id").agg(F.min_by("path", "i").alias("path"))
    status = F.when(F.col("path").isNotNull(), "resolved").when(F.col("__none"), "unsupported").otherwise("unresolved")
    return imports.select(*PLACE, "import_id", paths.isNull().alias("__none")).join(hit, [*PLACE, "import_id"], "left").withColumn("status", status).drop("__none")


def python_symbols(files: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, name, first_line, last_line): the definitions and imports of Python texts, by the language's own syntax trees.

    files: (key, text). Kinds are Function, Class and Import; names are qualified by the definitions around them, imports by their module. A text
    that has no tree (null, not Python, or nested beyond the parser) gives one row of kind Diagnostic with the error as its name.
    """
    types = {f.name: f.dataType.simpleString() for f in files.select(*key).schema}

    def walked(text: str | None) -> list[tuple]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return [("Diagnostic", type(e).__name__, getattr(e, "lineno", None) or 1, None)]
        out, todo = [], [(tree, "")]
        while todo:
            node, outer = todo.pop()
            for child in ast.iter_child_nodes(node):
                inner = outer
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    inner = f"{outer}{child.name}::"
                    out.append(("Class" if isinstance(child, ast.ClassDef) else "Function", inner[:-2], child.lineno, child.end_lineno))
                elif isinstance(child, (ast.Import, ast.ImportFrom)):
                    module = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                    out += [("Import", f"{module}::{n.name}" if isinstance(child, ast.ImportFrom) else n.name, child.lineno, child.end_lineno) for n in child.names]
                todo.append((child, inner))
        return out

    def extracted(batches):
        for batch in batches:
            rows = [(*k, *found) for *k, text in batch.itertuples(index=False) for found in walked(text)]
            yield pd.DataFrame(rows, columns=[*key, "kind", "name", "first_line", "last_line"]).astype({"first_line": "Int64", "last_line": "Int64"})

    schema = ", ".join([*(f"`{k}` {t}" for k, t in types.items()), "kind string, name string, first_line bigint, last_line bigint"])
    return files.select(*key, "text").mapInPandas(extracted, schema)


def export_bindings(exports: DataFrame, stars: DataFrame, max_depth: int = 32) -> DataFrame:
    """(module, name, origin): where each exported name comes from through star re-exports.

    exports: (module, name) stated there; stars: (module, source). A stated export ends the walk; ``default`` never passes a star; a
    name from several origins is left out.
    """
    from palimpsest.session import materialize

    known = materialize(exports.select("module", "name", F.col("module").alias("origin")).distinct(), "exports")
    stated = exports.select("module", "name").distinct()
    frontier = known
    for _ in range(max_depth):
        found = (
            frontier.where("name <> 'default'")
            .join(stars.select(F.col("source").alias("module"), F.col("module").alias("via")), "module")
            .select(F.col("via").alias("module"), "name", "origin")
            .distinct()
            .join(stated, ["module", "name"], "left_anti")
            .join(known, ["module", "name", "origin"], "left_anti")
        )
        frontier = materialize(found, "exports")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    else:
        raise RuntimeError(f"re-exports are nested deeper than {max_depth}")
    return known.groupBy("module", "name").agg(F.min("origin").alias("origin"), F.countDistinct("origin").alias("n")).where("n = 1").drop("n")


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text, fenced, heading level or 0, title): the lines of each document, fences counted by a running sum."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line", "text"))
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    by = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("fence", fence).withColumn("open", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(by) % 2)
    marks = F.regexp_extract("text", r"^(#{1,6})[ \t]+\S", 1)
    return lines.withColumn("fenced", F.col("fence") | (F.col("open") == 1)).select(
        "doc_id", "line", "text", "fenced", F.when(F.col("fenced"), 0).otherwise(F.length(marks)).alias("level"),
        F.trim(F.regexp_replace("text", r"^#{1,6}[ \t]+", "")).alias("title"),
    )


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, anchor, duplicate, parent_line): headings with the last earlier heading of a smaller level as parent.

    Parents are found with one running maximum per level, so no heading is compared with all others.
    """
    h = document_lines(documents).where("level > 0").select("doc_id", "line", "level", "title", slug(F.col("title")).alias("anchor"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.greatest(*[F.when(F.lit(lv) < F.col("level"), F.max(F.when(F.col("level") == lv, F.col("line"))).over(before)) for lv in range(1, 6)])
    dup = F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy("line")) - 1
    return h.select("doc_id", "line", "level", "title", "anchor", dup.alias("duplicate"), smaller.alias("parent_line"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph, first_line, last_line): maximal runs of lines that are not blank."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line", "text"))
    by = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.withColumn("blank", ~F.col("text").rlike(r"\S")).withColumn("run", F.sum(F.col("blank").cast("int")).over(by)).where("not blank")
    runs = rows.groupBy("doc_id", "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1
    return runs.select("doc_id", number.alias("paragraph"), "first_line", "last_line")


def owning_sections(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph, section_line): the last heading strictly before a paragraph, by a merge of both in one sorted window."""
    p = paragraphs(documents).select("doc_id", F.col("first_line").alias("line"), "paragraph", F.lit(None).cast("int").alias("heading"))
    s = sections(documents).select("doc_id", "line", F.lit(None).cast("int").alias("paragraph"), F.col("line").alias("heading"))
    by = Window.partitionBy("doc_id").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    return p.unionByName(s).withColumn("section_line", F.max("heading").over(by)).where("paragraph is not null").select("doc_id", "paragraph", "section_line")


def normal_link(source: Column, link: Column) -> Column:
    """A local link relative to its source, as a path inside the root; null for other links and for those that leave the root."""
    path = F.try_url_decode(F.regexp_replace(link, r"[#?].*$", ""))
    local = ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:|^//|^#")
    folder = F.regexp_replace(source, r"[^/]*$", "")
    whole = F.when(path.startswith("/"), F.regexp_replace(path, "^/", "")).otherwise(F.concat(folder, path))
    # A step above the root leaves a mark that stays.
    step = lambda acc, x: F.when((x == "") | (x == ".") | F.array_contains(acc, F.lit("\0")), acc).when(
        x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("\0")))
    ).otherwise(F.concat(acc, F.array(x)))
    folded = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.when(local & (path != "") & ~F.array_contains(folded, F.lit("\0")), F.array_join(folded, "/"))
