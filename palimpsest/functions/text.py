"""Scalar text functions on identifiers and documents, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Borders inside an identifier: a lower-case letter or digit before a capital, or an acronym before a word.
_CAMEL = r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"


def identifier_terms(c: Column, least: int = 1) -> Column:
    """Distinct sorted lower-case terms of an identifier; null gives an empty array."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), _CAMEL, " "), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: F.length(x) >= least)))


def rarity(population: Column, frequency: Column) -> Column:
    """Bit length of population div (frequency + 1) + 1: an integer weight that falls as a term gets common."""
    return F.length(F.bin(F.expr("0") + F.floor(population / (frequency + 1)) + 1)).cast("bigint")


def terminal_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "::"), -1)


def canonical_symbol(c: Column) -> Column:
    """Without white space and type arguments, however deep they nest. A ``>`` that closes nothing goes too; an unclosed ``<`` takes the rest."""
    bare = F.regexp_replace(c, r"\s+", "")

    def step(at: Column, x: Column) -> Column:
        depth = F.when(x == "<", at["depth"] + 1).when(x == ">", F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"])
        out = F.when((at["depth"] == 0) & ~x.isin("<", ">"), F.concat(at["out"], x)).otherwise(at["out"])
        return F.struct(depth.alias("depth"), out.alias("out"))

    parts = F.regexp_extract_all(bare, F.lit("[<>]|[^<>]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.when(bare.rlike("[<>]"), F.aggregate(parts, start, step, lambda at: at["out"])).otherwise(bare)


def slug(c: Column) -> Column:
    """Anchor of a heading: lower case, letters, digits, hyphens and underscores, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\- ]", ""), " ", "-")


def normal_path(c: Column) -> Column:
    """A relative path with forward slashes; null for absolute, drive-letter or climbing paths and empty segments."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    bad = path.rlike(r"^/|^[A-Za-z]:|(^|/)\.{0,2}(/|$)") | (path == "")
    return F.when(~bad, path)


def candidate_paths(paths: Column) -> Column:
    """Sorted distinct usable paths of an array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(paths, normal_path), lambda x: x.isNotNull())))


def is_static_command(c: Column) -> Column:
    """A shell command word that is known before it runs: no expansion in it."""
    return F.coalesce(c.rlike(r"^[A-Za-z_][A-Za-z0-9_./\-]*$"), F.lit(False))


#: Lexical families of node kinds.
CODE = ["Module", "Function", "Struct", "Enum", "Trait", "Test", "Class", "Script"]
DOCUMENTATION = ["Document", "Section", "DocumentChunk"]
REFERENCE = ["Reference", "UnresolvedReference", "AmbiguousReference", "Import", "Export"]


def lexical_family(kind: Column) -> Column:
    return (
        F.when(kind.isin(CODE), "Code").when(kind.isin(DOCUMENTATION), "Documentation").when(kind.isin(REFERENCE), "Reference").otherwise("Other")
    )


#: Kinds whose source text is indexed, and kinds that a reference may resolve to.
SOURCE_CONTENT = ["Function", "Struct", "Enum", "Trait", "Test", "Class", "Import", "Export", "Section", "DocumentChunk"]
REFERENCE_TARGETS = ["Function", "Test", "Class", "Struct", "Trait", "File", "Document"]


def is_source_content(kind: Column) -> Column:
    return F.coalesce(kind.isin(SOURCE_CONTENT), F.lit(False))


def is_source_anchor(kind: Column, namespace: Column, external_kind: Column, anchors: str) -> Column:
    """An External node of kind ``anchor`` in the namespace of anchors."""
    return F.coalesce((kind == "External") & (namespace == anchors) & (external_kind == "anchor"), F.lit(False))


def is_reference_target(kind: Column, anchor: Column | None = None) -> Column:
    """Definitions, files, documents and source anchors; nothing else may answer a reference."""
    target = F.coalesce(kind.isin(REFERENCE_TARGETS), F.lit(False))
    return target if anchor is None else target | anchor


def source_role(kind: Column) -> Column:
    """TestIntent for tests, else null: its absence is no proof of production code."""
    return F.when(kind == "Test", "TestIntent")


def span_lines(text: Column, start: Column, end: Column) -> Column:
    """The whole lines, numbered from 1, that the UTF-8 bytes [start, end) of a text touch: (first_line, last_line, text).

    Null for a span that is empty, ends beyond the text, or begins or ends inside a character.
    """
    raw = F.encode(text, "UTF-8")
    part = lambda at, n: F.substring(raw, at + 1, n)
    # Bytes 10xxxxxx continue a character.
    inside = lambda at: F.conv(F.hex(part(at, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80
    breaks = lambda b: F.octet_length(b) - F.octet_length(F.replace(F.decode(b, "UTF-8"), F.lit("\n"), F.lit("")))
    sound = (start >= 0) & (start < end) & (end <= F.octet_length(raw)) & ~F.coalesce(inside(start), F.lit(False)) & ~F.coalesce(inside(end), F.lit(False))
    first = breaks(part(F.lit(0), start)) + 1
    # A line break as the last byte belongs to the line that it ends.
    last = breaks(part(F.lit(0), end - F.when(part(end - 1, F.lit(1)) == F.lit(b"\n"), 1).otherwise(0))) + 1
    lines = F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")
    return F.when(sound, F.struct(first.cast("bigint").alias("first_line"), last.cast("bigint").alias("last_line"), lines.alias("text")))
