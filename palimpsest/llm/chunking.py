"""Splitting oversized items at natural boundaries (problem 2).

A document is oversized if the UTF-8 bytes of its text and of the non-null elements of its context
exceed ``max_bytes`` of its profile. Its text is cut into pieces that fit with the context; a piece
ends at the end of a paragraph, else of a line, else of a sentence, else of a word, and
begins up to ``overlap_bytes`` before the end of the piece before: at the first paragraph, line or sentence within that
reach, else at the first of the words that are marked, one every few.

Pointer doubling. Every boundary is joined to its farthest legal successor, the start of the next piece
(as-of lookups by a merge of boundaries and probes in one sorted window). The successor table is
then squared again and again: after k squarings it jumps 2**k pieces, so the starts reached double
with each round and all cuts of all documents are found in log2(pieces) rounds.

Edge cases: null text has no pieces; empty text is one empty piece; a document whose profile is null or
unknown has no limit and stays whole; null elements of a context count nothing and are left out;
if a context leaves no room for a run of the text (96 bytes, or the whole of a shorter text), the outermost
elements are left out of the pieces until there is, and ``left_out`` counts them; a stretch without any boundary is cut between
characters, never inside one; nulls in overlap_bytes count as 0; extra columns are dropped.
A repeated doc_id is one document and a null one is none. A document of a profile whose max_bytes is under 512 stays whole and is
``refused``, since a piece could not be sure to hold a run beside its overlap.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.llm.documents import unique_documents
from palimpsest.session import discard, materialize

#: A natural boundary is the end of a line or of a sentence.
NATURAL = r"(?<=\n)|(?<=[.!?…][ \t])|(?<=[。！？])"
#: A few words: from a word's start at least 15 characters, up to the next white space.
WORDS = r"(?s).{1,15}\z|.{15,}?(?:\s+|\z)"
#: A run of characters that is cut for want of white space; marks stay with their letter.
RUN = r"(?s).{1,16}\p{M}{0,8}"

#: The most bytes of a RUN: 24 characters of 4.
RUN_BYTES = 96
#: A quarter of it must hold a run.
LEAST_BYTES = 512

PARAGRAPH, LINE, SENTENCE, INNER = 3, 2, 1, 0


def text_bytes(c: Column) -> Column:
    return F.octet_length(c)


def context_bytes(context: Column) -> Column:
    return F.aggregate(
        F.coalesce(context, F.array().cast("array<string>")),
        F.lit(0).cast("bigint"),
        lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)),
    )


def _kept_context(context: Column, most: Column) -> Column:
    """The longest tail of the non-null elements whose bytes are at most ``most``."""
    full = F.filter(F.coalesce(context, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.filter(full, lambda x, i: context_bytes(F.slice(full, i + 1, F.greatest(F.size(full), F.lit(1)))) <= most)


def sized(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, text, kept, left_out, room, overlap, oversized, refused): what a piece of each document may hold."""
    # Written first, so that the planner knows their size when it chooses the join.
    limits = materialize(
        profiles.groupBy("profile").agg(
            F.min("max_bytes").alias("max_bytes"), F.max(F.coalesce("overlap_bytes", F.lit(0))).alias("overlap")
        ), "profiles"
    )
    d = documents.select("doc_id", "text", "context", "profile").where(F.col("text").isNotNull())
    d = d.join(limits, "profile", "left")
    over = F.coalesce(text_bytes(F.col("text")) + context_bytes(F.col("context")) > F.col("max_bytes"), F.lit(False))
    fits = F.coalesce(F.col("max_bytes"), F.lit(2**31 - 1)).cast("bigint")
    # A context that leaves room for a run of the text, or for all of it, stays whole.
    kept = _kept_context(F.col("context"), fits - F.least(text_bytes(F.col("text")), F.lit(RUN_BYTES)))
    given = F.size(F.filter(F.coalesce("context", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    small = F.coalesce(F.col("max_bytes") < LEAST_BYTES, F.lit(False))
    d = d.withColumn("oversized", over).withColumn("refused", over & small)
    d = d.withColumn("kept", F.when(F.col("refused"), _kept_context(F.col("context"), F.lit(2**62))).otherwise(kept))
    return d.select(
        "doc_id", "text", "kept", (given - F.size("kept")).alias("left_out"), (fits - context_bytes(F.col("kept"))).alias("room"), F.col("overlap").cast("bigint"), "oversized", "refused"
    )


def boundaries(items: DataFrame) -> DataFrame:
    """(doc_id, at, level, room, overlap): every place where a text may be cut, in bytes, 0 and the end included."""
    fine = F.floor(F.col("room") / 4)
    # Every few words inside stretches that an overlap could not go back over whole, or that are long beside the room.
    by = F.when(F.col("overlap") > 0, F.least(fine, "overlap")).otherwise(fine)
    natural = F.split("text", NATURAL, -1)
    by_word = F.flatten(
        F.transform(natural, lambda s: F.when(F.octet_length(s) > by, F.regexp_extract_all(s, F.lit(WORDS), F.lit(0))).otherwise(F.array(s)))
    )
    pieces = F.flatten(
        F.transform(
            by_word,
            lambda s: F.when(F.octet_length(s) > fine, F.regexp_extract_all(s, F.lit(RUN), F.lit(0))).otherwise(F.array(s)),
        )
    )
    segs = items.select("doc_id", "room", "overlap", F.posexplode(pieces).alias("i", "seg")).where(
        F.octet_length("seg") > 0
    )
    by = Window.partitionBy("doc_id").orderBy("i")
    blank = F.col("seg").rlike(r"^[ \t\r]*\n$")
    level = (
        F.when(blank, PARAGRAPH)
        .when(F.col("seg").endswith("\n"), LINE)
        .when(F.col("seg").rlike(r"[.!?…][ \t]$|[。！？]$"), SENTENCE)
        .otherwise(INNER)
    )
    cuts = segs.select(
        "doc_id", "room", "overlap", level.alias("level"), F.sum(F.octet_length("seg")).over(by).cast("bigint").alias("at")
    )
    zero = items.select(
        "doc_id", "room", "overlap", F.lit(PARAGRAPH).alias("level"), F.lit(0).cast("bigint").alias("at")
    )
    return cuts.unionByName(zero)


def successors(cuts: DataFrame) -> DataFrame:
    """(doc_id, s, e, nxt): the farthest legal end of a piece that starts at s, and where the next piece starts.

    ``nxt`` is null for a piece that ends with the text. Ends are looked up with a probe at s + room, starts with a
    probe at e - overlap; probes are merged with the boundaries by a sort within the document. Each boundary carries its own
    probes along, so that all of it stays where its document is, and every look-up is a running minimum or maximum.
    """
    cuts = cuts.withColumn("total", F.max("at").over(Window.partitionBy("doc_id")))
    far = F.col("at") + F.col("room")
    rows = cuts.select("doc_id", "room", "overlap", "total", "level", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("probe"))
    rows = rows.withColumn("key", F.when(F.col("probe") == 1, far).otherwise(F.col("at")))
    upto = Window.partitionBy("doc_id").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, 0)

    def last(level: int) -> Column:
        return F.max(F.when((F.col("probe") == 0) & (F.col("level") >= level), F.col("at"))).over(upto)

    found = rows.select(
        "doc_id", "room", "overlap", "total", "probe", "level", F.col("at").alias("s"),
        last(PARAGRAPH).alias("paragraph"), last(LINE).alias("line"), last(SENTENCE).alias("sentence"), last(INNER).alias("any"),
    ).where(F.col("probe") == 1)
    # An end must lie past the overlap, or the next piece could end where this one does.
    half = F.col("s") + F.greatest(F.col("overlap"), F.floor(F.col("room") / 2))
    quarter = F.col("s") + F.greatest(F.col("overlap"), F.floor(F.col("room") / 4))
    end = (
        F.when(F.col("any") == F.col("total"), F.col("total"))
        .when(F.col("paragraph") > half, F.col("paragraph"))
        .when(F.col("line") > half, F.col("line"))
        .when(F.col("sentence") > quarter, F.col("sentence"))
        .otherwise(F.col("any"))
    )
    # Every boundary as a mark, and, but for the text's end, the end of the piece that starts there.
    kinds = F.array(F.lit(1), F.when(F.col("s") < F.col("total"), 2))
    ends = found.select("doc_id", "room", "overlap", "total", "level", "s", end.alias("e"), F.explode(F.array_compact(kinds)).alias("kind"))
    ends = ends.withColumn("key", F.when(F.col("kind") == 1, F.col("s")).otherwise(F.col("e")))
    down = Window.partitionBy("doc_id").orderBy(F.desc("key"), F.desc("kind"))
    mark = F.when(F.col("kind") == 1, F.col("key"))
    following = F.min(mark).over(down.rowsBetween(Window.unboundedPreceding, -1))
    # The start after e: of the boundaries at or after both e - overlap and (next boundary after e) - room the first that is natural and lies
    # before e, else the first of any kind.
    least = F.greatest(F.col("e") - F.col("overlap"), F.coalesce("following", "e") - F.col("room"))
    probes = ends.withColumn("following", following).select(
        "doc_id", "total", "level", "s", "e", F.when(F.col("kind") == 1, 1).otherwise(0).alias("kind"), F.when(F.col("kind") == 1, F.col("s")).otherwise(least).alias("key")
    )
    ahead = down.rowsBetween(Window.unboundedPreceding, 0)
    natural = F.min(F.when(F.col("level") > INNER, mark)).over(ahead)
    return (
        probes.select("*", F.min(mark).over(ahead).alias("b"), natural.alias("natural"))
        .where("kind = 0")
        .withColumn("b", F.when(F.col("natural") < F.col("e"), F.col("natural")).otherwise(F.least("b", "e")))
        .select("doc_id", "s", "e", F.when(F.col("e") < F.col("total"), F.col("b")).alias("nxt"))
    )


def reached_starts(table: DataFrame) -> DataFrame:
    """The starts reached from 0 by following ``nxt``: pointer doubling."""
    reached = table.where("s = 0").select("doc_id", "s")
    reached = materialize(reached, "starts")
    jump = materialize(table.where("nxt is not null").select("doc_id", "s", "nxt"), "jump")
    while not jump.isEmpty():
        step = reached.join(jump, ["doc_id", "s"]).select("doc_id", F.col("nxt").alias("s"))
        grown = materialize(reached.unionByName(step), "starts")
        a, b = jump.alias("a"), jump.alias("b")
        squared = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.nxt") == F.col("b.s"))).select(
            "a.doc_id", "a.s", "b.nxt"
        )
        squared = materialize(squared, "jump")
        discard(jump)
        discard(reached)
        reached, jump = grown, squared
    discard(jump)
    return reached


@F.pandas_udf(ArrayType(StringType()))
def _slices(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for t, s, e in zip(text, starts, ends):
        raw = memoryview(t.encode("utf-8"))
        out.append([bytes(raw[i:j]).decode("utf-8") for i, j in zip(s, e)])
    return pd.Series(out)


def split_documents(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, piece, pieces, start_byte, overlap, text, context, oversized, left_out, refused): every piece of every document, from 0.

    ``overlap`` is the number of bytes that a piece shares with the one before.
    """
    items = sized(unique_documents(documents), profiles)
    split_it = F.col("oversized") & ~F.col("refused") & (F.octet_length("text") > 0)
    whole = items.where(~split_it).select(
        "doc_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).cast("bigint").alias("start_byte"), F.lit(0).cast("bigint").alias("overlap"), "text",
        F.col("kept").alias("context"), "oversized", "left_out", "refused",
    )
    large = items.where(split_it)
    table = materialize(successors(boundaries(large)), "successors")
    starts = reached_starts(table)
    cuts = (
        starts.join(table, ["doc_id", "s"])
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    )
    cuts = materialize(cuts, "cuts")
    discard(starts)
    discard(table)
    cut = large.join(cuts, "doc_id").select("doc_id", "kept", "left_out", "cuts", _slices("text", F.col("cuts.s"), F.col("cuts.e")).alias("texts"))
    split = cut.select(
        "doc_id", "kept", "left_out", "cuts", F.size("texts").alias("pieces"), F.posexplode("texts").alias("piece", "text")
    )
    start = F.element_at("cuts", F.col("piece") + 1)["s"]
    before = F.when(F.col("piece") > 0, F.element_at("cuts", F.greatest(F.col("piece"), F.lit(1)))["e"] - start).otherwise(0)
    split = split.select(
        "doc_id", "piece", "pieces", start.alias("start_byte"), before.cast("bigint").alias("overlap"), "text", F.col("kept").alias("context"),
        F.lit(True).alias("oversized"), "left_out", F.lit(False).alias("refused"),
    )
    return whole.unionByName(split)
