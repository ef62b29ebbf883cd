"""Source files that do not parse (problem 1).

Each distinct content is lexed into rows of tokens once, whatever the number of versions that have it. Then three checks
run as relational steps over the tokens:

1. adjacent pairs of token classes are anti-joined against the pairs that the language's grammar permits (computed
   from the FIRST and LAST sets of its productions);
2. brackets are matched by windowed reductions: a running depth, and within each depth the kind of the bracket before;
3. a running count of statement ends at depth 0 groups the tokens into top-level statements, each reduced to its shape
   (the sequence of its token classes); every distinct shape is derived from the grammar's productions once.

A content fails if any check does. All languages go the same way; indentation of Python comes as tokens.

Contents are brought together once, before they are lexed. Tokens are written in buckets by content, so that none of the checks
shuffles them.

Edge cases: null text or path, other extensions and empty or blank text give no case; contents shared by several
versions flag each of them; a repeated row counts once in found and in rates; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.documents import spread
from palimpsest.llm.syntax import rules
from palimpsest.llm.syntax.lexers import lex
from palimpsest.session import delete, discard, materialize, scratch_path

#: Extension to language.
EXTENSIONS = {
    "rs": "rust", "py": "python", "ts": "typescript", "js": "javascript", "mjs": "javascript", "sh": "bash", "bash": "bash",
}
#: Bytes of a diagnostic's message that are kept.
MESSAGE_BYTES = 4096
#: Bytes of text whose tokens a bucket should hold, and Spark's own limit of their number.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 100_000
KEY = ["lang", "content"]
_TOKENS = "lang string, content binary, pos int, prev string, cls string, nest int, kind string, ends boolean"


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), extension)


def in_language(files: DataFrame) -> DataFrame:
    """Files with a text in a known language."""
    return files.withColumn("lang", language_of(F.col("normalized_path"))).where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def keyed(files: DataFrame) -> DataFrame:
    """Files in a known language, with the key of their content."""
    return in_language(files).withColumn("content", F.unhex(F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, 32)))


def tokens(contents: DataFrame) -> DataFrame:
    """A row per token of each (lang, content, text), in order of ``pos``, with the class before it; the last row is ``$``."""

    def lexed(batches):
        for batch in batches:
            for lang, content, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = lex(lang, text)
                n = len(t.cls) + 1
                columns = [
                    pa.array([lang] * n), pa.array([content] * n, pa.binary()), pa.array(range(n), pa.int32()),
                    pa.array(["^", *t.cls]), pa.array([*t.cls, "$"]), pa.array([*t.nest, 0], pa.int32()),
                    pa.array([*t.kind, ""]), pa.array([*t.end, False]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "content", "pos", "prev", "cls", "nest", "kind", "ends"])

    return contents.select(*KEY, "text").mapInArrow(lexed, _TOKENS)


class TokenTable:
    """The tokens of all distinct contents, in a table bucketed by content."""

    def __init__(self, files: DataFrame):
        self.spark = files.sparkSession
        # The number of buckets follows the bytes of text, and is that of the cores at least, so that small inputs are spread too.
        size = in_language(files).agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        width = min(max(math.ceil(size / BUCKET_BYTES), self.spark.sparkContext.defaultParallelism), MOST_BUCKETS)
        self.path, self.name = scratch_path(self.spark, "tokens"), f"palimpsest_{uuid.uuid4().hex}"
        contents = keyed(files).groupBy(*KEY).agg(F.first("text").alias("text")).repartition(width, *KEY)
        # The contents of a task are those of one bucket, so that it writes one file.
        rows = tokens(contents).write.format("parquet").bucketBy(width, *KEY)
        rows.option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        delete(self.spark, self.path)


def bad_pairs(found: DataFrame) -> DataFrame:
    """Adjacent tokens that the grammar never puts next to each other."""
    permitted = [(lang, a, b) for lang in rules.LANGUAGES for a, b in sorted(rules.grammar(lang).pairs())]
    table = found.sparkSession.createDataFrame(permitted, "lang string, prev string, cls string")
    # The table's size is that of the grammars, whatever the data.
    bad = found.join(F.broadcast(table), ["lang", "prev", "cls"], "left_anti")
    message = F.when(F.col("cls") == "conflict", "marker of an unresolved merge").otherwise(
        F.concat(F.lit("unexpected `"), F.col("cls"), F.lit("` after `"), F.col("prev"), F.lit("`"))
    )
    return bad.select(*KEY, "pos", message.alias("message"))


def bad_nesting(found: DataFrame) -> DataFrame:
    """Brackets without a partner. At one depth, openers and closers must take turns and agree in kind."""
    order = Window.partitionBy(*KEY).orderBy("pos")
    brackets = (
        found.where("nest <> 0")
        .select(*KEY, "pos", "nest", "kind", F.sum("nest").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("d"))
        .withColumn("depth", F.when(F.col("nest") > 0, F.col("d")).otherwise(F.col("d") + 1))
    )
    level = Window.partitionBy(*KEY, "depth").orderBy("pos")
    seen = brackets.select(
        *KEY, "pos", "nest", "kind", "depth",
        F.lag("nest").over(level).alias("nest_before"), F.lag("kind").over(level).alias("kind_before"),
        F.lead("nest").over(level).alias("nest_after"),
    )
    unclosed = (F.col("nest") > 0) & F.coalesce(F.col("nest_after") > 0, F.lit(True))
    unopened = (F.col("nest") < 0) & (
        (F.col("depth") <= 0) | F.coalesce(F.col("nest_before") < 0, F.lit(True)) | (F.col("kind") != F.col("kind_before"))
    )
    what = F.when(unclosed, F.lit("nothing closes `")).otherwise(F.lit("nothing opened what closes `"))
    return seen.where(unclosed | unopened).select(*KEY, "pos", F.concat(what, F.col("kind"), F.lit("`")).alias("message"))


def statements(found: DataFrame) -> DataFrame:
    """(lang, content, pos, shape): the top-level statements, by a running depth and a running count of ends at depth 0."""
    order = Window.partitionBy(*KEY).orderBy("pos")
    depth = F.sum("nest").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ended = F.when(F.col("ends") & (F.col("depth") <= 0), 1).otherwise(0)
    numbered = (
        found.where("cls <> '$'")
        .select(*KEY, "pos", "ends", "cls", depth.alias("depth"))
        .select(*KEY, "pos", "cls", F.coalesce(F.sum(ended).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    )
    return numbered.groupBy(*KEY, "n").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cls"))), lambda x: x["cls"]), " ").alias("shape"),
    ).select(*KEY, "pos", "shape")


def bad_statements(all_: DataFrame) -> DataFrame:
    """Statements whose shape the grammar cannot produce."""

    def judged(batches):
        grammars = {lang: rules.grammar(lang) for lang in rules.LANGUAGES}
        for batch in batches:
            langs, shapes = (batch.column(i).to_pylist() for i in range(2))
            yield batch.filter(pa.array([not grammars[lang].accepts(s.split()) for lang, s in zip(langs, shapes)], pa.bool_()))

    bad = spread(all_.select("lang", "shape").distinct()).mapInArrow(judged, "lang string, shape string")
    return all_.join(bad, ["lang", "shape"], "left_semi").select(*KEY, "pos", F.lit("no statement has this form").alias("message"))


def failing_contents(files: DataFrame) -> DataFrame:
    """(lang, content, pos, message): the first problem of each content that does not parse."""
    table = TokenTable(files)
    said = materialize(statements(table.rows), "statements")
    problems = bad_pairs(table.rows).unionByName(bad_nesting(table.rows)).unionByName(bad_statements(said))
    first = problems.groupBy(*KEY).agg(F.min(F.struct("pos", "message")).alias("p")).select(*KEY, "p.pos", "p.message")
    first = materialize(first, "problems")
    table.drop()
    discard(said)
    return first


def diagnostics(files: DataFrame) -> DataFrame:
    """(repository_id, worktree_id, file_id, valid_from_sequence, lang, message, truncated) of each version that does not parse."""
    full = F.concat(F.lit("token "), F.col("pos").cast("string"), F.lit(": "), F.col("message"))
    # Cut by bytes; a character that the cut would break goes whole.
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(full, "UTF-8"), 1, MESSAGE_BYTES).cast("string")), "\ufffd+$", "")
    return (
        keyed(files)
        .select("repository_id", "worktree_id", "file_id", "valid_from_sequence", *KEY)
        .join(failing_contents(files), KEY)
        .select(
            "repository_id", "worktree_id", "file_id", "valid_from_sequence", "lang",
            F.when(F.octet_length(full) > MESSAGE_BYTES, cut).otherwise(full).alias("message"), (F.octet_length(full) > MESSAGE_BYTES).alias("truncated"),
        )
        .distinct()
    )


def rates(files: DataFrame) -> DataFrame:
    """Versions and failing versions by repository and language."""
    version = ["repository_id", "worktree_id", "file_id", "valid_from_sequence"]
    bad = failing_contents(files).select(*KEY, F.lit(1).alias("bad"))
    return (
        keyed(files)
        .select(*version, *KEY)
        .distinct()
        .join(bad, KEY, "left")
        .groupBy("repository_id", "lang")
        .agg(F.count("*").alias("versions"), F.count("bad").alias("failing"))
        .withColumn("rate", F.col("failing") / F.col("versions"))
    )
