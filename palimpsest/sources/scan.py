"""Source trees, exports with audit, NDJSON, control records and validated fact batches."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import normal_path
from palimpsest.session import list_names, read_text, write_once

PLACE = ["repository_id", "worktree_id"]


def _extension_in(path: Column, extensions: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin([e.lower() for e in extensions])


def scan_tree(spark: SparkSession, root: str, extensions: list[str], ignored: list[str] = ()) -> DataFrame:
    """(path, content_hash, size_bytes, content) of the files under a root with an extension, ignore patterns (regex) left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + base.replace(".", r"\."), "")
    rows = files.select(path.alias("path"), "content", F.col("length").alias("size_bytes")).where(_extension_in(F.col("path"), extensions))
    for pattern in ignored:
        rows = rows.where(~F.col("path").rlike(pattern))
    return rows.select("path", F.sha2("content", 256).alias("content_hash"), "size_bytes", "content").orderBy("path")


def inventory(rows: DataFrame, path: str, text: str, extensions: list[str]) -> DataFrame:
    """The same inventory from a table that holds texts; unusable paths and other extensions are left out."""
    return rows.select(normal_path(F.col(path)).alias("path"), F.encode(F.col(text), "UTF-8").alias("content")).where(
        F.col("path").isNotNull() & F.col("content").isNotNull() & _extension_in(F.col("path"), extensions)
    ).select("path", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("bigint").alias("size_bytes"))


def scan_metrics(rows: DataFrame, path: str, text: str, extensions: list[str]) -> DataFrame:
    """Entries visited, files read and their bytes."""
    read = F.coalesce(_extension_in(F.col(path), extensions) & F.col(text).isNotNull(), F.lit(False))
    return rows.agg(
        F.count("*").alias("visited"), F.sum(F.when(read, 1).otherwise(0)).alias("read"),
        F.sum(F.when(read, F.octet_length(text)).otherwise(0)).cast("bigint").alias("bytes"),
    )


def ndjson(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(section, id, line): one JSON line per record. parts: (record name, rows, id column); null fields are left out."""
    out = None
    for i, (name, rows, key) in enumerate(parts):
        line = F.to_json(F.struct(F.lit(name).alias("record"), *[F.col(c) for c in rows.columns]))
        part = rows.select(F.lit(i).alias("section"), F.col(key).cast("string").alias("id"), line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def write_ndjson(lines: DataFrame, path: str) -> None:
    """Text files in the order of (section, id), with a footer of counts in the folder's manifest."""
    lines.orderBy("section", "id").select("line").write.text(path)
    counts = {str(r["section"]): r["count"] for r in lines.groupBy("section").count().collect()}  # one row per section
    write_once(lines.sparkSession, f"{path}/_manifest.json", json.dumps({"counts": counts}))


def export_parquet(rows: DataFrame, path: str, schema_version: int = 2) -> dict:
    """Write rows, then a checksum of each file, and last a manifest with counts and schema. An export that has its manifest is kept."""
    spark = rows.sparkSession
    if found := read_text(spark, f"{path}/manifest.json"):
        return json.loads(found)
    rows.write.mode("overwrite").parquet(f"{path}/data")
    _checksums(spark, f"{path}/data").write.mode("overwrite").parquet(f"{path}/checksums")
    total = spark.read.parquet(f"{path}/checksums").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    manifest = {"schema_version": schema_version, "rows": total["rows"], "files": total["files"], "columns": rows.dtypes}
    write_once(spark, f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def _checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, first, second): for each file its rows and two digests of what they hold, in whatever order.

    Files are read as rows by as many tasks as they have splits, never whole in one cell.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"))
    data = spark.read.parquet(path)
    digest = lambda seed: F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in data.columns])
    held = data.select(F.col("_metadata.file_name").alias("name"), digest(1).alias("a"), digest(2).alias("b"))
    sums = held.groupBy("name").agg(F.count("*").alias("rows"), F.bit_xor("a").alias("first"), F.sum(F.col("b").bitwiseAND(0xFFFFFFFF)).alias("second"))
    return names.join(sums, "name", "left").select("name", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second"))


def audit_export(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with an export: missing manifest, unreadable files, other files, other contents, other count or columns. Empty if nothing is.

    Only what is wrong comes to the driver.
    """
    text = read_text(spark, f"{path}/manifest.json")
    if text is None:
        return ["no manifest"]
    try:
        return _differences(spark, path, json.loads(text))
    except (PySparkException, Py4JJavaError) as e:
        # The schema is read from some file before any row is, so that a damaged one can show at any step.
        return [f"unreadable: {str(e).splitlines()[0]}"]


def _differences(spark: SparkSession, path: str, m: dict) -> list[str]:
    data = spark.read.parquet(f"{path}/data")
    if [list(c) for c in data.dtypes] != [list(c) for c in m["columns"]]:
        return ["columns"]
    then, now = spark.read.parquet(f"{path}/checksums"), _checksums(spark, f"{path}/data")
    values = lambda d, n: d.select("name", F.struct("rows", "first", "second").alias(n))
    both = values(then, "then").join(values(now, "now"), "name", "full_outer")
    what = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unknown").when(F.col("then") != F.col("now"), "changed")
    out = [f"{r['what']} {r['name']}" for r in both.select("name", what.alias("what")).where("what is not null").orderBy("what", "name").collect()]
    whole = then.agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    if not out and (whole["files"], whole["rows"]) != (m["files"], m["rows"]):
        out.append("row count")
    return out


class Records:
    """Small control records by key, one file each: read, prefix scans, pages, last, and compare-and-exchange by version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, key: str) -> list[str]:
        return [n for n in list_names(self.spark, f"{self.root}/{key.encode().hex()}") if n.endswith(".json")]

    def read(self, key: str) -> tuple[int, str | None]:
        """(version, value); version 0 and None if there is no record."""
        names = self._versions(key)
        if not names:
            return 0, None
        return int(names[-1][:-5]), json.loads(read_text(self.spark, f"{self.root}/{key.encode().hex()}/{names[-1]}"))

    def compare_exchange(self, key: str, version: int, value: str) -> bool:
        """Write the value if the record still has the version; only one of several writers can."""
        if self.read(key)[0] != version:
            return False
        return write_once(self.spark, f"{self.root}/{key.encode().hex()}/{version + 1:012d}.json", json.dumps(value))

    def keys(self, prefix: str = "", after: str = "", limit: int | None = None) -> list[str]:
        names = sorted(bytes.fromhex(n).decode() for n in list_names(self.spark, self.root))
        found = [k for k in names if k.startswith(prefix) and k > after]
        return found if limit is None else found[:limit]

    def last(self, prefix: str) -> str | None:
        found = self.keys(prefix)
        return found[-1] if found else None


class RecordTable:
    """Records by key at any number: batches of (key, value) under one folder, each visible by its commit; the last write of a key holds.

    Reads are DataFrames: prefix scans, pages in key order and the last key of a prefix are filters on the key.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self) -> list[str]:
        return [n for n in list_names(self.spark, f"{self.root}/commits") if n.endswith(".json")]

    def put(self, rows: DataFrame) -> int:
        """Write a batch, each key once (of several values of one key the greatest). Gives the batch's number; raises if another writer took it."""
        number, name = len(self._batches()) + 1, uuid.uuid4().hex[:12]
        rows.groupBy("key").agg(F.max("value").alias("value")).where(F.col("key").isNotNull()).withColumn("batch", F.lit(number)).write.parquet(f"{self.root}/data/{name}")
        if not write_once(self.spark, f"{self.root}/commits/{number:08d}.json", json.dumps({"data": name})):
            raise RuntimeError(f"batch {number} was committed by another writer")
        return number

    def scan(self, prefix: str = "", after: str | None = None) -> DataFrame:
        """(key, value, batch) of the records whose key begins with a prefix and comes after another key."""
        names = [json.loads(read_text(self.spark, f"{self.root}/commits/{n}"))["data"] for n in self._batches()]
        if not names:
            return self.spark.createDataFrame([], "key string, value string, batch int")
        rows = self.spark.read.parquet(*[f"{self.root}/data/{n}" for n in names]).where(F.col("key").startswith(prefix))
        if after is not None:
            rows = rows.where(F.col("key") > after)
        return rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"), F.max("batch").alias("batch"))

    def page(self, prefix: str, limit: int, after: str | None = None) -> DataFrame:
        return self.scan(prefix, after).orderBy("key").limit(limit)

    def last(self, prefix: str) -> str | None:
        return self.scan(prefix).agg(F.max("key").alias("k")).first()["k"]


def observation_nodes(observations: DataFrame, granted: list[str], namespace: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): validated observations as nodes whose id is a digest of their content, so a repeat is the same node.

    observations: subject, relation, object, observed_at_nanos, producer_namespace. Rejected rows have a reason.
    """
    reason = (
        F.when(F.col("producer_namespace") != namespace, "namespace")
        .when(~F.col("relation").isin(granted), "capability")
        .when(F.col("subject").isNull() | F.col("object").isNull(), "incomplete")
        .when(F.col("observed_at_nanos").isNull() | (F.col("observed_at_nanos") < 0), "time")
    )
    judged = observations.withColumn("reason", reason)
    content = F.concat_ws("|", "producer_namespace", "subject", "relation", "object", F.col("observed_at_nanos").cast("string"))
    accepted = judged.where(F.col("reason").isNull()).select(
        F.sha2(content, 256).alias("node_id"), F.lit("RuntimeObservation").alias("kind"), "subject", "relation", "object", "observed_at_nanos"
    ).distinct()
    return accepted, judged.where(F.col("reason").isNotNull())
