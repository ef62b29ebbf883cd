"""Applying a stream of inserts, updates and deletes (problem 7).

The current state lives in hash buckets under one folder. Applying a part of the feed

1. reduces it to one deciding change per fact, before and after the shuffle, and routes these to buckets: a staged folder,
   bucketed and sorted like the table;
2. sort-merges the touched buckets only, base with staged changes bucket by bucket, without moving the base, and writes
   replacement files; a touched bucket that has no base yet takes the staged files as they are;
3. commits a manifest that names, for each bucket, the folder that now holds it.

Untouched buckets are not read and keep their folders; readers follow the last manifest, so a failed run is never seen.

The deciding change of a fact is the greatest (generation_sequence, change_id, revision): this
takes the highest revision of each change_id, since all revisions of it lie in one generation, and
then the change of the greatest generation. Removed facts stay in their bucket as tombstones,
so that a late change of an older generation cannot bring them back.

Facts are hashed, and a fact has one row in the table, so buckets are of like size whatever the feed repeats. Their number
is taken from the size of the first part, and doubled, with a full rewrite, once buckets have grown ``GROWTH`` fold.

Edge cases: repeated deliveries are equal in that order and count once; rows with a null fact_id,
fact_kind or generation_sequence cannot be ordered or named and are left out; unknown kinds
are left out; a null repository or worktree is a place of its own, other than the empty name; an empty feed commits a manifest
without buckets; null arrivals belong to the first part.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import delete, list_names, read_text, scratch_path, write_once

FACT = ["repository_id", "worktree_id", "fact_kind", "fact_id"]
PLACE = FACT[:2]
ORDER = ["generation_sequence", "change_id", "revision"]
VALUES = ["kind", "name", "content_hash", "size_bytes"]
KINDS = ["Added", "Updated", "Removed"]
#: In the files no column of the key is null: ``place_nulls`` says which of the place's two were, so that buckets join by equality.
KEY = ["place_nulls", *FACT]
#: Facts that a bucket holds when the table is laid out, how often over it may grow, and Spark's own limit of their number.
BUCKET_ROWS, GROWTH, MOST_BUCKETS = 200_000, 4, 100_000


def deciding_changes(feed: DataFrame, values: list[str] = VALUES) -> DataFrame:
    """One row per fact: its greatest change by ORDER, with its values."""
    usable = feed.where(
        F.col("fact_id").isNotNull()
        & F.col("fact_kind").isNotNull()
        & F.col("generation_sequence").isNotNull()
        & F.col("kind").isin(KINDS)
    )
    return usable.groupBy(*FACT).agg(F.max(F.struct(*ORDER, *values)).alias("c")).select(*FACT, "c.*")


def _bucket(width: int) -> Column:
    """The bucket of a row of KEY, as Spark's own bucketed files have it."""
    return F.pmod(F.hash(*KEY), F.lit(width))


class BucketedTable:
    """Copy-on-write buckets of the facts' deciding changes under one folder.

    ``data/<write>/bucket=B`` holds files, ``manifests/N.json`` the folder of each bucket. ``buckets`` fixes their first number.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, values: list[str] = VALUES, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.buckets, self.values, self.bucket_rows = spark, root.rstrip("/"), buckets, values, bucket_rows

    def manifest(self) -> dict:
        names = [n for n in list_names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": {}, "width": self.buckets}
        return json.loads(read_text(self.spark, f"{self.root}/manifests/{names[-1]}"))

    def _rows_of(self, m: dict) -> DataFrame | None:
        paths = [f"{self.root}/{at}" for at in m["buckets"].values()]
        if not paths:
            return None
        names = [F.when((F.col("place_nulls").bitwiseAND(1 << i)) == 0, F.col(c)).alias(c) for i, c in enumerate(PLACE)]
        return self.spark.read.parquet(*paths).select(*names, *FACT[2:], "c.*")

    def rows(self) -> DataFrame | None:
        """All present rows, tombstones included. None if there is no file."""
        return self._rows_of(self.manifest())

    def current(self) -> DataFrame | None:
        """The facts that exist."""
        rows = self.rows()
        return None if rows is None else rows.where(F.col("kind") != "Removed")

    def _write(self, rows: DataFrame, width: int) -> dict[str, str]:
        """Bucketed, sorted files of (KEY, c); the folder of each bucket written."""
        write, name = f"data/{uuid.uuid4().hex[:12]}", f"palimpsest_{uuid.uuid4().hex}"
        out = rows.select(*KEY, "c").withColumn("bucket", _bucket(width)).write.format("parquet")
        try:
            out.partitionBy("bucket").bucketBy(width, *KEY).sortBy(*KEY).option("path", f"{self.root}/{write}").saveAsTable(name)
        finally:
            # The catalog's entry only; the files are found by the manifest.
            self.spark.sql(f"drop table if exists {name}")
        names = [n for n in list_names(self.spark, f"{self.root}/{write}") if n.startswith("bucket=")]
        return {n.partition("=")[2]: f"{write}/{n}" for n in names}

    def _bucketed(self, folders: dict[str, str], width: int, like: DataFrame) -> tuple[DataFrame, str]:
        """The buckets in some folders as a bucketed table (with its name), so that a join of two such shuffles neither."""
        name = f"palimpsest_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        self.spark.sql(
            f"create table {name} ({columns}, bucket int) using parquet partitioned by (bucket) "
            f"clustered by ({', '.join(KEY)}) sorted by ({', '.join(KEY)}) into {width} buckets location '{self.root}/none'"
        )
        parts = [f"partition (bucket={b}) location '{self.root}/{at}'" for b, at in folders.items()]
        for i in range(0, len(parts), 500):
            self.spark.sql(f"alter table {name} add {' '.join(parts[i : i + 500])}")
        return self.spark.table(name), name

    def _routed(self, changes: DataFrame, width: int) -> DataFrame:
        nulls = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(PLACE)), F.lit(0))
        named = changes.select(nulls.cast("int").alias("place_nulls"), *[F.coalesce(c, F.lit("")).alias(c) for c in FACT], F.struct(*ORDER, *self.values).alias("c"))
        return named.repartition(width, *KEY)

    def merged(self, base: dict[str, str], staged: dict[str, str], width: int, like: DataFrame) -> tuple[DataFrame, list[str]]:
        """(KEY, c) of the touched buckets after the staged changes, by a sort-merge join of the two; and the names to drop."""
        b, b_name = self._bucketed(base, width, like)
        s, s_name = self._bucketed(staged, width, like)
        both = b.select(*KEY, "c").join(s.select(*KEY, F.col("c").alias("d")).hint("merge"), KEY, "full_outer")
        return both.select(*KEY, F.greatest("c", "d").alias("c")), [b_name, s_name]

    def apply(self, feed: DataFrame) -> int:
        """Merge a feed into the touched buckets and commit. Gives the new version.

        Raises if another writer has committed the same version meanwhile.
        """
        m = self.manifest()
        changes = deciding_changes(feed, self.values)
        width = m["width"]
        if not width:
            # Rows of the feed bound those of its facts; a count reads no column.
            width = self._width(feed.count())
        if m["buckets"]:
            rows = self._rows_of(m)
            if (n := rows.count()) > GROWTH * self.bucket_rows * width:
                width = self._width(n)
                m = m | {"buckets": self._write(self._routed(rows, width), width)}
        routed = self._routed(changes, width)
        staged = self._write(routed, width)
        meet = {b: at for b, at in staged.items() if b in m["buckets"]}
        new = {b: at for b, at in staged.items() if b not in m["buckets"]}
        if meet:
            rows, names = self.merged({b: m["buckets"][b] for b in meet}, meet, width, routed)
            try:
                new |= self._write(rows, width)
            finally:
                for name in names:
                    self.spark.sql(f"drop table if exists {name}")
            for at in meet.values():
                delete(self.spark, f"{self.root}/{at}")
        after = {"version": m["version"] + 1, "width": width, "buckets": m["buckets"] | new}
        if not write_once(self.spark, f"{self.root}/manifests/{after['version']:08d}.json", json.dumps(after)):
            raise RuntimeError(f"version {after['version']} was committed by another writer")
        return after["version"]

    def _width(self, rows: int) -> int:
        return min(max(1, math.ceil(rows / self.bucket_rows)), MOST_BUCKETS)

    def vacuum(self) -> None:
        """Delete the folders that the last manifest does not name. Only where no reader is on an older version and no writer at work."""
        live = {at.partition("/bucket=")[0] for at in self.manifest()["buckets"].values()}
        for name in list_names(self.spark, f"{self.root}/data"):
            if f"data/{name}" not in live:
                delete(self.spark, f"{self.root}/data/{name}")


#: Into how many parts by arrival a whole feed is cut.
PARTS = 3


def parts_by_arrival(feed: DataFrame, parts: int = PARTS, arrival: str = "arrived_at") -> list[DataFrame]:
    """The feed in parts of about equal size in the order of arrival; together they hold every row once."""
    shares = [i / parts for i in range(1, parts)]
    cuts = feed.agg(F.percentile_approx(arrival, F.lit(shares)).cast("array<string>").alias("q")).first()["q"] if shares else None
    cuts, kind, out, low = list(dict.fromkeys(cuts or [])), dict(feed.dtypes)[arrival], [], None
    for cut in [*cuts, None]:
        # Cast to the column's own type, so that no time zone comes in.
        part = feed if cut is None else feed.where((F.col(arrival) <= F.lit(cut).cast(kind)) | F.col(arrival).isNull())
        out.append(part if low is None else part.where(F.col(arrival) > F.lit(low).cast(kind)))
        low = cut
    return out


def current_facts(feed: DataFrame, buckets: int | None = None, root: str | None = None, parts: int = PARTS) -> DataFrame:
    """The facts that exist after all changes of ``feed``, each with its deciding change.

    The feed is applied as it came, in ``parts`` commits by arrival, so that later parts are merged with what earlier ones left.
    """
    spark = feed.sparkSession
    table = BucketedTable(spark, root or scratch_path(spark, "facts"), buckets)
    for part in parts_by_arrival(feed, parts):
        table.apply(part)
        if root is None:
            table.vacuum()
    found = table.current()
    return deciding_changes(feed).where("false") if found is None else found
