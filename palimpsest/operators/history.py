"""History of facts: points in time, intervals, changes, lineage, acceptance and observation.

Facts come from version tables (file, provenance, node, edge). Rows are exact copies where a table
repeats them, so every reader starts from distinct rows. Sequences are read within (repository_id,
worktree_id). Validity is half-open and a null end is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["repository_id", "worktree_id"]
FACT = [*PLACE, "fact_kind", "fact_id"]

#: The families in the global fact order, with their tables and keys.
FAMILIES = [
    ("file", "file_versions", "file_id"),
    ("provenance", "provenance", "provenance_id"),
    ("node", "node_versions", "node_id"),
    ("edge", "edge_versions", "edge_id"),
]


def fact_order(kind: Column) -> Column:
    order = F.lit(None).cast("int")
    for i, (name, _, _) in reversed(list(enumerate(FAMILIES))):
        order = F.when(kind == name, i).otherwise(order)
    return order


def fact_versions(tables: dict[str, DataFrame]) -> DataFrame:
    """The four families as one feed: FACT, valid_from_sequence, valid_until_sequence; distinct."""
    out = None
    for kind, name, key in FAMILIES:
        t = tables[name]
        until = F.col("valid_until_sequence") if "valid_until_sequence" in t.columns else F.lit(None).cast("bigint")
        part = t.select(
            *PLACE, F.lit(kind).alias("fact_kind"), F.col(key).alias("fact_id"), "valid_from_sequence", until.alias("valid_until_sequence")
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def as_of(versions: DataFrame, sequence) -> DataFrame:
    """Versions valid at a sequence (a number or a column)."""
    at = sequence if isinstance(sequence, Column) else F.lit(sequence)
    return versions.where(
        (F.col("valid_from_sequence") <= at) & (F.col("valid_until_sequence").isNull() | (F.col("valid_until_sequence") > at))
    )


def current(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("valid_until_sequence").isNull())


def history_as_of(versions: DataFrame, sequence: int) -> DataFrame:
    """Versions started by a sequence; an end after it is still unknown then, so it is null."""
    until = F.when(F.col("valid_until_sequence") <= sequence, F.col("valid_until_sequence"))
    return versions.where(F.col("valid_from_sequence") <= sequence).withColumn("valid_until_sequence", until)


def page(rows: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """A keyset page: the first ``limit`` rows past ``after``, and one more if there is one, as a mark of more."""
    if after is not None:
        if len(after) != len(order):
            raise ValueError("the cursor belongs to another order")
        here = F.struct(*order)
        rows = rows.where(here > F.struct(*[F.lit(a).alias(c) for a, c in zip(after, order)]))
    return rows.orderBy(*order).limit(limit + 1)


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """The rows, or an error if there are more than the budget: never a part."""
    # A count, not a limit: a limit of this size would bring its rows to one task.
    if rows.count() > budget:
        raise RuntimeError(f"more than {budget} rows")
    return rows


def changed_at(versions: DataFrame, sequence: int) -> DataFrame:
    """Versions opened or closed at a sequence."""
    return versions.where((F.col("valid_from_sequence") == sequence) | (F.col("valid_until_sequence") == sequence)).withColumn(
        "opened", F.col("valid_from_sequence") == sequence
    )


def effective_changes(feed: DataFrame) -> DataFrame:
    """One row per change of a fact: the highest revision of each change_id, whatever the deliveries."""
    key = [*FACT, "generation_sequence", "change_id"]
    return feed.groupBy(*key).agg(F.max(F.struct("revision", "event_id", "kind", "content_hash")).alias("c")).select(
        *key, "c.revision", "c.event_id", "c.kind", "c.content_hash"
    )


def derived_versions(changes: DataFrame) -> DataFrame:
    """Intervals from changes: each Added or Updated opens a version that the fact's next change, of any kind, closes.

    The next change is taken before removals are dropped, since a removal closes but opens nothing.
    """
    by = Window.partitionBy(*FACT).orderBy("generation_sequence", "change_id")
    return (
        changes.withColumn("valid_until_sequence", F.lead("generation_sequence").over(by))
        .withColumn("retired_by", F.lead("event_id").over(by))
        .withColumn("retired_kind", F.lead("kind").over(by))
        .where(F.col("kind") != "Removed")
        .select(
            *FACT, F.col("generation_sequence").alias("valid_from_sequence"), "valid_until_sequence",
            F.col("event_id").alias("introduced_by"), F.col("kind").alias("introduced_kind"), "retired_by", "retired_kind", "content_hash",
        )
    )


def change_kinds(versions: DataFrame) -> DataFrame:
    """(FACT, sequence, kind) by comparing what existed before and exists after each border of a fact's versions."""
    starts = versions.select(*FACT, F.col("valid_from_sequence").alias("sequence"), F.lit(1).alias("after"), F.lit(0).alias("before"))
    ends = versions.where(F.col("valid_until_sequence").isNotNull()).select(
        *FACT, F.col("valid_until_sequence").alias("sequence"), F.lit(0).alias("after"), F.lit(1).alias("before")
    )
    # Versions that go on through a border are counted by the running balance of starts and ends.
    at = starts.unionByName(ends).groupBy(*FACT, "sequence").agg(F.sum("after").alias("opened"), F.sum("before").alias("closed"))
    by = Window.partitionBy(*FACT).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.col("opened") - F.col("closed")).over(by)
    existed = held - F.col("opened") + F.col("closed")
    kind = (
        F.when((F.col("existed") <= 0) & (F.col("opened") > 0), "Added")
        .when((F.col("existed") > 0) & (F.col("opened") > 0), "Updated")
        .when((F.col("closed") > 0) & (F.col("held") <= 0), "Removed")
    )
    return (
        at.withColumn("held", held)
        .withColumn("existed", existed)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(*FACT, "sequence", "kind")
    )


def supersessions(versions: DataFrame) -> DataFrame:
    """Pairs of consecutive versions of a fact."""
    by = Window.partitionBy(*FACT).orderBy("valid_from_sequence", F.col("valid_until_sequence").asc_nulls_last())
    return (
        versions.withColumn("supersedes", F.lag("valid_from_sequence").over(by))
        .where(F.col("supersedes").isNotNull())
        .select(*FACT, "valid_from_sequence", "supersedes")
    )


def correlated_events(changes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Later events that touch a fact which the anchor event of their worktree touches.

    anchors: (PLACE, event_id). A fact of the anchor is one row, so the join's fan-out is the fact's changes.
    """
    a = changes.join(anchors.select(*PLACE, "event_id"), [*PLACE, "event_id"]).select(
        *FACT, F.col("event_id").alias("anchor"), F.col("generation_sequence").alias("anchored")
    )
    return (
        changes.join(a.distinct(), FACT)
        .where((F.col("generation_sequence") > F.col("anchored")) & (F.col("event_id") != F.col("anchor")))
        .groupBy(*PLACE, "anchor", "event_id", "generation_sequence")
        .agg(F.countDistinct("fact_kind", "fact_id").alias("shared_facts"))
    )


def chain(generations: DataFrame) -> DataFrame:
    """Distinct generations of each worktree with their 1-based place in the chain."""
    g = generations.select(
        *PLACE, "generation", "parent_generation", "generation_sequence", "status", "accepted_at", "accepted_at_unix_nanos"
    ).groupBy(*PLACE, "generation").agg(
        F.max("parent_generation").alias("parent_generation"), F.max("generation_sequence").alias("generation_sequence"),
        F.max("status").alias("status"), F.max("accepted_at").alias("accepted_at"), F.max("accepted_at_unix_nanos").alias("nanos"),
    )
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*PLACE).orderBy("generation_sequence")))


def accepted_through(generations: DataFrame) -> DataFrame:
    """Per generation the latest acceptance of all up to it; null once one of them is unknown."""
    by = Window.partitionBy(*PLACE).orderBy("generation_sequence").rowsBetween(Window.unboundedPreceding, 0)
    known = F.min(F.col("nanos").isNotNull().cast("int")).over(by) == 1
    return chain(generations).withColumn("through", F.when(known, F.max("nanos").over(by))).select(
        *PLACE, "generation", "generation_sequence", "through"
    )


def known_sequences(generations: DataFrame, by_nanos: int) -> DataFrame:
    """Per worktree the last sequence whose whole chain was accepted by a time."""
    return (
        accepted_through(generations)
        .where(F.col("through") <= by_nanos)
        .groupBy(*PLACE)
        .agg(F.max("generation_sequence").alias("known_sequence"))
    )


def known_graph(versions: DataFrame, generations: DataFrame, by_nanos: int) -> DataFrame:
    """Facts at the last sequence that was wholly accepted by a time."""
    return as_of(versions.join(known_sequences(generations, by_nanos), PLACE), F.col("known_sequence"))


def attributes(tables: dict[str, DataFrame]) -> DataFrame:
    """The long form of the history: a row for each non-null attribute of a version, by value kind (1 text, 3 integer)."""
    wide = {
        "file": [("normalized_path", 1), ("content_hash", 1), ("size_bytes", 3), ("language", 1)],
        "provenance": [("producer_namespace", 1), ("producer_version", 1), ("evidence_class", 1)],
        "node": [("kind", 1), ("name", 1), ("owner_file", 1), ("provenance", 1)],
        "edge": [("source", 1), ("target", 1), ("relation", 1), ("provenance", 1), ("extension_namespace", 1)],
    }
    out = None
    for kind, name, key in FAMILIES:
        t = tables[name]
        until = F.col("valid_until_sequence") if "valid_until_sequence" in t.columns else F.lit(None).cast("bigint")
        cells = [
            F.struct(
                F.lit(c).alias("attribute"),
                F.lit(k).alias("value_kind"),
                (F.col(c) if k == 1 else F.lit(None).cast("string")).alias("value_text"),
                (F.col(c).cast("bigint") if k == 3 else F.lit(None).cast("bigint")).alias("value_uint64"),
            )
            for c, k in wide[kind]
        ]
        part = t.select(
            *PLACE, F.lit(kind).alias("fact_kind"), F.col(key).alias("fact_id"), "valid_from_sequence",
            until.alias("valid_until_sequence"), F.explode(F.array(*cells)).alias("a"),
        ).select(*FACT, "valid_from_sequence", "valid_until_sequence", "a.*")
        part = part.where(F.col("value_text").isNotNull() | F.col("value_uint64").isNotNull())
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy(*FACT, "valid_from_sequence", "attribute").orderBy("value_text", "value_uint64", "valid_until_sequence")
    return out.distinct().withColumn("ordinal", F.row_number().over(by) - 1).withColumn("schema_version", F.lit(2))


def feed_changes(feed: DataFrame) -> DataFrame:
    """The rows of ``attributes`` by the sequence (as_of_sequence) at which a synchronization has to write them.

    A row is written where it begins, its end unknown if it is still to come, and again where it ends. Rows of one version
    and attribute are numbered together, so all that are known then are written where any of them begins or ends.
    """
    group = [*FACT, "valid_from_sequence", "attribute", "value_kind", "schema_version"]
    begun, until = F.col("valid_from_sequence"), lambda r: r["valid_until_sequence"]
    rows = feed.groupBy(*group).agg(F.collect_set(F.struct("value_text", "value_uint64", "valid_until_sequence")).alias("rows"))
    ends = F.transform("rows", lambda r: F.greatest(begun, until(r)))  # greatest passes over nulls
    events = rows.withColumn("as_of_sequence", F.explode(F.array_distinct(F.concat(F.array(begun), ends))))
    as_known = F.transform("rows", lambda r: r.withField("valid_until_sequence", F.when(until(r) <= F.col("as_of_sequence"), until(r))))
    known = F.array_sort(F.array_distinct(as_known))
    return events.select(*group, "as_of_sequence", F.posexplode(known).alias("ordinal", "r")).select(*group, "as_of_sequence", "ordinal", "r.*")


def fact_counts(versions: DataFrame, generations: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct facts by the generation in which they begin; with a ``limit`` (1 to 4096) the first in order of sequence."""
    ids = chain(generations).select(*PLACE, "generation", F.col("generation_sequence").alias("valid_from_sequence"))
    counts = (
        versions.select(*FACT, "valid_from_sequence")
        .distinct()
        .groupBy(*PLACE, "valid_from_sequence")
        .agg(F.count("*").alias("facts"))
        .join(ids, [*PLACE, "valid_from_sequence"])
        .select(*PLACE, F.col("generation").alias("valid_from_generation"), "valid_from_sequence", "facts")
    )
    if limit is None:
        return counts
    if not 1 <= limit <= 4096:
        raise ValueError("limit must be from 1 to 4096")
    return counts.orderBy(*PLACE, "valid_from_sequence").limit(limit)


def with_status(generations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Generations (place, generation, status, ...) with the status that decisions (place, generation, status) give them.

    A decision on a generation that is not there is an error; several on one are decided by the greatest status.
    """
    unknown = decisions.join(generations.select(*PLACE, "generation").distinct(), [*PLACE, "generation"], "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a status for a generation that is not there")
    new = decisions.groupBy(*PLACE, "generation").agg(F.max("status").alias("__status"))
    rows = generations.join(new, [*PLACE, "generation"], "left").withColumn("status", F.coalesce("__status", "status"))
    return rows.select(*generations.columns)


def feed_pages(versions: DataFrame, size: int = 256, spread: int = 6) -> DataFrame:
    """The facts of each worktree in fact order (family, id, start) with the page of ``size`` that each lies in, from 0.

    Facts are numbered within blocks of equal family and id prefix of ``spread`` characters, and blocks by running sums, so that no
    window goes over a worktree. A reader resumes after the last (page, fact) that it has seen.
    """
    rows = versions.withColumn("ord", fact_order(F.col("fact_kind"))).withColumn("block", F.substring("fact_id", 1, spread))
    sizes = rows.groupBy(*PLACE, "ord", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*PLACE).orderBy("ord", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy(*PLACE, "ord", "block").orderBy("fact_id", "valid_from_sequence", F.col("valid_until_sequence").asc_nulls_last())
    at = F.col("offset") + F.row_number().over(inside) - 1
    return rows.join(offsets, [*PLACE, "ord", "block"]).withColumn("page", F.floor(at / size).cast("bigint")).drop("ord", "block", "offset")


def roots(versions: DataFrame) -> DataFrame:
    """A digest of each worktree's facts, the same in whatever order they come, and other if any fact changes."""
    text = F.concat_ws("|", "fact_kind", "fact_id", F.col("valid_from_sequence").cast("string"), F.coalesce(F.col("valid_until_sequence").cast("string"), F.lit("-")))
    word = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return versions.withColumn("w", word).groupBy(*PLACE).agg(F.bit_xor("w").alias("root"), F.count("*").alias("facts"))
