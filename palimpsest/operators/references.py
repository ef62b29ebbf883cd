"""References to records that do not exist (problem 5).

The distinct non-null references (key and the sequence at which it is made) are anti-joined
against the validity of the parent keys; what remains is given a reason and joined back to the
rows that made the reference.

Distinct references come before the join, so a key that a third of all rows cite is one row per
sequence in it; the join back is the only step in which a hot key keeps its rows, and
there adaptive execution splits the large side.

Edge cases: null keys refer to nothing and are no case; a null start sequence is at no time
valid, so such a reference is ``missing`` if its worktree has no row of the key and else
``deleted``; parents without an end are open; repeated rows of either side change nothing;
an empty parent table makes every reference ``missing``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["repository_id", "worktree_id"]

#: (record table, field, parent table, parent's key)
REFERENCES = [
    ("edge_versions", "source", "node_versions", "node_id"),
    ("edge_versions", "target", "node_versions", "node_id"),
    ("node_versions", "owner_file", "file_versions", "file_id"),
    ("node_versions", "provenance", "provenance", "provenance_id"),
]


def exploded_references(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(place, version_id, record_table, field, parent, key, seq): a row per non-null reference."""
    out = None
    for record in dict.fromkeys(r[0] for r in references):
        cells = [
            F.struct(F.lit(field).alias("field"), F.lit(parent).alias("parent"), F.col(field).alias("key"))
            for rec, field, parent, _ in references
            if rec == record
        ]
        part = (
            tables[record]
            .select(
                *PLACE,
                "version_id",
                F.col("valid_from_sequence").alias("seq"),
                F.lit(record).alias("record_table"),
                F.explode(F.array(*cells)).alias("c"),
            )
            .select(*PLACE, "version_id", "seq", "record_table", "c.field", "c.parent", "c.key")
            .where(F.col("key").isNotNull())
        )
        out = part if out is None else out.unionByName(part)
    return out


def parent_validity(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(place, parent, key, from, until): per key and start the longest validity; no end is the greatest bigint."""
    out = None
    for parent, key in dict.fromkeys((r[2], r[3]) for r in references):
        rows = tables[parent]
        until = F.col("valid_until_sequence") if "valid_until_sequence" in rows.columns else F.lit(None).cast("bigint")
        part = rows.select(
            *PLACE,
            F.lit(parent).alias("parent"),
            F.col(key).alias("key"),
            F.col("valid_from_sequence").alias("from"),
            F.coalesce(until, F.lit(2**63 - 1)).alias("until"),
        ).where(F.col("key").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*PLACE, "parent", "key", "from").agg(F.max("until").alias("until"))


def orphan_references(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(place, record_table, version_id, field, seq, reason), each case once."""
    made = exploded_references(tables, references)
    parents = parent_validity(tables, references)
    distinct = made.select(*PLACE, "parent", "key", "seq").distinct()
    p, d = parents.alias("p"), distinct.alias("d")
    same = [F.col(f"d.{c}") == F.col(f"p.{c}") for c in (*PLACE, "parent", "key")]
    held = (F.col("p.from") <= F.col("d.seq")) & (F.col("d.seq") < F.col("p.until"))
    orphans = d.join(p, [*same, held], "left_anti")
    first = parents.groupBy(*PLACE, "parent", "key").agg(F.min("from").alias("first"))
    reasoned = orphans.join(first, [*PLACE, "parent", "key"], "left").withColumn(
        "reason",
        F.when(F.col("first").isNull(), "missing").when(F.col("first") > F.col("seq"), "late").otherwise("deleted"),
    )
    r = reasoned.select(*PLACE, "parent", "key", F.col("seq").alias("at"), "reason")
    return (
        made.join(r, [*PLACE, "parent", "key"])
        .where(F.col("at").eqNullSafe(F.col("seq")))
        .select(*PLACE, "record_table", "version_id", "field", "seq", "reason")
        .distinct()
    )


def orphan_counts(tables: dict[str, DataFrame], generations: DataFrame, references=REFERENCES) -> DataFrame:
    """Orphans, with distinct versions referring, by table, field, reason and the generation at which they begin."""
    ids = generations.groupBy(*PLACE, F.col("generation_sequence").alias("seq")).agg(F.min("generation").alias("generation"))
    return (
        orphan_references(tables, references)
        .groupBy("record_table", "field", "reason", *PLACE, "seq")
        .agg(F.count("*").alias("orphans"))
        .join(ids, [*PLACE, "seq"], "left")
        .select("record_table", "field", "reason", *PLACE, F.col("seq").alias("valid_from_sequence"), "generation", "orphans")
    )
