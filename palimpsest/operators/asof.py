"""Attributes as known at event time (problem 4).

Every attribute of an entity has its own history of (value, validity, time it became known), in which a statement that
repeats the one before it is left out, so that an attribute which seldom changes has a short history whatever the others
do. An event is matched with each history by itself: of the values whose validity holds the event's sequence and which were
known when the event was made, the one known last. The matches are then pivoted back to one row per event.

Matching is a merge and pairs nothing. Validity is cut into dyadic ranges of sequences (``intervals``): a value lies in at
most two ranges per level, an event in one. Within a range only times matter: events and values are sorted together, and each
event takes the last value before it. The ranges of an entity are cut into time blocks in proportion to its events and values, so that no
task sorts a whole hot range; the last value before a block comes from a running maximum over block summaries.

Edge cases: an event with a null key, sequence or time, or without a match, gives no row; a null
value that was the one known last comes out as null; of two values known at the same
microsecond the one with the greater ``tie`` is taken; repeated rows change nothing; columns of
events that have the same name as an attribute do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.intervals import levels_of, nodes_over, nodes_within

OPEN = 2**63 - 1
#: Events and values of one entity that a time block should hold, and the most blocks of one entity.
BLOCK_ROWS, BLOCKS = 100_000, 256


def attribute_histories(rows: DataFrame, keys: list[str], attributes: list[str], tie: str) -> DataFrame:
    """(keys, __block, __from, __until, __known, __tie, attribute, value): the history of each attribute.

    rows: (keys, __block, __from, __until, __known, __tie, __v0, ...), the last being the attributes. A statement is left out where the entity's
    statement known just before it gives the attribute the same value over a validity that holds its own: the last one
    known is then the same value with or without it. Blocks are looked at by themselves, and the first statement of one always stays.
    """
    by = Window.partitionBy(*keys, "__block").orderBy("__known", "__tie")
    shared = [*keys, "__block", "__from", "__until", "__known", "__tie"]
    again = F.lit(False)
    if any(a != tie for a in attributes):
        within = (F.lag("__from").over(by) <= F.col("__from")) & (F.col("__until") <= F.lag("__until").over(by))
        same = [F.lit(False) if a == tie else F.lag(f"__v{i}").over(by).eqNullSafe(F.col(f"__v{i}")) for i, a in enumerate(attributes)]
        rows = rows.select("*", F.coalesce(within, F.lit(False)).alias("__in"), *[c.alias(f"__s{i}") for i, c in enumerate(same)])
    cells = []
    for i, a in enumerate(attributes):
        # Values of the tie's own column all differ.
        again = F.lit(False) if a == tie else F.col("__in") & F.col(f"__s{i}")
        cells.append(F.when(~again, F.struct(F.lit(i).alias("attribute"), F.col(f"__v{i}").alias("value"))))
    return rows.select(*shared, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*shared, "c.*")


def _time_blocks(times: DataFrame, column: str):
    """A function from a time and a number of blocks to the time's block, by quantiles of the times."""
    cuts = times.agg(F.percentile_approx(column, F.lit([i / BLOCKS for i in range(1, BLOCKS)]), F.lit(1000)).cast("array<string>").alias("q")).first()["q"]
    kind = dict(times.dtypes)[column]
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind}>")
    rank = lambda t: F.size(F.filter(bounds, lambda b: b <= t))
    return lambda t, n: F.when(n > 1, F.floor(rank(t) * n / BLOCKS)).otherwise(F.lit(0)).cast("int")


def attributes_at_event(
    events: DataFrame,
    versions: DataFrame,
    keys: list[str],
    event_id: str,
    sequence: str,
    known_by: str,
    attributes: list[str],
    valid_from: str = "valid_from_sequence",
    valid_until: str = "valid_until_sequence",
    known_at: str = "accepted_at",
    tie: str = "version_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(event_id, one column per attribute): the values that held and were known at each event."""
    k = [f"__k{i}" for i in range(len(keys))]
    types = dict(versions.dtypes)
    named = [F.col(c).alias(n) for c, n in zip(keys, k)]
    whole = lambda *c: F.forall(F.array(*[F.col(x).isNotNull() for x in c]), lambda x: x)
    asked = events.select(F.col(event_id).alias("__event"), *named, F.col(sequence).alias("__seq"), F.col(known_by).cast(types[known_at]).alias("__by"))
    asked = asked.where(whole(*k, "__seq", "__by"))
    said = versions.where(whole(*keys, valid_from, known_at))
    span = said.agg(F.min(valid_from).alias("low"), F.max(F.greatest(valid_from, valid_until)).alias("high")).first()
    # Sequences count from the least start: no value holds before it, and what holds at the greatest border holds at all later ones.
    low = span["low"] or 0
    top = (span["high"] or 0) - low + 1
    levels = levels_of(top + 1)
    block = _time_blocks(said, known_at)
    # Only entities with both events and values matter; how many they have decides into how many time blocks they are cut.
    weight = asked.groupBy(*k).agg(F.count("*").alias("a")).join(said.select(*named).groupBy(*k).agg(F.count("*").alias("b")), k)
    weight = weight.select(*k, F.least(F.ceil((F.col("a") + F.col("b")) / block_rows), F.lit(BLOCKS)).cast("int").alias("__blocks"))
    e = asked.where(F.col("__seq") >= low).join(weight, k).withColumn("__block", block(F.col("__by"), F.col("__blocks")))
    v = said.select(
        *named, F.col(valid_from).alias("__from"), F.coalesce(valid_until, F.lit(OPEN)).alias("__until"), F.col(known_at).alias("__known"), F.col(tie).alias("__tie"),
        *[F.col(a).cast("string").alias(f"__v{i}") for i, a in enumerate(attributes)],
    ).join(weight, k).withColumn("__block", block(F.col("__known"), F.col("__blocks")))
    ver = F.struct(F.col("__known").alias("t"), "__tie", "value")

    def ranged(e: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Events and values by the ranges that they lie in."""
        at = F.least(F.col("__seq") - low, F.lit(top - 1))
        until = F.least(F.col("__until") - low, F.lit(top))
        e = e.select(*k, "__block", F.explode(nodes_over(at, levels)).alias("__range"), F.col("__by").alias("t"), F.lit(1).alias("is_event"), "__event")
        v = attribute_histories(v, k, attributes, tie).select(
            *k, "__block", F.explode(nodes_within(F.col("__from") - low, until, levels)).alias("__range"), F.col("__known").alias("t"), F.lit(0).alias("is_event"), "attribute", ver.alias("ver")
        )
        return e, v

    group, names = [*k, "__range"], [f"__a{i}" for i in range(len(attributes))]
    of = [F.when(F.col("attribute") == i, F.col("ver")) for i in range(len(attributes))]
    events_in, values_in = ranged(e, v)
    inside = Window.partitionBy(*group, "__block").orderBy("t", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    both = events_in.unionByName(values_in, allowMissingColumns=True)
    seen = both.select(*group, "__block", "__event", *[F.max(c).over(inside).alias(n) for c, n in zip(of, names)]).where("__event is not null")
    # A range in several blocks has a summary row for each; a block's carry is the last value of the blocks before it.
    many = F.col("__blocks") > 1
    events_cut, values_cut = ranged(e.where(many), v.where(many))
    summary = values_cut.groupBy(*group, "__block").agg(*[F.max(c).alias(n) for c, n in zip(of, names)])
    summary = summary.unionByName(events_cut.select(*group, "__block").distinct(), allowMissingColumns=True)
    summary = summary.groupBy(*group, "__block").agg(*[F.max(n).alias(n) for n in names])
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*group, "__block", *[F.max(n).over(before).alias(f"{n}c") for n in names])
    best = seen.join(carried, [*group, "__block"], "left").groupBy("__event").agg(*[F.max(F.greatest(n, f"{n}c")).alias(n) for n in names])
    return best.where(F.coalesce(*names).isNotNull()).select(
        F.col("__event").alias(event_id), *[F.col(f"{n}.value").cast(types[a]).alias(a) for n, a in zip(names, attributes)]
    )


def premise_attributes(
    premises: DataFrame, generations: DataFrame, edge_versions: DataFrame, attributes: list[str]
) -> DataFrame:
    """Problem 4's statement: edge attributes that held in a premise's generation and were known when it was drawn."""
    place = ["repository_id", "worktree_id"]
    sequences = generations.groupBy(*place, "generation").agg(F.max("generation_sequence").alias("generation_sequence"))
    events = premises.select(*place, "premise_id", "generation", "edge_id", "drawn_at").join(
        sequences, [*place, "generation"]
    )
    return attributes_at_event(
        events, edge_versions, [*place, "edge_id"], "premise_id", "generation_sequence", "drawn_at", attributes
    )
