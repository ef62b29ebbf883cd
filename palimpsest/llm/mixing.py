"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. With n the available and t the target shares of the sources, the
weights are the normalised t * (n / t) ** x: exponent 0 gives the targets, 1 the natural shares. The exponent
is bisected to the least at which no source would be used more than its ``max_repeats`` times for the
wanted total. Without a wanted total the largest is taken that the targets allow, so that the bisection ends at
0 and the targets themselves are met. With a wanted entropy in place of stated shares the weights are the normalised n ** x, and the
exponent is bisected to meet the entropy: 1 keeps the natural shares, 0 makes all equal.

The weights become token budgets. A budget of f full uses and a rest takes every document f times and, for
the rest, the first documents of a permutation: documents fall into hash blocks of bounded size, blocks
are put in order by offsets summed over blocks, and only the place inside a block needs a window. No
window runs over a whole source. A document is taken for the rest only if it fits wholly, so a source
falls short of its budget by less than its one document that did not fit, and never exceeds a limit.

Edge cases: documents with null or blank-less empty text have no tokens and are never used; documents whose source
is null or not in the targets are left out; a target source without documents is reported with 0
tokens and its share goes to the others in proportion; targets of 0 or null use nothing; repeated
target rows count once (the greatest share); ties of the permutation are broken by doc_id.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import default_vocabulary, read_ranks
from palimpsest.llm.documents import spread
from palimpsest.session import materialize


def token_counts(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) with the public tokenizer's own library; the vocabulary (fixed size) is broadcast."""
    if path is None:
        path, pattern = default_vocabulary()
    shared = documents.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))

    def encoder():
        import tiktoken

        ranks, pat = shared.value
        return tiktoken.Encoding("counting", pat_str=pat, mergeable_ranks=ranks, special_tokens={})

    held: list = []

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(encoder())
        return pd.Series([len(held[0].encode_ordinary(t)) if t else 0 for t in texts])

    return spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", count("text").alias("tokens"))


def tempered(available: dict[str, int], targets: dict[str, float], x: float) -> dict[str, float]:
    raw = {s: targets[s] * (available[s] / targets[s]) ** x for s in targets}
    whole = sum(raw.values())
    return {s: w / whole for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    """In nats."""
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisected(enough, low: float = 0.0, high: float = 1.0) -> float:
    """The least exponent for which ``enough`` holds, which stays true from there on up to ``high``."""
    if enough(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def mixing_weights(
    available: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None, wanted_entropy: float | None = None
) -> tuple[dict[str, float], int, float]:
    """(weights, total, exponent) under the repetition limits. A total beyond all limits is an error, and so is an entropy beyond that of
    equal or natural shares."""
    targets = {s: t for s, t in targets.items() if t and t > 0 and available.get(s, 0) > 0}
    if not targets:
        return {}, 0, 0.0
    most = lambda w: min(repeats[s] * available[s] / w[s] for s in w)
    if wanted_entropy is not None:
        # Equal targets make the exponent that of the natural shares alone. Entropy falls as it grows.
        targets = dict.fromkeys(targets, 1 / len(targets))
        at = lambda x: tempered(available, targets, x)
        if not entropy(at(1.0)) - 1e-9 <= wanted_entropy <= entropy(at(0.0)) + 1e-9:
            raise ValueError(f"an entropy of {wanted_entropy} lies outside {entropy(at(1.0))} to {entropy(at(0.0))}")
        x = _bisected(lambda x: entropy(at(x)) <= wanted_entropy)
        total = int(most(at(x))) if total is None else total
        if total > most(at(x)):
            raise ValueError(f"a total of {total} tokens needs more repetition than the limits allow")
        return at(x), total, x
    if total is None:
        total = int(most(tempered(available, targets, 0.0)))
    # Weights at exponent 1 are the natural shares; between, the tightest source is relieved step by step.
    if total > most(tempered(available, targets, 1.0)) and total > most(tempered(available, targets, 0.0)):
        raise ValueError(f"a total of {total} tokens needs more repetition than the limits allow")
    x = _bisected(lambda x: total <= most(tempered(available, targets, x)))
    return tempered(available, targets, x), total, x


def _plan(counted: DataFrame, targets: DataFrame, total: int | None, passes: float | None = None, evenness: float | None = None) -> list[dict]:
    """A row for each target source; as many come to the driver as there are targets. ``passes`` states the total as so many
    times the tokens of the sources that have a target. ``evenness`` wants that part of the way from the natural shares' entropy to that of equal ones."""
    rows = targets.groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("m"))
    sums = (
        counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
    )
    # The driver takes one row per target source, never one per source of the corpus.
    got = rows.where(F.col("source").isNotNull()).join(sums, "source", "left").collect()
    n = {r["source"]: r["n"] or 0 for r in got}
    t = {r["source"]: r["t"] or 0.0 for r in got}
    m = {r["source"]: r["m"] or 1 for r in got}
    if passes is not None:
        total = int(passes * sum(n[s] for s in n if t[s] > 0))
    wanted = None
    if evenness is not None:
        held = {s: n[s] for s in n if t[s] > 0 and n[s] > 0}
        natural = {s: c / sum(held.values()) for s, c in held.items()}
        wanted = entropy(natural) + evenness * (math.log(len(held)) - entropy(natural)) if held else None
    weights, whole, x = mixing_weights(n, t, m, total, wanted)
    out = []
    for r in got:
        s = r["source"]
        budget = int(weights.get(s, 0.0) * whole)
        full = budget // n[s] if n[s] else 0
        out.append(
            {
                "source": s, "target_share": t[s], "max_repeats": m[s], "available_tokens": n[s],
                "full": min(full, m[s]), "rest": 0 if full >= m[s] or not n[s] else budget - full * n[s],
                "blocks": max(1, math.ceil((r["docs"] or 0) / BLOCK_DOCUMENTS)), "exponent": x,
            }
        )
    return out


#: About how many documents a block of the permutation has: the bound of a window.
BLOCK_DOCUMENTS = 100_000
_PLAN = "source string, target_share double, max_repeats int, available_tokens bigint, full bigint, rest bigint, blocks bigint, exponent double"


def _copies(counted: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    """(source, doc_id, tokens, copies): how often each document is used."""
    spark = counted.sparkSession
    # One row per target source. Spark broadcasts it where that is small, and joins by shuffle where there are very many targets.
    wanted = spark.createDataFrame(plan, _PLAN)
    place = F.xxhash64(F.lit(seed), "doc_id")
    rows = (
        counted.where(F.col("tokens") > 0)
        .join(wanted, "source")
        .withColumn("place", place)
        .withColumn("block", F.pmod(F.col("place"), F.col("blocks")))
        .withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id"))
    )
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "block", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["source", "block"]).withColumn("until", F.col("offset") + F.sum("tokens").over(inside))
    return placed.select(
        "source",
        "doc_id",
        "tokens",
        (F.col("full") + F.when(F.col("until") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("copies"),
    ).where(F.col("copies") > 0)


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, passes: float | None = None, evenness: float | None = None, **tokenizer) -> DataFrame:
    """(source, doc_id, epoch, tokens): a row for each use of a document, epochs from 0."""
    counted = materialize(token_counts(documents, **tokenizer), "tokens")
    copies = _copies(counted, _plan(counted, targets, total, passes, evenness), seed)
    return copies.select("source", "doc_id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), "tokens")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, passes: float | None = None, evenness: float | None = None, **tokenizer) -> DataFrame:
    """Per target source its available and used tokens, the share reached, and how many times over it is used."""
    counted = materialize(token_counts(documents, **tokenizer), "tokens")
    plan = _plan(counted, targets, total, passes, evenness)
    used = _copies(counted, plan, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    out = counted.sparkSession.createDataFrame(plan, _PLAN).join(used, "source", "left")
    tokens = F.coalesce("used", F.lit(0))
    return out.select(
        "source", "target_share", "available_tokens", tokens.alias("used_tokens"),
        F.coalesce(F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy())), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.try_divide(tokens, F.col("available_tokens")), F.lit(0.0)).alias("times_used"),
        "max_repeats", "exponent",
    )
