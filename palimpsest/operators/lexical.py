"""Identifier search: postings, rarity-weighted ranking, family channels, plans and packing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.stem import stemmed
from palimpsest.functions.text import identifier_terms, is_source_content, lexical_family, rarity, terminal_segment

PLACE = ["repository_id", "worktree_id"]


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name holds a text, letter case aside (Unicode rules)."""
    if text == "":
        raise ValueError("an empty search")
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower())))


def symbol_candidates(nodes: DataFrame, symbols: list[str]) -> DataFrame:
    """Nodes named so, or whose last segment after :: is so named."""
    return nodes.where(F.col("name").isin(symbols) | terminal_segment(F.col("name")).isin(symbols))


def postings(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """(place, node_id, term): the identifier index; ``text`` may add path terms to the name's."""
    source = F.col("name") if text is None else text
    return nodes.select(*PLACE, "node_id", F.explode(identifier_terms(source)).alias("term")).distinct()


def stemmed_postings(index: DataFrame) -> DataFrame:
    """The index under stems. Each distinct term is stemmed once and joined back."""
    stems = index.select("term").distinct().select("term", stemmed("term").alias("stem"))
    return index.join(stems, "term").select(*PLACE, "node_id", F.col("stem").alias("term")).distinct()


def term_statistics(index: DataFrame, terms: list[str]) -> DataFrame:
    """Nodes per place and term."""
    return index.where(F.col("term").isin(terms)).groupBy(*PLACE, "term").agg(F.countDistinct("node_id").alias("frequency"))


def ranked(index: DataFrame, population: DataFrame, terms: list[str], eligible: DataFrame | None = None) -> DataFrame:
    """(place, node_id, matched, weight, score): the sum of rarity weights times the terms matched.

    Frequencies are global in a place; ``eligible`` restricts only what is returned.
    population: (place, population).
    """
    hits = index.where(F.col("term").isin(terms))
    weights = (
        term_statistics(index, terms)
        .join(population, PLACE)
        .select(*PLACE, "term", rarity(F.col("population"), F.col("frequency")).alias("w"))
    )
    if eligible is not None:
        hits = hits.join(eligible.select(*PLACE, "node_id").distinct(), [*PLACE, "node_id"], "left_semi")
    return (
        hits.join(weights, [*PLACE, "term"])
        .groupBy(*PLACE, "node_id")
        .agg(F.count("*").alias("matched"), F.sum("w").alias("weight"))
        .withColumn("score", F.col("weight") * F.col("matched"))
    )


def top(rows: DataFrame, k: int, by: list[str] = PLACE) -> DataFrame:
    """The k best of each place by score, then id. Ranks are limited by group before any full sort."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "node_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def populations(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*PLACE).agg(F.countDistinct("node_id").alias("population"))


def first_per_file(rows: DataFrame, k: int) -> DataFrame:
    """k rows of each place: first the best of each file, at most ceil(k/2) of these, then the best of the rest.

    rows: (place, node_id, owner_file, score). A row without a file is a file of its own.
    """
    file = F.coalesce("owner_file", F.concat(F.lit("node:"), F.col("node_id")))
    in_file = Window.partitionBy(*PLACE, "__file").orderBy(F.desc("score"), "node_id")
    lead = rows.withColumn("__file", file).withColumn("__first", F.row_number().over(in_file) == 1)
    among = Window.partitionBy(*PLACE, "__first").orderBy(F.desc("score"), "node_id")
    marked = lead.withColumn("__turn", F.col("__first") & (F.row_number().over(among) <= (k + 1) // 2))
    order = Window.partitionBy(*PLACE).orderBy(F.desc("__turn"), F.desc("score"), "node_id")
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__file", "__first", "__turn")


def fused(nodes: DataFrame, exact: DataFrame, body: DataFrame, stem_scores: DataFrame) -> DataFrame:
    """Score of a node = score of its name + the greater of its body's exact and stemmed scores; code and documents come first."""
    s = lambda df, c: df.select(*PLACE, "node_id", F.col("score").alias(c))
    rows = nodes.select(*PLACE, "node_id", "owner_file", lexical_family(F.col("kind")).alias("family"))
    for df, c in ((exact, "name_score"), (body, "body_score"), (stem_scores, "stem_score")):
        rows = rows.join(s(df, c), [*PLACE, "node_id"], "left")
    content = F.greatest(F.coalesce("body_score", F.lit(0)), F.coalesce("stem_score", F.lit(0)))
    rows = rows.withColumn("score", F.coalesce("name_score", F.lit(0)) + content)
    return rows.where("score > 0").withColumn("tier", F.when(F.col("family").isin("Code", "Documentation"), 0).otherwise(1))


def body_postings(nodes: DataFrame, files: DataFrame, terms: list[str]) -> DataFrame:
    """(place, node_id, term) of the terms in the texts behind nodes of source-content kinds.

    files: (place, file_id, content_hash, text) of current files; a text whose digest does not begin with its content_hash is not
    indexed. Texts are reduced to the asked terms before anything is joined.
    """
    sound = F.startswith(F.sha2(F.encode("text", "UTF-8"), 256), F.col("content_hash")) & (F.length("content_hash") > 0)
    asked = F.array_intersect(identifier_terms(F.col("text")), F.array(*[F.lit(t) for t in terms]))
    said = files.where(sound).select(*PLACE, F.col("file_id").alias("owner_file"), F.explode(asked).alias("term")).distinct()
    owners = nodes.where(is_source_content(F.col("kind"))).select(*PLACE, "node_id", "owner_file").distinct()
    return owners.join(said, [*PLACE, "owner_file"]).select(*PLACE, "node_id", "term").distinct()


def refilled(channels: DataFrame, limit: int = 256) -> DataFrame:
    """(place, node_id, rank): one id of each channel in turn, ids once; a channel goes on past ids that are taken.

    channels: (place, channel, position, node_id). A channel can pass over at most ``limit`` taken ids, so no more than its first
    ``limit`` matter, and a place's group is that many rows of each channel.
    """
    first = F.row_number().over(Window.partitionBy(*PLACE, "channel").orderBy("position", "node_id"))
    rows = channels.withColumn("at", first).where(F.col("at") <= limit).select(*PLACE, "channel", "at", "node_id")

    def turn(group: pd.DataFrame) -> pd.DataFrame:
        lists = [list(part.sort_values("at")["node_id"]) for _, part in group.groupby("channel", sort=True)]
        ids = round_robin(lists, limit)
        place = [group[c].iloc[0] for c in PLACE]
        return pd.DataFrame([(*place, n, i + 1) for i, n in enumerate(ids)], columns=[*PLACE, "node_id", "rank"])

    return rows.groupBy(*PLACE).applyInPandas(turn, "repository_id string, worktree_id string, node_id string, rank bigint")


def round_robin(channels: list[list[str]], limit: int = 256) -> list[str]:
    """One id of each channel in turn, ids once; a channel goes on past ids that are taken."""
    out: dict[str, None] = {}
    at = [0] * len(channels)
    while len(out) < limit:
        moved = False
        for c, ids in enumerate(channels):
            while at[c] < len(ids) and ids[at[c]] in out:
                at[c] += 1
            if at[c] < len(ids) and len(out) < limit:
                out[ids[at[c]]] = None
                at[c] += 1
                moved = True
        if not moved:
            break
    return list(out)


def utf8_bytes(text: str) -> int:
    return len(text.encode("utf-8"))


def best_window(lines: list[str], terms: set[str], fits: Callable[[str], bool], widths=(24, 12, 6, 3, 1)) -> tuple[int, int] | None:
    """(first, last) line, from 0, of the window with most distinct terms that fits; wider first, then earlier."""
    found = [{t for t in terms if t in line.lower()} for line in lines]
    for width in widths:
        best = None
        for at in range(max(1, len(lines) - width + 1)):
            part = lines[at : at + width]
            score = len(set().union(*found[at : at + width])) if part else 0
            if score and fits("\n".join(part)) and (best is None or score > best[0]):
                best = (score, at, at + len(part) - 1)
        if best:
            return best[1], best[2]
    return None


def pack(candidates: list[dict], budget: int, terms: set[str] = frozenset(), count: Callable[[str], int] = utf8_bytes) -> dict:
    """Greedy packing of at most a few hundred candidates in their order: a whole item, else its best excerpt; else earlier sources, the last
    first, are cut down to narrower excerpts until the item fits; else it is omitted.

    An item with the text of one already in adds its node ids to that. Gives items, tokens and omitted counts by kind.
    """
    items: list[dict] = []
    at: dict[tuple, dict] = {}
    omitted: dict[str, int] = {}
    used = lambda: sum(i["tokens"] for i in items)

    def excerpt(c: dict, fits: Callable[[str], bool], widths=(24, 12, 6, 3, 1)) -> dict | None:
        lines = c["text"].split("\n")
        window = best_window(lines, terms, fits, widths) if c["kind"] == "source_evidence" else None
        if window is None:
            return None
        first = c.get("line_start", 1)
        text = "\n".join(lines[window[0] : window[1] + 1])
        return c | {"text": text, "line_start": first + window[0], "line_end": first + window[1], "tokens": count(text)}

    def compacted(cost: int) -> bool:
        """Make room for ``cost`` by excerpts of the items in, or leave all as it is."""
        kept = [dict(i) for i in items]
        for item in reversed(items):
            whole = len(item["text"].split("\n"))
            for width in (24, 12, 6, 3, 1):
                if width < whole and (short := excerpt(item, lambda t: True, (width,))) and short["tokens"] < item["tokens"]:
                    item.update(short)
                    if used() + cost <= budget:
                        return True
        for item, before in zip(items, kept):
            item.clear()
            item.update(before)
        return False

    for c in candidates:
        key = (c["kind"], c["text"])
        if key in at:
            at[key]["node_ids"] = sorted(set(at[key]["node_ids"]) | set(c["node_ids"]))
            continue
        c = c | {"tokens": count(c["text"])}
        if used() + c["tokens"] > budget:
            free = budget - used()
            c = excerpt(c, lambda t: count(t) <= free) or c  # noqa: B023
        if used() + c["tokens"] > budget and (c["tokens"] > budget or not compacted(c["tokens"])):
            omitted[c["kind"]] = omitted.get(c["kind"], 0) + 1
            continue
        item = c | {"rank": len(items) + 1, "node_ids": sorted(c["node_ids"])}
        items.append(item)
        at[key] = item
    return {"items": items, "tokens": used(), "omitted": omitted}
