"""Dyadic ranges: half-open intervals and points of integers as nodes of a binary tree, so that "lies in" becomes equality.

An interval is the union of at most two nodes per level, a point lies in one node of every level. Both sides of a join or a sort
grow by the logarithm of the integers' range at most, however long the intervals are. Nodes are numbered as in a heap: those of level
``lv`` from 2 ** (levels - lv), so that a number names its level too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levels_of(top: int) -> int:
    """Levels of the tree over 0..top-1."""
    return max(1, int(top).bit_length())


def nodes_over(point: Column, levels: int) -> Column:
    """The nodes that a point from 0 lies in, as an array."""
    leaf = point.cast("bigint") + (1 << levels)
    return F.array(*[F.shiftright(leaf, lv) for lv in range(levels)])


def nodes_within(start: Column, end: Column, levels: int) -> Column:
    """The nodes that together are [start, end), as an array; empty for an empty interval. 0 <= start, end < 2 ** levels."""
    cover = []
    for lv in range(levels):
        left, right = F.shiftright(start.cast("bigint") + ((1 << lv) - 1), lv), F.shiftright(end.cast("bigint"), lv)
        at = 1 << (levels - lv)
        cover += [F.when((left < right) & (left.bitwiseAND(1) == 1), left + at), F.when((left < right) & (right.bitwiseAND(1) == 1), right - 1 + at)]
    return F.array_compact(F.array(*cover))
