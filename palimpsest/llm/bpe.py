"""Encoding with a public byte-level BPE tokenizer (problem 8).

A text is cut into words by the tokenizer's pattern and each word is encoded by merging, over and over, the
leftmost pair of adjacent tokens with the least rank. A segment tree over the word's byte positions
holds in each node the least (rank, position) of its range: the root is the next merge, and a merge
changes at most three leaves (the merged token's, its live left neighbour's and that of the token that
went), each updated in logarithmic time. A word of n bytes takes O(n log n), so a
very long word (hex dumps, text without spaces) costs no more per byte than a short one, within a log.

Edge cases: null and empty texts give an empty list; strings that look like special tokens are ordinary
text; repeated rows are encoded each; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.documents import spread

_NONE = 1 << 62


class SegmentTreeBPE:
    """ranks: token bytes to id, where the id is the merge rank. pattern: how a text is cut into words."""

    #: Words of up to this many bytes are remembered, up to so many of them.
    REMEMBERED_BYTES, REMEMBERED = 64, 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ends = list(range(1, n + 1))  # the token that starts at i ends at ends[i]
        before = list(range(-1, n - 1))  # the start of the live token before i
        tree = [_NONE] * (2 * width)
        get = ranks.get
        for i in range(n - 1):
            rank = get(word[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += width
            if tree[i] == value:
                return
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    return
                tree[i] = value
                i >>= 1

        while (root := tree[1]) != _NONE:
            i = root % width
            j = ends[i]
            ends[i] = k = ends[j]
            put(j, _NONE)
            if k < n:
                before[k] = i
                rank = get(word[i : ends[k]])
                put(i, _NONE if rank is None else rank * width + i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                rank = get(word[h:k])
                put(h, _NONE if rank is None else rank * width + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                raw = word.encode("utf-8")
                ids = self.merge(raw)
                if len(raw) <= self.REMEMBERED_BYTES:
                    if len(known) >= self.REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.extend(ids)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def default_vocabulary() -> tuple[str, str]:
    """(path of byte_bpe_50k's ranks, its pattern) of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document. The vocabulary (about 1 MB, fixed) is broadcast; there is no shuffle but of small inputs."""
    if path is None:
        path, pattern = default_vocabulary()
    shared = documents.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))
    key = documents.schema["doc_id"]

    def encode(batches):
        tokenizer = SegmentTreeBPE(*shared.value)
        for batch in batches:
            ids = [tokenizer.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return spread(documents.select("doc_id", "text")).mapInArrow(encode, f"doc_id {key.dataType.simpleString()}, ids array<int>")
