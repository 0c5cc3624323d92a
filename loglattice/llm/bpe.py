"""Byte-level byte-pair encoding with a segment tree (operator 8).

A text is cut by the vocabulary's pattern; each match is merged on its own. Over
the byte positions of a match stands a segment tree whose leaf at a live position
is the rank of the pair that starts there. Its root is the leftmost minimum, so a
merge takes the root, joins the two neighbours and updates at most three leaves in
logarithmic time. Results equal those of ranked merging, lowest rank first and
leftmost among equals.

Null texts count as empty: no ids, and no bytes after decoding. Text that is not
valid Unicode cannot occur in a string column. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, lean


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    none = 1 << 62
    width = 1 << (n - 1).bit_length()
    shift = n.bit_length()
    low = (1 << shift) - 1
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << shift | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            if tree[i] == value:
                return
            tree[i] = value

    while (top := tree[1]) != none:
        i = top & low
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        put(j, none)
        r = get(piece[i : after[k]]) if k < n else None
        put(i, none if r is None else r << shift | i)
        if i:
            h = before[i]
            r = get(piece[h:k])
            put(h, none if r is None else r << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes texts; ids of matches are kept in two generations of ``keep`` each."""

    def __init__(self, path: str, pattern: str, keep: int = 400_000):
        import regex

        self.ranks = load_ranks(path)
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.cut = regex.compile(pattern).findall
        self.keep, self.known, self.old = keep, {}, {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        matches = self.cut(text)
        if len(self.known) > self.keep:
            self.known, self.old = {}, self.known
        known = self.known
        for match in set(matches).difference(known):
            got = self.old.get(match)
            known[match] = np.array(merge(match.encode(), self.ranks), "<u4").tobytes() if got is None else got
        return b"".join(map(known.__getitem__, matches))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@kept
def shared_codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker, which outlives a task of this operator."""
    return Codec(path, pattern)


def round_trips(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's whole text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                ids = codec.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, shared_codec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded text: the general form of the operator."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(ranks_path, pattern)
        for batch in batches:
            ids = [codec.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([codec.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, shared_codec), "doc_id long, ids array<int>, decoded string")
