"""Benchmark decontamination by size-partitioned MinHash containment (operator 7).

Finds short test items inside long documents: pairs whose document holds at least
``threshold`` of the item's distinct shingles of ``words`` words. Words are runs
between ASCII white space after A-Z are lower-cased and ASCII punctuation is turned
into spaces; an item of fewer words is one shingle and is looked up among the runs
of as many words in a document.

Items are partitioned by size, a partition for each power of two. In one whose items
have up to m shingles the sketch of an item is its smallest shingle hashes, as many
as m - ceil(threshold * m) + 1. A document that holds ``threshold`` of an item cannot
miss that many of its shingles, so it shares a hash of the sketch: the search loses
no pair. Candidates are verified by exact containment of the shingles' texts.

The items' sketches go to the executors in blocks of at most ``block_words`` words
(a document pass for each block), so what is broadcast is bounded whatever the size
of the benchmark.

Null and empty texts hold nothing, and items without words are found nowhere.
Repeated document rows give repeated pairs; equal benchmark rows count once. Rows
with a null doc_id keep it. Extra columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean

TABLE = bytes.maketrans(
    (string.ascii_uppercase + string.punctuation).encode(),
    string.ascii_lowercase.encode() + b" " * len(string.punctuation),
)
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def runs(found: list[bytes], words: int) -> set[bytes]:
    return {b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)}


def shingles(found: list[bytes], words: int) -> set[bytes]:
    if len(found) <= words:
        return {b" ".join(found)} if found else set()
    return runs(found, words)


class Hasher:
    """Hashes of all shingles of a text; hashes of words are kept, up to ``keep`` of them."""

    def __init__(self, words: int, keep: int = 200_000):
        self.words, self.keep, self.known = words, keep, {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.keep:
            known.clear()
        for x in set(found).difference(known):
            known[x] = xxhash.xxh64_intdigest(x)
        each = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = max(len(each) - self.words + 1, min(1, len(each)))
        out = np.zeros(n, np.uint64)
        for j in range(min(self.words, len(each))):
            factor = np.uint64(pow(FACTORS[j % 5], 2 * j + 1, 1 << 64))
            out += each[j : j + n] * factor
        out ^= out >> np.uint64(29)
        out *= np.uint64(FACTORS[0])
        return out ^ out >> np.uint64(32)


@kept
def hasher(words: int) -> Hasher:
    return Hasher(words)


class Index:
    """Sketches of benchmark items, partitioned by size."""

    def __init__(self, items: list[tuple[int | None, str]], words: int, threshold: float):
        self.words, self.threshold, self.items = words, threshold, []
        self.short: dict[int, dict[bytes, list[int]]] = {}  # items of fewer words, by their number
        of, found = Hasher(words), defaultdict(list)
        for item_id, text in items:
            listed = words_of(text)
            texts = shingles(listed, words)
            if not texts:
                continue
            hashes = np.unique(of(listed))
            largest = 1 << (len(texts) - 1).bit_length()  # of the partition
            self.items.append((item_id, texts))
            if len(listed) < words:
                self.short.setdefault(len(listed), {}).setdefault(*texts, []).append(len(self.items) - 1)
                continue
            for h in hashes[: largest - math.ceil(threshold * largest - 1e-9) + 1].tolist():
                found[h].append(len(self.items) - 1)
        self.hashes = np.array(sorted(found), np.uint64)
        self.holders = [found[h] for h in self.hashes.tolist()]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, shingles shared, shingles of the item) of the items that the text holds."""
        listed = words_of(text)
        if not listed:
            return []
        out = [(self.items[i][0], 1, 1) for n, held in self.short.items() for x in held.keys() & runs(listed, n) for i in held[x]]
        if not len(self.hashes):
            return out
        hashes = hasher(self.words)(listed)
        hashes = hashes[self.seen[(hashes >> np.uint64(44)).astype(np.int64)]]
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hits = np.unique(at[self.hashes[at] == hashes])
        if not len(hits):
            return out
        texts = shingles(listed, self.words)
        for i in sorted({i for h in hits.tolist() for i in self.holders[h]}):
            item_id, own = self.items[i]
            shared = len(own & texts)
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((item_id, shared, len(own)))
        return out


def indexes(benchmark: DataFrame, words: int, threshold: float, block_words: int):
    """An index for each block of the benchmark."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = items.filter(part == block).collect()
        yield Index(sorted(map(tuple, rows), key=lambda x: (x[0] is not None, x)), words, threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of each pair found."""
    spark, out = docs.sparkSession, None
    for index in indexes(benchmark, words, threshold, block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                rows = [(d.as_py(), *hit) for d, x in zip(batch.column(0), batch.column(1), strict=True) for hit in shared.value.matches(x.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_shingles"])

        found = docs.select("doc_id", "text").mapInArrow(lean(run, hasher), "doc_id long, item_id long, n_shared long, n_shingles long")
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` without documents that hold an item; columns stay as they are."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for index in indexes(benchmark, words, threshold, block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(x.as_py()) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(lean(run, hasher), docs.schema)
    return docs


ORACLE_SQL = r"""
WITH cut AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
listed AS (
  SELECT kind, id, r, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+') AS w FROM cut),
shingled AS (
  SELECT DISTINCT kind, id, r, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM listed WHERE len(w) > 0),
sized AS (SELECT r, count(*) AS n FROM shingled WHERE kind = 1 GROUP BY r)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(z.n) AS n_shingles, count(*) / any_value(z.n) AS containment
FROM shingled d JOIN shingled i ON d.kind = 0 AND i.kind = 1 AND d.s = i.s JOIN sized z ON z.r = i.r
GROUP BY d.r, d.id, i.r, i.id HAVING count(*) >= 0.8 * any_value(z.n) - 1e-9
"""
