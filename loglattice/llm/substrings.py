"""Substring dedup by prefix-partitioned suffix trees (operator 2).

Words are runs between ASCII white space, unchanged. Each word covered by a window of
``length`` words whose sequence also starts anywhere else, in any document, is removed;
windows are judged on the input.

Suffixes are split by prefixes of variable length: by the least of the ``gram``-word
stretches in their first ``length`` words (the anchor, see ``repeats``), and where over
``heavy`` unlike contexts share that, by a longer prefix around it: the words that all
windows of a block of offsets have in common, for blocks of ``BLOCKS`` offsets, the last
of which is the window itself. Every group so fits in memory and becomes a subtree, built
from its root down: a node's suffixes part by their next words, a suffix that is alone
ends its path, and what is left at depth ``length`` are the deep internal nodes, whose
leaves are the repeats.

Null and empty texts have no words. A document shorter than a window keeps its words.
Repeated rows repeat each other, so that rows of ``length`` words or more lose all.
Extra columns are ignored; an empty table gives no rows. Very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .repeats import READERS, Contexts, Hashes, Plan, covered, marked_texts, marks_of, solved

WINDOW, GRAM, HEAVY = 35, 16, 4_000
#: Words on an edge of a subtree.
EDGE = 8
#: Offsets in a block, for prefixes longer and longer.
BLOCKS = (4, 1)


def deep_leaves(values: np.ndarray, leaf: np.ndarray, node: np.ndarray, several: np.ndarray, depth: int) -> np.ndarray:
    """The leaves below internal nodes of ``depth``: suffixes, given by their first units, of the subtrees ``node``.

    A suffix marked ``several`` stands for more than one, so its leaf is an internal node.
    """
    hashes, at = Hashes(values), 0
    while len(leaf) and at < depth:
        to = min(at + EDGE, depth)
        edge = hashes.of(leaf + at, leaf + to)
        order = np.lexsort((edge, node))
        leaf, node, edge, several = leaf[order], node[order], edge[order], several[order]
        child = np.cumsum(np.concatenate(([True], (node[1:] != node[:-1]) | (edge[1:] != edge[:-1])))) - 1
        inner = (np.bincount(child)[child] > 1) | several
        leaf, node, several, at = leaf[inner], child[inner], several[inner], to
    return leaf


def _windows(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Values of all words, the first word of each body, and each window: its first word and its body."""
    words = [x.split() for x in bodies]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), np.maximum(sizes - length + 1, 0))
    counts = np.maximum(sizes - length + 1, 0)
    leaf = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    return READERS["words"].values(words), starts, leaf, owner, words


def subtrees(length: int) -> Callable[[Contexts], tuple[np.ndarray, np.ndarray]]:
    """The repeating windows of a shard: a subtree for each anchor."""

    def solve(found: Contexts) -> tuple[np.ndarray, np.ndarray]:
        values, starts, leaf, owner, _ = _windows(found.body, length)
        root = np.cumsum(np.concatenate(([False], found.a[1:] != found.a[:-1])))
        deep = deep_leaves(values, leaf, root[owner], found.several[owner], length)
        own = owner[np.searchsorted(leaf, deep)]
        return own, deep - starts[own]

    return solve


LONGER = "a long, c long, place int, several boolean, body binary, top_a long, top_c long, first int"


def _longer(length: int, width: int) -> Callable:
    """Contexts by longer prefixes: one for each block of ``width`` offsets of the anchor that they have windows of."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                some = batch.slice(lo, 2_000)
                if not some.num_rows:
                    continue
                a, place, first = (some.column(x).to_numpy() for x in ("a", "place", "first"))
                values, starts, leaf, owner, words = _windows(some.column("body").to_pylist(), length)
                block = (place[owner] - (leaf - starts[owner])) // width
                new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))))
                own, n = owner[new], np.diff(np.append(new, len(leaf)))
                s = leaf[new] - starts[own]  # in the body
                hashes, core = Hashes(values), starts[own] + place[own] - block[new] * width
                with np.errstate(over="ignore"):
                    prefix = hashes.sized(core, core + length - width + 1, block[new]) ^ (a[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                around = hashes.sized(leaf[new], leaf[new] + n + length - 1, place[own] - s)
                body = [b" ".join(words[i][x : x + m + length - 1]) for i, x, m in zip(own.tolist(), s.tolist(), n.tolist(), strict=True)]
                take = lambda name, some=some, own=own: some.column(name).take(pa.array(own))
                columns = [pa.array(prefix.view(np.int64)), pa.array(around.view(np.int64)), pa.array((place[own] - s).astype(np.int32)), take("several"), pa.array(body, pa.binary()), take("top_a"), take("top_c"), pa.array((first[own] + s).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "c", "place", "several", "body", "top_a", "top_c", "first"])

    return run


def by_longer_prefixes(bodies: DataFrame, many: DataFrame, plan: Plan) -> list[DataFrame]:
    """Spans in the contexts of heavy anchors, whose prefixes are made longer until a group fits."""
    out, used = [], []
    rows = bodies.withColumns({"top_a": F.col("a"), "top_c": F.col("c"), "first": F.lit(0)})
    for width in BLOCKS:
        rows = written(rows.mapInArrow(_longer(plan.length, width), LONGER), "longer-prefixes", rows=2_000)
        unlike = written(rows.groupBy("a", "c").agg(((F.count("*") > 1) | F.max("several")).alias("several"), F.first("place").alias("place"), F.first("body").alias("body")), "longer-contexts")
        # A prefix of one place is a leaf.
        sizes = written(unlike.groupBy("a").agg(F.count("*").alias("n"), F.max("several").alias("several")).filter("n > 1 or several").select("a", "n"), "longer-counts")
        fit = sizes.filter((F.col("n") <= plan.heavy) | F.lit(width == 1)).select("a")
        found = written(solved(unlike.join(fit, "a", "left_semi").select("a", "c", "place", "several", "body"), plan), "longer-solved", rows=2_000)
        out.append(written(rows.join(found, ["a", "c"]).select(F.col("top_a").alias("a"), F.col("top_c").alias("c"), (rows["first"] + found["s"]).alias("s"), (rows["first"] + found["e"]).alias("e")), "longer-spans"))
        used += [rows, unlike, sizes]
        discard(found)
        large = sizes.filter((F.col("n") > plan.heavy) & F.lit(width > 1)).select("a")
        if not large.limit(1).count():
            break
        rows = rows.join(large, "a", "left_semi")
    discard(*used)
    return out


def plan(length: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> Plan:
    return Plan("words", length, gram, subtrees(length), by_longer_prefixes, heavy=heavy)


def _kept(text: str | None, marks: tuple) -> tuple[int, int, list[bytes]]:
    words = (text or "").encode().split()
    starts, ends = covered(len(words), *marks)
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), kept


def without_repeats(docs: DataFrame, length: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (text), or kept_sha256, of every document."""
    last = "kept_sha256" if digest else "kept"

    def run(batches):
        for batch in batches:
            rows = [_kept(t.as_py(), m) for t, m in zip(batch.column(1), marks_of(batch.column(2)), strict=True)]
            kept = (b" ".join(x[2]) for x in rows)
            kept = pa.array([hashlib.sha256(x).hexdigest() if digest else x.decode() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), kept], ["doc_id", "n_words", "n_removed", last])

    return marked_texts(docs, plan(length, gram, heavy)).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


ORACLE_SQL = r"""
WITH listed AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM listed WHERE len(w) >= 35),
again AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM again),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM listed),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (r)
"""
