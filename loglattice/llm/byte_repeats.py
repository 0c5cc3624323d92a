"""Suffix-array dedup of byte strings (operator 9).

Texts are UTF-8 bytes. Each byte covered by a string of ``length`` bytes that also
starts anywhere else, in any document, is removed; strings are judged on the input and
never cross documents.

Shards hold the contexts of anchors (see ``repeats``). Each has a suffix array by
Larsson-Sadakane refinement and its common prefixes by Kasai's bound; suffixes next to
each other that share ``length`` bytes are repeats. An anchor's contexts are in one shard
as long as they fit; one with over ``heavy`` unlike contexts has several shards, each with
an array of its own, and these are merged: every shard puts the strings that its array
tells apart in order of their digests, cuts the list at the bounds of digest ranges, and
in each range the lists of all shards are merged and searched by bisection for strings
that another shard has, too.

Null and empty texts have no bytes. A text shorter than ``length`` keeps its bytes.
Repeated rows repeat each other. Extra columns are ignored; an empty table gives no
rows. Very long texts are taken whole. What is kept of a text may not be valid UTF-8, so
it is returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written
from .repeats import READERS, Contexts, Hashes, Plan, contexts_of, covered, marked_texts, marks_of, shards, solved_rows
from .suffixes import deep_nodes

LENGTH, GRAM, HEAVY = 200, 64, 3_000
ENTRY = np.dtype([("h", "<u8"), ("a", "<i8"), ("c", "<i8"), ("at", "<i4"), ("known", "?")])


def _array(found: Contexts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the shard's repeats and the first leaf of each repeat's run; then the first byte, owner and last byte of all strings."""
    sizes = np.fromiter(map(len, found.body), np.int64, len(found.body))
    raw = b"".join(found.body)
    units = np.frombuffer(raw, np.uint8)
    heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw + bytes(8), np.uint8), 8)[: len(units)].copy().view(">u8").ravel().astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    nodes = deep_nodes(units, heads, 8, np.arange(len(units)) + length <= ends[owner], length)
    counts = nodes.stop - nodes.first
    run = np.cumsum(counts) - counts
    leaf = nodes.leaves[np.repeat(nodes.first - run, counts) + np.arange(int(counts.sum()))]
    return leaf, run, starts, owner, ends


def suffix_arrays(length: int) -> Callable[[Contexts], tuple[np.ndarray, np.ndarray]]:
    """The repeating strings of a shard; all of a context that stands for several places."""

    def solve(found: Contexts) -> tuple[np.ndarray, np.ndarray]:
        leaf, _, starts, owner, ends = _array(found, length)
        lone = found.several[owner] & (np.arange(len(owner)) + length <= ends[owner])
        lone[leaf] = True
        leaf = np.flatnonzero(lone)
        return owner[leaf], leaf - starts[owner[leaf]]

    return solve


def _pieces(plan: Plan, parts: int) -> Callable:
    """Spans of the repeats inside each shard, and its strings by digest, cut into ``parts`` ranges."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, plan.shard, "g"):
            found = contexts_of(table)
            leaf, first, starts, owner, ends = _array(found, plan.length)
            string = np.arange(len(owner)) + plan.length <= ends[owner]
            hit = found.several[owner] & string
            hit[leaf] = True
            inside = np.flatnonzero(hit)
            spans = solved_rows(found, owner[inside], inside - starts[owner[inside]], plan.length)
            n = spans.num_rows
            yield pa.RecordBatch.from_arrays([*spans.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["a", "c", "s", "e", "part", "strings"])
            one = string.copy()  # one of each run of equal strings
            one[leaf] = False
            one[leaf[first]] = True
            at = np.flatnonzero(one)
            own = owner[at]
            rows = np.zeros(len(at), ENTRY)
            rows["h"] = Hashes(READERS["bytes"].values([b"".join(found.body)])).of(at, at + plan.length)
            rows["a"], rows["c"], rows["at"], rows["known"] = found.a[own], found.c[own], at - starts[own], hit[at]
            rows = rows[np.argsort(rows["h"])]
            bounds = np.searchsorted(rows["h"], np.array([(x << 64) // parts for x in range(1, parts)], np.uint64))
            cut = [x.tobytes() for x in np.split(rows, bounds)]
            none = pa.nulls(parts, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.nulls(parts, pa.int32()) for _ in range(2)), pa.array(range(parts), pa.int32()), pa.array(cut, pa.binary())], ["a", "c", "s", "e", "part", "strings"])

    return run


def _merge(plan: Plan) -> Callable:
    """Spans of strings that lists of two shards or more have."""

    def across(lists: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(lists)
        every = every[np.lexsort((every["a"], every["h"]))]
        found = []
        for one in lists:
            lo, hi = (np.searchsorted(every["h"], one["h"], side) for side in ("left", "right"))
            more = np.flatnonzero((hi - lo > 1) & ~one["known"])
            same = [i for i in more.tolist() if np.count_nonzero(every["a"][lo[i] : hi[i]] == one["a"][i]) > 1] if len(more) else []
            found.append(one[same])
        hits = np.concatenate(found)
        context, own = np.unique(hits[["a", "c"]], return_inverse=True)
        empty = np.zeros(0)
        return solved_rows(Contexts(context["a"].copy(), context["c"].copy(), empty, empty, []), own, hits["at"].astype(np.int64), plan.length)

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, lists = None, []
        for batch in batches:
            for of, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of != part and lists:
                    yield across(lists)
                    lists = []
                part = of
                lists.append(np.frombuffer(raw.as_py(), ENTRY))
        if lists:
            yield across(lists)

    return run


def by_merging(bodies: DataFrame, many: DataFrame, plan: Plan) -> list[DataFrame]:
    """Spans in the contexts of heavy anchors, dealt over shards whose arrays are merged."""
    parts = shuffle_partitions(bodies.sparkSession)
    shard = F.xxhash64("a", F.pmod("c", F.ceil(F.col("contexts") / plan.heavy)))
    dealt = bodies.join(many, "a").select("a", "c", "place", "several", "body", shard.alias("g"))
    pieces = written(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_pieces(plan, parts), "a long, c long, s int, e int, part int, strings binary"), "pieces", rows=2_000)
    lists = pieces.filter("part is not null and length(strings) > 0").select("part", "strings")
    across = written(lists.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(plan), "a long, c long, s int, e int"), "merged", rows=100)
    inside = written(pieces.filter("part is null").select("a", "c", "s", "e"), "inside")
    discard(pieces)
    return [inside, across]


def plan(length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, shard: int = 1 << 20) -> Plan:
    return Plan("bytes", length, gram, suffix_arrays(length), by_merging, shard, heavy)


def _kept(text: str | None, marks: tuple) -> tuple[int, int, int, bytes]:
    raw = (text or "").encode()
    starts, ends = covered(len(raw), *marks)
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    out = b"".join(kept)
    return len(raw), len(raw) - len(out), len(starts), out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, shard: int = 1 << 20, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary), or kept_sha256, of every document."""
    last, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches):
        for batch in batches:
            rows = [_kept(t.as_py(), m) for t, m in zip(batch.column(1), marks_of(batch.column(2)), strict=True)]
            kept = pa.array([hashlib.sha256(x[3]).hexdigest() for x in rows], pa.string()) if digest else pa.array([x[3] for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([x[i] for x in rows], pa.int64()) for i in range(3)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return marked_texts(docs, plan(length, gram, heavy, shard)).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")
