"""Passages that repeat anywhere in a corpus: the plan behind operators 2 and 9.

A text is a sequence of units (words or bytes). A window is ``length`` consecutive
units of one document; it repeats if its units also start anywhere else. Every unit
that a repeating window covers is marked.

1. Every window has one anchor, its first k-gram of least hash, so equal windows have an
   equal anchor at an equal place. The windows of an anchor are consecutive; together
   they cover its context. Each anchor goes out as a row with the hash of its context.
2. Anchors are counted with map-side aggregation. One that occurs once cannot be in a
   repeating window and goes no further; nothing else is decided by a count of anchors.
3. Equal contexts are one, marked ``several`` where it stands for more than one place.
   Contexts meet by anchor, the prefix that their suffixes share, in shards of bounded
   size. The operator's solver (suffix trees in ``substrings``, suffix arrays in
   ``byte_repeats``) finds the repeating windows of a shard.
4. An anchor with more than ``heavy`` unlike contexts fits no shard; the operator has its
   own way to split it (``Plan.split``): longer prefixes, or arrays merged across shards.
5. Spans found in a context go to all places of that context, and to their documents.

Hashes are of 64 bits and compared together with a second one. Joins have plain shuffles
on both sides, so adaptive execution can split a key that holds many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SHIFT = np.uint64(31)
FACTOR = np.uint64(0xBF58476D1CE4E5B9)
OTHER = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Contexts:
    """Contexts of a shard, sorted by anchor: hashes, the anchor's place in each, whether each stands for several places, and bodies."""

    a: np.ndarray
    c: np.ndarray
    place: np.ndarray
    several: np.ndarray
    body: list[bytes]


@dataclass(frozen=True)
class Plan:
    """``units``: words or bytes; ``gram`` is a power of two and at most ``length``; a shard has about ``shard`` bytes.

    ``solve`` gives the context and the place in it of every repeating window of a shard.
    ``split`` takes the bodies of heavy anchors and gives (a, c, s, e) like ``solved``.
    """

    units: str
    length: int
    gram: int
    solve: Callable
    split: Callable
    shard: int = 1 << 20
    heavy: int = 3_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> SHIFT) * FACTOR
    return (x ^ x >> SHIFT) * FACTOR


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, INVERSE):
        x = np.ones(n, np.uint64)
        step, done = np.uint64(base), 1
        with np.errstate(over="ignore"):
            while done < n:
                more = min(done, n - done)
                x[done : done + more] = x[:more] * step
                step, done = step * step, done + more
        out.append(x)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 19, 1 << (n - 1).bit_length() if n else 1))


class Words:
    """Words of a text, runs between ASCII white space, and their hashes."""

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode().split()

    def values(self, texts: list[list[bytes]]) -> np.ndarray:
        import xxhash

        every = [w for text in texts for w in text]
        known = {w: xxhash.xxh64_intdigest(w, 5) for w in set(every)}
        return np.fromiter(map(known.__getitem__, every), np.uint64, len(every))

    def cut(self, text: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(text[a:b])


class Bytes:
    TABLE = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)))

    def split(self, text: str | None) -> bytes:
        return (text or "").encode()

    def values(self, texts: list[bytes]) -> np.ndarray:
        return self.TABLE[np.frombuffer(b"".join(texts), np.uint8)]

    def cut(self, text: bytes, a: int, b: int) -> bytes:
        return text[a:b]


READERS = {"words": Words(), "bytes": Bytes()}


class Hashes:
    """Hashes of any stretch of a sequence, by prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])

    def sized(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hashes that tell stretches of other sizes and places apart."""
        with np.errstate(over="ignore"):
            return mixed(self.of(a, b) + (place.astype(np.uint64) * OTHER ^ (b - a).astype(np.uint64) * FACTOR))


def anchors(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor of these documents, its first window and how many it has; every window has one anchor."""
    n, width = len(values), length - gram + 1
    long = ends - starts >= length
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, span, factor = values, 1, np.uint64(BASE)
    with np.errstate(over="ignore"):
        while span < gram:
            h = h[:-span] + h[span:] * factor
            span, factor = 2 * span, factor * factor
        h = mixed(h)
    # Half of a hash and the place: of equal halves the first counts, which is the same one in equal windows.
    pick = _least(h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), width) & np.uint64(0xFFFFFFFF)
    edges = np.zeros(n + 1, np.int64)
    edges[starts[long]] += 1
    np.add.at(edges, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edges[: len(pick)]) > 0)
    pick = pick[window].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
    return pick[first], h[pick[first]], window[first], np.diff(np.append(first, len(pick)))


ANCHORS = "a long, c long, k long, s int, n int, place int"


def _anchor_rows(plan: Plan) -> Callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        units = READERS[plan.units]

        def rows(keys: list[int], texts: list) -> pa.RecordBatch:
            values = units.values(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            at, h, s, n = anchors(values, starts, ends, plan.length, plan.gram)
            doc = np.searchsorted(ends, at, side="right")
            c = Hashes(values).sized(s, s + n + plan.length - 1, at - s)
            columns = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.array(keys, np.int64)[doc]), *(pa.array(x.astype(np.int32)) for x in (s - starts[doc], n, at - s))]
            return pa.RecordBatch.from_arrays(columns, ["a", "c", "k", "s", "n", "place"])

        for batch in batches:
            keys, texts, total = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = units.split(text.as_py())
                if len(own) < plan.length:
                    continue
                keys.append(key.as_py())
                texts.append(own)
                total += len(own)
                if total >= 1 << 18:
                    yield rows(keys, texts)
                    keys, texts, total = [], [], 0
            if keys:
                yield rows(keys, texts)

    return run


BODIES = "a long, c long, place int, several boolean, body binary"


def _body_rows(plan: Plan) -> Callable:
    """Bodies of the wanted contexts of each document."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        units = READERS[plan.units]
        names = ["a", "c", "place", "several", "body"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                own = units.split(text.as_py())
                for x in wanted.as_py():
                    for column, value in zip(rows, (x["a"], x["c"], x["place"], x["several"], units.cut(own, x["s"], x["s"] + x["n"] + plan.length - 1)), strict=True):
                        column.append(value)
                if len(rows[0]) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)
                    rows = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    return run


def spans(context: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a context: its index, first unit and end."""
    order = np.lexsort((at, context))
    context, at = context[order], at[order]
    new = np.concatenate(([True], (context[1:] != context[:-1]) | (at[1:] > at[:-1] + 1))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return context[first], at[first], at[last] + length


SOLVED = "a long, c long, s int, e int"


def solved_rows(found: Contexts, context: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    own, s, e = spans(context, at, length)
    return pa.RecordBatch.from_arrays([pa.array(found.a[own]), pa.array(found.c[own]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["a", "c", "s", "e"])


def contexts_of(table: pa.Table) -> Contexts:
    return Contexts(table.column("a").to_numpy(), table.column("c").to_numpy(), table.column("place").to_numpy(), table.column("several").to_numpy(), table.column("body").to_pylist())


def shards(batches, bytes_: int, group: str = "a") -> Iterator[pa.Table]:
    """Tables of about ``bytes_`` bytes of bodies from rows sorted by ``group``; a group is in one table."""

    def cut(table: pa.Table, ended: bool) -> Iterator[pa.Table]:
        """Shards of the table, and last what is left of it: the last group, unless ``ended``."""
        key = table.column(group).to_numpy()
        whole = len(key) if ended else int(np.searchsorted(key, key[-1]))
        sizes = np.cumsum(pc.binary_length(table.column("body")).to_numpy())
        at = 0
        while at < whole:
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + bytes_)) + 1
            to = int(np.searchsorted(key, key[min(to, whole) - 1], side="right"))
            yield table.slice(at, to - at)
            at = to
        yield table.slice(whole)

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("body"))).as_py() or 0
        if size >= bytes_:
            *whole, rest = cut(pa.Table.from_batches(held), False)
            yield from whole
            held = rest.to_batches()
            size = pc.sum(pc.binary_length(rest.column("body"))).as_py() or 0
    if held:
        yield from (x for x in cut(pa.Table.from_batches(held), True) if x.num_rows)


def solved(bodies: DataFrame, plan: Plan) -> DataFrame:
    """a, c, s, e: spans of repeating windows in each context; an anchor's contexts meet in one shard."""

    def run(batches):
        for table in shards(batches, plan.shard):
            found = contexts_of(table)
            yield solved_rows(found, *plan.solve(found), plan.length)

    return bodies.repartition("a").sortWithinPartitions("a").mapInArrow(run, SOLVED)


def repeated_spans(texts: DataFrame, plan: Plan) -> DataFrame:
    """k, s, e: stretches of units of the text with key k that repeating windows cover; ``texts`` has k, text.

    Each step is a table of its own, deleted after its last use, so that the disk holds
    the shuffle of one step at a time.
    """
    found = written(texts.select("k", "text").mapInArrow(_anchor_rows(plan), ANCHORS), "anchors", rows=1_000)
    often = written(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "anchor-counts")
    places = written(found.join(often, "a"), "places")
    discard(found, often)
    contexts = written(places.groupBy("a", "c").agg((F.count("*") > 1).alias("several"), F.min(F.struct("k", "s", "n", "place")).alias("at")), "contexts")
    many = written(contexts.groupBy("a").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > plan.heavy), "heavy-anchors")
    split = bool(many.limit(1).count())

    def bodies(rows: DataFrame) -> DataFrame:
        wanted = F.struct("a", "c", "several", *[F.col(f"at.{x}").alias(x) for x in ("s", "n", "place")])
        asked = rows.groupBy(F.col("at.k").alias("k")).agg(F.collect_list(wanted).alias("wanted"))
        return texts.select("k", "text").join(asked, "k").select("text", "wanted").mapInArrow(_body_rows(plan), BODIES)

    out = [written(solved(bodies(contexts.join(many, "a", "left_anti") if split else contexts), plan), "solved", rows=1_000)]
    if split:
        large = written(bodies(contexts.join(many, "a", "left_semi")), "heavy-bodies", rows=1_000)
        out += plan.split(large, many, plan)
        discard(large)
    discard(contexts, many)
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    marked = written(places.join(every, ["a", "c"]).select("k", (places["s"] + every["s"]).alias("s"), (places["s"] + every["e"]).alias("e")), "spans")
    discard(places, *out)
    return marked


def covered(n: int, s: np.ndarray, e: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal covered stretches of a text of ``n`` units, from spans in any order."""
    if not len(s):
        return [], []
    order = np.argsort(s)
    s, e = s[order], np.maximum.accumulate(np.minimum(e[order], n))
    first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist()


def marks_of(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the spans of each row; none where the list is null."""
    at = column.offsets.to_numpy()
    s, e = (column.values.field(i).to_numpy() for i in (0, 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield s[a:b], e[a:b]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, k: the key is doc_id where it is unique and never null, else a hash of the row."""
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    unique = ids["n"] == ids["known"] and not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return docs.select("doc_id", "text", (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if unique else F.xxhash64("doc_id", "text")).alias("k"))


def marked_texts(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, text, marks (array of s, e, or null) of every document."""
    texts = keyed(docs)
    marks = repeated_spans(texts, plan).groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    return texts.join(marks, "k", "left").select("doc_id", "text", "marks")
