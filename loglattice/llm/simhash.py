"""SimHash near-duplicates by pivot distance tables (operator 4).

Fingerprint: over the word shingles of a text, A-Z lower-cased, a bit is set if it is
set in more than half of the shingles' XXH64 values. Two fingerprints link if at most
``radius`` bits differ; a component is what links connect.

Search works on distinct fingerprints. The pivot table holds each fingerprint's
Hamming distances to ``PIVOTS`` reference fingerprints. Fingerprints that share
enough of their blocks (five blocks for radius 3, any two equal: no pair within the
radius is missed) meet in a bucket; there every pair is discarded of which a
coordinate of the table differs by more than the radius, since the triangle
inequality then puts it beyond the radius, and survivors are verified bit by bit.
A bucket does not emit its pairs but a chain through each connected set in it, so
links grow with the fingerprints. A bucket of more than ``heavy`` fingerprints is
split further by cells of two pivot coordinates, each fingerprint going to its own
cell and the one above; any pair within the radius meets in some cell.

``one_of_each`` is the operator as a stage: links by fingerprint come first, through the
pivot table, as above and none checked away; ``copies`` then adds copies by Jaccard
similarity of word shingles, which three bits of 64 cannot see.

Texts without words, null ones among them, have fingerprint zero and link like any
other. Null doc_ids keep a row; they have the component of their fingerprint, which
is null if no document with an id is in it. Repeated rows give repeated rows. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, written

PIVOTS = 16
MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """SplitMix64: the x-th reference fingerprint."""
    x = (x * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


REFERENCES = np.array([_mixed(i) for i in range(1, PIVOTS + 1)], np.uint64)


def shingles(text: str | None, words: int) -> list[bytes]:
    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    import xxhash

    parts = shingles(text, words)
    if not parts:
        return 0
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), "<u8", len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Pairs of equal blocks to look for; with radius + 2 blocks, some two of them are equal."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b - a) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def connected(fps: np.ndarray, table: np.ndarray, radius: int) -> list[np.ndarray]:
    """The links (rows of two indexes) that connect each connected set of ``fps``, a row of 64-bit words each.

    A set of m fingerprints gives m - 1 links, in the order of a search from one of them.
    """
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int64)
    waiting, out = order, []
    while len(waiting) > 1:
        queue, pairs = [waiting[0]], []
        waiting, first = waiting[1:], first[1:]
        while queue and len(waiting):
            x = queue.pop()
            at = int(table[x, 0])
            lo, hi = np.searchsorted(first, [at - radius, at + radius + 1])
            near = waiting[lo:hi]
            near = near[np.abs(table[near, 1:].astype(np.int16) - table[x, 1:]).max(1, initial=0) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[x]).sum(1, dtype=np.int64) <= radius]
            if len(near):
                queue += near.tolist()
                pairs.append(np.column_stack((np.full(len(near), x), near)))
                rest = ~np.isin(waiting, near)
                waiting, first = waiting[rest], first[rest]
        if pairs:
            out.append(np.concatenate(pairs))
    return out


def links(nodes: DataFrame, radius: int = 3, heavy: int = 50_000) -> DataFrame:
    """a, b: chains through what links connect in each bucket; ``nodes`` has fp, rep, pivots."""
    chosen = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keyed = nodes.select("fp", "rep", "pivots", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "part"))
    keyed = keyed.withColumn("key", F.xxhash64("mask", "part"))
    counts = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "simhash-buckets")
    keyed = keyed.select("fp", "rep", "pivots", "key").join(counts, "key")
    width = radius + 1
    cells = [F.floor(F.conv(F.hex(F.substring("pivots", j, 1)), 16, 10).cast("int") / width) for j in (1, 2)]
    both = F.array(*[F.xxhash64("key", cells[0] + i, cells[1] + j) for i in (0, 1) for j in (0, 1)])
    routed = keyed.select("fp", "rep", "pivots", F.explode(F.when(F.col("n") > heavy, both).otherwise(F.array("key"))).alias("key"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        rest = None
        for batch in batches:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
            keys = rest.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from solve(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    def solve(rows: pa.Table):
        keys, fps, reps = (rows.column(x).to_numpy() for x in ("key", "fp", "rep"))
        fps = fps.view(np.uint64)
        table = np.frombuffer(b"".join(rows.column("pivots").to_pylist()), np.uint8).reshape(-1, PIVOTS)
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(edges)
        # Buckets of two all at once: the table discards, the bits verify.
        i = edges[:-1][sizes == 2]
        i = i[np.abs(table[i].astype(np.int16) - table[i + 1]).max(1, initial=0) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + 1]) <= radius]
        a, b = [np.minimum(reps[i], reps[i + 1])], [np.maximum(reps[i], reps[i + 1])]
        for lo, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for pairs in connected(fps[lo : lo + size, None], table[lo : lo + size], radius):
                chain = np.unique(reps[lo + pairs])
                a.append(chain[:-1])
                b.append(chain[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    return routed.repartition("key").sortWithinPartitions("key").select("key", "fp", "rep", "pivots").mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest node that each node of ``edges`` (a, b) is connected to.

    Labels spread to neighbours and jump to the label of their label, until none changes;
    each round makes some label smaller, so this ends.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        met = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("far"))
        step, before = written(met.join(jump, "root").select("v", "old", F.least("root", "far").alias("root")), "labels"), labels
        labels = step.select("v", "root")
        labels.written_to = step.written_to
        discard(before)
        if not step.filter("old <> root").limit(1).count():
            discard(both)
            return labels


def measured(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, rep) with their rows of the pivot table."""

    def measure(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            table = np.bitwise_count(own[:, None] ^ REFERENCES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in table], pa.binary())], ["fp", "rep", "pivots"])

    return nodes.mapInArrow(lean(measure), "fp long, rep long, pivots binary")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    fps = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = written(measured(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null")), "pivot-table")
    roots = components(links(nodes, radius))
    classes = written(nodes.select("fp", "rep").join(roots, F.col("rep") == F.col("v"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "classes")
    return fps.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def links_by_fingerprint(found: DataFrame, radius: int) -> DataFrame:
    """a, b: links that connect the nodes of ``found`` (node, fp) as their fingerprints are connected within ``radius``.

    A fingerprint stands for its smallest node; its other nodes hang on that one.
    """
    found = written(found.distinct(), "fingerprints")
    reps = found.groupBy("fp").agg(F.min("node").alias("rep"))
    nodes = written(measured(reps), "pivot-table")
    equal = found.join(nodes.select("fp", "rep"), "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    out = written(links(nodes, radius).union(equal).filter("a <> b").distinct(), "fingerprint-links")
    discard(found, nodes)
    return out


PARTS, MOST_PARTS, COMMON, ROUNDS = 512, 16_384, 200_000, ((1, 1), (2, 8), (9, None))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of the distinct word shingles of a text, in order."""
    import xxhash

    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words)), np.uint64))


def digest(own: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(own.astype("<u8").tobytes()), "little", signed=True)


def prefix(own: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones before ``common`` ones; two sets of at least ``similarity`` share one of theirs.

    They have ``similarity`` of the larger set in common, so all but the last of these
    fit into what a set may have alone. This holds for any order that all sets follow.
    """
    size = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
    if len(common):
        often = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate((own[~often], own[often]))
    return own[:size]


def parities(own: np.ndarray) -> bytes:
    """A set's row of the table of parities: a bit is 1 if an odd number of its hashes is in that part; parts grow with the set."""
    parts = PARTS
    while parts < MOST_PARTS and parts < len(own):
        parts *= 2
    at = (own & np.uint64(parts - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=parts) & 1).astype(bool), bitorder="little").tobytes()


class Table:
    """Rows of the table of parities, of any number of parts each; two rows compare by the parts of the coarser one."""

    def __init__(self, rows: list[bytes]):
        self.words = np.fromiter(map(len, rows), np.int64, len(rows)) // 8
        self.place, self.rows = np.zeros(len(rows), np.int64), {}
        for words in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == words)
            self.place[own] = np.arange(len(own))
            self.rows[words] = np.frombuffer(b"".join([rows[i] for i in own.tolist()]), "<u8").reshape(-1, words)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many parities differ: two sets differ in as many shingles at least."""
        out, x, y = np.zeros(len(i), np.int64), self.words[i], self.words[j]
        for p, own in self.rows.items():
            for q, other in self.rows.items():
                some, step, least = np.flatnonzero((x == p) & (y == q)), max(1, (1 << 18) // max(p, q)), min(p, q)
                for lo in range(0, len(some), step):
                    at = some[lo : lo + step]
                    a, b = (np.bitwise_xor.reduce(rows[self.place[v[at]]].reshape(len(at), -1, least), axis=1) for rows, v in ((own, i), (other, j)))
                    out[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


class Sets:
    """The sorted hashes of each row's set."""

    def __init__(self, column: pa.ListArray):
        self.ends, self.values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)

    def alike(self, i: int, j: int, similarity: float) -> bool:
        x, y = (self.values[self.ends[k] : self.ends[k + 1]] for k in (i, j))
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        return both >= similarity * (len(x) + len(y) - both) - 1e-9


def near_in_buckets(key: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, before: np.ndarray, place: np.ndarray, table: Table, similarity: float, first: int, last: int | None, sets: Sets | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Links of rows ``first`` to ``last`` places apart, of one key and two roots, and a label of what they connect for each row.

    With ``sets``, links are pairs that do reach ``similarity``, and they connect roots; without, pairs that may reach it,
    and they connect rows. A pair that links connect already is left out, so there are fewer links than rows.

    ``at`` is the place of the key in the prefix of its set, ``place`` that of the row in its bucket. If this is the first key that
    two sets share, they share one more than what follows it in either; a pair for which
    that is too little is left to the bucket of its first key, and so is one that shares
    the key ``before``, too. Sets of at least
    ``similarity`` differ in (1 - s) / (1 + s) of their sizes' sum at most; the table of parities
    discards those that differ in more.
    """
    share, n = (1 - similarity) / (1 + similarity), len(key)
    label = np.arange(n) if sets is None else np.unique(root, return_inverse=True)[1].reshape(-1)
    above = np.arange(n)

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return int(x)

    a, b, rows, step = [], [], np.arange(n), 1
    while len(rows) and (last is None or step <= last):
        rows = rows[: np.searchsorted(rows, n - step)]
        rows = rows[key[rows] == key[rows + step]]
        x = rows[(root[rows] != root[rows + step]) & (above[label[rows]] != above[label[rows + step]])]
        x = x[place[x + step] - place[x] >= first]
        if last is not None:
            x = x[place[x + step] - place[x] <= last]
        links = len(a)
        for lo in range(0, len(x), 1 << 16):
            i = x[lo : lo + (1 << 16)]
            j = i + step
            most = share * (size[i] + size[j]) + 1e-6
            shared = np.minimum(size[i] - at[i], size[j] - at[j])
            may = (np.abs(size[i] - size[j]) <= most) & (2 * shared >= size[i] + size[j] - most) & ((before[i] != before[j]) | (at[i] == 0) | (at[j] == 0))
            i, j, most = i[may], j[may], most[may]
            near = table.apart(i, j) <= most
            for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
                u, v = top(label[p]), top(label[q])
                if u != v and (sets is None or sets.alike(p, q, similarity)):
                    above[max(u, v)] = min(u, v)
                    a.append(p)
                    b.append(q)
        if len(a) > links:
            while (above[above] != above).any():
                above = above[above]
        step += 1
    return a, b, above[label]


def copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """doc_id, component_id of every document with an id: groups of copies by links of at least ``similarity``.

    With a ``radius``, fingerprints link first, as in ``near_duplicates``, and what follows
    adds to these links; groups are what links of both kinds connect.

    Similarity is the Jaccard index of the sets of word shingles, and no pair is lost.
    Documents of one set (by a digest of its hashes) are one node; so are all without
    words, null texts among them, which are copies of each other and of nothing else. Nodes meet in the buckets of their ``prefix``; the
    order that puts common shingles last comes from a sample and bears on speed alone.
    In a bucket the table of parities discards; rows that it connects go with their sets to
    one task, a row of each node and key, where the exact index of two sets
    makes a link. Pairs go by their distance in the order of a bucket, in ``ROUNDS``, and are never rows of a table; a pair
    is left out only if links found before connect it, so that groups of many copies
    do not take all their pairs. Later rounds link the groups of earlier ones.
    """
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = np.zeros(0, np.uint64)

    def listed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                found = [shingle_hashes(x.as_py(), words) for x in batch.column(1).slice(lo, 1024)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    def sketch(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                sets = [shingle_hashes(x.as_py(), words) for x in some.column(1)]
                table = [parities(x) for x in sets]
                first = [prefix(x, common, similarity).view(np.int64) for x in sets]
                fps = np.fromiter((0 if radius is None else fingerprint(x.as_py()) for x in some.column(1)), np.uint64, some.num_rows)
                columns = [pa.array([digest(x) for x in sets], pa.int64()), pa.array(fps.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(table, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "node", "fp", "size", "pivots", "keys"])

    def hashes(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [shingle_hashes(x.as_py(), words) for x in batch.column(0).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    columns = [("key", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("size", pa.int64()), ("at", pa.int32()), ("before", pa.int64()), ("pivots", pa.binary())]

    def may_meet(rows: pa.Table, first: int, last: int | None):
        """Rows that pairs of ``near_in_buckets`` connect, with the part of their bucket that is connected."""
        key, node, root, size, at, before = (rows.column(x).to_numpy() for x in ("key", "node", "root", "size", "at", "before"))
        place = np.arange(len(key))
        a, b, part = near_in_buckets(key, root, size, at, before, place, Table(rows.column("pivots").to_pylist()), similarity, first, last)
        if a:
            own = np.unique(a + b)
            some = rows.take(pa.array(own)).append_column("part", pa.array(part[own])).append_column("place", pa.array(own)).combine_chunks()
            yield from some.select([c for c, _ in columns]).cast(pa.schema(columns)).to_batches()

    def meet(rows: pa.Table, first: int, last: int | None):
        """Links between the roots of rows whose sets reach the similarity."""
        key, part, place, root, size, at, before = (rows.column(x).to_numpy() for x in ("key", "part", "place", "root", "size", "at", "before"))
        bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        sets = Sets(rows.column("shingles").combine_chunks())
        a, b, _ = near_in_buckets(bucket, root, size, at, before, place, Table(rows.column("pivots").to_pylist()), similarity, first, last, sets)
        if a:
            pairs = np.sort(np.column_stack((root[a], root[b])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def buckets(batches, solve, first: int, last: int | None):
        waiting = []
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if waiting and (cut or key[-1] != waiting[-1].column(0)[-1].as_py()):
                    yield from solve(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), first, last)
                    waiting, batch = [], batch.slice(cut)
                waiting.append(batch)
        if waiting:
            yield from solve(pa.Table.from_batches(waiting), first, last)

    sampled = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).mapInArrow(lean(listed), "key long")
    often = sampled.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "key").limit(COMMON).select("key")
    common = np.sort(often.toArrow().column(0).to_numpy().view(np.uint64))
    sketches = written(known.mapInArrow(lean(sketch), "doc_id long, node long, fp long, size long, pivots binary, keys array<long>"), "copies-sketches", rows=500)
    nodes = written(sketches.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "pivots", "keys")]), "copies-nodes")
    keyed = nodes.select("node", "keys", F.posexplode("keys").alias("at", "key")).select("node", "at", "key", F.coalesce(F.get("keys", F.col("at") - 1), F.lit(0)).alias("before"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, "key").select("key", "node", "at", "before", "n"), "copies-buckets")
    used, roots = [sketches, nodes, met], None
    if radius is not None:
        close = links_by_fingerprint(sketches.select("node", "fp"), radius)
        used.append(close)
        if close.limit(1).count():
            roots = components(close)
            used.append(roots)
    for first, last in ROUNDS:
        live = met.withColumn("root", F.col("node"))
        if roots is not None:
            live = met.filter(F.col("n") > first).join(roots, F.col("node") == F.col("v"), "left").withColumn("root", F.coalesce("root", "node"))
            mixed = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
            live = live.join(mixed, "key", "left_semi")
        rows = live.select("key", "node", "at", "before", "root").join(nodes.select("node", "size", "pivots"), "node").select("key", "node", "root", "size", "at", "before", "pivots")
        found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(partial(buckets, solve=may_meet, first=first, last=last)), ", ".join(f"{c} {kind}" for c, kind in zip(dict(columns), ("long",) * 6 + ("int", "long", "binary"), strict=True)))
        near = written(found, "copies-candidates")
        used.append(near)
        if not near.limit(1).count():
            continue
        texts = known.join(nodes.join(near.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        # An id of several texts brings sets that no row asks for; equal sets come once.
        sets = written(texts.select("text").mapInArrow(lean(hashes), "node long, shingles array<long>").dropDuplicates(["node"]), "copies-shingles", rows=200)
        whole = near.join(sets, "node").select(*dict(columns), "shingles").repartition("key", "part").sortWithinPartitions("key", "part", "place")
        exact = written(whole.mapInArrow(lean(partial(buckets, solve=meet, first=first, last=last)), "a long, b long").distinct(), "copies-links", rows=200)
        discard(sets)
        used.append(exact)
        if not exact.limit(1).count():
            continue
        joined = components(exact)
        used.append(joined)
        if roots is not None:
            moved = roots.join(joined.toDF("root", "now"), "root", "left").select("v", F.coalesce("now", "root").alias("root"))
            joined = written(moved.union(joined.join(roots, "v", "left_anti")), "copies-roots")
            used.append(joined)
        roots = joined
    if roots is None:
        classes = nodes.select("node", F.col("rep").alias("component_id"))
    else:
        rooted = nodes.join(roots, F.col("node") == F.col("v"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
        classes = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    out = written(sketches.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id"), "classes")
    discard(*used)
    return out


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` with the document of smallest id of each group of copies, by fingerprint or by similarity; rows without an id stay."""
    groups = copies(docs, words, similarity, radius)
    gone = written(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    discard(groups)
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
