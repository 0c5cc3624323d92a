"""Token ids in directly addressable codes (operator 3).

An id is cut into 8-bit chunks, lowest first. Level 0 holds the lowest chunk of
every id, level k the k-th chunk of those ids that need one. A bitmap beside each
level says which of its entries continue in the next one, and a rank directory
(set bits before every 512th position) turns a position of one level into the
position of the next. Any id is so read with one chunk and one rank per level and
without decoding its neighbours.

A file is a Parquet table of segments; each row holds one binary segment:

    "DAC1" | u32 documents | u64 ids | u32 levels
    i64 doc_id[documents] | u8 has_id[documents] | u64 first id[documents + 1]
    per level: u64 entries | u8 chunk[entries] | u8 bitmap[ceil(entries / 8)]
               | u32 rank[ceil(entries / 512) + 1]

All numbers are little-endian. A segment closes at the first document end after
``tokens_per_segment`` ids, so memory is bounded by that and the longest document.

Null texts count as empty; a document always ends with ``end_id``. Documents are
in ascending doc_id order (null ids first, equal ids by text). An empty table gives
an empty file. Extra columns of the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, shuffle_partitions

BLOCK = 512
HEADER = struct.Struct("<4sIQI")
SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("first", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("blob", T.BinaryType()),
])


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """The segment of ``ids``, the concatenated ids of documents with these counts."""
    levels = []
    rest = ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        rest = rest[more] >> 8
        if not len(rest):
            break
    out = [
        HEADER.pack(b"DAC1", len(doc_ids), len(ids), len(levels)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], "u1").tobytes(),
        np.concatenate(([0], np.cumsum(np.array(counts, "<i8")))).astype("<u8").tobytes(),
    ]
    for chunks, more in levels:
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        out += [
            struct.pack("<Q", len(chunks)),
            chunks.tobytes(),
            np.packbits(more, bitorder="little").tobytes(),
            np.concatenate(([0], np.cumsum(blocks))).astype("<u4").tobytes(),
        ]
    return b"".join(out)


class Segment:
    """A segment read from its bytes, without copying them."""

    def __init__(self, blob: bytes):
        magic, n_docs, self.n_tokens, n_levels = HEADER.unpack_from(blob)
        if magic != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK) + 1)))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            whole = bitmap[block * BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + sum(int(b).bit_count() for b in whole) + (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        rest = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
            out[more] |= rest << 8
            rest = out
        return rest


#: Kinds of bytes; the apostrophe is apart since it can begin a match of the tokenizer's split.
LETTER, DIGIT, PUNCTUATION, APOSTROPHE = 1, 2, 3, 4
KINDS = np.array([0 if x < 33 or x > 126 else LETTER if chr(x).isalpha() else DIGIT if chr(x).isdigit() else APOSTROPHE if chr(x) == "'" else PUNCTUATION for x in range(256)], np.uint8)
#: No match of the split holds two neighbours of these kinds, and no normal form joins them.
CUTS = np.zeros((5, 5), bool)
CUTS[[LETTER, LETTER, LETTER, PUNCTUATION, PUNCTUATION], [DIGIT, PUNCTUATION, APOSTROPHE, LETTER, DIGIT]] = True
CUTS[DIGIT, 1:] = True
CUTS = CUTS.ravel()
#: Below this, letters are long assigned and no two of them compose.
PLAIN_BELOW = "\u0530"


def is_plain(stem: str) -> bool:
    """Whether a run is of letters that stay letters in lower case, so that the split ends with them.

    The capital I with a dot does not: it becomes a letter and a mark, which the split
    takes together with punctuation that follows.
    """
    return stem.isalpha() and (stem.isascii() or max(stem) < PLAIN_BELOW and stem.lower().isalpha())


PLAIN = np.array([is_plain(chr(x)) for x in range(ord(PLAIN_BELOW))])


def cut_texts(texts: pa.Array, whole: list[str]) -> pa.Array:
    """Texts with a space where the split cuts anyway and for line feeds, and with A-Z in lower case.

    Cuts are between ASCII characters by their kinds, and between a plain letter of two
    bytes and punctuation. A capital before a byte over 127 stays: what follows may compose
    with one of its cases only. Texts that contain one of ``whole`` only lose line feeds.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    kept = None
    for token in whole:
        found = pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        kept = found if kept is None else kept | found
    kinds = KINDS[data]
    if kept is not None and kept.any():
        kinds[np.repeat(kept, np.diff(offsets))] = 0
    cut = np.zeros(len(data), bool)
    cut[1:] = CUTS[kinds[:-1] * np.uint8(5) + kinds[1:]]
    after = np.flatnonzero((kinds[2:] == PUNCTUATION) & (data[1:-1] > 127)) + 2
    lead = data[after - 2]
    after, lead = after[(lead >= 0xC2) & (lead < 0xD5)], lead[(lead >= 0xC2) & (lead < 0xD5)]
    code = (lead.astype(np.int64) & 31) << 6 | data[after - 1] & 63
    after = after[code < len(PLAIN)]
    cut[after[PLAIN[code[code < len(PLAIN)]]]] = True
    capital = (kinds == LETTER) & (data < 97)
    capital[:-1] &= data[1:] < 128
    data[capital] += 32
    data[data == 10] = 32
    at = np.flatnonzero(cut)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets + np.searchsorted(at, offsets)), pa.py_buffer(np.insert(data, at, 32))])


def gathered(pool: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` of these places and lengths, one after another."""
    ends = np.cumsum(counts)
    return pool[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class Known:
    """The ids of runs in one array, and where each run's are."""

    def __init__(self):
        self.places, self.pool, self.starts = {}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def add(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.places), len(runs)
        at = self.starts[n]
        if n + m >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(n + m, np.int64)))
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(at + len(ids), np.uint32)))
        self.pool[at : at + len(ids)] = ids
        self.starts[n + 1 : n + m + 1] = at + np.cumsum(sizes)
        self.places.update(zip(runs, range(n, n + m), strict=True))

    def find(self, runs: list[str]) -> np.ndarray:
        """The place of each run, -1 for those not known."""
        return np.fromiter(map(self.places.get, runs, repeat(-1)), np.int64, len(runs))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[places]
        sizes = self.starts[places + 1] - first
        return gathered(self.pool, first, sizes), sizes


class WordEncoder:
    """Ids of whole texts by a tokenizer whose words end at white space.

    Its normalizer and its split work within runs between spaces or line feeds, so
    equal runs have equal ids. Texts get more spaces first, where its split cuts anyway
    (see ``cut_texts``), so that there are fewer different runs. Ids of runs are kept in
    two generations of at most ``keep`` entries each, and those of one batch.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.known, self.old = Known(), Known()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # With an ending symbol for each of the 256 bytes, a word has one ending token, its last.
        self.whole = sum(len(token) == 5 for token in vocabulary if token.endswith("</w>")) >= 256

    def _letters(self, words: list[str]) -> None:
        """Learn words of plain letters: each is one piece of the split, which ends with its only ending token."""
        if not self.whole:
            self._each(words)
            return
        for i in range(0, len(words), 1 << 14):
            some = words[i : i + (1 << 14)]
            ids, sizes = self._encoded([" ".join(some[j : j + 16]) for j in range(0, len(some), 16)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # Each text ends where its words do, and there is an end for each word.
            if len(cuts) == len(some) and (cuts[15::16] == np.cumsum(sizes)[: len(some) // 16]).all():
                self.known.add(some, ids, np.diff(cuts, prepend=0))
            else:
                self._each(some)

    def _each(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 2048):
            self.known.add(runs[i : i + 2048], *self._encoded(runs[i : i + 2048]))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _places(self, runs: list[str]) -> np.ndarray:
        """The place of each of these different runs in ``known``, learned if need be."""
        if len(self.known.places) > self.keep:
            self.known, self.old = Known(), self.known
        places = self.known.find(runs)
        missing = np.flatnonzero(places < 0)
        new = [runs[i] for i in missing.tolist()]
        before = self.old.find(new)
        had = before >= 0
        self.known.add(list(compress(new, had.tolist())), *self.old.take(before[had]))
        fresh = list(compress(new, (~had).tolist()))
        plain = list(map(is_plain, fresh))
        self._letters(list(compress(fresh, plain)))
        self._each([x for x, letters in zip(fresh, plain, strict=True) if not letters])
        places[missing] = self.known.find(new)
        return places

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each text's.

        Runs are told apart by Arrow, so that Python sees each different run once a call.
        """
        lists = pc.split_pattern(cut_texts(texts, self.special), " ")
        runs = lists.flatten().dictionary_encode()
        places = self._places(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, counts = self.known.take(places[runs.indices.to_numpy()])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.diff(np.concatenate(([0], np.cumsum(counts)))[offsets])

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.arrays(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        yield from (ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True))


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which outlives a task."""
    return WordEncoder(path)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, tokens_per_segment: int = 1 << 20) -> None:
    """Encode every document and write the file at ``path``."""
    spark = docs.sparkSession

    def encode(batches):
        from pyspark import TaskContext

        part, segment, first = TaskContext.get().partitionId(), 0, 0
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        ids, names, counts, n = [], [], [], 0

        def close():
            nonlocal segment, first, ids, names, counts, n
            blob = pack(np.concatenate(ids), names, counts)
            out = pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "first": [first], "n_tokens": [n], "blob": [blob]}, schema=ARROW)
            segment, first, ids, names, counts, n = segment + 1, first + n, [], [], [], 0
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                every, sizes = encoder.arrays(some.column(1))
                at = np.cumsum(sizes)
                for name, lo, hi in zip(some.column(0).to_pylist(), (at - sizes).tolist(), at.tolist(), strict=True):
                    ids += [every[lo:hi], end]
                    names.append(name)
                    counts.append(hi - lo + 1)
                    n += counts[-1]
                    if n >= tokens_per_segment:
                        yield close()
        if names:
            yield close()

    ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])
    (
        docs.select("doc_id", "text")
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, SEGMENTS)
        .write.option("compression", "zstd").parquet(path)
    )


def _bases(segments: DataFrame) -> DataFrame:
    """Segments with ``base``, the ids of the parts before; a row per part meets on the driver."""
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    spark, rows, at = segments.sparkSession, [], 0
    for x in sums:
        rows.append((x["part"], at))
        at += x["n"]
    return segments.join(F.broadcast(spark.createDataFrame(rows, "part int, base long")), "part")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the file."""
    segments = _bases(spark.read.schema(SEGMENTS).parquet(path))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row["blob"])
                raw, at = s.all().astype("<u4").tobytes(), s.starts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(s.doc_ids, pa.int64()),
                    "start": pa.array(row["base"] + row["first"] + at[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                })

    return segments.select("base", "first", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, token of each row of ``positions`` (column position), by random access.

    Positions meet their segment by its start; those outside the file give no row.
    """
    segments = _bases(spark.read.schema(SEGMENTS).parquet(path)).withColumn("start", F.col("base") + F.col("first"))
    wanted = positions.select(F.col("position").cast("long").alias("position"))
    found = wanted.join(segments, (wanted["position"] >= segments["start"]) & (wanted["position"] < segments["start"] + segments["n_tokens"]))

    def get(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"position": pa.array([x["position"] for x in rows], pa.int64()), "token": pa.array([Segment(x["blob"])[x["position"] - x["start"]] for x in rows], pa.int64())})

    return found.select("position", "start", "blob").mapInArrow(get, "position long, token long")


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the ids of ``docs`` to a file in the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "dac")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_documents(spark, path)
