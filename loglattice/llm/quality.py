"""Document quality by a linear-chain conditional random field over lines (operator 1).

A document is its sequence of lines. Each line has one of two labels, good or bad;
the field scores a labelling by features of the line, of the line before and of the
line after it, and by the transition between neighbouring labels. Forward-backward
gives each line's marginal probability of being good; the mean of the marginals,
weighted by line length in bytes, is the score of the document.

The field is fitted by penalised conditional likelihood on a bounded sample
(``sample_docs`` for each label, smallest hash of doc_id first) of labelled training
documents, all of whose lines take the document's label. Only the text is an input.

A null or empty text is one empty line and gets the score of that line. Without
labelled training rows of both kinds every score is 0.5. Repeated rows are scored
alike; extra columns are ignored. Null labels count as unlabelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of bytes whose shares describe a line.
LOWER, UPPER, DIGIT, SPACE, STOP, BAR, MARK, HIGH_UPPER, HIGH = range(9)
CLASSES = 9


def _table() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    kind[ord("a") : ord("z") + 1] = LOWER
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[[ord(","), ord("."), ord("'")]] = STOP
    kind[[ord("|"), ord("<"), ord(">"), ord("{"), ord("}")]] = BAR
    kind[128:160] = HIGH_UPPER  # second bytes of capital Latin letters, among others
    kind[160:] = HIGH
    return kind


KIND = _table()
EDGES = {
    "length": [3, 8, 20, 50, 120, 300, 800, 2000],
    "share": [0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
}
OWN = (CLASSES + 2) * 9
WIDTH = 3 * (OWN + 1) + 1


LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _echoes(joined: np.ndarray, space: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Share of each line's words that have the length and first eight bytes of the word before."""
    edge = np.concatenate(([True], space))
    begins = np.flatnonzero(edge[:-1] & ~space)
    ends = np.flatnonzero(edge[1:] & ~edge[:-1])
    sizes = ends - begins
    padded = np.concatenate((joined, np.zeros(8, np.uint8)))
    head = np.lib.stride_tricks.sliding_window_view(padded, 8)[begins].view("<u8").ravel() & LOW_BYTES[np.minimum(sizes, 8)]
    line = np.searchsorted(starts, begins, side="right") - 1
    same = np.concatenate(([False], (head[1:] == head[:-1]) & (sizes[1:] == sizes[:-1]) & (line[1:] == line[:-1])))
    return np.bincount(line[same], minlength=len(starts)) / np.maximum(np.bincount(line, minlength=len(starts)), 1)


def line_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of every line (a row each), bytes of every line, and lines of every text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    kinds = KIND[joined]
    counts = np.empty((len(starts), CLASSES), np.float64)
    for c in range(CLASSES):
        counts[:, c] = np.add.reduceat((kinds == c).view(np.uint8), starts, dtype=np.int64)
    counts[:, SPACE] -= 1  # the line feed
    shares = counts / np.maximum(sizes, 1)[:, None]
    shares = np.column_stack((shares, _echoes(joined, kinds == SPACE, starts)))
    bins = np.empty((len(starts), CLASSES + 2), np.int64)
    bins[:, 0] = np.digitize(sizes, EDGES["length"])
    bins[:, 1:] = np.digitize(shares, EDGES["share"], right=True)
    bins += np.arange(CLASSES + 2) * 9
    return bins, sizes, np.array([x.count(b"\n") + 1 for x in texts], np.int64)


def scores_of_lines(bins: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The evidence for a good label at each line, from itself and both neighbours."""
    own = weights[bins].sum(1)
    before, after = weights[OWN + 1 + bins].sum(1), weights[2 * (OWN + 1) + bins].sum(1)
    out = own + weights[-1]
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    last = np.cumsum(lines) - 1
    left = np.concatenate(([0.0], before[:-1]))
    left[first] = weights[OWN + 1 + OWN]
    right = np.concatenate((after[1:], [0.0]))
    right[last] = weights[2 * (OWN + 1) + OWN]
    return out + left + right


def _groups(lines: np.ndarray):
    """Numbers of texts with a like number of lines, so that little is padded."""
    order = np.argsort(lines, kind="stable")
    size = np.ceil(np.log2(np.maximum(lines[order], 1)) * 2).astype(int)
    for part in np.split(order, np.flatnonzero(np.diff(size)) + 1):
        for i in range(0, len(part), 4096):
            yield part[i : i + 4096]


def forward_backward(score: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the good label, expected transitions (2 x 2) and the sum of log normalisers."""
    marginal, expected, total = np.empty(len(score)), np.zeros((2, 2)), 0.0
    first = np.concatenate(([0], np.cumsum(lines)[:-1])) if len(lines) else lines
    m = np.exp(moves)
    for some in _groups(lines):
        n, longest = lines[some], int(lines[some].max())
        at = first[some][:, None] + np.minimum(np.arange(longest), n[:, None] - 1)
        live = np.arange(longest) < n[:, None]
        s = np.clip(score[at], -40, 40)
        emit = np.stack([np.exp(-np.maximum(s, 0)), np.exp(np.minimum(s, 0))], 2)  # (1, e^s), scaled to at most 1
        total += (np.where(live, np.maximum(s, 0), 0)).sum()
        alpha, scale = np.empty((len(some), longest, 2)), np.ones((len(some), longest))
        for t in range(longest):
            a = emit[:, 0] if t == 0 else (alpha[:, t - 1] @ m) * emit[:, t]
            z = a.sum(1)
            alpha[:, t], scale[:, t] = a / z[:, None], z
        total += np.log(scale)[live].sum()
        beta = np.ones((len(some), 2))
        post = np.empty((len(some), longest))
        for t in range(longest - 1, -1, -1):
            ended = ~(np.arange(longest)[t] < n - 1)
            if t + 1 < longest:
                move = emit[:, t + 1] * beta / scale[:, t + 1][:, None]
                pair = alpha[:, t][:, :, None] * m * move[:, None, :]
                expected += pair[~ended].sum(0)
                beta = np.where(ended[:, None], 1.0, move @ m.T)
            g = alpha[:, t] * beta
            post[:, t] = g[:, 1] / g.sum(1)
        marginal[at[live]] = post[live]
    return marginal, expected, total


@dataclass
class Field:
    weights: np.ndarray
    moves: np.ndarray
    fitted: bool = True

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        if not texts:
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(texts), 0.5)
        bins, sizes, lines = line_bins(texts)
        marginal, _, _ = forward_backward(scores_of_lines(bins, lines, self.weights), lines, self.moves)
        first = np.concatenate(([0], np.cumsum(lines)[:-1]))
        heavy = sizes + 1e-6
        return np.clip(np.add.reduceat(marginal * heavy, first) / np.add.reduceat(heavy, first), 0, 1)


def fit(texts: list[bytes], labels: list[int], rounds: int = 80, rate: float = 0.15, penalty: float = 1e-3) -> Field:
    """Maximise the mean conditional log-likelihood of the labels by Adam."""
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if len(set(labels)) < 2:
        return Field(weights, moves, fitted=False)
    bins, _, lines = line_bins(texts)
    y = np.repeat(np.array(labels, float), lines)
    share = 1 / np.repeat(np.sqrt(lines), lines)  # a long document does not outweigh the rest
    first, last = np.concatenate(([0], np.cumsum(lines)[:-1])), np.cumsum(lines) - 1
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (np.array(labels), np.array(labels)), lines - 1)
    m1, m2 = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    n = len(texts)
    for step in range(1, rounds + 1):
        marginal, expected, _ = forward_backward(scores_of_lines(bins, lines, weights), lines, moves)
        r = (y - marginal) * share
        grad = np.zeros(WIDTH)
        spread = lambda base, rows, values: np.add(grad[base : base + OWN], np.bincount(rows.ravel(), np.repeat(values, rows.shape[1]), OWN), out=grad[base : base + OWN])
        spread(0, bins, r)
        inner = np.ones(len(r), bool)
        inner[first] = False
        spread(OWN + 1, bins[:-1][inner[1:]], r[1:][inner[1:]])
        inner = np.ones(len(r), bool)
        inner[last] = False
        spread(2 * (OWN + 1), bins[1:][inner[:-1]], r[:-1][inner[:-1]])
        grad[OWN + 1 + OWN], grad[2 * (OWN + 1) + OWN], grad[-1] = r[first].sum(), r[last].sum(), r.sum()
        g = np.concatenate((grad / n - penalty * weights, ((pairs - expected) / lines.sum() - penalty * moves).ravel()))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + move[:WIDTH], np.clip(moves + move[WIDTH:].reshape(2, 2), -3, 3)
    return Field(weights, moves)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample_docs: int) -> list[tuple[bytes, int]]:
    """(text, label) of at most ``sample_docs`` labelled training documents of each label.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are left out. Ids are
    chosen first, so that only the sample's texts move.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.filter(F.col(label).isin(0, 1) & (fold != held)).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.select("doc_id", "label").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, label int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").toArrow().to_pylist()
    rows.sort(key=lambda x: (x["doc_id"], x["text"]))
    return [(x["text"].encode(), x["label"]) for x in rows]


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                texts = [(x or "").encode() for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(model.value.documents(texts), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_docs: int = 1500, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = training_rows(docs, labels, "quality", folds, held, sample_docs)
    field = fit([x for x, _ in rows], [y for _, y in rows])
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return scored(docs, field).select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
