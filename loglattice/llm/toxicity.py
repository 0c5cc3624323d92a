"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Confirmed toxic documents are the positives; unlabelled text is a sample of all
documents, toxic ones among them. A linear classifier over the presence of words is
trained on the class-prior-corrected risk

    prior * E_p[loss(+1)] + max(0, E_u[loss(-1)] - prior * E_p[loss(-1)]),

whose second term, the risk on negatives, cannot fall below zero: where a step finds
it negative, that step climbs it instead. The prior is the toxic share of the
labelled training rows. The loss is logistic, so the score is a probability; its mean
over all training documents is brought to the prior times ``slack``, a little over it, so
that more of the doubtful documents go.

Fitted on bounded samples (``max_positive`` and ``max_unlabelled`` documents,
smallest hash of doc_id first; ``max_words`` features that differ by ``least_z`` deviations); scoring covers every whole text.
Features are the words of a text, runs between white space, lower-cased and without
punctuation at their ends, and their first four to six letters, since inflected
forms share a stem: whether one, two or three different words of the text have it.

Null and empty texts have no words and get the score of the bias alone. Without
confirmed positives, or without documents, every score is low and the same. Null labels count
as unlabelled; extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written

ENDS = string.punctuation


STEMS, LEVELS = (4, 5, 6), 3


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) > k]


def features_of(text: str | None) -> set[str]:
    words = {x.strip(ENDS) for x in set((text or "").lower().split())} - {""}
    stems = Counter(stem for word in words for stem in stems_of(word))
    return words | {f"{stem}*{i}" for stem, n in stems.items() for i in range(1, min(n, LEVELS) + 1)}


@dataclass
class Linear:
    """Weights of features; ``known`` keeps, for words met, which of those with a weight they bear on."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.stems = {f.rpartition("*")[0] for f in self.weights if "*" in f}

    def logit(self, text: str | None) -> float:
        known, found = self.known, set()
        if len(known) > 100_000:
            known.clear()
        for raw in set((text or "").lower().split()):
            hits = known.get(raw)
            if hits is None:
                word = raw.strip(ENDS)
                hits = known[raw] = (word,) if word in self.weights or not self.stems.isdisjoint(stems_of(word)) else ()
            found.update(hits)
        stems = Counter(stem for word in found for stem in stems_of(word))
        features = found | {f"{stem}*{i}" for stem, n in stems.items() for i in range(1, min(n, LEVELS) + 1)}
        return self.bias + sum(self.weights[f] for f in sorted(features) if f in self.weights)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


@dataclass
class Sample:
    """Sampled documents as pairs of row and feature number, positives and unlabelled apart."""

    features: list[str]
    positive: int
    unlabelled: int
    p_rows: np.ndarray
    p_features: np.ndarray
    u_rows: np.ndarray
    u_features: np.ndarray


def fit(sample: Sample, prior: float, steps: int = 250, rate: float = 0.1, penalty: float = 2e-4) -> Linear:
    """Minimise the corrected risk by Adam; the best weights met are kept."""
    prior = min(max(prior, 1e-4), 0.9)
    start = float(np.log(prior / (1 - prior)))
    np_, nu, width = sample.positive, sample.unlabelled, len(sample.features)
    if not np_ or not nu:
        return Linear(start)
    w, b = np.zeros(width), start
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    best, kept = np.inf, (w, b)
    for step in range(1, steps + 1):
        zp = b + np.bincount(sample.p_rows, w[sample.p_features], np_)
        zu = b + np.bincount(sample.u_rows, w[sample.u_features], nu)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
        on_positive = prior * np.logaddexp(0, -zp).mean()
        on_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risk = on_positive + max(0.0, on_negative)
        if risk < best:
            best, kept = risk, (w.copy(), b)
        negative = (su / nu, -prior * sp / np_)  # derivatives of the risk on negatives
        gu, gp = (negative[0], prior * (sp - 1) / np_ + negative[1]) if on_negative >= 0 else (-negative[0], -negative[1])
        grad = np.append(np.bincount(sample.p_features, gp[sample.p_rows], width) + np.bincount(sample.u_features, gu[sample.u_rows], width) + penalty * w, gp.sum() + gu.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    w, b = kept
    return Linear(float(b), dict(zip(sample.features, w.tolist(), strict=True)))


def levelled(docs: DataFrame, model: Linear, prior: float, slack: float = 1.1) -> Linear:
    """``model`` with the bias that makes the mean score of ``docs`` ``slack`` times the prior.

    Logits are counted in steps of 1/64, so that the driver gets a bounded histogram.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            z = np.fromiter((shared.value.logit(x.as_py()) for x in batch.column(0)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(64 * np.clip(z - shared.value.bias, -40, 40)).astype(np.int64))], ["step"])

    found = docs.select("text").mapInArrow(lean(run), "step long").groupBy("step").agg(F.count("*").alias("n")).orderBy("step").collect()
    if not found:
        return model
    z, n = np.array([r["step"] / 64 for r in found]), np.array([r["n"] for r in found], float)
    low, high = model.bias - 60.0, model.bias + 60.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (low, b) if np.average(1 / (1 + np.exp(-np.clip(z + b, -40, 40))), weights=n) > min(slack * prior, 0.95) else (b, high)
    return Linear(float(b), model.weights)


def fold_of(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def drawn(docs: DataFrame, picked: list[tuple[int, int]], max_words: int, least_z: float, least_share: float) -> Sample:
    """The sample of the (doc_id, kind) in ``picked``, kind 1 for positives.

    Features are counted on the executors; the driver gets the chosen ones and where they are.
    """
    spark = docs.sparkSession
    kinds = spark.createDataFrame(picked, "doc_id long, kind int")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sorted(features_of(x.as_py())) for x in batch.column(2)], pa.list_(pa.string()))], ["kind", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(kinds), "doc_id").select("doc_id", "kind", "text").mapInArrow(lean(run), "kind int, features array<string>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    each = rows.select("row", "kind", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    pooled = (F.col("p") + F.col("u") + 1) / F.lit(float(n_p + n_u + 2))
    z = F.abs(F.col("p") / F.lit(float(max(n_p, 1))) - F.col("u") / F.lit(float(max(n_u, 1)))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / max(n_p, 1) + 1 / max(n_u, 1)))
    chosen = counts.filter(F.col("p") >= max(3, round(least_share * n_p))).withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(max_words).collect()
    features = [r["feature"] for r in chosen]
    index = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, i int")
    found = each.join(F.broadcast(index), "feature").select("row", "kind", "i").toArrow().to_pandas()
    out = []
    for kind in (1, 0):
        some = found[found["kind"] == kind]
        out += [np.unique(some["row"].to_numpy(), return_inverse=True)[1], some["i"].to_numpy(np.int64)]
    return Sample(features, n_p, n_u, *out)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_positive: int = 2500, max_unlabelled: int = 5000, max_words: int = 2000, least_z: float = 4.5, least_share: float = 0.04) -> Linear:
    """Learn from the rows whose crc32(doc_id as text) mod ``folds`` is not ``held``."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold_of("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not totals["toxic"]:
        return Linear(-4.0)
    training = docs.filter(F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held))
    ids = training.select("doc_id").distinct()
    positive = ids.join(known.filter("toxic = 1"), "doc_id", "left_semi").orderBy(*order).limit(max_positive).collect()
    unlabelled = ids.orderBy(*order).limit(max_unlabelled).collect()
    picked = [(x[0], 1) for x in positive] + [(x[0], 0) for x in unlabelled]
    prior = totals["toxic"] / totals["n"]
    return levelled(training, fit(drawn(docs, picked, max_words, least_z, least_share), prior), prior)


def scored(docs: DataFrame, model: Linear) -> DataFrame:
    """The columns of ``docs`` and ``score``, in place of a column of that name."""
    docs, shared = docs.drop("score"), docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shared.value.score(x.as_py()) for x in texts], pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields) + ", score double"
    return docs.mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, folds, held)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score at least ``threshold``; columns stay as they are."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = pa.array([shared.value.score(x.as_py()) < threshold for x in batch.column(at)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(lean(run), docs.schema)
