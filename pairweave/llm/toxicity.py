"""6. Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all others, whatever their label, are unlabelled. A linear classifier on
the presence of words and word beginnings minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic
loss (the corrected, non-negative estimator): the prior is the share of toxic rows among the labelled ones. A feature
takes part if positives have it more or less often than chance explains; both kinds of evidence have weights.

Only the training sample is bounded: the ``POSITIVES`` and ``UNLABELLED`` documents of least hash among the rows that
may be learnt from. Their features, numbers below 2^20, go to the driver; the weights (at most ``FEATURES``) go to the
tasks. Every whole text is scored, however long, without a shuffle.

Null and empty texts have no features: their score is the bias alone. Without positives every score is 0. Labels that
contradict each other count as toxic, null labels as none. Repeated rows repeat; an id that repeats is learnt from by its
least text. A score equal to the threshold is a rejection. An empty table gives an empty one. Only the id, the text and the
label are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_slices, text_list

POSITIVES, UNLABELLED = 4_000, 8_000
BUCKETS = 1 << 20
FEATURES = 4096
THRESHOLD = 0.3
BEGINNING = 5
WORD = re.compile(r"[^\W\d_]+").findall
#: A feature takes part if this many documents have it, its count among positives has such a likelihood ratio (twice its
#: logarithm) against that expected from the unlabelled, and, where positives have it more often, so large a share of
#: the documents with it seem positive.
LEAST_COUNT, LEAST_RATIO, LEAST_PURITY = 3, 10.0, 0.6
ROUNDS, RATE, DECAY = 400, 0.05, 2e-4


def features(text: str) -> set[str]:
    """The distinct words, lower-cased, and the beginnings (marked) of the longer ones."""
    words = set(WORD(text.lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) >= BEGINNING}


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def feature_buckets(text: str) -> Column:
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        of = Memo(bucket, 200_000)
        kind = pa.list_(pa.int32())
        return by_slices(
            texts, kind,
            lambda some: pa.array(
                [np.unique(np.fromiter((of[f] for f in features(x)), dtype=np.int32)) for x in text_list(some)], kind,
            ),
        )

    return run(text)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Risk:
    """The non-negative risk of a linear score: prior x loss of positives as positive, plus what the unlabelled lose as negative
    less the positives' share of that, where this is not below zero. Documents are (row, feature) pairs."""

    def __init__(self, p: tuple[np.ndarray, np.ndarray], n_p: int, u: tuple[np.ndarray, np.ndarray], n_u: int, features: int, prior: float):
        self.p, self.n_p, self.u, self.n_u, self.features, self.prior = p, n_p, u, n_u, features, prior

    def scores(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        return tuple(bias + np.bincount(r, weights[c], n) for (r, c), n in ((self.p, self.n_p), (self.u, self.n_u)))

    def parts(self, weights: np.ndarray, bias: float) -> tuple[float, float]:
        """The positive part, and the negative one before it is held at zero."""
        zp, zu = self.scores(weights, bias)
        positive = self.prior * np.logaddexp(0, -zp).mean()
        return float(positive), float(np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean())

    def slope(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Of the whole risk, by weights and bias; where the negative part fell below zero, what undoes that part alone."""
        zp, zu = self.scores(weights, bias)
        up_p, up_u = self.prior * sigmoid(zp) / self.n_p, sigmoid(zu) / self.n_u
        if self.parts(weights, bias)[1] >= 0:
            gp, gu = -self.prior * (1 - sigmoid(zp)) / self.n_p - up_p, up_u
        else:
            gp, gu = up_p, -up_u
        by_feature = sum(np.bincount(c, g[r], self.features) for (r, c), g in ((self.p, gp), (self.u, gu)))
        return np.append(by_feature, gp.sum() + gu.sum())


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[dict[int, float], float]:
    """Weights of buckets, and the bias."""
    share = lambda docs: np.bincount(np.concatenate(docs), minlength=BUCKETS)
    in_p, in_u = share(positive), share(unlabelled)
    expected = len(positive) * (in_u + 0.5) / (len(unlabelled) + 1)
    ratio = 2 * (in_p * np.log(np.maximum(in_p, 1) / expected) - (in_p - expected))
    # prior * in_p / expected estimates how often a document with the feature is positive.
    pure = (in_p <= expected) | (prior * in_p / expected >= LEAST_PURITY)
    found = np.flatnonzero((in_p + in_u >= LEAST_COUNT) & (ratio >= LEAST_RATIO) & pure)
    chosen = np.sort(found[np.argsort(-ratio[found], kind="stable")[:FEATURES]])
    if not len(chosen):
        return {}, float(np.log(prior / (1 - prior)))
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))

    def sparse(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), column[np.concatenate(docs)]
        return rows[cols >= 0], cols[cols >= 0]

    risk = Risk(sparse(positive), len(positive), sparse(unlabelled), len(unlabelled), len(chosen), prior)
    weights, bias = np.zeros(len(chosen)), -2.0
    moment, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, ROUNDS + 1):
        slope = risk.slope(weights, bias)
        slope[:-1] += DECAY * weights
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return dict(zip(chosen.tolist(), weights.tolist(), strict=True)), float(bias)


class Toxicity:
    """A trained scorer; ``score`` makes a column."""

    def __init__(self, weights: dict[int, float], bias: float, known: bool):
        self.weights, self.bias, self.known = weights, bias, known

    def score_text(self, text: str, of: dict[str, float] | None = None) -> float:
        if not self.known:
            return 0.0
        of = {f: self.weights.get(bucket(f), 0.0) for f in features(text)} if of is None else of
        z = self.bias + sum(map(of.__getitem__, features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: Column, spark) -> Column:
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            model = shared.value
            if not hasattr(model, "remembered"):
                model.remembered = Memo(lambda f: model.weights.get(bucket(f), 0.0), 150_000)
            return by_slices(
                texts, pa.float64(),
                lambda some: pa.array([model.score_text(x, model.remembered) for x in text_list(some)], pa.float64()),
            )

        return run(text)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Toxicity:
    """Train on the rows where ``learn`` (of the column doc_id) holds."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where(
        learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
    ).groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) == 1).alias("toxic"))
    n, toxic = marked.agg(F.count("*"), F.count_if("toxic")).first()
    if not toxic:
        return Toxicity({}, 0.0, False)
    chance = F.xxhash64("doc_id")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Both samples are bounded by their limits, so broadcasting their ids is too.
    chosen_p = marked.where("toxic").select("doc_id").orderBy(chance, "doc_id").limit(positives)
    chosen_u = rows.where(
        learn & F.col("doc_id").isNotNull()
    ).select("doc_id").distinct().orderBy(chance, "doc_id").limit(unlabelled)
    ids = chosen_p.withColumn("positive", F.lit(True)).union(chosen_u.withColumn("positive", F.lit(False)))
    # One row an id: the sample stays bounded where an id has many rows.
    sample = rows.where(learn).join(F.broadcast(ids), "doc_id").groupBy("positive", "doc_id").agg(
        F.min("text").alias("text")
    )
    sample = sample.select("positive", "doc_id", feature_buckets("text").alias("buckets")).toArrow()
    lists = sample.column(2).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    values, ends = (lists.values.to_numpy(), lists.offsets.to_numpy()) if sample.num_rows else (
        np.zeros(0, np.int32), np.zeros(1, np.int32),
    )
    rows = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), range(sample.num_rows), strict=True))
    sample = [(positive, doc, values[ends[i] : ends[i + 1]]) for positive, doc, i in rows]
    # Equal texts count once: a group of copies must not stand for a word's frequency.
    p, u = (list({x.tobytes(): x for positive, _, x in sample if positive == kind}.values()) for kind in (True, False))
    if not p or not u:
        return Toxicity({}, 0.0, False)
    return Toxicity(*train(p, u, min(0.9, max(1e-4, toxic / n))), True)


