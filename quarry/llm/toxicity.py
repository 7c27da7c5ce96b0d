"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its hashed character n-grams (lower-cased text, whole
length), and for n-grams that stand at least 2, 3 or 5 times (``LEVELS``) a further
member each, so that how often counts as well. From labelled rows the log-count ratio of
every bucket is taken; presence times ratio, scaled to unit length, are the features of a
logistic regression, kept near the ratios themselves by an L2 penalty. Scoring reads each text once where it
lies: no shuffle, and only the weight vector (one float per bucket) is sent out.

Training uses a bounded sample of the labelled rows (``positives``, ``negatives``;
chosen by a hash of the id, so it does not depend on partitioning); the classes are
weighted back to their share among all labelled rows, which keeps the score a
probability. The training task holds one number per bucket of each sampled document: at
most ``2**BUCKET_BITS`` of four bytes however long its text is, 1 MB, and a few ten KB as
a rule. Everything else covers all rows.

Defined results: null or empty text scores by the intercept alone; null labels are
no training rows; a document with several labels takes the largest; without any row
of one class every score is the smoothed share of label 1; repeated rows are each
scored; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, give_back, keep, prepare, texts_of
from quarry.llm._labels import held_out, training_rows

BUCKET_BITS = 18
SIZES = (3, 4, 5)
#: An n-gram that stands at least so often is a further feature.
LEVELS = (2, 3, 5)
#: Bounds of the training sample, documents per class.
POSITIVES = 1500
NEGATIVES = 3000
THRESHOLD = 0.3
ROUNDS = 40
PENALTY = 1e-6
#: Code points hashed at once; a longer text is taken in overlapping stretches.
STRETCH = 1 << 20
#: Feature entries of one part of a training pass.
PART = 1 << 21

SCORES = "doc_id long, score double"


class NGrams:
    """Distinct buckets of a text: n-grams, and n-grams that stand often."""

    def __init__(self, bits: int = BUCKET_BITS, sizes: tuple[int, ...] = SIZES, levels: tuple[int, ...] = LEVELS):
        self.bits, self.sizes, self.levels = bits, sizes, levels
        self.factors = np.random.default_rng(7).integers(1, 1 << 62, max(sizes), dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.spread = np.uint64(0x9E3779B97F4A7C15)

    def _hashes(self, codes: np.ndarray, starts: int) -> np.ndarray:
        """Buckets of all n-grams that begin at the first ``starts`` code points."""
        out, total = [], np.zeros(len(codes), "uint64")
        for n in range(1, max(self.sizes) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            total = total[:m] + codes[n - 1:] * self.factors[n - 1]
            if n in self.sizes:
                mixed = (total[:starts] ^ (total[:starts] >> np.uint64(29))) * self.spread
                out.append((mixed >> np.uint64(64 - self.bits)).astype("int32"))
        return np.concatenate(out) if out else np.zeros(0, "int32")

    def _often(self, buckets: np.ndarray, level: int) -> np.ndarray:
        """Where the features of n-grams that stand at least ``level`` times lie."""
        mixed = (buckets.astype("uint64") + np.uint64(1)) * (self.spread + np.uint64(2 * level))
        return (mixed >> np.uint64(64 - self.bits)).astype("int32")

    def buckets(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype("uint64")
        if len(codes) <= STRETCH:
            h = np.sort(self._hashes(codes, len(codes)))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, "int64")
            distinct, count = h[first], np.diff(np.append(first, len(h)))
        else:
            total = np.zeros(1 << self.bits, "int64")
            for at in range(0, len(codes), STRETCH):
                total += np.bincount(self._hashes(codes[at:at + STRETCH + max(self.sizes) - 1], STRETCH), minlength=len(total))
            distinct = np.flatnonzero(total).astype("int32")
            count = total[distinct]
        return np.unique(np.concatenate([distinct, *[self._often(distinct[count >= n], n) for n in self.levels]]))


def log_count_ratio(groups: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of label-1 presence counts) / (share of label-0 presence counts) per bucket."""
    sums = []
    for label in (1, 0):
        count = np.full(size, smooth)
        for g, y, w in zip(groups, labels, weight):
            if y == label:
                count[g] += w
        sums.append(np.log(count / count.sum()))
    return sums[0] - sums[1]


def fit(groups: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, size: int,
        rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """(weight per bucket, intercept): logistic regression on ratio-scaled presence,
    by quasi-Newton steps. The score of a set g is
    sigmoid(sum(v[g]) / sqrt(|g|) + intercept)."""
    total1, total = float(weight[labels == 1].sum()), float(weight.sum())
    prior = (total1 + 1) / (total + 2)
    intercept = float(np.log(prior / (1 - prior)))
    if not 0 < total1 < total:
        return np.zeros(size), intercept
    ratio = log_count_ratio(groups, labels, weight, size)
    lengths = np.array([len(g) for g in groups])
    groups = [g for g, n in zip(groups, lengths) if n]
    y, w, lengths = labels[lengths > 0].astype(float), weight[lengths > 0] / total, lengths[lengths > 0]
    scale = 1 / np.sqrt(lengths)
    used = np.zeros(size, bool)  # only buckets of the sample move
    for g in groups:
        used[g] = True
    used = np.flatnonzero(used)
    r = ratio[used]
    # Parts of whole documents, so that the arrays of one pass stay small.
    part = np.cumsum(lengths) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    parts = [(slice(a, b), np.searchsorted(used, np.concatenate(groups[a:b])).astype("int32")) for a, b in zip(cuts[:-1], cuts[1:])]
    del groups

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        beta = theta[:-1]
        v = beta * r
        value, grad, shift = penalty / 2 * float(beta @ beta), np.zeros(len(used)), 0.0
        for docs, flat in parts:
            n = lengths[docs]
            z = np.add.reduceat(v[flat], np.concatenate([[0], np.cumsum(n)[:-1]])) * scale[docs] + theta[-1]
            value += float(w[docs] @ (np.logaddexp(0, z) - y[docs] * z))
            error = w[docs] * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[docs])
            grad += np.bincount(flat, weights=np.repeat(error * scale[docs], n), minlength=len(used))
            shift += float(error.sum())
        return value, np.append(grad * r + penalty * beta, shift)

    theta = minimize(loss, np.append(np.zeros(len(used)), intercept), rounds)
    v = np.zeros(size)
    v[used] = theta[:-1] * r
    return v, float(theta[-1])


def minimize(loss, start: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving line search."""
    x, (value, grad) = start, loss(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, alphas = -grad, []
        for s, g in reversed(pairs):
            a = (s @ direction) / (s @ g)
            alphas.append(a)
            direction = direction - a * g
        if pairs:
            s, g = pairs[-1]
            direction = direction * ((s @ g) / (g @ g))
        for (s, g), a in zip(pairs, reversed(alphas)):
            direction = direction + s * (a - (g @ direction) / (s @ g))
        slope = float(grad @ direction)
        step = 1.0 if pairs else min(1.0, 1 / (np.abs(grad).sum() + 1e-12))
        for _ in range(30):
            new = x + step * direction
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, g = new - x, new_grad - grad
        if s @ g > 1e-12:
            pairs = [*pairs, (s, g)][-memory:]
        x, value, grad = new, new_value, new_grad
        if np.abs(grad).max() < 1e-7:
            break
    return x


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES,
          negatives: int = NEGATIVES) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample, in one task, so that a lost executor only repeats it."""
    prepare(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for block in blocks(batches):
            packed = [grams.buckets(t).tobytes() for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(packed, pa.binary()), block.column(2), block.column(3)],
                                             names=["doc_id", "buckets", "y", "weight"])
        give_back()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(4)))
        rows.sort(key=lambda r: (r[0], r[2], r[1]))  # sums do not depend on the arrival
        y, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
        groups = [np.frombuffer(r[1], "int32") for r in rows]
        del rows
        v, b = fit(groups, y, weight, 1 << BUCKET_BITS)
        del groups
        give_back()
        yield pa.RecordBatch.from_pydict({"v": [v.astype("<f4").tobytes()], "b": [b]})

    rows = training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, label,
                         {1: positives, 0: negatives}).select("doc_id", "text", "y", "weight")
    sample = rows.mapInArrow(features, "doc_id long, buckets binary, y int, weight double")
    model = sample.repartition(1).mapInArrow(fitted, "v binary, b double").collect()
    if not model:
        return np.zeros(1 << BUCKET_BITS, "f4"), 0.0
    return np.frombuffer(model[0]["v"], "<f4"), model[0]["b"]


def probabilities(texts: list[str], model: tuple[np.ndarray, float], grams: NGrams) -> np.ndarray:
    weights, intercept = model
    z = []
    for t in texts:
        g = grams.buckets(t)
        z.append(intercept + (float(weights[g].sum(dtype="float64")) / np.sqrt(len(g)) if len(g) else 0.0))
    return 1 / (1 + np.exp(-np.clip(np.array(z, "float64"), -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every whole text."""
    spark = prepare(docs)
    sent = spark.sparkContext.broadcast(model)  # one float per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for block in blocks(batches):
            p = probabilities(texts_of(block), sent.value, grams)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels of rows not held out."""
    learn = labels.filter(~held_out(F.col("doc_id")))
    scored = score(docs, train(docs, learn, **bounds))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, all columns; decided where the rows lie."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), **bounds)
    sent = prepare(docs).sparkContext.broadcast(model)
    return keep(docs, lambda texts: probabilities(texts, sent.value, NGrams()) < threshold)
