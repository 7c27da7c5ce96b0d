"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of word characters, runs of other signs) fall into hashed buckets. Every
bucket owns a sparse random index vector of +1 and -1; its context vector is the sum of
the index vectors of all neighbours within ``WINDOW`` words over the whole corpus. Tasks
add up integers and emit one row per bucket, so the sums are exact and do not depend on
the partitioning; Spark adds them up per bucket. Context vectors are centred by what the
bucket's frequency alone would give and scaled to unit length.

A document is the mean of its words' vectors. A network with one hidden layer, in numpy,
is fitted to a bounded sample of labelled rows (``PER_CLASS``, chosen by a hash of the id,
weighted back to the classes' shares); a temperature fitted on a part kept aside
calibrates its probabilities. Sent out: the bucket vectors and the network, both of fixed
size. Everything else covers all rows and whole texts.

Defined results: null and empty texts pool to the zero vector and get its score; null
labels are no training rows; a document with several labels takes the largest; without a
row of either class the score is the smoothed share of label 1; repeated rows are each
scored; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, prepare, texts_of
from quarry.llm._labels import held_out, training_rows

BUCKETS = 1 << 14
DIM = 64
NONZERO = 4
WINDOW = 2
#: Bound of the training sample, documents per class.
PER_CLASS = 4000
HIDDEN = 32
ROUNDS = 400
RATE = 0.01
DECAY = 1e-4
THRESHOLD = 0.7
#: Distinct words a worker remembers the buckets of; later ones are hashed again.
CACHE_WORDS = 200_000
#: Words counted at once.
STRETCH = 1 << 20

WORD = re.compile(r"\w+|[^\w\s]+")


class Words(dict):
    """Blank-separated piece -> its words' buckets as 2-byte numbers."""

    def __missing__(self, piece: str) -> bytes:
        found = np.array([zlib.crc32(w.encode()) % BUCKETS for w in WORD.findall(piece)], "<u2").tobytes()
        if len(self) < CACHE_WORDS:
            self[piece] = found
        return found

    def buckets(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u2")


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(position, sign) of the non-zero components; the last row is a gap of zeros."""
    rng = np.random.default_rng(seed)
    place = rng.integers(0, DIM, (BUCKETS + 1, NONZERO))
    sign = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    sign[BUCKETS] = 0
    return place, sign


class Contexts:
    """Sums of neighbours' index vectors and word counts per bucket."""

    def __init__(self):
        self.place, self.sign = index_vectors()
        self.sums = np.zeros((BUCKETS + 1) * DIM)
        self.counts = np.zeros(BUCKETS + 1, "int64")

    def add(self, texts: list[np.ndarray]) -> None:
        """Texts as bucket arrays; words of different texts are no neighbours."""
        gap, at, part = np.full(WINDOW, BUCKETS, "int64"), 0, []
        for t in texts:
            part += [t.astype("int64"), gap]
            at += len(t) + WINDOW
            if at >= STRETCH:
                self._add(np.concatenate(part))
                at, part = 0, []
        if part:
            self._add(np.concatenate(part))

    def _add(self, ids: np.ndarray) -> None:
        self.counts += np.bincount(ids, minlength=BUCKETS + 1)
        for step in range(1, WINDOW + 1):
            for word, other in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                for j in range(NONZERO):
                    self.sums += np.bincount(word * DIM + self.place[other, j], weights=self.sign[other, j],
                                             minlength=len(self.sums))

    def rows(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.counts[:BUCKETS])
        sums = self.sums.reshape(-1, DIM)[used].astype("int64")
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype("int32")), pa.array(self.counts[used]),
             pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype="int32") * DIM), pa.array(sums.ravel()))],
            names=["bucket", "n", "c"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets over the whole of ``docs(doc_id, text)``."""
    prepare(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts = Words(), Contexts()
        for block in blocks(batches):
            contexts.add([words.buckets(t) for t in texts_of(block)])
        yield contexts.rows()

    parts = docs.select("text").mapInArrow(count, "bucket int, n long, c array<long>")
    sums = [F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(DIM)]
    total = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *sums).toArrow()  # at most one row per bucket
    n, c = np.zeros(BUCKETS), np.zeros((BUCKETS, DIM))
    if total.num_rows:
        at = total.column("bucket").to_numpy()
        n[at] = total.column("n").to_numpy()
        for i in range(DIM):
            c[at, i] = total.column(f"c{i}").to_numpy()
    centred = c - np.outer(n / max(1.0, n.sum()), c.sum(axis=0))
    length = np.linalg.norm(centred, axis=1, keepdims=True)
    return (centred / np.maximum(length, 1e-12)).astype("f4")


def pooled(vectors: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Mean vector of a text's words, in stretches."""
    if not len(buckets):
        return np.zeros(DIM)
    total = np.zeros(DIM)
    for at in range(0, len(buckets), 1 << 16):
        total += vectors[buckets[at:at + (1 << 16)]].sum(axis=0, dtype="f8")
    return total / len(buckets)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> Network:
    """Full-batch Adam on the weighted log loss; every fifth row is kept aside for the temperature."""
    rng = np.random.default_rng(seed)
    prior = float((weight[y == 1].sum() + 1) / (weight.sum() + 2))
    bias = float(np.log(prior / (1 - prior)))
    flat = Network(np.zeros(DIM), np.ones(DIM), np.zeros((DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias)
    if not 0 < (y == 1).sum() < len(y):
        return flat
    aside = np.arange(len(y)) % 5 == 4
    if min((y[~aside] == 0).sum(), (y[~aside] == 1).sum()) == 0:
        aside[:] = False
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, np.sqrt(2 / DIM), (DIM, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), bias)
    z, t, w = (x[~aside] - net.centre) / net.scale, y[~aside], weight[~aside] / weight[~aside].sum()
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        inner = z @ params[0] + params[1]
        hidden = np.maximum(inner, 0)
        error = w * (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -700, 700))) - t)
        back = np.outer(error, params[2]) * (inner > 0)
        grads = [z.T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(params[3][0])
    if aside.any():
        raw, t, w = net.logits(x[aside]), y[aside], weight[aside]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [float(w @ (np.logaddexp(0, raw / a) - t * raw / a)) for a in tried]
        net.temperature = float(tried[int(np.argmin(loss))])
    return net


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD,
             per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels of rows not held out."""
    spark = prepare(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))  # fixed size: buckets x dimensions

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for block in blocks(batches):
            x = [pooled(vectors.value, words.buckets(t)) for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([block.column(0), *block.columns[2:], pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "weight", "x"])

    rows = training_rows(docs, labels.filter(~held_out(F.col("doc_id"))), label, {1: per_class, 0: per_class})
    sample = rows.select("doc_id", "text", "y", "weight").mapInArrow(
        features, "doc_id long, y int, weight double, x array<double>").toArrow()  # bounded by the sample
    if sample.num_rows:
        x = np.array(sample.column("x").to_pylist())
        order = np.lexsort((*x.T[::-1], sample.column("y").to_numpy(), sample.column("doc_id").to_numpy()))  # rows of one id too
        x = x[order]
        net = fit(x, sample.column("y").to_numpy()[order].astype(float), sample.column("weight").to_numpy()[order])
    else:
        net = fit(np.zeros((0, DIM)), np.zeros(0), np.zeros(0))
    sent = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for block in blocks(batches):
            x = np.array([pooled(vectors.value, words.buckets(t)) for t in texts_of(block)])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sent.value.probabilities(x))], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
