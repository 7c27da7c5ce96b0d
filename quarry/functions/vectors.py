"""Column expressions over ``ARRAY<FLOAT>`` vectors.

Arithmetic is done in DOUBLE: elements are cast before multiplying. These are
higher-order SQL functions evaluated in the JVM; the bulk scoring paths (k-NN,
re-ranking) use NumPy on Arrow batches instead, these serve per-row columns.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest norm divided by when normalising (as in common L2 normalise).
NORM_EPS = 1e-12
# Fixed value: base of the sinusoidal position table.
POSITION_BASE = 10000.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products (DOUBLE)."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """``v / max(||v||, eps)``; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(NORM_EPS))
    return F.transform(_col(v), lambda x: x.cast("double") / n)


def multiply(a, b) -> Column:
    """Element-wise product."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))


def clamp01(x) -> Column:
    return F.least(F.greatest(_col(x), F.lit(0.0)), F.lit(1.0))


def pair_similarity(q, d) -> Column:
    """Dot product of the normalised vectors, clamped to [0, 1]."""
    return clamp01(dot(l2_normalize(q), l2_normalize(d)))


def distance(q, d, metric: str = "ip") -> Column:
    """``ip``: 1 - q.d; ``l2``: squared Euclidean; ``cosine``: 1 - cos
    (cos = 0 when a norm is 0)."""
    if metric == "ip":
        return F.lit(1.0) - dot(q, d)
    if metric == "l2":
        diffs = F.zip_with(_col(q), _col(d), lambda x, y: x.cast("double") - y.cast("double"))
        return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x * x)
    if metric == "cosine":
        den = norm(q) * norm(d)
        return F.lit(1.0) - F.when(den > 0, dot(q, d) / den).otherwise(F.lit(0.0))
    raise ValueError(f"unknown metric {metric!r}")


def interleave(q, docs) -> Column:
    """Component-major order ``[q0, d1_0..dk_0, q1, d1_1..]`` of a query
    vector and an array of document vectors."""
    qc, dc = _col(q), _col(docs)
    return F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(qc) - 1),
        lambda i: F.concat(F.array(qc[i].cast("double")), F.transform(dc, lambda v: v[i].cast("double"))),
    ))


def position_phase(slot, dim: int):
    """What slot ``slot`` of a position vector makes of position p is
    ``sin(p * rate + shift)``; returns (rate, shift). Two slots share a rate, the
    odd one is a quarter turn ahead. Works on numbers, arrays and columns."""
    pair = slot - slot % 2
    return pair * (-math.log(POSITION_BASE) / dim), slot % 2 * (math.pi / 2)


def positional_encoding(pos, dim: int) -> Column:
    """Sinusoidal position vector of length ``dim`` for position ``pos``."""
    p = _col(pos).cast("double")

    def value(slot):
        log_rate, shift = position_phase(slot, dim)
        return F.sin(p * F.exp(log_rate) + shift)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)


def position_matrix(count: int, dim: int) -> np.ndarray:
    """The same vectors for positions 0..count-1, as rows of a matrix."""
    log_rate, shift = position_phase(np.arange(dim), dim)
    return np.sin(np.outer(np.arange(count), np.exp(log_rate)) + shift)
