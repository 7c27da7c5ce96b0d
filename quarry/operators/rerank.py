"""Feed-forward re-ranking, pair scoring and projection layers.

The scorer runs on ``x = q * d`` (element-wise): dense -> ReLU ->
[dense -> ReLU, only with an extra layer] -> dense -> ReLU -> dense(1). The
output is a logit (no sigmoid) and may be negative. Weights are broadcast once;
scoring is a NumPy matrix pass per Arrow batch in a pandas UDF, across all
queries at once.

Re-ranking replaces the score and orders by (rounded new score desc, previous
rank asc), so equal scores keep the retrieval order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import nn
from quarry.operators import runs
from quarry.operators.ranking import top_k
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most
from quarry.shipping import ship
from quarry.sources.weights import formula_layers, load_model

# Tensor names of the scorer and of a projection layer, as in
# the checkpoints' state dictionaries.
RANKER_LAYERS = ("input", "extra_hidden", "h1", "output")
PROJECTION_LAYER = "_layer"


def _stack(series: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a vector column as a matrix, plus the mask of non-null rows."""
    ok = np.fromiter((v is not None for v in series), dtype=bool, count=len(series))
    if not ok.any():
        return np.zeros((len(series), 0)), ok
    dim = len(next(v for v in series if v is not None))
    m = np.zeros((len(series), dim))
    if ok.any():
        m[ok] = np.stack([np.asarray(v, dtype=np.float64) for v, k in zip(series, ok) if k])
    return m, ok


def _with_nulls(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    out = pd.Series(values, dtype="object")
    out[~ok] = None
    return out


@dataclass
class FeedForwardRanker:
    """The scorer; ``tensors`` maps ``<layer>.weight`` / ``<layer>.bias``."""

    tensors: dict

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.tensors
        h = nn.relu(nn.dense(x, t["input.weight"], t["input.bias"]))
        if "extra_hidden.weight" in t:
            h = nn.relu(nn.dense(h, t["extra_hidden.weight"], t["extra_hidden.bias"]))
        h = nn.relu(nn.dense(h, t["h1.weight"], t["h1.bias"]))
        return nn.dense(h, t["output.weight"], t["output.bias"])[:, 0]

    @classmethod
    def from_table(cls, weights: DataFrame, model: str) -> "FeedForwardRanker":
        return cls(load_model(weights, model))

    @classmethod
    def formula(cls, dim: int, hidden: int, extra: int = 0) -> "FeedForwardRanker":
        layers = {"input": (hidden, dim)}
        if extra > 0:
            layers["extra_hidden"] = (extra, hidden)
            layers["h1"] = (hidden, extra)
        else:
            layers["h1"] = (hidden, hidden)
        layers["output"] = (1, hidden)
        return cls(formula_layers(layers))


def ffn_score(ranker: FeedForwardRanker, spark, q, d) -> Column:
    """Column: scorer logit of ``q * d`` (null when a vector is missing)."""
    ship(spark)
    bc = spark.sparkContext.broadcast(ranker.tensors)

    @F.pandas_udf(T.DoubleType())
    def score(qs: pd.Series, ds: pd.Series) -> pd.Series:
        qm, qok = _stack(qs)
        dm, dok = _stack(ds)
        ok = qok & dok
        out = np.zeros(len(qs))
        if ok.any():
            out[ok] = FeedForwardRanker(bc.value).score(qm[ok] * dm[ok])
        return _with_nulls(out, ok)

    col = lambda c: F.col(c) if isinstance(c, str) else c
    return score(col(q), col(d))


def _query_side(query_vecs: DataFrame, max_rows: int) -> DataFrame:
    qv = query_vecs.select("qid", F.col("embedding").alias("query_vec"))
    return F.broadcast(qv) if row_count_at_most(qv, max_rows) else qv


def rerank_ffn(run: DataFrame, query_vecs: DataFrame, vectors: DataFrame, ranker: FeedForwardRanker,
               id_col: str = "vec_id", max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """N2 + T1: re-score every hit and re-rank.

    Output keeps ``(qid, id_col, rank, score, prev_rank, embedding)``: the
    document vector travels with the hit for later reformulation."""
    spark = run.sparkSession
    hits = run if "embedding" in run.columns else runs.fetch_embeddings(run, vectors, id_col, max_broadcast_rows)
    hits = hits.join(_query_side(query_vecs, max_broadcast_rows), "qid", "left")
    scored = hits.select(
        "qid", id_col, F.col("rank").alias("prev_rank"), "embedding",
        ffn_score(ranker, spark, "query_vec", "embedding").alias("score"),
    )
    return top_k(scored, None, doc=id_col, extra_order=[F.col("prev_rank").asc()])


def score_pairs(triples: DataFrame, query_vecs: DataFrame, vectors: DataFrame, ranker: FeedForwardRanker,
                id_col: str = "vec_id", max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``triples(qid, pos_id, neg_id)`` -> ``score_pos``, ``score_neg``
    (null when there is no negative)."""
    spark = triples.sparkSession
    triples = cut_lineage(triples)  # used for the ids and for the joins
    ids = triples.select(F.col("pos_id").alias(id_col)).unionByName(
        triples.select(F.col("neg_id").alias(id_col)).filter(F.col(id_col).isNotNull()))
    vecs = runs.fetch_by_key(ids, vectors.select(id_col, "embedding"), id_col, max_broadcast_rows)
    pos = vecs.select(F.col(id_col).alias("pos_id"), F.col("embedding").alias("pos_vec"))
    neg = vecs.select(F.col(id_col).alias("neg_id"), F.col("embedding").alias("neg_vec"))
    t = (triples.join(_query_side(query_vecs, max_broadcast_rows), "qid", "left")
         .join(pos, "pos_id", "left").join(neg, "neg_id", "left"))
    return t.select(
        "qid", "pos_id", "neg_id",
        ffn_score(ranker, spark, "query_vec", "pos_vec").alias("score_pos"),
        ffn_score(ranker, spark, "query_vec", "neg_vec").alias("score_neg"),
    )


@dataclass
class ProjectionLayer:
    """One dense layer on ``q * d`` (``ip``), ``[q; d]`` (``cat``) or ``q``
    alone (``single``)."""

    weight: np.ndarray
    bias: np.ndarray
    mode: str = "ip"

    def apply(self, q: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
        if self.mode == "ip":
            x = q * d
        elif self.mode == "cat":
            x = np.concatenate([q, d], axis=1)
        elif self.mode == "single":
            x = q
        else:
            raise ValueError(f"unknown projection mode {self.mode!r}")
        return nn.dense(x, self.weight, self.bias)

    @classmethod
    def from_tensors(cls, tensors: dict, mode: str = "ip") -> "ProjectionLayer":
        return cls(tensors[f"{PROJECTION_LAYER}.weight"], tensors[f"{PROJECTION_LAYER}.bias"], mode)


def project(layer: ProjectionLayer, spark, q, d=None) -> Column:
    """Column ARRAY<DOUBLE>: the projection of ``q`` (and ``d``)."""
    ship(spark)
    bc = spark.sparkContext.broadcast((layer.weight, layer.bias, layer.mode))
    col = lambda c: F.col(c) if isinstance(c, str) else c

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def proj(qs: pd.Series, ds: pd.Series) -> pd.Series:
        w, b, mode = bc.value
        qm, ok = _stack(qs)
        dm, dok = _stack(ds) if mode != "single" else (qm, ok)
        ok = ok & dok
        vals = [None] * len(qs)
        if ok.any():
            res = ProjectionLayer(w, b, mode).apply(qm[ok], dm[ok])
            for j, idx in enumerate(np.nonzero(ok)[0]):
                vals[idx] = res[j]
        return pd.Series(vals, dtype="object")

    return proj(col(q), col(d) if d is not None else col(q))
