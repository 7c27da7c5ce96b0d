"""Pseudo-relevance-feedback query reformulation.

Input is a re-ranked run carrying the document vectors
``(qid, rank, score, embedding)`` and the query vectors ``(qid, embedding)``;
output is new query vectors ``(qid, embedding)``. Feedback order is the run's
rank order.

Per query only the first ``topk`` hits are used, so each group collected by
``groupBy(qid)`` is bounded by ``topk`` rows; the arithmetic then runs per Arrow
batch over many queries at once:

* ``top1``        -- the rank-1 document vector (no re-normalisation).
* ``avg``         -- mean of the first ``topk`` vectors (no re-normalisation).
* ``weighted``    -- score-weighted mean of the first ``topk`` vectors, one dense
  layer, L2-normalised; null when the scores sum to about zero.
* ``neural``      -- ``[q, d1..dk]`` interleaved component-major, dense ->
  sigmoid -> dense, L2-normalised; missing documents are zero-padded.
* ``transformer`` -- sequence ``[q, d1..dk]`` scaled by sqrt(dim), plus
  sinusoidal positions, through post-norm encoder layers (dropout off);
  position 0, L2-normalised.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import nn
from quarry.functions.vectors import position_matrix
from quarry.shipping import ship
from quarry.sources.weights import load_model

# Reformulator names offered to users and what they select
# (kind, feedback depth, heads, layers).
REFORMULATORS = {
    "Neural (h2500_top5)": ("neural", 5, None, None),
    "Transformer (top10_h4_l1)": ("transformer", 10, 4, 1),
    "Transformer (top10_h6_l4)": ("transformer", 10, 6, 4),
    "Weighted Avg Top10": ("weighted", 10, None, None),
}
KINDS = ("top1", "avg", "weighted", "neural", "transformer")
# Fixed value: |sum of feedback scores| below which the weighted mean is undefined.
MIN_SCORE_SUM = 1e-12
# Tensor names (state-dictionary keys) of the models.
PROJECTION_PREFIX = "_layer"
TRANSFORMER_LAYER_KEYS = {
    "in_w": "self_attn.in_proj_weight", "in_b": "self_attn.in_proj_bias",
    "out_w": "self_attn.out_proj.weight", "out_b": "self_attn.out_proj.bias",
    "ff1_w": "linear1.weight", "ff1_b": "linear1.bias",
    "ff2_w": "linear2.weight", "ff2_b": "linear2.bias",
    "n1_g": "norm1.weight", "n1_b": "norm1.bias",
    "n2_g": "norm2.weight", "n2_b": "norm2.bias",
}


@dataclass
class Reformulator:
    kind: str
    topk: int = 10
    tensors: dict = field(default_factory=dict)
    heads: int | None = None
    layers: int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown reformulator kind {self.kind!r}")
        if self.topk < 1:
            raise ValueError("topk must be >= 1")

    @classmethod
    def by_name(cls, name: str, tensors: dict | None = None) -> "Reformulator":
        """The registered reformulator ``name`` with its weights."""
        if name not in REFORMULATORS:
            raise ValueError(f"unknown reformulator {name!r}; known: {sorted(REFORMULATORS)}")
        kind, topk, heads, layers = REFORMULATORS[name]
        return cls(kind, topk, tensors or {}, heads, layers)

    @classmethod
    def from_table(cls, weights: DataFrame, model: str, kind: str, topk: int, heads=None, layers=None):
        return cls(kind, topk, load_model(weights, model), heads, layers)

    # -- NumPy forms (one query per row of the inputs) ----------------------
    def weighted(self, vecs: list[np.ndarray], scores: list[np.ndarray]) -> list[np.ndarray | None]:
        w, b = self.tensors[f"{PROJECTION_PREFIX}.weight"], self.tensors[f"{PROJECTION_PREFIX}.bias"]
        out = []
        for v, s in zip(vecs, scores):
            tot = s.sum()
            if v.shape[0] == 0 or abs(tot) < MIN_SCORE_SUM:
                out.append(None)
                continue
            mean = (v * s[:, None]).sum(axis=0) / tot
            out.append(nn.l2_normalize(nn.dense(mean[None, :], w, b))[0])
        return out

    def neural(self, q: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """``q (B, E)``, ``docs (B, k, E)`` zero-padded -> ``(B, E)``."""
        seq = np.concatenate([q[:, None, :], docs], axis=1)  # (B, k+1, E)
        x = seq.transpose(0, 2, 1).reshape(seq.shape[0], -1)  # component-major
        t = self.tensors
        h = nn.sigmoid(nn.dense(x, t["input.weight"], t["input.bias"]))
        return nn.l2_normalize(nn.dense(h, t["output.weight"], t["output.bias"]))

    def layer_params(self) -> list[dict]:
        out = []
        for i in range(self.layers or 0):
            out.append({k: self.tensors[f"layers.{i}.{v}"] for k, v in TRANSFORMER_LAYER_KEYS.items()})
        return out

    def transformer(self, seq: np.ndarray) -> np.ndarray:
        """``seq (B, S, E)`` = [q, d1..] -> ``(B, E)``."""
        _, s, e = seq.shape
        x = seq * math.sqrt(e) + position_matrix(s, e)[None, :, :]
        for p in self.layer_params():
            x = nn.encoder_layer(x, p, self.heads)
        return nn.l2_normalize(x[:, 0, :])


def _feedback(run: DataFrame, topk: int) -> DataFrame:
    """``(qid, hits)``: the first ``topk`` hits per query in rank order."""
    return run.filter(F.col("rank") <= topk).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("score").cast("double").alias("score"),
                                             "embedding"))).alias("hits")
    )


def _as_mats(vec_lists: pd.Series) -> list[np.ndarray]:
    return [np.stack([np.asarray(v, dtype=np.float64) for v in vl]) if vl is not None and len(vl)
            else np.zeros((0, 0)) for vl in vec_lists]


def reformulate(run: DataFrame, query_vecs: DataFrame, reformulator: Reformulator) -> DataFrame:
    """New query vectors ``(qid, embedding)`` from the re-ranked run."""
    kind, topk = reformulator.kind, reformulator.topk
    fb = _feedback(run, 1 if kind == "top1" else topk)
    if kind == "top1":
        return fb.select("qid", F.transform(F.col("hits")[0]["embedding"], lambda x: x.cast("double")).alias("embedding"))
    if kind == "avg":
        first = F.col("hits")[0]["embedding"]
        mean = F.transform(
            F.sequence(F.lit(0), F.size(first) - 1),
            lambda i: F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["embedding"][i].cast("double"))
            / F.size("hits"),
        )
        return fb.select("qid", mean.alias("embedding"))

    spark = run.sparkSession
    ship(spark)
    bc = spark.sparkContext.broadcast(reformulator)
    vecs = F.transform("hits", lambda h: h["embedding"])
    if kind == "weighted":
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def weighted(vs: pd.Series, ss: pd.Series) -> pd.Series:
            res = bc.value.weighted(_as_mats(vs), [np.asarray(s, dtype=np.float64) for s in ss])
            return pd.Series(res, dtype="object")

        return fb.select("qid", weighted(vecs, F.transform("hits", lambda h: h["score"])).alias("embedding"))

    q = query_vecs.select("qid", F.col("embedding").alias("query_vec"))
    fb = fb.join(q, "qid")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sequence_model(qs: pd.Series, vs: pd.Series) -> pd.Series:
        model = bc.value
        qm = np.stack([np.asarray(v, dtype=np.float64) for v in qs])
        mats = _as_mats(vs)
        bsz, e = qm.shape
        if model.kind == "neural":
            docs = np.zeros((bsz, model.topk, e))
            for i, m in enumerate(mats):
                docs[i, : m.shape[0]] = m[: model.topk]
            return pd.Series(list(model.neural(qm, docs)), dtype="object")
        out = [None] * bsz
        lengths = np.array([m.shape[0] for m in mats])
        for n in np.unique(lengths):  # batch the queries with equal feedback depth
            idx = np.nonzero(lengths == n)[0]
            seq = np.concatenate([qm[idx][:, None, :]] + ([np.stack([mats[i] for i in idx])] if n else []), axis=1)
            res = model.transformer(seq)
            for j, i in enumerate(idx):
                out[i] = res[j]
        return pd.Series(out, dtype="object")

    return fb.select("qid", sequence_model("query_vec", vecs).alias("embedding"))


def formula_neural(dim: int, topk: int, hidden: int) -> dict:
    from quarry.sources.weights import formula_layers

    return formula_layers({"input": (hidden, (topk + 1) * dim), "output": (dim, hidden)})


def random_transformer(dim: int, layers: int, ff: int, seed: int = 7) -> dict:
    """Deterministic random weights of the encoder stack (tests, bench)."""
    rng = np.random.default_rng(seed)
    t = {}
    for i in range(layers):
        p = f"layers.{i}."
        t[p + "self_attn.in_proj_weight"] = rng.normal(0, 0.05, (3 * dim, dim))
        t[p + "self_attn.in_proj_bias"] = rng.normal(0, 0.01, 3 * dim)
        t[p + "self_attn.out_proj.weight"] = rng.normal(0, 0.05, (dim, dim))
        t[p + "self_attn.out_proj.bias"] = rng.normal(0, 0.01, dim)
        t[p + "linear1.weight"] = rng.normal(0, 0.05, (ff, dim))
        t[p + "linear1.bias"] = rng.normal(0, 0.01, ff)
        t[p + "linear2.weight"] = rng.normal(0, 0.05, (dim, ff))
        t[p + "linear2.bias"] = rng.normal(0, 0.01, dim)
        t[p + "norm1.weight"] = 1.0 + rng.normal(0, 0.01, dim)
        t[p + "norm1.bias"] = rng.normal(0, 0.01, dim)
        t[p + "norm2.weight"] = 1.0 + rng.normal(0, 0.01, dim)
        t[p + "norm2.bias"] = rng.normal(0, 0.01, dim)
    return t


def formula_transformer(dim: int, layers: int, ff: int) -> dict:
    """Encoder weights that SQL can name as well: formula matrices, norms near one."""
    from quarry.sources.weights import formula_bias, formula_matrix

    t = {}
    for i in range(layers):
        shapes = {"in": (3 * dim, dim), "out": (dim, dim), "ff1": (ff, dim), "ff2": (dim, ff)}
        for name, (n_out, n_in) in shapes.items():
            t[f"layers.{i}.{TRANSFORMER_LAYER_KEYS[name + '_w']}"] = formula_matrix(n_out, n_in)
            t[f"layers.{i}.{TRANSFORMER_LAYER_KEYS[name + '_b']}"] = formula_bias(n_out)
        for norm in ("n1", "n2"):
            t[f"layers.{i}.{TRANSFORMER_LAYER_KEYS[norm + '_g']}"] = 1.0 + formula_bias(dim)
            t[f"layers.{i}.{TRANSFORMER_LAYER_KEYS[norm + '_b']}"] = formula_bias(dim)
    return t
