"""NumPy building blocks run inside Arrow batches.

Weights follow the ``W[out, in]`` convention: ``dense(x, W, b) = x @ W.T + b``
for a batch ``x`` of shape ``(n, in)``. Everything is float64.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed value of the encoder layer: layer-norm epsilon.
LAYER_NORM_EPS = 1e-5


def dense(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    y = x @ w.T
    return y + b if b is not None else y


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def l2_normalize(x: np.ndarray, axis: int = -1, eps: float = 1e-12) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=axis, keepdims=True))
    return x / np.maximum(n, eps)


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float = LAYER_NORM_EPS) -> np.ndarray:
    mu = x.mean(axis=-1, keepdims=True)
    var = ((x - mu) ** 2).mean(axis=-1, keepdims=True)
    return (x - mu) / np.sqrt(var + eps) * gamma + beta


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    z = x - x.max(axis=axis, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=axis, keepdims=True)


def self_attention(x: np.ndarray, in_w: np.ndarray, in_b: np.ndarray, out_w: np.ndarray, out_b: np.ndarray,
                   heads: int) -> np.ndarray:
    """Multi-head self-attention over a batch of sequences ``x (B, S, E)``.

    ``in_w (3E, E)`` stacks the query, key and value projections."""
    bsz, s, e = x.shape
    hd = e // heads
    qkv = x @ in_w.T + in_b  # (B, S, 3E)
    q, k, v = qkv[..., :e], qkv[..., e:2 * e], qkv[..., 2 * e:]

    def split(t):
        return t.reshape(bsz, s, heads, hd).transpose(0, 2, 1, 3)  # (B, H, S, hd)

    q, k, v = split(q), split(k), split(v)
    att = softmax(q @ k.transpose(0, 1, 3, 2) / math.sqrt(hd), axis=-1)
    ctx = (att @ v).transpose(0, 2, 1, 3).reshape(bsz, s, e)
    return ctx @ out_w.T + out_b


def encoder_layer(x: np.ndarray, p: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """Post-norm encoder layer (attention, residual, norm, ReLU feed-forward,
    residual, norm); dropout off. ``p`` keys: in_w, in_b, out_w, out_b, ff1_w,
    ff1_b, ff2_w, ff2_b, n1_g, n1_b, n2_g, n2_b."""
    h = layer_norm(x + self_attention(x, p["in_w"], p["in_b"], p["out_w"], p["out_b"], heads), p["n1_g"], p["n1_b"])
    ff = dense(relu(dense(h, p["ff1_w"], p["ff1_b"])), p["ff2_w"], p["ff2_b"])
    return layer_norm(h + ff, p["n2_g"], p["n2_b"])
