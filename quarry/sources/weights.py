"""Model weights as a table (S6): ``weights(model, name, shape, values)``.

A model's tensors are read from the table, checked against a size bound,
collected once on the driver and shipped to executors as one broadcast. Model
size is fixed by its architecture, not by the data, so this is the one
collect the engine does by design.

``formula_weights`` builds the deterministic test weights used by the oracle
queries: ``w[o, i] = (((o * 31 + i * 17) % 13) - 6) / 100`` and
``b[o] = (((o * 7) % 5) - 2) / 100``; an output layer of width 1 gets the
positive bias 0.25.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bound on the number of values of one model collected to the driver.
MAX_MODEL_VALUES = 500_000_000
# Fixed value: bias of a width-1 output layer in the formula weights.
FORMULA_OUTPUT_BIAS = 0.25

WEIGHTS_SCHEMA = "model string, name string, shape array<int>, values array<float>"


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def weights_frame(spark: SparkSession, model: str, tensors: dict[str, np.ndarray]) -> DataFrame:
    rows = [(model, name, [int(d) for d in t.shape], [float(x) for x in np.asarray(t).reshape(-1)])
            for name, t in tensors.items()]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def load_model(weights: DataFrame, model: str, max_values: int = MAX_MODEL_VALUES) -> dict[str, np.ndarray]:
    """Tensors of one model as float64 arrays (size-checked before collecting)."""
    sel = weights.filter(F.col("model") == model)
    total = sel.agg(F.sum(F.size("values"))).first()[0] or 0
    if total > max_values:
        raise ValueError(f"model {model!r} has {total} values (> {max_values})")
    out = {}
    for r in sel.select("name", "shape", "values").collect():
        out[r["name"]] = np.asarray(r["values"], dtype=np.float64).reshape(tuple(r["shape"]))
    if not out:
        raise ValueError(f"no weights for model {model!r}")
    return out


def formula_matrix(n_out: int, n_in: int) -> np.ndarray:
    o = np.arange(n_out)[:, None]
    i = np.arange(n_in)[None, :]
    return ((((o * 31 + i * 17) % 13) - 6) / 100.0).astype(np.float64)


def formula_bias(n_out: int) -> np.ndarray:
    if n_out == 1:
        return np.array([FORMULA_OUTPUT_BIAS])
    o = np.arange(n_out)
    return ((((o * 7) % 5) - 2) / 100.0).astype(np.float64)


def formula_layers(layers: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """``{"input": (out, in), ...}`` -> ``{"input.weight": W, "input.bias": b, ...}``."""
    out = {}
    for name, (n_out, n_in) in layers.items():
        out[f"{name}.weight"] = formula_matrix(n_out, n_in)
        out[f"{name}.bias"] = formula_bias(n_out)
    return out
