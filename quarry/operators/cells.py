"""Exact k-NN that skips cells by bounds.

Every vector lies in the cell of its nearest centroid. Per cell are kept its centre, its
radius (largest distance of a member from the centre) and its number of vectors: one row
per cell, whatever the table's size. For a query q no member of a cell scores better than

* ``ip``: ``q . centre + |q| * radius``,
* ``l2``: ``1 - max(0, |q - centre| - radius)**2``,
* ``cosine``: the ``ip`` bound of the unit vectors, which are what the cells are made of.

Search: a query first takes cells by falling bound until they hold ``k`` vectors, and is
scored there; the k-th score is its threshold. It then visits the other cells whose bound
reaches the threshold, and no more. So the result is that of the full scan, ties included:
on clustered vectors few cells are read, on vectors without structure all of them.

Stored (``write``) the vectors lie in one folder per cell and both passes list only the
folders of cells that some query wants. Both passes use the searches of ``ivf``: vectors
never move when the query matrix fits a broadcast, else cells, sub-shards of hot cells and
query blocks meet in bounded groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import ivf
from quarry.operators.knn import MAX_BROADCAST_QUERIES, METRICS, _stack, arrow_matrix, score_matrix
from quarry.operators.ranking import top_k
from quarry.plans.sizing import cut_lineage, row_count_at_most
from quarry.shipping import ship

#: Scores are compared after rounding to 9 decimals; bounds carry rounding errors of their own.
SLACK = 1e-8


@dataclass
class CellIndex:
    vectors: DataFrame  # (id_col, embedding, cell), unit vectors are not stored
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    metric: str
    id_col: str

    def at(self, vectors: DataFrame) -> "CellIndex":
        return CellIndex(vectors, self.centres, self.radii, self.sizes, self.metric, self.id_col)

    def write(self, path: str) -> "CellIndex":
        """Store the vectors in one folder per cell and search there from now on."""
        self.vectors.write.partitionBy("cell").parquet(path)
        spark = self.vectors.sparkSession
        return self.at(spark.read.schema(self.vectors.schema).parquet(path).select(*self.vectors.columns))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def _near(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance to it, in bounded pieces."""
    cell, far = np.zeros(len(x), "i4"), np.zeros(len(x))
    step = max(1, 4_000_000 // max(1, len(centres)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        best = np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * part @ centres.T, axis=1)
        cell[at:at + step] = best
        far[at:at + step] = np.sqrt(((part - centres[best]) ** 2).sum(axis=1))
    return cell, far


def build_cells(vectors: DataFrame, n_cells: int, metric: str = "ip", id_col: str = "vec_id",
                centroids: np.ndarray | None = None, seed: int = 42) -> CellIndex:
    """Cells of ``vectors(id_col, embedding)`` around fitted (or given) centroids. Vectors
    that are null are kept in no cell; with ``cosine`` the cells are those of unit vectors."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = vectors.sparkSession
    ship(spark)
    src = vectors.select(id_col, "embedding").filter(F.col("embedding").isNotNull())
    if centroids is None:
        fitted = src
        if metric == "cosine":
            size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
            fitted = src.withColumn("size", size).select(
                F.when(F.col("size") > 0, F.transform("embedding", lambda x: x / F.col("size"))).otherwise(
                    F.transform("embedding", lambda x: x.cast("double"))).alias("embedding"))
        count = src.count()
        if not count:
            return CellIndex(src.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, "i8"), metric, id_col)
        if min(n_cells, count) < 2:  # one cell, around any vector
            centroids = np.array(fitted.limit(1).collect()[0]["embedding"], dtype=np.float64)[None, :]
        else:
            centroids = ivf.fit_centroids(fitted, min(n_cells, count), seed=seed)
    sent = spark.sparkContext.broadcast((centroids, metric))  # n_cells x dim: set by the parameter

    def assign(batches):
        import pyarrow as pa

        centres, met = sent.value
        for batch in batches:
            _, x = arrow_matrix(batch, "embedding")
            cell, far = _near(unit(x) if met == "cosine" else x, centres) if len(x) else (np.zeros(0, "i4"), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    schema = T.StructType([*src.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    placed = src.mapInArrow(assign, schema)
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), "i8")
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        radii[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
    return CellIndex(placed.select(id_col, "embedding", "cell"), centroids, radii, sizes, metric, id_col)


def bounds(q: np.ndarray, index_arrays: tuple, metric: str) -> np.ndarray:
    """(queries, cells): no member of the cell scores better; -inf for empty cells."""
    centres, radii, sizes = index_arrays
    if not len(centres):
        return np.zeros((len(q), 0))
    q = unit(q) if metric == "cosine" else q
    if metric == "l2":
        away = np.sqrt(np.maximum(1.0 - score_matrix(q, centres, "l2"), 0.0))
        top = 1.0 - np.maximum(away - radii[None, :], 0.0) ** 2
    else:
        top = q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radii[None, :]
        if metric == "cosine":
            # A zero query or vector scores 0.
            top = np.maximum(top, 0.0)
    return np.where(sizes[None, :] > 0, top, -np.inf)


class CellSearch:
    """Both passes of one batch of queries ``(qid, embedding)``."""

    def __init__(self, queries: DataFrame, index: CellIndex, k: int, max_broadcast_queries: int = MAX_BROADCAST_QUERIES):
        if k < 1:
            raise ValueError("k must be >= 1")
        self.index, self.k, self.max_queries = index, k, max_broadcast_queries
        self.spark = queries.sparkSession
        ship(self.spark)
        sent = self.spark.sparkContext.broadcast(((index.centres, index.radii, index.sizes), index.metric))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def first(emb: pd.Series) -> pd.Series:
            arrays, metric = sent.value
            top = bounds(_stack(emb), arrays, metric)
            order = np.argsort(-top, axis=1, kind="stable")
            held = np.cumsum(arrays[2][order], axis=1)
            need = (held < k).sum(axis=1) + 1
            return pd.Series([[int(c) for c in o[:n] if np.isfinite(t[c])] for o, n, t in zip(order, need, top)], dtype="object")

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def second(emb: pd.Series, done: pd.Series, kth: pd.Series) -> pd.Series:
            arrays, metric = sent.value
            top = bounds(_stack(emb), arrays, metric)
            least = kth.fillna(-np.inf).to_numpy(dtype=float)
            slack = SLACK + 1e-12 * np.abs(np.where(np.isfinite(top), top, 0.0))
            reach = np.isfinite(top) & (top + slack >= least[:, None])
            return pd.Series([[int(c) for c in np.flatnonzero(r) if c not in set(d)] for r, d in zip(reach, done)], dtype="object")

        asked = queries.filter(F.col("embedding").isNotNull()).select("qid", "embedding")
        self.first = cut_lineage(asked.withColumn("cells", first("embedding") if index.sizes.sum() else F.array().cast("array<int>")))
        self.found = cut_lineage(self._candidates(self.first))
        kth = top_k(self.found, k, doc=index.id_col).filter(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        rest = self.first.withColumnRenamed("cells", "done").join(kth, "qid", "left")
        self.second = cut_lineage(rest.withColumn("cells", second("embedding", "done", "kth")).select("qid", "embedding", "cells"))

    def _candidates(self, probed: DataFrame) -> DataFrame:
        ix = self.index
        schema = (f"qid {probed.schema['qid'].dataType.simpleString()}, "
                  f"{ix.id_col} {ix.vectors.schema[ix.id_col].dataType.simpleString()}, score double")
        wanted = probed.select(F.explode("cells").alias("c")).distinct().collect()  # at most one row per cell
        probed = probed.filter(F.size("cells") > 0)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        part = ivf.IVFIndex(ix.centres, ix.vectors, ix.metric, ix.id_col).only([r["c"] for r in wanted])
        if row_count_at_most(probed, self.max_queries):
            return ivf._search_block(self.spark, probed, part, self.k, schema)
        return ivf._search_groups(probed, part, self.k, schema, max(1, self.max_queries))

    def run(self) -> DataFrame:
        return top_k(self.found.unionByName(self._candidates(self.second)), self.k, doc=self.index.id_col)

    def cells_read(self) -> DataFrame:
        """(qid, read, cells): cells a query visits, and all that hold vectors."""
        both = self.first.select("qid", "cells").unionByName(self.second.select("qid", "cells"))
        return both.groupBy("qid").agg(F.sum(F.size("cells")).alias("read"), F.lit(int((self.index.sizes > 0).sum())).alias("cells"))


def bounded_topk(queries: DataFrame, index: CellIndex, k: int = 100,
                 max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact top-k ``(qid, id, score, rank)`` of every query, as ``knn_topk`` gives it."""
    return CellSearch(queries, index, k, max_broadcast_queries).run()
