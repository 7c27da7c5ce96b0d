"""Approximate k-NN with an inverted-file (IVF) index (K3).

Build: ``pyspark.ml`` KMeans over every vector (or the caller's own centroids)
gives ``n_cells`` centroids; every vector gets the id of its nearest centroid by
distance (``cell``), whatever the search metric, so a long centroid attracts no
more than its share. Centroids are ``n_cells x dim`` -- fixed by the parameter,
not by the data. ``write`` stores the vectors in one folder per cell; a search
over a stored index reads only the folders of the probed cells.

Search: each query's ``n_probe`` best cells are computed where the queries
lie; then the (size-checked) query matrix and probe lists are broadcast and
``vectors.mapInPandas`` scores, per batch and per cell, only the queries that
probe that cell. Vectors never move; each partition emits at most ``k`` rows
per query, and the final per-query window ranks them. ``n_probe = n_cells``
gives the exact result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.knn import (MAX_BROADCAST_QUERIES, MAX_SCORE_ELEMENTS, _best_k, _best_k_rowwise, _stack, arrow_matrix,
                                  score_matrix)
from quarry.operators.ranking import top_k
from quarry.plans.sizing import cut_lineage, row_count_at_most
from quarry.shipping import ship


@dataclass
class IVFIndex:
    centroids: np.ndarray
    vectors: DataFrame  # (id_col, embedding, cell)
    metric: str = "ip"
    id_col: str = "vec_id"

    def persist(self) -> "IVFIndex":
        self.vectors.persist()
        return self

    def write(self, path: str) -> "IVFIndex":
        """Store the vectors in one folder per cell and search there from now on."""
        self.vectors.write.partitionBy("cell").parquet(path)
        return self.at(path, self.vectors.sparkSession)

    def at(self, path: str, spark) -> "IVFIndex":
        """The same index over vectors that ``write`` stored."""
        stored = spark.read.schema(self.vectors.schema).parquet(path).select(*self.vectors.columns)
        return IVFIndex(self.centroids, stored, self.metric, self.id_col)

    def only(self, cells: list[int]) -> "IVFIndex":
        """The vectors of some cells: partition pruning on a stored index."""
        return IVFIndex(self.centroids, self.vectors.filter(F.col("cell").isin(cells)), self.metric, self.id_col)


def _nearest_cells(vecs: np.ndarray, centroids: np.ndarray, metric: str, n: int) -> np.ndarray:
    s = score_matrix(vecs, centroids, metric)
    n = min(n, centroids.shape[0])
    order = np.argsort(-s, axis=1, kind="stable")
    return order[:, :n]


def fit_centroids(vectors: DataFrame, n_cells: int, train_fraction: float | None = None, seed: int = 42,
                  max_iter: int = 20) -> np.ndarray:
    """K-means centroids over every vector; a caller may ask for a fraction of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.filter(F.col("embedding").isNotNull()).select(
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    if train_fraction is not None:
        feats = feats.sample(fraction=train_fraction, seed=seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    return np.asarray(model.clusterCenters(), dtype=np.float64)


def build_ivf(vectors: DataFrame, n_cells: int = 0, metric: str = "ip", id_col: str = "vec_id",
              centroids: np.ndarray | None = None, train_fraction: float | None = None, seed: int = 42,
              max_iter: int = 20) -> IVFIndex:
    """Assign every vector its nearest of ``centroids`` (fitted with ``n_cells`` unless given)."""
    spark = vectors.sparkSession
    ship(spark)
    if centroids is None:
        centroids = fit_centroids(vectors, n_cells, train_fraction, seed, max_iter)
    bc = spark.sparkContext.broadcast(centroids)
    src = vectors.select(id_col, "embedding")
    out_schema = T.StructType(src.schema.fields + [T.StructField("cell", T.IntegerType())])

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            cell = np.full(b.num_rows, -1, dtype=np.int32)  # -1: no vector
            keep, mat = arrow_matrix(b, "embedding")
            if mat.shape[0]:
                cell[keep] = np.concatenate([_nearest_cells(part, bc.value, "l2", 1)[:, 0]
                                             for part in np.array_split(mat, 1 + mat.shape[0] * len(bc.value) // MAX_SCORE_ELEMENTS)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)],
                                             names=[id_col, "embedding", "cell"])

    assigned = src.mapInArrow(assign, out_schema)
    return IVFIndex(centroids, assigned, metric, id_col)


def approx_knn_topk(query_vecs: DataFrame, ivf: IVFIndex, k: int = 100, n_probe: int = 8,
                    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
                    max_group_vectors: int = 200_000) -> DataFrame:
    """K3: top-k ``(qid, id, score, rank)`` among the vectors of each query's
    ``n_probe`` nearest cells."""
    spark = query_vecs.sparkSession
    ship(spark)
    id_col = ivf.id_col
    qid_type = query_vecs.schema["qid"].dataType.simpleString()
    id_type = ivf.vectors.schema[id_col].dataType.simpleString()
    schema = f"qid {qid_type}, {id_col} {id_type}, score double"
    cbc = spark.sparkContext.broadcast((ivf.centroids, ivf.metric, n_probe))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probes(emb: pd.Series) -> pd.Series:
        cents, met, n = cbc.value
        cells = _nearest_cells(_stack(emb), cents, met, n)
        return pd.Series([c.astype(np.int32) for c in cells], dtype="object")

    probed = query_vecs.filter(F.col("embedding").isNotNull()).select(
        "qid", "embedding", probes("embedding").alias("cells"))
    probed = cut_lineage(probed)  # the cells are chosen once, for pruning and for the search
    wanted = probed.select(F.explode("cells").alias("c")).distinct().collect()  # at most one row per cell
    ivf = ivf.only([r["c"] for r in wanted])
    if row_count_at_most(probed, max_broadcast_queries):
        cand = _search_block(spark, probed, ivf, k, schema)
    else:
        cand = _search_groups(probed, ivf, k, schema, max_broadcast_queries, max_group_vectors)
    return top_k(cand, k, doc=id_col)


def _parts(queries: np.ndarray | None, width: int) -> list[np.ndarray]:
    """The queries of a cell in parts whose score matrix stays bounded."""
    if queries is None:
        return []
    return np.array_split(queries, 1 + len(queries) * width // MAX_SCORE_ELEMENTS)


def _search_groups(probed: DataFrame, ivf: IVFIndex, k: int, schema: str, block_queries: int,
                   max_group_vectors: int = 200_000) -> DataFrame:
    """Distributed form for many queries: (cell, sub-shard, query block) groups.

    A hot cell is split into sub-shards of at most ``max_group_vectors``
    vectors (per-cell counts: one row per cell), each query is sent to every
    sub-shard of the cells it probes, and queries are cut into blocks, so no
    group holds more than one block of queries and one sub-shard of vectors."""
    id_col, metric = ivf.id_col, ivf.metric
    n_q = probed.count()
    n_blocks = max(1, -(-n_q // block_queries))
    subs = (ivf.vectors.groupBy("cell").count()
            .select("cell", F.greatest(F.lit(1), F.ceil(F.col("count") / max_group_vectors)).cast("int").alias("n_sub")))
    subs = F.broadcast(subs)  # one row per cell: bounded by the number of cells
    q = (probed.select("qid", F.col("embedding").alias("qvec"), F.explode("cells").alias("cell"))
         .join(subs, "cell")
         .select("qid", "qvec", "cell", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)).alias("sub"),
                 F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).alias("block")))
    v = (ivf.vectors.filter(F.col("embedding").isNotNull()).join(subs, "cell")
         .select(id_col, F.col("embedding").alias("vvec"), "cell",
                 F.pmod(F.xxhash64(id_col), F.col("n_sub")).alias("sub"),
                 F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")))

    def run(qpdf: pd.DataFrame, vpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or vpdf.empty:
            return pd.DataFrame({"qid": [], id_col: [], "score": []})
        qids = qpdf["qid"].to_numpy()
        ids = vpdf[id_col].to_numpy()
        qm, vm, parts = _stack(qpdf["qvec"]), _stack(vpdf["vvec"]), []
        step = max(1, MAX_SCORE_ELEMENTS // len(ids))
        for at in range(0, len(qids), step):  # bounded score matrix
            sc = score_matrix(qm[at:at + step], vm, metric)
            rows, cols = _best_k(sc, ids, k)
            parts.append(pd.DataFrame({"qid": qids[at + rows], id_col: ids[cols], "score": sc[rows, cols]}))
        return pd.concat(parts, ignore_index=True)

    return q.groupBy("cell", "sub", "block").cogroup(v.groupBy("cell", "sub", "block")).applyInPandas(run, schema)


def _search_block(spark, probed: DataFrame, ivf: IVFIndex, k: int, schema: str) -> DataFrame:
    id_col, metric = ivf.id_col, ivf.metric
    qpdf = probed.toPandas()
    qids = qpdf["qid"].to_numpy()
    qmat = _stack(qpdf["embedding"])
    by_cell: dict[int, list] = {}
    for qi, cells in enumerate(qpdf["cells"]):
        for c in cells:
            by_cell.setdefault(int(c), []).append(qi)
    bc = spark.sparkContext.broadcast((qids, qmat, {c: np.asarray(v) for c, v in by_cell.items()}))

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        bq, bm, cells_map = bc.value
        nq = len(bq)
        # running k best per query; -inf / None mark empty slots
        best_s = np.full((nq, k), -np.inf)
        best_i = np.full((nq, k), None, dtype=object)
        for b in batches:
            keep, mat = arrow_matrix(b, "embedding")
            if not mat.shape[0]:
                continue
            all_ids = b.column(id_col).to_numpy(zero_copy_only=False)[keep]
            cells = b.column("cell").to_numpy(zero_copy_only=False)[keep]
            order = np.argsort(cells, kind="stable")
            bounds = np.flatnonzero(np.diff(cells[order])) + 1
            for rows_of_cell, qsel in ((r, part) for r in np.split(order, bounds)
                                       for part in _parts(cells_map.get(int(cells[r[0]])), len(r))):
                ids = all_ids[rows_of_cell]
                sc = score_matrix(bm[qsel], mat[rows_of_cell], metric)
                rows, cols = _best_k(sc, ids, k)
                m = len(cols) // len(qsel)
                cand_s = np.concatenate([best_s[qsel], sc[rows, cols].reshape(len(qsel), m)], axis=1)
                cand_i = np.concatenate([best_i[qsel], ids[cols].reshape(len(qsel), m).astype(object)], axis=1)
                r2, c2 = _best_k_rowwise(cand_s, cand_i, k)
                best_s[qsel] = cand_s[r2, c2].reshape(len(qsel), k)
                best_i[qsel] = cand_i[r2, c2].reshape(len(qsel), k)
        found = np.isfinite(best_s)
        types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string(),
                 "double": pa.float64()}
        yield pa.RecordBatch.from_pydict(
            {"qid": list(np.repeat(bq, found.sum(axis=1))), id_col: list(best_i[found]), "score": best_s[found]},
            schema=pa.schema([(name, types[t]) for name, t in fields]))

    return ivf.vectors.select(id_col, "embedding", "cell").mapInArrow(run, schema)
