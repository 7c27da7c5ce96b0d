"""Exact k-nearest-neighbour search over a vector table.

``knn_topk(query_vecs(qid, embedding), vectors(vec_id, embedding), k, metric)``
returns ``(qid, vec_id, score, rank)`` with ``score = 1 - distance``:
``ip`` -> q.d, ``l2`` -> 1 - |q - d|^2, ``cosine`` -> cos (0 for a zero vector).
Ties: rounded score (9 decimals) descending, then id ascending.

Two plans, same rows:

* **broadcast** (query matrix proven small): the ``Q x dim`` matrix is
  broadcast once; ``vectors.mapInPandas`` scores each Arrow batch with one
  matrix product and keeps the ``k`` best per query for the whole partition.
  The vectors never move; the only shuffle carries ``partitions x Q x k`` rows
  into the final per-query window.
* **blocked** (many queries): the vectors are stored once as shards in the session's
  shared folder, and the queries are dealt to tasks. A task holds a block of queries,
  reads shard after shard in batches and keeps the ``k`` best per query and shard, so
  its memory is bounded on both sides and neither side is copied for the other: disk
  and shuffle grow with the rows, not with their product.

No pair of (query, vector) is ever materialised as a row.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.ranking import RANK_DECIMALS, top_k
from quarry.session import ensure_checkpoint_dir, filesystem
from quarry.shipping import ship

METRICS = ("ip", "l2", "cosine")
# Bound of the broadcast query matrix (rows and bytes as float64).
MAX_BROADCAST_QUERIES = 50_000
MAX_BROADCAST_BYTES = 512 * 1024 * 1024
# Score-matrix elements computed at once inside a task (bounds task memory).
MAX_SCORE_ELEMENTS = 2_000_000
# Queries scored at once inside a task.
QUERY_ROWS = 1024
# Rows of an Arrow batch that a task returns.
OUT_ROWS = 100_000
# Queries per block and, at most, vectors per shard in the blocked plan.
BLOCK_QUERIES = 16384
SHARD_VECTORS = 50_000
# Queries that are worth a task, which reads all shards.
TASK_QUERIES = 128
# Vectors of a shard read at once.
SHARD_ROWS = 8192


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def score_matrix(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """(nq, nv) scores ``1 - distance`` in float64."""
    ip = q @ v.T
    if metric == "ip":
        return ip
    if metric == "l2":
        qq = (q * q).sum(axis=1)[:, None]
        vv = (v * v).sum(axis=1)[None, :]
        return 1.0 - np.maximum(qq + vv - 2.0 * ip, 0.0)
    if metric == "cosine":
        den = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(den > 0, ip / np.where(den > 0, den, 1.0), 0.0)
    raise ValueError(f"unknown metric {metric!r}")


def _best_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the k best columns by (rounded score desc, id asc).

    Returns index arrays (rows, cols) into ``scores``; exact at ties."""
    nq, n = scores.shape
    if n <= k:
        rows = np.repeat(np.arange(nq), n)
        return rows, np.tile(np.arange(n), nq)
    r = np.round(scores, RANK_DECIMALS)
    part = np.argpartition(-r, k - 1, axis=1)[:, :k]
    sel = np.take_along_axis(r, part, axis=1)
    kth = sel.min(axis=1)
    n_all = (r == kth[:, None]).sum(axis=1)
    n_sel = (sel == kth[:, None]).sum(axis=1)
    cols = part
    for i in np.nonzero(n_all > n_sel)[0]:  # ties cut at the boundary: choose by id
        cand = np.nonzero(r[i] >= kth[i])[0]
        order = sorted(cand, key=lambda c: (-r[i, c], ids[c]))
        cols[i] = np.asarray(order[:k])
    rows = np.repeat(np.arange(nq), k)
    return rows, cols.reshape(-1)


def _best_k_rowwise(scores: np.ndarray, ids: np.ndarray, k: int):
    nq, n = scores.shape
    r = np.round(scores, RANK_DECIMALS)
    part = np.argpartition(-r, k - 1, axis=1)[:, :k]
    sel = np.take_along_axis(r, part, axis=1)
    kth = sel.min(axis=1)
    n_all = (r == kth[:, None]).sum(axis=1)
    n_sel = (sel == kth[:, None]).sum(axis=1)
    for i in np.nonzero(n_all > n_sel)[0]:
        cand = np.nonzero(r[i] >= kth[i])[0]
        order = sorted(cand, key=lambda c: (-r[i, c], ids[i, c]))
        part[i] = np.asarray(order[:k])
    return np.repeat(np.arange(nq), k), part.reshape(-1)


def _partition_topk_arrays(qids: np.ndarray, qmat: np.ndarray, batches, k: int, metric: str):
    """Consume ``(ids, matrix)`` batches of vectors; return ``(qid, id, score)``
    arrays of the partition's k best per query."""
    nq = len(qids)
    best_s = np.zeros((nq, 0))
    best_i = None
    for ids_all, vecs_all in batches:
        if nq == 0 or len(ids_all) == 0:
            continue
        if vecs_all.shape[1] != qmat.shape[1]:
            raise ValueError(f"vector dim {vecs_all.shape[1]} != query dim {qmat.shape[1]}")
        if best_i is None:
            best_i = np.zeros((nq, 0), dtype=ids_all.dtype)
        if best_i.dtype != ids_all.dtype:  # ids of some batches hold nulls
            best_i = best_i.astype(object)
        # Blocks of queries against blocks of vectors: the scores held at once stay
        # bounded, however many queries there are.
        rows_at_once = min(nq, QUERY_ROWS)
        step = max(1, MAX_SCORE_ELEMENTS // rows_at_once)
        for s0 in range(0, len(ids_all), step):
            ids, vecs = ids_all[s0:s0 + step], vecs_all[s0:s0 + step]
            held = best_s.shape[1]
            m = min(k, held + len(ids))
            next_s, next_i = (best_s, best_i) if m == held else (np.empty((nq, m)), np.empty((nq, m), best_i.dtype))
            for q0 in range(0, nq, rows_at_once):
                q = slice(q0, min(nq, q0 + rows_at_once))
                sc = score_matrix(qmat[q], vecs, metric)
                rows, cols = _best_k(sc, ids, k)
                n = len(sc)
                s = np.concatenate([best_s[q], sc[rows, cols].reshape(n, -1)], axis=1)
                i = np.concatenate([best_i[q], ids[cols].reshape(n, -1)], axis=1)
                if s.shape[1] > k:
                    rows, cols = _best_k_rowwise(s, i, k)
                    s, i = s[rows, cols].reshape(n, k), i[rows, cols].reshape(n, k)
                next_s[q], next_i[q] = s, i
            best_s, best_i = next_s, next_i
    m = best_s.shape[1]
    return np.repeat(qids, m), (np.zeros(0, dtype=object) if best_i is None else best_i.reshape(-1)), best_s.reshape(-1)


def arrow_matrix(batch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, float64 matrix) of a list<float> column of an Arrow batch:
    the values buffer is reshaped, no Python loop per row. Null vectors are
    skipped; vectors must share one length."""
    import pyarrow.compute as pc

    arr = batch.column(column)
    keep = np.asarray(pc.is_valid(arr).to_numpy(zero_copy_only=False), dtype=bool)
    if not keep.all():
        arr = arr.filter(pc.is_valid(arr))
    n = len(arr)
    if n == 0:
        return keep, np.zeros((0, 0))
    lengths = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    dim = int(lengths[0])
    if not (lengths == dim).all():
        raise ValueError("vectors of different lengths in one table")
    values = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return keep, values.reshape(n, dim)


def _broadcast_plan(queries: DataFrame, vectors: DataFrame, k: int, metric: str, id_col: str,
                    schema: str) -> DataFrame:
    spark = vectors.sparkSession
    ship(spark)
    qpdf = queries.select("qid", "embedding").filter(F.col("embedding").isNotNull()).toPandas()
    qids = qpdf["qid"].to_numpy()
    qmat = _stack(qpdf["embedding"])
    bc = spark.sparkContext.broadcast((qids, qmat))

    def batches_as_frames(arrow_batches):
        for b in arrow_batches:
            keep, mat = arrow_matrix(b, "embedding")
            if mat.shape[0]:
                ids = b.column(id_col).to_numpy(zero_copy_only=False)[keep]
                yield ids, mat

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def run(arrow_batches):
        import pyarrow as pa

        types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string(),
                 "double": pa.float64()}
        pa_schema = pa.schema([(name, types[t]) for name, t in fields])
        bq, bm = bc.value
        out = _partition_topk_arrays(bq, bm, batches_as_frames(arrow_batches), k, metric)
        for at in range(0, max(1, len(out[2])), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            columns = [pa.array(x[part], t, from_pandas=True) for x, t in zip(out, pa_schema.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa_schema)

    return vectors.select(id_col, "embedding").mapInArrow(run, schema)


def _blocked_plan(queries: DataFrame, vectors: DataFrame, k: int, metric: str, id_col: str, schema: str,
                  n_queries: int, block_queries: int) -> DataFrame:
    spark = vectors.sparkSession
    ship(spark)
    most = max(block_queries, QUERY_ROWS)  # queries of a task held at once
    n_shards = max(1, math.ceil(vectors.count() / SHARD_VECTORS))
    # Stored once; every task reads the shards, so neither side is copied for the other.
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/knn-shards-{uuid.uuid4().hex}"
    kept = vectors.select(id_col, "embedding").filter(F.col("embedding").isNotNull())
    kept.repartition(n_shards).write.parquet(path)
    shards = sorted(spark.read.schema(kept.schema).parquet(path).inputFiles())
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_queries / TASK_QUERIES))
    n_parts = max(1, tasks, math.ceil(n_queries / most))
    q = queries.select("qid", "embedding").filter(F.col("embedding").isNotNull()).repartition(n_parts)
    out_schema = to_arrow_schema(T.StructType.fromDDL(schema))

    def vectors_of(shard: str):
        import pyarrow.parquet as pq

        fs, name = filesystem(shard)
        with fs.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(SHARD_ROWS, columns=[id_col, "embedding"]):
                keep, mat = arrow_matrix(batch, "embedding")
                if len(mat):
                    yield batch.column(id_col).to_numpy(zero_copy_only=False)[keep], mat

    def scored(qids: np.ndarray, qmat: np.ndarray):
        import pyarrow as pa

        for shard in shards:
            out = _partition_topk_arrays(qids, qmat, vectors_of(shard), k, metric)
            for at in range(0, len(out[2]), OUT_ROWS):
                columns = [pa.array(x[at:at + OUT_ROWS], t, from_pandas=True) for x, t in zip(out, out_schema.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        for batch in batches:
            ids, mat = batch.column("qid").to_numpy(zero_copy_only=False), arrow_matrix(batch, "embedding")[1]
            for at in range(0, len(ids), most):
                part = (ids[at:at + most], mat[at:at + most])
                if held and sum(len(i) for i, _ in held) + len(part[0]) > most:
                    yield from scored(*map(np.concatenate, zip(*held)))
                    held.clear()
                held.append(part)
        if held:
            yield from scored(*map(np.concatenate, zip(*held)))

    return q.mapInArrow(run, schema)


def knn_candidates(query_vecs: DataFrame, vectors: DataFrame, k: int = 100, metric: str = "ip",
                   id_col: str = "vec_id", max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
                   block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Per-partition (or per-group) k best ``(qid, id, score)``; feed to ``top_k``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be >= 1")
    qid_type = query_vecs.schema["qid"].dataType.simpleString()
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"qid {qid_type}, {id_col} {id_type}, score double"
    # one plain aggregate gives the row count and the dimension: a row per partition moves
    probe = query_vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    dim = max(1, probe["d"] or 1)
    if probe["n"] <= min(max_broadcast_queries, MAX_BROADCAST_BYTES // (8 * dim)):
        return _broadcast_plan(query_vecs, vectors, k, metric, id_col, schema)
    return _blocked_plan(query_vecs, vectors, k, metric, id_col, schema, probe["n"], block_queries)


def knn_topk(query_vecs: DataFrame, vectors: DataFrame, k: int = 100, metric: str = "ip",
             id_col: str = "vec_id", max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
             block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """K1: exact top-k ``(qid, id_col, score, rank)`` for every query vector."""
    cand = knn_candidates(query_vecs, vectors, k, metric, id_col, max_broadcast_queries, block_queries)
    return top_k(cand, k, doc=id_col)
