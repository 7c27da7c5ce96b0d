"""Deterministic per-query ranking (rank numbers and top-k).

Scores are compared after rounding to 9 decimals and ties are broken by the
document id, so the same run comes out of any partitioning and agrees with a
SQL engine that sums in another order. ``row_number() <= k`` is planned by
Spark as a partial ``WindowGroupLimit`` before the shuffle, so at most ``k`` rows
per query and partition cross the network. The top-k is taken in two steps, first
per (query, salt of the document id), then per query, so the candidates of a
single query over very many partitions meet in ``SALTS`` tasks and the last one
gets ``SALTS * k`` rows, whatever the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: decimals kept when scores are compared for ranking.
RANK_DECIMALS = 9
SALTS = 16


def rank_order(score: str = "score", doc: str = "doc_id", extra: list[Column] | None = None) -> list[Column]:
    return [F.round(F.col(score), RANK_DECIMALS).desc()] + (extra or []) + [F.col(doc).asc()]


def top_k(scored: DataFrame, k: int | None, qid: str = "qid", doc: str = "doc_id", score: str = "score",
          extra_order: list[Column] | None = None) -> DataFrame:
    """Keep the best ``k`` rows per query and number them 1..k (``rank`` BIGINT).

    ``k=None`` ranks all rows. ``extra_order`` adds tie breakers before the id
    (e.g. the previous rank for a stable re-rank).
    """
    order = rank_order(score, doc, extra_order)
    if k is None:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)))
        return ranked.withColumn("rank", F.col("rank").cast("bigint"))
    if k < 1:
        raise ValueError("k must be >= 1")
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64(doc), F.lit(SALTS)))
    part = Window.partitionBy(qid, "_salt").orderBy(*order)
    best = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_salt", "_r")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))
