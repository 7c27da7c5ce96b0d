"""Pipelines: retriever -> [re-ranker] -> [reformulate -> retrieve -> re-rank]
(F8, F9, G1, G2).

A ``Pipeline`` names its stages; ``run_pipeline`` composes the operators into
one Spark job per pass for *all* queries at once. Between the two passes the
small first-pass run is checkpointed into the shared checkpoint folder: the
lineage is cut (a lost executor does not recompute the first pass) and the run
is reused for feedback and checks without being recomputed.

Validity (as the original choice rules): BM25 takes no ranker and no
reformulator; k-NN takes the feed-forward ranker or none; a reformulator needs
k-NN with the ranker (the original silently ignored it elsewhere -- here it is
an error). Depth ``k`` is 1..1000.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import bm25, embed, knn, rerank, runs
from quarry.operators.index import TextIndex
from quarry.operators.reformulate import Reformulator, reformulate
from quarry.plans.sizing import cut_lineage

# Allowed result depth and the default.
MIN_K, MAX_K, DEFAULT_K = 1, 1000, 100
RETRIEVERS = ("bm25", "knn")


@dataclass
class Pipeline:
    retriever: str = "knn"
    ranker: rerank.FeedForwardRanker | None = None
    reformulator: Reformulator | None = None
    k: int = DEFAULT_K
    metric: str = "ip"
    encoder: object = None
    rm3: bool = True
    name: str = "pipeline"

    def validate(self) -> "Pipeline":
        if self.retriever not in RETRIEVERS:
            raise ValueError(f"retriever must be one of {RETRIEVERS}")
        if not MIN_K <= self.k <= MAX_K:
            raise ValueError(f"k must be in {MIN_K}..{MAX_K}")
        if self.retriever == "bm25" and (self.ranker is not None or self.reformulator is not None):
            raise ValueError("BM25 pipelines take no ranker and no reformulator")
        if self.reformulator is not None and self.ranker is None:
            raise ValueError("a reformulator needs the k-NN retriever with the feed-forward ranker")
        return self


def run_pipeline(p: Pipeline, queries: DataFrame, *, index: TextIndex | None = None,
                 vectors: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """G1: the run ``(qid, <id>, rank, score)`` of pipeline ``p``.

    ``queries(qid, text)``; BM25 needs ``index``, k-NN needs ``vectors(id_col,
    embedding)``. k-NN runs keep the hit vectors in ``embedding``. With a
    reformulator every query stays: one whose new vector is undefined (scores that
    sum to zero) keeps its first-pass run, and ``reformulated`` says which is which."""
    p.validate()
    if p.retriever == "bm25":
        if index is None:
            raise ValueError("BM25 needs an index")
        if p.rm3:
            return bm25.bm25_rm3_topk(index, queries, k=p.k)
        return bm25.bm25_topk(index, queries, k=p.k)

    if vectors is None:
        raise ValueError("k-NN needs a vector table")
    # encoded once: the search, the size checks and the re-ranker all read it
    qv = cut_lineage(embed.encode_queries(queries, p.encoder))
    hits = knn.knn_topk(qv, vectors, k=p.k, metric=p.metric, id_col=id_col)
    if p.ranker is None:
        return hits
    hits = rerank.rerank_ffn(hits, qv, vectors, p.ranker, id_col=id_col)
    if p.reformulator is None:
        return hits
    first = cut_lineage(hits)
    new_qv = cut_lineage(reformulate(first, qv, p.reformulator).filter(F.col("embedding").isNotNull()))
    second = knn.knn_topk(new_qv, vectors, k=p.k, metric=p.metric, id_col=id_col)
    second = rerank.rerank_ffn(second, new_qv, vectors, p.ranker, id_col=id_col)
    # a query whose reformulation is undefined keeps its first-pass run
    kept = first.join(new_qv.select("qid"), "qid", "left_anti")
    return second.withColumn("reformulated", F.lit(True)).unionByName(kept.withColumn("reformulated", F.lit(False)))


def compare_pipelines(a: Pipeline, b: Pipeline, queries: DataFrame, *, index: TextIndex | None = None,
                      vectors: DataFrame | None = None, id_map: DataFrame | None = None) -> DataFrame:
    """Two pipelines side by side on the same queries.

    k-NN runs are translated to document ids through ``id_map(doc_id, vec_id)``
    so both sides speak document ids."""
    def as_docs(p: Pipeline) -> DataFrame:
        r = run_pipeline(p, queries, index=index, vectors=vectors)
        if p.retriever == "knn":
            if id_map is None:
                raise ValueError("comparing a k-NN run needs an id map")
            r = runs.id_translate(r, id_map)
        return r.select("qid", "doc_id", "rank", "score")

    return runs.compare_runs(as_docs(a), as_docs(b))
