"""Run the headline operators once and write their final physical plans
(after adaptive execution) to PLANS.md.

Usage: python scripts/show_plans.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from quarry.operators import bm25, embed, knn, rerank, runs  # noqa: E402
from quarry.operators.index import build_index  # noqa: E402
from quarry.session import local_session  # noqa: E402
from quarry.sources import passages, tables  # noqa: E402


def final_plan(df) -> str:
    df.collect()  # executes this DataFrame's own plan, so the final plan is kept
    lines = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if ln.strip()]
    folded, skip = [], None
    for ln in lines:  # fold the plans of cached inputs
        depth = len(ln) - len(ln.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = None
        if "InMemoryRelation" in ln:
            skip = depth
        folded.append(re.sub(r"#\d+L?", "", ln)[:170])
    text = "\n".join(folded)
    if "== Final Plan ==" in text:
        text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return "\n".join(ln for ln in text.splitlines() if ln.strip(" +-:"))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out_path = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    spark = local_session(app="quarry-plans")
    docs, queries, vectors = tables.corpus(spark, sf_dir), tables.passage_queries(spark, sf_dir), tables.vectors(spark, sf_dir)
    index = build_index(docs)
    qv = embed.encode_queries(queries, embed.HashBagOfWords(64))
    self_q = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    ranker = rerank.FeedForwardRanker.formula(64, 16, 24)
    items = [
        ("BM25 top-k over the persisted, document-partitioned index", bm25.bm25_topk(index, queries, k=100)),
        ("BM25 + RM3 (second pass; first pass and expansion are checkpointed)", bm25.bm25_rm3_topk(index, queries, k=100)),
        ("exact k-NN, broadcast query matrix", knn.knn_topk(self_q, vectors, k=10)),
        ("exact k-NN, blocked cogroup plan", knn.knn_topk(self_q, vectors, k=10, max_broadcast_queries=16, block_queries=128)),
        ("re-rank (hits checkpointed, vectors fetched by broadcast semi join)",
         rerank.rerank_ffn(knn.knn_topk(qv, vectors, k=10), qv, vectors, ranker)),
        ("late fetch of raw text", runs.attach_raw(bm25.bm25_topk(index, queries, k=10), docs)),
        ("passage-containment judgements", passages.passage_judgements(docs, queries)),
    ]
    with open(out_path, "w") as f:
        f.write(f"# Physical plans (final, after adaptive execution) at `{sf_dir}`\n\n"
                "Generated by `scripts/show_plans.py`; plans of cached inputs are folded.\n")
        for title, df in items:
            f.write(f"\n## {title}\n\n```\n{final_plan(df)}\n```\n")
    spark.stop()
    print(out_path)


if __name__ == "__main__":
    main()
