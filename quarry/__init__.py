"""quarry: batch retrieval, ranking and query reformulation on Spark.

Main entry points:

* ``quarry.operators.index.build_index``          -- postings, term and collection statistics
* ``quarry.operators.bm25.bm25_topk / bm25_rm3_topk``
* ``quarry.operators.knn.knn_topk`` and ``quarry.operators.ivf.approx_knn_topk``
* ``quarry.operators.embed`` (encoders, token features, pair similarity)
* ``quarry.operators.rerank`` (feed-forward scorer) and ``quarry.operators.reformulate``
* ``quarry.plans.pipeline.run_pipeline / compare_pipelines``
* ``quarry.operators.runs`` (late fetch, relevance, comparison, presentation)
* ``quarry.streaming.query_stream`` (queries served per micro-batch)

Every operator takes and returns DataFrames and works on all queries at once.
"""
