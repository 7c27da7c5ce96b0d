"""Physical-plan checks: where the shuffles are and are not."""

import re

import numpy as np

from quarry.operators import bm25, knn, runs
from quarry.operators.index import build_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_no_shuffle_of_postings(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common text {i}") for i in range(200)],
                                 "doc_id long, text string")
    idx = build_index(docs).persist()
    idx.postings.count()
    q = spark.createDataFrame([(1, "w1 common"), (2, "w2 text")], "qid long, text string")
    p = bm25.bm25_topk(idx, q, k=5)
    p.count()
    s = plan(p)
    assert "BroadcastHashJoin" in s
    assert "WindowGroupLimit" in s  # partial top-k before the shuffle on qid
    # no exchange keyed on (qid, doc_id): the sum per hit runs in place
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", s)
    assert "SortMergeJoin" not in s


def test_knn_no_pairs(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)],
                              "vec_id long, embedding array<float>")
    q = v.selectExpr("vec_id AS qid", "embedding")
    for run in (knn.knn_topk(q, v, k=3), knn.knn_topk(q, v, k=3, max_broadcast_queries=5, block_queries=10)):
        run.count()
        s = plan(run)
        assert "CartesianProduct" not in s and "BroadcastNestedLoopJoin" not in s
        assert "MapInArrow" in s or "FlatMapCoGroupsInPandas" in s


def test_late_fetch_filters_corpus_in_place(spark):
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    run = spark.createDataFrame([(1, 3, 1, 1.0)], "qid long, doc_id long, rank bigint, score double")
    out = runs.attach_raw(run, corpus)
    out.count()
    s = plan(out)
    assert re.search(r"BroadcastHashJoin.*LeftSemi", s)


def test_bucketed_index_tables_keep_doc_partitioning(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common text {i}") for i in range(200)],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 common"), (2, "w2 text")], "qid long, text string")
    idx = build_index(docs)
    want = sorted(tuple(r) for r in bm25.bm25_topk(idx, q, k=5).select("qid", "doc_id", "rank").collect())
    idx.save_as_tables("test_idx", buckets=4)
    stored = idx.from_tables(spark, "test_idx")
    assert stored._stats == idx.stats()  # statistics come with the tables, no rescan
    run = bm25.bm25_topk(stored, q, k=5)
    got = sorted(tuple(r) for r in run.select("qid", "doc_id", "rank").collect())
    assert got == want
    s = plan(run)
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", s)
    assert "SortMergeJoin" not in s


def test_index_write_read_roundtrip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 5} text {i}") for i in range(50)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 text")], "qid long, text string")
    idx = build_index(docs)
    idx.write(str(tmp_path / "idx"))
    back = idx.read(spark, str(tmp_path / "idx"))
    assert back.stats() == idx.stats()
    a = sorted(tuple(r) for r in bm25.bm25_topk(idx, q, k=5).select("doc_id", "rank").collect())
    b = sorted(tuple(r) for r in bm25.bm25_topk(back, q, k=5).select("doc_id", "rank").collect())
    assert a == b
