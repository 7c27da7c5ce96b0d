from quarry.operators import bm25
from quarry.operators.index import build_index
from quarry.streaming import query_stream


def test_stream_matches_batch_and_replays_idempotently(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 5}") for i in range(60)], "doc_id long, text string")
    index = build_index(docs).persist()
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(1, "beta1 gamma2"), (2, "alpha")], "item_id long, text string").write.parquet(str(src / "a"))
    stream = query_stream.query_stream(spark, str(src / "a"))
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    q = query_stream.serve(stream, lambda b: bm25.bm25_topk(index, b, k=5), sink, ckpt)
    q.awaitTermination()
    got = sorted(tuple(r) for r in query_stream.read_sink(spark, sink).select("qid", "doc_id", "rank").collect())
    batch = spark.createDataFrame([(1, "beta1 gamma2"), (2, "alpha")], "qid long, text string")
    want = sorted(tuple(r) for r in bm25.bm25_topk(index, batch, k=5).select("qid", "doc_id", "rank").collect())
    assert got == want
    # replay of batch 0 (as after a lost checkpoint): its folder is overwritten, not duplicated
    q2 = query_stream.serve(query_stream.query_stream(spark, str(src / "a")),
                            lambda b: bm25.bm25_topk(index, b, k=5), sink, str(tmp_path / "ckpt2"))
    q2.awaitTermination()
    again = sorted(tuple(r) for r in query_stream.read_sink(spark, sink).select("qid", "doc_id", "rank").collect())
    assert again == want
