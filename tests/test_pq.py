"""Product quantisation: codes, estimates and recall against the full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn, pq
from quarry.sources import tables


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(z) for z in v]) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<float>")


def asked(df):
    return df.withColumnRenamed("vec_id", "qid")


def recall(got, want):
    best = {}
    for r in want.collect():
        best.setdefault(r.qid, set()).add(r.vec_id)
    hits = sum(r.vec_id in best[r.qid] for r in got.collect())
    return hits / sum(map(len, best.values()))


def rows(run):
    return sorted((r.qid, r.rank, r.vec_id, round(r.score, 6)) for r in run.collect())


def test_codes_are_the_nearest_centres(spark):
    x = np.random.default_rng(0).normal(size=(700, 10))
    index = pq.build_pq(frame(spark, [*x, None]), n_sub=4, n_codes=16)
    codes = {r.vec_id: list(r.code) for r in index.codes.collect()}
    assert set(codes) == set(range(700)) and [b.shape for b in index.books] == [(16, 2), (16, 3), (16, 2), (16, 3)]
    at = 0
    for j, book in enumerate(index.books):
        part = np.float32(x[:, at:at + book.shape[1]]).astype(float)
        away = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert all(away[i, codes[i][j]] <= away[i].min() + 1e-9 for i in range(700))
        at += book.shape[1]


@pytest.mark.parametrize("metric", knn.METRICS)
def test_tables_score_the_decoded_vectors(metric):
    rng = np.random.default_rng(1)
    books = [rng.normal(size=(8, 3)), rng.normal(size=(8, 2))]
    code, q = rng.integers(0, 8, (50, 2)), rng.normal(size=(4, 5))
    decoded = np.concatenate([books[0][code[:, 0]], books[1][code[:, 1]]], axis=1)
    s = sum(t[:, code[:, j]] for j, t in enumerate(pq.tables(q, books, metric)))
    if metric == "l2":
        want = (q * q).sum(axis=1)[:, None] - ((q[:, None] - decoded[None]) ** 2).sum(axis=2)
    else:
        want = (pq.unit(q) if metric == "cosine" else q) @ decoded.T
    assert np.allclose(s, want)


@pytest.mark.parametrize("metric", knn.METRICS)
def test_all_candidates_give_the_exact_result(spark, metric):
    x = np.random.default_rng(3).normal(size=(300, 12))
    vectors = frame(spark, [*x, x[0], x[0], None])
    index = pq.build_pq(vectors, metric, n_sub=3, n_codes=32)
    want = rows(knn.knn_topk(asked(vectors), vectors, k=5, metric=metric))
    assert rows(pq.pq_topk(asked(vectors), vectors, index, 5, per_neighbour=100)) == want
    assert rows(pq.pq_topk(asked(vectors), vectors, index, 5, per_neighbour=100, max_broadcast_queries=40)) == want


def test_recall_of_fifty_thousand_vectors(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(50_000, 64)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import pyarrow as pa
    import pyarrow.parquet as parquet

    parquet.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}),
                        str(tmp_path / "v.parquet"))
    vectors = spark.read.parquet(str(tmp_path / "v.parquet"))
    queries = asked(vectors.filter(F.col("vec_id") % 500 == 0))
    index = pq.build_pq(vectors).write(str(tmp_path / "codes"))
    assert index.codes.count() == 50_000
    got = recall(pq.pq_topk(queries, vectors, index, 10), knn.knn_topk(queries, vectors, k=10))
    print("recall", got)
    assert got >= 0.9


def test_registered_queries_find_the_nearest(spark):
    """Recall at 10 of the registered approximate queries on the larger table."""
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.1"
    vectors = tables.vectors(spark, sf)
    want = knn.knn_topk(asked(vectors), vectors, k=10).select("qid", "vec_id").cache()
    for name in ("approx_knn_topk", "pq_knn_topk"):
        got = E.queries()[name](spark, sf)
        assert got.columns == ["qid", "vec_id", "rank", "score"] and recall(got, want) >= 0.9
    want.unpersist()


def test_small_and_empty_tables(spark):
    one = frame(spark, [[1.0, 2.0]])
    assert rows(pq.pq_topk(asked(one), one, pq.build_pq(one), 3)) == [(0, 1, 0, 5.0)]
    none = one.limit(0)
    assert pq.pq_topk(asked(one), none, pq.build_pq(none), 3).count() == 0
    assert pq.pq_topk(asked(none), one, pq.build_pq(one), 3).count() == 0
    with pytest.raises(ValueError):
        pq.build_pq(one, n_codes=300)
