"""Exact k-NN with bounds against the full scan."""

import numpy as np
import pytest

from quarry.operators import cells, knn


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(z) for z in v]) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<float>")


def clustered(n=1200, dim=12, groups=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 6
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.15
    return np.round(x, 3), centres


def result(run):
    return sorted((r.qid, r.rank, r.vec_id, round(r.score, 6)) for r in run.collect())


def asked(df):
    return df.withColumnRenamed("vec_id", "qid")


@pytest.mark.parametrize("metric", knn.METRICS)
def test_equals_the_full_scan_and_skips_cells(spark, metric):
    x, centres = clustered()
    vectors = frame(spark, [*x, x[3], x[3], np.zeros(12), None])
    queries = asked(frame(spark, [*x[:40], np.zeros(12), centres[0], None], 9000))
    index = cells.build_cells(vectors, 24, metric)
    for k in (1, 10, 60):
        search = cells.CellSearch(queries, index, k)
        assert result(search.run()) == result(knn.knn_topk(queries, vectors, k=k, metric=metric))
    read = [r for r in cells.CellSearch(asked(frame(spark, x[:40])), index, 5).cells_read().collect()]
    assert len(read) == 40 and sum(r["read"] for r in read) < 0.35 * sum(r["cells"] for r in read)


def test_no_structure_reads_most_cells_and_stays_exact(spark):
    x = np.random.default_rng(2).normal(size=(400, 24))
    vectors = frame(spark, x)
    index = cells.build_cells(vectors, 8)
    search = cells.CellSearch(asked(vectors), index, 10)
    assert result(search.run()) == result(knn.knn_topk(asked(vectors), vectors, k=10))
    read = search.cells_read().collect()
    assert sum(r["read"] for r in read) > 0.7 * sum(r["cells"] for r in read)


def test_groups_of_cells_and_stored_folders(spark, tmp_path):
    x, _ = clustered(500)
    vectors = frame(spark, x)
    index = cells.build_cells(vectors, 12, "l2").write(str(tmp_path / "cells"))
    want = result(knn.knn_topk(asked(vectors), vectors, k=6, metric="l2"))
    assert result(cells.bounded_topk(asked(vectors), index, 6, max_broadcast_queries=50)) == want
    one = cells.CellSearch(asked(frame(spark, x[:1])), index, 3)
    assert result(one.run()) == result(knn.knn_topk(asked(frame(spark, x[:1])), vectors, k=3, metric="l2"))


def test_ties_across_cells(spark):
    """Equal vectors at equal scores in different cells: ids decide."""
    x = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.5, 0.5]] * 5
    vectors = frame(spark, x)
    queries = asked(frame(spark, [[1.0, 1.0], [0.0, 0.0]], 100))
    index = cells.build_cells(vectors, 4, centroids=np.array([[1.0, 0], [0, 1.0], [-1.0, 0], [9.0, 9.0]]))
    for k in (1, 3, 8, 40):
        assert result(cells.bounded_topk(queries, index, k)) == result(knn.knn_topk(queries, vectors, k=k))


def test_empty_tables(spark):
    vectors = frame(spark, [[1.0, 2.0]])
    none = vectors.limit(0)
    assert cells.bounded_topk(asked(none), cells.build_cells(vectors, 2), 3).count() == 0
    assert cells.bounded_topk(asked(vectors), cells.build_cells(none, 2), 3).count() == 0
    with pytest.raises(ValueError):
        cells.build_cells(vectors, 2, "manhattan")
