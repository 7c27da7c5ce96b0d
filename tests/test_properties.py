import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import vectors as V

vec = st.lists(st.floats(min_value=-100, max_value=100, allow_nan=False, width=32), min_size=1, max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(vec.filter(lambda v: len(v) == 6), min_size=1, max_size=5))
def test_l2_normalize_idempotent(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")
    once = df.select("id", V.l2_normalize("v").alias("u"))
    twice = once.select("id", "u", V.l2_normalize("u").alias("w"))
    for r in twice.collect():
        u, w = np.array(r["u"]), np.array(r["w"])
        assert np.allclose(u, w, atol=1e-12)
        n = np.linalg.norm(u)
        assert n == 0 or abs(n - 1) < 1e-9


def test_distances_and_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "q array<double>, d array<double>")
    out = df.select(V.distance("q", "d", "ip").alias("ip"), V.distance("q", "d", "l2").alias("l2"),
                    V.distance("q", "d", "cosine").alias("cos"), V.pair_similarity("q", "d").alias("sim")).collect()
    assert [r["ip"] for r in out] == [1.0, -4.0, 1.0]
    assert [r["l2"] for r in out] == [2.0, 0.0, 1.0]
    assert [round(r["cos"], 12) for r in out] == [1.0, 0.0, 1.0]  # zero vector: cos = 0
    assert [round(r["sim"], 12) for r in out] == [0.0, 1.0, 0.0]
