"""Re-ranker, pair scoring, projections and reformulators against
independent loop implementations."""

import math

import numpy as np
import pytest

from quarry.operators import reformulate as R
from quarry.operators import rerank
from quarry.plans import pipeline as P
from quarry.sources.weights import formula_layers, load_model, weights_frame

DIM = 8


def loop_dense(x, w, b):
    return [sum(w[o][i] * x[i] for i in range(len(x))) + b[o] for o in range(len(w))]


def loop_ffn(t, q, d):
    x = [a * c for a, c in zip(q, d)]
    h = [max(v, 0.0) for v in loop_dense(x, t["input.weight"], t["input.bias"])]
    if "extra_hidden.weight" in t:
        h = [max(v, 0.0) for v in loop_dense(h, t["extra_hidden.weight"], t["extra_hidden.bias"])]
    h = [max(v, 0.0) for v in loop_dense(h, t["h1.weight"], t["h1.bias"])]
    return loop_dense(h, t["output.weight"], t["output.bias"])[0]


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / max(n, 1e-12) for x in v]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    vecs = {i: [float(x) for x in rng.normal(size=DIM).astype(np.float32)] for i in range(40)}
    qv = {q: [float(x) for x in rng.normal(size=DIM)] for q in ("a", "b")}
    vectors = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>")
    query_vecs = spark.createDataFrame(list(qv.items()), "qid string, embedding array<double>")
    run = spark.createDataFrame([(q, i, r + 1, 1.0 - r / 100) for q in qv for r, i in enumerate(range(12))],
                                "qid string, vec_id long, rank bigint, score double")
    return vecs, qv, vectors, query_vecs, run


def test_rerank_matches_loop(spark, data):
    vecs, qv, vectors, query_vecs, run = data
    ranker = rerank.FeedForwardRanker.formula(DIM, 6, 10)
    got = rerank.rerank_ffn(run, query_vecs, vectors, ranker).collect()
    for q in qv:
        rows = sorted([r for r in got if r["qid"] == q], key=lambda r: r["rank"])
        want = sorted(((loop_ffn(ranker.tensors, qv[q], vecs[i]), i) for i in range(12)),
                      key=lambda x: (-round(x[0], 9), x[1]))
        assert [r["vec_id"] for r in rows] == [i for _, i in want]
        assert np.allclose([r["score"] for r in rows], [s for s, _ in want], atol=1e-12)
        assert sorted(r["vec_id"] for r in rows) == list(range(12))  # a permutation of the hits


def test_rerank_equal_scores_keep_order_and_single_hit(spark, data):
    vecs, qv, vectors, query_vecs, run = data
    t = formula_layers({"input": (4, DIM), "h1": (4, 4), "output": (1, 4)})
    t["output.weight"] = np.zeros((1, 4))  # every score equals the bias
    got = rerank.rerank_ffn(run, query_vecs, vectors, rerank.FeedForwardRanker(t)).collect()
    a = sorted([r for r in got if r["qid"] == "a"], key=lambda r: r["rank"])
    assert [r["prev_rank"] for r in a] == list(range(1, 13))
    one = run.filter("qid = 'a' AND rank = 1")
    assert rerank.rerank_ffn(one, query_vecs, vectors, rerank.FeedForwardRanker(t)).count() == 1


def test_score_pairs_null_negative(spark, data):
    vecs, qv, vectors, query_vecs, _ = data
    ranker = rerank.FeedForwardRanker.formula(DIM, 6)
    triples = spark.createDataFrame([("a", 1, 2), ("a", 3, None)], "qid string, pos_id long, neg_id long")
    got = {r["pos_id"]: r for r in rerank.score_pairs(triples, query_vecs, vectors, ranker).collect()}
    assert abs(got[1]["score_pos"] - loop_ffn(ranker.tensors, qv["a"], vecs[1])) < 1e-12
    assert abs(got[1]["score_neg"] - loop_ffn(ranker.tensors, qv["a"], vecs[2])) < 1e-12
    assert got[3]["score_neg"] is None


def test_weights_table_roundtrip(spark):
    t = formula_layers({"input": (3, 4), "output": (1, 3)})
    df = weights_frame(spark, "m", t)
    back = load_model(df, "m")
    for k in t:
        assert np.allclose(back[k], t[k], atol=1e-7)


def loop_transformer(tensors, heads, layers, q, docs):
    seq = [list(q)] + [list(d) for d in docs]
    s, e = len(seq), len(q)
    x = [[seq[p][i] * math.sqrt(e) + (math.sin(p * math.exp(i * -math.log(10000.0) / e)) if i % 2 == 0
          else math.cos(p * math.exp((i - 1) * -math.log(10000.0) / e))) for i in range(e)] for p in range(s)]

    def norm(v, g, b):
        mu = sum(v) / len(v)
        var = sum((a - mu) ** 2 for a in v) / len(v)
        return [(a - mu) / math.sqrt(var + 1e-5) * g[i] + b[i] for i, a in enumerate(v)]

    hd = e // heads
    for li in range(layers):
        p = {k: tensors[f"layers.{li}.{v}"] for k, v in R.TRANSFORMER_LAYER_KEYS.items()}
        qkv = [loop_dense(row, p["in_w"], p["in_b"]) for row in x]
        ctx = [[0.0] * e for _ in range(s)]
        for h in range(heads):
            sl = slice(h * hd, (h + 1) * hd)
            for i in range(s):
                qi = qkv[i][:e][sl]
                logits = [sum(a * b for a, b in zip(qi, qkv[j][e:2 * e][sl])) / math.sqrt(hd) for j in range(s)]
                mx = max(logits)
                ex = [math.exp(v - mx) for v in logits]
                z = sum(ex)
                for j in range(s):
                    vj = qkv[j][2 * e:][sl]
                    for c in range(hd):
                        ctx[i][h * hd + c] += ex[j] / z * vj[c]
        att = [loop_dense(c, p["out_w"], p["out_b"]) for c in ctx]
        x = [norm([a + b for a, b in zip(x[i], att[i])], p["n1_g"], p["n1_b"]) for i in range(s)]
        ff = [loop_dense([max(v, 0.0) for v in loop_dense(row, p["ff1_w"], p["ff1_b"])], p["ff2_w"], p["ff2_b"])
              for row in x]
        x = [norm([a + b for a, b in zip(x[i], ff[i])], p["n2_g"], p["n2_b"]) for i in range(s)]
    return unit(x[0])


def fb(vecs, n):
    return [vecs[i] for i in range(n)]


@pytest.mark.parametrize("kind", ["top1", "avg", "weighted", "neural", "transformer"])
def test_reformulators_match_loops(spark, data, kind):
    vecs, qv, vectors, query_vecs, run = data
    ranked = run.join(vectors, "vec_id")  # rank order as given; vectors travel with the hits
    if kind == "top1":
        r = R.Reformulator("top1", 1)
    elif kind == "avg":
        r = R.Reformulator("avg", 5)
    elif kind == "weighted":
        r = R.Reformulator("weighted", 10, formula_layers({"_layer": (DIM, DIM)}))
    elif kind == "neural":
        r = R.Reformulator("neural", 5, R.formula_neural(DIM, 5, 7))
    else:
        r = R.Reformulator("transformer", 10, R.random_transformer(DIM, 2, 16, seed=5), heads=2, layers=2)
    got = {row["qid"]: row["embedding"] for row in R.reformulate(ranked, query_vecs, r).collect()}
    for q in qv:
        scores = [1.0 - k / 100 for k in range(12)]
        if kind == "top1":
            want = vecs[0]
        elif kind == "avg":
            want = [sum(c) / 5 for c in zip(*fb(vecs, 5))]
        elif kind == "weighted":
            m = [sum(s * v[i] for s, v in zip(scores[:10], fb(vecs, 10))) / sum(scores[:10]) for i in range(DIM)]
            t = r.tensors
            want = unit(loop_dense(m, t["_layer.weight"], t["_layer.bias"]))
        elif kind == "neural":
            cols = [qv[q]] + fb(vecs, 5)
            x = [cols[j][i] for i in range(DIM) for j in range(6)]  # component-major
            t = r.tensors
            h = [1 / (1 + math.exp(-v)) for v in loop_dense(x, t["input.weight"], t["input.bias"])]
            want = unit(loop_dense(h, t["output.weight"], t["output.bias"]))
        else:
            want = loop_transformer(r.tensors, 2, 2, qv[q], fb(vecs, 10))
        assert np.allclose(got[q], want, atol=1e-9), kind


def test_reformulate_edge_cases(spark, data):
    vecs, qv, vectors, query_vecs, run = data
    few = run.filter("rank <= 3").join(vectors, "vec_id")
    # fewer hits than topk: mean over what exists; neural zero-pads
    got = {r["qid"]: r["embedding"] for r in R.reformulate(few, query_vecs, R.Reformulator("avg", 5)).collect()}
    assert np.allclose(got["a"], [sum(c) / 3 for c in zip(*fb(vecs, 3))])
    neural = R.reformulate(few, query_vecs, R.Reformulator("neural", 5, R.formula_neural(DIM, 5, 7))).collect()
    assert len(neural) == 2
    # scores summing to about zero: no vector
    zero = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 2, -1.0)], "qid string, vec_id long, rank bigint, score double")
    w = R.Reformulator("weighted", 10, formula_layers({"_layer": (DIM, DIM)}))
    assert R.reformulate(zero.join(vectors, "vec_id"), query_vecs, w).first()["embedding"] is None
    with pytest.raises(ValueError):
        R.Reformulator.by_name("Unknown (x)")
    assert R.Reformulator.by_name("Transformer (top10_h6_l4)").layers == 4


def test_pipeline_validation():
    ranker = rerank.FeedForwardRanker.formula(DIM, 4)
    with pytest.raises(ValueError):
        P.Pipeline("bm25", ranker=ranker).validate()
    with pytest.raises(ValueError):
        P.Pipeline("knn", reformulator=R.Reformulator("top1", 1)).validate()
    with pytest.raises(ValueError):
        P.Pipeline("knn", k=1001).validate()
    P.Pipeline("knn", ranker, R.Reformulator("top1", 1), k=5).validate()


def test_position_vectors_agree(spark):
    import numpy as np

    from quarry.functions.vectors import position_matrix, positional_encoding

    rows = spark.range(12).select("id", positional_encoding("id", 9).alias("p")).orderBy("id").collect()
    assert np.allclose([r.p for r in rows], position_matrix(12, 9), atol=1e-12)
    assert np.allclose(position_matrix(3, 4)[2], [np.sin(2), np.cos(2), np.sin(2 / 100), np.cos(2 / 100)])
