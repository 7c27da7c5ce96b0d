import random

import numpy as np
import pytest

from quarry.llm import decontaminate as D
from quarry.llm import forest


@pytest.fixture()
def items(spark, prose):
    rows = [(i, prose(15 + 5 * (i % 9))) for i in range(40)] + [(50, None), (51, ""), (52, "Single sentence here without an end"), (53, "!!!")]
    return spark.createDataFrame([(*r, "x", 2.0) for r in rows], "item_id long, text string, doc_id string, score double")


def test_retrieval_equals_scoring_everything(items, prose):
    texts = [r.text for r in items.orderBy("item_id").collect() if r.text and D.words_of(r.text)]
    count = {}
    for t in texts:
        for w in set(D.words_of(t)):
            count[w] = count.get(w, 0) + 1
    mean = np.mean([len(D.words_of(t)) for t in texts])
    index = D.build_index(list(range(len(texts))), texts, count, len(texts), mean, per_block=4)
    docs = [prose(200) + texts[3] + " " + prose(50), texts[7], "", prose(30) + texts[8][:60], "nothing of it"] + [prose(300) for _ in range(10)]
    stride, want = index.longest, {}
    for d, t in enumerate(docs):
        ws = D.words_of(t)
        for start in range(0, len(ws), stride):
            there = set(ws[start:start + 2 * stride])
            for i, item in enumerate(texts):
                iw = D.words_of(item)
                part = lambda w: (np.log(1 + (len(texts) - count[w] + 0.5) / (count[w] + 0.5)) * iw.count(w) * (D.K1 + 1)
                                  / (iw.count(w) + D.K1 * (1 - D.B + D.B * len(iw) / mean)))
                share = sum(part(w) for w in set(iw) & there) / sum(part(w) for w in set(iw))
                if share >= 0.4:
                    want[d, start, i] = share
    got = {(a, b, c): s for a, b, c, s in zip(*(x.tolist() for x in D.retrieve(index, docs, 0.4)))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 20


def test_leaks_are_found_and_clean_documents_left(spark, documents, items, prose):
    text = {r.item_id: r.text for r in items.collect()}
    rows = [(i, prose(150)) for i in range(30)]
    rows += [(100 + i, prose(90) + " " + text[i].upper() + " " + prose(40)) for i in range(12)]
    rows += [(200, text[5].split(".")[0]), (201, " ".join(random.Random(1).sample(text[6].split(), len(text[6].split())))), (202, None), (203, ""),
             (104, rows[34][1]), (204, " ".join(["stone river"] * 30_000) + " " + text[11])]
    docs = documents(rows)
    for shard_bytes in (1 << 20, 2000):
        got = D.contaminated(docs, items, shard_bytes=shard_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i in range(12)} | {(204, 11)}
        assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 for r in got) and len([r for r in got if r.doc_id == 104]) == 2
    clean = D.clean(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {*range(30), 200, 201, 202, 203}
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.clean(docs, items.limit(0)).count() == len(rows)


def test_a_long_item_does_not_stretch_the_others(spark, documents, items, prose):
    text = {r.item_id: r.text for r in items.collect()}
    long = prose(4000)
    more = items.unionByName(spark.createDataFrame([(90, long, "x", 2.0)], items.schema))
    made = list(D.indexes(more))
    assert [len(x.ids) for x in made] == [41, 1] and made[0].longest <= 60 and made[1].longest >= 4000
    rows = [(1, prose(200) + " " + text[4] + " " + prose(100)), (2, prose(20) + " " + long + " " + prose(30)), (3, prose(3000))]
    got = D.contaminated(documents(rows), more).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 4), (2, 90)}
    assert {r.doc_id for r in D.clean(documents(rows), more).collect()} == {3}


def test_question_and_answer():
    assert D.question_and_answer("One two. Three four! Five.") == (["one", "two", "three", "four"], ["five"])
    assert D.question_and_answer("a b c d e f g h") == (["a", "b", "c", "d", "e", "f"], ["g", "h"])
    assert D.question_and_answer("...") == ([], [])


def brute(rows, queries, k=20):
    out = {}
    for q in queries:
        for v in [x for i, x in rows if i == q]:
            best = {}
            for i, x in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(v, x)))
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_forest_finds_the_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype("f4").astype(float) * rng.uniform(0.5, 2, (3000, 1))
    x[1000:1900] = x[1000]  # a third of the rows are one vector
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = forest.nearest(df, df.filter("vec_id % 100 = 0"), leaf_rows=200, chunk_rows=128).collect()
    want = brute([(i, v) for i, v, _ in rows], range(0, 3000, 100))
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = sum(len({v for v, _ in mine[q].values()} & {v for v, _ in best}) for q, best in want.items())
    assert hits / (20 * len(want)) >= 0.9
    for q, ranked in mine.items():
        scores = [ranked[i + 1] for i in range(20)]
        assert scores == sorted(scores, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(np.dot(x[q], x[v])), abs=1e-9) for v, s in scores)
    same = [v for v, _ in mine[1000].values()]
    assert same == sorted(same) or x[1000] @ x[1000] < max(s for _, s in mine[1000].values())


@pytest.mark.parametrize("n", [400, 5000])
def test_registered_query_finds_the_nearest(spark, tmp_path, n):
    """Trees are used at every size; recall of the registered query against all inner products."""
    from quarry.llm import queries

    x = np.random.default_rng(n).normal(size=(n, 64)).astype("f4").astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    assert forest.fit(x, float((x * x).sum(axis=1).max()), n).depth == 3
    got = queries.queries()["op10_forest"](spark, str(tmp_path)).collect()
    want = brute(list(enumerate(x)), range(0, n, 20))
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert len(got) == 20 * len(want) and hits / len(got) >= 0.9


def test_many_queries_are_dealt_over_tasks(spark):
    x = np.random.default_rng(4).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = forest.nearest(df, df, k=5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, forest.nearest(df, df, k=5, query_rows=50).collect()))


def test_vectors_that_take_no_part(spark):
    ok = [(i, [float(i % 7 + 1), 1.0, -2.0]) for i in range(30)]
    bad = [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 2.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]),
           (140, []), (160, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 1.0, -2.0])]
    df = spark.createDataFrame(ok + bad, "vec_id long, embedding array<double>")
    got = forest.nearest(df, df.filter("vec_id % 20 = 0"), k=40).collect()
    assert {r.query_id for r in got} == {0, 20} and {r.vec_id for r in got} == set(range(30))
    want = brute(ok, [20], 40)[20]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 20] == want
    assert forest.nearest(df.limit(0), df).count() == 0


def test_doubled_rows_count_once(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(z) for z in rng.normal(size=6)]) for i in range(300)]
    ids, x = np.array([i for i, _ in rows] * 2), np.array([v for _, v in rows] * 2)
    q = x[:9]
    for i, (v, s) in enumerate(forest.best_of(ids, x, ids[:9], q, 20)):
        assert len(set(v.tolist())) == len(v) == 20 and v.tolist() == [j for j in np.argsort(-(x[:300] @ q[i]), kind="stable") if j != i][:20]
    # an id with many rows near everything, among them exact repeats
    rows = rows * 2 + [(900, [4.0 + 0.01 * j] * 6) for j in range(40)] * 2
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for chunk_rows in (forest.CHUNK_ROWS, 50):
        got = {}
        for r in forest.nearest(vectors, vectors.filter("vec_id < 9"), leaf_rows=1000, chunk_rows=chunk_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = brute(rows, range(9))
        assert {i: len(v) for i, v in got.items()} == dict.fromkeys(range(9), 20)
        assert got == {i: [v for v, _ in best] for i, best in want.items()}


def test_rows_of_one_id_are_dealt_out():
    x = np.random.default_rng(12).normal(size=(8000, 6)).astype("f4").astype("f8")
    dealt = np.bincount((forest.spread(np.full(8000, 7), x) % np.uint64(8)).astype(int), minlength=8)
    assert dealt.min() > 800 and dealt.max() < 1200
