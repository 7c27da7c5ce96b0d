"""The learnt encoder against NumPy's SVD, and what it finds."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.operators import lsa
from quarry.operators.index import build_index
from quarry.sources import passages, tables


def corpus(n=150):
    rng = random.Random(1)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]
    rows = []
    for i in range(n):
        words = rng.choices(topics[i % 6], k=rng.randint(5, 40)) + rng.choices(["common", "often", "usual"], k=5)
        rows.append((i, " ".join(words)))
    return rows + [(1000, ""), (1001, None), (1002, "alone")]


def matrix(rows, min_df=2):
    counts = {i: Counter((t or "").split()) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    vocabulary = sorted(w for w, n in df.items() if n >= min_df)
    at = {w: j for j, w in enumerate(vocabulary)}
    a, ids = np.zeros((len(rows), len(at))), [i for i, _ in rows]
    for r, i in enumerate(ids):
        for w, n in counts[i].items():
            if w in at:
                a[r, at[w]] = (1 + np.log(n)) * np.log((1 + len(rows)) / (1 + df[w]))
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return ids, a / np.where(size > 0, size, 1), at, df


@pytest.mark.parametrize("block_docs", [10_000, 40])
def test_equals_numpy(spark, monkeypatch, block_docs):
    monkeypatch.setattr(lsa, "SUM_ROWS", 100)
    rows = corpus()
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    fitted = lsa.fit(index, dim=6, oversample=20, rounds=6, block_docs=block_docs)
    ids, a, _, _ = matrix(rows)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(fitted.singular, s[:6], rtol=1e-6)
    got = {r.doc_id: np.array(r.embedding) for r in lsa.encode_documents(index, fitted, block_docs).collect()}
    assert set(got) == set(range(150))  # texts without known terms have no vector
    x = np.stack([got[i] for i in range(150)])
    # Signs, and bases of equal values, are free: inner products are not.
    want = u[:150, :6]
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-5)


def test_queries_lie_in_the_same_space(spark):
    rows = corpus()
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    fitted = lsa.fit(index, dim=8, rounds=4)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in (0, 1, 7)] + [(8, "unknown words"), (9, None)], "qid long, text string")
    got = {r.qid: np.array(r.embedding) for r in lsa.encode_queries(queries, fitted).collect()}
    docs = {r.doc_id: np.array(r.embedding) for r in lsa.encode_documents(index, fitted).collect()}
    assert set(got) == {0, 1, 7} and all(np.allclose(got[i], docs[i]) for i in got)


def test_same_vectors_every_time(spark):
    index = build_index(spark.createDataFrame(corpus(40), "doc_id long, text string"))
    a, b = (lsa.fit(index, dim=4, rounds=2).singular for _ in range(2))
    assert np.allclose(a, b)


def test_empty_corpus(spark):
    index = build_index(spark.createDataFrame([(1, "all different words here")], "doc_id long, text string"))
    fitted = lsa.fit(index, dim=4)
    assert len(fitted.singular) == 0 and lsa.encode_documents(index, fitted).count() == 0


def test_tables_grow_by_documents_not_by_terms(spark, monkeypatch):
    """No table of term vectors is stored or left: only documents' vectors and the matrix are."""
    from pathlib import Path

    from quarry.session import ensure_checkpoint_dir

    monkeypatch.setattr(lsa, "WHOLE_DOCS", 16)  # in parts, and in slices
    monkeypatch.setattr(lsa, "SLICE_BYTES", 1 << 16)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(3000)], k=400))) for i in range(60)]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    fitted = lsa.fit(index, dim=24, oversample=8)
    assert size() - before < 1_000_000  # one table of 3,000 terms' vectors of 32 numbers is 768,000
    _, a, _, _ = matrix(rows)
    assert np.allclose(fitted.singular[0], np.linalg.norm(a, 2), rtol=1e-4)  # three rounds
    n_terms = fitted.idf.count()
    got = {r.term: r.embedding for r in fitted.vectors.collect()}
    assert len(got) == n_terms and {len(v) for v in got.values()} == {24}
    assert np.allclose(sum(np.outer(v, v) for v in map(np.array, got.values())) * fitted.singular[:, None] * fitted.singular, np.eye(24), atol=1e-6)


def test_judged_queries_find_their_document(spark):
    """Of the passages that stand in some document, 0.9 find it among the first ten."""
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    run = E.queries()["lsa_text_topk"](spark, sf)
    assert run.columns == ["qid", "doc_id", "rank", "score"]
    judged = passages.passage_judgements(tables.corpus(spark, sf), tables.passage_queries(spark, sf))
    hit = judged.join(run.withColumnRenamed("doc_id", "did"), ["qid", "did"]).select("qid").distinct().count()
    assert hit >= 0.9 * judged.select("qid").distinct().count()
