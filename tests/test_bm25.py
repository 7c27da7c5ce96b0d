"""BM25 / RM3 against a plain-Python brute force on hand-made rows."""

import math

import numpy as np
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import bm25
from quarry.operators.index import build_index

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the dog barks; the fox runs"),
    (3, "a lazy afternoon with a lazy cat"),
    (4, "quick quick quick"),
    (5, ""),
    (6, "the the the"),
    (7, "Café crème brûlée, café!"),
    (8, "the quick brown fox jumps over the lazy dog"),  # exact duplicate of 1
]
QUERIES = [(100, "quick fox"), (101, "lazy lazy dog"), (102, "zebra"), (103, "the"), (104, "café")]


def toks(s):
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if t]


def brute_bm25(docs, qweights, k, k1=3.44, b=0.87):
    d = {i: toks(t) for i, t in docs}
    n = len(d)
    avgdl = sum(len(v) for v in d.values()) / n
    df = Counter(t for v in d.values() for t in set(v))
    out = {}
    for qid, w in qweights.items():
        scores = {}
        for did, tt in d.items():
            tf = Counter(tt)
            s, hit = 0.0, False
            for t, qw in w.items():
                if tf[t]:
                    hit = True
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += qw * idf * tf[t] / (tf[t] + k1 * (1 - b + b * len(tt) / avgdl))
            if hit:
                scores[did] = s
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out[qid] = ranked
    return out


def qtf(text):
    return dict(Counter(toks(text)))


def engine(spark, k, docs=DOCS, queries=QUERIES):
    idx = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "qid long, text string")
    rows = bm25.bm25_topk(idx, q, k=k).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    return out


def test_bm25_matches_brute_force(spark):
    got = engine(spark, 10)
    want = brute_bm25(DOCS, {q: qtf(t) for q, t in QUERIES}, 10)
    want = {q: v for q, v in want.items() if v}
    assert got.keys() == want.keys()  # query without matching term has no hits
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        for (_, a), (_, b) in zip(got[q], want[q]):
            assert abs(a - b) < 1e-9


def test_k_larger_than_hits_and_ties(spark):
    got = engine(spark, 1000)
    assert len(got[100]) == 4  # docs 1, 2, 4, 8 contain quick or fox
    # duplicate texts tie: lower id first
    ids = [d for d, _ in got[101]]
    assert ids.index(1) < ids.index(8)


@settings(max_examples=3, deadline=None)
@given(st.integers(min_value=1, max_value=5))
def test_topk_is_prefix(spark, k):
    a, b = engine(spark, k), engine(spark, k + 1)
    for q in a:
        assert a[q] == b[q][: len(a[q])]


def brute_rm3(docs, queries, fb_docs=10, fb_terms=10, a=0.5):
    d = {i: toks(t) for i, t in docs}
    n = len(d)
    df = Counter(t for v in d.values() for t in set(v))
    first = brute_bm25(docs, {q: qtf(t) for q, t in queries}, fb_docs)
    out = {}
    for qid, text in queries:
        w = Counter()
        for did, score in first[qid]:
            tf = Counter(t for t in d[did] if 2 <= len(t) <= 20 and df[t] <= 0.1 * n)
            kept = sorted(tf.items(), key=lambda x: (-x[1], x[0]))[:fb_terms]
            tot = sum(c for _, c in kept)
            for t, c in kept:
                w[t] += c / tot * score
        best = sorted(w.items(), key=lambda x: (-round(x[1], 9), x[0]))[:fb_terms]
        orig = qtf(text)
        so = sum(orig.values())
        if not best:
            out[qid] = {t: c / so for t, c in orig.items()}
            continue
        sw = sum(v for _, v in best)
        mixed = Counter({t: a * c / so for t, c in orig.items()})
        for t, v in best:
            mixed[t] += (1 - a) * v / sw
        out[qid] = dict(mixed)
    return out


def test_rm3_weights_match_brute_force(spark):
    # 30 documents so that some terms fall under the 10% document-frequency cut
    docs = [(i, f"common words here unique{i} shared{i % 3} rare{i % 7} " + ("extra " * (i % 4)))
            for i in range(30)]
    queries = [(1, "common unique1 shared1"), (2, "words rare3"), (3, "nothingmatches")]
    idx = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "qid long, text string")
    qw = bm25.query_terms(q)
    first = bm25.bm25_search(idx, qw, 10)
    got = {}
    for r in bm25.rm3_terms(idx, qw, first).collect():
        got.setdefault(r["qid"], {})[r["term"]] = r["qw"]
    want = brute_rm3(docs, queries)
    assert got.keys() == want.keys()
    for qid in want:
        assert got[qid].keys() == want[qid].keys()
        assert abs(sum(got[qid].values()) - 1.0) < 1e-9  # weights sum to 1
        for t in want[qid]:
            assert abs(got[qid][t] - want[qid][t]) < 1e-9
    # the expanded run uses those weights
    run = bm25.bm25_rm3_topk(idx, q, k=5).collect()
    assert {r["qid"] for r in run} == {1, 2}


def test_shuffle_paths_equal_broadcast_paths(spark):
    """Forcing every size check to fail (no broadcast) gives the same runs."""
    from quarry.operators import runs

    docs = [(i, f"common words here unique{i} shared{i % 3} rare{i % 7}") for i in range(30)]
    idx = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame([(1, "common unique1 shared1"), (2, "words rare3")], "qid long, text string")

    def rows(df):
        return sorted((r["qid"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())

    assert rows(bm25.bm25_topk(idx, q, k=5)) == rows(bm25.bm25_topk(idx, q, k=5, max_broadcast_rows=0))
    assert rows(bm25.bm25_rm3_topk(idx, q, k=5)) == rows(bm25.bm25_rm3_topk(idx, q, k=5, max_broadcast_rows=0))
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    run = bm25.bm25_topk(idx, q, k=5)
    a = sorted((r["doc_id"], r["raw"]) for r in runs.attach_raw(run, corpus).collect())
    b = sorted((r["doc_id"], r["raw"]) for r in runs.attach_raw(run, corpus, max_broadcast_rows=0).collect())
    assert a == b


def test_term_in_every_document_and_no_usable_feedback(spark):
    docs = [(i, "alpha beta gamma " + ("delta " * (i % 3))) for i in range(20)]
    queries = [(1, "alpha delta"), (2, "alpha")]
    got = engine(spark, 50, docs, queries)
    want = brute_bm25(docs, {q: qtf(t) for q, t in queries}, 50)
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        assert all(s > 0 for _, s in got[q])  # idf of a term in every document stays positive
    # every candidate term is in more than 10% of the documents: no expansion,
    # the query keeps its own normalised distribution
    idx = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "qid long, text string")
    qw = bm25.query_terms(q)
    w = {(r["qid"], r["term"]): r["qw"] for r in bm25.rm3_terms(idx, qw, bm25.bm25_search(idx, qw, 10)).collect()}
    assert w == {(1, "alpha"): 0.5, (1, "delta"): 0.5, (2, "alpha"): 1.0}


def test_stopwords_optional(spark):
    stop = ["the", "a", "over"]

    def drop(text):
        return " ".join(t for t in toks(text) if t not in stop)

    idx = build_index(spark.createDataFrame(DOCS, "doc_id long, text string"), stopwords=stop)
    q = spark.createDataFrame(QUERIES, "qid long, text string")
    rows = bm25.bm25_topk(idx, q, k=10, stopwords=stop).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    want = brute_bm25([(i, drop(t)) for i, t in DOCS], {qq: qtf(drop(t)) for qq, t in QUERIES}, 10)
    want = {qq: v for qq, v in want.items() if v}
    assert got.keys() == want.keys()  # query "the" now has no term left
    for qq in want:
        assert [d for d, _ in got[qq]] == [d for d, _ in want[qq]]
        assert np.allclose([s for _, s in got[qq]], [s for _, s in want[qq]], atol=1e-9)


def test_feedback_search_runs_once(spark, tmp_path):
    from quarry.operators import forward

    docs = spark.createDataFrame([(i, f"alpha beta w{i} w{i // 2}") for i in range(12)], "doc_id long, text string")
    index = build_index(docs)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    qw = bm25.query_terms(spark.createDataFrame([(1, "alpha w3"), (2, "beta w4")], "qid long, text string"))
    run = bm25.bm25_search(index, qw, k=3)
    store = forward.write_forward(index, str(tmp_path / "forward"), files=3)
    got = bm25.rm3_terms(index, qw, run.mapInArrow(counted, run.schema), forward=store)
    assert seen.value == 6
    want = bm25.rm3_terms(index, qw, run)
    assert {(r.qid, r.term, round(r.qw, 9)) for r in got.collect()} == {(r.qid, r.term, round(r.qw, 9)) for r in want.collect()}


@pytest.mark.parametrize("name", ["compare_runs", "order_by_other_run"])
def test_compared_runs_share_their_first_pass(spark, monkeypatch, name):
    import __spark_entry__ as E

    searches, search = [], bm25.bm25_search
    monkeypatch.setattr(bm25, "bm25_search", lambda *a, **k: searches.append(1) or search(*a, **k))
    assert E.queries()[name](spark, E.SF_SMOKE).count() > 0 and len(searches) == 2


def _postings_by_hand(rows, stop=()):
    import re

    out = Counter()
    for i, text in rows:
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w and w not in stop]
        out.update((i, len(words), w) for w in words)
    return out


def test_texts_are_counted_where_they_lie(spark):
    rows = [(i, " ".join(f"w{j % (i + 1)}" for j in range(3 * i)) + " .") for i in range(40)] + [(40, ""), (41, None), (42, " É one, One ")]
    for stop in (None, ["w1", "one"]):
        index = build_index(spark.createDataFrame(rows, "doc_id long, text string"), stopwords=stop)
        got = {(r.doc_id, r.dl, r.term): r.tf for r in index.postings.collect()}
        assert got == _postings_by_hand(rows, stop or ()) and index.postings.count() == len(got)
        assert index.postings.schema.simpleString() == "struct<doc_id:bigint,dl:int,term:string,tf:int>"
        # one row per document is kept, and no posting is grouped by its term
        assert [k.count() for k in index.kept] == [len(rows)]
        assert "Aggregate" not in index.kept[0]._jdf.queryExecution().optimizedPlan().toString()
        index.unpersist()


def test_repeated_ids_are_counted_together(spark):
    rows = [(1, "a b a"), (1, "b c a"), (1, "a"), (None, "a b"), (None, "a a"), (None, None), (2, "c c"), (3, "")]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.dl, r.term): r.tf for r in index.postings.collect()}
    assert got == _postings_by_hand(rows) and index.postings.count() == len(got)
    assert got[(1, 3, "a")] == 3 and got[(None, 2, "a")] == 3
    assert [k.count() for k in index.kept] == [2, len(got) - 1]


def test_few_terms_do_not_count_the_vocabulary(spark):
    index = build_index(spark.createDataFrame([(i, f"common w{i} x{i % 3}") for i in range(30)], "doc_id long, text string"))
    needed = spark.createDataFrame([("common",), ("x1",), ("w7",), ("none",)], "term string")
    few, all_terms = index.doc_freqs(needed, True), index.doc_freqs(needed, False)
    assert {r.term: r.df for r in few.collect()} == {r.term: r.df for r in all_terms.collect()} == {"common": 30, "x1": 10, "w7": 1}
    assert few._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 1
    assert "posexplode" in few._jdf.queryExecution().withCachedData().toString()  # the postings, not the kept vocabulary


def test_vocabulary_of_an_index_that_is_not_kept(spark):
    """Its terms come from the texts' distinct tokens; no step that makes an array is repeated by an inferred filter."""
    rows = [*DOCS, (3, "a lazy third"), (4, "quick quick quick"), (None, "no id"), (None, "no id either"), (9, None), (10, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stopwords in (None, ["the"]):
        for corpus in (docs, spark.createDataFrame(DOCS, "doc_id long, text string")):
            kept = build_index(corpus, stopwords=stopwords)
            unkept = build_index(corpus, stopwords=stopwords, persist=False)
            assert sorted(map(tuple, unkept.terms.collect())) == sorted(map(tuple, kept.terms.collect()))
            order = lambda p: sorted(map(str, p.select("doc_id", "dl", "term", "tf").collect()))
            assert order(unkept.postings) == order(kept.postings)
            kept.unpersist()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan(unkept.terms)
    assert plan(unkept.postings).count("sort_array") == 1 and "size(transform" not in plan(unkept.postings)
