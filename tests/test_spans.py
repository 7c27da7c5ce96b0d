"""Shortest covering spans against trying every span."""

import random

from quarry.operators import spans


def brute(tokens, terms):
    have = set(tokens) & terms
    if not have:
        return 0, None, None
    best = min((j - i, i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if have <= set(tokens[i:j + 1]))
    return len(have), best[1], best[2]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    queries = [(q, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))) for q in range(8)] + [(8, ""), (9, "zz")]
    hits = [(q, d, " ".join(rng.choices("abcdefghijklmn", k=rng.randint(0, 25)))) for q in range(10) for d in range(25)]
    hits += [(0, 900, None), (0, 901, "..."), (1, 902, "A, b! C")]
    h = spark.createDataFrame([(*x, 1) for x in hits], "qid int, doc_id long, raw string, rank int")
    q = spark.createDataFrame(queries, "qid int, text string")
    for bound in (0, 10**6):
        got = {(r.qid, r.doc_id): r for r in spans.covering_spans(h, q, max_broadcast_rows=bound).collect()}
        assert len(got) == len(hits)
        for qid, doc, raw in hits:
            tokens = (raw or "").lower().replace(",", " ").replace("!", " ").replace(".", " ").split()
            n, start, stop = brute(tokens, set(dict(queries)[qid].split()))
            r = got[qid, doc]
            assert (r.n_terms, r.start, r.stop) == (n, start, stop)
            assert r.span == (" ".join(tokens[start:stop + 1]) if n else None) and r["rank"] == 1


def test_ties_take_the_first(spark):
    h = spark.createDataFrame([(1, 1, "x a b y b a z a b")], "qid int, doc_id long, raw string")
    q = spark.createDataFrame([(1, "a b c")], "qid int, text string")
    [r] = spans.covering_spans(h, q).collect()
    assert (r.n_terms, r.start, r.stop, r.span) == (2, 1, 2, "a b")


def test_no_hits(spark):
    h = spark.createDataFrame([], "qid int, doc_id long, raw string")
    assert spans.covering_spans(h, spark.createDataFrame([(1, "a")], "qid int, text string")).count() == 0
