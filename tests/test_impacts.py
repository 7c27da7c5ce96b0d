"""Pruned BM25 search and the forward store against the full scan."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, forward, impacts
from quarry.operators.index import build_index


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of very different lengths; frequent words everywhere, rare ones in a few."""
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        n = rng.choice([5, 12, 30, 90, 250])
        words = [f"common{min(int(rng.expovariate(0.5)), 9)}" for _ in range(n)]
        words += [f"rare{rng.randrange(150)}"] if rng.random() < 0.3 else []
        rows.append((i, " ".join(words)))
    rows += [(3000 + i, rows[i][1]) for i in range(200)] + [(4000, ""), (4001, None), (4002, "...")]  # ties, no terms
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def index(corpus):
    return build_index(corpus)


@pytest.fixture(scope="module")
def stored(index, tmp_path_factory):
    return impacts.write_impacts(index, str(tmp_path_factory.mktemp("impacts") / "a"), region_docs=16, shards=6)


QUERIES = [(1, "rare3 common0"), (2, "rare7 rare8 rare9"), (3, "common0 common1"), (4, "nothing here"), (5, "rare1 rare1 common9"),
           (6, "common0 common1 common2 common3 rare5"), (7, "")]


def queries(spark, rows=QUERIES):
    return spark.createDataFrame(rows, "qid int, text string")


def result(run):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in run.collect())


@pytest.mark.parametrize("k", [1, 5, 100, 5000])
def test_equals_the_full_scan(spark, index, stored, k):
    q = queries(spark)
    want = result(bm25.bm25_topk(index, q, k=k))
    assert result(impacts.pruned_topk(stored, q, k=k, first_regions=3)) == want


def test_joins_without_broadcast(spark, index, stored):
    q = queries(spark)
    got = impacts.pruned_topk(stored, q, k=7, first_regions=2, max_broadcast_rows=0)
    assert result(got) == result(bm25.bm25_topk(index, q, k=7))


def test_weighted_queries(spark, index, stored):
    w = spark.createDataFrame([(1, "rare3", 0.25), (1, "common0", 0.001), (2, "common1", 2.5)], "qid int, term string, qw double")
    assert result(impacts.pruned_search(stored, w, k=10)) == result(bm25.bm25_search(index, w, k=10))


def test_selective_queries_read_few_blocks(spark, stored):
    q = bm25.query_terms(queries(spark, [(i, f"rare{i} common0") for i in range(20)]))
    search = impacts.PrunedSearch(stored, q, k=3, first_regions=4)
    read = search.blocks_read().collect()
    assert len(read) == 20 and sum(r["read"] for r in read) < 0.3 * sum(r["blocks"] for r in read)
    assert search.run().count() == 60


def test_scans_are_narrowed(spark, stored):
    q = bm25.query_terms(queries(spark, [(1, "rare3 common0")]))
    search = impacts.PrunedSearch(stored, q, k=3, first_regions=2)
    plan = search.read(search.first)._jdf.queryExecution().toString()
    assert "In(term, [" in plan and "PartitionFilters: [shard" in plan.replace("PartitionFilters: [isnotnull(shard#", "PartitionFilters: [shard#")
    assert "In(term, [" in search.found._jdf.queryExecution().toString()


def test_stored_index_is_read_back(spark, index, stored, tmp_path):
    impacts.write_impacts(index, str(tmp_path / "b"), bm25.BM25Params(1.2, 0.75), region_docs=8, shards=2)
    again = impacts.read_impacts(spark, str(tmp_path / "b"))
    q = queries(spark)
    assert again.params == bm25.BM25Params(1.2, 0.75)
    assert result(impacts.pruned_topk(again, q, k=9)) == result(bm25.bm25_topk(index, q, k=9, params=bm25.BM25Params(1.2, 0.75)))
    with pytest.raises(ValueError):
        impacts.write_impacts(index, str(tmp_path / "c"), region_docs=10)


def test_empty_corpus(spark, tmp_path):
    index = build_index(spark.createDataFrame([], "doc_id long, text string"))
    stored = impacts.write_impacts(index, str(tmp_path / "e"))
    assert impacts.pruned_topk(stored, queries(spark), k=3).count() == 0


def test_feedback_through_the_forward_store(spark, index, tmp_path):
    store = forward.write_forward(index, str(tmp_path / "f"), files=8)
    q = queries(spark)
    qw = bm25.query_terms(q)
    first = bm25.bm25_search(index, qw, k=5)
    terms = lambda rows: sorted((r.qid, r.term, round(r.qw, 9)) for r in rows.collect())
    assert terms(bm25.rm3_terms(index, qw, first, forward=store)) == terms(bm25.rm3_terms(index, qw, first))


def test_feedback_reads_only_its_files(spark, index, tmp_path):
    store = forward.write_forward(index, str(tmp_path / "g"), files=8)
    wanted = spark.createDataFrame([(5,), (6,), (9999,)], "doc_id long")
    assert len(store.files) == 8 and len(store.files_for(wanted)) == 1
    rows = store.lookup(wanted)
    assert len(rows.inputFiles()) == 1 and {r.doc_id for r in rows.collect()} == {5, 6}
    by_doc = {r.doc_id: {t.term: t.tf for t in r.terms} for r in rows.collect()}
    want = index.postings.filter(F.col("doc_id") == 5).collect()
    assert by_doc[5] == {r.term: r.tf for r in want}


def test_every_shard_has_a_task_of_its_own(spark, tmp_path):
    import re

    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 37))) for i in range(400)]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    stored = impacts.write_impacts(index, str(tmp_path / "own"), region_docs=4, shards=8)
    files = [r[0] for r in stored.postings.selectExpr("_metadata.file_path").distinct().collect()]
    at = [tuple(map(int, re.search(r"shard=(\d+)/part-(\d+)", f).groups())) for f in files]
    assert len(at) > 1 and len({task for _, task in at}) == len(at)
    assert stored.blocks.groupBy("term", "shard", "region").count().filter("count > 1").count() == 0


def test_a_shard_passes_on_its_best_documents_only(spark, index, stored, monkeypatch):
    q = queries(spark)
    search = impacts.PrunedSearch(stored, bm25.query_terms(q), k=4, first_regions=2)
    per_query = search.scores(search.bounds).groupBy("qid").count().collect()
    assert per_query and max(r["count"] for r in per_query) <= 6 * 4  # shards x k, of over 1000 documents
    assert result(search.run()) == result(bm25.bm25_topk(index, q, k=4))
    # Few sums at once give the same rows.
    shard = search.bounds.filter("shard = 2").select("qid", "shard", "region").toArrow()
    files = [f for f in stored.postings.inputFiles() if "/shard=2/" in f]
    args = (shard, files, search.sent.value, stored.params, stored.avgdl, 4)
    want = impacts._shard_best(*args)
    monkeypatch.setattr(impacts, "SUMS", 20)
    got = impacts._shard_best(*args)
    assert len(want[0]) and got[:2] == want[:2] and got[2] == pytest.approx(want[2])


def test_blocks_are_counted_without_an_exchange(spark, stored, monkeypatch):
    """Each shard's blocks stand in one file, however few rows are read at once."""
    files = [r[0] for r in stored.blocks.select("shard", F.col("_metadata.file_path").alias("f")).distinct().groupBy("f").count().select("count").collect()]
    assert files and set(files) == {1}
    want = {(r.term, r.shard, r.region): (round(r.top, 12), r.n) for r in stored.postings.groupBy("term", "shard", "region").agg(
        F.max(impacts._factor(stored.params, stored.avgdl)).alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    rows = stored.blocks.collect()
    assert len(rows) == len(want) and {(r.term, r.shard, r.region): (round(r.top, 12), r.n) for r in rows} == want
    monkeypatch.setattr(impacts, "READ_ROWS", 3)
    shard, names = min(impacts._shard_files(stored.postings).items())
    batches = impacts._blocks_of(shard, names, stored.params, stored.avgdl)
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert {(t, s, g): (round(top, 12), n) for t, s, g, top, n in got} == {k: v for k, v in want.items() if k[1] == shard}
    assert len(got) == len({g[:3] for g in got})
