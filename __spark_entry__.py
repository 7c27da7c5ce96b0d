"""

Every registered query reads the driver tables under ``sf_dir`` in full and
returns a DataFrame whose computed columns carry the same names as the oracle
SQL. Floats are rounded to 6 decimals for the comparison only; the library
operators themselves return full precision.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:  # loaded by file path: make the package importable
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import oracle
from quarry.functions import vectors as V
from quarry.operators import bm25, embed, knn, reformulate, rerank, runs
from quarry.plans import pipeline
from quarry.plans.sizing import cut_lineage
from quarry.operators.index import TextIndex, build_index
from quarry.session import ensure_checkpoint_dir
from quarry.sources import idmap, judgements, passages, tables, weights

try:  # the training-data operators are optional: nothing else here needs them
    import corpus_pipeline
    from quarry.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "quarry.llm"):
        raise
    corpus_pipeline = llm_queries = None

SF_SMOKE = "/root/testdata/sf0.001"
D = 6


#: The index of the table read last; its caches are released when another one is built.
_INDEX: dict[tuple[str, str, str], TextIndex] = {}


def _index(spark: SparkSession, sf_dir: str, corpus: str = "documents") -> TextIndex:
    key = (spark.sparkContext.applicationId, sf_dir, corpus)
    if key not in _INDEX:
        for (app, *_), old in list(_INDEX.items()):
            if app == key[0]:  # those of a stopped session are gone with it
                old.unpersist()
        _INDEX.clear()
        _INDEX[key] = build_index(tables.open_corpus(spark, sf_dir, corpus))
    return _INDEX[key]


def _run_out(run: DataFrame) -> DataFrame:
    return run.select("qid", "doc_id", "rank", F.round("score", D).alias("score"))


def q_bm25_topk(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    index = _index(spark, sf_dir)
    return _run_out(bm25.bm25_topk(index, tables.passage_queries(spark, sf_dir), k=k))


def q_rm3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    qw = bm25.query_terms(tables.passage_queries(spark, sf_dir))
    first = bm25.bm25_search(index, qw, k=bm25.RM3_FB_DOCS)
    w = bm25.rm3_terms(index, qw, first)
    return w.select("qid", "term", F.round("qw", D).alias("weight"))


def q_bm25_rm3_topk(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    index = _index(spark, sf_dir)
    return _run_out(bm25.bm25_rm3_topk(index, tables.passage_queries(spark, sf_dir), k=k))


def _bm25_run(spark, sf_dir, k, corpus="documents"):
    return bm25.bm25_topk(_index(spark, sf_dir, corpus), tables.passage_queries(spark, sf_dir), k=k)


def _rm3_run(spark, sf_dir, k, first=None):
    index = _index(spark, sf_dir)
    return bm25.bm25_rm3_topk(index, tables.passage_queries(spark, sf_dir), k=k, first=first)


def _both_runs(spark, sf_dir, k=10):
    """(BM25, BM25 + RM3): the BM25 run serves as the feedback pass too, which needs its first ``RM3_FB_DOCS`` hits."""
    first = cut_lineage(_bm25_run(spark, sf_dir, max(k, bm25.RM3_FB_DOCS)))
    return first.filter(F.col("rank") <= k), _rm3_run(spark, sf_dir, k, first)


def _passage_qrels(spark, sf_dir, corpus=None):
    corpus = corpus if corpus is not None else tables.corpus(spark, sf_dir)
    return passages.passage_judgements(corpus, tables.passage_queries(spark, sf_dir))


def _label_qrels(spark, sf_dir):
    return judgements.qrels_from_labels(
        tables.read_table(spark, sf_dir, "labels"), tables.read_table(spark, sf_dir, "documents")
    )


def q_passage_qrels(spark, sf_dir):
    return _passage_qrels(spark, sf_dir).select("qid", "did", "label")


def q_qrels_positive(spark, sf_dir):
    return judgements.positive_judgements(_label_qrels(spark, sf_dir))


def q_positives_by_query(spark, sf_dir):
    return judgements.positives_by_query(_label_qrels(spark, sf_dir)).select("qid", "pos", "did")


def q_judged_queries(spark, sf_dir):
    return judgements.judged_queries(tables.passage_queries(spark, sf_dir), _passage_qrels(spark, sf_dir))


def q_relevance_flag(spark, sf_dir):
    run = runs.relevance_flag(_bm25_run(spark, sf_dir, 10), _passage_qrels(spark, sf_dir))
    return run.select("qid", "doc_id", "rank", "relevant")


def q_attach_raw(spark, sf_dir):
    run = runs.attach_raw(_bm25_run(spark, sf_dir, 10), tables.corpus(spark, sf_dir))
    return run.select("qid", "doc_id", "rank", F.round("score", D).alias("score"), "raw")


def q_hit_counts(spark, sf_dir):
    return runs.hit_counts(_bm25_run(spark, sf_dir, 100)).select("qid", F.col("hits").cast("bigint"))


def q_doc_lookup(spark, sf_dir):
    ids = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    return runs.doc_lookup(ids, tables.corpus(spark, sf_dir)).select("doc_id", "raw")


def q_shorten_text(spark, sf_dir):
    from quarry.functions.text import shorten

    return tables.corpus(spark, sf_dir).select("doc_id", shorten("text").alias("short"))


def q_first_url(spark, sf_dir):
    from quarry.functions.text import first_url, shorten

    return tables.web_corpus(spark, sf_dir).select("doc_id", first_url(shorten("text")).alias("url"))


def q_linkify(spark, sf_dir):
    from quarry.functions.text import first_url, linkify, shorten

    short = tables.web_corpus(spark, sf_dir).select("doc_id", shorten("text").alias("t"))
    return short.select("doc_id", linkify("t", first_url("t")).alias("display"))


def q_present_hits(spark, sf_dir):
    web = tables.web_corpus(spark, sf_dir)
    run = runs.relevance_flag(_bm25_run(spark, sf_dir, 10, "pages"), _passage_qrels(spark, sf_dir, web))
    shown = runs.present_hits(runs.attach_raw(run, web))
    return shown.select("qid", "doc_id", "rank", F.round("score", D).alias("score"), "relevant",
                        "text", "url", "display")


def q_compare_runs(spark, sf_dir):
    cmp = runs.compare_runs(*_both_runs(spark, sf_dir))
    return cmp.select("qid", "doc_id", "rank_a", F.round("score_a", D).alias("score_a"),
                      "rank_b", F.round("score_b", D).alias("score_b"))


def q_order_by_other_run(spark, sf_dir):
    plain, expanded = _both_runs(spark, sf_dir)
    out = runs.order_by_other_run(expanded, plain)
    return out.select("qid", "doc_id", "rank_b", "rank_a", "rank")


def _self_queries(spark, sf_dir):
    return tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("qid"), "embedding")


def _knn_out(run: DataFrame) -> DataFrame:
    return run.select("qid", "vec_id", "rank", F.round("score", D).alias("score"))


def q_embed_text(spark, sf_dir):
    vecs = embed.embed(tables.corpus(spark, sf_dir), "text", embed.HashBagOfWords(64))
    return vecs.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter(
        F.col("value") != 0).select("doc_id", F.col("slot").cast("bigint"), F.round("value", D).alias("value"))


def q_knn_topk(spark, sf_dir, metric="ip"):
    return _knn_out(knn.knn_topk(_self_queries(spark, sf_dir), tables.vectors(spark, sf_dir), k=10, metric=metric))


def q_knn_topk_l2(spark, sf_dir):
    return q_knn_topk(spark, sf_dir, "l2")


def q_knn_topk_cosine(spark, sf_dir):
    return q_knn_topk(spark, sf_dir, "cosine")


def q_knn_topk_blocked(spark, sf_dir):
    run = knn.knn_topk(_self_queries(spark, sf_dir), tables.vectors(spark, sf_dir), k=10,
                       max_broadcast_queries=16, block_queries=128)
    return _knn_out(run)


def _text_knn(spark, sf_dir, k=10):
    qv = embed.encode_queries(tables.passage_queries(spark, sf_dir), embed.HashBagOfWords(64))
    return knn.knn_topk(qv, tables.vectors(spark, sf_dir), k=k)


def q_knn_text_topk(spark, sf_dir):
    return _knn_out(_text_knn(spark, sf_dir))


def q_lsa_text_topk(spark, sf_dir):
    """Passages against documents in the space that the encoder learnt from the corpus."""
    from quarry.operators import lsa

    index = _index(spark, sf_dir)
    fitted = lsa.fit(index)
    docs = lsa.encode_documents(index, fitted)
    qv = lsa.encode_queries(tables.passage_queries(spark, sf_dir), fitted)
    run = knn.knn_topk(qv, docs, k=10, metric="cosine", id_col="doc_id")
    return run.select("qid", "doc_id", "rank", F.round("score", D).alias("score"))


def _id_map(spark, sf_dir):
    return tables.corpus(spark, sf_dir).select("doc_id", F.col("doc_id").alias("vec_id"))


def q_id_translate(spark, sf_dir):
    run = runs.id_translate(_text_knn(spark, sf_dir), _id_map(spark, sf_dir))
    return run.select("qid", "vec_id", "doc_id", "rank")


def q_fetch_embeddings(spark, sf_dir):
    run = runs.fetch_embeddings(_text_knn(spark, sf_dir), tables.vectors(spark, sf_dir))
    return run.select("qid", "vec_id", "rank", F.size("embedding").cast("bigint").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), D).alias("emb_sum"))


def q_knn_score_from_distance(spark, sf_dir):
    vecs = tables.vectors(spark, sf_dir)
    run = knn.knn_topk(_self_queries(spark, sf_dir), vecs, k=10, metric="l2")
    q = vecs.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    pairs = runs.fetch_embeddings(run.select("qid", "vec_id"), vecs).join(q, "qid")
    pairs = runs.score_from_distance(pairs.withColumn("distance", V.distance("qv", "embedding", "l2")))
    return pairs.select("qid", "vec_id", F.round("distance", D).alias("distance"), F.round("score", D).alias("score"))


def q_l2_normalize(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select("vec_id", V.l2_normalize("embedding").alias("u"))
    return v.select("vec_id", F.posexplode("u").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint"), F.round("value", D).alias("value"))


def q_pair_similarity(spark, sf_dir):
    pairs = _passage_qrels(spark, sf_dir).select("qid", F.col("did").alias("doc_id"))
    sim = embed.pair_similarity(pairs, tables.passage_queries(spark, sf_dir), tables.corpus(spark, sf_dir),
                                embed.HashBagOfWords(64))
    return sim.select("qid", "doc_id", F.round("score", D).alias("score"))


def q_token_features(spark, sf_dir):
    tf = embed.token_features(tables.passage_queries(spark, sf_dir))
    z = tf.select("qid", F.col("window").cast("bigint").alias("window"),
                  F.posexplode(F.arrays_zip("input_ids", "segment_ids", "input_mask")).alias("position", "f"))
    return z.select("qid", "window", F.col("position").cast("bigint"),
                    F.col("f.input_ids").cast("bigint").alias("input_id"),
                    F.col("f.segment_ids").cast("bigint").alias("segment_id"),
                    F.col("f.input_mask").cast("bigint").alias("input_mask"))


RANKER = dict(dim=64, hidden=16, extra=24)


def _text_query_vecs(spark, sf_dir):
    return embed.encode_queries(tables.passage_queries(spark, sf_dir), embed.HashBagOfWords(64))


def q_rerank_ffn(spark, sf_dir):
    ranker = rerank.FeedForwardRanker.formula(**RANKER)
    rr = rerank.rerank_ffn(_text_knn(spark, sf_dir), _text_query_vecs(spark, sf_dir), tables.vectors(spark, sf_dir), ranker)
    return rr.select("qid", "vec_id", "rank", F.col("prev_rank").cast("bigint"), F.round("score", D).alias("score"))


def q_score_pairs(spark, sf_dir):
    from pyspark.sql import Window

    run = _text_knn(spark, sf_dir)
    triples = run.select("qid", F.col("vec_id").alias("pos_id"),
                         F.lead("vec_id").over(Window.partitionBy("qid").orderBy("rank")).alias("neg_id"))
    ranker = rerank.FeedForwardRanker.formula(**RANKER)
    sc = rerank.score_pairs(triples, _text_query_vecs(spark, sf_dir), tables.vectors(spark, sf_dir), ranker)
    return sc.select("qid", "pos_id", "neg_id", F.round("score_pos", D).alias("score_pos"),
                     F.round("score_neg", D).alias("score_neg"))


def _projection(spark, sf_dir, mode):
    from quarry.sources.weights import formula_bias, formula_matrix

    n_in = 128 if mode == "cat" else 64
    layer = rerank.ProjectionLayer(formula_matrix(8, n_in), formula_bias(8), mode)
    hits = runs.fetch_embeddings(_text_knn(spark, sf_dir), tables.vectors(spark, sf_dir))
    hits = hits.join(_text_query_vecs(spark, sf_dir).withColumnRenamed("embedding", "qv"), "qid")
    y = hits.select("qid", "vec_id", rerank.project(layer, spark, "qv", "embedding").alias("y"))
    return y.select("qid", "vec_id", F.posexplode("y").alias("pos", "value")).select(
        "qid", "vec_id", F.col("pos").cast("bigint"), F.round("value", D).alias("value"))


def q_projection_ip(spark, sf_dir):
    return _projection(spark, sf_dir, "ip")


def q_projection_cat(spark, sf_dir):
    return _projection(spark, sf_dir, "cat")


def q_projection_single(spark, sf_dir):
    return _projection(spark, sf_dir, "single")


def _reranked(spark, sf_dir):
    ranker = rerank.FeedForwardRanker.formula(**RANKER)
    return rerank.rerank_ffn(_text_knn(spark, sf_dir), _text_query_vecs(spark, sf_dir), tables.vectors(spark, sf_dir), ranker)


def _explode_vec(df: DataFrame, col: str = "embedding", keys=("qid",)) -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint"), F.round("value", D).alias("value"))


def _weighted_reformulator():
    from quarry.sources.weights import formula_layers

    return reformulate.Reformulator("weighted", 10, formula_layers({"_layer": (64, 64)}))


def _reformulated(spark, sf_dir, reformulator):
    return reformulate.reformulate(_reranked(spark, sf_dir), _text_query_vecs(spark, sf_dir), reformulator)


def q_reformulate_top1(spark, sf_dir):
    return _explode_vec(_reformulated(spark, sf_dir, reformulate.Reformulator("top1", 1)))


def q_reformulate_avg(spark, sf_dir):
    return _explode_vec(_reformulated(spark, sf_dir, reformulate.Reformulator("avg", 5)))


def q_reformulate_weighted(spark, sf_dir):
    return _explode_vec(_reformulated(spark, sf_dir, _weighted_reformulator()))


def q_reformulate_neural(spark, sf_dir):
    r = reformulate.Reformulator("neural", 5, reformulate.formula_neural(64, 5, 32))
    return _explode_vec(_reformulated(spark, sf_dir, r))


def q_reformulate_transformer(spark, sf_dir):
    r = reformulate.Reformulator("transformer", 10, reformulate.random_transformer(64, 1, 128), heads=4, layers=1)
    return _explode_vec(_reformulated(spark, sf_dir, r))


def q_reformulate_encoder(spark, sf_dir):
    """The encoder layer with weights that SQL can name."""
    r = reformulate.Reformulator("transformer", 5, reformulate.formula_transformer(64, 1, 32), heads=4, layers=1)
    return _explode_vec(_reformulated(spark, sf_dir, r))


def q_interleave(spark, sf_dir):
    fb = _reranked(spark, sf_dir).filter(F.col("rank") <= 5).groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "embedding"))), lambda h: h["embedding"]).alias("ds"))
    x = fb.join(_text_query_vecs(spark, sf_dir), "qid").select("qid", V.interleave("embedding", "ds").alias("x"))
    return _explode_vec(x, "x")


def q_positional_encoding(spark, sf_dir):
    pe = _reranked(spark, sf_dir).select("qid", "vec_id", V.positional_encoding("rank", 64).alias("p"))
    return _explode_vec(pe, "p", ("qid", "vec_id"))


def q_prf_pipeline(spark, sf_dir):
    p = pipeline.Pipeline("knn", rerank.FeedForwardRanker.formula(**RANKER), _weighted_reformulator(), k=10,
                          encoder=embed.HashBagOfWords(64))
    run = pipeline.run_pipeline(p, tables.passage_queries(spark, sf_dir), vectors=tables.vectors(spark, sf_dir))
    return run.select("qid", "vec_id", "rank", F.round("score", D).alias("score"), "reformulated")


def q_prf_pipeline_undefined(spark, sf_dir):
    """A scorer whose scores are all zero: no reformulation is defined, every query keeps its first pass."""
    ranker = rerank.FeedForwardRanker.formula(**RANKER)
    zero = {k: 0 * v if k.startswith("output") else v for k, v in ranker.tensors.items()}
    p = pipeline.Pipeline("knn", rerank.FeedForwardRanker(zero), _weighted_reformulator(), k=10, encoder=embed.HashBagOfWords(64))
    run = pipeline.run_pipeline(p, tables.passage_queries(spark, sf_dir), vectors=tables.vectors(spark, sf_dir))
    return run.select("qid", "vec_id", "rank", F.round("score", D).alias("score"), "reformulated")


def q_approx_knn_topk(spark, sf_dir):
    """Fitted cells, two thirds of which every query visits: these vectors have no clusters."""
    from quarry.operators import ivf

    index = ivf.build_ivf(tables.vectors(spark, sf_dir), n_cells=32).write(_shared(spark, "ivf"))
    return _knn_out(ivf.approx_knn_topk(_self_queries(spark, sf_dir), index, k=10, n_probe=22))


def q_pq_knn_topk(spark, sf_dir):
    """One byte per four components, the best 20 codes per neighbour ranked exactly."""
    from quarry.operators import pq

    vecs = tables.vectors(spark, sf_dir)
    index = pq.build_pq(vecs).write(_shared(spark, "pq"))
    return _knn_out(pq.pq_topk(_self_queries(spark, sf_dir), vecs, index, k=10))


def _bounded_knn(spark, sf_dir, metric):
    from quarry.operators import cells

    index = cells.build_cells(tables.vectors(spark, sf_dir), 32, metric).write(_shared(spark, "cells"))
    return _knn_out(cells.bounded_topk(_self_queries(spark, sf_dir), index, k=10))


def q_knn_bounded_topk(spark, sf_dir):
    return _bounded_knn(spark, sf_dir, "ip")


def q_knn_bounded_topk_l2(spark, sf_dir):
    return _bounded_knn(spark, sf_dir, "l2")


def q_knn_bounded_topk_cosine(spark, sf_dir):
    return _bounded_knn(spark, sf_dir, "cosine")


def q_bm25_pruned_topk(spark, sf_dir, k: int = 100):
    """The flagship search through the stored block index."""
    from quarry.operators import impacts

    index = _index(spark, sf_dir)
    stored = impacts.write_impacts(index, _shared(spark, "impacts"))
    return _run_out(impacts.pruned_topk(stored, tables.passage_queries(spark, sf_dir), k=k))


def q_term_stems(spark, sf_dir):
    from quarry.functions.stem import stems

    return stems(build_index(tables.corpus(spark, sf_dir), persist=False).terms)


def q_bm25_stemmed_topk(spark, sf_dir, k: int = 100):
    """The flagship search over stems."""
    from quarry.operators import stemmed

    index = _index(spark, sf_dir)
    by_stem = stemmed.stem_index(index)
    qw = stemmed.stem_queries(bm25.query_terms(tables.passage_queries(spark, sf_dir)))
    return _run_out(bm25.bm25_search(by_stem, qw, k=k))


def q_rm3_terms_forward(spark, sf_dir):
    """Feedback through the forward store."""
    from quarry.operators import forward

    index = _index(spark, sf_dir)
    store = forward.write_forward(index, _shared(spark, "forward"))
    qw = bm25.query_terms(tables.passage_queries(spark, sf_dir))
    w = bm25.rm3_terms(index, qw, bm25.bm25_search(index, qw, k=bm25.RM3_FB_DOCS), forward=store)
    return w.select("qid", "term", F.round("qw", D).alias("weight"))


def q_doc_lookup_keyed(spark, sf_dir):
    """Documents by id from files of disjoint key ranges."""
    from quarry.sources.keyed import KeyedStore

    store = KeyedStore.write(tables.corpus(spark, sf_dir), _shared(spark, "by-id"), "doc_id")
    ids = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    return runs.doc_lookup(ids, store).select("doc_id", "raw")


def q_snippets(spark, sf_dir):
    from quarry.operators import snippets

    hits = runs.attach_raw(_bm25_run(spark, sf_dir, 10), tables.corpus(spark, sf_dir))
    out = snippets.best_sentences(hits, tables.passage_queries(spark, sf_dir))
    return out.select("qid", "doc_id", "snippet")


def q_covering_spans(spark, sf_dir):
    from quarry.operators import spans

    hits = runs.attach_raw(_bm25_run(spark, sf_dir, 10), tables.corpus(spark, sf_dir))
    out = spans.covering_spans(hits, tables.passage_queries(spark, sf_dir))
    return out.select("qid", "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_terms", "start", "stop")], "span")


def q_stream_bm25_topk(spark, sf_dir, k: int = 100):
    from quarry.streaming import query_stream

    index = _index(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = query_stream.query_stream(spark, sf_dir, glob="benchmark.parquet")
    q = query_stream.serve(stream, lambda batch: bm25.bm25_topk(index, batch, k=k), f"{base}/sink", f"{base}/ckpt")
    q.awaitTermination()
    out = query_stream.read_sink(spark, f"{base}/sink")
    return _run_out(out)


def q_compare_pipelines(spark, sf_dir):
    a = pipeline.Pipeline("bm25", k=10, rm3=False, name="bm25")
    b = pipeline.Pipeline("knn", rerank.FeedForwardRanker.formula(**RANKER), k=10, encoder=embed.HashBagOfWords(64))
    cmp = pipeline.compare_pipelines(a, b, tables.passage_queries(spark, sf_dir),
                                     index=_index(spark, sf_dir),
                                     vectors=tables.vectors(spark, sf_dir), id_map=_id_map(spark, sf_dir))
    return cmp.select("qid", "doc_id", "rank_a", F.round("score_a", D).alias("score_a"),
                      "rank_b", F.round("score_b", D).alias("score_b"))


def _shared(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_qrels_file(spark, sf_dir):
    """Judgements written as text lines and read back."""
    path = _shared(spark, "qrels")
    rows = _label_qrels(spark, sf_dir)
    rows.select(F.concat_ws(" ", "qid", F.lit("0"), F.col("did").cast("string"), F.col("label").cast("string"))).write.text(path)
    return judgements.read_qrels(spark, path).select("qid", F.col("did").cast("bigint").alias("did"), "label")


def q_queries_file(spark, sf_dir):
    """Queries written as tab-separated lines (blanks for line breaks) and read back."""
    path = _shared(spark, "queries")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    tables.passage_queries(spark, sf_dir).select(F.concat(F.col("qid").cast("string"), F.lit("\t"), flat)).write.text(path)
    return judgements.first_query_text(judgements.read_queries(spark, path)).select(F.col("qid").cast("bigint").alias("qid"), "text")


def q_id_map(spark, sf_dir):
    path = _shared(spark, "id-map")
    rows = _id_map(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "vec_id")
    rows.write.json(path)
    return idmap.read_id_map_lines(spark, path).select("doc_id", "vec_id")


def q_id_map_object(spark, sf_dir):
    """The map as JSON objects, read back in splits."""
    path = _shared(spark, "id-map-object")
    rows = _id_map(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "vec_id")
    idmap.write_id_map(rows, path)
    return idmap.read_id_map(spark, path)


def q_weights_rerank(spark, sf_dir):
    """The scorer's tensors from a stored weights table."""
    path = _shared(spark, "weights")
    weights.weights_frame(spark, "ffn", rerank.FeedForwardRanker.formula(**RANKER).tensors).write.parquet(path)
    ranker = rerank.FeedForwardRanker.from_table(weights.read_weights(spark, path), "ffn")
    rr = rerank.rerank_ffn(_text_knn(spark, sf_dir), _text_query_vecs(spark, sf_dir), tables.vectors(spark, sf_dir), ranker)
    return rr.select("qid", "vec_id", "rank", F.col("prev_rank").cast("bigint"), F.round("score", 4).alias("score"))


def q_document_vectors(spark, sf_dir):
    """Stored vector of every document id that has one."""
    found = runs.document_vectors(tables.corpus(spark, sf_dir).select("doc_id"), _id_map(spark, sf_dir), tables.vectors(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("doc_id", "vec_id", F.round(total, D).alias("emb_sum"))


def q_whole_text(spark, sf_dir):
    """Hits with their whole text, not shortened."""
    shown = runs.present_hits(runs.attach_raw(_bm25_run(spark, sf_dir, 10), tables.corpus(spark, sf_dir)), shortened=False)
    return shown.select("qid", "doc_id", "rank", F.md5("text").alias("text_md5"))


def q_term_stats(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", F.col("df").cast("bigint"))


def q_doc_stats(spark, sf_dir):
    return _index(spark, sf_dir).doc_lengths.select("doc_id", F.col("dl").cast("bigint"))


def q_collection_stats(spark, sf_dir):
    st = _index(spark, sf_dir).collection_stats()
    return st.select(F.col("n_docs").cast("bigint"), F.round("avgdl", D).alias("avgdl"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: BM25 top-100 of every benchmark passage over the documents."""
    return q_bm25_topk(spark, SF_SMOKE)


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm_queries is None:
        return {}
    return {**llm_queries.queries(), "pipeline": corpus_pipeline.run}


def _llm_sql() -> dict[str, str]:
    if llm_queries is None:
        return {}
    sql = corpus_pipeline.ORACLE_SQL
    return {**llm_queries.oracle_sql(), **({"pipeline": sql} if sql else {})}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **_llm_queries(),
        "bm25_topk": q_bm25_topk,
        "rm3_terms": q_rm3_terms,
        "bm25_rm3_topk": q_bm25_rm3_topk,
        "passage_qrels": q_passage_qrels,
        "qrels_positive": q_qrels_positive,
        "positives_by_query": q_positives_by_query,
        "judged_queries": q_judged_queries,
        "relevance_flag": q_relevance_flag,
        "attach_raw": q_attach_raw,
        "hit_counts": q_hit_counts,
        "doc_lookup": q_doc_lookup,
        "shorten_text": q_shorten_text,
        "first_url": q_first_url,
        "linkify": q_linkify,
        "present_hits": q_present_hits,
        "compare_runs": q_compare_runs,
        "order_by_other_run": q_order_by_other_run,
        "embed_text": q_embed_text,
        "knn_topk": q_knn_topk,
        "knn_topk_l2": q_knn_topk_l2,
        "knn_topk_cosine": q_knn_topk_cosine,
        "knn_topk_blocked": q_knn_topk_blocked,
        "knn_text_topk": q_knn_text_topk,
        "lsa_text_topk": q_lsa_text_topk,
        "id_translate": q_id_translate,
        "fetch_embeddings": q_fetch_embeddings,
        "knn_score_from_distance": q_knn_score_from_distance,
        "l2_normalize": q_l2_normalize,
        "pair_similarity": q_pair_similarity,
        "token_features": q_token_features,
        "rerank_ffn": q_rerank_ffn,
        "score_pairs": q_score_pairs,
        "projection_ip": q_projection_ip,
        "projection_cat": q_projection_cat,
        "projection_single": q_projection_single,
        "reformulate_top1": q_reformulate_top1,
        "reformulate_avg": q_reformulate_avg,
        "reformulate_weighted": q_reformulate_weighted,
        "reformulate_neural": q_reformulate_neural,
        "reformulate_transformer": q_reformulate_transformer,
        "reformulate_encoder": q_reformulate_encoder,
        "interleave": q_interleave,
        "positional_encoding": q_positional_encoding,
        "prf_pipeline": q_prf_pipeline,
        "prf_pipeline_undefined": q_prf_pipeline_undefined,
        "qrels_file": q_qrels_file,
        "queries_file": q_queries_file,
        "id_map": q_id_map,
        "id_map_object": q_id_map_object,
        "weights_rerank": q_weights_rerank,
        "document_vectors": q_document_vectors,
        "whole_text": q_whole_text,
        "approx_knn_topk": q_approx_knn_topk,
        "pq_knn_topk": q_pq_knn_topk,
        "knn_bounded_topk": q_knn_bounded_topk,
        "knn_bounded_topk_l2": q_knn_bounded_topk_l2,
        "knn_bounded_topk_cosine": q_knn_bounded_topk_cosine,
        "bm25_pruned_topk": q_bm25_pruned_topk,
        "rm3_terms_forward": q_rm3_terms_forward,
        "term_stems": q_term_stems,
        "bm25_stemmed_topk": q_bm25_stemmed_topk,
        "doc_lookup_keyed": q_doc_lookup_keyed,
        "snippets": q_snippets,
        "covering_spans": q_covering_spans,
        "stream_bm25_topk": q_stream_bm25_topk,
        "compare_pipelines": q_compare_pipelines,
        "term_stats": q_term_stats,
        "doc_stats": q_doc_stats,
        "collection_stats": q_collection_stats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_llm_sql(),
        "bm25_topk": oracle.bm25_topk(),
        "rm3_terms": oracle.rm3_terms(),
        "bm25_rm3_topk": oracle.bm25_rm3_topk(),
        "passage_qrels": oracle.passage_qrels(),
        "qrels_positive": oracle.qrels_positive(),
        "positives_by_query": oracle.positives_by_query(),
        "judged_queries": oracle.judged_queries(),
        "relevance_flag": oracle.relevance_flag(),
        "attach_raw": oracle.attach_raw(),
        "hit_counts": oracle.hit_counts(),
        "doc_lookup": oracle.doc_lookup(),
        "shorten_text": oracle.shorten_text(),
        "first_url": oracle.first_url(),
        "linkify": oracle.linkify(),
        "present_hits": oracle.present_hits(),
        "compare_runs": oracle.compare_runs(),
        "order_by_other_run": oracle.order_by_other_run(),
        "embed_text": oracle.embed_text(),
        "knn_topk": oracle.knn_self("ip"),
        "knn_topk_l2": oracle.knn_self("l2"),
        "knn_topk_cosine": oracle.knn_self("cosine"),
        "knn_topk_blocked": oracle.knn_self("ip"),
        "knn_text_topk": oracle.knn_text_topk(),
        "id_translate": oracle.id_translate(),
        "fetch_embeddings": oracle.fetch_embeddings(),
        "knn_score_from_distance": oracle.knn_score_from_distance(),
        "l2_normalize": oracle.l2_normalize(),
        "pair_similarity": oracle.pair_similarity(),
        "token_features": oracle.token_features(),
        "rerank_ffn": oracle.rerank_ffn(),
        "score_pairs": oracle.score_pairs(),
        "projection_ip": oracle.projection("ip"),
        "projection_cat": oracle.projection("cat"),
        "projection_single": oracle.projection("single"),
        "reformulate_top1": oracle.reformulate_top1(),
        "reformulate_avg": oracle.reformulate_avg(),
        "reformulate_weighted": oracle.reformulate_weighted(),
        "reformulate_neural": oracle.reformulate_neural(),
        "reformulate_encoder": oracle.reformulate_encoder(),
        "interleave": oracle.interleave(),
        "positional_encoding": oracle.positional_encoding(),
        "prf_pipeline": oracle.prf_pipeline(),
        "prf_pipeline_undefined": oracle.prf_pipeline_undefined(),
        "pq_knn_topk": oracle.knn_self("ip"),
        "knn_bounded_topk": oracle.knn_self("ip"),
        "knn_bounded_topk_l2": oracle.knn_self("l2"),
        "knn_bounded_topk_cosine": oracle.knn_self("cosine"),
        "bm25_pruned_topk": oracle.bm25_topk(),
        "rm3_terms_forward": oracle.rm3_terms(),
        "term_stems": oracle.term_stems(),
        "bm25_stemmed_topk": oracle.bm25_stemmed_topk(),
        "doc_lookup_keyed": oracle.doc_lookup(),
        "qrels_file": oracle.qrels_file(),
        "queries_file": oracle.queries_file(),
        "id_map": oracle.id_map(),
        "id_map_object": oracle.id_map(),
        "weights_rerank": oracle.weights_rerank(),
        "document_vectors": oracle.document_vectors(),
        "whole_text": oracle.whole_text(),
        "snippets": oracle.snippets(),
        "covering_spans": oracle.covering_spans(),
        "stream_bm25_topk": oracle.bm25_topk(),
        "compare_pipelines": oracle.compare_pipelines(),
        "term_stats": oracle.term_stats(),
        "doc_stats": oracle.doc_stats(),
        "collection_stats": oracle.collection_stats(),
    }
