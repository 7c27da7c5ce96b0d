"""BM25 search and RM3 query expansion over a ``TextIndex``.

Scoring (per query term t matched in document d):

    idf(t)   = ln(1 + (N - df + 0.5) / (df + 0.5))
    part     = qw(t) * idf(t) * tf / (tf + k1 * (1 - b + b * dl / avgdl))
    score    = sum of parts over the query terms

``qw`` is the query term frequency for plain BM25 and the RM3 weight for the
expanded pass. Only documents with at least one matching term are hits.

Plan: the query-term side is small, so (after a row-count check) it is
broadcast into the postings scan; the postings never shuffle. Because the
postings are partitioned by ``doc_id`` the ``(qid, doc_id)`` sum also runs
without an exchange, and the top-k window cuts to ``k`` rows per query and
partition before the only shuffle (on ``qid``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.index import TextIndex
from quarry.operators.ranking import RANK_DECIMALS, top_k
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most
from quarry.sources.keyed import KeyedStore

# Fixed values of the searcher configuration: BM25 (k1, b) and RM3
# (feedback terms, feedback documents, original query weight).
BM25_K1 = 3.44
BM25_B = 0.87
RM3_FB_TERMS = 10
RM3_FB_DOCS = 10
RM3_ORIGINAL_WEIGHT = 0.5
# Candidate expansion terms: length 2..20 characters, in at most 10% of documents.
RM3_MIN_TERM_LEN = 2
RM3_MAX_TERM_LEN = 20
RM3_MAX_DF_RATIO = 0.1


@dataclass(frozen=True)
class BM25Params:
    k1: float = BM25_K1
    b: float = BM25_B


@dataclass(frozen=True)
class RM3Params:
    fb_terms: int = RM3_FB_TERMS
    fb_docs: int = RM3_FB_DOCS
    original_query_weight: float = RM3_ORIGINAL_WEIGHT
    min_term_len: int = RM3_MIN_TERM_LEN
    max_term_len: int = RM3_MAX_TERM_LEN
    max_df_ratio: float = RM3_MAX_DF_RATIO


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def query_terms(queries: DataFrame, qid_col: str = "qid", text_col: str = "text",
                stopwords: list[str] | None = None) -> DataFrame:
    """``(qid, term, qw)`` with ``qw`` = term frequency in the query text
    (``stopwords``, if given, are dropped as in the index)."""
    terms = queries.select(F.col(qid_col).alias("qid"), F.explode(tokens(text_col)).alias("term"))
    if stopwords:
        terms = terms.filter(~F.col("term").isin(sorted(set(stopwords))))
    return terms.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("qw"))


def bm25_scores(index: TextIndex, qweights: DataFrame, params: BM25Params = BM25Params(),
                max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """All ``(qid, doc_id, score)`` for weighted query terms ``(qid, term, qw)``."""
    n, avgdl = index.stats()
    small = row_count_at_most(qweights, max_broadcast_rows)
    index = index.of_terms(qweights.select("term").distinct(), small)
    qw = _hint(qweights.select("qid", "term", F.col("qw").cast("double").alias("qw")), small)
    dfs = index.doc_freqs(qweights.select("term").distinct(), small)
    weighted = qw.join(_hint(dfs, small), "term").select(
        "qid", "term",
        (F.col("qw") * F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("wt"),
    )
    norm = F.lit(params.k1) * (F.lit(1.0 - params.b) + F.lit(params.b) * F.col("dl") / F.lit(avgdl))
    part = F.col("wt") * F.col("tf") / (F.col("tf") + norm)
    return (
        index.postings.join(_hint(weighted, small), "term")
        .select("qid", "doc_id", part.alias("part"))
        .groupBy("qid", "doc_id")
        .agg(F.sum("part").alias("score"))
    )


def bm25_search(index: TextIndex, qweights: DataFrame, k: int = 100, params: BM25Params = BM25Params(),
                max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Top-k run ``(qid, doc_id, score, rank)`` for weighted query terms."""
    return top_k(bm25_scores(index, qweights, params, max_broadcast_rows), k)


def bm25_topk(index: TextIndex, queries: DataFrame, k: int = 100, params: BM25Params = BM25Params(),
              qid_col: str = "qid", text_col: str = "text",
              max_broadcast_rows: int = BROADCAST_MAX_ROWS, stopwords: list[str] | None = None) -> DataFrame:
    """B1: BM25 top-k for every query of ``queries(qid, text)``."""
    return bm25_search(index, query_terms(queries, qid_col, text_col, stopwords), k, params, max_broadcast_rows)


def rm3_terms(index: TextIndex, qweights: DataFrame, feedback: DataFrame, rm3: RM3Params = RM3Params(),
              max_broadcast_rows: int = BROADCAST_MAX_ROWS, forward: KeyedStore | None = None) -> DataFrame:
    """Expanded query weights ``(qid, term, qw)``.

    ``qweights(qid, term, qw)`` is the original query, ``feedback(qid, doc_id,
    score, rank)`` the first-pass run. Per feedback document the ``fb_terms``
    most frequent candidate terms get their share of that document's kept term
    counts; a term's weight is the score-weighted sum of its shares; the
    ``fb_terms`` best (ties: term ascending) are normalised to sum 1 and mixed
    with the normalised original query as
    ``w = a * orig + (1 - a) * expansion``. A query without any expansion term
    keeps its normalised original distribution. The result is checkpointed.
    With a ``forward`` store (``forward.write_forward``) only the feedback documents'
    term vectors are read; without one the postings are scanned for them.
    """
    n, _ = index.stats()
    # Queries x feedback documents, used for the documents' keys and for the shares: the
    # search that found them runs once.
    fb = cut_lineage(feedback.filter(F.col("rank") <= rm3.fb_docs).select("qid", "doc_id", "score"))
    fb_small = row_count_at_most(fb, max_broadcast_rows)
    # A document's candidate terms do not depend on the query that retrieved
    # it: choose them once per distinct feedback document. The postings are
    # filtered where they lie (broadcast semi join keeps the doc partitioning),
    # so the per-document window below needs no shuffle.
    fb_docs = fb.select("doc_id").distinct()
    if forward is None:
        doc_terms = index.postings.join(_hint(fb_docs, fb_small), "doc_id", "left_semi")
    else:
        doc_terms = forward.lookup(fb_docs, max_broadcast_rows).select("doc_id", F.inline("terms"))
    doc_terms = (
        doc_terms.filter(F.length("term").between(rm3.min_term_len, rm3.max_term_len))
        .select("doc_id", "term", "tf")
    )
    # One scan of the postings for all queries, cached for the size check and
    # the joins below; released once the expansion is checkpointed.
    doc_terms = doc_terms.persist()
    vocab = doc_terms.select("term").distinct()
    vocab_small = row_count_at_most(vocab, max_broadcast_rows)
    rare = index.doc_freqs(vocab, vocab_small).filter(
        F.col("df") <= F.lit(rm3.max_df_ratio * n)
    ).select("term")
    cand = doc_terms.join(_hint(rare, vocab_small), "term")

    per_doc = Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), F.col("term").asc())
    kept = cand.withColumn("r", F.row_number().over(per_doc)).filter(F.col("r") <= rm3.fb_terms)
    shares = kept.withColumn("share", F.col("tf") / F.sum("tf").over(Window.partitionBy("doc_id")))
    # Per query from here on: one shuffle on qid serves the sum per term, the
    # ranking of terms and (after the union) the normalisation and mixing.
    weights = (
        shares.join(_hint(fb, fb_small), "doc_id")
        .select("qid", "term", (F.col("share") * F.col("score")).alias("c"))
        .repartition("qid")
        .groupBy("qid", "term").agg(F.sum("c").alias("w"))
    )
    per_q = Window.partitionBy("qid").orderBy(F.round("w", RANK_DECIMALS).desc(), F.col("term").asc())
    best = weights.withColumn("r", F.row_number().over(per_q)).filter(F.col("r") <= rm3.fb_terms)

    none = F.lit(None).cast("double")
    rows = qweights.select("qid", "term", F.col("qw").cast("double").alias("o"), none.alias("e")).unionByName(
        best.select("qid", "term", none.alias("o"), F.col("w").alias("e")))
    q = Window.partitionBy("qid")
    rows = rows.select(
        "qid", "term",
        (F.col("o") / F.sum("o").over(q)).alias("o"),
        (F.col("e") / F.sum("e").over(q)).alias("e"),
        (F.count("e").over(q) > 0).alias("has_fb"),
    )
    a = rm3.original_query_weight
    part = F.when(~F.col("has_fb"), F.col("o")).when(F.col("o").isNotNull(), F.lit(a) * F.col("o")) \
        .otherwise(F.lit(1.0 - a) * F.col("e"))
    expanded = cut_lineage(rows.groupBy("qid", "term").agg(F.sum(part).alias("qw")))
    doc_terms.unpersist()
    return expanded


def bm25_rm3_topk(index: TextIndex, queries: DataFrame, k: int = 100, params: BM25Params = BM25Params(),
                  rm3: RM3Params = RM3Params(), qid_col: str = "qid", text_col: str = "text",
                  max_broadcast_rows: int = BROADCAST_MAX_ROWS, stopwords: list[str] | None = None,
                  first: DataFrame | None = None) -> DataFrame:
    """B1+B2: BM25 with RM3 expansion (feedback pass, expansion, second pass).

    ``first``: a BM25 run of the same queries, index and parameters with at least
    ``rm3.fb_docs`` hits per query, if the caller has one; the feedback pass is then not run again."""
    qw = query_terms(queries, qid_col, text_col, stopwords)
    # The expansion checkpoints the feedback run and comes back checkpointed itself
    # (small: queries x terms), so the second pass neither re-runs the first nor the
    # expansion windows.
    if first is None:
        first = bm25_search(index, qw, rm3.fb_docs, params, max_broadcast_rows)
    expanded = rm3_terms(index, qw, first, rm3, max_broadcast_rows)
    return bm25_search(index, expanded, k, params, max_broadcast_rows)
