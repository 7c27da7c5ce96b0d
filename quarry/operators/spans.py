"""Shortest covering span of a hit (Q1).

Of the spans of a document's tokens that hold all query terms the document has, the
shortest (ties: the first). A positional table holds each occurrence of a query term in a
hit. Going over the occurrences as ends of spans, the best start for an end is the smallest
of the last positions of the terms so far, and the span covers all terms once every term
has one. Both are window functions: the last position of each term at each end is a running
``last`` over the ends, kept per (hit, term); the rest are aggregates per end and per hit.

Work grows with occurrences times distinct terms of one hit; a hit's rows are those of one
document, so no partition grows with the corpus. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most


def occurrences(hits: DataFrame, queries: DataFrame, raw_col: str = "raw",
                max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(qid, doc_id, pos, term): positions of the query's terms in each hit's tokens, from 0."""
    terms = queries.select("qid", F.explode(F.array_distinct(TX.tokens("text"))).alias("term"))
    if row_count_at_most(terms, max_broadcast_rows):
        terms = F.broadcast(terms)
    at = hits.select("qid", "doc_id", F.posexplode(TX.tokens(raw_col)).alias("pos", "term"))
    return at.join(terms, ["qid", "term"])


def covering_spans(hits: DataFrame, queries: DataFrame, raw_col: str = "raw",
                   max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``hits(qid, doc_id, raw, ...)`` with ``n_terms`` (distinct query terms in the document),
    ``start`` and ``stop`` (token positions, both inside) and ``span`` (its tokens joined by
    blanks). Hits without a query term have 0 and nulls. One row per (qid, doc_id)."""
    hits = cut_lineage(hits)  # used for the positions and for the final join
    hit = Window.partitionBy("qid", "doc_id")
    rows = occurrences(hits, queries, raw_col, max_broadcast_rows).withColumn("terms", F.collect_set("term").over(hit))
    # Every end meets every term of the hit; the term's own occurrences carry a position.
    grid = rows.select("qid", "doc_id", "pos", F.size("terms").alias("n_terms"), "term", F.explode("terms").alias("of"))
    so_far = Window.partitionBy("qid", "doc_id", "of").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = grid.withColumn("latest", F.last(F.when(F.col("term") == F.col("of"), F.col("pos")), ignorenulls=True).over(so_far))
    ends = seen.groupBy("qid", "doc_id", "n_terms", "pos").agg(F.min("latest").alias("start"), F.count("latest").alias("met"))
    whole = ends.filter(F.col("met") == F.col("n_terms"))
    best = whole.groupBy("qid", "doc_id", "n_terms").agg(
        F.min(F.struct((F.col("pos") - F.col("start")).alias("length"), "start", F.col("pos").alias("stop"))).alias("best"))
    found = best.select("qid", "doc_id", "n_terms", "best.start", "best.stop")
    span = F.array_join(F.slice(TX.tokens(raw_col), F.col("start") + 1, F.col("stop") - F.col("start") + 1), " ")
    return hits.join(found, ["qid", "doc_id"], "left").withColumn("span", F.when(F.col("start").isNotNull(), span)).withColumn(
        "n_terms", F.coalesce("n_terms", F.lit(0)))
