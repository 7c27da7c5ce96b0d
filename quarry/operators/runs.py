"""Operators on runs ``run(qid, doc_id, rank, score, ...)`` (W1, J2-J6, J8, R1,
A5, T3, F3, F7).

Runs are small (queries x k) while corpora, vector tables and id maps grow with
the data. Fetching from a big table therefore goes in two steps: the run's
distinct keys (row-count checked, then broadcast) filter the big table where it
lies -- no shuffle of the big side -- and the small result is joined back. The
run is used twice in such a fetch, so it is checkpointed first: the search that
produced it runs once, and its lineage is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most
from quarry.sources.keyed import KeyedStore


def fetch_by_key(keys: DataFrame, table: DataFrame | KeyedStore, key: str | list[str],
                 max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows of ``table`` whose ``key`` (one column or several) occurs in
    ``keys`` (late fetch). Of a store keyed by ``key`` only the files hit are read."""
    if isinstance(table, KeyedStore):
        if key != table.key:
            raise ValueError(f"the store is keyed by {table.key!r}, not {key!r}")
        return table.lookup(keys, max_broadcast_rows)
    cols = [key] if isinstance(key, str) else list(key)
    wanted = keys.select(*cols).distinct()
    if row_count_at_most(wanted, max_broadcast_rows):
        wanted = F.broadcast(wanted)
    return table.join(wanted, cols, "left_semi")


def attach_raw(run: DataFrame, corpus: DataFrame | KeyedStore, text_col: str = "text",
               max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Add ``raw`` text to each hit (null when the document is missing)."""
    run = cut_lineage(run)
    texts = fetch_by_key(run, corpus, "doc_id", max_broadcast_rows).select("doc_id", F.col(text_col).alias("raw"))
    return run.join(texts, "doc_id", "left")


def doc_lookup(ids: DataFrame, corpus: DataFrame | KeyedStore, text_col: str = "text",
               max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``(doc_id, raw)`` for a batch of ids; unknown ids get null."""
    return attach_raw(ids.select("doc_id"), corpus, text_col, max_broadcast_rows)


def id_translate(run: DataFrame, id_map: DataFrame, max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Index id -> document id. ``run`` has ``vec_id``; ``id_map(doc_id,
    vec_id)``. Unmapped ids keep a null ``doc_id``."""
    run = cut_lineage(run)
    mapped = fetch_by_key(run, id_map.select("vec_id", "doc_id"), "vec_id", max_broadcast_rows)
    return run.join(mapped, "vec_id", "left")


def doc_to_index_ids(run: DataFrame, id_map: DataFrame, max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """J5 (reverse): document id -> index id ``vec_id`` (null when unmapped)."""
    run = cut_lineage(run)
    mapped = fetch_by_key(run, id_map.select("doc_id", "vec_id"), "doc_id", max_broadcast_rows)
    return run.join(mapped, "doc_id", "left")


def fetch_embeddings(run: DataFrame, vectors: DataFrame | KeyedStore, key: str = "vec_id",
                     max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Attach the stored vector of each hit (``vectors(key, embedding)``)."""
    run = cut_lineage(run)
    vecs = fetch_by_key(run, vectors, key, max_broadcast_rows).select(key, "embedding")
    return run.join(vecs, key, "left")


def document_vectors(ids: DataFrame, id_map: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """J5 + J6: ``(doc_id, vec_id, embedding)`` for a batch of document ids. Ids that are
    not mapped or have no vector keep nulls, or raise when ``strict``."""
    found = fetch_embeddings(doc_to_index_ids(ids.select("doc_id"), id_map), vectors)
    if strict:
        missing = F.concat(F.lit("no vector for document "), F.col("doc_id").cast("string"))
        found = found.withColumn("embedding", F.coalesce(F.col("embedding"), F.raise_error(missing)))
    return found.select("doc_id", "vec_id", "embedding")


def score_from_distance(hits: DataFrame, distance_col: str = "distance") -> DataFrame:
    """``score = 1 - distance`` for every metric."""
    return hits.withColumn("score", F.lit(1.0) - F.col(distance_col))


def relevance_flag(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``relevant`` = hit is a positive of its query; null (not false)
    when the query has no positive judgement at all."""
    run = cut_lineage(run)  # used for the key sets and for the joins
    positives = qrels.filter(F.col("label") > 0).select("qid", F.col("did").alias("doc_id"))
    # only the judgements of the run's (query, document) pairs and queries are
    # read out of the (possibly large) judgement table
    pos = fetch_by_key(run, positives, ["qid", "doc_id"]).distinct()
    judged = fetch_by_key(run, positives.select("qid"), "qid").distinct().withColumn("_judged", F.lit(True))
    marked = (
        run.join(pos.withColumn("_hit", F.lit(True)), ["qid", "doc_id"], "left")
        .join(judged, "qid", "left")
    )
    return marked.withColumn(
        "relevant", F.when(F.col("_judged"), F.coalesce(F.col("_hit"), F.lit(False)))
    ).drop("_hit", "_judged")


def hit_counts(run: DataFrame) -> DataFrame:
    """A5: number of hits per query."""
    return run.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))


def compare_runs(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Two pipelines side by side: ``(qid, doc_id, rank_a, score_a,
    rank_b, score_b)``; a document found by one side only has nulls on the other."""
    a = run_a.select("qid", "doc_id", F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    b = run_b.select("qid", "doc_id", F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    return a.join(b, ["qid", "doc_id"], "full_outer")


def order_by_other_run(run_b: DataFrame, run_a: DataFrame) -> DataFrame:
    """Re-number ``run_b`` in the order of ``run_a``'s ranks (documents
    ``run_a`` did not find follow, in their own order)."""
    a = run_a.select("qid", "doc_id", F.col("rank").alias("rank_a"))
    b = run_b.withColumnRenamed("rank", "rank_b").join(a, ["qid", "doc_id"], "left")
    w = Window.partitionBy("qid").orderBy(F.col("rank_a").asc_nulls_last(), F.col("rank_b").asc(), F.col("doc_id"))
    return b.withColumn("rank", F.row_number().over(w).cast("bigint"))


def present_hits(run: DataFrame, shortened: bool = True) -> DataFrame:
    """presentation columns of hits that carry ``raw`` (and optionally
    ``relevant``): shortened text, its first link, and the text with the link
    replaced by an anchor."""
    short = T.shorten("raw", shortened)
    out = run.withColumn("text", short).withColumn("url", T.first_url("text"))
    return out.withColumn("display", T.linkify("text", "url"))
