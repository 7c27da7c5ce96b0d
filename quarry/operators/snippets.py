"""Query-biased snippets (Q1).

The original generator is unfinished (it stops after an empty loop header);
this is the engine's own definition of its intent: split the hit's whole raw
text into sentences, score each by the number of distinct query terms it
contains, keep the ``n`` best (ties: earlier sentence first) and join them in
text order. Everything stays in the JVM: ``posexplode`` of sentences,
``array_intersect`` of token sets, a window per hit, and a bounded
``collect_list`` of at most ``n`` sentences per hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most

# Fixed value: sentences per snippet.
SNIPPET_SENTENCES = 2


def best_sentences(hits: DataFrame, queries: DataFrame, n: int = SNIPPET_SENTENCES, raw_col: str = "raw",
                   max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``hits(qid, doc_id, raw, ...)`` + ``queries(qid, text)`` -> hits with ``snippet``."""
    hits = cut_lineage(hits)  # used for the sentences and for the final join
    qt = queries.select("qid", F.array_distinct(TX.tokens("text")).alias("qterms"))
    if row_count_at_most(qt, max_broadcast_rows):
        qt = F.broadcast(qt)
    sents = hits.select("qid", "doc_id", F.posexplode(TX.sentences(raw_col)).alias("pos", "sentence"))
    scored = sents.join(qt, "qid").withColumn(
        "matched", F.size(F.array_intersect(F.array_distinct(TX.tokens("sentence")), F.col("qterms"))))
    w = Window.partitionBy("qid", "doc_id").orderBy(F.col("matched").desc(), F.col("pos").asc())
    best = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    snip = best.groupBy("qid", "doc_id").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))),
                                     lambda s: s["sentence"])).alias("snippet"))
    return hits.join(snip, ["qid", "doc_id"], "left")
