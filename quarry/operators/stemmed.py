"""Stemmed index and queries (B1): the stem table of the vocabulary joined to the postings.

A search needs the postings of its queries' stems alone. ``StemIndex.of_terms`` cuts the
stem table to the words of these stems before it meets the postings, so the postings are
filtered by a broadcast where they lie, and no posting is shuffled, however large the
vocabulary is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stem import stems
from quarry.operators.index import TextIndex
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most


@dataclass
class StemIndex(TextIndex):
    """``table(term, stem)`` of the vocabulary beside the index ``words`` that is stemmed."""

    words: TextIndex | None = None
    table: DataFrame | None = None
    max_broadcast_rows: int = BROADCAST_MAX_ROWS

    def of_terms(self, needed_terms: DataFrame, small: bool) -> TextIndex:
        wanted = needed_terms.select(F.col("term").alias("stem"))
        table = cut_lineage(self.table.join(F.broadcast(wanted) if small else wanted, "stem", "left_semi"))
        if not row_count_at_most(table, self.max_broadcast_rows):
            return self  # as many words as the vocabulary: no use in reading it apart
        found = _stemmed(self.words, table, True)
        return TextIndex(postings=found, doc_ids=self.doc_ids, terms=_doc_freqs(found), _stats=self.stats())


def _stemmed(index: TextIndex, table: DataFrame, small: bool) -> DataFrame:
    rows = index.postings.join(F.broadcast(table) if small else table, "term")
    return rows.groupBy("doc_id", "dl", F.col("stem").alias("term")).agg(F.sum("tf").cast("int").alias("tf"))


def _doc_freqs(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def stem_index(index: TextIndex, max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> StemIndex:
    """``index`` with stems for terms; document lengths stay, since stems do not merge places.

    A vocabulary that fits a broadcast is joined where the postings lie, which keeps their
    document partitioning; a larger one is shuffled, and the counts are gathered by document."""
    table = cut_lineage(stems(index.terms))
    postings = _stemmed(index, table, row_count_at_most(table, max_broadcast_rows))
    return StemIndex(postings=postings, doc_ids=index.doc_ids, terms=_doc_freqs(postings), _stats=index.stats(),
                     words=index, table=table, max_broadcast_rows=max_broadcast_rows)


def stem_queries(qweights: DataFrame) -> DataFrame:
    """``(qid, term, qw)`` with stems for terms, weights of equal stems added up."""
    qweights = cut_lineage(qweights)
    rows = qweights.join(stems(qweights), "term")
    return rows.groupBy("qid", F.col("stem").alias("term")).agg(F.sum("qw").alias("qw"))
