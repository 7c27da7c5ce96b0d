"""Forward store: each document's term vector, found by key.

Feedback needs the terms of a few documents out of the corpus. ``write_forward`` stores
``(doc_id, dl, terms)``, ``terms`` an array of ``(term, tf)``, in files of disjoint ranges
of ``doc_id`` with a bloom filter (``sources.keyed``); ``rm3_terms(..., forward=store)``
then reads only the files, and in them the row groups, that hold feedback documents.
The postings are dealt over the ranges first and gathered there, so the cut points come
from a scan of the postings and the vectors are built once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.index import TextIndex
from quarry.sources.keyed import KeyedStore


def write_forward(index: TextIndex, path: str, files: int | None = None) -> KeyedStore:
    """Documents without terms have no row."""
    n = files or int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = index.postings.repartitionByRange(n, "doc_id").groupBy("doc_id", "dl").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))  # one document's terms
    return KeyedStore.write(vectors, path, "doc_id", n, ranged=True)
