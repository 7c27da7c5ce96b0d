"""Labelled rows for the trained classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import smallest


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> DataFrame:
    """Bounded labelled sample: doc_id, text, y, weight. ``labels`` holds doc_id and
    ``label``. Each class gives at most its bound of ids, by smallest hash of the id, and of
    rows: equal texts of an id are one row, every sampled id keeps its text of the smallest
    hash, and further texts fill the bound by smallest hash. The weight of an id is how many
    labelled ids it stands for; its rows share it."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [smallest(known.filter(F.col("y") == y), key, n, totals.get(y, 0), "labelled", F.col("doc_id")).withColumn(
        "weight", F.lit(totals.get(y, 0) / max(1, min(n, totals.get(y, 0))))) for y, n in per_class.items()]
    sample = parts[0].unionByName(parts[1])
    # At most the sum of the bounds in rows of three numbers: proven small.
    met = docs.select("doc_id", F.xxhash64("text").alias("_text")).join(F.broadcast(sample), "doc_id").distinct()
    first = met.groupBy("doc_id").agg(F.min("_text").alias("_first"))
    met = met.join(F.broadcast(first), "doc_id")
    order = (F.col("_text") != F.col("_first"), F.xxhash64("doc_id", "_text"), F.col("doc_id"), F.col("_text"))
    parts = [met.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in per_class.items()]
    chosen = parts[0].unionByName(parts[1])
    share = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))  # over bounded rows
    chosen = chosen.select("doc_id", "_text", "y", (F.col("weight") / share).alias("weight"))
    rows = docs.withColumn("_text", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "_text"])
    return rows.dropDuplicates(["doc_id", "_text"]).drop("_text")
