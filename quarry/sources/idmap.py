"""Document id <-> index id mapping (S3).

The original format is one JSON object ``{"doc id": index id, ...}`` in one file. A reader
that takes the object as one record parses it in one task; here the text source cuts it at
commas (its record separator), so every split of the file is read by a task of its own:

* a record with two quotes is a whole entry, ``"key": number``;
* others are parts of keys that hold commas. Escapes never contain a comma, so quotes are
  counted part by part, and whether a part begins inside a key follows from the parity of the
  quotes before it: per split one number, summed over the splits in file order, then a
  window inside each split. Parts get the number of their entry, counted the same way, and
  are put together by it, also across the seams of splits.

No task holds more than a split's broken records, and per split one row is summed.
``read_id_map_lines`` reads the form of one ``{"doc_id": .., "vec_id": ..}`` per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# An entry: a JSON string and a whole number, with the object's braces at its ends.
ENTRY = r'^\s*\{?\s*("[^"\\]*(?:\\.[^"\\]*)*")\s*:\s*(-?\d+)\s*\}?\s*$'


def _quotes(value) -> F.Column:
    bare = F.regexp_replace(value, r"\\.", "")  # escaped characters, quotes among them
    return F.length(bare) - F.length(F.translate(bare, '"', ""))


def _stitched(parts: DataFrame, splits: DataFrame) -> DataFrame:
    """Entries (value) of records ``parts(file, split, at, value, quotes)`` with fewer than two
    quotes; ``splits(file, split, odd)`` holds every split's number of single quotes."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    opened = splits.select("file", "split", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("opened"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(opened, ["file", "split"])
    within = (F.col("opened") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2 == 1
    rows = rows.withColumn("first", F.when(within, 0).otherwise(1))  # a part that begins an entry
    starts = rows.groupBy("file", "split").agg(F.sum("first").alias("n"))
    starts = starts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("entries"))
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, ["file", "split"]).withColumn("entry", F.col("entries") + F.sum("first").over(upto))
    whole = rows.groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("parts"))
    return whole.select(F.array_join(F.transform("parts", lambda p: p["value"]), ",").alias("value"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``id_map(doc_id STRING, vec_id BIGINT)`` from files of one JSON object each, read in
    splits. Anything but string keys and whole numbers is an error."""
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    raw = raw.withColumn("quotes", _quotes(F.col("value")))
    parts = raw.filter("quotes < 2")
    splits = raw.groupBy("file", "split").agg(F.sum(F.when(F.col("quotes") == 1, 1).otherwise(0)).alias("odd"))
    entries = raw.filter("quotes >= 2").select("value").unionByName(_stitched(parts, splits))
    entries = entries.filter(~F.col("value").rlike(r"^[\s{}]*$"))
    key, number = (F.regexp_extract("value", ENTRY, i) for i in (1, 2))
    checked = F.when(F.col("value").rlike(ENTRY), key).otherwise(F.raise_error(F.concat(F.lit("not an id map entry: "), F.substring("value", 1, 80))))
    return entries.select(F.from_json(F.concat(F.lit("["), checked, F.lit("]")), "array<string>")[0].alias("doc_id"),
                          number.cast("bigint").alias("vec_id"))


def read_id_map_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id_map`` from JSON lines ``{"doc_id": "...", "vec_id": n}``."""
    return spark.read.schema("doc_id STRING, vec_id BIGINT").json(path)


def write_id_map(rows: DataFrame, path: str) -> None:
    """Store ``rows(doc_id, vec_id)`` as text files of one JSON object each, one per partition."""

    def objects(batches):
        import json

        import pyarrow as pa

        opening = "{"
        for batch in batches:
            entries = [f"{json.dumps(k)}: {v}" for k, v in zip(*(c.to_pylist() for c in batch.columns))]
            if entries:
                lines = [opening + entries[0], *["," + e for e in entries[1:]]]
                opening = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if opening == "{" else "}"])], names=["value"])

    known = rows.filter("doc_id IS NOT NULL AND vec_id IS NOT NULL")
    known.select(F.col("doc_id").cast("string"), F.col("vec_id").cast("bigint")).mapInArrow(objects, "value string").write.text(path)
