"""Relevance judgements and query files.

Text files are read with ``spark.read.text``; the file order is kept through a
line key ``(file path, block start, monotonically increasing id)`` so "first
occurrence wins" and "file order" hold even when a file is split over tasks.

Malformed lines: ``strict=True`` (default) raises with the number of bad lines;
``strict=False`` drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.sizing import ordered_positions

# Blanks stripped from both ends of a line; judgement fields are
# separated by blank runs, query fields by exactly one tab.
STRIP_PATTERN = r"^\s+|\s+$"
JUDGEMENT_SEPARATOR = r"\s+"
QUERY_SEPARATOR = "\t"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    return raw.select(
        F.regexp_replace("value", STRIP_PATTERN, "").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("line_no"),
    )


def _check(df: DataFrame, ok: Column, strict: bool, what: str) -> DataFrame:
    if strict:
        bad = df.filter(~ok).count()
        if bad:
            raise ValueError(f"{bad} malformed {what} line(s)")
    return df.filter(ok)


def read_qrels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``qid ignored did label`` lines -> ``qrels(qid, did, label, line_no)``."""
    parts = _lines(spark, path).select(F.split("line", JUDGEMENT_SEPARATOR).alias("f"), "line_no")
    ok = (F.size("f") == 4) & F.col("f")[3].rlike(r"^[+-]?\d+$")
    parts = _check(parts, ok, strict, "judgement")
    return parts.select(
        F.col("f")[0].alias("qid"), F.col("f")[2].alias("did"), F.col("f")[3].cast("int").alias("label"), "line_no"
    )


def positive_judgements(qrels: DataFrame) -> DataFrame:
    """keep ``label > 0`` (duplicates stay)."""
    return qrels.filter(F.col("label") > 0)


def positives_by_query(qrels: DataFrame) -> DataFrame:
    """A1: positives per query in file order, as ``(qid, pos, did)`` rows.

    The original keeps a list per query; here the list is long-form so that no
    query's positives are ever collected into one array or one task (a query
    may hold a large share of all judgements): positions come from
    ``ordered_positions``. ``positives_lists`` builds arrays when groups are
    known to be small."""
    pos = positive_judgements(qrels)
    order = "line_no" if "line_no" in qrels.columns else "did"
    return ordered_positions(pos.select("qid", "did", order), "qid", [order]).select("qid", "pos", "did")


def positives_lists(positives: DataFrame, max_per_query: int) -> DataFrame:
    """``(qid, dids)`` arrays from ``positives_by_query``; refuses groups larger
    than ``max_per_query`` (checked first) instead of building them."""
    biggest = positives.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    if biggest > max_per_query:
        raise ValueError(f"a query has {biggest} positives (> {max_per_query}); keep the long form")
    return positives.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "did"))), lambda s: s["did"]).alias("dids"))


def read_queries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """S2 (first half): ``qid<TAB>text`` lines -> ``(qid, text, line_no)``."""
    parts = _lines(spark, path).select(F.split("line", QUERY_SEPARATOR).alias("f"), "line_no")
    parts = _check(parts, F.size("f") == 2, strict, "query")
    return parts.select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("text"), "line_no")


def first_query_text(queries: DataFrame) -> DataFrame:
    """A2: one text per qid, the first in file order (``min_by``, not an
    unordered ``dropDuplicates``)."""
    if "line_no" not in queries.columns:
        return queries.groupBy("qid").agg(F.min("text").alias("text"))
    return queries.groupBy("qid").agg(F.min_by("text", "line_no").alias("text"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """S2 + J1: queries that have at least one positive judgement."""
    judged = positive_judgements(qrels).select("qid").distinct()
    return first_query_text(queries).join(judged, "qid", "left_semi")


def load_qrels(spark: SparkSession, qrels_path: str, queries_path: str, strict: bool = True):
    """Both files at once: ``(positives_by_query, judged_queries)``."""
    qrels = read_qrels(spark, qrels_path, strict)
    return positives_by_query(qrels), judged_queries(read_queries(spark, queries_path, strict), qrels)


def qrels_from_labels(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Judgements with zeros from a label table: ``qid`` = document source,
    ``did`` = document id, ``label`` = quality flag."""
    return labels.join(documents.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("qid"), F.col("doc_id").alias("did"), F.col("quality").alias("label")
    )
