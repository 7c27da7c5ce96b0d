"""Table sources (S4, S5): corpora, query sets and vectors by name.

Every reader is a lazy ``spark.read``; column selection and filters written
after it are pushed into the parquet scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, base_dir: str) -> DataFrame:
    """``corpus(doc_id, text)`` from the documents table."""
    return read_table(spark, base_dir, "documents").select("doc_id", "text")


def web_corpus(spark: SparkSession, base_dir: str) -> DataFrame:
    """``corpus(doc_id, text)`` whose raw text starts with the page's link."""
    return read_table(spark, base_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat_ws("\n", "url", "html").alias("text")
    )


def passage_queries(spark: SparkSession, base_dir: str) -> DataFrame:
    """``queries(qid, text)`` from the benchmark passages."""
    return read_table(spark, base_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, base_dir: str) -> DataFrame:
    """``vectors(vec_id, embedding)``."""
    return read_table(spark, base_dir, "embeddings").select("vec_id", "embedding")


# Corpora registry -- name -> reader(spark, base_dir).
CORPORA = {
    "documents": corpus,
    "pages": web_corpus,
}


def open_corpus(spark: SparkSession, base_dir: str, name: str = "documents") -> DataFrame:
    try:
        return CORPORA[name](spark, base_dir)
    except KeyError:
        raise ValueError(f"unknown corpus {name!r}; known: {sorted(CORPORA)}") from None
