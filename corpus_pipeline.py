"""Corpus cleaning pipeline over ``documents``: each stage calls one operator of ``quarry.llm``.

1. ``toxicity``: the character n-gram classifier learns from ``labels`` (held-out rows
   excepted); documents it predicts toxic go.
2. ``line_dedup``: later occurrences of repeated three-line windows are cut out of the
   texts; every document stays (an exact later copy stays with an empty text), and
   ``n_chars`` follows the text.
3. ``simhash``: of each component of linked fingerprints one row stays, that with the
   smallest doc_id; a component without any id keeps one row too.
4. ``decontamination``: documents with a verified passage of ``benchmark`` go.
5. ``byte_bpe``: digests of the ids and of the decoded bytes of every kept document.

Filters decide where the rows lie, so texts move only in stages 2 and 3. Each stage's
result is written to the shared folder and read back, which cuts lineage and survives
lost executors. Nulls, empty texts, repeated rows and empty tables have the results
that the operators' docstrings give; a null text is kept as null until stage 5, where it
counts as empty. The columns are those of ``documents``; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from quarry.llm._common import stored, table

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs.select(*DOCUMENTS), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(docs.select(*DOCUMENTS))
    kind = docs.schema["n_chars"].dataType
    chars = F.when(F.col("removed_lines") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(*DOCUMENTS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs.select(*DOCUMENTS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed by this stage only

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]
#: Neither the classifier nor the fingerprints' components are SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *DOCUMENTS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
