"""Queries as a stream: each micro-batch of incoming queries is searched with
the batch operators (the original ran one interactive query per request; here
queries arrive as files and are served in micro-batches).

``foreachBatch`` runs any ``search(queries_batch) -> run`` function (BM25,
k-NN, a whole pipeline) against static, persisted indexes. Output is written
per batch id into ``<sink>/batch_id=<n>`` with overwrite, so a batch replayed
after a failure rewrites the same folder: the sink is exactly-once together
with the streaming checkpoint.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def query_stream(spark: SparkSession, source_dir: str, schema: str = "item_id BIGINT, text STRING",
                 glob: str | None = None, qid_col: str = "item_id", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``queries(qid, text)`` from parquet files arriving in ``source_dir``."""
    reader = spark.readStream.format("parquet").schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir).select(F.col(qid_col).alias("qid"), "text")


def serve(stream: DataFrame, search: Callable[[DataFrame], DataFrame], sink_dir: str,
          checkpoint_dir: str, available_now: bool = True, name: str | None = None) -> StreamingQuery:
    """Start the micro-batch search; returns the running ``StreamingQuery``.

    ``checkpoint_dir`` must be the same shared folder after a restart: it holds the
    batch numbers, so a new session neither repeats nor overwrites a finished batch.
    ``name`` tells several streams of one session apart."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = search(batch)
        out.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()


def read_sink(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
