"""Keyed store: a table in files of disjoint key ranges, with a manifest.

``write`` range-partitions a table by its key, sorts each part and stores one file
per part, with a parquet bloom filter on the key, then writes the manifest: file,
smallest and largest key, rows. ``lookup`` finds for a batch of keys the files whose
range holds one of them and scans only these; a short list of keys is pushed into the
scan as well, where row-group statistics and the bloom filter skip what does not hold
them. The driver sees the manifest (one row per file) and the list of files hit.

Rows of one key lie in one file. Null keys are stored but never found. Columns keep
their names and types; the key may be any type that orders the same way in Spark and
Python (numbers, dates, strings in code point order).
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.sizing import BROADCAST_MAX_ROWS, row_count_at_most
from quarry.shipping import ship

#: Up to so many keys are pushed into the scan as an ``IN`` list.
PUSHED_KEYS = 1000


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.read.parquet(f"{self.path}/data").schema
        rows = spark.read.parquet(f"{self.path}/manifest").filter("first IS NOT NULL").orderBy("first").collect()
        self.files = [r["file"] for r in rows]  # one row per file
        self.first = [r["first"] for r in rows]
        self.last = [r["last"] for r in rows]

    @staticmethod
    def write(table: DataFrame, path: str, key: str, files: int | None = None, ranged: bool = False) -> "KeyedStore":
        """Store ``table``; ``files`` defaults to the session's shuffle partitions. A ``ranged``
        table comes partitioned by ranges of the key already (``repartitionByRange``)."""
        spark, path = table.sparkSession, path.rstrip("/")
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = (table if ranged else table.repartitionByRange(n, key)).sortWithinPartitions(key)
        parts.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/data")
        stored = spark.read.parquet(f"{path}/data")
        manifest = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
        manifest.write.parquet(f"{path}/manifest")
        return KeyedStore(spark, path, key)

    def files_for(self, keys: DataFrame) -> list[str]:
        """Files whose key range holds a key of ``keys``."""
        ship(self.spark)
        sent = self.spark.sparkContext.broadcast((self.first, self.last))  # one entry per file

        def places(batches):
            import pyarrow as pa

            first, last = sent.value
            hit = set()
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    at = bisect_right(first, key) - 1 if key is not None else -1
                    if at >= 0 and key <= last[at]:
                        hit.add(at)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hit), pa.int32())], names=["file"])

        hit = keys.select(self.key).mapInArrow(places, "file int").distinct().collect()  # one row per file at most
        return [self.files[r["file"]] for r in sorted(hit, key=lambda r: r["file"])]

    def lookup(self, keys: DataFrame, max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
        """Rows whose key occurs in ``keys``; other files are not read."""
        wanted = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        files = self.files_for(wanted)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*files)
        if row_count_at_most(wanted, PUSHED_KEYS):
            return rows.filter(F.col(self.key).isin([r[0] for r in wanted.collect()]))
        if row_count_at_most(wanted, max_broadcast_rows):
            wanted = F.broadcast(wanted)
        return rows.join(wanted, self.key, "left_semi")

    def table(self) -> DataFrame:
        """All rows."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
