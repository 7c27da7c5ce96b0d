"""Size checks behind every broadcast, and lineage cuts.

A side is broadcast only after a check of its rows and bytes proves it small;
beyond the bounds the join stays a shuffle join (AQE may still switch it at run time from
measured sizes). Long multi-pass jobs cut lineage with a reliable
``checkpoint()`` into ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir

# Default bounds for broadcasting a query-side table: rows, and bytes of its values.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20


def _bytes_of(name: str, kind: T.DataType) -> Column:
    """Bytes that a value of a column takes, about: 8 per number, the length of texts."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
        size = 8 * F.size(col)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        size = F.octet_length(F.to_json(col))
    else:
        size = F.lit(8)
    return F.coalesce(F.greatest(size, F.lit(0)), F.lit(0)).cast("long")


def row_count_at_most(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """True if ``df`` has at most ``max_rows`` rows whose values take at most
    ``max_bytes`` (``BROADCAST_MAX_BYTES`` unless given). A plain aggregate: every
    partition sends one row, whatever the table's size."""
    max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    width = sum((_bytes_of(f.name, f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return facts["n"] <= max_rows and facts["bytes"] <= max_bytes


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ordered_positions(df: DataFrame, key: str, order: list[str], out: str = "pos",
                      partitions: int | None = None) -> DataFrame:
    """Exact 1-based position of each row within its ``key`` group in ``order``
    -- like ``row_number()`` over ``partitionBy(key)``, but a hot key is not
    sent to one task: rows are range-partitioned on ``(key, order)``, so a big
    group spans many partitions; each partition numbers its rows locally and a
    small table of per-(partition, key) counts gives every partition its offset.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Partition ids and row ids are frozen by a reliable checkpoint: the counts
    # and the rows must come from one and the same evaluation of the split.
    ranged = cut_lineage(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # counts has one row per (partition, key): at most partitions x keys rows.
    return (ranged.join(F.broadcast(offsets.select("_pid", key, "_off", "_first"))
                        if row_count_at_most(offsets, BROADCAST_MAX_ROWS) else offsets.select("_pid", key, "_off", "_first"),
                        ["_pid", key])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off", "_first"))
