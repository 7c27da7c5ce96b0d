"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the session is created by the caller; nothing here overrides its
settings. ``checkpoint_dir`` only fills in a folder when the session names none
and the master is local (tests, bench) -- never a machine-local folder on a
cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, Arrow on."""
    builder = SparkSession.builder
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` (or an already set SparkContext folder). Only
    a local master may fall back to a fresh temporary folder; on a cluster an
    unset folder is an error, because a machine-local path does not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
    path = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def filesystem(url: str):
    """(file system, path) of a folder or file URL, in the driver or a task."""
    from pyarrow import fs

    if url.startswith("file:/") and not url.startswith("file://"):
        url = "file://" + url[len("file:"):]
    return fs.FileSystem.from_uri(url)
