"""Make the package importable in executor Python workers.

Pandas UDFs refer to functions of this package, which the workers unpickle by
module name. ``ship(spark)`` zips the package once per SparkContext and adds it
with ``addPyFile`` (what ``--py-files`` does), unless the package is already
importable there through the environment.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def _zip_package() -> str:
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    return out


def ship(spark) -> None:
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    sc.addPyFile(_zip_package())
    _SHIPPED.add(key)


def ship_active() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
