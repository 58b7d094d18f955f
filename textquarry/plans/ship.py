"""Sends this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package's sources to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    where = tempfile.mkdtemp(prefix="ship-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    path = Path(where) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)


def shipped(query):
    """``query(spark, sf)`` that ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf: str):
        ship(spark)
        return query(spark, sf)

    return run
