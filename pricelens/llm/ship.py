"""Sends this package to the executors, for clusters on which it is not installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Once per application; Spark's own file server hands the archive to every executor."""
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    folder = tempfile.mkdtemp(prefix="package-")  # the file server reads it while the job lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(application)


def on_executors(query: Callable) -> Callable:
    """``query``, run after the package was sent; its first argument is the session."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        send_package(spark)
        return query(spark, *rest)

    return run
