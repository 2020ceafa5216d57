"""Shared folder for tables that a plan writes once and reads several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_private_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may fall back to a private one."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"set {_SETTING} to storage that every executor can reach")
    if context.applicationId not in _private_folders:
        _private_folders[context.applicationId] = tempfile.mkdtemp(prefix="pricelens-")
    return _private_folders[context.applicationId]


class StagingArea:
    """Writes intermediate tables as Parquet and hands back frames that read them.

    A written table cuts lineage and outlives lost executors, and readers get column
    pruning and file statistics from it. Each area owns one sub-folder, which ``close`` (or
    leaving a ``with`` block) removes with everything written to it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        root = folder or shared_folder(spark)
        self.path = f"{root}/pricelens/{uuid.uuid4().hex}"
        self._count = 0

    def __enter__(self) -> StagingArea:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Remove the area's own folder; frames that read from it are of no use afterwards."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def location(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:04d}_{name}"

    def put(self, name: str, table: DataFrame, near: str | None = None) -> DataFrame:
        """Write ``table`` and return a frame that reads what was written.

        ``near`` names a column whose equal values should share files, so that later
        aggregates on it combine before their shuffle. It is a rebalance, not a strict
        partitioning: adaptive execution splits a hot value over several files.
        """
        where = self.location(name)
        (table.hint("rebalance", near) if near else table).write.parquet(where)
        return self.spark.read.schema(table.schema).parquet(where)

    def put_in_order(
        self, name: str, table: DataFrame, *order: str, chunks: int | None = None
    ) -> DataFrame:
        """Write ``table`` range-partitioned by ``order`` with its partition number as ``chunk``.

        Every row of a chunk sorts before every row of a later chunk, so ordered scans can
        work chunk by chunk and carry totals across: no task ever holds a whole group.
        The number is stored because a re-run of the sampling could cut differently.
        """
        split = table.repartitionByRange(*([chunks] if chunks else []), *order)
        return self.put(name, split.withColumn("chunk", F.spark_partition_id()))
