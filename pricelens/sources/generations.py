"""Bundles of tables that appear as a whole or not at all.

A bundle is written to a folder of its own, a generation. Only when all of its tables are there
and hold the rows that were sent does a line of the manifest name it; readers go by the newest
line. A run that fails in the middle therefore leaves the bundle before it untouched, and what
it wrote is unread files until ``prune``. The manifest is a small Parquet table that only grows:
a line is one file, which Spark's commit moves into place at once, also on object stores.

Writers are expected one at a time. Two that overlap write two whole generations of the same
version; the one that finished last counts, by its time and then its name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from pricelens.sources.files import save

MANIFEST = (
    "version long, generation string, formats array<string>, rows map<string, long>,"
    " written timestamp"
)


class IncompleteBundle(RuntimeError):
    """A written table does not hold the rows that were sent to it."""


def _manifest(folder: str) -> str:
    return f"{folder}/manifest"


def generations(spark: SparkSession, folder: str) -> DataFrame:
    """All finished generations of ``folder``; empty where there are none."""
    try:
        return spark.read.schema(MANIFEST).parquet(_manifest(folder))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, folder: str) -> Row | None:
    """The newest finished generation."""
    newest = generations(spark, folder).orderBy(
        F.desc("version"), F.desc("written"), F.desc("generation")
    )
    return newest.first()


def _place(folder: str, generation: str) -> str:
    return f"{folder}/generations/{generation}"


def publish_bundle(
    tables: Mapping[str, DataFrame], folder: str, formats: Iterable[str] = ("parquet",)
) -> Row:
    """Writes all tables in all formats, compares their rows and makes them the current bundle.

    A table is computed once, for its first format; the others are written from that. Rows are
    counted while they are written and once more when read back.
    """
    kinds = list(dict.fromkeys(formats))
    if not tables or not kinds:
        raise ValueError("a bundle needs a table and a format")
    # Parquet keeps types, so where it is asked for the other formats copy it.
    kinds.sort(key=lambda kind: kind != "parquet")
    spark = next(iter(tables.values())).sparkSession
    generation = uuid.uuid4().hex
    place = _place(folder, generation)
    rows: dict[str, int] = {}
    for name, table in tables.items():
        sent = Observation()
        save(table.observe(sent, F.count(F.lit(1)).alias("rows")), place, name, kinds[0])
        rows[name] = sent.get["rows"]
        for kind in kinds[1:]:
            save(_written(spark, place, name, kinds[0], table), place, name, kind)
        for kind in kinds:
            found = _written(spark, place, name, kind, table).count()
            if found != rows[name]:
                raise IncompleteBundle(f"{name}.{kind} has {found} rows of {rows[name]}")
    last = current(spark, folder)
    line = spark.range(1).select(
        F.lit(last.version + 1 if last else 1).cast("long").alias("version"),
        F.lit(generation).alias("generation"),
        F.array(*[F.lit(kind) for kind in kinds]).alias("formats"),
        F.map_from_arrays(
            F.array(*[F.lit(name) for name in rows]),
            F.array(*[F.lit(n).cast("long") for n in rows.values()]),
        ).alias("rows"),
        F.current_timestamp().alias("written"),
    )
    line.coalesce(1).write.mode("append").parquet(_manifest(folder))
    return current(spark, folder)


def _written(
    spark: SparkSession, place: str, name: str, kind: str, table: DataFrame
) -> DataFrame:
    reader = spark.read.schema(table.schema)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(kind).load(f"{place}/{name}.{kind}")


def read_published(
    spark: SparkSession, folder: str, names: Iterable[str] | None = None, kind: str = "parquet"
) -> dict[str, DataFrame]:
    """Tables of the current bundle, all of the same generation."""
    bundle = current(spark, folder)
    if bundle is None:
        raise FileNotFoundError(f"no finished bundle in {folder}")
    wanted = list(bundle.rows if names is None else names)
    absent = [name for name in wanted if name not in bundle.rows]
    if absent or kind not in bundle.formats:
        raise FileNotFoundError(
            f"version {bundle.version} in {folder} has tables {sorted(bundle.rows)}"
            f" as {bundle.formats}"
        )
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    place = _place(folder, bundle.generation)
    return {name: reader.format(kind).load(f"{place}/{name}.{kind}") for name in wanted}


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Removes all generations but the newest ``keep`` finished ones; returns what it removed.

    Also removes what failed runs left. Not to be called while a bundle is written.
    """
    if keep < 1:
        raise ValueError("the current bundle must stay")
    newest = generations(spark, folder).orderBy(
        F.desc("version"), F.desc("written"), F.desc("generation")
    )
    stay = {row.generation for row in newest.limit(keep).collect()}
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/generations")
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    removed = []
    for found in store.listStatus(root) if store.exists(root) else []:
        name = found.getPath().getName()
        if name not in stay:
            store.delete(found.getPath(), True)
            removed.append(name)
    return sorted(removed)
