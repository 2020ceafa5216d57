"""CSV, JSON and Parquet readers and writers for table bundles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from pricelens.sources import contract as C


def read_csv(spark: SparkSession, folder: str, name: str, typed: bool = True) -> DataFrame:
    """One raw table from ``<folder>/<name>.csv`` (a file or a folder of part files).

    ``typed`` applies the contract schema; without it Spark infers the types, which costs
    a second pass over the text. A missing path is a ``FileNotFoundError``.
    """
    reader = spark.read
    reader = reader.schema(C.RAW[name].schema) if typed else reader.option("inferSchema", True)
    return open_csv(reader, folder, name)


def open_csv(reader: DataFrameReader, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.csv"
    try:
        return reader.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no raw source at {path}") from error


def read_csv_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All five raw tables; one error names every missing source.

    Text in a number or date becomes NULL; ``quarantine.read_checked_bundle`` tells it apart.
    """
    return each_source(lambda name: read_csv(spark, folder, name), folder)


def each_source(read: Callable[[str], DataFrame], folder: str) -> dict[str, DataFrame]:
    """``read`` for each raw table; one error names every source that it misses."""
    found: dict[str, DataFrame] = {}
    absent: list[str] = []
    for name in C.RAW:
        try:
            found[name] = read(name)
        except FileNotFoundError:
            absent.append(f"{name}.csv")
    if absent:
        raise FileNotFoundError(f"raw sources missing in {folder}: {', '.join(absent)}")
    return found


def write_bundle(
    tables: Mapping[str, DataFrame],
    folder: str,
    formats: Iterable[str] = ("csv",),
    compression: str | None = None,
) -> None:
    """Write each table to ``<folder>/<name>.<format>`` with one part file per task.

    ``compression`` names a codec for the part files; readers tell it by their ending.
    Tables are replaced one by one; ``generations.publish_bundle`` replaces all at once.
    """
    kinds = list(formats)
    for name, table in tables.items():
        for kind in kinds:
            save(table, folder, name, kind, compression)


def save(
    table: DataFrame, folder: str, name: str, kind: str, compression: str | None = None
) -> None:
    writer = table.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(f"{folder}/{name}.{kind}")


def json_record(table: DataFrame, *columns: str) -> Column:
    """Each row as one JSON object; dates as ISO text, NULL fields left out."""
    return F.to_json(F.struct(*(columns or table.columns)))
