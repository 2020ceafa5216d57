"""CSV rows whose cells do not fit the contract: kept, named and counted.

A typed CSV reader turns text in a number into NULL, and the cell then looks empty. Here the
file is read as text, each cell is converted by its contract type, and a cell that holds text
but gives no value is a fault. The converted rows are written once; the tables and the
quarantine both read what was written, so the text is parsed once.

Defined cases: an empty cell is no fault; blanks around a value are ignored; NaN is no number;
dates are ``yyyy-MM-dd``; a row with too few or too many cells is a fault of the column
``(cells)``, whose value is the whole row; a row with several faults has a row for each.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.operators.checks import stacked
from pricelens.sources import contract as C
from pricelens.sources.area import StagingArea
from pricelens.sources.files import each_source, open_csv

col = F.col

#: The fault of a row that has another number of cells than the contract.
CELLS = "(cells)"
_RECORD, _FAULTS = "_record", "_faults"


@dataclass(frozen=True)
class CheckedBundle:
    """The five tables and the faults of their files.

    ``tables`` holds all rows, with NULL in place of a faulty cell, so that links stay whole;
    ``clean`` holds the rows without faults. ``quarantine`` has a row per fault: table_name,
    row_key, fault (its number in the row), column_name, value and the row's cells as JSON
    (``record``).
    """

    tables: Mapping[str, DataFrame]
    clean: Mapping[str, DataFrame]
    quarantine: DataFrame


def _converted(name: str, kind: T.DataType) -> Column:
    cell = col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return cell
    if isinstance(kind, T.DateType):
        return F.try_to_date(F.trim(cell), "yyyy-MM-dd")
    value = cell.try_cast(kind)
    return F.when(~F.isnan(value), value) if isinstance(kind, T.DoubleType) else value


def _fault(name: Column, value: Column) -> Column:
    return F.struct(name.alias("column_name"), value.alias("value"))


def marked_rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of ``<folder>/<name>.csv`` by contract, with their faults and original cells."""
    columns = C.RAW[name].columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _RECORD]])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", _RECORD)
    rows = open_csv(reader, folder, name)
    faults = [F.when(col(_RECORD).isNotNull(), _fault(F.lit(CELLS), col(_RECORD)))]
    for column, kind in columns.items():
        cell = col(f"`{column}`")
        wrong = (F.trim(cell) != "") & _converted(column, kind).isNull()
        faults.append(F.when(wrong, _fault(F.lit(column), cell)))
    found = F.array_compact(F.array(*faults))
    original = F.to_json(F.struct(*[f"`{c}`" for c in columns]), {"ignoreNullFields": "false"})
    return rows.select(
        *[_converted(c, kind).alias(c) for c, kind in columns.items()],
        found.alias(_FAULTS),
        F.when(F.size(found) > 0, original).alias(_RECORD),
        F.when(F.size(found) > 0, col(C.RAW[name].key[0])).alias("_key"),
    )


def read_checked_bundle(spark: SparkSession, folder: str, area: StagingArea) -> CheckedBundle:
    """All five tables with their quarantine; one error names every missing source."""
    marked = each_source(lambda name: marked_rows(spark, folder, name), folder)
    tables, clean, faults = {}, {}, []
    for name, rows in marked.items():
        kept, columns = area.put(f"checked_{name}", rows), list(C.RAW[name].columns)
        tables[name] = kept.select(*columns)
        clean[name] = kept.where(F.size(_FAULTS) == 0).select(*columns)
        faults.append(
            kept.where(F.size(_FAULTS) > 0)
            .select("_key", _RECORD, F.posexplode(_FAULTS).alias("place", "found"))
            .select(
                F.lit(name).alias("table_name"),
                col("_key").alias("row_key"),
                (col("place") + 1).alias("fault"),
                "found.column_name",
                "found.value",
                col(_RECORD).alias("record"),
            )
        )
    return CheckedBundle(tables, clean, stacked(faults))
