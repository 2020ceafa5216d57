"""Exact distinct counts of many columns in one pass, as mergeable sets.

Whole numbers and dates whose values fill a good part of their range are sets of bits: each task
makes one bitmap per column and bucket of 32768 numbers, bitmaps of a bucket are joined by OR, and
a count is the number of bits. A key of a trillion rows then moves one bit per row.

All other values are runs of 64-bit keys. For types of up to 64 bits the key is a one-to-one image
of the value; longer values (text) carry a second, unrelated 64-bit hash that must agree as well.
Equal values collapse in their task, whatever their number.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

col = F.col

_SHORT = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.FloatType, T.DoubleType)


def whole_number(value: Column, kind: T.DataType) -> Column | None:
    """The value as a 64-bit number if its type counts in whole steps."""
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    return F.unix_date(value).cast("long") if isinstance(kind, T.DateType) else None


def least_distinct(value: Column) -> Column:
    """An aggregate that no column has fewer different non-NULL values than: the hash slots, of 64,
    that its values fill. One number per task, whatever the values; not exact beyond one value."""
    slot = F.pmod(F.xxhash64(value), F.lit(64)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot)
    return F.bit_count(F.coalesce(F.bit_or(F.when(value.isNotNull(), bit)), F.lit(0).cast("long")))


def _fits_64_bits(kind: T.DataType) -> bool:
    return isinstance(kind, _SHORT) or (isinstance(kind, T.DecimalType) and kind.precision <= 18)


def _cells(table: DataFrame, names: Sequence[str], **parts: Sequence[Column]) -> DataFrame:
    """A row (place, parts) for every known cell; a column is its position in ``names``."""
    structs = [
        F.struct(
            F.lit(i).alias("place"),
            col(f"`{name}`").isNull().alias("unknown"),
            *[columns[i].alias(part) for part, columns in parts.items()],
        )
        for i, name in enumerate(names)
    ]
    cells = table.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
    return cells.where(~col("unknown")).drop("unknown")


def _bit_counts(table: DataFrame, names: Sequence[str], kinds: dict[str, T.DataType]) -> DataFrame:
    codes = [whole_number(col(f"`{name}`"), kinds[name]) for name in names]
    sets = (
        _cells(table, names, code=codes)
        .groupBy("place", F.bitmap_bucket_number("code").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
    )
    return sets.groupBy("place").agg(F.sum(F.bitmap_count("bits")).alias("distinct_count"))


def _run_counts(table: DataFrame, names: Sequence[str], kinds: dict[str, T.DataType]) -> DataFrame:
    values = [col(f"`{name}`") for name in names]
    keys = [F.xxhash64(value) for value in values]
    checks = [
        F.lit(0).cast("long") if _fits_64_bits(kinds[name]) else F.xxhash64(F.lit(1), value)
        for name, value in zip(names, values, strict=True)
    ]
    runs = _cells(table, names, key=keys, check=checks).distinct()
    return runs.groupBy("place").agg(F.count(F.lit(1)).alias("distinct_count"))


def distinct_counts(
    table: DataFrame, columns: Sequence[str], dense: Collection[str] = ()
) -> DataFrame:
    """column_name, distinct_count: different non-NULL values of each column.

    ``dense`` names columns of whole numbers or dates to be counted as bitmaps. The table is
    scanned once for those and once for the others. A column without a value counts 0.
    """
    kinds = {f.name: f.dataType for f in table.schema.fields}
    parts = []
    for count, names in (
        (_bit_counts, [c for c in columns if c in dense]),
        (_run_counts, [c for c in columns if c not in dense]),
    ):
        if names:
            labels = F.array(*[F.lit(name) for name in names])
            all_ = table.sparkSession.range(len(names)).select(
                col("id").cast("int").alias("place"), F.get(labels, col("id").cast("int")).alias("column_name")
            )
            found = all_.join(count(table, names, kinds), "place", "left")
            parts.append(
                found.select("column_name", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"))
            )
    if not parts:
        raise ValueError("no column to count")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
