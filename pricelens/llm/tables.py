"""Reading the given tables and staging what a plan uses more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.sources.area import StagingArea


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def area(spark: SparkSession) -> StagingArea:
    """A fresh sub-folder of the shared folder that the cluster names."""
    return StagingArea(spark)


def whole_rows(frame: DataFrame) -> Column:
    """All columns of ``frame`` as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{name}`") for name in frame.columns])


def column(name: str) -> Column:
    """A column by its plain name, also when the name holds dots."""
    return F.col(f"`{name}`")


#: Tables of up to this many rows are written in few files, one for so many rows.
SMALL_ROWS, ROWS_PER_FILE = 1_000_000, 250_000


def compact(frame: DataFrame, most: int) -> DataFrame:
    """A frame made of at most ``most`` rows, in few partitions where that is a small number.

    ``most`` must bound what the last stage reads, as that stage runs in these partitions. A
    loop writes many small tables; one file per shuffle partition of each would cost more than
    its rows. Larger frames keep their partitions.
    """
    return frame.coalesce(max(1, -(-most // ROWS_PER_FILE))) if most <= SMALL_ROWS else frame


def is_row_count_at_most(frame: DataFrame, most: int) -> bool:
    """Whether a frame is small enough to broadcast; reads at most ``most + 1`` rows of it."""
    return frame.limit(most + 1).count() <= most


def rows_that_stay(
    docs: DataFrame, id_: Column, keys: dict[str, Column], winners: DataFrame, repeated: DataFrame
) -> DataFrame:
    """The rows of ``docs`` named by ``winners`` (the keys, ``id``), with their columns unchanged.

    ``repeated`` lists those names that several rows have; of these rows one stays, decided by
    the rest of the row. It is a written table, mostly empty, and then costs nothing.
    """
    rows = docs.select(
        whole_rows(docs).alias("whole"), id_.alias("id"), *[c.alias(k) for k, c in keys.items()]
    )

    def named(other: str) -> list[Column]:
        same = [F.col(f"r.{k}") == F.col(f"{other}.{k}") for k in keys]
        return [*same, F.col("r.id").eqNullSafe(F.col(f"{other}.id"))]

    stay = rows.alias("r").join(winners.alias("w"), named("w"), "left_semi")
    if not repeated.isEmpty():
        twice = repeated.select(*keys, "id", F.lit(True).alias("twice"))
        marked = stay.alias("r").join(twice.alias("t"), named("t"), "left").select("r.*", "t.twice")
        groups = marked.where("twice").groupBy(*keys, "id")
        one = groups.agg(F.min_by("whole", F.xxhash64("whole")).alias("whole")).select("whole")
        stay = marked.where(F.col("twice").isNull()).select("whole").unionByName(one)
    return stay.select("whole.*")
