"""Histograms, tail collapsing, sections by dimension, table rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import half_even, linear_step

col = F.col


def histogram(table: DataFrame, value: Column, cells: int) -> DataFrame:
    """Equal-width counts over the observed range: ``bin, lower, upper, rows``.

    The range is a one-row subquery, the count a map-side aggregate on the cell number;
    empty cells are listed with 0.
    """
    values = table.select(value.alias("value")).where(col("value").isNotNull())
    edges = values.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    span = edges.select(F.struct("low", "high")).scalar()
    filled = (
        values.withColumn("span", span)
        .select(linear_step(col("value"), col("span.low"), col("span.high"), cells).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    width = (col("high") - col("low")) / F.lit(float(cells))
    frame = edges.select(
        "low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("bin")
    ).withColumn("bin", col("bin").cast("long"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (col("low") + col("bin") * col("width")).alias("lower"),
        (col("low") + (col("bin") + 1) * col("width")).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def density(table: DataFrame, x: Column, y: Column, cells: int) -> DataFrame:
    """Square-cell counts over two observed ranges; only cells that hold rows."""
    points = table.select(x.alias("x"), y.alias("y")).where(
        col("x").isNotNull() & col("y").isNotNull()
    )
    span = points.agg(
        F.struct(
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
        )
    ).scalar()
    return (
        points.withColumn("s", span)
        .groupBy(
            linear_step(col("x"), col("s.x0"), col("s.x1"), cells).alias("x_bin"),
            linear_step(col("y"), col("s.y0"), col("s.y1"), cells).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def collapse_tail(
    table: DataFrame,
    label: str,
    value: str,
    most: int = P.COLLAPSE_MAX_ROWS,
    rest: str = P.COLLAPSE_LABEL,
) -> DataFrame:
    """Keep the ``most - 1`` largest rows and add up the others, if there are more than ``most``.

    The head is a distributed top-k; nothing else is ordered.
    """
    head = table.orderBy(col(value).desc(), label).limit(most - 1).select(col(label).alias("_kept"))
    size = table.agg(F.count(F.lit(1))).scalar()
    tagged = table.join(F.broadcast(head), col(label) == col("_kept"), "left")
    shown = F.when((size <= most) | col("_kept").isNotNull(), col(label)).otherwise(rest)
    return tagged.groupBy(shown.alias(label)).agg(F.sum(value).alias(value))


def by_dimension(table: DataFrame, dimensions: Sequence[str], **measures: Column) -> DataFrame:
    """One scan grouped by each dimension on its own: ``dimension, value`` and the measures."""
    marks = [F.grouping(d).alias(f"_{d}") for d in dimensions]
    grouped = table.groupingSets([[d] for d in dimensions], *dimensions).agg(
        *marks, *[measure.alias(name) for name, measure in measures.items()]
    )
    which = F.coalesce(*[F.when(col(f"_{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(col(f"_{d}") == 0, col(d).cast("string")) for d in dimensions])
    return grouped.select(which.alias("dimension"), value.alias("value"), *measures)


def round_columns(table: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round the named columns half to even; columns the table lacks are ignored."""
    present = {name: n for name, n in digits.items() if name in table.columns}
    return table.withColumns(
        {name: half_even(col(name).cast("double"), n) for name, n in present.items()}
    )


def top_per_group(
    table: DataFrame, group: Sequence[str], order: Sequence[Column], most: int
) -> DataFrame:
    """First ``most`` rows of each group; Spark cuts every task to ``most`` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return table.withColumn("_place", place).where(col("_place") <= most).drop("_place")
