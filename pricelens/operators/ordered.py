"""Running counts, ranks, quantiles and lags that never hold a group in one task.

All of them work on tables staged by ``StagingArea.put_in_order``: rows are cut into
ordered chunks of even size, each chunk is scanned on its own, and the totals of the
earlier chunks (one row per group and chunk) are added afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.numeric import half_even
from pricelens.sources.area import StagingArea

col = F.col

# Entries of a sketch that brackets quantiles, and the share of rows on either side of a quantile
# that its bracket takes in: about three times the sketch's error.
SKETCH_ENTRIES, BRACKET = 4096, 0.003

# A value with at least this fraction (1/1000) of its metric's rows is joined by broadcast.
HEAVY_VALUES = 1000


def carry_in(staged: DataFrame, group: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    """Per group and chunk, the sum of each amount over the earlier chunks of the group.

    ``<name>_total`` is the sum over all chunks: it travels with the chunk sums, so no row
    ever has to be joined on its group alone.
    """
    per_chunk = staged.groupBy(*group, "chunk").agg(
        *[F.sum(amount).alias(name) for name, amount in amounts.items()]
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_chunk.select(
        *group,
        "chunk",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in amounts],
        *[F.sum(name).over(whole).alias(f"{name}_total") for name in amounts],
    )


def running_before(
    staged: DataFrame, group: Sequence[str], order: Sequence[str | Column], **amounts: Column
) -> DataFrame:
    """Add two columns per amount: its sum over the rows that sort before this one, and
    ``<name>_total``, its sum over the group.

    ``order`` must be the order the table was staged in, without the group columns.
    """
    within = (
        Window.partitionBy("chunk", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = staged.select(
        "*",
        *[
            F.coalesce(F.sum(amount).over(within), F.lit(0)).alias(f"_{name}")
            for name, amount in amounts.items()
        ],
    )
    carried = carry_in(staged, group, amounts)
    if not group:
        carried = F.broadcast(carried)  # one row per chunk
    keys = [*group, "chunk"]
    return local.join(carried, keys, "left").select(
        *staged.columns,
        *[(col(f"_{name}") + col(name)).alias(name) for name in amounts],
        *[f"{name}_total" for name in amounts],
    )


def previous_value(
    staged: DataFrame, group: Sequence[str], order: Sequence[str], value: str, default: object
) -> DataFrame:
    """Add ``previous_<value>``: the value of the row before this one in its group.

    The first row of a group within a chunk takes the last value of the group's nearest
    earlier chunk, the very first row takes ``default``.
    """
    out = f"previous_{value}"
    within = Window.partitionBy("chunk", *group).orderBy(*order)
    local = staged.withColumns(
        {"_before": F.lag(value).over(within), "_place": F.row_number().over(within)}
    )
    last = staged.groupBy(*group, "chunk").agg(
        F.max_by(value, F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*group).orderBy("chunk")
    handed = last.select(
        *group, "chunk", F.lag("_last", 1, default).over(across).alias("_handed")
    )
    before = F.when(col("_place") == 1, col("_handed")).otherwise(col("_before"))
    return local.join(handed, [*group, "chunk"], "left").select(
        *staged.columns, F.coalesce(before, F.lit(default)).alias(out)
    )


def value_counts(table: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct non-NULL values per group with their number of rows ``n``.

    Equal values collapse before the shuffle, so a value that fills a third of the table
    is one row per task.
    """
    known = table.where(col(value).isNotNull())
    return known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def value_positions(
    area: StagingArea,
    counts: DataFrame,
    group: Sequence[str],
    value: str,
    chunks: int | None = None,
) -> DataFrame:
    """Add to value counts the rows ``before`` each value and the group's ``total``."""
    staged = area.put_in_order("value_counts", counts, *group, value, chunks=chunks)
    placed = running_before(staged, group, [value], before=col("n")).drop("chunk")
    return placed.withColumnRenamed("before_total", "total")


def percentile_ranks(
    area: StagingArea,
    table: DataFrame,
    key: Sequence[str],
    metrics: Sequence[str],
    chunks: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Per key and metric the average-tie rank divided by the number of non-NULL values.

    ``digits`` rounds the metrics first, for values that differ only by the order in which
    they were summed; without it values are ranked as they are.

    Returns the key with ``<metric>_rank`` (NULL for a NULL metric) and
    ``<metric>_distinct``, the number of different values of the metric. Keys without any
    metric value are absent.
    """
    def ranked_value(metric: str) -> Column:
        number = col(metric).cast("double")
        return number if digits is None else half_even(number, digits)

    rounded = table.select(*key, *[ranked_value(m).alias(m) for m in metrics])
    long = rounded.unpivot(list(key), list(metrics), "metric", "value").where(
        col("value").isNotNull()
    )
    counts = value_counts(long, ["metric"], "value")
    placed = value_positions(area, counts, ["metric"], "value", chunks)
    rank = (col("before") + (col("n") + 1) / 2) / col("total")
    heavy = col("n") * HEAVY_VALUES >= col("total")
    ranks = area.put(
        "value_ranks", placed.select("metric", "value", rank.alias("rank"), heavy.alias("heavy"))
    )
    ranked = _join_ranks(long, ranks)
    wide = ranked.groupBy(*key).agg(
        *[F.max(F.when(col("metric") == m, col("rank"))).alias(f"{m}_rank") for m in metrics]
    )
    distinct = ranks.agg(
        F.struct(*[F.count(F.when(col("metric") == m, F.lit(1))).alias(m) for m in metrics])
    ).scalar()
    return wide.withColumn("_d", distinct).select(
        *key,
        *[f"{m}_rank" for m in metrics],
        *[col(f"_d.{m}").alias(f"{m}_distinct") for m in metrics],
    )


def _join_ranks(long: DataFrame, ranks: DataFrame) -> DataFrame:
    """Give every row the rank of its value, without shuffling rows onto a hot value.

    A value is heavy when it holds at least 1/HEAVY_VALUES of its metric, so there are at
    most HEAVY_VALUES of them per metric: those are broadcast, the others are shuffled.
    """
    on = ["metric", "value"]
    heavy = F.broadcast(ranks.where("heavy").drop("heavy"))
    light = ranks.where(~col("heavy")).drop("heavy")
    common = long.join(heavy, on)
    others = long.join(heavy.drop("rank"), on, "left_anti").join(light, on)
    return common.unionByName(others)


def exact_quantiles(
    area: StagingArea,
    table: DataFrame,
    group: Sequence[str],
    value: str,
    points: Mapping[str, float],
    chunks: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact over all rows.

    ``points`` names an output column for each probability. Spark's own exact percentile
    keeps every distinct value of a group in one buffer; this does not.
    """
    counts = value_counts(table, group, value)
    placed = value_positions(area, counts, group, value, chunks)
    return _interpolated(placed, group, col(value), points)


def _interpolated(
    placed: DataFrame, group: Sequence[str], value: Column, points: Mapping[str, float]
) -> DataFrame:
    """Quantiles from values with their number ``n``, the rows ``before`` them and ``total``."""

    def at(index: Column) -> Column:
        covers = (col("before") <= index) & (index < col("before") + col("n"))
        return F.max(F.when(covers, value))

    picks = []
    for name, probability in points.items():
        place = F.lit(probability) * (col("total") - 1)
        picks += [
            at(F.floor(place)).alias(f"{name}_low"),
            at(F.ceil(place)).alias(f"{name}_high"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    found = placed.groupBy(*group).agg(*picks)
    return found.select(
        *group,
        *[
            (
                col(f"{name}_low")
                + (col(f"{name}_high") - col(f"{name}_low")) * col(f"{name}_part")
            ).alias(name)
            for name in points
        ],
    )


def selected_quantiles(
    area: StagingArea,
    table: DataFrame,
    group: Sequence[str],
    value: str,
    points: Mapping[str, float],
) -> DataFrame:
    """As ``exact_quantiles``, for few groups, by selection: only rows near a quantile are ordered.

    A sketch per group brackets each quantile. One counting pass keeps the values inside the
    brackets, each with its number of rows, and one count for each stretch between them, so the
    places of the kept values are exact. Should a quantile lie outside its bracket, which the
    counts tell, its group is ordered as a whole. There is one row per group in a broadcast.
    """
    known = table.where(col(value).isNotNull()).withColumn(value, col(value).cast("double"))
    sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_ENTRIES))

    def edge(share: float) -> Column:
        rank = F.lit(float(min(max(share, 0.0), 1.0)))
        return F.when(col("n") > 0, F.kll_sketch_get_quantile_double("sketch", rank))

    ends = {name: (edge(p - BRACKET), edge(p + BRACKET)) for name, p in points.items()}
    brackets = area.put(
        "brackets",
        known.groupBy(*group).agg(sketch.alias("sketch"), F.count(value).alias("n")).select(
            *group,
            F.struct(
                *[F.struct(low.alias("low"), high.alias("high")).alias(n) for n, (low, high) in ends.items()]
            ).alias("brackets"),
        ),
    )
    if group:
        placed = known.join(F.broadcast(brackets), list(group))
    else:
        placed = known.withColumn("brackets", brackets.scalar())
    inside, passed = F.lit(False), F.lit(0)
    for name in points:
        low, high = col(f"brackets.{name}.low"), col(f"brackets.{name}.high")
        inside = inside | col(value).between(low, high)
        passed = passed + (col(value) > high).cast("int")
    # Values outside all brackets that have passed equally many of them are neighbours.
    counts = (
        placed.select(*group, value, inside.alias("kept"), F.when(~inside, passed).alias("stretch"))
        .groupBy(*group, "kept", "stretch", F.when(col("kept"), col(value)).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(value))
        .drop("key", "stretch")
    )
    ranked = area.put("bracketed", value_positions(area, counts, group, value))
    found = _interpolated(ranked, group, F.when(col("kept"), col(value)), points)
    found = area.put("quantiles", found)
    missed = F.lit(False)
    for name in points:
        missed = missed | col(name).isNull()
    lost = found.where(missed).select(*group)
    if lost.isEmpty():
        return found
    again = known.join(F.broadcast(lost), list(group), "left_semi") if group else known
    return found.where(~missed).unionByName(exact_quantiles(area, again, group, value, points))
