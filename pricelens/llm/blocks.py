"""Exact comparison inside large groups: blocks that meet pairwise, each pair in some task.

A group is any set of rows that have to meet: the members of a bucket or of a component. Some
of them are settled among each other already; only pairs with an ``outside`` member are open.
Rows are dealt into blocks of about ``size`` rows by a hash of their key, and every block of
outside members meets each other block once. A task holds two blocks at a time, whatever the
size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired_blocks(members: DataFrame, carried: list[str], size: int) -> DataFrame:
    """Rows (meeting, sides, side, carried columns) of ``members`` (bucket, key, outside).

    In a meeting of one side all pairs are open, in one of two sides those across.
    """
    n = members.groupBy("bucket", "outside").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
    counts = n.groupBy("bucket").agg(
        F.max(F.when(F.col("outside"), F.col("n"))).cast("int").alias("n_out"),
        F.coalesce(F.max(F.when(~F.col("outside"), F.col("n"))), F.lit(0)).cast("int").alias("n_in"),
    )
    blocks = F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_in"))
    dealt = members.join(counts.where("n_out > 0"), "bucket").withColumn(
        "own", F.pmod(F.xxhash64("key"), blocks).cast("int")
    )
    out, in_ = dealt.where("outside"), dealt.where(~F.col("outside"))
    own, other = F.col("own"), F.col("other")

    def met(frame: DataFrame, kind: int, count: str, pair: tuple, sides: Column, side: Column):
        each = frame.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
        name = F.xxhash64("bucket", F.lit(kind), *pair).alias("meeting")
        return each.select(name, sides.alias("sides"), side.alias("side"), *carried)

    among = (F.least(own, other), F.greatest(own, other))
    one_or_two = F.when(own == other, 1).otherwise(2)
    return (
        met(out, 0, "n_out", among, one_or_two, own)
        .unionByName(met(out.where("n_in > 0"), 1, "n_in", (own, other), F.lit(2), F.lit(0)))
        .unionByName(met(in_, 1, "n_out", (other, own), F.lit(2), F.lit(1)))
    )


def gathered(meetings: DataFrame) -> DataFrame:
    """Brings the rows of each meeting together, one after the other."""
    return meetings.repartition("meeting").sortWithinPartitions("meeting")


def meetings_of(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[bool, pa.Table | None]]:
    """(whether an input batch ended, rows of a meeting): whole meetings, in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = batch.column("meeting").to_numpy()
        cuts = [0, *((names[1:] != names[:-1]).nonzero()[0] + 1).tolist(), len(names)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column("meeting")[0] != batch.column("meeting")[a]:
                yield False, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        yield True, None
    if held:
        yield False, pa.Table.from_batches(held)
    yield True, None
