"""Connected components of links, by alternating large and small stars.

Each node is pointed at the smallest node it can see: first from larger neighbours, then
from smaller ones, until all nodes of a component point at its smallest. A node with very many
neighbours is added up per task before its shuffle, and its rows are split by the join, so no
task holds all links of a node. Every half step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.tables import area, compact
from pricelens.sources.area import StagingArea

#: Rounds needed grow with the logarithm of the longest path; this bound is never near.
MOST_ROUNDS = 64


def _large_star(place: StagingArea, links: DataFrame, rows: int) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Written, so that both sides of the join are shuffled anew and a hot node can be split.
    least = place.put("least", compact(least, 2 * rows))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node."""
    place = area(spark)
    told = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = place.put("links", told.distinct())
    rows = links.count()  # no step makes more links than it is given
    state = None
    for _ in range(MOST_ROUNDS):
        links = place.put("large_star", compact(_large_star(place, links, rows), rows))
        links = place.put("small_star", compact(_small_star(links), rows))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now
    raise RuntimeError("components did not settle")
