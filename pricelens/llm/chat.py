"""Chat formatting: collapse cumulative snapshots, then render the maximal conversations.

Chat logs often store a conversation again after each turn. A snapshot whose turns are the
first turns of a longer conversation adds nothing. Each turn gets two 64-bit hashes over its
position, role and text; their running XOR along a conversation is a 128-bit hash of every
prefix. Equal conversations are collapsed by the hash of their last prefix; an anti-join
against the proper prefixes of all conversations leaves the maximal ones. Only those are
rendered. The prefixes are made distinct before the shuffle ends, so a first turn or a whole
conversation that a third of the corpus shares is one entry per task.

Defined cases: rows with a NULL conversation belong to none and are left out; turns are
ordered by turn number (NULL first), then role and text; a repeated row is a turn of its own;
a NULL or empty role renders as ``unknown``, a NULL text as the empty text, and NULL and empty
are alike when turns are compared. Of equal conversations the smallest identifier stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, table

TURN_START, ROLE_END, TURN_END = "<|turn|>", "\n", "<|end|>\n"
UNKNOWN_ROLE = "unknown"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place in the conversation and the hash of the turns up to it."""
    told = turns.select(
        column("conv_id"),
        column("turn"),
        F.coalesce(F.nullif(column("role"), F.lit("")), F.lit(UNKNOWN_ROLE)).alias("role"),
        F.coalesce(column("text"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = told.withColumn("place", F.row_number().over(order))
    return placed.select(
        "*",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("text", "place", F.lit(1), "role")).over(so_far).alias("h2"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"),
    )


def maximal_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per conversation that prefixes no longer one: conv_id, n_turns, n_copies, rendered."""
    prefixes = area(spark).put("turn_prefixes", turn_prefixes(turns))
    key = ["place", "h1", "h2"]
    ends = (
        prefixes.where("place = n_turns")
        .groupBy(*key)
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    inner = prefixes.where("place < n_turns").select(*key).distinct()
    kept = area(spark).put("maximal", ends.join(inner, key, "left_anti"))
    return (
        prefixes.join(kept.select("conv_id", "n_copies"), "conv_id")
        .groupBy("conv_id", "n_copies")
        .agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").alias("n_turns"),
            "n_copies",
            F.array_join(
                F.transform(
                    "turns",
                    lambda t: F.concat(
                        F.lit(TURN_START), t["role"], F.lit(ROLE_END), t["text"], F.lit(TURN_END)
                    ),
                ),
                "",
            ).alias("rendered"),
        )
    )


def op3_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return maximal_conversations(spark, table(spark, folder, "conversations"))


# Written from the definition: whole prefixes are compared as text, without hashes.
OP3_SQL = """
WITH told AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM told),
prefixes AS (
  SELECT conv_id, place, n_turns,
         string_agg('<|turn|>' || role || chr(10) || text || '<|end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY place) AS so_far
  FROM placed),
ends AS (
  SELECT so_far, place, min(conv_id) AS conv_id, count(*) AS n_copies
  FROM prefixes WHERE place = n_turns GROUP BY so_far, place)
SELECT conv_id, CAST(place AS INTEGER) AS n_turns, n_copies, so_far AS rendered
FROM ends
WHERE NOT EXISTS (
  SELECT 1 FROM prefixes p
  WHERE p.so_far = ends.so_far AND p.place = ends.place AND p.place < p.n_turns)
"""
