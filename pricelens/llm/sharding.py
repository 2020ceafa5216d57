"""Contiguous shards of equal bytes, cut from one global prefix sum of sizes.

Rows are put in one order over the whole table: by text digest, then identifier, so equal texts
lie side by side. The order is written in ranges (chunks), none of which is a group: a text that
fills a third of the table spans as many chunks as it needs. The bytes before a row are those of
the earlier chunks, one total per chunk, and those before it in its own chunk. With ``total``
bytes in all, the row whose middle lies at byte ``m`` goes to shard ``floor(m * shards / total)``:
every shard is a contiguous stretch of the order, and each cut is at most half a row off its
target. Slots count rows in the same order, from 0 in every shard.

What moves is a digest, an identifier and three numbers a row; ``write_shards`` moves whole rows,
once, as files in this order need.

Defined cases: a NULL text has no bytes; NULL identifiers come first among equal texts; rows that
repeat text and identifier are ordered by a hash of all their columns, and rows equal in every
column by chance, which changes no result; a row larger than a target takes it all, and a shard
may then be empty; an empty table gives an empty result; further columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.crc_sql import REMAINDERS, crc32
from pricelens.llm.tables import area, column, table, whole_rows
from pricelens.operators.ordered import running_before

#: Shards of the registered query, and what a row takes beside its text.
SHARDS, ROW_BYTES = 40, 16
_ORDER = ["digest", "id", "tie"]


def _placed(
    spark: SparkSession,
    docs: DataFrame,
    shards: int,
    id_column: str,
    text_column: str,
    row_bytes: int,
    with_rows: bool,
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row, and the row itself if asked."""
    if shards < 1 or row_bytes < 0:
        raise ValueError("there must be a shard, and sizes are not negative")
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    sized = docs.select(
        column(id_column).alias("id"),
        F.unhex(F.md5(text)).alias("digest"),
        (F.octet_length(text).cast("long") + row_bytes).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole_rows(docs)).alias("tie"),
        *([whole_rows(docs).alias("document")] if with_rows else []),
    )
    staged = area(spark).put_in_order("sizes", sized, *_ORDER)
    summed = running_before(staged, [], _ORDER, before=F.col("size"), place=F.lit(1).cast("long"))
    twice = "CAST(before AS DECIMAL(20)) * 2 + size"
    cut = F.expr(f"({twice}) * {int(shards)} div greatest(CAST(before_total AS DECIMAL(20)) * 2, 1)")
    dealt = summed.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    # One row per shard, so the hint is safe at any size of the table.
    firsts = F.broadcast(dealt.groupBy("shard").agg(F.min("place").alias("first")))
    return dealt.join(firsts, "shard").select(
        "id",
        "size",
        "text_crc32",
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        *(["document"] if with_rows else []),
    )


def contiguous_shards(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 length of the text and ``row_bytes``; shards hold nearly equal sums.
    """
    return _placed(spark, docs, shards, id_column, text_column, row_bytes, False)


def write_shards(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Writes the rows to ``path/shard=N`` in slot order; returns rows and bytes per shard.

    A file row is ``slot``, ``size`` and ``document`` (all input columns), so no name can clash.
    Every file holds a stretch of consecutive slots.
    """
    placed = _placed(spark, docs, shards, id_column, text_column, row_bytes, True)
    rows = placed.select("shard", "slot", "size", "document").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
    kept = spark.read.schema("slot long, size long, shard int").parquet(path)
    return kept.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = contiguous_shards(spark, table(spark, folder, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP13_SQL = f"""
WITH {REMAINDERS},
sized AS (
  SELECT doc_id, coalesce(text, '') AS body, md5(coalesce(text, '')) AS digest,
         octet_length(encode(coalesce(text, ''))) + 16 AS size
  FROM documents
),
summed AS (
  SELECT *, sum(size) OVER same - size AS before, sum(size) OVER () AS total, row_number() OVER same AS place
  FROM sized
  WINDOW same AS (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
),
dealt AS (
  SELECT *, CAST((2 * before + size) * 40 // (2 * total) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size, {crc32("body")} AS text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, remainders
"""
