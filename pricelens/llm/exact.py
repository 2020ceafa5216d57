"""Exact dedup: sorted digest runs, merged in binomial rounds.

Every input partition is one run. A run holds each text once, as its digest with the best
identifier and the number of rows. In each round ``fan_in`` neighbouring runs exchange their
entries by digest and are merged; the merge keeps the best identifier. The last round leaves
one run for the whole corpus, spread over tasks by digest. Texts never leave the first scan:
what moves is a digest, a length and an identifier. A group of copies, however large, is one
entry per run before its first shuffle.

Two texts are equal when SHA-256, byte length and a second, unrelated 64-bit hash all agree;
that is the check that every merge makes.

Defined cases: a NULL text counts as the empty text; NULL identifiers lose against any other
and stay only where all are NULL; of rows that repeat the best identifier with the same text,
one stays; an empty table gives an empty result; further columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, rows_that_stay, table

FAN_IN = 8
_KEYS = ("digest", "n_bytes", "check")


def _fingerprint(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(whole).alias("n_bytes"),
        F.xxhash64(whole).alias("check"),
    ]


def merged_runs(entries: DataFrame, largest: bool, fan_in: int = FAN_IN) -> DataFrame:
    """One row per text: ``best`` (identifier, row number) and ``size``, by rounds of merges.

    ``entries`` has ``run``, the fingerprint, ``id`` and ``row``. The extreme of a struct is a
    sort aggregate in Spark, so each run is sorted by digest before and after its exchange.
    """
    # NULL sorts before every value: it must lose in both directions.
    has_id = F.col("id").isNotNull() if largest else F.col("id").isNull()
    extreme = F.max if largest else F.min
    runs = entries.select(
        "run",
        *_KEYS,
        F.struct(has_id.alias("known"), "id", "row").alias("best"),
        F.lit(1).cast("long").alias("size"),
    )
    count = (entries.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        count = -(-count // fan_in)
        group = F.floor(F.col("run") / fan_in).cast("long").alias("run")
        runs = runs.groupBy(group, *_KEYS).agg(
            extreme("best").alias("best"), F.sum("size").alias("size")
        )
        if count == 1:
            return runs.drop("run")


def _entries(spark: SparkSession, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The fingerprint of every row, written once: row numbers must not change in a retry."""
    found = docs.select(
        column(id_column).alias("id"),
        *_fingerprint(column(text_column)),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().cast("long").alias("run"),
    )
    return area(spark).put("digest_runs", found)


def exact_groups(
    spark: SparkSession,
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the identifier that stays in a group: ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest") or fan_in < 2:
        raise ValueError("keep is smallest or largest, fan_in at least 2")
    entries = _entries(spark, docs, id_column, text_column)
    groups = merged_runs(entries, keep == "largest", fan_in)
    return entries.join(groups, list(_KEYS)).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(
    spark: SparkSession,
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    fan_in: int = FAN_IN,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    entries = _entries(spark, docs, id_column, text_column)
    groups = merged_runs(entries, keep == "largest", fan_in)
    winners = groups.select(*_KEYS, F.col("best.id").alias("id"))
    names = entries.groupBy(*_KEYS, "id").count().where("count > 1").select(*_KEYS, "id")
    repeated = area(spark).put("repeated", names)
    keys = dict(zip(_KEYS, _fingerprint(column(text_column)), strict=True))
    return rows_that_stay(docs, column(id_column), keys, winners, repeated)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_groups(spark, docs, keep="largest").withColumnRenamed("id", "doc_id")


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
