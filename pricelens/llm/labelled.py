"""The labelled texts that the classifiers are fitted on: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import column

#: A classifier that learns in one task takes at most this many; a hash of the id decides which.
MAX_TRAINING_DOCS = 12_000


def held_out(id_column: str, parts: int, part: int):
    """Whether a document is held out: crc32 of its id as text, modulo ``parts``, is ``part``."""
    id_ = F.coalesce(column(id_column).cast("string"), F.lit(""))
    return F.crc32(id_) % parts == part


def training_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    part: int,
    most: int | None = MAX_TRAINING_DOCS,
) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` documents that are not held out; None: of all.

    A document labelled more than once counts with its largest label; an id with several texts
    with its smallest text. Ids bounded by ``most`` are broadcast, so only the texts of the
    sample are shuffled; without a bound the optimizer chooses the join.
    """
    chosen = (
        labels.select(column("doc_id"), column(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out("doc_id", parts, part))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    if most is not None:
        chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(column("doc_id"), F.coalesce(column("text"), F.lit("")).alias("text"))
    return (
        texts.join(chosen, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
