"""A training corpus from raw documents: filter, deduplicate, mix, pack.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with
the columns of ``documents``; the last returns the packed pieces. Every hand-over is a written
table in the folder that ``spark.checkpoint.dir`` names, so a lost executor costs one stage.

Defined cases are those of the operators; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm import exact, mixing, near, packing, quality
from pricelens.llm.ship import on_executors
from pricelens.llm.tables import area, table


@on_executors
def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on ``labels``, rejects."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.drop_low_quality(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest identifier of each text."""
    return exact.drop_exact_copies(spark, docs, keep="largest")


@on_executors
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near.drop_near_copies(spark, docs)


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights of sources, languages and topics.

    A value that has fewer tokens than its weight asks of the budget is kept whole.
    """
    return mixing.sample_mixture(spark, docs)


@on_executors
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return packing.pack(spark, docs, added=True)


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", sample_to_targets),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier; tests compare each stage with a plain one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    place = area(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = place.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
