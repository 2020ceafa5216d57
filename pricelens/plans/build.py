"""The checked way from raw tables to written results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.plans import fact, quality
from pricelens.plans.warehouse import Warehouse
from pricelens.sources.generations import publish_bundle

#: How many failing checks an error names.
NAMED_FAILURES = 10


class CheckFailed(ValueError):
    """A report with failures; ``report`` holds all of its rows."""

    def __init__(self, stage: str, report: DataFrame, failures: list) -> None:
        told = "; ".join(f"{r.check_name}: {r.detail}" for r in failures)
        super().__init__(f"{stage} checks failed: {told}")
        self.stage, self.report = stage, report


def require(stage: str, report: DataFrame) -> DataFrame:
    """The report itself, or ``CheckFailed`` when one of its rows is a FAIL."""
    failed = report.where(F.col("status") == "FAIL").select("check_name", "detail")
    first = failed.orderBy("check_name").limit(NAMED_FAILURES).collect()
    if first:
        raise CheckFailed(stage, report, first)
    return report


def checked_build(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    folder: str | None = None,
    formats: Iterable[str] = ("parquet", "csv"),
    policy: P.Policy = P.POLICY,
    quarantine: DataFrame | None = None,
) -> Warehouse:
    """Checks the raw tables and their links, builds, checks the results and publishes them.

    Nothing is derived from tables that fail, and nothing is published that fails: all results
    become the current bundle of ``folder`` at once (``generations.read_published``). Without a
    ``folder`` they stay in the warehouse's staging area. ``quarantine`` holds the faults of the
    files that ``raw`` was read from.
    """
    require("raw", quality.raw_report(raw, quarantine))
    warehouse = Warehouse(spark, raw, policy=policy)
    fact.check_links(warehouse.staged)
    tables = warehouse.derived_tables()
    require("processed", quality.processed_report(tables, policy))
    if folder is not None:
        publish_bundle(tables, folder, formats)
    return warehouse
