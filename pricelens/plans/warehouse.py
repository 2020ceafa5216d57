"""The tables every plan reads, each built once per warehouse."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import on_grid
from pricelens.plans import customers, dashboard, fact, marts, risk
from pricelens.sources import tpch
from pricelens.sources.area import StagingArea
from pricelens.sources.staging import staged_tables

# Lines in a task that sums them by customer and another column: about 200 MB of groups.
LINES_A_TASK = 250_000


class Warehouse:
    """A snapshot of the five input tables and what is derived from them.

    The star join, the peer baseline, the order ledger, the customer profile, the scores and
    the marts that need ordered scans are written to the shared folder on first use: dozens
    of plans read them, and a written table keeps their scans narrow and their lineage short.
    Plans with quantiles or ranks also write what they put in order. Other tables are views.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: Mapping[str, DataFrame],
        area: StagingArea | None = None,
        policy: P.Policy = P.POLICY,
    ) -> None:
        self.spark = spark
        self.raw = dict(raw)
        self.area = area or StagingArea(spark)
        self.policy = policy
        self._kept: dict[str, Any] = {}

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Remove all tables that this warehouse staged."""
        self.area.close()

    def once(self, name: str, build: Callable[[], Any]) -> Any:
        """Build something on first use and keep it with the warehouse."""
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Warehouse:
        return cls(spark, tpch.raw_tables(spark, folder))

    @cached_property
    def staged(self) -> dict[str, DataFrame]:
        """The staging models; products and reps are written, so their true size decides the join.

        A grouped or derived table is only estimated, and never small at scale: lines would
        be shuffled on a few product ids, and order headers on a few reps, to meet it.
        """
        models = staged_tables(self.raw)
        written = ("products", "sales_reps")
        return models | {name: self.area.put(name, models[name]) for name in written}

    @cached_property
    def enriched(self) -> DataFrame:
        """The star join, stored as the join leaves it, lines of an order together.

        Moving all lines once more, to store them by customer, costs more than the partial
        sums per customer that this saves.
        """
        return self.area.put("order_item_enriched", fact.enriched(self.staged))

    @cached_property
    def lines(self) -> DataFrame:
        """The pricing fact."""
        return fact.pricing_metrics(self.enriched, self.policy, self.peer_baseline)

    @cached_property
    def lines_by_customer(self) -> DataFrame:
        """The pricing fact with all lines of a customer in one partition.

        For plans that count distinct values beside other sums per customer: over ``lines`` they
        shuffle the buffers of all sums per customer and value, nearly one row per line, and the
        merged buffers once more. Here the stored columns a plan reads move once, and everything
        per customer is summed where it lies. The number of lines decides the number of tasks, so
        that their groups fit in memory; a customer with many lines adds time, not groups.
        """
        tasks = self.enriched.count() // LINES_A_TASK + 1
        placed = self.enriched.repartition(tasks, "customer_id")
        return fact.pricing_metrics(placed, self.policy, self.peer_baseline)

    @cached_property
    def peer_baseline(self) -> DataFrame:
        """Mean realization per product and channel, computed once and of known size.

        Written on a fixed binary grid: the order in which tasks add up would else show in the
        last bits, and in every residual of a product with it.
        """
        mean = on_grid(F.col("peer_price_realization"), P.SUM_BITS)
        table = fact.peer_baseline(self.enriched).withColumn("peer_price_realization", mean)
        return self.area.put("peer_baseline", table)

    @cached_property
    def ledger(self) -> DataFrame:
        """Order-level facts, stored in customer and date order."""
        return self.area.put_in_order(
            "order_ledger", customers.order_level(self.lines), *customers.LEDGER_ORDER
        )

    @cached_property
    def profile(self) -> DataFrame:
        """Customer measures, stored on the same grid as the peer baseline."""
        table = customers.profile(self.lines, self.ledger)
        doubles = [name for name, kind in table.dtypes if kind == "double"]
        stored = {name: on_grid(F.col(name), P.SUM_BITS) for name in doubles}
        return self.area.put("customer_pricing_profile", table.withColumns(stored))

    @cached_property
    def scores(self) -> DataFrame:
        return self.area.put("customer_risk_scores", risk.scored(self.area, self.profile, self.policy))

    @cached_property
    def median_discounts(self) -> DataFrame:
        return self.area.put("median_discounts", marts.median_discounts(self.area, self.lines))

    @cached_property
    def segments(self) -> DataFrame:
        """Segment summary with sample spread and residual columns."""
        table = marts.segment_summary(self.area, self.lines, self.median_discounts)
        return self.area.put("segment_pricing_summary", table)

    @cached_property
    def segment_mart(self) -> DataFrame:
        """Segment summary with population spread."""
        table = marts.segment_mart(self.area, self.lines, self.median_discounts)
        return self.area.put("mart_segment_pricing_summary", table)

    @cached_property
    def account_facts(self) -> DataFrame:
        """Month by dimension facts of every account."""
        return self.area.put("account_facts", dashboard.customer_facts(self.lines, policy=self.policy))

    @cached_property
    def scope_facts(self) -> DataFrame:
        """Month by dimension facts behind every dashboard slice."""
        return self.area.put("scope_facts", dashboard.monthly_facts(self.lines, self.policy))

    def derived_tables(self) -> dict[str, DataFrame]:
        return {
            "order_item_enriched": self.enriched,
            "order_item_pricing_metrics": self.lines,
            "customer_pricing_profile": self.profile,
            "segment_pricing_summary": self.segments,
            "segment_channel_diagnostics": marts.segment_channel(self.lines),
            "customer_risk_scores": self.scores,
            "risk_tier_summary": risk.tier_summary(self.scores),
            "main_driver_summary": risk.driver_summary(self.scores),
        }
