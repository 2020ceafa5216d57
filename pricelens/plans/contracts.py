"""Metric contracts: declared expectations per table, checked in one aggregate each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import count_if
from pricelens.operators.checks import as_rows, stacked, status, text
from pricelens.operators.links import Link, figure, link_facts

col = F.col
Bound = tuple[float | None, float | None]


@dataclass(frozen=True)
class Contract:
    """What a table promises; ``bounds`` are (lowest, highest), None leaves an end open."""

    columns: tuple[str, ...]
    not_null: tuple[str, ...]
    key: tuple[str, ...] = ()
    bounds: Mapping[str, Bound] = field(default_factory=dict)
    allowed: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


_SHARE: Bound = (0.0, 1.0)
_DEPTH: Bound = (0.0, P.DISCOUNT_MAX)
_SCORE: Bound = (0.0, 100.0)
_POSITIVE: Bound = (0.0, None)

# The contracted columns, limits and labels.
CONTRACTS = {
    "order_item_pricing_metrics": Contract(
        columns=(
            "order_item_id", "order_id", "order_date", "order_month", "customer_id",
            "product_id", "segment", "region", "category", "sales_channel", "line_revenue",
            "line_list_revenue", "realized_price", "list_price_at_sale", "discount_depth",
            "line_price_realization", "price_realization_residual_pct", "high_discount_flag",
            "margin_proxy_pct",
        ),
        not_null=(
            "order_item_id", "order_id", "order_date", "order_month", "customer_id",
            "product_id", "line_revenue", "line_list_revenue", "discount_depth",
            "line_price_realization", "price_realization_residual_pct", "high_discount_flag",
            "margin_proxy_pct",
        ),
        key=("order_item_id",),
        bounds={
            "line_revenue": _POSITIVE,
            "line_list_revenue": _POSITIVE,
            "realized_price": _POSITIVE,
            "list_price_at_sale": _POSITIVE,
            "discount_depth": _DEPTH,
            "line_price_realization": _SHARE,
            "high_discount_flag": _SHARE,
            "margin_proxy_pct": (-0.25, 1.0),
        },
    ),
    "customer_pricing_profile": Contract(
        columns=(
            "customer_id", "segment", "region", "total_orders", "total_revenue",
            "avg_discount_pct", "weighted_discount_pct", "share_orders_discounted",
            "share_orders_high_discount", "revenue_high_discount_share", "avg_margin_proxy_pct",
            "realized_price_cv", "avg_abs_price_realization_residual_pct",
            "repeat_discount_behavior",
        ),
        not_null=(
            "customer_id", "total_orders", "total_revenue", "avg_discount_pct",
            "weighted_discount_pct", "share_orders_discounted", "share_orders_high_discount",
            "revenue_high_discount_share", "avg_margin_proxy_pct", "realized_price_cv",
            "avg_abs_price_realization_residual_pct", "repeat_discount_behavior",
        ),
        key=("customer_id",),
        bounds={
            "total_orders": (1.0, None),
            "total_revenue": _POSITIVE,
            "avg_discount_pct": _DEPTH,
            "weighted_discount_pct": _DEPTH,
            "share_orders_discounted": _SHARE,
            "share_orders_high_discount": _SHARE,
            "revenue_high_discount_share": _SHARE,
            "avg_margin_proxy_pct": _SHARE,
            "realized_price_cv": _POSITIVE,
            "avg_abs_price_realization_residual_pct": _POSITIVE,
            "repeat_discount_behavior": _SHARE,
        },
    ),
    "customer_risk_scores": Contract(
        columns=(
            "customer_id", "pricing_risk_score", "discount_dependency_score",
            "margin_erosion_score", "governance_priority_score", "main_risk_driver",
            "risk_tier", "recommended_action", "low_data_flag",
        ),
        not_null=(
            "customer_id", "pricing_risk_score", "discount_dependency_score",
            "margin_erosion_score", "governance_priority_score", "main_risk_driver",
            "risk_tier", "recommended_action", "low_data_flag",
        ),
        key=("customer_id",),
        bounds={
            "pricing_risk_score": _SCORE,
            "discount_dependency_score": _SCORE,
            "margin_erosion_score": _SCORE,
            "governance_priority_score": _SCORE,
            "low_data_flag": _SHARE,
        },
        allowed={
            "risk_tier": P.TIERS_ASCENDING,
            "main_risk_driver": tuple(P.COMPONENTS),
            "recommended_action": P.ACTIONS,
        },
    ),
    "segment_pricing_summary": Contract(
        columns=(
            "segment", "total_revenue", "avg_discount_pct", "median_discount_pct",
            "share_high_discount", "avg_margin_proxy_pct", "price_realization_residual_std",
            "price_realization_residual_abs_mean", "margin_erosion_proxy",
        ),
        not_null=(
            "segment", "total_revenue", "avg_discount_pct", "median_discount_pct",
            "share_high_discount", "avg_margin_proxy_pct", "price_realization_residual_std",
            "price_realization_residual_abs_mean", "margin_erosion_proxy",
        ),
        key=("segment",),
        bounds={
            "total_revenue": _POSITIVE,
            "avg_discount_pct": _DEPTH,
            "share_high_discount": _SHARE,
            "avg_margin_proxy_pct": _SHARE,
            "price_realization_residual_abs_mean": _POSITIVE,
            "margin_erosion_proxy": _POSITIVE,
        },
    ),
    "overall_pricing_health": Contract(
        columns=(
            "total_revenue", "weighted_realized_discount", "price_realization",
            "high_discount_revenue_share", "margin_proxy_pct",
        ),
        not_null=(
            "total_revenue", "weighted_realized_discount", "price_realization",
            "high_discount_revenue_share", "margin_proxy_pct",
        ),
        bounds={
            "total_revenue": _POSITIVE,
            "weighted_realized_discount": _SHARE,
            "price_realization": _SHARE,
            "high_discount_revenue_share": _SHARE,
            "margin_proxy_pct": _SHARE,
        },
    ),
}


def _row(table: str, check: str, passed: Column, detail: Column, severity: str = "High") -> dict:
    return {
        "contract_table": table,
        "check_name": check,
        "status": status(passed),
        "severity": severity,
        "detail": detail,
    }


def _outside(name: str, bound: Bound) -> Column:
    """Non-NULL values that are not numbers or lie outside the bound."""
    number = col(name).try_cast("double")
    broken = col(name).isNotNull() & (number.isNull() | F.isnan(number))
    low, high = bound
    if low is not None:
        broken = broken | (number < low)
    if high is not None:
        broken = broken | (number > high)
    return count_if(F.coalesce(broken, F.lit(False)))


def check_contract(
    name: str, table: DataFrame | None, contract: Contract, keys: Column | None = None
) -> DataFrame | None:
    """The report rows of one table.

    Counts, null rates, bounds and labels share one aggregate that combines map-side; ``keys``
    are the figures of ``link_facts`` on the keys of all tables.
    """
    if table is None:
        return None
    missing = [c for c in contract.columns if c not in table.columns]
    measures = [F.count(F.lit(1)).alias("rows")]
    if not missing:
        measures += [F.sum(col(c).isNull().cast("long")).alias(f"null_{c}") for c in contract.not_null]
        measures += [_outside(c, b).alias(f"bound_{c}") for c, b in contract.bounds.items()]
        measures += [
            count_if(col(c).isNotNull() & ~col(c).isin(*labels)).alias(f"label_{c}")
            for c, labels in contract.allowed.items()
        ]
    facts = table.agg(*measures)
    rows, width = col("rows"), len(table.columns)
    basics = [
        _row(name, "table_exists", F.lit(True), text(f"rows=%d cols={width}", rows), "Low"),
        _row(name, "row_count_positive", rows > 0, text("rows=%d", rows)),
        _row(
            name,
            "required_columns_present",
            F.lit(not missing),
            F.lit("missing=" + ", ".join(missing) if missing else "all present"),
        ),
    ]
    report = as_rows(facts, basics)
    if missing:
        return report
    details = []
    if contract.key and keys is not None:
        facts = facts.withColumn("links", keys)
        facts = facts.withColumn("dup", figure(name, "duplicate_rows"))
        label = ", ".join(contract.key)
        details.append(
            _row(
                name,
                "primary_key_uniqueness",
                col("dup") == 0,
                text(f"primary_key={label}, duplicate_rows=%d", col("dup")),
            )
        )
    worst = F.greatest(*[col(f"null_{c}") for c in contract.not_null], F.lit(0)) / rows
    details.append(
        _row(name, "key_null_rate", worst == 0, text("max_null_rate=%.4f", worst))
    )
    details += [
        _row(
            name,
            f"bound_{c}",
            col(f"bound_{c}") == 0,
            text(f"violations=%d, min={low}, max={high}", col(f"bound_{c}")),
        )
        for c, (low, high) in contract.bounds.items()
    ]
    details += [
        _row(
            name,
            f"allowed_values_{c}",
            col(f"label_{c}") == 0,
            text("invalid_rows=%d", col(f"label_{c}")),
        )
        for c in contract.allowed
    ]
    return report.unionByName(as_rows(facts.where(rows > 0), details))


def contract_report(
    tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract] = CONTRACTS
) -> DataFrame:
    """All contract rows; a table that is not given fails its ``table_exists`` check."""
    parts = []
    session = next(iter(tables.values())).sparkSession
    links = [
        Link(name, name, tuple(contract.key))
        for name, contract in contracts.items()
        if contract.key and name in tables and set(contract.columns) <= set(tables[name].columns)
    ]
    # One and the same subquery for all tables, which Spark runs once.
    keys = link_facts(tables, links).scalar() if links else None
    for name, contract in contracts.items():
        part = check_contract(name, tables.get(name), contract, keys)
        if part is None:
            absent = _row(name, "table_exists", F.lit(False), F.lit("table not given"))
            part = as_rows(session.range(1), [absent])
        parts.append(part)
    return stacked(parts)
