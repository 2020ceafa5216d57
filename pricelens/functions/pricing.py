"""Order-line expressions: money, margins, discount classes, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import flag, ratio

col = F.col


def line_amounts() -> dict[str, Column]:
    """Extended list value, revenue and cost of a line."""
    quantity = col("quantity")
    return {
        "line_list_revenue": quantity * col("list_price_at_sale"),
        "line_revenue": quantity * col("realized_unit_price"),
        "line_cost": quantity * col("unit_cost"),
    }


def gross_margin() -> Column:
    return col("line_revenue") - col("line_cost")


def margin_pct() -> Column:
    return ratio(col("gross_margin_value"), col("line_revenue"))


def price_realization() -> Column:
    return ratio(col("realized_unit_price"), col("list_price_at_sale"))


def discount_bucket(depth: Column) -> Column:
    """Upper-closed depth class; NULL depth has none."""
    label = F.when(depth.isNull(), F.lit(None).cast("string"))
    for upper, name in P.DISCOUNT_BUCKETS:
        label = label.when(depth <= upper, name)
    return label.otherwise(P.LAST_DISCOUNT_BUCKET)


def bucket_order(bucket: Column) -> Column:
    """Position of a bucket label in depth order."""
    labels = [name for _, name in P.DISCOUNT_BUCKETS] + [P.LAST_DISCOUNT_BUCKET]
    return F.array_position(F.array(*[F.lit(x) for x in labels]), bucket)


def at_least(depth: Column, threshold: float) -> Column:
    return flag(depth >= F.lit(threshold))


def residual(baseline: Column) -> Column:
    """Relative gap of a line's price realization to its peer baseline."""
    gap = (col("line_price_realization") - baseline) / baseline
    return F.when(baseline > 0, gap).otherwise(F.lit(0.0))


def order_month(day: Column) -> Column:
    return F.trunc(day, "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def order_quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def tenure_band(days: Column) -> Column:
    """Left-open, right-closed tenure class; 0 days or fewer has none."""
    band = F.when(days <= 0, F.lit(None).cast("string"))
    for upper, name in P.TENURE_BANDS:
        band = band.when(days <= upper, name)
    return band


def scope_columns(policy: P.Policy = P.POLICY) -> dict[str, Column]:
    """High-discount revenue, margin-at-risk revenue and discount leakage of a line."""
    high = col("discount_depth") >= F.lit(policy.high_discount)
    exposed = high & (col("margin_proxy_pct") < F.lit(policy.margin_at_risk))
    revenue = col("line_revenue")
    return {
        "high_discount_revenue": F.when(high, revenue).otherwise(F.lit(0.0)),
        "margin_at_risk_revenue": F.when(exposed, revenue).otherwise(F.lit(0.0)),
        "discount_leakage_value": col("line_list_revenue") - revenue,
    }


def dashboard_columns(policy: P.Policy = P.POLICY) -> dict[str, Column]:
    """The additive measures the dashboard facts sum."""
    scoped = scope_columns(policy)
    return {
        "discount_weighted_num": col("discount_depth") * col("line_list_revenue"),
        "high_discount_revenue": scoped["high_discount_revenue"],
        "margin_risk_revenue": scoped["margin_at_risk_revenue"],
    }
