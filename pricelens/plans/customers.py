"""Order and customer grain: order ledger, repeat behaviour, pricing profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions import measures as A
from pricelens.functions.numeric import ratio
from pricelens.operators.ordered import previous_value
from pricelens.plans.fact import labels

col = F.col

LEDGER_ORDER = ("customer_id", "order_date", "order_id")
PROFILE_COLUMNS = (
    "customer_id",
    "segment",
    "region",
    "company_size",
    "total_orders",
    "total_order_items",
    "total_revenue",
    "avg_discount_pct",
    "weighted_discount_pct",
    "share_order_items_discounted",
    "product_diversity",
    "avg_margin_proxy_pct",
    "realized_price_cv",
    "avg_abs_price_realization_residual_pct",
    "share_orders_discounted",
    "share_orders_high_discount",
    "repeat_discount_behavior",
    "revenue_high_discount_share",
)


def order_level(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id", "order_id", "order_date").agg(
        F.sum("line_revenue").alias("order_revenue"),
        F.avg("discount_depth").alias("order_discount_depth"),
        F.max("high_discount_flag").alias("high_discount_order"),
        F.max("discounted_flag").alias("discounted_order"),
    )


def order_sequence(ledger: DataFrame) -> DataFrame:
    """Each order with the high-discount flag of the customer's order before it (0 if none)."""
    return previous_value(
        ledger, ["customer_id"], ["order_date", "order_id"], "high_discount_order", 0
    )


def order_stats(ledger: DataFrame) -> DataFrame:
    """Order counts, discounted shares and repeat behaviour per customer.

    Repeat behaviour is the number of back-to-back high-discount orders over the number of
    order pairs; one order makes no pair and counts 0.
    """
    pair = col("high_discount_order") * col("previous_high_discount_order")
    orders = ledger.groupBy("customer_id").agg(F.count_distinct("order_id").alias("total_orders"))
    shares = (
        order_sequence(ledger)
        .groupBy("customer_id")
        .agg(
            F.avg("discounted_order").alias("share_orders_discounted"),
            F.avg("high_discount_order").alias("share_orders_high_discount"),
            (F.sum(pair) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias(
                "repeat_discount_behavior"
            ),
        )
    )
    return orders.join(shares, "customer_id")


def profile(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per transacting customer.

    Line measures, the distinct product count, labels and order measures are aggregates of
    their own, joined on the customer they are all shuffled by. A shared aggregate would
    carry every sum through the (customer, product) shuffle of the distinct count. Partial
    sums keep a customer with a third of all lines out of one task.
    """
    spread = F.stddev_pop("realized_price") / F.nullif(F.avg("realized_price"), F.lit(0.0))
    by_customer = lines.groupBy("customer_id").agg(
        A.lines().alias("total_order_items"),
        A.revenue().alias("total_revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        ratio(
            F.sum(col("discount_depth") * col("line_list_revenue")), A.list_revenue(), 0.0
        ).alias("weighted_discount_pct"),
        F.avg("discounted_flag").alias("share_order_items_discounted"),
        A.margin_pct(otherwise=0.0).alias("avg_margin_proxy_pct"),
        F.coalesce(spread, F.lit(0.0)).alias("realized_price_cv"),
        F.coalesce(F.avg("abs_price_realization_residual_pct"), F.lit(0.0)).alias(
            "avg_abs_price_realization_residual_pct"
        ),
        A.high_revenue_share(otherwise=0.0).alias("revenue_high_discount_share"),
    )
    filled = {
        name: F.coalesce(col(name), F.lit(0.0))
        for name in (
            "share_orders_discounted",
            "share_orders_high_discount",
            "repeat_discount_behavior",
        )
    }
    named = labels(lines, "customer_id", "segment", "region", "company_size")
    range_bought = lines.groupBy("customer_id").agg(
        F.count_distinct("product_id").alias("product_diversity")
    )
    joined = (
        by_customer.join(named, "customer_id")
        .join(range_bought, "customer_id")
        .join(order_stats(ledger), "customer_id", "left")
    )
    return joined.withColumns(filled).select(*PROFILE_COLUMNS)
