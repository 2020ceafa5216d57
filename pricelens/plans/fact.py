"""Order-line grain: the star join and the pricing fact on top of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import pricing as X
from pricelens.operators.joins import assert_many_to_one

col = F.col

ENRICHED_COLUMNS = (
    "order_item_id",
    "order_id",
    "order_date",
    "customer_id",
    "signup_date",
    "segment",
    "region",
    "company_size",
    "sales_channel",
    "sales_rep_id",
    "team",
    "rep_region",
    "product_id",
    "product_name",
    "category",
    "quantity",
    "list_price_at_sale",
    "realized_unit_price",
    "discount_pct",
    "list_price",
    "unit_cost",
    "days_since_signup",
)


def enriched(staged: Mapping[str, DataFrame]) -> DataFrame:
    """Order lines with order, customer, product and rep attributes.

    Lines without order, customer or product drop out; a missing rep leaves NULLs.
    Customers and reps are joined to the orders first, so only order headers are shuffled
    by customer and rep, and the lines move once, by order, before the names and prices of
    their products widen them. Join strategy is left to the optimizer: it broadcasts a
    dimension only below its size limit, and adaptive execution splits hot join keys.
    """
    headers = (
        staged["orders"]
        .join(staged["customers"], "customer_id")
        .join(staged["sales_reps"], "sales_rep_id", "left")
    )
    joined = staged["order_items"].join(headers, "order_id").join(staged["products"], "product_id")
    days = F.datediff("order_date", "signup_date").alias("days_since_signup")
    return joined.select(*ENRICHED_COLUMNS[:-1], days)


def labels(lines: DataFrame, key: str, *names: str) -> DataFrame:
    """One row per key with the smallest value of each label.

    A minimum over text cannot be hash aggregated, so label combinations are counted first
    and only one row per combination is sorted. The test on the count keeps the optimizer
    from folding both steps into one sort of all lines.
    """
    combinations = lines.groupBy(key, *names).agg(F.count(F.lit(1)).alias("n"))
    found = combinations.where(col("n") > 0)
    return found.groupBy(key).agg(*[F.min(name).alias(name) for name in names])


def check_links(staged: Mapping[str, DataFrame]) -> None:
    """Raise unless every link of the star is many-to-one and complete."""
    for left, key, right in (
        ("order_items", "order_id", "orders"),
        ("orders", "customer_id", "customers"),
        ("order_items", "product_id", "products"),
        ("orders", "sales_rep_id", "sales_reps"),
    ):
        assert_many_to_one(staged[left], staged[right], key, right)


def peer_baseline(lines: DataFrame) -> DataFrame:
    """Mean price realization per product and channel.

    An aggregate instead of a window: partial sums are combined before the shuffle, so a
    product that fills a third of the lines does not land in one task.
    """
    return lines.groupBy("product_id", "sales_channel").agg(
        F.avg(X.price_realization()).alias("peer_price_realization")
    )


def pricing_metrics(
    lines: DataFrame, policy: P.Policy = P.POLICY, baseline: DataFrame | None = None
) -> DataFrame:
    """The pricing fact as a view over enriched lines.

    Everything but the peer baseline is row-local. A ``baseline`` that was written before is
    joined by broadcast while its size allows it, so lines keep their layout. Distinct on its
    key, it is dropped by the optimizer from plans that use no residual column.
    """
    peers = peer_baseline(lines) if baseline is None else baseline
    # Keeps the key distinct for the optimizer; on the written table it costs a few rows.
    peers = peers.groupBy("product_id", "sales_channel").agg(
        F.max("peer_price_realization").alias("peer_price_realization")
    )
    day = col("order_date")
    priced = (
        lines.withColumns(X.line_amounts())
        .withColumns(
            {
                "order_month": X.order_month(day),
                "order_quarter": X.order_quarter(day),
                "realized_price": col("realized_unit_price"),
                "discount_depth": col("discount_pct"),
                "discount_bucket": X.discount_bucket(col("discount_pct")),
                "gross_margin_value": X.gross_margin(),
                "line_price_realization": X.price_realization(),
                "high_discount_flag": X.at_least(col("discount_pct"), policy.high_discount),
                "discounted_flag": X.at_least(col("discount_pct"), policy.discounted),
            }
        )
        .withColumn("margin_proxy_pct", X.margin_pct())
    )
    compared = priced.join(peers, ["product_id", "sales_channel"], "left")
    gap = X.residual(col("peer_price_realization"))
    return compared.select(
        *priced.columns,
        gap.alias("price_realization_residual_pct"),
        F.abs(gap).alias("abs_price_realization_residual_pct"),
    )
