"""Aggregate marts over the pricing fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import measures as A
from pricelens.functions import pricing as X
from pricelens.functions.numeric import clip, ratio, sum_if
from pricelens.operators.ordered import exact_quantiles
from pricelens.operators.shapes import by_dimension
from pricelens.plans.fact import labels
from pricelens.sources.area import StagingArea

col = F.col


def overall(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.max("order_date").alias("as_of_date"),
        A.revenue().alias("total_revenue"),
        A.list_revenue().alias("total_list_revenue"),
        A.margin_value().alias("total_margin_proxy_value"),
        A.avg_discount().alias("avg_realized_discount"),
        A.weighted_discount().alias("weighted_realized_discount"),
        A.high_revenue_share().alias("high_discount_revenue_share"),
        A.realization().alias("price_realization"),
        A.margin_pct().alias("margin_proxy_pct"),
    )


def monthly(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_month").agg(
        A.revenue().alias("revenue"),
        A.list_revenue().alias("list_revenue"),
        A.margin_value().alias("gross_margin_value"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_share().alias("high_discount_share"),
        A.weighted_discount().alias("weighted_discount_pct"),
        A.margin_pct().alias("margin_proxy_pct"),
    )


def yearly(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.year("order_date").alias("year")).agg(
        A.revenue().alias("revenue"),
        A.list_revenue().alias("list_revenue"),
        A.margin_value().alias("margin_proxy_value"),
        A.avg_discount().alias("avg_realized_discount"),
        A.high_revenue().alias("high_discount_revenue"),
        A.realization().alias("price_realization"),
        A.weighted_discount().alias("weighted_discount"),
        A.margin_pct().alias("margin_proxy_pct"),
        A.high_revenue_share().alias("high_discount_revenue_share"),
    )


def products(lines: DataFrame) -> DataFrame:
    sums = lines.groupBy("product_id").agg(
        A.revenue().alias("revenue"),
        A.list_revenue().alias("list_revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.margin_pct().alias("avg_margin_proxy_pct"),
        A.high_share().alias("high_discount_share"),
        A.lines().alias("order_item_count"),
        A.realization().alias("price_realization"),
    )
    named = labels(lines, "product_id", "product_name", "category")
    return named.join(sums, "product_id")


def erosion_proxy(margin: Column, high_share: Column) -> Column:
    return (F.lit(1.0) - clip(margin, 0, 1)) * clip(high_share, 0, 1) * 100


def median_discounts(area: StagingArea, lines: DataFrame) -> DataFrame:
    """Exact median discount per segment; both segment summaries use it."""
    return exact_quantiles(
        area, lines, ["segment"], "discount_depth", {"median_discount_pct": 0.5}
    )


def segment_mart(
    area: StagingArea, lines: DataFrame, medians: DataFrame | None = None
) -> DataFrame:
    """Segment summary with population spread."""
    summary = lines.groupBy("segment").agg(
        A.revenue().alias("total_revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_share().alias("share_high_discount"),
        A.margin_pct().alias("avg_margin_proxy_pct"),
        F.var_pop("realized_price").alias("realized_price_variance"),
        F.stddev_pop("realized_price").alias("realized_price_std"),
    )
    return _with_median(area, lines, summary, medians).select(
        "segment",
        "total_revenue",
        "avg_discount_pct",
        "median_discount_pct",
        "share_high_discount",
        "avg_margin_proxy_pct",
        "realized_price_variance",
        "realized_price_std",
        "margin_erosion_proxy",
    )


def segment_summary(
    area: StagingArea, lines: DataFrame, medians: DataFrame | None = None
) -> DataFrame:
    """Segment summary with sample spread and price-residual spread; unknown spread is 0."""

    def known(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    summary = lines.groupBy("segment").agg(
        A.revenue().alias("total_revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_share().alias("share_high_discount"),
        A.margin_pct(otherwise=0.0).alias("avg_margin_proxy_pct"),
        known(F.var_samp("realized_price")).alias("realized_price_variance"),
        known(F.stddev_samp("realized_price")).alias("realized_price_std"),
        known(F.stddev_samp("price_realization_residual_pct")).alias(
            "price_realization_residual_std"
        ),
        known(F.avg("abs_price_realization_residual_pct")).alias(
            "price_realization_residual_abs_mean"
        ),
    )
    return _with_median(area, lines, summary, medians).select(
        "segment",
        "total_revenue",
        "avg_discount_pct",
        "median_discount_pct",
        "share_high_discount",
        "avg_margin_proxy_pct",
        "realized_price_variance",
        "realized_price_std",
        "price_realization_residual_std",
        "price_realization_residual_abs_mean",
        "margin_erosion_proxy",
    )


def _with_median(
    area: StagingArea, lines: DataFrame, summary: DataFrame, medians: DataFrame | None
) -> DataFrame:
    proxy = erosion_proxy(col("avg_margin_proxy_pct"), col("share_high_discount"))
    known = median_discounts(area, lines) if medians is None else medians
    return summary.join(known, "segment", "left").withColumn("margin_erosion_proxy", proxy)


def segment_channel(lines: DataFrame) -> DataFrame:
    return lines.groupBy("segment", "sales_channel").agg(
        A.revenue().alias("revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_share().alias("high_discount_share"),
        A.lines().alias("order_item_count"),
        A.margin_pct(otherwise=0.0).alias("avg_margin_proxy_pct"),
    )


def channel_comparison(lines: DataFrame) -> DataFrame:
    return lines.groupBy("sales_channel").agg(
        A.revenue().alias("revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.margin_pct().alias("avg_margin_proxy_pct"),
    )


def _bucket_frame(lines: DataFrame) -> DataFrame:
    """Every bucket label in depth order."""
    labels = [name for _, name in P.DISCOUNT_BUCKETS] + [P.LAST_DISCOUNT_BUCKET]
    frame = F.posexplode(F.array(*[F.lit(x) for x in labels]))
    return lines.sparkSession.range(1).select(frame.alias("bucket_order", "discount_bucket"))


def revenue_by_bucket(lines: DataFrame) -> DataFrame:
    """Revenue per discount bucket; empty buckets count 0."""
    sums = lines.groupBy("discount_bucket").agg(A.revenue().alias("revenue"))
    return (
        _bucket_frame(lines)
        .join(sums, "discount_bucket", "left")
        .select("bucket_order", "discount_bucket", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
    )


def margin_by_bucket(lines: DataFrame) -> DataFrame:
    """Margin per discount bucket; empty buckets have none."""
    sums = lines.groupBy("discount_bucket").agg(A.margin_pct().alias("margin_proxy_pct"))
    return _bucket_frame(lines).join(sums, "discount_bucket", "left").select(
        "bucket_order", "discount_bucket", "margin_proxy_pct"
    )


def ladders(lines: DataFrame) -> DataFrame:
    """Weighted discount, margin and revenue by channel, by region and by category."""
    return by_dimension(
        lines,
        ["sales_channel", "region", "category"],
        weighted_discount_pct=A.weighted_discount(),
        margin_proxy_pct=A.margin_pct(),
        revenue=A.revenue(),
    )


def annual_value(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.year("order_date").alias("order_year")).agg(
        A.revenue().alias("revenue"),
        A.list_revenue().alias("list_revenue"),
        (A.list_revenue() - A.revenue()).alias("revenue_forgone"),
        A.margin_value().alias("gross_margin_value"),
        A.high_revenue().alias("high_discount_revenue"),
        A.lines().alias("order_items"),
        A.realization().alias("price_realization"),
        A.weighted_discount().alias("weighted_discount_pct"),
        A.margin_pct().alias("margin_proxy_pct"),
        A.high_revenue_share().alias("high_discount_revenue_share"),
    )


def value_pool(lines: DataFrame, dimension: str) -> DataFrame:
    """Value forgone per segment or channel and its share of all value forgone."""
    pool = lines.groupBy(dimension).agg(
        A.revenue().alias("revenue"),
        A.list_revenue().alias("list_revenue"),
        (A.list_revenue() - A.revenue()).alias("revenue_forgone"),
        A.margin_value().alias("gross_margin_value"),
        A.high_revenue().alias("high_discount_revenue"),
        A.lines().alias("order_items"),
        F.count_distinct("customer_id").alias("customers"),
        A.realization().alias("price_realization"),
        A.weighted_discount().alias("weighted_discount_pct"),
        A.margin_pct().alias("margin_proxy_pct"),
        A.high_revenue_share().alias("high_discount_revenue_share"),
    )
    forgone = lines.agg(A.list_revenue() - A.revenue()).scalar()
    return pool.withColumn("share_of_revenue_forgone", col("revenue_forgone") / forgone)


def month_by_flag(lines: DataFrame) -> DataFrame:
    """Monthly revenue below and above the high-discount line."""
    pivoted = lines.groupBy("order_month").pivot("high_discount_flag", [0, 1]).agg(A.revenue())
    return pivoted.select(
        "order_month",
        F.coalesce(col("`0`"), F.lit(0.0)).alias("standard_discount_revenue"),
        F.coalesce(col("`1`"), F.lit(0.0)).alias("high_discount_revenue"),
    )


def segment_channel_heatmap(lines: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Average discount per segment with one column per channel.

    The pivot runs on the segment by channel mart, so looking up the channels, when they
    are not given, does not scan the lines a second time.
    """
    cells = segment_channel(lines).select("segment", "sales_channel", "avg_discount_pct")
    return cells.groupBy("segment").pivot("sales_channel", channels).agg(F.max("avg_discount_pct"))


def tenure_cohorts(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """Average discount and margin by the customers' mean tenure at sale."""
    return (
        customer_tenure(lines)
        .join(profile.select("customer_id", "avg_discount_pct", "avg_margin_proxy_pct"), "customer_id")
        .where(col("tenure_band").isNotNull())
        .groupBy("tenure_band")
        .agg(
            F.avg("avg_discount_pct").alias("avg_discount_pct"),
            F.avg("avg_margin_proxy_pct").alias("avg_margin_proxy_pct"),
            F.count(F.lit(1)).alias("customers"),
        )
    )


def customer_tenure(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("customer_id")
        .agg(F.avg("days_since_signup").alias("tenure_days"))
        .withColumn("tenure_band", X.tenure_band(col("tenure_days")))
    )


def portfolio_counts(
    lines: DataFrame, scope_facts: DataFrame, profile: DataFrame, scores: DataFrame
) -> DataFrame:
    """How many lines, customers, products, months, segments, channels, regions, categories
    the portfolio has, and how much of it sits in the two upper tiers.

    Only the product count reads the lines; the dimensions are counted on the dashboard
    facts, the lines on the profile.
    """
    upper = col("risk_tier").isin(*P.PRIORITY_TIERS)
    tiers = scores.agg(
        F.count(F.when(upper, F.lit(1))).alias("high_tier_customers"),
        sum_if(upper, col("total_revenue")).alias("high_tier_revenue"),
        F.avg(F.when(upper, col("governance_priority_score"))).alias("high_tier_avg_priority"),
    )
    kinds = scope_facts.agg(
        F.struct(
            *[
                F.count_distinct(name).alias(name)
                for name in ("order_month", "segment", "sales_channel", "region", "category")
            ]
        )
    )
    size = profile.agg(
        F.struct(
            F.sum("total_order_items").alias("lines"), F.count(F.lit(1)).alias("customers")
        )
    )
    products_sold = lines.select("product_id").distinct().agg(F.count("product_id"))
    return tiers.withColumns({"_k": kinds.scalar(), "_s": size.scalar()}).select(
        col("_s.lines").alias("n_order_items"),
        col("_s.customers").alias("n_customers"),
        products_sold.scalar().alias("n_products"),
        col("_k.order_month").alias("n_months"),
        col("_k.segment").alias("n_segments"),
        col("_k.sales_channel").alias("n_channels"),
        col("_k.region").alias("n_regions"),
        col("_k.category").alias("n_categories"),
        "high_tier_customers",
        "high_tier_revenue",
        "high_tier_avg_priority",
    )


def realization_range(lines: DataFrame) -> DataFrame:
    """Lowest, highest and mean monthly price realization."""
    month = lines.groupBy("order_month").agg(
        ratio(A.revenue(), A.list_revenue()).alias("price_realization")
    )
    return month.agg(
        F.min("price_realization").alias("pr_min"),
        F.max("price_realization").alias("pr_max"),
        F.avg("price_realization").alias("pr_mean"),
    )
