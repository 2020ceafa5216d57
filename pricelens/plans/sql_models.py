"""The central marts once more as Spark SQL text, for users who query by SQL.

They share nothing with the DataFrame versions but the fact table, so comparing the two
paths checks both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OVERALL = """
SELECT max(order_date) AS as_of_date,
       sum(line_revenue) AS total_revenue,
       sum(line_list_revenue) AS total_list_revenue,
       sum(gross_margin_value) AS total_margin_proxy_value,
       avg(discount_depth) AS avg_realized_discount,
       1 - try_divide(sum(line_revenue), sum(line_list_revenue)) AS weighted_realized_discount,
       try_divide(coalesce(sum(line_revenue) FILTER (WHERE high_discount_flag = 1), 0D),
                  sum(line_revenue)) AS high_discount_revenue_share,
       try_divide(sum(line_revenue), sum(line_list_revenue)) AS price_realization,
       try_divide(sum(gross_margin_value), sum(line_revenue)) AS margin_proxy_pct
FROM {lines}
"""

_MONTHLY = """
SELECT order_month,
       sum(line_revenue) AS revenue,
       sum(line_list_revenue) AS list_revenue,
       sum(gross_margin_value) AS gross_margin_value,
       avg(discount_depth) AS avg_discount_pct,
       avg(high_discount_flag) AS high_discount_share,
       1 - try_divide(sum(line_revenue), sum(line_list_revenue)) AS weighted_discount_pct,
       try_divide(sum(gross_margin_value), sum(line_revenue)) AS margin_proxy_pct
FROM {lines}
GROUP BY order_month
"""

_CUSTOMERS = """
WITH orders_of AS (
    SELECT customer_id, avg(discounted_order) AS share_orders_discounted,
           avg(high_discount_order) AS share_orders_high_discount,
           count(DISTINCT order_id) AS total_orders,
           sum(high_discount_order * before) / greatest(count(*) - 1, 1)
               AS repeat_discount_behavior
    FROM (SELECT *, lag(high_discount_order, 1, 0) OVER (
                        PARTITION BY customer_id ORDER BY order_date, order_id) AS before
          FROM {ledger})
    GROUP BY customer_id
),
lines_of AS (
    SELECT customer_id, count(*) AS total_order_items, sum(line_revenue) AS total_revenue,
           avg(discount_depth) AS avg_discount_pct,
           coalesce(try_divide(sum(discount_depth * line_list_revenue),
                               sum(line_list_revenue)), 0D) AS weighted_discount_pct,
           avg(discounted_flag) AS share_order_items_discounted,
           count(DISTINCT product_id) AS product_diversity,
           coalesce(stddev_pop(realized_price) / nullif(avg(realized_price), 0), 0D)
               AS realized_price_cv,
           coalesce(avg(abs_price_realization_residual_pct), 0D)
               AS avg_abs_price_realization_residual_pct,
           coalesce(try_divide(sum(gross_margin_value), sum(line_revenue)), 0D)
               AS avg_margin_proxy_pct,
           coalesce(try_divide(sum(line_revenue) FILTER (WHERE high_discount_flag = 1),
                               sum(line_revenue)), 0D) AS revenue_high_discount_share
    FROM {lines} GROUP BY customer_id
)
SELECT * FROM lines_of LEFT JOIN orders_of USING (customer_id)
"""

# The median is taken over value counts: Spark's percentile then holds distinct values only.
_SEGMENTS = """
WITH medians AS (
    SELECT segment, percentile(discount_depth, 0.5D, n) AS median_discount_pct
    FROM (SELECT segment, discount_depth, count(*) AS n FROM {lines}
          WHERE discount_depth IS NOT NULL GROUP BY segment, discount_depth)
    GROUP BY segment
),
sums AS (
    SELECT segment, sum(line_revenue) AS total_revenue, avg(discount_depth) AS avg_discount_pct,
           avg(high_discount_flag) AS share_high_discount,
           try_divide(sum(gross_margin_value), sum(line_revenue)) AS avg_margin_proxy_pct,
           var_pop(realized_price) AS realized_price_variance,
           stddev_pop(realized_price) AS realized_price_std
    FROM {lines} GROUP BY segment
)
SELECT sums.*, median_discount_pct,
       (1 - greatest(0D, least(1D, avg_margin_proxy_pct)))
           * greatest(0D, least(1D, share_high_discount)) * 100 AS margin_erosion_proxy
FROM sums LEFT JOIN medians USING (segment)
"""

_PRODUCTS = """
SELECT product_id, sum(line_revenue) AS revenue, sum(line_list_revenue) AS list_revenue,
       avg(discount_depth) AS avg_discount_pct,
       try_divide(sum(gross_margin_value), sum(line_revenue)) AS avg_margin_proxy_pct,
       avg(high_discount_flag) AS high_discount_share, count(*) AS order_item_count,
       try_divide(sum(line_revenue), sum(line_list_revenue)) AS price_realization
FROM {lines}
GROUP BY product_id
"""


def overall(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(_OVERALL, lines=lines)


def monthly(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(_MONTHLY, lines=lines)


def customers(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(_CUSTOMERS, lines=lines, ledger=ledger)


def segments(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(_SEGMENTS, lines=lines)


def products(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(_PRODUCTS, lines=lines)


def parity(
    name: str, by_sql: DataFrame, by_frame: DataFrame, key: list[str], tolerance: float = 1e-9
) -> DataFrame:
    """Per numeric column: rows on either side and rows that differ by more than a relative
    tolerance, joined on the key."""
    numeric = [f for f, t in by_sql.dtypes if t in ("double", "bigint", "int") and f not in key]
    numeric = [f for f in numeric if f in by_frame.columns]
    left = by_sql.select(*key, *[F.col(f).alias(f"a_{f}") for f in numeric])
    right = by_frame.select(*key, *[F.col(f).alias(f"b_{f}") for f in numeric])
    joined = left.join(right, key, "full_outer")

    def differs(f: str):
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        near = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a))
        return F.count(F.when(~F.coalesce(near, a.isNull() & b.isNull()), F.lit(1)))

    sums = joined.agg(F.count(F.lit(1)).alias("rows"), *[differs(f).alias(f) for f in numeric])
    long = sums.unpivot(["rows"], numeric, "metric", "differing_rows")
    return long.select(F.lit(name).alias("mart"), "metric", "rows", "differing_rows")
