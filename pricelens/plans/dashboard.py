"""Dashboard facts and the slices computed from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import pricing as X
from pricelens.functions.numeric import ratio
from pricelens.functions.scoring import watch_level
from pricelens.operators.shapes import collapse_tail

col = F.col

ADDITIVE = (
    "line_revenue",
    "line_list_revenue",
    "discount_weighted_num",
    "high_discount_revenue",
    "margin_risk_revenue",
)
RISK_COLUMNS = (
    "customer_id",
    "segment",
    "region",
    "total_orders",
    "avg_discount_pct",
    "share_orders_high_discount",
    "revenue_high_discount_share",
    "avg_margin_proxy_pct",
    "pricing_risk_score",
    "discount_dependency_score",
    "margin_erosion_score",
    "governance_priority_score",
    "risk_tier",
    "main_risk_driver",
    "recommended_action",
)


@dataclass(frozen=True)
class Scope:
    """A dashboard selection; 'All' leaves a dimension open, None leaves the period open.

    Months are 'YYYY-MM' labels, both ends included, in either order.
    """

    segment: str = P.ALL
    region: str = P.ALL
    category: str = P.ALL
    sales_channel: str = P.ALL
    start: str | None = None
    end: str | None = None

    def matches_dims(self) -> Column:
        chosen = F.lit(True)
        for name in P.SCOPE_DIMS:
            value = getattr(self, name)
            if value != P.ALL:
                chosen = chosen & (col(name) == value)
        return chosen

    def matches_period(self) -> Column:
        start, end = self.start, self.end
        if start is not None and end is not None and start > end:
            start, end = end, start
        chosen = F.lit(True)
        if start is not None:
            chosen = chosen & (col("order_month") >= start)
        if end is not None:
            chosen = chosen & (col("order_month") <= end)
        return chosen


def _with_month_label(facts: DataFrame) -> DataFrame:
    """Month dates as 'YYYY-MM', after grouping, so only group rows are formatted."""
    return facts.withColumn("order_month", F.date_format("order_month", "yyyy-MM"))


def additive_lines(lines: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    return lines.withColumns(X.dashboard_columns(policy))


def monthly_facts(lines: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    """Additive measures per month and dimension combination."""
    sums = [F.sum(name).alias(name) for name in ADDITIVE]
    return _with_month_label(
        additive_lines(lines, policy).groupBy("order_month", *P.SCOPE_DIMS).agg(*sums)
    )


def customer_facts(
    lines: DataFrame, chosen: DataFrame | None = None, policy: P.Policy = P.POLICY
) -> DataFrame:
    """Additive measures per month, customer and dimension combination.

    All accounts by default; ``chosen`` limits them to its customers.
    """
    kept = additive_lines(lines, policy)
    if chosen is not None:
        kept = kept.join(chosen.select("customer_id"), "customer_id", "left_semi")
    facts = kept.groupBy("order_month", "customer_id", *P.SCOPE_DIMS).agg(
        F.sum("line_revenue").alias("filtered_revenue"),
        F.sum("line_list_revenue").alias("filtered_list_revenue"),
        F.sum("discount_weighted_num").alias("filtered_discount_num"),
    )
    return _with_month_label(facts)


def kpi_cube(facts: DataFrame) -> DataFrame:
    """Every combination of the four dimensions, open ones labelled 'All'.

    Runs on the monthly facts: the cube's sixteen-fold expansion then multiplies a few
    rows per month instead of every order line.
    """
    marks = [F.grouping(name).alias(f"_{name}") for name in P.SCOPE_DIMS]
    cube = facts.cube(*P.SCOPE_DIMS).agg(
        *marks, *[F.sum(name).alias(name) for name in ADDITIVE]
    )
    labels = [
        F.when(col(f"_{name}") == 1, P.ALL).otherwise(col(name)).alias(name)
        for name in P.SCOPE_DIMS
    ]
    net = col("line_revenue")
    return cube.select(
        *labels,
        net.alias("net_revenue"),
        ratio(col("discount_weighted_num"), col("line_list_revenue"), 0.0).alias(
            "weighted_discount_pct"
        ),
        ratio(col("high_discount_revenue"), net, 0.0).alias("high_discount_revenue_share"),
        col("margin_risk_revenue").alias("margin_at_risk"),
        ratio(col("margin_risk_revenue"), net, 0.0).alias("margin_at_risk_share"),
    ).dropDuplicates(list(P.SCOPE_DIMS))


def filter_options(facts: DataFrame) -> DataFrame:
    """Sorted choices per filter with their position; 'All' leads every dimension."""
    long = facts.select(*P.SCOPE_DIMS, "order_month").unpivot(
        [], [*P.SCOPE_DIMS, "order_month"], "filter", "option"
    )
    listed = long.where(col("option").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("filter").orderBy("option"))
    numbered = listed.withColumn("position", place)
    opening = listed.where(col("filter") != "order_month").select(
        "filter", F.lit(P.ALL).alias("option"), F.lit(0).alias("position")
    )
    return numbered.unionByName(opening.distinct())


def coverage(lines: DataFrame) -> DataFrame:
    """First and last order date, line and customer counts."""
    return lines.agg(
        F.date_format(F.min("order_date"), "yyyy-MM-dd").alias("coverage_start"),
        F.date_format(F.max("order_date"), "yyyy-MM-dd").alias("coverage_end"),
        F.count(F.lit(1)).alias("pricing_rows"),
        F.count_distinct("customer_id").alias("customers"),
    )


def scoped_kpi(facts: DataFrame, scope: Scope) -> DataFrame:
    """Net, list, leakage, weighted discount, margin at risk and revenue coverage of a scope.

    Both totals come from one pass: the scope's sums are conditional on the dimensions,
    the coverage base is the whole period.
    """
    inside = scope.matches_dims()

    def scoped(name: str) -> Column:
        return F.coalesce(F.sum(F.when(inside, col(name))), F.lit(0.0))

    sums = facts.where(scope.matches_period()).agg(
        scoped("line_revenue").alias("net_revenue"),
        scoped("line_list_revenue").alias("list_revenue"),
        scoped("discount_weighted_num").alias("leakage"),
        scoped("margin_risk_revenue").alias("margin_at_risk"),
        F.coalesce(F.sum("line_revenue"), F.lit(0.0)).alias("period_revenue"),
    )
    return sums.select(
        "net_revenue",
        "list_revenue",
        "leakage",
        ratio(col("leakage"), col("list_revenue"), 0.0).alias("weighted_discount_pct"),
        "margin_at_risk",
        ratio(col("margin_at_risk"), col("net_revenue"), 0.0).alias("margin_risk_share"),
        "period_revenue",
        ratio(col("net_revenue"), col("period_revenue"), 0.0).alias("revenue_coverage_share"),
    )


def scoped_accounts(scores: DataFrame, account_facts: DataFrame, scope: Scope) -> DataFrame:
    """Scored accounts with revenue in the scope, with their scoped revenue and discount."""
    sums = (
        account_facts.where(scope.matches_dims() & scope.matches_period())
        .groupBy("customer_id")
        .agg(
            F.sum("filtered_revenue").alias("filtered_revenue"),
            F.sum("filtered_list_revenue").alias("filtered_list_revenue"),
            F.sum("filtered_discount_num").alias("filtered_discount_num"),
        )
        .where(col("filtered_revenue") > 0)
        .select(
            "customer_id",
            "filtered_revenue",
            ratio(col("filtered_discount_num"), col("filtered_list_revenue"), 0.0).alias(
                "filtered_avg_discount"
            ),
        )
    )
    rows = scores.select(*RISK_COLUMNS)
    for name in ("segment", "region"):
        value = getattr(scope, name)
        if value != P.ALL:
            rows = rows.where(col(name) == value)
    return rows.join(sums, "customer_id")


def high_risk_count(accounts: DataFrame) -> Column:
    upper = col("risk_tier").isin(*P.PRIORITY_TIERS)
    return accounts.agg(F.count(F.when(upper, F.lit(1)))).scalar()


def scoped_indicators(
    facts: DataFrame, accounts: DataFrame, scope: Scope, policy: P.Policy = P.POLICY
) -> DataFrame:
    """The three watched indicators of a scope with their levels and the overall posture."""
    kpi = scoped_kpi(facts, scope).withColumn("high_risk_count", high_risk_count(accounts))
    levels = {
        f"{name}_level": watch_level(col(name), watch) for name, watch in policy.watch.items()
    }
    leveled = kpi.withColumns(levels)
    any_of = {
        level: F.greatest(*[(col(name) == level).cast("int") for name in levels]) == 1
        for level in ("critical", "warn")
    }
    posture = F.when(any_of["critical"], "critical").when(any_of["warn"], "warn").otherwise("ok")
    label = (
        F.when(col("posture") == "critical", P.POSTURES["critical"])
        .when(col("posture") == "warn", P.POSTURES["warn"])
        .otherwise(P.POSTURES["ok"])
    )
    return leveled.withColumn("posture", posture).select(
        *policy.watch, *levels, "posture", label.alias("posture_label")
    )


def scoped_trend(facts: DataFrame, scope: Scope) -> DataFrame:
    """Monthly weighted discount of a scope and its change to the month before, in points.

    The lag runs over one row per month.
    """
    months = (
        facts.where(scope.matches_dims() & scope.matches_period())
        .groupBy("order_month")
        .agg(
            ratio(F.sum("discount_weighted_num"), F.sum("line_list_revenue"), 0.0).alias(
                "weighted_discount_pct"
            )
        )
    )
    before = F.lag("weighted_discount_pct").over(Window.orderBy("order_month"))
    return months.withColumn("delta_pts", (col("weighted_discount_pct") - before) * 100)


def segment_ranking(facts: DataFrame, scope: Scope) -> DataFrame:
    return (
        facts.where(scope.matches_dims() & scope.matches_period())
        .groupBy("segment")
        .agg(
            (ratio(F.sum("discount_weighted_num"), F.sum("line_list_revenue"), 0.0) * 100).alias(
                "weighted_discount_points"
            )
        )
        .orderBy(col("weighted_discount_points").desc(), "segment")
    )


def region_ranking(facts: DataFrame, scope: Scope) -> DataFrame:
    return (
        facts.where(scope.matches_dims() & scope.matches_period())
        .groupBy("region")
        .agg(F.sum("margin_risk_revenue").alias("margin_at_risk"))
        .orderBy(col("margin_at_risk").desc(), "region")
    )


def revenue_by(accounts: DataFrame, label: str) -> DataFrame:
    """Scoped revenue per label of the accounts; the leader is marked."""
    sums = accounts.groupBy(label).agg(F.sum("filtered_revenue").alias("filtered_revenue"))
    leader = accounts.groupBy(label).agg(F.sum("filtered_revenue").alias("r")).agg(
        F.max_by(label, F.struct("r", label))
    )
    return sums.withColumn("is_top", col(label) == leader.scalar())


def action_chart(accounts: DataFrame) -> DataFrame:
    """Scoped revenue per recommended action with the tail folded into one row."""
    sums = accounts.groupBy(col("recommended_action").alias("label")).agg(
        F.sum("filtered_revenue").alias("value")
    )
    return collapse_tail(sums, "label", "value")


def queue_table(
    accounts: DataFrame, sort_by: str, descending: bool = True, rows: int = P.QUEUE_TABLE_ROWS
) -> DataFrame:
    key = col(sort_by).desc() if descending else col(sort_by).asc()
    return accounts.orderBy(key, "customer_id").limit(rows)


def bridge(kpi: DataFrame) -> DataFrame:
    """List revenue to protected revenue in five steps; reductions are negative."""
    net, listed, exposed = col("net_revenue"), col("list_revenue"), col("margin_at_risk")
    protected = F.greatest(net - exposed, F.lit(0.0))
    steps = [
        ("List revenue", "Total", listed),
        ("Discount given", "Reduction", -F.abs(listed - net)),
        ("Net revenue", "Total", net),
        ("Margin at risk", "Reduction", -F.abs(net - protected)),
        ("Protected revenue", "Total", protected),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("step"), F.lit(kind).alias("kind"), value.alias("value"))
            for name, kind, value in steps
        ]
    )
    return kpi.select(F.posexplode(rows).alias("step_order", "row")).select("step_order", "row.*")
