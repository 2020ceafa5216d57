"""Diagnostic analyses: dependency, erosion, inconsistency, sensitivity, action queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import measures as A
from pricelens.functions import pricing as X
from pricelens.functions.numeric import count_if, ratio, sum_if
from pricelens.functions.scoring import health_verdict
from pricelens.operators.ordered import percentile_ranks, running_before, selected_quantiles
from pricelens.operators.shapes import density, histogram
from pricelens.sources.area import StagingArea

col = F.col


def verdict(overall: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    name, reason = health_verdict(
        col("weighted_realized_discount"),
        col("high_discount_revenue_share"),
        col("margin_proxy_pct"),
        policy,
    )
    return overall.select(
        "weighted_realized_discount",
        "high_discount_revenue_share",
        "margin_proxy_pct",
        name.alias("verdict"),
        reason.alias("reason"),
    )


def threshold_sensitivity(lines: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    """High-discount exposure under each policy threshold, in one pass over the lines.

    The step of a line is the number of thresholds that it reaches. Lines are summed per customer
    and step, and the sums of a threshold are those of its own step and all above: over all
    customers for the totals, over one customer's steps for its share. The plan is the same for
    any number of thresholds.
    """
    spark, levels = lines.sparkSession, sorted(set(policy.sensitivity))
    depth, revenue = col("discount_depth"), col("line_revenue")
    reached = F.size(F.filter(F.lit(levels), lambda t: t <= depth))
    cells = lines.groupBy("customer_id", reached.alias("step")).agg(
        F.sum(revenue).alias("revenue"),
        F.sum("gross_margin_value").alias("margin"),
        F.count(F.lit(1)).alias("lines"),
        sum_if(col("margin_proxy_pct") < F.lit(policy.margin_at_risk), revenue).alias("exposed"),
    )
    customer = Window.partitionBy("customer_id")
    downward = customer.orderBy(F.desc("step"))
    share = ratio(
        F.sum("revenue").over(downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        F.sum("revenue").over(customer),
        0.0,
    )
    counted = cells.select(
        "*",
        (share >= policy.high_revenue_share).cast("long").alias("above"),
        F.lag("step").over(downward).isNull().cast("long").alias("customers"),
        F.coalesce(F.lead("step").over(downward), F.lit(0)).alias("below"),
    )
    # The share holds for the thresholds down to the customer's next step, and is taken back there.
    own = ("revenue", "margin", "lines", "exposed", "customers", "above")
    back = [F.lit(0).cast(counted.schema[n].dataType).alias(n) for n in own[:-1]]
    moved = counted.select(
        F.inline(
            F.array(
                F.struct(col("step"), *own),
                F.struct(col("below").alias("step"), *back, (-col("above")).alias("above")),
            )
        )
    )
    none = spark.range(len(levels) + 1).select(
        col("id").cast("int").alias("step"),
        *[F.lit(0).cast(moved.schema[n].dataType).alias(n) for n in own],
    )
    sums = moved.unionByName(none).groupBy("step").agg(*[F.sum(n).alias(n) for n in own])
    # One row per step, so one task is enough.
    every = Window.partitionBy(F.lit(0))
    upper = every.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sums.select(
        "step",
        *[F.sum(n).over(upper).alias(n) for n in own],
        *[F.sum(n).over(every).alias(f"all_{n}") for n in ("revenue", "lines", "customers")],
    )
    asked = spark.range(1).select(
        F.explode(F.lit(list(policy.sensitivity))).alias("high_discount_threshold")
    )
    asked = asked.withColumn(
        "step", F.array_position(F.lit(levels), col("high_discount_threshold")).cast("int")
    )
    return held.join(F.broadcast(asked), "step").select(
        "high_discount_threshold",
        ratio(col("revenue"), col("all_revenue")).alias("high_discount_revenue_share"),
        ratio(col("lines"), col("all_lines")).alias("high_discount_order_item_share"),
        ratio(col("margin"), col("revenue")).alias("margin_proxy_pct_on_high_discount"),
        ratio(col("above"), col("all_customers")).alias(
            "customer_share_above_policy_high_discount_revenue_threshold"
        ),
        col("exposed").alias("revenue_with_margin_at_risk"),
    )


def customer_leakage(lines: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    scoped = lines.withColumns(X.scope_columns(policy))
    return scoped.groupBy("customer_id").agg(
        F.sum("line_revenue").alias("revenue_in_scope"),
        F.sum("line_list_revenue").alias("total_list_revenue"),
        F.sum("high_discount_revenue").alias("high_discount_revenue"),
        F.sum("margin_at_risk_revenue").alias("margin_at_risk_revenue"),
        F.sum("discount_leakage_value").alias("discount_leakage_value"),
    )


def with_leakage(customers: DataFrame, leakage: DataFrame, revenue: Column) -> DataFrame:
    """Left join; absent leakage is 0 and absent scope revenue is ``revenue``."""
    zero = F.lit(0.0)
    return customers.join(leakage, "customer_id", "left").withColumns(
        {
            "high_discount_revenue": F.coalesce("high_discount_revenue", zero),
            "margin_at_risk_revenue": F.coalesce("margin_at_risk_revenue", zero),
            "discount_leakage_value": F.coalesce("discount_leakage_value", zero),
            "revenue_in_scope": F.coalesce(col("revenue_in_scope"), revenue),
        }
    )


def action_queue(
    lines: DataFrame, scores: DataFrame, policy: P.Policy = P.POLICY
) -> DataFrame:
    """Accounts valued by score times margin at risk."""
    joined = with_leakage(scores, customer_leakage(lines, policy), col("total_revenue"))
    value = col("governance_priority_score") / 100 * col("margin_at_risk_revenue")
    return joined.select(
        "customer_id",
        "segment",
        "region",
        "risk_tier",
        "main_risk_driver",
        "recommended_action",
        "governance_priority_score",
        "total_revenue",
        "revenue_in_scope",
        "high_discount_revenue",
        "margin_at_risk_revenue",
        "discount_leakage_value",
        value.alias("priority_value_proxy"),
    )


def queue_order() -> list[Column]:
    return [
        col("priority_value_proxy").desc(),
        col("governance_priority_score").desc(),
        col("margin_at_risk_revenue").desc(),
        col("customer_id").asc(),
    ]


def customer_dependency(profile: DataFrame) -> DataFrame:
    value = col("revenue_high_discount_share") * col("total_revenue")
    return profile.withColumn("high_discount_revenue_value", value)


def segment_dependency(lines: DataFrame, profile: DataFrame) -> DataFrame:
    repeat = profile.groupBy("segment").agg(
        F.avg("repeat_discount_behavior").alias("repeat_discount_behavior")
    )
    sums = lines.groupBy("segment").agg(
        A.revenue().alias("revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_revenue().alias("high_discount_revenue"),
        A.high_revenue_share().alias("high_discount_revenue_share"),
        A.margin_pct().alias("avg_margin_proxy_pct"),
    )
    return sums.join(repeat, "segment", "left").select(
        "segment",
        "revenue",
        "avg_discount_pct",
        "high_discount_revenue",
        F.coalesce("repeat_discount_behavior", F.lit(0.0)).alias("repeat_discount_behavior"),
        "high_discount_revenue_share",
        "avg_margin_proxy_pct",
    )


def product_dependency(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id", "product_name", "category").agg(
        A.revenue().alias("revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_revenue().alias("high_discount_revenue"),
        A.lines().alias("order_lines"),
        A.high_revenue_share().alias("high_discount_revenue_share"),
    )


def dependence_ranking(lines: DataFrame) -> DataFrame:
    """Products scored by high-discount share times log revenue."""
    sums = lines.groupBy("product_id", "product_name", "category").agg(
        A.revenue().alias("revenue"),
        A.high_revenue().alias("high_discount_revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.margin_pct().alias("avg_margin_proxy_pct"),
        A.high_revenue_share(otherwise=0.0).alias("high_discount_revenue_share"),
    )
    score = col("high_discount_revenue_share") * F.log1p("revenue")
    return sums.withColumn("dependence_score", score)


def ranked_customers(
    area: StagingArea, profile: DataFrame, *order: Column, name: str = "ranked_customers"
) -> DataFrame:
    """The profile's revenue with ``position`` (0-based) and ``revenue_before`` in an order.

    ``order`` are ascending sort expressions; the customer id breaks ties.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    slim = profile.select(
        "customer_id", "total_revenue", *[o.alias(k) for o, k in zip(order, keys, strict=True)]
    )
    staged = area.put_in_order(name, slim, *keys, "customer_id")
    return running_before(
        staged,
        [],
        [*keys, "customer_id"],
        position=F.lit(1),
        revenue_before=col("total_revenue"),
    ).drop("chunk", *keys)


def dependency_concentration(area: StagingArea, profile: DataFrame) -> DataFrame:
    """Revenue share of the tenth of customers that depend most on high discounts."""
    ranked = ranked_customers(
        area, profile, -col("revenue_high_discount_share"), -col("total_revenue")
    )
    totals = profile.agg(
        F.greatest(F.ceil(F.count(F.lit(1)) * P.TOP_DEPENDENCY_SHARE), F.lit(1)).alias("top"),
        F.sum("total_revenue").alias("revenue"),
        F.avg("repeat_discount_behavior").alias("avg_repeat_discount_behavior"),
        F.avg("share_orders_discounted").alias("avg_share_orders_discounted"),
    )
    head = totals.select("top").scalar()
    head_revenue = ranked.where(col("position") < head).agg(F.sum("total_revenue")).scalar()
    return totals.select(
        col("top").alias("top_decile_customers"),
        ratio(head_revenue, col("revenue")).alias("revenue_share_of_top_dependency_decile"),
        "avg_repeat_discount_behavior",
        "avg_share_orders_discounted",
    )


def revenue_concentration(area: StagingArea, profile: DataFrame) -> DataFrame:
    """Lorenz curve: cumulative revenue share per customer in descending revenue order."""
    ranked = ranked_customers(area, profile, -col("total_revenue"))
    total = profile.agg(
        F.struct(F.sum("total_revenue").alias("revenue"), F.count(F.lit(1)).alias("customers"))
    ).scalar()
    return ranked.withColumn("_t", total).select(
        "customer_id",
        (col("position") + 1).alias("customer_rank"),
        ((col("position") + 1) / col("_t.customers")).alias("customer_share"),
        ((col("revenue_before") + col("total_revenue")) / col("_t.revenue")).alias(
            "cumulative_revenue_share"
        ),
    )


def top_revenue_shares(area: StagingArea, profile: DataFrame) -> DataFrame:
    """Revenue share of the top 10 % and 20 % of customers.

    The cut is the whole number of customers below the fraction; fewer than one has none.
    """
    curve = revenue_concentration(area, profile)
    customers = profile.agg(F.count(F.lit(1))).scalar()
    return curve.agg(
        *[
            F.max(
                F.when(
                    col("customer_rank") == F.floor(customers * fraction),
                    col("cumulative_revenue_share"),
                )
            ).alias(name)
            for name, fraction in (("top10_rev_share", 0.10), ("top20_rev_share", 0.20))
        ]
    )


def _weighted_ranks(parts: dict[str, tuple[float, bool]]) -> Column:
    """``100 * sum(weight * rank)``; reversed ranks count from the other end."""
    terms = [
        F.lit(weight) * ((F.lit(1.0) - col(f"{m}_rank")) if reverse else col(f"{m}_rank"))
        for m, (weight, reverse) in parts.items()
    ]
    return reduce(Column.__add__, terms) * 100


def erosion_base(lines: DataFrame) -> DataFrame:
    return lines.groupBy("segment", "category").agg(
        A.revenue().alias("revenue"),
        A.list_revenue().alias("list_revenue"),
        A.margin_value().alias("gross_margin_value"),
        A.avg_discount().alias("avg_discount_pct"),
        A.high_share().alias("high_discount_share"),
        A.lines().alias("order_lines"),
        A.margin_pct().alias("margin_proxy_pct"),
        (A.list_revenue() - A.revenue()).alias("discount_leakage_value"),
    )


def margin_erosion(area: StagingArea, lines: DataFrame) -> DataFrame:
    """Segment by category erosion base with a score blended from peer ranks."""
    base = area.put("erosion_base", erosion_base(lines))
    parts = {
        "avg_discount_pct": (P.EROSION_WEIGHTS["discount"], False),
        "high_discount_share": (P.EROSION_WEIGHTS["high_share"], False),
        "margin_proxy_pct": (P.EROSION_WEIGHTS["margin"], True),
    }
    ranks = percentile_ranks(
        area, base, ["segment", "category"], list(parts), digits=P.SUM_DIGITS
    )
    score = _weighted_ranks(parts).alias("margin_erosion_risk_score")
    return base.join(ranks, ["segment", "category"], "left").select(*base.columns, score)


def rep_behaviour(lines: DataFrame) -> DataFrame:
    """Reps with enough lines, compared with the mean of their team and region.

    Peer figures are an aggregate joined back, not a window, so a crowded peer group is
    summed in parts.
    """
    reps = (
        lines.groupBy("sales_rep_id", "team", "rep_region")
        .agg(
            A.revenue().alias("revenue"),
            A.lines().alias("order_lines"),
            A.avg_discount().alias("avg_discount_pct"),
            F.stddev_samp("discount_depth").alias("discount_std"),
            A.margin_pct().alias("avg_margin_proxy_pct"),
        )
        .where(col("order_lines") >= P.MIN_REP_LINES)
    )
    peers = reps.groupBy("team", "rep_region").agg(
        F.avg("avg_discount_pct").alias("peer_avg_discount"),
        F.nullif(F.stddev_samp("avg_discount_pct"), F.lit(0.0)).alias("peer_discount_std"),
    )
    z = F.coalesce(
        (col("avg_discount_pct") - col("peer_avg_discount")) / col("peer_discount_std"), F.lit(0.0)
    )
    return (
        reps.join(peers, ["team", "rep_region"])
        .withColumn("discount_zscore_vs_peers", z)
        .select(
            "sales_rep_id",
            "team",
            "rep_region",
            "revenue",
            "order_lines",
            "avg_discount_pct",
            "discount_std",
            "avg_margin_proxy_pct",
            "peer_avg_discount",
            "peer_discount_std",
            "discount_zscore_vs_peers",
            (F.abs("discount_zscore_vs_peers") >= P.REP_OUTLIER_Z).alias("discount_outlier_flag"),
        )
    )


def channel_region(lines: DataFrame) -> DataFrame:
    return lines.groupBy("sales_channel", "region").agg(
        A.revenue().alias("revenue"),
        A.avg_discount().alias("avg_discount_pct"),
        A.lines().alias("order_lines"),
        A.margin_pct().alias("avg_margin_proxy_pct"),
    )


def product_variance(lines: DataFrame) -> DataFrame:
    """Price spread per product and channel with enough lines."""
    stats = (
        lines.groupBy("product_id", "product_name", "category", "sales_channel")
        .agg(
            A.revenue().alias("revenue"),
            A.lines().alias("order_lines"),
            A.avg_discount().alias("avg_discount_pct"),
            F.avg("realized_price").alias("realized_price_mean"),
            F.stddev_samp("realized_price").alias("realized_price_std"),
            F.coalesce(F.avg("abs_price_realization_residual_pct"), F.lit(0.0)).alias(
                "price_realization_residual_abs_mean"
            ),
            F.coalesce(F.stddev_samp("price_realization_residual_pct"), F.lit(0.0)).alias(
                "price_realization_residual_std"
            ),
        )
        .where(col("order_lines") >= P.MIN_PRODUCT_CHANNEL_LINES)
    )
    spread = ratio(col("realized_price_std"), col("realized_price_mean"))
    return stats.withColumn("realized_price_cv", spread)


def product_patterns(area: StagingArea, lines: DataFrame) -> DataFrame:
    """Products with a pricing pattern (first rule that matches) and a concern score."""
    base = area.put(
        "product_base",
        lines.groupBy("product_id", "product_name", "category").agg(
            A.revenue().alias("revenue"),
            A.list_revenue().alias("list_revenue"),
            A.lines().alias("order_lines"),
            A.avg_discount().alias("avg_discount_pct"),
            A.high_share().alias("high_discount_share"),
            A.realization().alias("price_realization"),
            A.margin_pct().alias("avg_margin_proxy_pct"),
        ),
    )
    parts = {
        "avg_discount_pct": (P.CONCERN_WEIGHTS["discount"], False),
        "high_discount_share": (P.CONCERN_WEIGHTS["high_share"], False),
        "avg_margin_proxy_pct": (P.CONCERN_WEIGHTS["margin"], True),
    }
    keys = ["product_id", "product_name", "category"]
    ranks = percentile_ranks(area, base, keys, list(parts), digits=P.SUM_DIGITS)
    return base.join(ranks, keys, "left").select(
        *base.columns,
        pricing_pattern(
            col("avg_discount_pct"), col("high_discount_share"), col("avg_margin_proxy_pct")
        ).alias("pricing_pattern"),
        _weighted_ranks(parts).alias("governance_concern_score"),
    )


def pricing_pattern(discount: Column, high_share: Column, margin: Column) -> Column:
    clean, reliant, pressure, mixed = P.PATTERNS
    is_clean = (
        (discount < P.PATTERN_CLEAN.discount_max)
        & (high_share < P.PATTERN_CLEAN.high_share_max)
        & (margin > P.PATTERN_CLEAN.margin_min)
    )
    is_reliant = (high_share >= P.PATTERN_RELIANT_SHARE_MIN) | (
        discount >= P.PATTERN_RELIANT_DISCOUNT_MIN
    )
    is_pressure = (margin < P.PATTERN_PRESSURE_MARGIN_MAX) & (
        discount >= P.PATTERN_PRESSURE_DISCOUNT_MIN
    )
    return (
        F.when(is_clean, clean).when(is_reliant, reliant).when(is_pressure, pressure).otherwise(mixed)
    )


def recommendations(
    overall: DataFrame,
    segments: DataFrame,
    reps: DataFrame,
    patterns: DataFrame,
    queue: DataFrame,
    policy: P.Policy = P.POLICY,
) -> DataFrame:
    """Which follow-up rules fire, one row per rule in fixed order."""
    outliers = reps.agg(count_if(col("discount_outlier_flag"))).scalar()
    reliant = patterns.agg(count_if(col("pricing_pattern") == P.PATTERNS[1])).scalar()
    top_share = segments.agg(F.max("high_discount_revenue_share")).scalar()
    queued = queue.limit(1).agg(F.count(F.lit(1))).scalar()
    facts = overall.select(
        col("high_discount_revenue_share").alias("share"),
        top_share.alias("top_share"),
        outliers.alias("outliers"),
        reliant.alias("reliant"),
        queued.alias("queued"),
    )
    rules = [
        ("tighten_approval_thresholds", col("share") >= policy.mixed.high_share_max),
        ("review_segment_architecture", col("top_share") >= policy.high_revenue_share),
        ("investigate_rep_outliers", col("outliers") > 0),
        ("maintain_rep_monitoring", col("outliers") == 0),
        ("redesign_product_guardrails", col("reliant") > 0),
        ("monitor_mixed_products", col("reliant") == 0),
        ("activate_intervention_queue", col("queued") > 0),
        ("track_recurring_kpis", F.lit(True)),
    ]
    structs = [
        F.struct(
            F.lit(i).alias("rule_order"),
            F.lit(name).alias("rule"),
            F.coalesce(fired, F.lit(False)).alias("fired"),
        )
        for i, (name, fired) in enumerate(rules)
    ]
    return facts.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def recovery_scenarios(overall: DataFrame) -> DataFrame:
    """Revenue captured and realization reached by 1, 2 and 3 points more realization."""
    points = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("realization_improvement_pp")
    return overall.select(points, "total_list_revenue", "price_realization").select(
        "realization_improvement_pp",
        (col("total_list_revenue") * (col("realization_improvement_pp") / 100)).alias(
            "revenue_capture_on_analysis_base"
        ),
        (col("price_realization") + col("realization_improvement_pp") / 100).alias(
            "new_price_realization"
        ),
    )


def run_rate(overall: DataFrame, lines: DataFrame) -> DataFrame:
    """Value of two points, its yearly rate, and the spread of discounts between regions."""
    months = lines.select("order_month").distinct().agg(F.count(F.lit(1))).scalar()
    by_region = lines.groupBy("region").agg(A.weighted_discount().alias("discount"))
    spread = by_region.agg(
        F.struct(
            F.min_by("region", F.struct("discount", "region")).alias("shallowest"),
            F.max_by("region", F.struct("discount", "region")).alias("deepest"),
            (F.max("discount") - F.min("discount")).alias("width"),
        )
    ).scalar()
    capture = col("total_list_revenue") * 0.02
    years = F.greatest(months / 12.0, F.lit(1.0))
    return overall.withColumn("_r", spread).select(
        capture.alias("two_point_capture"),
        years.alias("analysis_years"),
        (capture / years).alias("two_point_annual_run_rate"),
        col("_r.shallowest").alias("shallowest_region"),
        col("_r.deepest").alias("deepest_region"),
        col("_r.width").alias("region_discount_range"),
    )


def period_growth(yearly: DataFrame) -> DataFrame:
    """Revenue growth from the first to the last year in percent; NULL for a single year."""
    ends = yearly.agg(
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
        F.min_by("revenue", "year").alias("start_revenue"),
        F.max_by("revenue", "year").alias("end_revenue"),
    )
    growth = (col("end_revenue") / F.nullif(col("start_revenue"), F.lit(0.0)) - 1) * 100
    return ends.withColumn(
        "growth_pct", F.when(col("end_year") > col("start_year"), growth)
    )


def reconciliation(lines: DataFrame, segment_mart: DataFrame, monthly: DataFrame) -> DataFrame:
    return lines.agg(F.sum("line_revenue").alias("base_revenue")).select(
        "base_revenue",
        segment_mart.agg(F.sum("total_revenue")).scalar().alias("segment_revenue"),
        monthly.agg(F.sum("revenue")).scalar().alias("monthly_revenue"),
    ).select(
        "*",
        (col("base_revenue") - col("segment_revenue")).alias("base_minus_segment"),
        (col("base_revenue") - col("monthly_revenue")).alias("base_minus_monthly"),
    )


def segment_exposure(segments: DataFrame, scores: DataFrame) -> DataFrame:
    """Segment summary with the share of its customers in the two upper tiers."""
    upper = col("risk_tier").isin(*P.PRIORITY_TIERS).cast("int")
    risk = scores.groupBy("segment").agg(
        F.avg(upper).alias("high_risk_customer_share"),
        F.sum(upper).alias("high_risk_customers"),
        F.count("customer_id").alias("total_customers"),
    )
    return segments.join(risk, "segment", "left")


def month_gaps(lines: DataFrame) -> DataFrame:
    """Calendar months between the first and last order that hold no order."""
    seen = lines.select("order_month").distinct()
    span = seen.agg(F.min("order_month").alias("a"), F.max("order_month").alias("b"))
    every = span.select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("order_month")
    )
    return every.join(seen, "order_month", "left_anti")


def discount_margin_fit(profile: DataFrame) -> DataFrame:
    """Correlation and least-squares line of customer margin on discount, in points."""
    x, y = col("avg_discount_pct") * 100, col("avg_margin_proxy_pct") * 100
    return profile.agg(
        F.corr("avg_discount_pct", "avg_margin_proxy_pct").alias("correlation"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def discount_quantiles(area: StagingArea, lines: DataFrame) -> DataFrame:
    points = lines.select((col("discount_depth") * 100).alias("points"))
    return selected_quantiles(
        area, points, [], "points", {"median_discount": 0.5, "p90_discount": 0.9}
    )


def score_quantile(area: StagingArea, scores: DataFrame) -> DataFrame:
    """90th percentile of the priority score and the customers at or above it."""
    found = area.put(
        "score_p90",
        selected_quantiles(area, scores, [], "governance_priority_score", {"p90_priority": 0.9}),
    )
    reached = scores.agg(
        count_if(col("governance_priority_score") >= found.scalar())
    )
    return found.withColumn("customers_at_or_above", reached.scalar())


def distribution_label(quantiles: DataFrame) -> DataFrame:
    deep = (col("median_discount") >= P.DEEP_TAIL_MEDIAN) | (col("p90_discount") >= P.DEEP_TAIL_P90)
    label = F.when(deep, "Material deep-discount tail").otherwise("Moderately concentrated")
    return quantiles.withColumn("distribution", label)


def score_variances(profile: DataFrame, scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.var_pop("governance_priority_score").alias("governance_score_variance")
    ).withColumn(
        "share_orders_high_discount_variance",
        profile.agg(F.var_pop("share_orders_high_discount")).scalar(),
    )


def discount_histogram(lines: DataFrame, cells: int) -> DataFrame:
    return histogram(lines, col("discount_depth") * 100, cells)


def price_density(lines: DataFrame, cells: int = 55) -> DataFrame:
    return density(lines, col("list_price_at_sale"), col("realized_price"), cells)
