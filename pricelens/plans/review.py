"""Analysis checks, final review, readiness and the release gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import count_if, ratio, sum_if, weighted_mean
from pricelens.functions.scoring import main_driver
from pricelens.operators.checks import as_rows, stacked, status, text
from pricelens.operators.links import Link, figure, link_facts
from pricelens.operators.ordered import exact_quantiles
from pricelens.sources.area import StagingArea

col = F.col

CORE_COLUMNS = (
    "order_item_id",
    "order_id",
    "customer_id",
    "product_id",
    "line_revenue",
    "discount_depth",
)


def _size(table: DataFrame) -> Column:
    return table.agg(F.count(F.lit(1))).scalar()


def _line_facts(lines: DataFrame, policy: P.Policy) -> DataFrame:
    """Everything the checks need from the lines, in one aggregate."""
    empty = sum((col(c).isNull().cast("long") for c in CORE_COLUMNS), F.lit(0))
    implied = F.lit(1.0) - ratio(col("realized_price"), col("list_price_at_sale"))
    return lines.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(empty).alias("empty"),
        F.sum("line_revenue").alias("revenue"),
        F.sum("line_list_revenue").alias("list_revenue"),
        F.sum("gross_margin_value").alias("margin"),
        sum_if(col("discount_depth") >= policy.high_discount, col("line_revenue")).alias(
            "high_revenue"
        ),
        weighted_mean(col("discount_depth"), col("line_list_revenue")).alias("discount_direct"),
        weighted_mean(col("margin_proxy_pct"), col("line_revenue")).alias("margin_direct"),
        F.max(F.abs(implied - col("discount_depth"))).alias("discount_gap"),
        count_if(col("realized_price") > col("list_price_at_sale")).alias("above_list"),
        (
            F.months_between(F.max("order_month"), F.min("order_month")).cast("long") + 1
        ).alias("months_expected"),
    ).withColumns(
        {
            "discount_total": ratio(col("list_revenue") - col("revenue"), col("list_revenue")),
            "margin_total": ratio(col("margin"), col("revenue")),
            "months_observed": _size(lines.select("order_month").distinct()),
        }
    )


def analysis_report(
    lines: DataFrame,
    enriched: DataFrame,
    yearly: DataFrame,
    segments: DataFrame,
    overall: DataFrame,
    profile: DataFrame,
    policy: P.Policy = P.POLICY,
) -> DataFrame:
    """Ten checks on the diagnostic tables against the lines they come from."""

    def row(name: str, passed: Column, detail: Column | str) -> dict:
        return {"check_name": name, "status": status(passed), "detail": detail}

    years = lines.agg(F.sort_array(F.collect_set(F.year("order_date")))).scalar()
    observed = yearly.agg(F.sort_array(F.collect_list(col("year")))).scalar()
    share = col("high_discount_revenue_share")
    outside = count_if(~F.coalesce(share.between(-1e-9, 1 + 1e-9), F.lit(False)))
    facts = _line_facts(lines, policy).withColumns(
        {
            "enriched_rows": _size(enriched),
            "years_expected": years,
            "years_observed": observed,
            "segment_total": segments.agg(F.sum("revenue")).scalar(),
            "yearly_outside": yearly.agg(outside).scalar(),
            "overall_outside": overall.agg(outside).scalar(),
            "overall_margin": overall.select("margin_proxy_pct").scalar(),
            "buyers": lines.agg(F.count_distinct("customer_id")).scalar(),
            "profiled": profile.agg(F.count_distinct("customer_id")).scalar(),
        }
    )
    revenue = col("revenue")
    tolerance = F.greatest(F.lit(1.0), revenue * 0.0001)
    return as_rows(
        facts,
        [
            row(
                "row_count_sanity",
                col("rows") == col("enriched_rows"),
                text("pricing=%d, enriched=%d", col("rows"), col("enriched_rows")),
            ),
            row("null_sanity_core_columns", col("empty") == 0, text("empty=%d", col("empty"))),
            row(
                "magnitude_checks_positive_revenue",
                (revenue > 0) & (col("list_revenue") >= revenue),
                text("revenue=%.2f, list_revenue=%.2f", revenue, col("list_revenue")),
            ),
            row(
                "trend_continuity_monthly",
                col("months_expected") == col("months_observed"),
                text("expected=%d, observed=%d", col("months_expected"), col("months_observed")),
            ),
            row(
                "time_window_year_coverage",
                col("years_expected") == col("years_observed"),
                text(
                    "expected=%s, observed=%s",
                    F.array_join(col("years_expected").cast("array<string>"), ","),
                    F.array_join(col("years_observed").cast("array<string>"), ","),
                ),
            ),
            row(
                "subtotal_total_consistency",
                F.abs(col("segment_total") - revenue) <= tolerance,
                text("segment_total=%.2f, total=%.2f", col("segment_total"), revenue),
            ),
            row(
                "denominator_correctness_shares",
                (col("yearly_outside") == 0) & (col("overall_outside") == 0),
                "shares lie in [0, 1]",
            ),
            row(
                "aggregation_logic_weighted_discount",
                F.abs(col("discount_direct") - col("discount_total")) <= 0.001,
                text("direct=%.6f, totals=%.6f", col("discount_direct"), col("discount_total")),
            ),
            row(
                "aggregation_logic_weighted_margin",
                F.abs(col("margin_direct") - col("overall_margin")) <= 0.001,
                text("direct=%.6f, totals=%.6f", col("margin_direct"), col("overall_margin")),
            ),
            row(
                "population_coverage_transacting_customers",
                col("buyers") == col("profiled"),
                text("transacting=%d, profiled=%d", col("buyers"), col("profiled")),
            ),
        ],
    )


# --- final review --------------------------------------------------------------------------


def _review(
    name: str, passed: Column, detail: Column | str, gate: str, severity: str, blocker: bool
) -> dict:
    return {
        "check_name": name,
        "status": status(passed),
        "detail": detail,
        "gate": gate,
        "severity": severity,
        "blocker": blocker,
    }


REVIEW_LINKS = (
    ("fk_orders_customer", "orders", "customer_id", "customers"),
    ("fk_orders_sales_rep", "orders", "sales_rep_id", "sales_reps"),
    ("fk_order_items_order", "order_items", "order_id", "orders"),
    ("fk_order_items_product", "order_items", "product_id", "products"),
)


def technical_checks(
    raw: Mapping[str, DataFrame], enriched: DataFrame, lines: DataFrame
) -> DataFrame:
    facts = enriched.agg(F.count(F.lit(1)).alias("enriched")).withColumns(
        {"items": _size(raw["order_items"]), "pricing": _size(lines)}
    )
    sizes = as_rows(
        facts,
        [
            _review(
                "join_explosion_order_items_to_enriched",
                col("items") == col("enriched"),
                text("order_items=%d, enriched=%d", col("items"), col("enriched")),
                "technical", "High", True,
            ),
            _review(
                "join_explosion_enriched_to_pricing",
                col("enriched") == col("pricing"),
                text("enriched=%d, pricing=%d", col("enriched"), col("pricing")),
                "technical", "High", True,
            ),
        ],
    )
    links = [Link(label, parent, (key,), child, key) for label, child, key, parent in REVIEW_LINKS]
    missing = [
        _review(
            label,
            figure(label, "missing_rows") == 0,
            text("missing=%d", figure(label, "missing_rows")),
            "technical", "High", True,
        )
        for label, *_ in REVIEW_LINKS
    ]
    return stacked([sizes, as_rows(link_facts(raw, links), missing)])


def line_checks(
    lines: DataFrame, profile: DataFrame, segments: DataFrame, policy: P.Policy = P.POLICY
) -> DataFrame:
    by_month = lines.groupBy("order_month").agg(
        F.sum("line_revenue").alias("revenue"), F.sum("gross_margin_value").alias("margin")
    )
    outside = F.lit(False)
    for name in (
        "share_orders_discounted", "share_orders_high_discount", "revenue_high_discount_share",
    ):
        outside = outside | ~F.coalesce(col(name).between(0, 1), F.lit(False))
    facts = _line_facts(lines, policy).withColumns(
        {
            "segment": segments.agg(F.sum("total_revenue")).scalar(),
            "margin_monthly": by_month.agg(
                F.sum(col("margin") / F.nullif(col("revenue"), F.lit(0.0)) * col("revenue"))
                / F.sum("revenue")
            ).scalar(),
            "outside": profile.agg(count_if(outside)).scalar(),
        }
    )
    revenue = col("revenue")
    return as_rows(
        facts,
        [
            _review(
                "discount_logic_consistency",
                col("discount_gap") <= P.DISCOUNT_TOLERANCE,
                text("max_abs_diff=%.6f", col("discount_gap")),
                "consistency", "High", True,
            ),
            _review(
                "realized_lte_list",
                col("above_list") == 0,
                text("violations=%d", col("above_list")),
                "consistency", "High", True,
            ),
            _review(
                "revenue_total_segment_match",
                F.abs(revenue - col("segment")) <= F.greatest(F.lit(1.0), revenue * 0.0001),
                text("pricing=%.2f, segment=%.2f", revenue, col("segment")),
                "consistency", "High", True,
            ),
            _review(
                "margin_proxy_consistency_line_vs_monthly",
                F.abs(col("margin_direct") - col("margin_monthly")) <= 0.001,
                text("line=%.6f, monthly=%.6f", col("margin_direct"), col("margin_monthly")),
                "consistency", "High", True,
            ),
            _review(
                "period_completeness_monthly",
                col("months_expected") == col("months_observed"),
                text("expected=%d, observed=%d", col("months_expected"), col("months_observed")),
                "analytical", "Medium", False,
            ),
            _review(
                "share_denominator_bounds",
                col("outside") == 0,
                text("rows_outside=%d", col("outside")),
                "analytical", "High", False,
            ),
            _review(
                "weighted_discount_consistency",
                F.abs(col("discount_direct") - col("discount_total")) <= 0.001,
                text("direct=%.6f, total=%.6f", col("discount_direct"), col("discount_total")),
                "analytical", "High", False,
            ),
        ],
    )


def tier_medians(area: StagingArea, scores: DataFrame) -> DataFrame:
    return exact_quantiles(
        area, scores, ["risk_tier"], "governance_priority_score", {"median_score": 0.5}
    )


def score_checks(area: StagingArea, scores: DataFrame) -> DataFrame:
    """Spread, tier order, driver and action agreement, and shrinkage of thin accounts."""
    score = col("governance_priority_score")
    distance = F.abs(score - P.NEUTRAL_SCORE)
    low = col("low_data_flag") == 1
    allowed = F.lit(False)
    for tier, actions in P.ACTIONS_BY_TIER.items():
        allowed = allowed | ((col("risk_tier") == tier) & col("recommended_action").isin(*actions))
    rank = F.array_position(F.array(*[F.lit(t) for t in P.TIERS_ASCENDING]), col("risk_tier"))
    medians = (
        tier_medians(area, scores)
        .where(rank > 0)
        .agg(
            F.sort_array(F.collect_list(F.struct(rank.alias("r"), "median_score", "risk_tier")))
            .alias("m")
        )
    )
    facts = scores.agg(
        F.var_pop(score).alias("variance"),
        count_if(~F.coalesce(main_driver() == col("main_risk_driver"), F.lit(False))).alias("driver"),
        count_if(~F.coalesce(allowed, F.lit(False))).alias("action"),
        F.avg(F.when(low, distance)).alias("low_mean"),
        F.avg(F.when(~low, distance)).alias("high_mean"),
    ).withColumn("m", medians.scalar())
    ordered = F.transform("m", lambda x: x["median_score"])
    steps = F.transform("m", lambda x: F.format_string("%s:%.3f", x["risk_tier"], x["median_score"]))
    split = col("low_mean").isNotNull() & col("high_mean").isNotNull()
    return as_rows(
        facts,
        [
            _review(
                "risk_score_nontrivial_variance",
                col("variance") > 1.0,
                text("variance=%.6f", col("variance")),
                "governance", "Medium", False,
            ),
            _review(
                "risk_tier_monotonicity_by_median_score",
                ordered == F.sort_array(ordered),
                F.concat(F.lit("median_scores="), F.array_join(steps, ", ")),
                "governance", "High", False,
            ),
            _review(
                "main_risk_driver_alignment",
                col("driver") == 0,
                text("mismatches=%d", col("driver")),
                "governance", "High", False,
            ),
            _review(
                "recommended_action_policy_alignment",
                col("action") == 0,
                text("invalid_rows=%d", col("action")),
                "governance", "Medium", False,
            ),
            _review(
                "score_stability_low_data_shrinkage",
                ~split | (col("low_mean") <= col("high_mean") + 2.0),
                F.when(
                    split,
                    text("low_data=%.3f, high_data=%.3f", col("low_mean"), col("high_mean")),
                ).otherwise("not applicable: one of the two groups is empty"),
                "governance", "Medium", False,
            ),
        ],
    )


def cross_output_checks(
    lines: DataFrame, overall: DataFrame, cube: DataFrame, policy: P.Policy = P.POLICY
) -> DataFrame:
    """Exported overall row and the cube's all-scope row against the lines."""
    all_scope = F.lit(True)
    for name in P.SCOPE_DIMS:
        all_scope = all_scope & (col(name) == P.ALL)
    exported = overall.select(
        F.struct("total_revenue", "weighted_realized_discount", "high_discount_revenue_share")
    ).scalar()
    cell = cube.where(all_scope).agg(
        F.struct(
            F.max("net_revenue").alias("net"), F.max("weighted_discount_pct").alias("discount")
        )
    ).scalar()
    facts = lines.agg(
        F.sum("line_revenue").alias("revenue"),
        F.sum("line_list_revenue").alias("list_revenue"),
        sum_if(col("discount_depth") >= policy.high_discount, col("line_revenue")).alias("high"),
    ).withColumns({"x": exported, "c": cell})
    base = F.greatest(F.lit(1.0), col("revenue"))
    discount = F.lit(1.0) - col("revenue") / col("list_revenue")
    gaps = F.greatest(
        F.abs(col("x.weighted_realized_discount") - discount),
        F.abs(
            col("x.high_discount_revenue_share") - ratio(col("high"), col("revenue"), 0.0)
        ),
        F.abs(col("x.total_revenue") - col("revenue")) / base,
    )
    revenue_gap = F.abs(col("c.net") - col("revenue")) / base
    discount_gap = F.abs(col("c.discount") - discount)
    return as_rows(
        facts,
        [
            _review(
                "cross_output_overall_health_consistency",
                gaps <= 0.001,
                text("max_diff=%.6f", gaps),
                "consistency", "High", False,
            ),
            _review(
                "dashboard_kpi_all_scope_consistency",
                (revenue_gap <= 0.001) & (discount_gap <= 0.001),
                text("revenue_diff=%.6f, discount_diff=%.6f", revenue_gap, discount_gap),
                "consistency", "High", False,
            ),
        ],
    )


def status_report_check(name: str, report: DataFrame, gate: str) -> DataFrame:
    """A report passes when it has rows, only PASS and FAIL, and no FAIL."""
    facts = report.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(col("status") == "FAIL").alias("failures"),
        count_if(~F.coalesce(col("status").isin("PASS", "FAIL"), F.lit(False))).alias("invalid"),
    )
    detail = text(
        "rows=%d, failures=%d, invalid_statuses=%d", col("rows"), col("failures"), col("invalid")
    )
    passed = (col("rows") > 0) & (col("failures") == 0) & (col("invalid") == 0)
    return as_rows(facts, [_review(name, passed, detail, gate, "High", True)])


def readiness(report: DataFrame) -> DataFrame:
    """One row: failure counts, readiness flags and release state of a review report."""
    failed = col("status") == "FAIL"
    analytical = failed & col("gate").isin("analytical", "consistency", "governance")
    counts = report.agg(
        count_if(failed).alias("failed_checks"),
        count_if(failed & col("blocker")).alias("failed_blocker_checks"),
        count_if(failed & (col("gate") == "technical")).alias("failed_technical_checks"),
        count_if(analytical).alias("failed_analytical_checks"),
    )
    blocked = col("failed_blocker_checks") > 0
    technical = ~blocked & (col("failed_technical_checks") == 0)
    acceptable = technical & (col("failed_analytical_checks") == 0)
    state = (
        F.when(blocked, "publish-blocked")
        .when(acceptable, P.REQUIRED_STATE)
        .when(technical, "technical-only")
        .otherwise("publish-blocked")
    )
    return counts.select(
        "*",
        technical.alias("technically_valid"),
        acceptable.alias("analytically_acceptable"),
        acceptable.alias("decision_support_only"),
        blocked.alias("publish_blocked"),
        state.alias("release_readiness_state"),
    )


def exclusions(customers: DataFrame, profile: DataFrame) -> DataFrame:
    """Customers without orders; worth a Medium finding above 5 %, a Low one above none."""
    facts = customers.agg(F.count_distinct("customer_id").alias("total")).withColumn(
        "profiled", profile.agg(F.count_distinct("customer_id")).scalar()
    )
    excluded = col("total") - col("profiled")
    share = ratio(excluded.cast("double"), col("total"))
    severity = F.when(excluded <= 0, "None").when(share > P.EXCLUSION_MEDIUM_SHARE, "Medium")
    return facts.select(
        excluded.alias("excluded_customers"),
        share.alias("excluded_customer_pct"),
        severity.otherwise("Low").alias("severity"),
    )


def release_gate(summary: DataFrame, contract_rows: DataFrame) -> DataFrame:
    """Gate rules on the readiness summary and the contract report, one row per rule."""
    contracts = contract_rows.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            count_if(col("status") == "FAIL").alias("failures"),
            count_if(~F.coalesce(col("status").isin("PASS", "FAIL"), F.lit(False))).alias("invalid"),
        )
    ).scalar()
    facts = summary.withColumn("c", contracts)

    def row(name: str, passed: Column, detail: Column) -> dict:
        return {"rule_name": name, "status": status(passed), "detail": detail}

    rules = [
        row(
            f"readiness_flag_{name}",
            col(name) == required,
            text(f"expected={str(required).lower()}, observed=%s", col(name).cast("string")),
        )
        for name, required in P.REQUIRED_FLAGS.items()
    ]
    state = col("release_readiness_state")
    rules += [
        row(
            "release_readiness_state",
            state == P.REQUIRED_STATE,
            text(f"expected={P.REQUIRED_STATE}, observed=%s", state),
        ),
        row(
            "max_failed_checks",
            col("failed_checks") <= P.MAX_FAILED_CHECKS,
            text(f"max={P.MAX_FAILED_CHECKS}, observed=%d", col("failed_checks")),
        ),
        row(
            "max_failed_blocker_checks",
            col("failed_blocker_checks") <= P.MAX_FAILED_BLOCKERS,
            text(f"max={P.MAX_FAILED_BLOCKERS}, observed=%d", col("failed_blocker_checks")),
        ),
        row(
            "metric_contract_report_valid",
            (col("c.rows") > 0)
            & (col("c.invalid") == 0)
            & (col("c.failures") <= P.MAX_CONTRACT_FAILURES),
            text(
                "rows=%d, failures=%d, invalid_statuses=%d",
                col("c.rows"),
                col("c.failures"),
                col("c.invalid"),
            ),
        ),
    ]
    return as_rows(facts, rules)


def blocking_reasons(gate: DataFrame) -> DataFrame:
    """Failed gate rules; the gate passes when there are none."""
    return gate.where(col("status") != "PASS").select("rule_name", "detail")
