"""Every check passes on valid tables and fails on the mutation it is there for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.plans import contracts, customers, marts, quality, review, risk
from pricelens.plans.fact import pricing_metrics
from tests.conftest import by_name, enriched_rows


def failed(report) -> set[str]:
    return {r.check_name for r in report.where("status = 'FAIL'").collect()}


def test_valid_raw_tables_pass(raw_tables):
    report = quality.raw_report(raw_tables)
    assert failed(report) == set()
    assert report.count() == 10 + 20 + 9


def test_missing_table_or_column_ends_the_report(raw_tables):
    less = {k: v for k, v in raw_tables.items() if k != "products"}
    report = by_name(quality.raw_report(less))
    assert report["products_exists"].status == "FAIL" and len(report) == 5
    cut = {**raw_tables, "orders": raw_tables["orders"].drop("sales_channel")}
    report = by_name(quality.raw_report(cut))
    assert report["orders_required_columns"].failed_rows == 1 and len(report) == 5


def with_values(tables, **changes):
    """Tables with columns overwritten: table__column=value."""
    out = dict(tables)
    for place, value in changes.items():
        table, column = place.split("__")
        kind = out[table].schema[column].dataType
        out[table] = out[table].withColumn(column, F.lit(value).cast(kind))
    return out


def test_raw_values_out_of_range_are_found(raw_tables):
    broken = with_values(
        raw_tables,
        order_items__discount_pct=-0.1,
        order_items__quantity=0,
        order_items__realized_unit_price=101.0,
        products__list_price=0.0,
        products__unit_cost=-1.0,
        orders__order_date="2022-12-31",
    )
    assert failed(quality.raw_pricing_rules(broken)) == {
        "order_items_discount_bounds",
        "order_items_realized_lte_list",
        "order_items_positive_quantity",
        "order_items_discount_formula_consistency",
        "products_positive_list_price",
        "products_non_negative_unit_cost",
        "orders_not_before_customer_signup",
    }


def test_small_discount_gap_bad_date_and_free_list_price_are_found(raw_tables):
    broken = with_values(
        raw_tables, order_items__discount_pct=0.101, customers__signup_date="not a date"
    )
    assert failed(quality.raw_pricing_rules(broken)) == {
        "order_items_discount_formula_consistency",
        "customer_and_order_dates_valid",
    }
    free = with_values(
        raw_tables, order_items__list_price_at_sale=0.0, order_items__realized_unit_price=0.0
    )
    assert failed(quality.raw_pricing_rules(free)) == {"order_items_positive_list_price"}


def test_broken_links_and_empty_cells_are_found(raw_tables):
    broken = with_values(
        raw_tables,
        order_items__product_id="P9",
        order_items__order_id="O9",
        orders__customer_id="C9",
        orders__sales_rep_id=None,
        customers__segment=None,
    )
    assert failed(quality.raw_integrity(broken)) == {
        "order_items_product_fk",
        "order_items_order_fk",
        "orders_customer_fk",
        "orders_sales_rep_fk",
        "customers_nulls",
        "orders_nulls",
    }


def test_duplicate_keys_are_counted(raw_tables):
    broken = {**raw_tables, "orders": raw_tables["orders"].unionAll(raw_tables["orders"])}
    assert by_name(quality.raw_integrity(broken))["orders_unique_order_id"].failed_rows == 1


def test_empty_table_fails_the_row_gate(raw_tables):
    broken = {**raw_tables, "orders": raw_tables["orders"].where("false")}
    assert "orders_row_count_gate" in failed(quality.raw_report(broken))


def test_text_in_a_number_stops_the_pricing_rules(raw_tables):
    items = raw_tables["order_items"].withColumn("quantity", F.lit("two"))
    broken = {**raw_tables, "order_items": items}
    report = by_name(quality.raw_report(broken))
    assert report["order_items_quantity_numeric"].failed_rows == 1
    assert "order_items_discount_bounds" not in report


@pytest.fixture(scope="module")
def processed(spark, area):
    """Twelve lines of four customers and everything derived from them."""
    rows = [
        (
            f"OI{i}", f"O{i // 2}", f"2024-0{1 + i % 3}-1{i % 10}", f"C{i // 4}",
            f"S{(i // 4) % 2}", f"P{i % 3}", f"K{i % 3}", "Online" if i % 2 else "Field",
            1 + i % 4, 100.0, 100.0 * (1 - 0.05 * (i % 7)), round(0.05 * (i % 7), 4), 50.0,
        )
        for i in range(12)
    ]
    enriched = area.put("q_enriched", enriched_rows(spark, rows))
    lines = area.put("q_lines", pricing_metrics(enriched))
    ledger = area.put_in_order("q_ledger", customers.order_level(lines), *customers.LEDGER_ORDER)
    profile = area.put("q_profile", customers.profile(lines, ledger))
    scores = area.put("q_scores", risk.scored(area, profile))
    return {
        "order_item_enriched": enriched,
        "order_item_pricing_metrics": lines,
        "customer_pricing_profile": profile,
        "segment_pricing_summary": area.put("q_seg", marts.segment_summary(area, lines)),
        "customer_risk_scores": scores,
        "overall_pricing_health": marts.overall(lines),
    }


def test_valid_processed_tables_pass(processed):
    report = quality.processed_report(processed)
    assert failed(report) == set() and report.count() == 37


def test_tampered_revenue_is_found(processed):
    one = F.when(F.col("order_item_id") == "OI3", F.col("line_revenue") + 25)
    name = "order_item_pricing_metrics"
    tampered = one.otherwise(F.col("line_revenue"))
    broken = {**processed, name: processed[name].withColumn("line_revenue", tampered)}
    found = by_name(quality.processed_report(broken))
    assert found["order_item_pricing_metrics_line_revenue_formula"].failed_rows == 1
    assert found["customer_pricing_profile_weighted_margin_reconciliation"].status == "FAIL"


def test_processed_mutations_are_found(processed):
    broken = with_values(
        processed,
        customer_risk_scores__risk_tier="Severe",
        customer_risk_scores__recommended_action="manual override",
        customer_risk_scores__pricing_risk_score=101.0,
        customer_pricing_profile__share_orders_discounted=1.5,
        order_item_pricing_metrics__high_discount_flag=1,
        order_item_pricing_metrics__price_realization_residual_pct=0.5,
        order_item_pricing_metrics__order_item_id="same",
    )
    assert failed(quality.processed_report(broken)) == {
        "customer_risk_scores_allowed_tiers",
        "customer_risk_scores_allowed_actions",
        "pricing_risk_score_bounds",
        "customer_pricing_profile_share_orders_discounted_bounds",
        "order_item_pricing_metrics_high_discount_policy",
        "order_item_pricing_metrics_price_realization_residual_formula",
        "order_item_pricing_metrics_unique_order_item_id",
    }


def test_empty_scores_fail_their_gate_and_skip_the_rest(processed):
    empty = processed["customer_risk_scores"].where("false")
    report = by_name(quality.processed_report({**processed, "customer_risk_scores": empty}))
    assert report["customer_risk_scores_row_count_gate"].status == "FAIL"
    assert "customer_risk_scores_allowed_tiers" not in report
    assert "customer_profile_to_risk_rowcount_consistency" not in report


def test_contracts_pass(processed):
    report = contracts.contract_report(processed)
    assert failed(report) == set()


def test_contract_breaches_are_found(processed):
    broken = with_values(
        processed,
        customer_risk_scores__risk_tier="Severe",
        customer_pricing_profile__realized_price_cv=-1.0,
        order_item_pricing_metrics__customer_id=None,
        order_item_pricing_metrics__order_item_id="same",
    )
    profile = broken["customer_pricing_profile"]
    broken["customer_pricing_profile"] = profile.withColumn("total_revenue", F.lit("text"))
    report = contracts.contract_report(broken).where("status = 'FAIL'")
    assert {(r.contract_table, r.check_name) for r in report.collect()} == {
        ("customer_risk_scores", "allowed_values_risk_tier"),
        ("customer_pricing_profile", "bound_realized_price_cv"),
        ("customer_pricing_profile", "bound_total_revenue"),
        ("order_item_pricing_metrics", "key_null_rate"),
        ("order_item_pricing_metrics", "primary_key_uniqueness"),
    }


def test_contract_structure(processed):
    broken = dict(processed)
    broken["segment_pricing_summary"] = processed["segment_pricing_summary"].drop("segment")
    broken["customer_risk_scores"] = processed["customer_risk_scores"].where("false")
    del broken["overall_pricing_health"]
    rows = {
        (r.contract_table, r.check_name): r.status
        for r in contracts.contract_report(broken).collect()
    }
    assert rows["segment_pricing_summary", "required_columns_present"] == "FAIL"
    assert ("segment_pricing_summary", "key_null_rate") not in rows
    assert rows["customer_risk_scores", "row_count_positive"] == "FAIL"
    assert ("customer_risk_scores", "key_null_rate") not in rows
    assert rows["overall_pricing_health", "table_exists"] == "FAIL"


def test_analysis_report_finds_a_month_gap(processed):
    from pricelens.plans import diagnostics

    lines = processed["order_item_pricing_metrics"]

    def report(of):
        return review.analysis_report(
            of,
            processed["order_item_enriched"],
            marts.yearly(of),
            diagnostics.segment_dependency(of, processed["customer_pricing_profile"]),
            marts.overall(of),
            processed["customer_pricing_profile"],
        )

    assert failed(report(lines)) == set()
    gap = lines.where(F.month("order_date") != 2)
    assert {"trend_continuity_monthly", "row_count_sanity"} <= failed(report(gap))
    assert [str(r.order_month) for r in diagnostics.month_gaps(gap).collect()] == ["2024-02-01"]


def test_unknown_margins_fail_the_weighted_margin_check(four_lines, area):
    from pricelens.plans import diagnostics

    ledger = area.put_in_order("u", customers.order_level(four_lines), *customers.LEDGER_ORDER)
    profile = customers.profile(four_lines, ledger)
    report = review.analysis_report(
        four_lines,
        four_lines,
        marts.yearly(four_lines),
        diagnostics.segment_dependency(four_lines, profile),
        marts.overall(four_lines),
        profile,
    )
    assert failed(report) == {"aggregation_logic_weighted_margin"}


def test_score_checks(processed, area):
    scores = processed["customer_risk_scores"]
    wrong = scores.withColumn("main_risk_driver", F.lit("none")).withColumn(
        "recommended_action", F.lit("none")
    )
    found = failed(review.score_checks(area, wrong))
    assert {"main_risk_driver_alignment", "recommended_action_policy_alignment"} <= found
    swapped = scores.withColumn(
        "risk_tier", F.when(F.col("governance_priority_score") > 50, "Low").otherwise("High")
    )
    assert "risk_tier_monotonicity_by_median_score" in failed(review.score_checks(area, swapped))


def review_rows(spark, *fails):
    rows = [
        (name, "FAIL" if name in fails else "PASS", "", gate, "High", blocker)
        for name, gate, blocker in (
            ("blocker", "technical", True),
            ("technical", "technical", False),
            ("analytical", "analytical", False),
            ("governance", "governance", False),
        )
    ]
    return spark.createDataFrame(
        rows,
        "check_name string, status string, detail string, gate string, severity string,"
        " blocker boolean",
    )


@pytest.mark.parametrize(
    ("fails", "state", "failing_rules"),
    [
        ((), "decision-support only", 0),
        (("analytical",), "technical-only", 4),
        (("governance",), "technical-only", 4),
        (("technical",), "publish-blocked", 5),
        (("blocker",), "publish-blocked", 7),
    ],
)
def test_readiness_and_gate(spark, fails, state, failing_rules):
    summary = review.readiness(review_rows(spark, *fails))
    assert summary.first().release_readiness_state == state
    contract_rows = spark.createDataFrame([("PASS",)], "status string")
    gate = review.release_gate(summary, contract_rows)
    assert gate.count() == 8
    assert review.blocking_reasons(gate).count() == failing_rules


@pytest.mark.parametrize("statuses", [[], ["PASS", "FAIL"], ["PASS", "MAYBE"], ["PASS", None]])
def test_bad_status_reports_fail(spark, statuses):
    report = spark.createDataFrame([(s,) for s in statuses], "status string")
    row = review.status_report_check("r", report, "analytical").first()
    assert row.status == "FAIL"
    gate = review.release_gate(review.readiness(review_rows(spark)), report)
    assert by_name(gate, "rule_name")["metric_contract_report_valid"].status == "FAIL"


def test_exclusions(spark):
    everyone = spark.createDataFrame([(i,) for i in range(100)], "customer_id int")
    for kept, severity in ((100, "None"), (96, "Low"), (90, "Medium")):
        row = review.exclusions(everyone, everyone.where(f"customer_id < {kept}")).first()
        assert (row.excluded_customers, row.severity) == (100 - kept, severity)


def test_policy_weights_add_up():
    for blend in P.COMPONENTS.values():
        assert blend.relative_weight + blend.absolute_weight == pytest.approx(1)
        assert sum(blend.relative.values()) == pytest.approx(1)
        assert sum(blend.absolute.values()) == pytest.approx(1)
    assert sum(P.PRIORITY_WEIGHTS.values()) == pytest.approx(1)
