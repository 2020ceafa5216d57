from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelens.plans import customers, marts, risk
from tests.conftest import by_name, enriched_rows
from pricelens.plans import fact

SIGNALS = (
    "customer_id string, segment string, region string, company_size string,"
    " total_orders bigint, total_order_items bigint, total_revenue double,"
    " avg_discount_pct double, weighted_discount_pct double,"
    " share_order_items_discounted double, product_diversity bigint,"
    " avg_margin_proxy_pct double, realized_price_cv double,"
    " avg_abs_price_realization_residual_pct double, share_orders_discounted double,"
    " share_orders_high_discount double, repeat_discount_behavior double,"
    " revenue_high_discount_share double"
)


def profile_row(name, orders=6, discount=0.0, share=0.0, margin=0.8, residual=0.0, average=None):
    average = discount if average is None else average
    return (
        name, "S", "North", "Large", orders, 10, 100.0, average, discount, share, 1, margin, 0.0,
        residual, share, share, share, share,
    )


def scored(spark, area, *rows):
    return by_name(risk.scored(area, spark.createDataFrame(list(rows), SIGNALS)), "customer_id")


@pytest.fixture(scope="module")
def ledger(area, four_lines):
    return area.put_in_order(
        "ledger", customers.order_level(four_lines), *customers.LEDGER_ORDER, chunks=3
    )


def test_profile_of_four_lines(four_lines, ledger):
    rows = by_name(customers.profile(four_lines, ledger), "customer_id")
    first, second = rows["C1"], rows["C2"]
    assert first.total_orders == 3
    assert first.weighted_discount_pct == pytest.approx(110 / 660)
    assert first.share_orders_high_discount == pytest.approx(2 / 3)
    assert first.repeat_discount_behavior == pytest.approx(0.5)
    assert first.revenue_high_discount_share == pytest.approx(350 / 550)
    assert first.avg_margin_proxy_pct == pytest.approx(164 / 550)
    assert first.product_diversity == 2
    for name in (
        "total_revenue", "avg_margin_proxy_pct", "revenue_high_discount_share",
        "repeat_discount_behavior", "realized_price_cv",
    ):
        assert second[name] == 0


def test_labels_take_the_smallest_value(spark, area):
    lines = fact.pricing_metrics(
        enriched_rows(
            spark,
            [
                ("a", "o1", "2024-01-01", "c", "Z", "p", "k", "ch", 1, 10.0, 10.0, 0.0, 1.0),
                ("b", "o2", "2024-01-01", "c", "A", "p", "k", "ch", 1, 10.0, 10.0, 0.0, 1.0),
            ],
        )
    )
    assert fact.labels(lines, "customer_id", "segment").first().segment == "A"


def test_same_day_orders_follow_the_order_id(spark, area):
    lines = fact.pricing_metrics(
        enriched_rows(
            spark,
            [
                ("a", "o1", "2024-01-01", "c", "s", "p", "k", "ch", 1, 10.0, 7.0, 0.3, 1.0),
                ("b", "o2", "2024-01-01", "c", "s", "p", "k", "ch", 1, 10.0, 10.0, 0.0, 1.0),
                ("c", "o3", "2024-01-01", "c", "s", "p", "k", "ch", 1, 10.0, 7.0, 0.3, 1.0),
                ("d", "o4", "2024-01-02", "c", "s", "p", "k", "ch", 1, 10.0, 7.0, 0.3, 1.0),
            ],
        )
    )
    ledger = area.put_in_order(
        "same_day", customers.order_level(lines), *customers.LEDGER_ORDER, chunks=2
    )
    assert customers.order_stats(ledger).first().repeat_discount_behavior == pytest.approx(1 / 3)


def test_extreme_and_clean_accounts(spark, area):
    rows = scored(
        spark,
        area,
        profile_row("extreme", discount=0.99, share=1.0, margin=0.0, residual=0.2),
        profile_row("clean"),
    )
    assert rows["extreme"].risk_tier == "Critical"
    assert rows["extreme"].recommended_action == "review pricing variance"
    assert rows["clean"].risk_tier == "Low"
    assert rows["clean"].recommended_action == "monitor only"


def test_no_orders_is_neutral(spark, area):
    row = scored(spark, area, profile_row("new", orders=0, discount=0.9, share=1.0))["new"]
    assert row.governance_priority_score == 50 and row.pricing_risk_score == 50
    assert row.risk_tier == "Medium" and row.low_data_flag == 1


def test_equal_values_are_neutral(spark, area):
    table = spark.createDataFrame([profile_row(n, share=0.3) for n in "abc"], SIGNALS)
    for row in risk.signals(area, table).collect():
        assert row.rel_order_share == 50 and row.rel_margin == 50


def test_weighted_discount_drives_the_score(spark, area):
    rows = scored(
        spark,
        area,
        profile_row("deep", discount=0.5, average=0.1),
        profile_row("flat", discount=0.1, average=0.5),
    )
    assert rows["deep"].pricing_risk_score > rows["flat"].pricing_risk_score


def test_review_queue_keeps_every_high_account(spark):
    tiers = [("Critical", 80)] + [("High", 70)] + [("Medium", 20)]
    rows = [
        (f"{tier}-{i}", tier, 50.0 + i / 100)
        for tier, count in tiers
        for i in range(count)
    ]
    table = spark.createDataFrame(
        rows, "customer_id string, risk_tier string, governance_priority_score double"
    )
    got = risk.review_queue(table).collect()
    assert len(got) == 150 and {r.risk_tier for r in got} == {"Critical", "High"}


def test_review_queue_fills_with_the_best(spark):
    rows = [("h", "High", 70.0)] + [(f"m{i:03d}", "Medium", float(i)) for i in range(300)]
    table = spark.createDataFrame(
        rows, "customer_id string, risk_tier string, governance_priority_score double"
    )
    got = risk.review_queue(table).collect()
    assert len(got) == 140
    assert min(r.governance_priority_score for r in got if r.risk_tier == "Medium") == 161.0


def test_segment_summary_of_single_lines(area, four_lines):
    rows = by_name(marts.segment_summary(area, four_lines), "segment")
    assert rows["S2"].realized_price_variance == 0.0
    assert rows["S2"].avg_margin_proxy_pct == 0.0
    assert rows["S1"].median_discount_pct == pytest.approx(0.2)
    assert by_name(marts.segment_mart(area, four_lines), "segment")["S2"].avg_margin_proxy_pct is None


def test_buckets_are_listed_in_order_even_when_empty(four_lines):
    got = marts.revenue_by_bucket(four_lines).orderBy("bucket_order").collect()
    assert [(r.discount_bucket, r.revenue) for r in got] == [
        ("0-5%", 200.0), ("5-10%", 0.0), ("10-20%", 80.0), ("20-30%", 270.0), ("30%+", 0.0),
    ]
    margins = marts.margin_by_bucket(four_lines).orderBy("bucket_order").collect()
    assert margins[1].margin_proxy_pct is None


def test_month_pivot_fills_zero(four_lines):
    row = marts.month_by_flag(four_lines.where(F.col("high_discount_flag") == 0)).first()
    assert (row.standard_discount_revenue, row.high_discount_revenue) == (200.0, 0.0)
