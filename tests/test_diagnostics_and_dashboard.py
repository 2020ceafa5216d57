from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.plans import customers, dashboard, diagnostics, marts, sql_models
from pricelens.plans.dashboard import Scope
from pricelens.plans.fact import pricing_metrics
from tests.conftest import enriched_rows


@pytest.fixture(scope="module")
def frame(spark, area):
    draw = np.random.default_rng(7)
    rows = []
    for i in range(240):
        discount = round(float(draw.uniform(0.05, 0.40)), 4)
        listed = float(draw.integers(50, 200))
        rows.append(
            (
                f"OI{i}", f"O{i // 2}", f"202{i % 3}-0{1 + i % 6}-0{1 + i % 9}", f"C{(i // 2) % 13}",
                f"S{(i // 2) % 13 % 2}", f"P{i % 5}", f"K{i % 3}", ["Online", "Field"][i % 2],
                int(draw.integers(1, 9)), listed, listed * (1 - discount), discount, listed * 0.5,
            )
        )
    return area.put("d_lines", pricing_metrics(enriched_rows(spark, rows)))


@pytest.fixture(scope="module")
def lines(frame) -> pd.DataFrame:
    return frame.toPandas()


@pytest.fixture(scope="module")
def profile(area, frame):
    ledger = area.put_in_order("d_ledger", customers.order_level(frame), *customers.LEDGER_ORDER)
    return area.put("d_profile", customers.profile(frame, ledger))


def test_threshold_sensitivity_against_one_pass_per_threshold(frame, lines):
    total = lines.groupby("customer_id").line_revenue.sum()
    for row in diagnostics.threshold_sensitivity(frame).collect():
        high = lines[lines.discount_depth >= row.high_discount_threshold]
        share = high.groupby("customer_id").line_revenue.sum().reindex(total.index).fillna(0) / total
        assert row.high_discount_revenue_share == pytest.approx(
            high.line_revenue.sum() / lines.line_revenue.sum()
        )
        assert row.high_discount_order_item_share == pytest.approx(len(high) / len(lines))
        assert row.margin_proxy_pct_on_high_discount == pytest.approx(
            high.gross_margin_value.sum() / high.line_revenue.sum()
        )
        assert row[
            "customer_share_above_policy_high_discount_revenue_threshold"
        ] == pytest.approx((share >= 0.40).mean())
        assert row.revenue_with_margin_at_risk == pytest.approx(
            high[high.margin_proxy_pct < 0.35].line_revenue.sum()
        )


def test_sensitivity_without_high_lines(frame):
    policy = P.Policy(sensitivity=(0.9,))
    row = diagnostics.threshold_sensitivity(frame, policy).first()
    assert row.high_discount_revenue_share == 0.0
    assert row.margin_proxy_pct_on_high_discount is None


def test_many_thresholds_have_the_plan_of_few(frame, lines):
    many = P.Policy(sensitivity=tuple(round(0.004 * i, 3) for i in range(200, 0, -1)))
    few = diagnostics.threshold_sensitivity(frame, P.Policy(sensitivity=(0.2, 0.1, 0.2)))
    got = diagnostics.threshold_sensitivity(frame, many)

    def nodes(plan):
        return plan._jdf.queryExecution().analyzed().toString().count("\n")

    assert nodes(got) == nodes(few)
    assert sorted(r.high_discount_threshold for r in few.collect()) == [0.1, 0.2, 0.2]
    total = lines.groupby("customer_id").line_revenue.sum()
    rows = got.collect()
    assert len(rows) == 200
    for row in rows:
        high = lines[lines.discount_depth >= row.high_discount_threshold]
        share = high.groupby("customer_id").line_revenue.sum().reindex(total.index).fillna(0) / total
        assert row.high_discount_revenue_share == pytest.approx(high.line_revenue.sum() / total.sum())
        assert row[4] == pytest.approx((share >= 0.40).mean())
        at_risk = high[high.margin_proxy_pct < 0.35].line_revenue.sum()
        assert row.revenue_with_margin_at_risk == pytest.approx(at_risk)


def test_concentration(area, profile):
    row = diagnostics.dependency_concentration(area, profile).first()
    data = profile.toPandas().sort_values(
        ["revenue_high_discount_share", "total_revenue"], ascending=False
    )
    assert row.top_decile_customers == 2
    assert row.revenue_share_of_top_dependency_decile == pytest.approx(
        data.head(2).total_revenue.sum() / data.total_revenue.sum()
    )


def test_revenue_curve(area, profile):
    got = diagnostics.revenue_concentration(area, profile).orderBy("customer_rank").toPandas()
    want = np.sort(profile.toPandas().total_revenue)[::-1]
    np.testing.assert_allclose(got.cumulative_revenue_share, want.cumsum() / want.sum())
    top = diagnostics.top_revenue_shares(area, profile).first()
    assert top.top10_rev_share == pytest.approx(want[0] / want.sum())
    assert top.top20_rev_share == pytest.approx(want[:2].sum() / want.sum())


def test_too_few_customers_have_no_top_share(area, profile):
    few = profile.where("customer_id in ('C1', 'C2')")
    assert diagnostics.top_revenue_shares(area, few).first().top10_rev_share is None


def test_growth(spark):
    years = "year int, revenue double"
    row = diagnostics.period_growth(spark.createDataFrame([(2023, 100.0), (2025, 150.0)], years))
    assert row.first().growth_pct == pytest.approx(50)
    single = diagnostics.period_growth(spark.createDataFrame([(2023, 100.0)], years)).first()
    assert single.growth_pct is None
    zero = diagnostics.period_growth(spark.createDataFrame([(2023, 0.0), (2024, 1.0)], years))
    assert zero.first().growth_pct is None


@pytest.mark.parametrize(
    ("discount", "share", "margin", "expected"),
    [
        (0.10, 0.20, 0.50, "Sold cleanly"),
        (0.15, 0.20, 0.50, "Mixed"),
        (0.10, 0.75, 0.50, "Discount-reliant"),
        (0.35, 0.10, 0.50, "Discount-reliant"),
        (0.25, 0.50, 0.29, "Margin-pressure"),
        (0.25, 0.50, 0.30, "Mixed"),
    ],
)
def test_pricing_patterns(spark, discount, share, margin, expected):
    pattern = diagnostics.pricing_pattern(F.lit(discount), F.lit(share), F.lit(margin))
    assert spark.range(1).select(pattern.alias("p")).first().p == expected


def test_rep_outliers(spark, area):
    """Eleven reps of one team, one of them far from its peers; thin reps are left out."""
    rows = []
    for rep in range(12):
        for i in range(120 if rep < 11 else 119):
            depth = 0.3 if rep == 0 else 0.1 + 0.001 * rep
            rows.append((f"R{rep}", depth, 10.0, 1.0))
    table = spark.createDataFrame(
        rows,
        "sales_rep_id string, discount_depth double, line_revenue double,"
        " gross_margin_value double",
    ).withColumns({"team": F.lit("T"), "rep_region": F.lit("N")})
    got = {r.sales_rep_id: r for r in diagnostics.rep_behaviour(table).collect()}
    assert len(got) == 11
    assert [k for k, r in got.items() if r.discount_outlier_flag] == ["R0"]


def test_single_rep_has_no_deviation(spark):
    table = spark.createDataFrame(
        [("R", "T", "N", 0.1, 10.0, 1.0)] * 120,
        "sales_rep_id string, team string, rep_region string, discount_depth double,"
        " line_revenue double, gross_margin_value double",
    )
    row = diagnostics.rep_behaviour(table).first()
    assert row.discount_zscore_vs_peers == 0 and row.discount_outlier_flag is False


def test_queue_fills_missing_leakage(spark, frame, area, profile):
    from pricelens.plans import risk

    scores = area.put("d_scores", risk.scored(area, profile))
    idle = scores.where("customer_id = 'C1'").withColumn("customer_id", F.lit("C99"))
    queue = diagnostics.action_queue(frame, scores.unionByName(idle))
    row = queue.where("customer_id = 'C99'").first()
    assert row.revenue_in_scope == row.total_revenue
    assert row.margin_at_risk_revenue == row.priority_value_proxy == 0


def test_sql_and_frame_paths_agree(frame, profile, area):
    for report in (
        sql_models.parity("o", sql_models.overall(frame), marts.overall(frame), ["as_of_date"]),
        sql_models.parity("m", sql_models.monthly(frame), marts.monthly(frame), ["order_month"]),
    ):
        assert report.agg(F.sum("differing_rows")).first()[0] == 0
    off = marts.overall(frame).withColumn("total_revenue", F.col("total_revenue") + 1)
    report = sql_models.parity("o", sql_models.overall(frame), off, ["as_of_date"])
    assert [r.metric for r in report.where("differing_rows > 0").collect()] == ["total_revenue"]


# --- dashboard -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(area, frame):
    return area.put("d_facts", dashboard.monthly_facts(frame))


def test_cube_cells_add_up(facts, lines):
    cube = dashboard.kpi_cube(facts).toPandas().set_index(list(P.SCOPE_DIMS))
    total = lines.line_revenue.sum()
    assert cube.loc[("All",) * 4].net_revenue == pytest.approx(total)
    assert cube.xs(("All", "All", "All"), level=["region", "category", "sales_channel"]).drop(
        "All"
    ).net_revenue.sum() == pytest.approx(total)
    cell = lines[(lines.segment == "S1") & (lines.sales_channel == "Field")]
    assert cube.loc[("S1", "All", "All", "Field")].net_revenue == pytest.approx(
        cell.line_revenue.sum()
    )


def test_null_dimension_is_no_subtotal(spark):
    table = spark.createDataFrame(
        [("2024-01", None, "N", "K", "C", 1.0, 1.0, 0.0, 0.0, 0.0)],
        "order_month string, segment string, region string, category string, sales_channel string,"
        " line_revenue double, line_list_revenue double, discount_weighted_num double,"
        " high_discount_revenue double, margin_risk_revenue double",
    )
    assert {r.segment for r in dashboard.kpi_cube(table).collect()} == {None, "All"}


def test_scope_filters_and_swaps_the_period(facts, lines):
    scope = Scope(segment="S1", start="2022-03", end="2021-01")
    row = dashboard.scoped_kpi(facts, scope).first()
    month = lines.order_date.astype(str).str[:7]
    period = lines[(month >= "2021-01") & (month <= "2022-03")]
    inside = period[period.segment == "S1"]
    assert row.net_revenue == pytest.approx(inside.line_revenue.sum())
    assert row.revenue_coverage_share == pytest.approx(
        inside.line_revenue.sum() / period.line_revenue.sum()
    )
    given = (inside.discount_depth * inside.line_list_revenue).sum()
    assert row.leakage == pytest.approx(given)
    assert row.weighted_discount_pct == pytest.approx(given / inside.line_list_revenue.sum())


def test_empty_scope_is_zero(facts):
    row = dashboard.scoped_kpi(facts, Scope(segment="nowhere")).first()
    assert row.net_revenue == 0 and row.weighted_discount_pct == 0 and row.margin_risk_share == 0


def test_accounts_of_a_scope(spark, area, frame, profile, lines):
    from pricelens.plans import risk

    scores = area.put("d_scores2", risk.scored(area, profile))
    account_facts = dashboard.customer_facts(frame, scores)
    scope = Scope(segment="S0", category="K1")
    got = {r.customer_id: r for r in dashboard.scoped_accounts(scores, account_facts, scope).collect()}
    inside = lines[(lines.segment == "S0") & (lines.category == "K1")]
    want = inside.groupby("customer_id").line_revenue.sum()
    assert {k: pytest.approx(r.filtered_revenue) for k, r in got.items()} == want.to_dict()


@pytest.mark.parametrize(
    ("discount", "exposed", "high", "posture"),
    [
        (0.139, 0.119, 34, "ok"),
        (0.14, 0.0, 0, "warn"),
        (0.0, 0.12, 0, "warn"),
        (0.0, 0.0, 35, "warn"),
        (0.20, 0.0, 0, "critical"),
        (0.0, 0.20, 0, "critical"),
        (0.0, 0.0, 80, "critical"),
    ],
)
def test_posture_edges(spark, discount, exposed, high, posture):
    table = spark.createDataFrame(
        [("2024-01", "S", "N", "K", "C", 1000.0, 1000.0, 1000.0 * discount, 0.0, 1000.0 * exposed)],
        "order_month string, segment string, region string, category string, sales_channel string,"
        " line_revenue double, line_list_revenue double, discount_weighted_num double,"
        " high_discount_revenue double, margin_risk_revenue double",
    )
    accounts = spark.range(high).select(F.lit("High").alias("risk_tier"))
    assert dashboard.scoped_indicators(table, accounts, Scope()).first().posture == posture


def test_bridge_never_protects_less_than_nothing(spark):
    kpi = spark.createDataFrame(
        [(100.0, 60.0, 70.0)], "list_revenue double, net_revenue double, margin_at_risk double"
    )
    got = [r.value for r in dashboard.bridge(kpi).orderBy("step_order").collect()]
    assert got == [100.0, -40.0, 60.0, -60.0, 0.0]


def test_trend_compares_with_the_month_before(facts):
    got = dashboard.scoped_trend(facts, Scope()).orderBy("order_month").toPandas()
    assert pd.isna(got.delta_pts[0])
    np.testing.assert_allclose(got.delta_pts[1:], got.weighted_discount_pct.diff()[1:] * 100)


def test_queue_table_sorts_both_ways(spark):
    accounts = spark.createDataFrame([(i, float(i)) for i in range(130)], "customer_id int, v double")
    high = dashboard.queue_table(accounts, "v").collect()
    low = dashboard.queue_table(accounts, "v", descending=False).collect()
    assert len(high) == 120 and (high[0].v, low[0].v) == (129.0, 0.0)
