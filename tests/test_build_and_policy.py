from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.plans import build, diagnostics
from pricelens.plans.warehouse import Warehouse
from pricelens.sources import tpch
from pricelens.sources.generations import current, read_published
from tests.conftest import by_name

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return tpch.raw_tables(spark, FOLDER)


def test_checked_build_writes_the_bundle(spark, raw, tmp_path):
    warehouse = build.checked_build(spark, raw, str(tmp_path / "out"), ["parquet"])
    published = read_published(spark, str(tmp_path / "out"))
    assert set(published) == set(warehouse.derived_tables())
    assert current(spark, str(tmp_path / "out")).rows == {n: t.count() for n, t in published.items()}
    warehouse.close()


def test_bad_raw_rows_stop_the_build(spark, raw, tmp_path):
    items = raw["order_items"]
    broken = items.withColumn(
        "discount_pct", F.when(F.col("order_item_id") == items.first().order_item_id, 2.0).otherwise(F.col("discount_pct"))
    )
    with pytest.raises(build.CheckFailed, match="raw checks failed") as error:
        build.checked_build(spark, {**raw, "order_items": broken}, str(tmp_path / "out"))
    assert error.value.report.where("status = 'FAIL'").count() >= 1
    assert not (tmp_path / "out").exists()


def test_broken_links_stop_the_build(spark, raw):
    twice = raw["products"].unionByName(raw["products"].limit(1))
    with pytest.raises(ValueError):
        build.checked_build(spark, {**raw, "products": twice})
    with pytest.raises(ValueError):
        build.checked_build(spark, {**raw, "customers": raw["customers"].where("customer_id > 20")})


def test_one_threshold_moves_everything(spark, raw):
    low = Warehouse(spark, raw, policy=P.Policy(high_discount=0.06, margin_at_risk=0.9))
    usual = Warehouse(spark, raw)

    def figures(w: Warehouse) -> list[float]:
        high = F.sum("high_discount_revenue")
        return [
            w.lines.agg(F.sum("high_discount_flag")).first()[0],
            w.scope_facts.agg(high).first()[0],
            diagnostics.customer_leakage(w.lines, w.policy).agg(high).first()[0],
            w.profile.agg(F.avg("share_orders_high_discount")).first()[0],
            w.scope_facts.agg(F.sum("margin_risk_revenue")).first()[0],
        ]

    assert all(a > b for a, b in zip(figures(low), figures(usual), strict=True))
    facts = low.scope_facts.agg(F.sum("high_discount_revenue")).first()[0]
    flagged = low.lines.where("high_discount_flag = 1").agg(F.sum("line_revenue")).first()[0]
    assert facts == pytest.approx(flagged)


def test_tier_limits_move_the_tiers(spark, raw):
    strict = P.Policy(tiers=((30.0, "Critical"), (20.0, "High"), (10.0, "Medium")))
    got = by_name(Warehouse(spark, raw, policy=strict).scores, "customer_id")
    for row in got.values():
        score = row.governance_priority_score
        want = "Critical" if score >= 30 else "High" if score >= 20 else "Medium" if score >= 10 else "Low"
        assert row.risk_tier == want


def test_json_round_trip():
    assert P.Policy.from_json(P.POLICY.to_json()) == P.POLICY
    assert P.Policy.from_json("{}") == P.POLICY
    text = json.dumps({"high_discount": 0.3, "watch": {"high_risk_count": {"warn": 1, "critical": 2}}})
    found = P.Policy.from_json(text)
    assert found.high_discount == 0.3 and found.watch["high_risk_count"] == P.Watch(1, 2)


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ('{"high_discount": 1.5}', "high_discount"),
        ('{"discounted": 0.4}', "discounted"),
        ('{"sensitivity": []}', "sensitivity"),
        ('{"limit": 3}', "unknown field"),
        ('{"priority_weights": {"pricing_risk_score": 1.0}}', "components"),
        ('{"tiers": [[10, "Critical"], [20, "High"], [5, "Medium"]]}', "tiers"),
        ('{"min_reliable_orders": 0}', "min_reliable_orders"),
        ('{"mixed": {"discount_max": 0.01, "high_share_max": 0.3, "margin_min": 0.4}}', "mixed"),
        ('{"healthy": {"discount": 0.01}}', "unexpected"),
        ('{"breaches": {"depth": {"threshold": 0.1, "span": 0.1}}}', "breaches"),
        ('{"watch": {"margin_risk_share": {"warn": 0.5, "critical": 0.1}}}', "watch"),
    ],
)
def test_wrong_policies_are_refused(text, problem):
    with pytest.raises(ValueError, match=problem):
        P.Policy.from_json(text)
