"""Plan shape and completeness: what a small result alone would not show."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricelens.functions.numeric import weighted_mean
from pricelens.operators import ordered
from pricelens.plans import customers, dashboard, fact, quality, sql_models
from pricelens.plans import warehouse as warehouses
from pricelens.plans.dashboard import Scope
from pricelens.plans.warehouse import Warehouse
from pricelens.registry import queries
from tests.conftest import by_name, local_frame

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def warehouse(spark):
    with Warehouse.from_folder(spark, FOLDER) as found:
        yield found


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def sort_merge_keys(frame) -> list[str]:
    return re.findall(r"SortMergeJoin \[(.*?)\]", plan(frame))


@pytest.mark.parametrize(
    "name", ["e1_peer_residual", "d9_customer_profile", "d16_product_channel_variance"]
)
def test_lines_are_not_shuffled_to_meet_the_baseline(warehouse, small_broadcasts, name):
    frame = queries.run(name, warehouse)
    assert not [k for k in sort_merge_keys(frame) if "product_id" in k]
    if name == "e1_peer_residual":
        assert "BroadcastHashJoin [product_id" in plan(frame)


def test_products_are_broadcast_to_the_lines(warehouse, small_broadcasts):
    frame = fact.enriched(warehouse.staged)
    assert not [k for k in sort_merge_keys(frame) if "product_id" in k]


def test_reps_are_broadcast_to_the_orders(warehouse, small_broadcasts):
    frame = fact.enriched(warehouse.staged)
    assert not [k for k in sort_merge_keys(frame) if "sales_rep_id" in k]


def test_customer_sums_by_sql_move_stored_lines_and_no_buffers(spark, monkeypatch):
    monkeypatch.setattr(warehouses, "LINES_A_TASK", 1000)
    with Warehouse.from_folder(spark, "/root/testdata/sf0.001") as w:
        shuffles = re.findall(r"hashpartitioning\((.*)\), (\w+)", plan(queries.run("c11_path_parity", w)))
        tasks = w.lines.count() // 1000 + 1
    assert not [keys for keys, _ in shuffles if "customer_id" in keys and "product_id" in keys]
    moved = [keys for keys, kind in shuffles if kind == "REPARTITION_BY_NUM"]
    assert tasks > 1 and [re.sub(r"#\d+L?", "", keys) for keys in moved] == [f"customer_id, {tasks}"]


def test_lines_by_customer_give_the_sums_of_all_lines(spark, raw_tables, monkeypatch):
    monkeypatch.setattr(warehouses, "LINES_A_TASK", 10)
    orders = [(f"O{i}", "C1" if i % 4 else f"C{i}", "2024-01-05", "Online", "R1") for i in range(16)]
    items = [
        (f"I{i}", f"O{i % 16}", f"P{i % 3}", i % 7, 100.0, 100.0 - i % 9, i % 9 / 100 if i % 11 else None)
        for i in range(64)
    ]
    raw = raw_tables | {
        "customers": local_frame(
            spark,
            [(f"C{i}", "2023-01-01", "S1", "North", "Large") for i in range(16)],
            "customer_id string, signup_date string, segment string, region string,"
            " company_size string",
        ),
        "products": local_frame(
            spark,
            [(f"P{i}", f"Product {i}", "K1", 100.0, 40.0) for i in range(3)],
            "product_id string, product_name string, category string, list_price double,"
            " unit_cost double",
        ),
        "orders": local_frame(
            spark,
            orders,
            "order_id string, customer_id string, order_date string, sales_channel string,"
            " sales_rep_id string",
        ),
        "order_items": local_frame(
            spark,
            items,
            "order_item_id string, order_id string, product_id string, quantity bigint,"
            " list_price_at_sale double, realized_unit_price double, discount_pct double",
        ),
    }
    with Warehouse(spark, raw) as w:
        assert w.lines_by_customer.rdd.getNumPartitions() == 7
        got, want = (
            by_name(sql_models.customers(lines, w.ledger), "customer_id")
            for lines in (w.lines_by_customer, w.lines)
        )
        assert got.keys() == want.keys() == {"C0", "C1", "C4", "C8", "C12"}
        assert got["C1"].total_order_items == 48 and got["C1"].product_diversity == 3
        for key, row in want.items():
            assert got[key].asDict() == pytest.approx(row.asDict())
        assert queries.run("c11_path_parity", w).agg(F.sum("differing_rows")).first()[0] == 0


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_no_join_on_a_group_alone(spark, warehouse, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    counts = ordered.value_counts(warehouse.lines, ["segment"], "discount_depth")
    placed = ordered.value_positions(warehouse.area, counts, ["segment"], "discount_depth")
    joins = re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[(.*?)\]", plan(placed))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins and all("chunk" in keys for keys in joins)


def test_totals_of_a_group_that_holds_nearly_all_rows(spark, area):
    rows = [("hot", float(i % 700)) for i in range(5000)] + [("cold", 1.0), ("cold", 3.0)]
    table = local_frame(spark, rows, "g string, v double")
    points = {"low": 0.0, "mid": 0.5, "top": 1.0}
    got = by_name(ordered.exact_quantiles(area, table, ["g"], "v", points, chunks=7), "g")
    hot = sorted(v for g, v in rows if g == "hot")
    assert got["hot"].mid == (hot[2499] + hot[2500]) / 2
    assert (got["hot"].low, got["hot"].top, got["cold"].mid) == (0.0, 699.0, 2.0)


def test_scoped_accounts_are_not_cut(spark):
    tiers = [("High", "act")] * 200 + [("Medium", "watch")] * 3
    rows = [(i, "S", "R", tier, "driver", action, 50.0) for i, (tier, action) in enumerate(tiers)]
    scores = local_frame(
        spark,
        rows,
        "customer_id long, segment string, region string, risk_tier string,"
        " main_risk_driver string, recommended_action string, governance_priority_score double",
    )
    scores = scores.withColumns(
        {c: F.lit(0.0) for c in dashboard.RISK_COLUMNS if c not in scores.columns}
    )
    facts = scores.select(
        "customer_id", "segment", "region", F.lit("K").alias("category"),
        F.lit("Ch").alias("sales_channel"), F.lit("2024-01").alias("order_month"),
        F.lit(10.0).alias("filtered_revenue"), F.lit(12.0).alias("filtered_list_revenue"),
        F.lit(2.0).alias("filtered_discount_num"),
    )
    accounts = dashboard.scoped_accounts(scores, facts, Scope())
    got = by_name(dashboard.revenue_by(accounts, "recommended_action"), "recommended_action")
    assert (got["act"].filtered_revenue, got["watch"].filtered_revenue) == (2000.0, 30.0)


def test_every_customer_is_in_the_action_revenue(warehouse):
    frame = queries.QUERIES["n9_action_revenue"](warehouse)
    by_action = frame.agg(F.sum("filtered_revenue")).first()[0]
    assert by_action == pytest.approx(warehouse.lines.agg(F.sum("line_revenue")).first()[0])


def test_weighted_mean_with_an_unknown_value(spark):
    rows = [("a", 0.5, 1.0), ("a", None, 1.0), ("b", 0.5, 1.0), ("b", 0.1, 3.0), ("c", 0.5, 0.0)]
    table = local_frame(spark, rows, "g string, v double, w double")
    got = by_name(table.groupBy("g").agg(weighted_mean(F.col("v"), F.col("w")).alias("m")), "g")
    assert got["a"].m is None and got["c"].m is None
    assert got["b"].m == pytest.approx(0.2)


def test_margin_check_needs_both_tables(spark, area, four_lines):
    name = "customer_pricing_profile_weighted_margin_reconciliation"
    paid = four_lines.where("line_revenue > 0")
    ledger = area.put_in_order("m", customers.order_level(paid), *customers.LEDGER_ORDER)
    profile = customers.profile(paid, ledger)
    for p, lines, want in ((profile, paid, "PASS"), (profile.limit(0), paid, None), (profile, paid.limit(0), None)):
        report = by_name(quality._margin_check(p, lines))
        assert (report[name].status if name in report else None) == want


def test_lines_move_once_before_products_widen_them(spark, monkeypatch):
    w = Warehouse.from_folder(spark, "/root/testdata/sf0.001")
    near, put = {}, w.area.put

    def noted(name, table, by=None):
        near[name] = by
        return put(name, table, by)

    monkeypatch.setattr(w.area, "put", noted)
    assert w.enriched.count() > 0 and near["order_item_enriched"] is None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = sort_merge_keys(fact.enriched(w.staged))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "product_id" in joins[0] and "order_id" in joins[1]


def test_a_csv_query_writes_its_own_table_compressed(spark):
    with Warehouse.from_folder(spark, "/root/testdata/sf0.001") as w:
        found = queries.run("a1_csv_products", w).count()
        folder = Path(queries.csv_folder(w))
        assert [f.name for f in folder.iterdir()] == ["products.csv"]
        assert {f.suffix for f in (folder / "products.csv").glob("part-*")} == {".gz"}
        assert found == w.raw["products"].count()
        assert queries.run("a2_typed_csv_products", w).count() == found
        assert len([*folder.iterdir()]) == 5


def test_a_repeated_key_is_checked_once(spark, area, monkeypatch):
    from pricelens.plans import profiling

    lines = local_frame(spark, [("a", 1.0), ("a", 2.0), ("b", 3.0)], "order_item_id string, list_price double")
    tables = {"order_item_enriched": lines, "order_item_pricing_metrics": lines}
    asked, facts = [], profiling.link_facts
    monkeypatch.setattr(
        profiling, "link_facts", lambda t, links: asked.append([x.parent for x in links]) or facts(t, links)
    )
    found = profiling.TableProfiler(
        area, tables, {"order_item_enriched": "order_item_pricing_metrics"}
    ).table_summary()
    assert asked == [["order_item_pricing_metrics"]]
    assert {r.table_name: r.duplicate_rows_on_primary_key for r in found.collect()} == {
        "order_item_enriched": 1, "order_item_pricing_metrics": 1,
    }
