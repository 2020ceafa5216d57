from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.plans import profiling
from pricelens.plans.warehouse import Warehouse
from pricelens.registry import queries
from pricelens.sources import contract as C
from pricelens.sources.area import StagingArea
from tests.conftest import local_frame


@pytest.fixture(scope="module")
def messy(spark, area):
    """Order items with a repeated key, text dates, impossible prices and mixed codes."""
    rows = [
        ("OI1", "2024-01-01", 100.0, 120.0, -5.0, "100", None),
        ("OI1", "not a date", 100.0, 90.0, 10.0, "ABC", None),
        ("OI2", "2024-03-01", 100.0, 80.0, 10.0, "ABC", "x"),
    ]
    table = spark.createDataFrame(
        rows,
        "order_item_id string, order_date string, list_price_at_sale double,"
        " realized_unit_price double, net_revenue double, code string, note string",
    )
    return profiling.TableProfiler(area, {"order_items": table})


def test_issues_of_a_messy_table(messy):
    found = {(r.column_name, r.issue_type) for r in messy.issues().collect()}
    assert {
        ("realized_unit_price", "impossible_pricing"),
        ("net_revenue", "impossible_negative_value"),
        ("code", "mixed_format"),
        ("note", "high_null_rate"),
        ("order_item_id", "duplicate_risk_identifier"),
    } <= found


def test_summary_of_a_messy_table(messy):
    row = messy.table_summary().first()
    assert (row.row_count, row.column_count, row.duplicate_rows_on_primary_key) == (3, 7, 1)
    assert (row.date_coverage_start, row.date_coverage_end) == ("2024-01-01", "2024-03-01")


def test_column_profile_of_a_messy_table(messy):
    rows = {r.column_name: r for r in messy.column_profile().collect()}
    assert rows["note"].null_rate == pytest.approx(2 / 3)
    assert rows["note"].distinct_count == 1
    assert rows["code"].cardinality_ratio == pytest.approx(2 / 3)
    assert rows["order_date"].column_type == "temporal"


def test_top_values_show_nulls(messy):
    rows = {(r.column_name, r.value): r for r in messy.top_values().collect()}
    assert rows["note", "<NULL>"]["count"] == 2
    assert rows["code", "ABC"].share == pytest.approx(2 / 3)


def test_numeric_summary(messy):
    rows = {r.column_name: r for r in messy.numeric_summary().collect()}
    row = rows["net_revenue"]
    assert row["count"] == 3 and row["mean"] == 5.0 and row["median"] == 10.0
    assert row["p05"] == pytest.approx(-3.5)
    assert row["negative_share"] == pytest.approx(1 / 3)


def test_type_rules():
    spec = C.ORDERS
    cases = [
        ("order_id", T.StringType(), "identifier"),
        ("customer_id", T.LongType(), "identifier"),
        ("any_id", T.LongType(), "identifier"),
        ("order_month", T.DateType(), "structural"),
        ("size_bucket", T.StringType(), "structural"),
        ("ship_date", T.StringType(), "temporal"),
        ("fiscal_year", T.IntegerType(), "temporal"),
        ("is_open", T.StringType(), "boolean"),
        ("paid_flag", T.IntegerType(), "boolean"),
        ("ready", T.BooleanType(), "boolean"),
        ("amount", T.DoubleType(), "metric"),
        ("label", T.StringType(), None),
    ]
    for name, kind, want in cases:
        assert profiling.named_type(name, kind, spec) == want


def test_long_varied_text_is_text(spark, area):
    rows = [(i, f"{i} " + "long remark " * 8, "short") for i in range(10)]
    table = spark.createDataFrame(rows, "k int, remark string, label string")
    types = {
        r.column_name: r.column_type
        for r in profiling.TableProfiler(area, {"notes": table}).column_types().collect()
    }
    assert types == {"k": "metric", "remark": "text", "label": "dimension"}


def test_signed_names_may_be_negative():
    assert profiling.never_negative("line_revenue")
    assert not profiling.never_negative("price_realization_residual_pct")
    assert not profiling.never_negative("revenue_growth")
    assert not profiling.never_negative("tenure_days")


def test_few_values_and_many_values(spark, area):
    rows = [(f"P{i}", f"name {i}", 1.0 * (i % 3)) for i in range(200)]
    table = spark.createDataFrame(rows, "product_id string, product_name string, score double")
    found = {
        (r.column_name, r.issue_type)
        for r in profiling.TableProfiler(area, {"products": table}).column_issues().collect()
    }
    assert found == {
        ("product_name", "high_cardinality_surprise"),
        ("score", "low_cardinality_surprise"),
    }


def test_negative_zero_is_no_new_value(spark, area):
    table = spark.createDataFrame([(0.0,), (-0.0,), (-1e-14,)], "delta double")
    row = profiling.TableProfiler(area, {"t": table}).column_profile().first()
    assert row.distinct_count == 2  # values are counted as they are, however small


def test_values_are_not_stored_where_nobody_reads_them(spark, area):
    rows = [(i, f"n{i % 3}", i / 7, "x" * 60 + str(i)) for i in range(200)]
    table = spark.createDataFrame(rows, "row_id int, kind string, amount double, note string")
    found = profiling.TableProfiler(area, {"t": table})
    counts = {r.column_name: r.distinct_count for r in found.column_profile().collect()}
    assert counts == {"row_id": 200, "kind": 3, "amount": 200, "note": 200}
    assert {r.column_name for r in found.frequencies.collect()} == {"kind"}


def test_long_text_with_few_values_is_counted(spark, area):
    long = "a product name that is much longer than forty-five characters "
    rows = [(long + str(i % 4), long + str(i % 2), long + str(i), long + str(i)) for i in range(40)]
    table = spark.createDataFrame(rows, "label string, kind_bucket string, all_bucket string, note string")
    found = profiling.TableProfiler(area, {"t": table})
    types = {r.column_name: r.column_type for r in found.column_types().collect()}
    assert types == {
        "label": "dimension", "kind_bucket": "structural", "all_bucket": "structural", "note": "text"
    }
    top = [(r.column_name, r["count"], r.share) for r in found.top_values().collect()]
    want = [("label", 10, 0.25)] * 4 + [("kind_bucket", 20, 0.5)] * 2 + [("all_bucket", 1, 1 / 40)] * 5
    assert sorted(top) == sorted(want)
    counts = {r.column_name: r.distinct_count for r in found.column_profile().collect()}
    assert counts == {"label": 4, "kind_bucket": 2, "all_bucket": 40, "note": 40}


def test_repeated_columns_are_profiled_once(spark, area):
    wide = spark.range(30).selectExpr("id AS a_id", "id % 3 AS n", "'t' AS label", "id / 2D AS extra")
    tables = {"narrow": wide.select("a_id", "n", "label"), "wide": wide}
    shared = profiling.TableProfiler(area, tables, {"narrow": "wide"})
    alone = profiling.TableProfiler(area, tables)
    for ask in ("column_profile", "numeric_summary", "top_values", "column_types"):
        got, want = (sorted(map(str, getattr(p, ask)().collect())) for p in (shared, alone))
        assert got == want


def test_coverage_and_join_issues(spark):
    day = dt.date(2024, 1, 1)
    tables = {
        "customers": spark.createDataFrame([("C1",), ("C2",), ("C3",)], "customer_id string"),
        "orders": spark.createDataFrame(
            [("O1", "C1", day), ("O2", "C9", day)], "order_id string, customer_id string, d date"
        ),
        "customer_pricing_profile": spark.createDataFrame([("C1",), ("C9",)], "customer_id string"),
        "customer_risk_scores": spark.createDataFrame([("C1",), ("C9",)], "customer_id string"),
    }
    row = profiling.population_coverage(tables).first()
    assert row.total_customers_raw == 3 and row.excluded_non_transacting_customers == 1
    assert row.profiled_not_scored_customers == 0
    found = {r.issue_type for r in profiling.join_issues(tables).collect()}
    assert found == {"possible_join_issue", "population_exclusion"}


def test_coverage_without_derived_tables(spark):
    only = {"customers": spark.createDataFrame([("C1",)], "customer_id string")}
    row = profiling.population_coverage(only).first()
    assert (row.total_customers_raw, row.scored_customers) == (1, 0)
    assert row.excluded_non_transacting_share == 1.0


def test_severity_order(spark):
    rows = [("a", "c", s, "t", "") for s in ("Low", "High", "Medium")]
    table = spark.createDataFrame(rows, list(profiling.ISSUE_COLUMNS))
    assert [r.severity for r in profiling.by_severity(table).collect()] == ["High", "Medium", "Low"]


def test_issues_count_only_what_they_depend_on(spark, monkeypatch):
    with StagingArea(spark) as area:
        rows = [(f"k{i // 2}", i / 7, float(i % 5), float(i % 6), None, float(i)) for i in range(200)]
        table = local_frame(
            spark, rows, "order_item_id string, many double, few double, six double, none double, unit_price double"
        )
        counted, count = [], profiling.distinct_counts
        monkeypatch.setattr(
            profiling, "distinct_counts", lambda t, names, dense: counted.extend(names) or count(t, names, dense)
        )
        repeats = {"order_item_enriched": "order_items"}
        tables = {"order_items": table, "order_item_enriched": table}
        profiler = profiling.TableProfiler(area, tables, repeats)
        found = {(r.table_name, r.column_name, r.issue_type, r.detail) for r in profiler.column_issues().collect()}
        assert "many" not in counted and "unit_price" not in counted
        assert counted.count("order_item_id") == 1
        low = {(t, "few", "low_cardinality_surprise", "5 distinct values") for t in tables}
        keys = {(t, "order_item_id", "duplicate_risk_identifier", "cardinality ratio 50.00%") for t in tables}
        nulls = {(t, "none", "high_null_rate", "null rate 100.00%") for t in tables}
        assert found == low | keys | nulls
        full = profiling.TableProfiler(area, tables, repeats)
        full.column_profile()
        assert {tuple(r) for r in full.column_issues().collect()} == {tuple(r) for r in profiler.column_issues().collect()}


def test_an_aggregate_of_facts_fits_generated_code(spark, area):
    names = [f"price_{i}" for i in range(40)]
    table = local_frame(spark, [(1.0,) * 40, (2.0,) * 40], ", ".join(f"{n} double" for n in names))
    profiler = profiling.TableProfiler(area, {"t": table})
    widths = []
    at = range(0, 40, profiling.FACTS_AT_ONCE)
    for begin in at:
        shapes = [profiler._shape(f, "metric") for f in table.schema.fields[begin : begin + profiling.FACTS_AT_ONCE]]
        plan = table.agg(F.count(F.lit(1)), *shapes)._jdf.queryExecution().executedPlan()
        leaf = plan.toString()
        widths.append(leaf.count("partial_"))
    assert max(widths) < 100
    assert profiler._facts.count() == 40 and {r.rows for r in profiler._facts.collect()} == {2}


def test_join_counts_build_no_other_table(spark):
    with Warehouse.from_folder(spark, "/root/testdata/sf0.001") as w:
        assert queries.run("k7_join_counts", w).count() == len(profiling.JOIN_RULES)
        assert queries.run("k8_population_coverage", w).count() == 1
        assert "segments" not in w.__dict__ and "median_discounts" not in w.__dict__


def test_a_profile_reads_written_tables(spark):
    with Warehouse.from_folder(spark, "/root/testdata/sf0.001") as w:
        tables = queries.profiler(w).tables
        for name in (*C.RAW, "segment_channel_diagnostics", "risk_tier_summary", "main_driver_summary"):
            plan = tables[name]._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan
