from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pricelens.operators import joins
from pricelens.plans import fact, quality
from pricelens.sources import area as area_module
from pricelens.sources import files, tpch
from pricelens.sources.staging import staged_table, staged_tables
from pricelens.sources import contract as C
from tests.conftest import by_name


def test_line_metrics(four_lines):
    rows = by_name(four_lines, "order_item_id")
    second = rows["L2"]
    assert second.discount_bucket == "10-20%"
    assert (second.high_discount_flag, second.discounted_flag) == (1, 1)
    assert (second.line_revenue, second.line_cost, second.gross_margin_value) == (80, 56, 24)
    assert second.margin_proxy_pct == pytest.approx(0.3)
    assert rows["L1"].price_realization_residual_pct == pytest.approx(10 / 90)
    free = rows["L4"]
    assert free.discount_bucket == "30%+" and free.margin_proxy_pct is None
    assert free.price_realization_residual_pct == 0.0


def test_zero_list_price_has_no_realization(spark):
    from tests.conftest import enriched_rows

    table = enriched_rows(
        spark,
        [("a", "o", "2024-01-01", "c", "s", "p", "k", "ch", 1, 0.0, 0.0, 0.0, 1.0)],
    )
    row = fact.pricing_metrics(table).first()
    assert row.line_price_realization is None and row.price_realization_residual_pct == 0.0


def test_staging_drops_rows_without_key_and_casts(spark):
    raw = spark.createDataFrame(
        [("P1", "A", "K", "10.5", "4"), (None, "B", "K", "1", "1"), ("P2", "C", "K", "x", "1")],
        "product_id string, product_name string, category string, list_price string,"
        " unit_cost string",
    )
    got = {r.product_id: r.list_price for r in staged_table(raw, C.PRODUCTS).collect()}
    assert got == {"P1": 10.5, "P2": None}


def test_staging_renames_the_rep_region(raw_tables):
    assert staged_tables(raw_tables)["sales_reps"].columns == ["sales_rep_id", "team", "rep_region"]


def test_missing_tables_and_columns_are_named(raw_tables):
    with pytest.raises(KeyError, match="orders, products"):
        staged_tables({k: v for k, v in raw_tables.items() if k not in ("orders", "products")})
    broken = {**raw_tables, "orders": raw_tables["orders"].drop("order_date", "sales_rep_id")}
    with pytest.raises(KeyError, match="orders lacks order_date, sales_rep_id"):
        staged_tables(broken)


def test_star_join(raw_tables):
    staged = staged_tables(raw_tables)
    fact.check_links(staged)
    row = fact.enriched(staged).first()
    assert row.days_since_signup == 369
    assert (row.segment, row.rep_region, row.product_name) == ("S1", "North", "Product 1")


def test_star_join_keeps_lines_without_rep(raw_tables):
    staged = staged_tables(raw_tables)
    staged["sales_reps"] = staged["sales_reps"].where("false")
    row = fact.enriched(staged).first()
    assert row.team is None and row.order_item_id == "OI1"


def test_duplicate_dimension_key_fails(raw_tables):
    staged = staged_tables(raw_tables)
    staged["products"] = staged["products"].unionAll(staged["products"])
    with pytest.raises(ValueError, match="products: 1 values of product_id are not unique"):
        fact.check_links(staged)


def test_missing_dimension_row_fails_with_examples(raw_tables):
    staged = staged_tables(raw_tables)
    staged["orders"] = staged["orders"].withColumn("customer_id", F.lit("C9"))
    with pytest.raises(ValueError, match="customers: 1 rows have no match on customer_id.*C9"):
        fact.check_links(staged)


def test_violations_show_the_first_five_keys(spark):
    left = spark.createDataFrame([(f"k{i}",) for i in range(8)] + [(None,)], "k string")
    right = spark.createDataFrame([("k0",), ("k0",), ("k1",)], "k string")
    row = joins.link_violations(left, right, "k", "dim").first()
    assert (row.duplicate_keys, row.unmatched_rows) == (1, 7)
    assert row.examples == "k2, k3, k4, k5, k6"


def test_duplicate_count_takes_null_keys_as_equal(spark):
    table = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,), ("b",)], "k string")
    assert joins.duplicate_count(table, ["k"]).first().duplicates == 3


def test_csv_round_trip(spark, tmp_path):
    raw = tpch.raw_tables(spark, "/root/testdata/sf0.001")
    files.write_bundle(raw, str(tmp_path))
    back = files.read_csv_bundle(spark, str(tmp_path))
    for name, table in raw.items():
        assert back[name].dtypes == [(n, t) for n, t in table.dtypes]
        assert back[name].exceptAll(table).count() == 0
        assert back[name].count() == table.count()


def test_missing_csv_files_are_listed_together(spark, tmp_path, raw_tables):
    files.write_bundle({"orders": raw_tables["orders"]}, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="customers.csv, products.csv"):
        files.read_csv_bundle(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="products.csv"):
        files.read_csv(spark, str(tmp_path), "products")


class FakeSession:
    """A session with one master and at most the folder setting."""

    def __init__(self, master, folder=None):
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")
        self.conf = SimpleNamespace(get=lambda key, default=None: folder or default)


def test_shared_folder_comes_from_the_setting():
    assert area_module.shared_folder(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        area_module.shared_folder(FakeSession("yarn"))


def test_local_session_keeps_one_private_folder():
    session = FakeSession("local[2]")
    assert area_module.shared_folder(session) == area_module.shared_folder(session)


def test_staged_tables_survive_the_source(spark, area, tmp_path):
    source = spark.range(100).withColumn("g", F.col("id") % 3)
    staged = area.put("kept", source, "g")
    assert staged.count() == 100 and staged.dtypes == source.dtypes


def test_orders_before_signup_are_flagged(raw_tables):
    early = raw_tables["orders"].withColumn("order_date", F.lit("2020-01-01"))
    row = quality.order_dates({**raw_tables, "orders": early}).first()
    assert row.before_signup is True


def test_closing_an_area_removes_its_tables(spark, tmp_path):
    from pricelens.sources.area import StagingArea

    with StagingArea(spark, str(tmp_path)) as area:
        area.put("numbers", spark.range(5))
        assert list(tmp_path.rglob("*.parquet"))
    assert not list(tmp_path.rglob("*.parquet"))
