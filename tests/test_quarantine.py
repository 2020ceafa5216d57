"""Files with cells that do not fit their contract."""

from __future__ import annotations

import json

import pytest

from pricelens.plans import build, quality
from pricelens.sources import quarantine

FILES = {
    "customers": [
        "customer_id,signup_date,segment,region,company_size",
        "1,2020-01-01,S1,North,Large",
        "2,01.02.2020,S2,South,Small",
    ],
    "products": [
        "product_id,product_name,category,list_price,unit_cost",
        "P1,One,K1,100.0,60.0",
        "P2,Two,K1,NaN,30.0",
    ],
    "sales_reps": ["sales_rep_id,team,region", "7,Field,North"],
    "orders": [
        "order_id,customer_id,order_date,sales_channel,sales_rep_id",
        "10,1,2023-03-05,Online,7",
        "11,2,2023-02-30,Online,7",
    ],
    "order_items": [
        "order_item_id,order_id,product_id,quantity,list_price_at_sale,realized_unit_price,discount_pct",
        "L1,10,P1,4,100.0,90.0,0.1",
        "L2,10,P1,two,100.0,100.0,none",
        "L3,11,P1,1.5,100.0,100.0,0.0",
        "L4,11,P2,,50.0,50.0,0.0",
        "L5,11,P1, 3 ,100.0,100.0,0.0",
        "L6,11,P1,3,100.0",
        ",11,P1,x,100.0,100.0,0.0",
    ],
}


def written(folder, **changed):
    for name, lines in {**FILES, **changed}.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def bundle(spark, area, tmp_path_factory):
    folder = written(tmp_path_factory.mktemp("csv"))
    return quarantine.read_checked_bundle(spark, folder, area)


def test_each_fault_is_named_with_its_row(bundle):
    got = {tuple(r)[:5] for r in bundle.quarantine.collect()}
    assert got == {
        ("customers", "2", 1, "signup_date", "01.02.2020"),
        ("products", "P2", 1, "list_price", "NaN"),
        ("orders", "11", 1, "order_date", "2023-02-30"),
        ("order_items", "L2", 1, "quantity", "two"),
        ("order_items", "L2", 2, "discount_pct", "none"),
        ("order_items", "L3", 1, "quantity", "1.5"),
        ("order_items", "L6", 1, "(cells)", "L6,11,P1,3,100.0"),
        ("order_items", None, 1, "quantity", "x"),
    }
    record = bundle.quarantine.where("row_key = 'L2'").first().record
    assert json.loads(record)["quantity"] == "two" and json.loads(record)["order_id"] == "10"


def test_tables_keep_all_rows_and_clean_rows_have_no_fault(bundle):
    quantities = [r.quantity for r in bundle.tables["order_items"].orderBy("order_item_id").collect()]
    assert quantities == [None, 4, None, None, None, 3, 3]
    clean = [r.order_item_id for r in bundle.clean["order_items"].orderBy("order_item_id").collect()]
    assert clean == ["L1", "L4", "L5"]
    assert bundle.clean["customers"].count() == 1 and bundle.clean["sales_reps"].count() == 1


def test_report_fails_numbers_and_shows_the_row(bundle):
    rows = quality.raw_integrity(bundle.tables, bundle.quarantine).collect()
    got = {r.check_name: r for r in rows}
    quantity = got["order_items_quantity_numeric"]
    assert (quantity.status, quantity.failed_rows) == ("FAIL", 3)
    assert "first: x in" in quantity.detail and '"product_id":"P1"' in quantity.detail
    assert got["order_items_discount_pct_numeric"].failed_rows == 1
    assert got["products_list_price_numeric"].failed_rows == 1
    assert got["products_unit_cost_numeric"].status == "PASS"
    assert got["order_items_quarantine"].failed_rows == 4
    assert got["sales_reps_quarantine"].status == "PASS"
    # Empty are L4's quantity, two cells that L6 does not have and the key of the last line.
    assert got["order_items_nulls"].failed_rows == 4
    assert got["orders_nulls"].failed_rows == got["customers_nulls"].failed_rows == 0


def test_report_without_quarantine_has_the_checks_it_had(bundle):
    names = {r.check_name for r in quality.raw_integrity(bundle.tables).collect()}
    assert not any(n.endswith("_quarantine") for n in names) and "order_items_nulls" in names


def test_build_refuses_files_with_faults(spark, bundle, tmp_path):
    with pytest.raises(build.CheckFailed, match="numeric"):
        build.checked_build(
            spark, bundle.tables, str(tmp_path / "out"), quarantine=bundle.quarantine
        )
    assert not (tmp_path / "out").exists()


def test_header_alone_and_missing_files(spark, area, tmp_path):
    empty = {name: lines[:1] for name, lines in FILES.items()}
    got = quarantine.read_checked_bundle(spark, written(tmp_path, **empty), area)
    assert got.quarantine.count() == 0 and got.tables["orders"].count() == 0
    report = quality.raw_integrity(got.tables, got.quarantine)
    assert report.where("status = 'FAIL'").count() == 0
    with pytest.raises(FileNotFoundError, match="customers.csv"):
        quarantine.read_checked_bundle(spark, str(tmp_path / "none"), area)
