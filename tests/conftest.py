from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pricelens.plans import fact  # noqa: E402
from pricelens.sources.area import StagingArea  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def area(spark) -> StagingArea:
    return StagingArea(spark)


ENRICHED = (
    "order_item_id string, order_id string, order_date date, customer_id string, segment string,"
    " region string, company_size string, product_id string, product_name string,"
    " category string, sales_channel string, sales_rep_id string, team string,"
    " rep_region string, quantity bigint, list_price_at_sale double, realized_unit_price double,"
    " discount_pct double, list_price double, unit_cost double, signup_date date,"
    " days_since_signup int"
)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small frame held as a local relation, which needs no Python worker to read."""
    schema = StructType.fromDDL(ddl)
    names = schema.fieldNames()
    table = pa.Table.from_pylist(
        [dict(zip(names, row, strict=True)) for row in rows], to_arrow_schema(schema)
    )
    return spark.createDataFrame(table, schema)


def enriched_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (item, order, date, customer, segment, product, category, channel, quantity,
    list price, realized price, discount, cost) as an enriched table."""
    full = [
        (
            item, order, day(date), customer, segment, "North", "Large", product,
            f"{product} name", category, channel, "R1", "Field", "North", quantity, listed,
            realized, discount, listed, cost, day("2020-01-01"), 100,
        )
        for (
            item, order, date, customer, segment, product, category, channel, quantity, listed,
            realized, discount, cost,
        ) in rows
    ]
    return local_frame(spark, full, ENRICHED)


FOUR_LINES = [
    ("L1", "A1", "2023-03-05", "C1", "S1", "P1", "K1", "Online", 4, 50.0, 50.0, 0.0, 30.0),
    ("L2", "A2", "2023-03-17", "C1", "S1", "P1", "K1", "Online", 2, 50.0, 40.0, 0.2, 28.0),
    ("L3", "A3", "2023-04-02", "C1", "S1", "P2", "K1", "Field", 3, 120.0, 90.0, 0.25, 70.0),
    ("L4", "A4", "2023-03-09", "C2", "S2", "P3", "K2", "Online", 1, 75.0, 0.0, 1.0, 12.0),
]


@pytest.fixture(scope="session")
def four_lines(spark) -> DataFrame:
    return fact.pricing_metrics(enriched_rows(spark, FOUR_LINES)).cache()


@pytest.fixture
def raw_tables(spark) -> dict[str, DataFrame]:
    """One valid row per input table, with text ids and text dates."""
    return {
        "customers": local_frame(
            spark,
            [("C1", "2023-01-01", "S1", "North", "Large")],
            "customer_id string, signup_date string, segment string, region string,"
            " company_size string",
        ),
        "products": local_frame(
            spark,
            [("P1", "Product 1", "K1", 100.0, 40.0)],
            "product_id string, product_name string, category string, list_price double,"
            " unit_cost double",
        ),
        "sales_reps": local_frame(
            spark,
            [("R1", "Field", "North")], "sales_rep_id string, team string, region string"
        ),
        "orders": local_frame(
            spark,
            [("O1", "C1", "2024-01-05", "Online", "R1")],
            "order_id string, customer_id string, order_date string, sales_channel string,"
            " sales_rep_id string",
        ),
        "order_items": local_frame(
            spark,
            [("OI1", "O1", "P1", 2, 100.0, 90.0, 0.1)],
            "order_item_id string, order_id string, product_id string, quantity bigint,"
            " list_price_at_sale double, realized_unit_price double, discount_pct double",
        ),
    }


def by_name(report: DataFrame, key: str = "check_name") -> dict:
    return {row[key]: row for row in report.collect()}
