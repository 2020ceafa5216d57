"""The five input tables: schemas, keys, links and required columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableContract:
    """Shape of one table as later stages rely on it."""

    name: str
    grain: str
    key: tuple[str, ...]
    links: Mapping[str, str] = field(default_factory=dict)
    columns: Mapping[str, T.DataType] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, kind) for name, kind in self.columns.items()])

    @property
    def measured(self) -> dict[str, T.DataType]:
        """Dates and numbers, which staging casts; ids and labels keep the type they come in."""
        return {
            name: kind
            for name, kind in self.columns.items()
            if not name.endswith("_id") and kind != T.StringType()
        }


_STRING, _LONG, _DOUBLE, _DATE = T.StringType(), T.LongType(), T.DoubleType(), T.DateType()

CUSTOMERS = TableContract(
    "customers",
    "1 row per customer account",
    ("customer_id",),
    columns={
        "customer_id": _LONG,
        "signup_date": _DATE,
        "segment": _STRING,
        "region": _STRING,
        "company_size": _STRING,
    },
)
PRODUCTS = TableContract(
    "products",
    "1 row per product",
    ("product_id",),
    columns={
        "product_id": _STRING,
        "product_name": _STRING,
        "category": _STRING,
        "list_price": _DOUBLE,
        "unit_cost": _DOUBLE,
    },
)
SALES_REPS = TableContract(
    "sales_reps",
    "1 row per sales rep",
    ("sales_rep_id",),
    columns={"sales_rep_id": _LONG, "team": _STRING, "region": _STRING},
)
ORDERS = TableContract(
    "orders",
    "1 row per order header",
    ("order_id",),
    {"customer_id": "customers.customer_id", "sales_rep_id": "sales_reps.sales_rep_id"},
    {
        "order_id": _LONG,
        "customer_id": _LONG,
        "order_date": _DATE,
        "sales_channel": _STRING,
        "sales_rep_id": _LONG,
    },
)
ORDER_ITEMS = TableContract(
    "order_items",
    "1 row per order line item",
    ("order_item_id",),
    {"order_id": "orders.order_id", "product_id": "products.product_id"},
    {
        "order_item_id": _STRING,
        "order_id": _LONG,
        "product_id": _STRING,
        "quantity": _LONG,
        "list_price_at_sale": _DOUBLE,
        "realized_unit_price": _DOUBLE,
        "discount_pct": _DOUBLE,
    },
)
_LINE_LINKS = {
    "order_id": "orders.order_id",
    "customer_id": "customers.customer_id",
    "product_id": "products.product_id",
    "sales_rep_id": "sales_reps.sales_rep_id",
}

RAW = {t.name: t for t in (CUSTOMERS, PRODUCTS, SALES_REPS, ORDERS, ORDER_ITEMS)}
DERIVED = {
    t.name: t
    for t in (
        TableContract(
            "order_item_enriched",
            "1 row per order line item with all dimensions attached",
            ("order_item_id",),
            _LINE_LINKS,
        ),
        TableContract(
            "order_item_pricing_metrics",
            "1 row per order line item with pricing metrics",
            ("order_item_id",),
            _LINE_LINKS,
        ),
        TableContract(
            "customer_pricing_profile",
            "1 row per customer pricing behavior profile",
            ("customer_id",),
            {"customer_id": "customers.customer_id"},
        ),
        TableContract("segment_pricing_summary", "1 row per customer segment", ("segment",)),
        TableContract(
            "segment_channel_diagnostics",
            "1 row per segment x sales_channel",
            ("segment", "sales_channel"),
        ),
        TableContract(
            "customer_risk_scores",
            "1 row per customer scored for pricing governance risk",
            ("customer_id",),
            {"customer_id": "customer_pricing_profile.customer_id"},
        ),
        TableContract(
            "risk_tier_summary",
            "1 row per risk_tier x recommended_action",
            ("risk_tier", "recommended_action"),
        ),
        TableContract("main_driver_summary", "1 row per main risk driver", ("main_risk_driver",)),
    )
}
ALL_TABLES = {**RAW, **DERIVED}


def missing_columns(table: DataFrame, contract: TableContract) -> list[str]:
    return [name for name in contract.columns if name not in table.columns]


def require_raw_tables(tables: Mapping[str, DataFrame]) -> None:
    """Raise one error that names every absent table or column."""
    absent = sorted(set(RAW) - set(tables))
    if absent:
        raise KeyError(f"input tables not given: {', '.join(absent)}")
    gaps = {name: missing_columns(tables[name], spec) for name, spec in RAW.items()}
    gaps = {name: columns for name, columns in gaps.items() if columns}
    if gaps:
        text = "; ".join(f"{name} lacks {', '.join(columns)}" for name, columns in gaps.items())
        raise KeyError(f"input columns not given: {text}")
