"""Maps the supplied order tables onto the five-table contract.

Money is scaled to whole cents before it is averaged or multiplied by a ratio, so that
half-cent ties round the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.numeric import half_even

# Unit cost as a percentage of list price, by product category.
COST_PERCENT = {"ECONOMY": 45, "STANDARD": 50, "SMALL": 50, "MEDIUM": 55, "LARGE": 60}
OTHER_COST_PERCENT = 65

# Account balance below which a customer falls into the size class.
SIZE_BELOW = ((1000, "Small"), (4000, "Medium"), (7500, "Large"))
LARGEST_SIZE = "Enterprise"

# Team by rep number modulo 3, and the signup date of customers without orders.
TEAMS = ("New Business", "Expansion", "Channel")
NO_ORDER_ANCHOR = "1995-01-01"
SIGNUP_SPREAD_DAYS = 1461
DISCOUNT_FACTOR = 4

col = F.col


def _product_id() -> Column:
    return F.concat_ws("/", "p_brand", "p_type")


def _cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Whole-number quotient, halves up."""
    return F.floor((numerator * 2 + denominator) / (denominator * 2)).cast("long")


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The contract tables as lazy views over the Parquet files in ``folder``."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders, part, supplier = read("orders"), read("part"), read("supplier")
    region_of_nation = (
        read("nation")
        .join(read("region"), col("n_regionkey") == col("r_regionkey"))
        .select("n_nationkey", col("r_name").alias("region"))
    )
    return {
        "customers": _customers(read("customer"), orders, region_of_nation),
        "products": _products(part),
        "sales_reps": _sales_reps(supplier, region_of_nation),
        "orders": _orders(orders, supplier),
        "order_items": _order_items(read("lineitem"), part),
    }


def _customers(customer: DataFrame, orders: DataFrame, regions: DataFrame) -> DataFrame:
    first_order = orders.groupBy(col("o_custkey").alias("c_custkey")).agg(
        F.min(col("o_orderdate").cast("date")).alias("first_order")
    )
    size = F.when(col("c_acctbal") < SIZE_BELOW[0][0], SIZE_BELOW[0][1])
    for bound, name in SIZE_BELOW[1:]:
        size = size.when(col("c_acctbal") < bound, name)
    anchor = F.coalesce("first_order", F.lit(NO_ORDER_ANCHOR).cast("date"))
    lead = (col("c_custkey") % SIGNUP_SPREAD_DAYS).cast("int")
    return (
        customer.join(first_order, "c_custkey", "left")
        .join(regions, col("c_nationkey") == col("n_nationkey"))
        .select(
            col("c_custkey").alias("customer_id"),
            F.date_sub(anchor, lead).alias("signup_date"),
            col("c_mktsegment").alias("segment"),
            "region",
            size.otherwise(LARGEST_SIZE).alias("company_size"),
        )
    )


def _products(part: DataFrame) -> DataFrame:
    percent = F.lit(OTHER_COST_PERCENT)
    for category, value in COST_PERCENT.items():
        percent = F.when(col("p_type") == category, value).otherwise(percent)
    return (
        part.groupBy("p_brand", "p_type")
        .agg(
            _half_up(F.sum(_cents(col("p_retailprice"))), F.count(F.lit(1))).alias("list_cents")
        )
        .select(
            _product_id().alias("product_id"),
            F.concat_ws(" ", "p_brand", "p_type").alias("product_name"),
            col("p_type").alias("category"),
            (col("list_cents") / 100.0).alias("list_price"),
            (_half_up(col("list_cents") * percent, F.lit(100)) / 100.0).alias("unit_cost"),
        )
    )


def _sales_reps(supplier: DataFrame, regions: DataFrame) -> DataFrame:
    team = F.element_at(
        F.array(*[F.lit(name) for name in TEAMS]), (col("s_suppkey") % len(TEAMS) + 1).cast("int")
    )
    return supplier.join(regions, col("s_nationkey") == col("n_nationkey")).select(
        col("s_suppkey").alias("sales_rep_id"), team.alias("team"), "region"
    )


def _orders(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    reps = supplier.agg(F.count(F.lit(1))).scalar()
    return orders.select(
        col("o_orderkey").alias("order_id"),
        col("o_custkey").alias("customer_id"),
        col("o_orderdate").cast("date").alias("order_date"),
        col("o_orderpriority").alias("sales_channel"),
        (col("o_orderkey") % reps).alias("sales_rep_id"),
    )


def _order_items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    discount = half_even(col("l_discount") * DISCOUNT_FACTOR, 4)
    return lineitem.join(part, col("l_partkey") == col("p_partkey")).select(
        F.concat_ws(
            "-",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            col("l_quantity").cast("long"),
            _cents(col("l_extendedprice")),
        ).alias("order_item_id"),
        col("l_orderkey").alias("order_id"),
        _product_id().alias("product_id"),
        col("l_quantity").cast("long").alias("quantity"),
        col("p_retailprice").alias("list_price_at_sale"),
        (col("p_retailprice") * (F.lit(1.0) - discount)).alias("realized_unit_price"),
        discount.alias("discount_pct"),
    )
