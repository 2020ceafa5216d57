"""Headline queries on one machine; prints one JSON line.

Building the staged tables is timed as its own entries (``build_*``), so a query's time is
the query alone, and the total counts both.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pricelens.plans.warehouse import Warehouse
from pricelens.registry.queries import run

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BUILDS = (
    "enriched", "peer_baseline", "ledger", "profile", "scores", "scope_facts", "segments",
    "account_facts",
)
HEADLINE = (
    "c1_star_join",
    "d1_overall",
    "d2_monthly",
    "d4_product",
    "d5_segment_population",
    "d9_customer_profile",
    "d16_product_channel_variance",
    "d19_kpi_cube",
    "d20_monthly_fact",
    "d25_discount_ladders",
    "e1_peer_residual",
    "e2_previous_order",
    "e6_revenue_concentration",
    "h4_discount_histogram40",
    "i9_risk_scores",
    "j2_threshold_sensitivity",
    "j3_action_queue",
    "j7_rep_inconsistency",
    "j8_product_patterns",
    "k2_column_profile",
    "k3_table_summary",
    "k5_numeric_summary",
    "k6_column_issues",
    "m2_raw_integrity",
    "m4_processed_checks",
    "m5_metric_contracts",
    "m6_warehouse_checks",
    "m7_analysis_checks",
    "m8_review_checks",
    "m10_readiness",
    "m12_release_gate",
    "n1_scoped_kpi",
    "n3_scoped_accounts",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("pricelens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    spark.range(1000).selectExpr("sum(id)").collect()
    warehouse = Warehouse.from_folder(spark, FOLDER)
    times: dict[str, float] = {}
    for name in BUILDS:
        start = time.perf_counter()
        getattr(warehouse, name)
        times[f"build_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        run(name, warehouse).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    sys.stdout.flush()
    warehouse.close()
    spark.stop()


if __name__ == "__main__":
    main()
