"""Every registered query as a function of a warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import pricing as X
from pricelens.functions.numeric import clip, count_if, ratio, sum_if, weighted_mean
from pricelens.operators import checks, joins, ordered, shapes
from pricelens.operators.links import Link
from pricelens.plans import (
    contracts,
    customers,
    dashboard,
    diagnostics,
    fact,
    marts,
    profiling,
    quality,
    review,
    risk,
    sql_models,
)
from pricelens.plans.dashboard import Scope
from pricelens.plans.warehouse import Warehouse
from pricelens.registry.shape import publish
from pricelens.sources import contract as C
from pricelens.sources import files, generations, quarantine

col = F.col
Query = Callable[[Warehouse], DataFrame]

OPEN = Scope()
# The ends are given in reverse on purpose: a scope swaps them.
NARROW = Scope(segment="BUILDING", sales_channel="1-URGENT", start="1999-12", end="1996-01")
SCOPES = {"open": OPEN, "narrow": NARROW}


# --- sources and sinks ---------------------------------------------------------------------


# Text that the queries write for themselves to read; part files are small enough to read whole.
TEXT_CODEC = "gzip"


def csv_folder(w: Warehouse, *names: str) -> str:
    """The named raw tables as CSV, each written once per warehouse."""
    folder = w.once("csv_folder", lambda: w.area.location("csv"))
    for name in names:
        w.once(
            f"csv_{name}",
            lambda name=name: files.write_bundle({name: w.raw[name]}, folder, compression=TEXT_CODEC),
        )
    return folder


def csv_source(name: str) -> Query:
    return lambda w: files.read_csv(w.spark, csv_folder(w, name), name, typed=False)


def typed_csv(name: str) -> Query:
    return lambda w: files.read_csv_bundle(w.spark, csv_folder(w, *C.RAW))[name]


def damaged_folder(w: Warehouse) -> str:
    """The raw tables as CSV files with cells that do not fit their contract, by plain rules."""

    def write() -> str:
        folder, raw = w.area.location("damaged"), dict(w.raw)
        items, orders, products = raw["order_items"], raw["orders"], raw["products"]
        words = F.concat(col("quantity").cast("string"), F.lit(" pcs"))
        depth = F.concat(F.lit("about "), F.round(col("discount_pct") * 100).cast("int"))
        raw["order_items"] = items.withColumns(
            {
                "quantity": F.when(col("quantity") >= 45, words).otherwise(col("quantity").cast("string")),
                "discount_pct": F.when(col("quantity") == 50, depth).otherwise(
                    col("discount_pct").cast("string")
                ),
            }
        )
        raw["orders"] = orders.withColumn(
            "order_date",
            F.when(
                F.dayofmonth("order_date") == 31, F.date_format("order_date", "dd.MM.yyyy")
            ).otherwise(col("order_date").cast("string")),
        )
        raw["products"] = products.withColumn(
            "unit_cost",
            F.when(col("category") == "ECONOMY", "n/a").otherwise(col("unit_cost").cast("string")),
        )
        files.write_bundle(raw, folder, compression=TEXT_CODEC)
        return folder

    return w.once("damaged_folder", write)


def checked_files(w: Warehouse) -> quarantine.CheckedBundle:
    return w.once(
        "checked_files",
        lambda: quarantine.read_checked_bundle(w.spark, damaged_folder(w), w.area),
    )


def clean_rows(w: Warehouse) -> DataFrame:
    """Rows without faults: per table their number, and of the lines what they sum to."""
    clean = checked_files(w).clean
    return checks.stacked(
        [
            table.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, table in clean.items()
        ]
    )


def quarantine_report(w: Warehouse) -> DataFrame:
    """The integrity report of the damaged files; details without the rows they show."""
    bundle = checked_files(w)
    report = quality.raw_integrity(bundle.tables, bundle.quarantine)
    return report.withColumn("detail", F.regexp_extract("detail", "^[^;]*", 0))


def mart_tables(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "mart_customer_pricing_profile": w.profile,
        "mart_segment_pricing_summary": w.segment_mart,
        "mart_product_pricing_summary": marts.products(w.lines),
        "mart_monthly_pricing_health": marts.monthly(w.lines),
        "mart_overall_pricing_health": marts.overall(w.lines),
    }


def table_sink(w: Warehouse) -> DataFrame:
    """Export the marts as CSV and Parquet and count what was written."""
    folder, tables = w.area.location("export"), mart_tables(w)
    files.write_bundle(tables, folder, ("csv", "parquet"))
    counts = []
    for name in tables:
        for kind in ("csv", "parquet"):
            written = w.spark.read.option("header", True).format(kind).load(f"{folder}/{name}.{kind}")
            counts.append(
                written.agg(F.count(F.lit(1)).alias("row_count")).select(
                    F.lit(name).alias("table_name"), F.lit(kind).alias("format"), "row_count"
                )
            )
    return checks.stacked(counts)


def atomic_sink(w: Warehouse) -> DataFrame:
    """Publish the marts as one generation and count the rows of the current one."""
    folder, tables = w.area.location("published"), mart_tables(w)
    generations.publish_bundle(tables, folder, ("csv", "parquet"))
    counts = []
    for kind in ("csv", "parquet"):
        for name, table in generations.read_published(w.spark, folder, tables, kind).items():
            counts.append(
                table.agg(F.count(F.lit(1)).alias("row_count")).select(
                    F.lit(name).alias("table_name"), F.lit(kind).alias("format"), "row_count"
                )
            )
    return checks.stacked(counts)


def policy_relation(w: Warehouse) -> DataFrame:
    policy = w.policy
    return w.lines.agg(
        F.lit(policy.high_discount).alias("high_discount_threshold"),
        F.lit(policy.discounted).alias("discounted_threshold"),
        count_if(col("discount_depth") >= policy.high_discount).alias("lines_high"),
        count_if(col("discount_depth") >= policy.discounted).alias("lines_discounted"),
    )


def json_records(w: Warehouse) -> DataFrame:
    return w.scores.select(
        files.json_record(
            w.scores,
            "customer_id",
            "segment",
            "region",
            "risk_tier",
            "main_risk_driver",
            "recommended_action",
            "governance_priority_score",
        ).alias("record")
    )


def json_row_sets(w: Warehouse) -> DataFrame:
    """The dashboard's row sets as JSON files, read back: rows and revenue of each."""
    sets = {
        "kpi_cube": (dashboard.kpi_cube(w.scope_facts), "net_revenue"),
        "monthly_facts": (w.scope_facts, "line_revenue"),
        "accounts": (accounts(w, OPEN), "filtered_revenue"),
        "account_facts": (w.account_facts, "filtered_revenue"),
    }
    folder = w.area.location("json")
    files.write_bundle({name: table for name, (table, _) in sets.items()}, folder, ["json"], TEXT_CODEC)
    read = []
    for name, (table, amount) in sets.items():
        back = w.spark.read.schema(table.schema).json(f"{folder}/{name}.json")
        sums = back.agg(F.count(F.lit(1)).alias("row_count"), F.sum(amount).alias("amount"))
        read.append(sums.select(F.lit(name).alias("record_set"), "row_count", "amount"))
    return checks.stacked(read)


def run_log(w: Warehouse) -> DataFrame:
    return quality.run_log(
        {
            "staging": {f"stg_{name}": table for name, table in w.staged.items()},
            "intermediate": {
                "int_order_item_enriched": w.enriched,
                "int_order_item_pricing_metrics": w.lines,
            },
            "marts": mart_tables(w),
        }
    )


# --- expressions ---------------------------------------------------------------------------


def date_parts(w: Warehouse) -> DataFrame:
    return w.lines.select(
        "order_item_id",
        "order_month",
        "order_quarter",
        F.year("order_date").alias("order_year"),
        X.month_label(col("order_date")).alias("month_label"),
    )


def safe_ratio(w: Warehouse) -> DataFrame:
    """Margin on high-discount lines; accounts without any show both fallbacks."""
    high = col("high_discount_flag") == 1
    sums = w.lines.groupBy("customer_id").agg(
        sum_if(high, col("gross_margin_value")).alias("margin"),
        sum_if(high, col("line_revenue")).alias("revenue"),
    )
    return sums.select(
        "customer_id",
        ratio(col("margin"), col("revenue")).alias("margin_or_null"),
        ratio(col("margin"), col("revenue"), 0.0).alias("margin_or_zero"),
    )


def clipped(w: Warehouse) -> DataFrame:
    margin = (col("avg_margin_proxy_pct") - 0.2) * 5
    share = col("share_orders_high_discount") * 1.25
    return w.profile.select(
        "customer_id",
        clip(margin, 0, 1).alias("margin_clipped"),
        clip(share, 0, 1).alias("share_clipped"),
        marts.erosion_proxy(margin, share).alias("erosion_proxy"),
    )


def null_fill(w: Warehouse) -> DataFrame:
    leakage = diagnostics.customer_leakage(w.lines, w.policy)
    return diagnostics.with_leakage(w.staged["customers"], leakage, F.lit(0.0))


# --- joins ---------------------------------------------------------------------------------


def join_contract(w: Warehouse) -> DataFrame:
    links = [
        Link(parent, parent, (key,), child, key)
        for child, key, parent in (
            ("order_items", "order_id", "orders"),
            ("orders", "customer_id", "customers"),
            ("order_items", "product_id", "products"),
            ("orders", "sales_rep_id", "sales_reps"),
        )
    ]
    return joins.violations(w.staged, links)


def profile_left_join(w: Warehouse) -> DataFrame:
    """Every registered customer with order statistics, 0 where there are none."""
    base = w.staged["customers"].select("customer_id")
    spent = w.lines.groupBy("customer_id").agg(F.sum("line_revenue").alias("total_revenue"))
    joined = base.join(spent, "customer_id", "left").join(
        customers.order_stats(w.ledger), "customer_id", "left"
    )
    return joined.fillna(
        0.0,
        [
            "total_revenue",
            "share_orders_discounted",
            "share_orders_high_discount",
            "repeat_discount_behavior",
        ],
    )


def policy_join(w: Warehouse) -> DataFrame:
    """Join the lines to the one-row policy relation through scalar subqueries."""
    policy = policy_relation(w)
    threshold = policy.select("high_discount_threshold").scalar()
    high = col("discount_depth") >= threshold
    return w.lines.agg(
        F.max(threshold).alias("high_discount_threshold"),
        F.sum("line_revenue").alias("base_revenue"),
        count_if(high).alias("lines_at_threshold"),
        sum_if(high, col("line_revenue")).alias("revenue_at_threshold"),
    )


def semi_join(w: Warehouse) -> DataFrame:
    """Lines of all accounts in the upper risk tiers."""
    chosen = w.scores.where(col("risk_tier").isin(*P.PRIORITY_TIERS)).select("customer_id")
    return w.lines.join(chosen, "customer_id", "left_semi")


def path_parity(w: Warehouse) -> DataFrame:
    return checks.stacked(
        [
            sql_models.parity(
                "overall", sql_models.overall(w.lines), marts.overall(w.lines), ["as_of_date"]
            ),
            sql_models.parity(
                "monthly", sql_models.monthly(w.lines), marts.monthly(w.lines), ["order_month"]
            ),
            sql_models.parity(
                "customers",
                sql_models.customers(w.lines_by_customer, w.ledger),
                w.profile,
                ["customer_id"],
            ),
            sql_models.parity(
                "segments", sql_models.segments(w.lines), w.segment_mart, ["segment"]
            ),
            sql_models.parity(
                "products", sql_models.products(w.lines), marts.products(w.lines), ["product_id"]
            ),
        ]
    )


# --- aggregates, windows, ordering ---------------------------------------------------------


def rounded_columns(w: Warehouse) -> DataFrame:
    digits = {
        "revenue": 2,
        "avg_discount_pct": 4,
        "high_discount_share": 4,
        "avg_margin_proxy_pct": 4,
    }
    return shapes.round_columns(marts.segment_channel(w.lines), digits)


def customer_fact(w: Warehouse) -> DataFrame:
    return dashboard.customer_facts(w.lines, policy=w.policy)


def weighted_averages(w: Warehouse) -> DataFrame:
    return w.lines.groupBy("segment").agg(
        weighted_mean(col("discount_depth"), col("line_list_revenue")).alias("weighted_discount"),
        weighted_mean(col("margin_proxy_pct"), col("line_revenue")).alias("weighted_margin"),
    )


def product_ranks(w: Warehouse) -> DataFrame:
    base = w.area.put("product_marts", marts.products(w.lines))
    ranks = ordered.percentile_ranks(
        w.area,
        base,
        ["product_id"],
        ["avg_discount_pct", "high_discount_share", "avg_margin_proxy_pct"],
        digits=P.SUM_DIGITS,
    )
    return ranks.select(
        "product_id",
        col("avg_discount_pct_rank").alias("avg_discount_rank"),
        col("high_discount_share_rank").alias("high_share_rank"),
        (F.lit(1.0) - col("avg_margin_proxy_pct_rank")).alias("low_margin_rank"),
    )


def top_decile(w: Warehouse) -> DataFrame:
    """The tenth of customers, rounded up, with the highest dependency."""
    ranked = diagnostics.ranked_customers(
        w.area, w.profile, -col("revenue_high_discount_share"), -col("total_revenue")
    )
    head = w.profile.agg(
        F.greatest(F.ceil(F.count(F.lit(1)) * P.TOP_DEPENDENCY_SHARE), F.lit(1))
    ).scalar()
    shares = w.profile.select("customer_id", "revenue_high_discount_share")
    return ranked.where(col("position") < head).join(shares, "customer_id")


def top_products(w: Warehouse, most: int = P.TOP_PRODUCTS) -> DataFrame:
    top = marts.products(w.lines).orderBy(col("revenue").desc(), "product_id").limit(most)
    return top.withColumn("deep_discount", col("high_discount_share") >= P.DEEP_SHARE_MARK)


def collapsed_tail(w: Warehouse) -> DataFrame:
    sums = marts.products(w.lines).select(
        col("product_id").alias("label"), col("revenue").alias("value")
    )
    return shapes.collapse_tail(sums, "label", "value")


def union_dedupe(w: Warehouse) -> DataFrame:
    """Totals per dimension, one after the other, with 'All' for the open dimensions."""
    facts = w.scope_facts
    parts = []
    for chosen in (None, *P.SCOPE_DIMS):
        grouped = facts.groupBy(*([chosen] if chosen else [])).agg(
            F.sum("line_revenue").alias("net_revenue"),
            F.sum("margin_risk_revenue").alias("margin_at_risk"),
        )
        labels = [
            col(name) if name == chosen else F.lit(P.ALL).alias(name) for name in P.SCOPE_DIMS
        ]
        parts.append(grouped.select(*labels, "net_revenue", "margin_at_risk"))
    return checks.stacked(parts).dropDuplicates(list(P.SCOPE_DIMS))


def month_gaps(w: Warehouse) -> DataFrame:
    missing = diagnostics.month_gaps(w.lines).agg(F.count(F.lit(1))).scalar()
    seen = w.lines.select("order_month").distinct()
    months = F.months_between(F.max("order_month"), F.min("order_month")).cast("int") + 1
    return seen.agg(
        months.alias("expected_months"), F.count(F.lit(1)).alias("observed_months")
    ).withColumn("missing_months", missing)


def bridge(w: Warehouse) -> DataFrame:
    return dashboard.bridge(dashboard.scoped_kpi(w.scope_facts, OPEN))


def priority_histogram(w: Warehouse) -> DataFrame:
    return shapes.histogram(w.scores, col("governance_priority_score"), 40)


# --- scoring stages ------------------------------------------------------------------------


def signals(w: Warehouse) -> DataFrame:
    return w.once("signals", lambda: risk.signals(w.area, w.profile, w.policy))


def reliability(w: Warehouse) -> DataFrame:
    return risk.component_scores(signals(w), w.policy).withColumn("shrunk_pricing", col("pricing_risk_score"))


# --- diagnostics ---------------------------------------------------------------------------


def recommendations(w: Warehouse) -> DataFrame:
    return diagnostics.recommendations(
        marts.overall(w.lines),
        diagnostics.segment_dependency(w.lines, w.profile),
        diagnostics.rep_behaviour(w.lines),
        diagnostics.product_patterns(w.area, w.lines),
        diagnostics.action_queue(w.lines, w.scores, w.policy),
        w.policy,
    )


def intervention_queue(w: Warehouse) -> DataFrame:
    dependent = col("revenue_high_discount_share") >= w.policy.high_revenue_share
    return w.profile.where(dependent).orderBy(col("total_revenue").desc(), "customer_id")


def reconciliation(w: Warehouse) -> DataFrame:
    table = diagnostics.reconciliation(w.lines, w.segment_mart, marts.monthly(w.lines))
    return table.select(
        "*",
        (F.abs("base_minus_segment") <= 0.01).alias("segment_agrees"),
        (F.abs("base_minus_monthly") <= 0.01).alias("monthly_agrees"),
    )


def cell_spotlight(w: Warehouse) -> DataFrame:
    cell = (col("segment") == "BUILDING") & (col("sales_channel") == "5-LOW")
    return marts.segment_channel(w.lines).where(cell)


# --- profiling and quality -----------------------------------------------------------------


def profiler(w: Warehouse) -> profiling.TableProfiler:
    """Shared profiles; the pricing fact holds the enriched lines' columns on the same rows."""
    repeats = {"order_item_enriched": "order_item_pricing_metrics"}
    return w.once("profiler", lambda: profiling.TableProfiler(w.area, written_tables(w), repeats))


def written_tables(w: Warehouse) -> dict[str, DataFrame]:
    """All tables, with the joins and aggregates among them written, as a profile scans each often.

    The pricing fact stays a view; the star join then reads the written lines.
    """
    w.raw.update({name: w.area.put(f"raw_{name}", w.raw[name]) for name in C.RAW})
    tables = all_tables(w)
    marts_ = ("segment_channel_diagnostics", "risk_tier_summary", "main_driver_summary")
    return tables | {name: w.area.put(name, tables[name]) for name in marts_}


def customer_links(w: Warehouse) -> dict[str, DataFrame]:
    """The tables whose links and customers are counted; no other is built for it."""
    scored = {"customer_pricing_profile": w.profile, "customer_risk_scores": w.scores}
    return {name: w.raw[name] for name in C.RAW} | scored


def all_tables(w: Warehouse) -> dict[str, DataFrame]:
    return {**{name: w.raw[name] for name in C.RAW}, **w.derived_tables()}


def metric_contracts(w: Warehouse) -> DataFrame:
    def build() -> DataFrame:
        tables = w.derived_tables()
        tables["overall_pricing_health"] = marts.overall(w.lines)
        return w.area.put("metric_contracts", contracts.contract_report(tables))

    return w.once("metric_contracts", build)


def analysis_checks(w: Warehouse) -> DataFrame:
    def build() -> DataFrame:
        report = review.analysis_report(
            w.lines,
            w.enriched,
            marts.yearly(w.lines),
            diagnostics.segment_dependency(w.lines, w.profile),
            marts.overall(w.lines),
            w.profile,
            w.policy,
        )
        return w.area.put("analysis_checks", report)

    return w.once("analysis_checks", build)


def cross_output(w: Warehouse) -> DataFrame:
    return review.cross_output_checks(
        w.lines, marts.overall(w.lines), dashboard.kpi_cube(w.scope_facts), w.policy
    )


def review_checks(w: Warehouse) -> DataFrame:
    def build() -> DataFrame:
        report = checks.stacked(
            [
                review.technical_checks(w.raw, w.enriched, w.lines),
                review.line_checks(w.lines, w.profile, w.segments, w.policy),
                review.score_checks(w.area, w.scores),
            ]
        )
        return w.area.put("review_checks", report)

    return w.once("review_checks", build)


def status_reports(w: Warehouse) -> DataFrame:
    return checks.stacked(
        [
            review.status_report_check(
                "formal_analysis_validation_passthrough", analysis_checks(w), "analytical"
            ),
            review.status_report_check(
                "metric_contract_validation_passthrough", metric_contracts(w), "governance"
            ),
        ]
    )


def readiness(w: Warehouse) -> DataFrame:
    """Readiness of the review, staged because the gate asks it several times."""

    def build() -> DataFrame:
        report = checks.stacked([review_checks(w), cross_output(w), status_reports(w)])
        return w.area.put("readiness", review.readiness(report))

    return w.once("readiness", build)


# --- dashboard slices ----------------------------------------------------------------------


def accounts(w: Warehouse, scope: Scope) -> DataFrame:
    return dashboard.scoped_accounts(w.scores, w.account_facts, scope)


def per_scope(w: Warehouse, build: Callable[[Scope], DataFrame]) -> DataFrame:
    return checks.stacked(
        [build(scope).withColumn("scope", F.lit(name)) for name, scope in SCOPES.items()]
    )


def indicators(w: Warehouse) -> DataFrame:
    return per_scope(
        w, lambda s: dashboard.scoped_indicators(w.scope_facts, accounts(w, s), s, w.policy)
    )


def scoped_kpis(w: Warehouse) -> DataFrame:
    return per_scope(w, lambda s: dashboard.scoped_kpi(w.scope_facts, s))


QUERIES: dict[str, Query] = {
    "a1_csv_source": csv_source("orders"),
    "a1_csv_customers": csv_source("customers"),
    "a1_csv_products": csv_source("products"),
    "a1_csv_sales_reps": csv_source("sales_reps"),
    "a1_csv_order_items": csv_source("order_items"),
    "a2_typed_csv_bundle": typed_csv("customers"),
    "a2_typed_csv_products": typed_csv("products"),
    "a2_typed_csv_sales_reps": typed_csv("sales_reps"),
    "a2_typed_csv_orders": typed_csv("orders"),
    "a2_typed_csv_order_items": typed_csv("order_items"),
    "a2_quarantine": lambda w: checked_files(w).quarantine.drop("record"),
    "a2_clean_rows": clean_rows,
    "a3_table_sink": table_sink,
    "a3_atomic_sink": atomic_sink,
    "a4_stg_customers": lambda w: w.staged["customers"],
    "a4_stg_products": lambda w: w.staged["products"],
    "a4_stg_orders": lambda w: w.staged["orders"],
    "a4_stg_order_items": lambda w: w.staged["order_items"],
    "a4_stg_sales_reps": lambda w: w.staged["sales_reps"],
    "a5_policy_relation": policy_relation,
    "a6_json_records": json_records,
    "a6_json_row_sets": json_row_sets,
    "a7_model_run_log": run_log,
    "b1_line_financials": lambda w: w.lines,
    "b2_margin_proxy_pct": lambda w: w.lines,
    "b3_line_price_realization": lambda w: w.lines,
    "b4_discount_bucket": lambda w: w.lines,
    "b5_discount_flags": lambda w: w.lines,
    "b6_date_parts": date_parts,
    "b7_days_since_signup": lambda w: w.lines,
    "b8_discount_scope": lambda w: w.lines.withColumns(X.scope_columns(w.policy)),
    "b9_dashboard_measures": lambda w: dashboard.additive_lines(w.lines, w.policy),
    "b10_safe_ratio": safe_ratio,
    "b11_rounded_columns": rounded_columns,
    "b12_tenure_band": lambda w: marts.customer_tenure(w.lines),
    "b13_clip": clipped,
    "b14_dependence_score": lambda w: diagnostics.dependence_ranking(w.lines),
    "b15_null_fill": null_fill,
    "c1_star_join": lambda w: fact.enriched(w.staged),
    "c2_join_contract": join_contract,
    "c3_profile_left_join": profile_left_join,
    "c4_queue_left_join": lambda w: diagnostics.with_leakage(
        w.scores, diagnostics.customer_leakage(w.lines, w.policy), col("total_revenue")
    ),
    "c5_policy_cross_join": policy_join,
    "c6_anti_joins": lambda w: quality.orphan_report(w.staged),
    "c7_semi_join": semi_join,
    "c8_margin_full_outer": lambda w: quality.margin_comparison(w.profile, w.lines),
    "c9_order_dates": lambda w: quality.order_dates(w.raw),
    "c10_segment_high_risk": lambda w: diagnostics.segment_exposure(w.segments, w.scores),
    "c11_path_parity": path_parity,
    "d1_overall": lambda w: marts.overall(w.lines),
    "d2_monthly": lambda w: marts.monthly(w.lines),
    "d3_yearly": lambda w: marts.yearly(w.lines),
    "d4_product": lambda w: marts.products(w.lines),
    "d5_segment_population": lambda w: w.segment_mart,
    "d6_segment_sample": lambda w: w.segments,
    "d7_segment_channel": lambda w: marts.segment_channel(w.lines),
    "d8_order_level": lambda w: customers.order_level(w.lines),
    "d9_customer_profile": lambda w: customers.profile(w.lines, w.ledger),
    "d10_repeat_behavior": lambda w: customers.order_stats(w.ledger),
    "d11_segment_dependency": lambda w: diagnostics.segment_dependency(w.lines, w.profile),
    "d12_product_dependency": lambda w: diagnostics.product_dependency(w.lines),
    "d13_erosion_base": lambda w: diagnostics.erosion_base(w.lines),
    "d14_rep_behavior": lambda w: diagnostics.rep_behaviour(w.lines),
    "d15_channel_region": lambda w: diagnostics.channel_region(w.lines),
    "d16_product_channel_variance": lambda w: diagnostics.product_variance(w.lines),
    "d17_tier_action": lambda w: risk.tier_summary(w.scores),
    "d18_main_driver": lambda w: risk.driver_summary(w.scores),
    "d19_kpi_cube": lambda w: dashboard.kpi_cube(w.scope_facts),
    "d20_monthly_fact": lambda w: dashboard.monthly_facts(w.lines, w.policy),
    "d21_customer_fact": customer_fact,
    "d22_channel_comparison": lambda w: marts.channel_comparison(w.lines),
    "d23_revenue_by_bucket": lambda w: marts.revenue_by_bucket(w.lines),
    "d24_margin_by_bucket": lambda w: marts.margin_by_bucket(w.lines),
    "d25_discount_ladders": lambda w: marts.ladders(w.lines),
    "d26_annual_value": lambda w: marts.annual_value(w.lines),
    "d27_segment_value_pool": lambda w: marts.value_pool(w.lines, "segment"),
    "d27_channel_value_pool": lambda w: marts.value_pool(w.lines, "sales_channel"),
    "d28_tier_detail": lambda w: risk.tier_detail(w.scores),
    "d29_tenure_cohort": lambda w: marts.tenure_cohorts(w.lines, w.profile),
    "d30_portfolio_counts": lambda w: marts.portfolio_counts(
        w.lines, w.scope_facts, w.profile, w.scores
    ),
    "d30_realization_range": lambda w: marts.realization_range(w.lines),
    "d31_weighted_average": weighted_averages,
    "d32_filter_options": lambda w: dashboard.filter_options(w.scope_facts),
    "d32_coverage": lambda w: dashboard.coverage(w.lines),
    "e1_peer_residual": lambda w: w.lines,
    "e2_previous_order": lambda w: customers.order_sequence(w.ledger),
    "e3_percentile_score": signals,
    "e4_percent_rank": product_ranks,
    "e5_rep_peer_zscore": lambda w: diagnostics.rep_behaviour(w.lines),
    "e6_revenue_concentration": lambda w: diagnostics.revenue_concentration(w.area, w.profile),
    "e6_top_revenue_shares": lambda w: diagnostics.top_revenue_shares(w.area, w.profile),
    "e7_month_over_month": lambda w: dashboard.scoped_trend(w.scope_facts, OPEN),
    "e8_period_growth": lambda w: diagnostics.period_growth(marts.yearly(w.lines)),
    "f1_ordered_lines": lambda w: w.lines.orderBy("order_date", "order_id", "order_item_id"),
    "f2_top_decile": top_decile,
    "f3_review_queue": lambda w: risk.review_queue(w.scores),
    "f4_top_products": top_products,
    "f5_top_dependence": lambda w: diagnostics.dependence_ranking(w.lines)
    .orderBy(col("dependence_score").desc(), "product_id")
    .limit(P.TOP_DEPENDENCE),
    "f6_top_values": lambda w: profiler(w).top_values(),
    "f7_queue_preview": lambda w: diagnostics.action_queue(w.lines, w.scores, w.policy)
    .orderBy(*diagnostics.queue_order())
    .limit(P.QUEUE_PREVIEW_ROWS),
    "f8_collapsed_tail": collapsed_tail,
    "f9_queue_table": lambda w: dashboard.queue_table(accounts(w, OPEN), "filtered_revenue"),
    "g1_union_dedupe": union_dedupe,
    "g2_month_gaps": month_gaps,
    "g3_month_by_flag": lambda w: marts.month_by_flag(w.lines),
    "g4_segment_channel_heatmap": lambda w: marts.segment_channel_heatmap(w.lines),
    "g5_bridge": bridge,
    "g6_distinct_keys": lambda w: quality.key_counts(mart_tables(w)),
    "h1_correlation": lambda w: diagnostics.discount_margin_fit(w.profile),
    "h2_regression": lambda w: diagnostics.discount_margin_fit(w.profile),
    "h3_discount_quantiles": lambda w: diagnostics.discount_quantiles(w.area, w.lines),
    "h3_score_quantile": lambda w: diagnostics.score_quantile(w.area, w.scores),
    "h4_discount_histogram45": lambda w: diagnostics.discount_histogram(w.lines, 45),
    "h4_discount_histogram40": lambda w: diagnostics.discount_histogram(w.lines, 40),
    "h4_priority_histogram40": priority_histogram,
    "h5_price_density": lambda w: diagnostics.price_density(w.lines),
    "h6_distribution_label": lambda w: diagnostics.distribution_label(
        diagnostics.discount_quantiles(w.area, w.lines)
    ),
    "h7_score_variances": lambda w: diagnostics.score_variances(w.profile, w.scores),
    "i1_scale_excess": signals,
    "i2_scale_shortfall": signals,
    "i3_reliability": reliability,
    "i4_components": lambda w: risk.raw_components(signals(w), w.policy),
    "i5_priority": lambda w: risk.classified(risk.component_scores(signals(w), w.policy), w.policy),
    "i6_risk_tier": lambda w: w.scores,
    "i7_main_driver": lambda w: w.scores,
    "i8_recommended_action": lambda w: w.scores,
    "i9_risk_scores": lambda w: risk.scored(w.area, w.profile, w.policy).orderBy(
        col("governance_priority_score").desc(), "customer_id"
    ),
    "j1_health_verdict": lambda w: diagnostics.verdict(marts.overall(w.lines), w.policy),
    "j2_threshold_sensitivity": lambda w: diagnostics.threshold_sensitivity(
        w.lines, w.policy
    ),
    "j3_action_queue": lambda w: diagnostics.action_queue(w.lines, w.scores, w.policy).orderBy(
        *diagnostics.queue_order()
    ),
    "j4_customer_dependency": lambda w: diagnostics.customer_dependency(w.profile).orderBy(
        col("revenue_high_discount_share").desc(), col("total_revenue").desc(), "customer_id"
    ),
    "j5_dependency_concentration": lambda w: diagnostics.dependency_concentration(
        w.area, w.profile
    ),
    "j6_margin_erosion": lambda w: diagnostics.margin_erosion(w.area, w.lines),
    "j7_rep_inconsistency": lambda w: diagnostics.rep_behaviour(w.lines),
    "j8_product_patterns": lambda w: diagnostics.product_patterns(w.area, w.lines),
    "j9_recommendations": recommendations,
    "j10_recovery_scenarios": lambda w: diagnostics.recovery_scenarios(marts.overall(w.lines)),
    "j11_run_rate": lambda w: diagnostics.run_rate(marts.overall(w.lines), w.lines),
    "j12_intervention_queue": intervention_queue,
    "j13_reconciliation": reconciliation,
    "j14_product_dependence": lambda w: marts.products(w.lines).orderBy(
        col("high_discount_share").desc(), col("revenue").desc(), "product_id"
    ),
    "j15_cell_spotlight": cell_spotlight,
    "j16_monthly_trend": lambda w: marts.monthly(w.lines).orderBy("order_month"),
    "j17_pressure_map": lambda w: marts.segment_channel(w.lines).orderBy(
        "segment", col("avg_discount_pct").desc()
    ),
    "k1_column_types": lambda w: profiler(w).column_types(),
    "k2_column_profile": lambda w: profiler(w).column_profile(),
    "k3_table_summary": lambda w: profiler(w).table_summary(),
    "k4_top_values": lambda w: profiler(w).top_values(),
    "k5_numeric_summary": lambda w: profiler(w).numeric_summary(),
    "k6_column_issues": lambda w: profiler(w).issues(),
    "k7_join_counts": lambda w: profiling.join_counts(customer_links(w)),
    "k8_population_coverage": lambda w: profiling.population_coverage(customer_links(w)),
    "k9_ranked_issues": lambda w: profiling.by_severity(profiler(w).issues()),
    "m1_raw_structure": lambda w: quality.raw_structure(w.raw),
    "m2_raw_integrity": lambda w: quality.raw_integrity(w.raw),
    "m2_file_integrity": quarantine_report,
    "m3_raw_pricing_rules": lambda w: quality.raw_pricing_rules(w.raw),
    "m4_processed_checks": lambda w: quality.processed_report(w.derived_tables(), w.policy),
    "m5_metric_contracts": metric_contracts,
    "m6_warehouse_checks": lambda w: quality.warehouse_report(
        w.raw, w.staged, w.enriched, w.lines, mart_tables(w), w.policy
    ),
    "m7_analysis_checks": analysis_checks,
    "m8_review_checks": review_checks,
    "m9_cross_output": cross_output,
    "m10_readiness": readiness,
    "m11_exclusions": lambda w: review.exclusions(w.raw["customers"], w.profile),
    "m12_release_gate": lambda w: review.release_gate(readiness(w), metric_contracts(w)),
    "m13_status_reports": status_reports,
    "n1_scoped_kpi": scoped_kpis,
    "n2_revenue_coverage": scoped_kpis,
    "n3_scoped_accounts": lambda w: accounts(w, NARROW),
    "n4_posture": indicators,
    "n5_indicator_levels": indicators,
    "n6_scoped_trend": lambda w: dashboard.scoped_trend(w.scope_facts, NARROW),
    "n7_segment_ranking": lambda w: dashboard.segment_ranking(w.scope_facts, OPEN),
    "n8_region_ranking": lambda w: dashboard.region_ranking(w.scope_facts, OPEN),
    "n9_action_revenue": lambda w: dashboard.revenue_by(accounts(w, OPEN), "recommended_action"),
    "n9_driver_revenue": lambda w: dashboard.revenue_by(accounts(w, OPEN), "main_risk_driver"),
    "n9_action_chart": lambda w: dashboard.action_chart(accounts(w, OPEN)),
}


def run(name: str, warehouse: Warehouse) -> DataFrame:
    """Run a registered query and publish its columns."""
    return publish(name, QUERIES[name](warehouse))
