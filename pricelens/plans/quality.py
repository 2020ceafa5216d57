"""Data-quality reports on raw, processed and warehouse tables.

Each report is a frame with one row per check. Conditions on the same table share one
aggregate; keys and links are counted in their own, so no check runs a scan of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import count_if, flag, ratio, weighted_mean
from pricelens.operators.checks import as_rows, counted, judged, stacked, status, text
from pricelens.operators.joins import duplicate_count
from pricelens.operators.links import Link, figure, link_counts, link_facts
from pricelens.sources import contract as C

col = F.col

LINKS = (
    ("orders_customer_fk", "orders", "customer_id", "customers"),
    ("orders_sales_rep_fk", "orders", "sales_rep_id", "sales_reps"),
    ("order_items_order_fk", "order_items", "order_id", "orders"),
    ("order_items_product_fk", "order_items", "product_id", "products"),
)
NUMERIC = {
    "products": ("list_price", "unit_cost"),
    "order_items": ("quantity", "list_price_at_sale", "realized_unit_price", "discount_pct"),
}


def _failures(condition: Column) -> Column:
    return count_if(F.coalesce(condition, F.lit(False)))


def _close(left: Column, right: Column, tolerance: float) -> Column:
    """Equal within the tolerance; two NULLs are equal, one NULL is not."""
    near = F.abs(left - right) <= tolerance
    return F.coalesce(near, left.isNull() & right.isNull())


# --- raw tables ----------------------------------------------------------------------------


def raw_structure(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables and columns exist; row counts are checked once the structure is complete."""
    session = next(iter(tables.values())).sparkSession
    rows = []
    for name, spec in C.RAW.items():
        if name not in tables:
            rows.append(counted(f"{name}_exists", F.lit(1), "table not given"))
            continue
        gaps = C.missing_columns(tables[name], spec)
        detail = f"missing: {', '.join(gaps)}" if gaps else "all required columns present"
        rows.append(counted(f"{name}_required_columns", F.lit(len(gaps)), detail))
    report = as_rows(session.range(1), rows)
    if not structure_complete(tables):
        return report
    sizes = [
        as_rows(
            tables[name].agg(F.count(F.lit(1)).alias("rows")),
            [
                counted(
                    f"{name}_row_count_gate",
                    F.greatest(F.lit(1) - col("rows"), F.lit(0)),
                    text("row_count=%d, minimum=1", col("rows")),
                )
            ],
        )
        for name in C.RAW
    ]
    return stacked([report, *sizes])


def structure_complete(tables: Mapping[str, DataFrame]) -> bool:
    return all(
        name in tables and not C.missing_columns(tables[name], spec)
        for name, spec in C.RAW.items()
    )


def _not_numeric(name: str) -> Column:
    return col(name).isNotNull() & col(name).try_cast("double").isNull()


def _held(quarantine: DataFrame, name: str) -> DataFrame:
    """One struct: the table's faulty rows and cells, and per numeric column faults and the first."""
    figures = [
        count_if(col("fault") == 1).alias("rows"),
        count_if(col("column_name").isin(*C.RAW[name].columns)).alias("cells"),
    ]
    for c in NUMERIC.get(name, ()):
        here = col("column_name") == c
        figures.append(count_if(here).alias(f"text_{c}"))
        figures.append(F.min(F.when(here, F.struct("row_key", "value", "record"))).alias(f"first_{c}"))
    return quarantine.where(col("table_name") == name).agg(F.struct(*figures))


def raw_integrity(
    tables: Mapping[str, DataFrame], quarantine: DataFrame | None = None
) -> DataFrame:
    """Unique keys, numeric text, complete links and no empty cells.

    All keys and links share one shuffle. With the quarantine of the files that the tables come
    from, a faulty cell fails its column and shows its row, and does not count as empty; each
    table also tells how many of its rows are held.
    """
    linked = {parent: label for label, _, _, parent in LINKS}
    links = [Link(label, parent, (key,), child, key) for label, child, key, parent in LINKS]
    links += [Link(name, name, spec.key) for name, spec in C.RAW.items() if name not in linked]
    parts, rows = [], []
    for name, spec in C.RAW.items():
        repeated = figure(linked.get(name, name), "duplicate_rows")
        rows.append(counted(f"{name}_unique_{spec.key[0]}", repeated, "key values are unique"))
    for label, _, _, parent in LINKS:
        missing = figure(label, "missing_rows")
        rows.append(counted(label, missing, f"every row has its {parent}"))
    parts.append(as_rows(link_facts(tables, links), rows))
    for name in C.RAW:
        table, numeric = tables[name], NUMERIC.get(name, ())
        empty = sum((col(c).isNull().cast("long") for c in table.columns), F.lit(0))
        measured = table.agg(
            F.coalesce(F.sum(empty), F.lit(0)).alias("empty"),
            *[count_if(_not_numeric(c)).alias(f"text_{c}") for c in numeric],
        )
        blank, details = col("empty"), dict.fromkeys(numeric, F.lit("values are numeric"))
        failed = {c: col(f"text_{c}") for c in numeric}
        if quarantine is not None:
            measured = measured.withColumn("held", _held(quarantine, name).scalar())
            blank = blank - col("held.cells")
            for c in numeric:
                failed[c] = failed[c] + col(f"held.text_{c}")
                first = col(f"held.first_{c}")
                shown = F.concat_ws(
                    "", details[c], F.lit("; first: "), first["value"], F.lit(" in "), first["record"]
                )
                details[c] = F.when(first.isNotNull(), shown).otherwise(details[c])
        rows = [counted(f"{name}_{c}_numeric", failed[c], details[c]) for c in numeric]
        rows.append(counted(f"{name}_nulls", blank, "no empty cells"))
        if quarantine is not None:
            rows.append(counted(f"{name}_quarantine", col("held.rows"), "no row is held"))
        parts.append(as_rows(measured, rows))
    return stacked(parts)


def raw_pricing_rules(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Price, discount and date rules; empty when any numeric column holds text."""

    def number(name: str) -> Column:
        return col(name).try_cast("double")

    listed, realized = number("list_price_at_sale"), number("realized_unit_price")
    depth = number("discount_pct")
    implied = F.lit(1.0) - ratio(realized, listed)
    lines = tables["order_items"].agg(
        _failures((depth < 0) | (depth > P.DISCOUNT_MAX)).alias("depth"),
        _failures(realized > listed).alias("above_list"),
        _failures(number("quantity") <= 0).alias("quantity"),
        _failures(listed <= 0).alias("list_price"),
        _failures(F.abs(implied - depth) > P.DISCOUNT_TOLERANCE).alias("formula"),
        _failures(_any_text("order_items")).alias("text"),
    )
    goods = tables["products"].agg(
        F.struct(
            _failures(number("list_price") <= 0).alias("list_price"),
            _failures(number("unit_cost") < 0).alias("unit_cost"),
            _failures(_any_text("products")).alias("text"),
        )
    )
    dates = order_dates(tables).agg(
        F.struct(
            (count_if(col("order_date").isNull()) + count_if(col("signup_date").isNull())).alias(
                "invalid"
            ),
            _failures(col("before_signup")).alias("early"),
        )
    )
    facts = lines.withColumns({"goods": goods.scalar(), "dates": dates.scalar()})
    rows = [
        counted("order_items_discount_bounds", col("depth"), "discounts lie in [0, 0.7]"),
        counted("order_items_realized_lte_list", col("above_list"), "realized price <= list price"),
        counted("order_items_positive_quantity", col("quantity"), "quantities are positive"),
        counted("order_items_positive_list_price", col("list_price"), "list prices are positive"),
        counted("products_positive_list_price", col("goods.list_price"), "list prices are positive"),
        counted("products_non_negative_unit_cost", col("goods.unit_cost"), "costs are not negative"),
        counted(
            "order_items_discount_formula_consistency",
            col("formula"),
            "discount follows from the two prices",
        ),
        counted("customer_and_order_dates_valid", col("dates.invalid"), "dates can be read"),
        counted("orders_not_before_customer_signup", col("dates.early"), "orders follow signup"),
    ]
    return as_rows(facts.where((col("text") == 0) & (col("goods.text") == 0)), rows)


def _any_text(table: str) -> Column:
    found = F.lit(False)
    for name in NUMERIC[table]:
        found = found | _not_numeric(name)
    return found


def order_dates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orders with their customer's signup date; unreadable dates are NULL."""
    signups = (
        tables["customers"]
        .dropDuplicates(["customer_id"])
        .select("customer_id", col("signup_date").try_cast("date").alias("signup_date"))
    )
    return (
        tables["orders"]
        .select("order_id", "customer_id", col("order_date").try_cast("date").alias("order_date"))
        .join(signups, "customer_id", "left")
        .withColumn("before_signup", col("order_date") < col("signup_date"))
    )


def raw_report(
    tables: Mapping[str, DataFrame], quarantine: DataFrame | None = None
) -> DataFrame:
    """The whole raw report; an incomplete structure ends it early."""
    structure = raw_structure(tables)
    if not structure_complete(tables):
        return structure
    return stacked([structure, raw_integrity(tables, quarantine), raw_pricing_rules(tables)])


# --- processed tables ----------------------------------------------------------------------

# The columns that each processed table must have, and the profile's shares.
PROCESSED_COLUMNS = {
    "order_item_pricing_metrics": (
        "order_item_id", "order_id", "customer_id", "product_id", "sales_channel", "quantity",
        "realized_price", "list_price_at_sale", "unit_cost", "discount_depth",
        "discount_bucket", "line_revenue", "line_list_revenue", "line_cost",
        "gross_margin_value", "margin_proxy_pct", "line_price_realization",
        "price_realization_residual_pct", "abs_price_realization_residual_pct",
        "high_discount_flag", "discounted_flag",
    ),
    "customer_pricing_profile": (
        "customer_id", "avg_discount_pct", "weighted_discount_pct", "share_orders_discounted",
        "revenue_high_discount_share", "product_diversity", "repeat_discount_behavior",
        "avg_abs_price_realization_residual_pct",
    ),
    "segment_pricing_summary": (
        "segment", "avg_discount_pct", "realized_price_variance", "margin_erosion_proxy",
    ),
    "customer_risk_scores": (
        "customer_id", "pricing_risk_score", "discount_dependency_score",
        "margin_erosion_score", "governance_priority_score", "risk_tier", "main_risk_driver",
        "recommended_action",
    ),
}
PROFILE_SHARES = (
    "share_orders_discounted",
    "share_orders_high_discount",
    "revenue_high_discount_share",
    "repeat_discount_behavior",
)


def processed_report(
    tables: Mapping[str, DataFrame], policy: P.Policy = P.POLICY
) -> DataFrame:
    """Structure, grain, bounds and recomputed arithmetic of the derived tables.

    A table that is absent, empty or short of columns is reported and not checked further.
    """
    session = next(iter(tables.values())).sparkSession
    parts = []
    sound: set[str] = set()
    for name, columns in PROCESSED_COLUMNS.items():
        if name not in tables:
            absent = counted(f"{name}_exists", F.lit(1), "table not given")
            parts.append(as_rows(session.range(1), [absent]))
            continue
        gaps = [c for c in columns if c not in tables[name].columns]
        rows = tables[name].agg(F.count(F.lit(1)).alias("rows"))
        parts.append(
            as_rows(
                rows,
                [
                    judged(
                        f"{name}_row_count_gate",
                        col("rows") > 0,
                        text("row_count=%d, minimum=1", col("rows")),
                    ),
                    counted(
                        f"{name}_required_columns",
                        F.lit(len(gaps)),
                        f"missing: {', '.join(gaps)}" if gaps else "all required columns present",
                    ),
                ],
            )
        )
        if not gaps:
            sound.add(name)
    if "order_item_pricing_metrics" in sound:
        parts.append(_line_checks(tables["order_item_pricing_metrics"], policy))
    if "customer_risk_scores" in sound:
        parts.append(_score_checks(tables["customer_risk_scores"]))
    if "customer_pricing_profile" in sound:
        parts.append(_profile_checks(tables["customer_pricing_profile"]))
        profile = tables["customer_pricing_profile"]
        if "order_item_pricing_metrics" in sound and "avg_margin_proxy_pct" in profile.columns:
            parts.append(_margin_check(profile, tables["order_item_pricing_metrics"]))
    if {"customer_pricing_profile", "customer_risk_scores"} <= sound:
        parts.append(
            _size_check(tables["customer_pricing_profile"], tables["customer_risk_scores"])
        )
    return stacked(parts)


def _line_checks(lines: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    name = "order_item_pricing_metrics"
    realization = ratio(col("realized_price"), col("list_price_at_sale"))
    baseline = lines.groupBy("product_id", "sales_channel").agg(
        F.avg(realization).alias("expected_baseline")
    )
    expected_gap = F.when(
        col("expected_baseline") > 0,
        (realization - col("expected_baseline")) / col("expected_baseline"),
    ).otherwise(F.lit(0.0))
    revenue, depth = col("line_revenue"), col("discount_depth")
    rules = {
        "line_revenue_formula": _close(revenue, col("quantity") * col("realized_price"), 0.01),
        "list_revenue_formula": _close(
            col("line_list_revenue"), col("quantity") * col("list_price_at_sale"), 0.01
        ),
        "line_cost_formula": _close(col("line_cost"), col("quantity") * col("unit_cost"), 0.01),
        "gross_margin_formula": _close(
            col("gross_margin_value"), revenue - col("line_cost"), 0.01
        ),
        "margin_proxy_formula": _close(
            col("margin_proxy_pct"), ratio(col("gross_margin_value"), revenue), 1e-9
        ),
        "high_discount_policy": col("high_discount_flag")
        == flag(depth >= policy.high_discount),
        "line_price_realization_formula": _close(
            col("line_price_realization"), realization, 1e-9
        ),
        "price_realization_residual_formula": _close(
            col("price_realization_residual_pct"), expected_gap, 1e-9
        ),
        "abs_price_realization_residual_formula": _close(
            col("abs_price_realization_residual_pct"), F.abs(expected_gap), 1e-9
        ),
        "discounted_policy": col("discounted_flag") == flag(depth >= policy.discounted),
    }
    compared = lines.join(baseline, ["product_id", "sales_channel"], "left")
    facts = compared.agg(
        F.count(F.lit(1)).alias("rows"),
        _failures((depth < 0) | (depth > P.DISCOUNT_MAX)).alias("depth"),
        _failures(col("realized_price") > col("list_price_at_sale")).alias("above_list"),
        weighted_mean(depth, col("line_list_revenue")).alias("direct"),
        ratio(
            F.sum("line_list_revenue") - F.sum(revenue), F.sum("line_list_revenue")
        ).alias("from_totals"),
        *[count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in rules.items()],
    ).withColumn("dup", duplicate_count(lines, ["order_item_id"]).scalar())
    rows = [
        counted(f"{name}_unique_order_item_id", col("dup"), "one row per order item"),
        counted(f"{name}_discount_depth_bounds", col("depth"), "depth lies in [0, 0.7]"),
        counted(f"{name}_realized_lte_list", col("above_list"), "realized price <= list price"),
        judged(
            f"{name}_weighted_discount_reconciliation",
            F.abs(col("direct") - col("from_totals")) <= 0.001,
            text("direct=%.6f, from_totals=%.6f", col("direct"), col("from_totals")),
        ),
    ]
    rows += [counted(f"{name}_{rule}", col(rule), "recomputed value agrees") for rule in rules]
    return as_rows(facts.where(col("rows") > 0), rows)


def _score_checks(scores: DataFrame) -> DataFrame:
    names = [*P.COMPONENTS, "governance_priority_score"]
    facts = scores.agg(
        F.count(F.lit(1)).alias("rows"),
        *[_failures((col(n) < 0) | (col(n) > 100)).alias(n) for n in names],
        count_if(~F.coalesce(col("risk_tier").isin(*P.TIERS_ASCENDING), F.lit(False))).alias("tier"),
        count_if(~F.coalesce(col("recommended_action").isin(*P.ACTIONS), F.lit(False))).alias(
            "action"
        ),
    ).withColumn("dup", duplicate_count(scores, ["customer_id"]).scalar())
    rows = [counted(f"{n}_bounds", col(n), "score lies in [0, 100]") for n in names]
    rows += [
        counted("customer_risk_scores_unique_customer_id", col("dup"), "one row per customer"),
        counted("customer_risk_scores_allowed_tiers", col("tier"), "tier is a policy label"),
        counted("customer_risk_scores_allowed_actions", col("action"), "action is a policy label"),
    ]
    return as_rows(facts.where(col("rows") > 0), rows)


def _profile_checks(profile: DataFrame) -> DataFrame:
    shares = [name for name in PROFILE_SHARES if name in profile.columns]
    residual = col("avg_abs_price_realization_residual_pct").try_cast("double")
    facts = profile.agg(
        F.count(F.lit(1)).alias("rows"),
        *[_failures((col(n) < 0) | (col(n) > 1)).alias(n) for n in shares],
        count_if(residual.isNull() | (residual < 0)).alias("residual"),
    ).withColumn("dup", duplicate_count(profile, ["customer_id"]).scalar())
    name = "customer_pricing_profile"
    rows = [counted(f"{name}_unique_customer_id", col("dup"), "one row per customer")]
    rows += [counted(f"{name}_{n}_bounds", col(n), "share lies in [0, 1]") for n in shares]
    rows.append(
        counted(
            f"{name}_price_realization_residual_non_negative",
            col("residual"),
            "mean residual is a non-negative number",
        )
    )
    return as_rows(facts.where(col("rows") > 0), rows)


def margin_comparison(profile: DataFrame, lines: DataFrame) -> DataFrame:
    """Profile margin next to margin over revenue of the customer's lines, on both sides' ids."""
    recomputed = lines.groupBy("customer_id").agg(
        ratio(F.sum("gross_margin_value"), F.sum("line_revenue")).alias("expected_margin_proxy_pct")
    )
    both = profile.select("customer_id", "avg_margin_proxy_pct").join(
        recomputed, "customer_id", "full_outer"
    )
    agrees = _close(col("avg_margin_proxy_pct"), col("expected_margin_proxy_pct"), 1e-9)
    return both.withColumn("agrees", agrees)


def _margin_check(profile: DataFrame, lines: DataFrame) -> DataFrame:
    def size(table: DataFrame) -> Column:
        return table.agg(F.count(F.lit(1))).scalar()

    off = count_if(~F.coalesce(col("agrees"), F.lit(False))).alias("off")
    facts = margin_comparison(profile, lines).agg(off).withColumns(
        {"profiles": size(profile), "rows": size(lines)}
    )
    rule = counted(
        "customer_pricing_profile_weighted_margin_reconciliation",
        col("off"),
        "profile margin equals margin over revenue",
    )
    return as_rows(facts.where((col("profiles") > 0) & (col("rows") > 0)), [rule])


def _size_check(profile: DataFrame, scores: DataFrame) -> DataFrame:
    facts = profile.agg(F.count(F.lit(1)).alias("p")).withColumn(
        "r", scores.agg(F.count(F.lit(1))).scalar()
    )
    rule = counted(
        "customer_profile_to_risk_rowcount_consistency",
        F.abs(col("p") - col("r")),
        text("profile_rows=%d, risk_rows=%d", col("p"), col("r")),
    )
    return as_rows(facts.where((col("p") > 0) & (col("r") > 0)), [rule])


# --- warehouse -----------------------------------------------------------------------------

MART_KEYS = {
    "mart_customer_pricing_profile": ("customer_id",),
    "mart_segment_pricing_summary": ("segment",),
    "mart_product_pricing_summary": ("product_id",),
    "mart_monthly_pricing_health": ("order_month",),
    "mart_overall_pricing_health": ("as_of_date",),
}
ORPHAN_CHECKS = (
    ("anti_join_order_items_missing_orders", "order_items", "order_id", "orders"),
    ("anti_join_orders_missing_customers", "orders", "customer_id", "customers"),
    ("anti_join_order_items_missing_products", "order_items", "product_id", "products"),
    ("anti_join_orders_missing_sales_reps", "orders", "sales_rep_id", "sales_reps"),
)


def _size(table: DataFrame) -> Column:
    return table.agg(F.count(F.lit(1))).scalar()


def orphan_report(staged: Mapping[str, DataFrame]) -> DataFrame:
    links = [Link(label, parent, (key,), child, key) for label, child, key, parent in ORPHAN_CHECKS]
    return link_counts(staged, links).select(col("name").alias("check_name"), "missing_rows")


def key_counts(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and distinct keys per mart."""
    parts = [
        marts[name]
        .groupBy(*key)
        .count()
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
        )
        .select(F.lit(name).alias("mart"), "rows", "distinct_keys")
        for name, key in MART_KEYS.items()
    ]
    return stacked(parts)


def run_log(layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Row count of every model with its layer."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("model_name"), "row_count"
        )
        for layer, models in layers.items()
        for name, table in models.items()
    ]
    return stacked(parts)


def warehouse_report(
    raw: Mapping[str, DataFrame],
    staged: Mapping[str, DataFrame],
    enriched: DataFrame,
    lines: DataFrame,
    marts: Mapping[str, DataFrame],
    policy: P.Policy = P.POLICY,
) -> DataFrame:
    """Row counts, dropped rows, links, keys, reconciliation and policy checks.

    The as-of check compares two scalars: the mart's date and the latest line date.
    """

    def row(name: str, passed: Column, detail: Column | str) -> dict:
        return {"check_name": name, "status": status(passed), "detail": detail}

    parts = []
    keys = key_counts(marts)
    for check, passed, detail in (
        ("row_count_positive", col("rows") > 0, text("row_count=%d", col("rows"))),
        (
            "primary_key_uniqueness",
            col("rows") == col("distinct_keys"),
            text("rows=%d, distinct_keys=%d", col("rows"), col("distinct_keys")),
        ),
    ):
        parts.append(
            keys.select(
                F.concat("mart", F.lit(f"_{check}")).alias("check_name"),
                status(passed).alias("status"),
                detail.alias("detail"),
            )
        )
    for name in C.RAW:
        facts = raw[name].agg(F.count(F.lit(1)).alias("a")).withColumn("b", _size(staged[name]))
        detail = text("raw_rows=%d, staging_rows=%d", col("a"), col("b"))
        parts.append(
            as_rows(facts, [row(f"stg_{name}_no_silent_drops", col("a") == col("b"), detail)])
        )
    facts = staged["order_items"].agg(F.count(F.lit(1)).alias("a")).withColumn("b", _size(enriched))
    parts.append(
        as_rows(
            facts,
            [
                row(
                    "int_order_item_enriched_no_silent_drops",
                    col("a") == col("b"),
                    text("order_items=%d, enriched=%d", col("a"), col("b")),
                )
            ],
        )
    )
    parts.append(
        orphan_report(staged).select(
            "check_name",
            status(col("missing_rows") == 0).alias("status"),
            text("missing_rows=%d", col("missing_rows")).alias("detail"),
        )
    )
    depth = col("discount_depth")
    shares = PROFILE_SHARES[:3]
    outside = F.lit(False)
    for name in shares:
        outside = outside | (col(name) < 0) | (col(name) > 1)
    line_facts = lines.agg(
        F.sum("line_revenue").alias("base"),
        F.max("order_date").alias("last_day"),
        _failures(
            (depth < 0)
            | (depth > P.DISCOUNT_MAX)
            | (col("realized_price") > col("list_price_at_sale"))
        ).alias("pricing"),
        _failures(
            col("high_discount_flag") != flag(depth >= policy.high_discount)
        ).alias("policy"),
    )
    profile = marts["mart_customer_pricing_profile"]
    both = line_facts.withColumns(
        {
            "segment": marts["mart_segment_pricing_summary"].agg(F.sum("total_revenue")).scalar(),
            "monthly": marts["mart_monthly_pricing_health"].agg(F.sum("revenue")).scalar(),
            "shares": profile.agg(_failures(outside)).scalar(),
            "as_of": marts["mart_overall_pricing_health"].agg(F.max("as_of_date")).scalar(),
        }
    )
    tolerance = F.greatest(F.lit(1.0), col("base") * 0.0001)
    checks = [
        row(
            f"mart_revenue_reconciliation_{name}",
            F.abs(col("base") - col(name)) <= tolerance,
            text(f"base=%.2f, {name}=%.2f", col("base"), col(name)),
        )
        for name in ("segment", "monthly")
    ]
    checks += [
        row("mart_customer_share_bounds", col("shares") == 0, text("violations=%d", col("shares"))),
        row("int_pricing_consistency", col("pricing") == 0, text("violations=%d", col("pricing"))),
        row(
            "int_high_discount_flag_matches_policy",
            col("policy") == 0,
            text("violations=%d", col("policy")),
        ),
        row(
            "mart_overall_as_of_date_deterministic",
            col("as_of") == col("last_day"),
            "as_of_date is the latest order date",
        ),
    ]
    parts.append(as_rows(both, checks))
    return stacked(parts)
