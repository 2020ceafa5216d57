"""Oracle building blocks for profiling, contracts, check reports and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

# Profiled tables: source relation and columns as name=<class><type>.
# Classes: I identifier, D dimension, S structural, T temporal, B boolean, M metric.
# Types: s string, l bigint, i int, d double, t date.
_PRICED = (
    "order_item_id=Is order_id=Il order_date=Tt customer_id=Il signup_date=Tt segment=Ds region=Ds"
    " company_size=Ds sales_channel=Ds sales_rep_id=Il team=Ds rep_region=Ds product_id=Is"
    " product_name=Ds category=Ds quantity=Ml list_price_at_sale=Md realized_unit_price=Md"
    " discount_pct=Md list_price=Md unit_cost=Md days_since_signup=Mi"
)
TABLES = {
    "customers": (
        "raw_customers",
        "customer_id=Il signup_date=Tt segment=Ds region=Ds company_size=Ds",
    ),
    "products": (
        "raw_products",
        "product_id=Is product_name=Ds category=Ds list_price=Md unit_cost=Md",
    ),
    "sales_reps": (
        "(SELECT sales_rep_id, team, rep_region AS region FROM raw_sales_reps)",
        "sales_rep_id=Il team=Ds region=Ds",
    ),
    "orders": (
        "raw_orders",
        "order_id=Il customer_id=Il order_date=Tt sales_channel=Ds sales_rep_id=Il",
    ),
    "order_items": (
        "raw_order_items",
        "order_item_id=Is order_id=Il product_id=Is quantity=Ml list_price_at_sale=Md"
        " realized_unit_price=Md discount_pct=Md",
    ),
    "order_item_enriched": ("enriched", _PRICED),
    "order_item_pricing_metrics": (
        """(SELECT *, listed AS line_list_revenue, net AS line_revenue, cost AS line_cost,
             year(order_date) || '-Q' || quarter(order_date) AS order_quarter,
             depth AS discount_depth, gm AS gross_margin_value,
             CASE WHEN depth <= 0.05 THEN '0-5%' WHEN depth <= 0.10 THEN '5-10%'
                  WHEN depth <= 0.20 THEN '10-20%' WHEN depth <= 0.30 THEN '20-30%'
                  ELSE '30%+' END AS discount_bucket,
             realization AS line_price_realization, high AS high_discount_flag,
             discounted AS discounted_flag, margin_pct AS margin_proxy_pct,
             residual AS price_realization_residual_pct,
             abs(residual) AS abs_price_realization_residual_pct FROM lines)""",
        f"{_PRICED} line_list_revenue=Md line_revenue=Md line_cost=Md order_month=St"
        " order_quarter=Ss realized_price=Md discount_depth=Md discount_bucket=Ss"
        " gross_margin_value=Md line_price_realization=Md high_discount_flag=Bi"
        " discounted_flag=Bi margin_proxy_pct=Md price_realization_residual_pct=Md"
        " abs_price_realization_residual_pct=Md",
    ),
    "customer_pricing_profile": (
        "profile",
        "customer_id=Il segment=Ds region=Ds company_size=Ds total_orders=Ml"
        " total_order_items=Ml total_revenue=Md avg_discount_pct=Md weighted_discount_pct=Md"
        " share_order_items_discounted=Md product_diversity=Ml avg_margin_proxy_pct=Md"
        " realized_price_cv=Md avg_abs_price_realization_residual_pct=Md"
        " share_orders_discounted=Md share_orders_high_discount=Md repeat_discount_behavior=Md"
        " revenue_high_discount_share=Md",
    ),
    "segment_pricing_summary": (
        "segments",
        "segment=Is total_revenue=Md avg_discount_pct=Md median_discount_pct=Md"
        " share_high_discount=Md avg_margin_proxy_pct=Md realized_price_variance=Md"
        " realized_price_std=Md price_realization_residual_std=Md"
        " price_realization_residual_abs_mean=Md margin_erosion_proxy=Md",
    ),
    "segment_channel_diagnostics": (
        "segment_channel",
        "segment=Is sales_channel=Is revenue=Md avg_discount_pct=Md high_discount_share=Md"
        " order_item_count=Ml avg_margin_proxy_pct=Md",
    ),
    "customer_risk_scores": (
        "scores",
        "customer_id=Il segment=Ds region=Ds company_size=Ds total_orders=Ml total_revenue=Md"
        " avg_discount_pct=Md weighted_discount_pct=Md share_orders_discounted=Md"
        " share_orders_high_discount=Md revenue_high_discount_share=Md avg_margin_proxy_pct=Md"
        " pricing_risk_score=Md discount_dependency_score=Md margin_erosion_score=Md"
        " governance_priority_score=Md score_reliability_weight=Md low_data_flag=Bi"
        " risk_tier=Ss main_risk_driver=Ss recommended_action=Ss",
    ),
    "risk_tier_summary": (
        """(SELECT risk_tier, recommended_action, count(*) AS customers,
             sum(total_revenue) AS total_revenue,
             avg(governance_priority_score) AS avg_governance_priority
            FROM scores GROUP BY risk_tier, recommended_action)""",
        "risk_tier=Is recommended_action=Is customers=Ml total_revenue=Md"
        " avg_governance_priority=Md",
    ),
    "main_driver_summary": (
        """(SELECT main_risk_driver, count(*) AS customers, sum(total_revenue) AS total_revenue,
             avg(governance_priority_score) AS avg_priority
            FROM scores GROUP BY main_risk_driver)""",
        "main_risk_driver=Is customers=Ml total_revenue=Md avg_priority=Md",
    ),
}
_LINE_LINKS = (
    "order_id->orders.order_id, customer_id->customers.customer_id,"
    " product_id->products.product_id, sales_rep_id->sales_reps.sales_rep_id"
)
_GRAINS = {
    "customers": ("1 row per customer account", "customer_id", ""),
    "products": ("1 row per product", "product_id", ""),
    "sales_reps": ("1 row per sales rep", "sales_rep_id", ""),
    "orders": (
        "1 row per order header",
        "order_id",
        "customer_id->customers.customer_id, sales_rep_id->sales_reps.sales_rep_id",
    ),
    "order_items": (
        "1 row per order line item",
        "order_item_id",
        "order_id->orders.order_id, product_id->products.product_id",
    ),
    "order_item_enriched": (
        "1 row per order line item with all dimensions attached",
        "order_item_id",
        _LINE_LINKS,
    ),
    "order_item_pricing_metrics": (
        "1 row per order line item with pricing metrics",
        "order_item_id",
        _LINE_LINKS,
    ),
    "customer_pricing_profile": (
        "1 row per customer pricing behavior profile",
        "customer_id",
        "customer_id->customers.customer_id",
    ),
    "segment_pricing_summary": ("1 row per customer segment", "segment", ""),
    "segment_channel_diagnostics": (
        "1 row per segment x sales_channel",
        "segment, sales_channel",
        "",
    ),
    "customer_risk_scores": (
        "1 row per customer scored for pricing governance risk",
        "customer_id",
        "customer_id->customer_pricing_profile.customer_id",
    ),
    "risk_tier_summary": (
        "1 row per risk_tier x recommended_action",
        "risk_tier, recommended_action",
        "",
    ),
    "main_driver_summary": ("1 row per main risk driver", "main_risk_driver", ""),
}
_CLASSES = {
    "I": "identifier", "D": "dimension", "S": "structural", "T": "temporal", "B": "boolean",
    "M": "metric",
}
_TYPES = {"s": "string", "l": "bigint", "i": "int", "d": "double", "t": "date"}


def _columns(table: str) -> list[tuple[str, str, str]]:
    pairs = [item.split("=") for item in TABLES[table][1].split()]
    return [(name, _CLASSES[code[0]], _TYPES[code[1]]) for name, code in pairs]


def _view(table: str) -> str:
    """The profiled columns of a table, as they are."""
    return f"SELECT {', '.join(n for n, _, _ in _columns(table))} FROM {TABLES[table][0]}"


def _list(items: Sequence[str]) -> str:
    return f"[{', '.join(items)}]"


def _texts(items: Sequence[str]) -> str:
    return _list(["'" + item.replace("'", "''") + "'" for item in items])


def _stats(table: str) -> str:
    columns = _columns(table)

    def counts(condition) -> str:
        return _list([condition(*c) for c in columns])

    return f"""
        SELECT '{table}' AS table_name, unnest({_texts([c[0] for c in columns])}) AS column_name,
               unnest({_texts([c[1] for c in columns])}) AS column_type,
               unnest({_texts([c[2] for c in columns])}) AS dtype, count(*) AS rows,
               unnest({counts(lambda n, k, t: f"count(*) - count({n})")}) AS nulls,
               unnest({counts(lambda n, k, t: f"count(DISTINCT {n})")}) AS distincts,
               unnest({counts(lambda n, k, t: f"avg(CASE WHEN regexp_matches({n}, "
                              "'^-?[0-9]+([.][0-9]+)?$') THEN 1 ELSE 0 END)"
                              if t == "string" else "NULL")}) AS numeric_like,
               unnest({counts(lambda n, k, t: f"count(*) FILTER ({n} < 0)"
                              if k == "metric" else "0")}) AS negatives
        FROM t_{table}"""


def column_types() -> str:
    rows = [
        f"('{table}', '{name}', '{kind}', '{dtype}')"
        for table in TABLES
        for name, kind, dtype in _columns(table)
    ]
    return (
        f"SELECT * FROM (VALUES {', '.join(rows)})"
        " AS v(table_name, column_name, column_type, dtype)"
    )


def column_profile() -> str:
    return """SELECT *, nulls / rows AS null_rate, distincts AS distinct_count,
        distincts / rows AS cardinality_ratio FROM column_stats"""


def table_summary() -> str:
    parts = []
    for table, (grain, key, links) in _GRAINS.items():
        columns = _columns(table)
        days = [n for n, kind, _ in columns if kind == "temporal"]
        first, last = (
            (f"strftime({f}({', '.join(f'{g}({d})' for d in days)}), '%Y-%m-%d')")
            if days
            else "NULL"
            for f, g in (("least", "min"), ("greatest", "max"))
        )
        parts.append(f"""
            SELECT '{table}' AS table_name, '{grain}' AS grain, '{key}' AS primary_key,
                   '{links}' AS foreign_keys, count(*) AS row_count,
                   {len(columns)} AS column_count, {first} AS date_coverage_start,
                   {last} AS date_coverage_end,
                   count(*) - count(DISTINCT ({key})) AS duplicate_rows_on_primary_key
            FROM t_{table}""")
    return " UNION ALL ".join(parts)


def top_values(names: Sequence[str] = tuple(TABLES)) -> str:
    parts = [
        f"""SELECT '{table}' AS table_name, '{name}' AS column_name,
            coalesce(CAST({name} AS VARCHAR), '<NULL>') AS value, count(*) AS "count",
            sum(count(*)) OVER () AS rows FROM t_{table} GROUP BY 3"""
        for table in names
        for name, kind, _ in _columns(table)
        if kind in ("dimension", "structural")
    ]
    return f"""SELECT *, "count" / rows AS share
        FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name
                                           ORDER BY "count" DESC, value) AS place
              FROM ({" UNION ALL ".join(parts)})) WHERE place <= 5"""


def numeric_summary() -> str:
    parts = [
        f"""SELECT '{table}' AS table_name, '{name}' AS column_name, count({name}) AS "count",
            avg({name}) AS mean, stddev_pop({name}) AS std, min({name}) AS "min",
            quantile_cont({name}, 0.05) AS p05, median({name}) AS "median",
            quantile_cont({name}, 0.95) AS p95, max({name}) AS "max",
            count(*) FILTER ({name} = 0) / count(*) AS zero_share,
            count(*) FILTER ({name} < 0) / count(*) AS negative_share FROM t_{table}"""
        for table in TABLES
        for name, kind, _ in _columns(table)
        if kind == "metric"
    ]
    return " UNION ALL ".join(parts)


# The metric contracts, written out for the oracle. Per table: key, columns that
# must not be NULL, lower and upper bounds, allowed labels.
_CONTRACTS = {
    "order_item_pricing_metrics": (
        "order_item_id",
        "order_item_id order_id order_date order_month customer_id product_id line_revenue"
        " line_list_revenue discount_depth line_price_realization"
        " price_realization_residual_pct high_discount_flag margin_proxy_pct",
        {
            "line_revenue": (0.0, None),
            "line_list_revenue": (0.0, None),
            "realized_price": (0.0, None),
            "list_price_at_sale": (0.0, None),
            "discount_depth": (0.0, 0.7),
            "line_price_realization": (0.0, 1.0),
            "high_discount_flag": (0.0, 1.0),
            "margin_proxy_pct": (-0.25, 1.0),
        },
        {
        },
    ),
    "customer_pricing_profile": (
        "customer_id",
        "customer_id total_orders total_revenue avg_discount_pct weighted_discount_pct"
        " share_orders_discounted share_orders_high_discount revenue_high_discount_share"
        " avg_margin_proxy_pct realized_price_cv avg_abs_price_realization_residual_pct"
        " repeat_discount_behavior",
        {
            "total_orders": (1.0, None),
            "total_revenue": (0.0, None),
            "avg_discount_pct": (0.0, 0.7),
            "weighted_discount_pct": (0.0, 0.7),
            "share_orders_discounted": (0.0, 1.0),
            "share_orders_high_discount": (0.0, 1.0),
            "revenue_high_discount_share": (0.0, 1.0),
            "avg_margin_proxy_pct": (0.0, 1.0),
            "realized_price_cv": (0.0, None),
            "avg_abs_price_realization_residual_pct": (0.0, None),
            "repeat_discount_behavior": (0.0, 1.0),
        },
        {
        },
    ),
    "customer_risk_scores": (
        "customer_id",
        "customer_id pricing_risk_score discount_dependency_score margin_erosion_score"
        " governance_priority_score main_risk_driver risk_tier recommended_action"
        " low_data_flag",
        {
            "pricing_risk_score": (0.0, 100.0),
            "discount_dependency_score": (0.0, 100.0),
            "margin_erosion_score": (0.0, 100.0),
            "governance_priority_score": (0.0, 100.0),
            "low_data_flag": (0.0, 1.0),
        },
        {
            "risk_tier": ("Low", "Medium", "High", "Critical",),
            "main_risk_driver": (
                "pricing_risk_score",
                "discount_dependency_score",
                "margin_erosion_score",
            ),
            "recommended_action": (
                "monitor only",
                "review segment pricing",
                "review pricing variance",
                "review discount terms",
                "review margin guardrails",
            ),
        },
    ),
    "segment_pricing_summary": (
        "segment",
        "segment total_revenue avg_discount_pct median_discount_pct share_high_discount"
        " avg_margin_proxy_pct price_realization_residual_std"
        " price_realization_residual_abs_mean margin_erosion_proxy",
        {
            "total_revenue": (0.0, None),
            "avg_discount_pct": (0.0, 0.7),
            "share_high_discount": (0.0, 1.0),
            "avg_margin_proxy_pct": (0.0, 1.0),
            "price_realization_residual_abs_mean": (0.0, None),
            "margin_erosion_proxy": (0.0, None),
        },
        {
        },
    ),
    "overall_pricing_health": (
        "",
        "total_revenue weighted_realized_discount price_realization"
        " high_discount_revenue_share margin_proxy_pct",
        {
            "total_revenue": (0.0, None),
            "weighted_realized_discount": (0.0, 1.0),
            "price_realization": (0.0, 1.0),
            "high_discount_revenue_share": (0.0, 1.0),
            "margin_proxy_pct": (0.0, 1.0),
        },
        {
        },
    ),
}

_CONTRACT_SOURCE = {"overall_pricing_health": "overall"}


def metric_contracts() -> str:
    parts = []
    for table, (key, not_null, bounds, allowed) in _CONTRACTS.items():
        source = _CONTRACT_SOURCE.get(table, f"full_{table}")
        width = 9 if table == "overall_pricing_health" else len(_columns(table))
        names = ["table_exists", "row_count_positive", "required_columns_present"]
        failed = ["0", "CASE WHEN count(*) > 0 THEN 0 ELSE 1 END", "0"]
        details = [
            f"'rows=' || count(*) || ' cols={width}'", "'rows=' || count(*)", "'all present'",
        ]
        if key:
            key = ", ".join(key.split())
            repeats = f"count(*) - count(DISTINCT {key})"
            names.append("primary_key_uniqueness")
            failed.append(repeats)
            details.append(f"'primary_key={key}, duplicate_rows=' || ({repeats})")
        worst = ", ".join(f"count(*) - count({c})" for c in not_null.split())
        names.append("key_null_rate")
        failed.append(f"greatest({worst})")
        details.append(f"'max_null_rate=' || printf('%.4f', greatest({worst}) / count(*))")
        for name, (low, high) in bounds.items():
            tests = [f"{name} < {low}"] if low is not None else []
            tests += [f"{name} > {high}"] if high is not None else []
            broken = f"count(*) FILTER ({' OR '.join(tests)})"
            names.append(f"bound_{name}")
            failed.append(broken)
            details.append(f"'violations=' || {broken} || ', min={low}, max={high}'")
        for name, labels in allowed.items():
            listed = ", ".join(f"'{label}'" for label in labels)
            broken = f"count(*) FILTER ({name} NOT IN ({listed}))"
            names.append(f"allowed_values_{name}")
            failed.append(broken)
            details.append(f"'invalid_rows=' || {broken}")
        parts.append(f"""SELECT '{table}' AS contract_table, unnest({_texts(names)}) AS check_name,
            unnest({_list(failed)}) AS failed, unnest({_list(details)}) AS detail FROM {source}""")
    return f"""SELECT contract_table, check_name,
        CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
        CASE WHEN check_name = 'table_exists' THEN 'Low' ELSE 'High' END AS severity, detail
        FROM ({" UNION ALL ".join(parts)})"""


# --- check reports -------------------------------------------------------------------------

Rule = tuple[str, str, str]


def _counted(rules: Sequence[Rule], source: str) -> str:
    """Rules as (name, failed rows, detail) over a source; no failed row is a pass."""
    return f"""SELECT check_name, CASE WHEN failed_rows = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
        failed_rows, detail
        FROM (SELECT unnest({_texts([r[0] for r in rules])}) AS check_name,
                     unnest({_list([r[1] for r in rules])}) AS failed_rows,
                     unnest({_list([r[2] for r in rules])}) AS detail FROM {source})"""


def _judged(rules: Sequence[Rule], source: str) -> str:
    """Rules as (name, outcome, detail) over a source."""
    return f"""SELECT check_name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, detail
        FROM (SELECT unnest({_texts([r[0] for r in rules])}) AS check_name,
                     unnest({_list([r[1] for r in rules])}) AS ok,
                     unnest({_list([r[2] for r in rules])}) AS detail FROM {source})"""


def _gated(rules: Sequence[tuple[Rule, str, str, bool]], source: str) -> str:
    base = _judged([r[0] for r in rules], source)
    tags = ", ".join(
        f"('{r[0][0]}', '{gate}', '{severity}', {str(blocker).lower()})"
        for r, gate, severity, blocker in ((x, x[1], x[2], x[3]) for x in rules)
    )
    return f"""SELECT * FROM ({base})
        JOIN (VALUES {tags}) AS g(check_name, gate, severity, blocker) USING (check_name)"""


_RAW = {
    "customers": ("raw_customers", "customer_id"),
    "products": ("raw_products", "product_id"),
    "sales_reps": ("raw_sales_reps", "sales_rep_id"),
    "orders": ("raw_orders", "order_id"),
    "order_items": ("raw_order_items", "order_item_id"),
}
_RAW_COLUMNS = {name: [c[0] for c in _columns(name)] for name in _RAW}


def _raw_structure() -> str:
    return " UNION ALL ".join(
        _counted(
            [
                (f"{name}_required_columns", "0", "'all required columns present'"),
                (
                    f"{name}_row_count_gate",
                    "CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END",
                    "'row_count=' || count(*) || ', minimum=1'",
                ),
            ],
            source,
        )
        for name, (source, _) in _RAW.items()
    )


def _raw_integrity() -> str:
    numeric = {
        "products": ("list_price", "unit_cost"),
        "order_items": ("quantity", "list_price_at_sale", "realized_unit_price", "discount_pct"),
    }
    parts = []
    for name, (_, key) in _RAW.items():
        empty = " + ".join(f"count(*) - count({c})" for c in _RAW_COLUMNS[name])
        rules = [
            (
                f"{name}_unique_{key}",
                f"count(*) - count(DISTINCT {key})",
                "'key values are unique'",
            ),
            (f"{name}_nulls", empty, "'no empty cells'"),
        ]
        rules += [
            (
                f"{name}_{c}_numeric",
                f"count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL)",
                "'values are numeric'",
            )
            for c in numeric.get(name, ())
        ]
        parts.append(_counted(rules, f"t_{name}"))
    parts.append("""SELECT child || '_' || CASE parent WHEN 'orders' THEN 'order'
            WHEN 'customers' THEN 'customer' WHEN 'products' THEN 'product'
            ELSE 'sales_rep' END || '_fk' AS check_name,
        CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END AS status, missing AS failed_rows,
        'every row has its ' || parent AS detail FROM links""")
    return " UNION ALL ".join(parts)


def _raw_rules() -> str:
    return " UNION ALL ".join(
        [
            _counted(
                [
                    (
                        "order_items_discount_bounds",
                        "count(*) FILTER (discount_pct NOT BETWEEN 0 AND 0.7)",
                        "'discounts lie in [0, 0.7]'",
                    ),
                    (
                        "order_items_realized_lte_list",
                        "count(*) FILTER (realized_unit_price > list_price_at_sale)",
                        "'realized price <= list price'",
                    ),
                    (
                        "order_items_positive_quantity",
                        "count(*) FILTER (quantity <= 0)",
                        "'quantities are positive'",
                    ),
                    (
                        "order_items_positive_list_price",
                        "count(*) FILTER (list_price_at_sale <= 0)",
                        "'list prices are positive'",
                    ),
                    (
                        "order_items_discount_formula_consistency",
                        "count(*) FILTER (abs(1 - realized_unit_price / list_price_at_sale"
                        " - discount_pct) > 1e-4)",
                        "'discount follows from the two prices'",
                    ),
                ],
                "raw_order_items",
            ),
            _counted(
                [
                    (
                        "products_positive_list_price",
                        "count(*) FILTER (list_price <= 0)",
                        "'list prices are positive'",
                    ),
                    (
                        "products_non_negative_unit_cost",
                        "count(*) FILTER (unit_cost < 0)",
                        "'costs are not negative'",
                    ),
                ],
                "raw_products",
            ),
            _counted(
                [
                    (
                        "customer_and_order_dates_valid",
                        "2 * count(*) - count(order_date) - count(signup_date)",
                        "'dates can be read'",
                    ),
                    (
                        "orders_not_before_customer_signup",
                        "count(*) FILTER (order_date < signup_date)",
                        "'orders follow signup'",
                    ),
                ],
                "raw_orders o LEFT JOIN raw_customers c ON c.customer_id = o.customer_id",
            ),
        ]
    )


def _processed() -> str:
    tables = {
        "order_item_pricing_metrics": "lines",
        "customer_pricing_profile": "profile",
        "segment_pricing_summary": "segments",
        "customer_risk_scores": "scores",
    }
    parts = [
        _counted(
            [
                (
                    f"{name}_row_count_gate",
                    "CASE WHEN count(*) > 0 THEN 0 ELSE 1 END",
                    "'row_count=' || count(*) || ', minimum=1'",
                ),
                (f"{name}_required_columns", "0", "'all required columns present'"),
            ],
            source,
        )
        for name, source in tables.items()
    ]
    p = "order_item_pricing_metrics"
    direct = "sum(depth * listed) / sum(listed)"
    totals = "1 - sum(net) / sum(listed)"
    ok = "'recomputed value agrees'"
    formulas = {
        "line_revenue_formula": "abs(net - quantity * realized_price) > 0.01",
        "list_revenue_formula": "abs(listed - quantity * list_price_at_sale) > 0.01",
        "line_cost_formula": "abs(cost - quantity * unit_cost) > 0.01",
        "gross_margin_formula": "abs(gm - (net - cost)) > 0.01",
        "margin_proxy_formula": "net > 0 AND abs(margin_pct - gm / net) > 1e-9",
        "high_discount_policy": "(high = 1) <> (depth >= 0.20::DOUBLE)",
        "line_price_realization_formula": "abs(realization - realized_price / list_price_at_sale)"
        " > 1e-9",
        "price_realization_residual_formula": "abs(residual - (realization / peer - 1)) > 1e-9",
        "abs_price_realization_residual_formula": "abs(abs(residual)"
        " - abs(realization / peer - 1)) > 1e-9",
        "discounted_policy": "(discounted = 1) <> (depth >= 0.05::DOUBLE)",
    }
    parts.append(
        _counted(
            [
                (
                    f"{p}_unique_order_item_id",
                    "count(*) - count(DISTINCT order_item_id)",
                    "'one row per order item'",
                ),
                (
                    f"{p}_discount_depth_bounds",
                    "count(*) FILTER (depth NOT BETWEEN 0 AND 0.7)",
                    "'depth lies in [0, 0.7]'",
                ),
                (
                    f"{p}_realized_lte_list",
                    "count(*) FILTER (realized_price > list_price_at_sale)",
                    "'realized price <= list price'",
                ),
                (
                    f"{p}_weighted_discount_reconciliation",
                    f"CASE WHEN abs({direct} - ({totals})) <= 0.001 THEN 0 ELSE 1 END",
                    f"printf('direct=%.6f, from_totals=%.6f', {direct}, {totals})",
                ),
                *[
                    (f"{p}_{name}", f"count(*) FILTER ({test})", ok)
                    for name, test in formulas.items()
                ],
            ],
            "lines",
        )
    )
    scores = (
        "pricing_risk_score", "discount_dependency_score", "margin_erosion_score",
        "governance_priority_score",
    )
    parts.append(
        _counted(
            [
                *[
                    (
                        f"{s}_bounds",
                        f"count(*) FILTER ({s} NOT BETWEEN 0 AND 100)",
                        "'score lies in [0, 100]'",
                    )
                    for s in scores
                ],
                (
                    "customer_risk_scores_unique_customer_id",
                    "count(*) - count(DISTINCT customer_id)",
                    "'one row per customer'",
                ),
                (
                    "customer_risk_scores_allowed_tiers",
                    "count(*) FILTER (risk_tier NOT IN ('Low', 'Medium', 'High', 'Critical'))",
                    "'tier is a policy label'",
                ),
                (
                    "customer_risk_scores_allowed_actions",
                    "count(*) FILTER (recommended_action NOT IN ('monitor only',"
                    " 'review segment pricing', 'review pricing variance',"
                    " 'review discount terms', 'review margin guardrails'))",
                    "'action is a policy label'",
                ),
            ],
            "scores",
        )
    )
    shares = (
        "share_orders_discounted", "share_orders_high_discount", "revenue_high_discount_share",
        "repeat_discount_behavior",
    )
    c = "customer_pricing_profile"
    parts.append(
        _counted(
            [
                (
                    f"{c}_unique_customer_id",
                    "count(*) - count(DISTINCT customer_id)",
                    "'one row per customer'",
                ),
                *[
                    (
                        f"{c}_{s}_bounds",
                        f"count(*) FILTER ({s} NOT BETWEEN 0 AND 1)",
                        "'share lies in [0, 1]'",
                    )
                    for s in shares
                ],
                (
                    f"{c}_price_realization_residual_non_negative",
                    "count(*) FILTER (avg_abs_price_realization_residual_pct IS NULL"
                    " OR avg_abs_price_realization_residual_pct < 0)",
                    "'mean residual is a non-negative number'",
                ),
            ],
            "profile",
        )
    )
    parts.append(
        _counted(
            [
                (
                    f"{c}_weighted_margin_reconciliation",
                    "count(*) FILTER (abs(avg_margin_proxy_pct - m) > 1e-9"
                    " OR m IS NULL OR avg_margin_proxy_pct IS NULL)",
                    "'profile margin equals margin over revenue'",
                )
            ],
            "profile FULL JOIN (SELECT customer_id, sum(gm) / sum(net) AS m FROM lines"
            " GROUP BY customer_id) USING (customer_id)",
        )
    )
    parts.append(
        _counted(
            [
                (
                    "customer_profile_to_risk_rowcount_consistency",
                    "abs(a - b)",
                    "'profile_rows=' || a || ', risk_rows=' || b",
                )
            ],
            "(SELECT (SELECT count(*) FROM profile) AS a, (SELECT count(*) FROM scores) AS b)",
        )
    )
    return " UNION ALL ".join(parts)


def _warehouse() -> str:
    parts = [
        """SELECT mart || '_row_count_positive' AS check_name,
           CASE WHEN rows > 0 THEN 'PASS' ELSE 'FAIL' END AS status,
           'row_count=' || rows AS detail FROM mart_keys""",
        """SELECT mart || '_primary_key_uniqueness',
           CASE WHEN rows = distinct_keys THEN 'PASS' ELSE 'FAIL' END,
           'rows=' || rows || ', distinct_keys=' || distinct_keys FROM mart_keys""",
        """SELECT 'anti_join_' || child || '_missing_' || parent,
           CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END, 'missing_rows=' || missing
           FROM links""",
    ]
    parts += [
        f"""SELECT 'stg_{name}_no_silent_drops',
            CASE WHEN count(*) = count({key}) THEN 'PASS' ELSE 'FAIL' END,
            'raw_rows=' || count(*) || ', staging_rows=' || count({key}) FROM {source}"""
        for name, (source, key) in _RAW.items()
    ]
    parts.append(
        _judged(
            [
                (
                    "int_order_item_enriched_no_silent_drops",
                    "items = wide",
                    "'order_items=' || items || ', enriched=' || wide",
                ),
                (
                    "mart_revenue_reconciliation_segment",
                    "abs(base - seg) <= greatest(1, base * 0.0001)",
                    "printf('base=%.2f, segment=%.2f', base, seg)",
                ),
                (
                    "mart_revenue_reconciliation_monthly",
                    "abs(base - mon) <= greatest(1, base * 0.0001)",
                    "printf('base=%.2f, monthly=%.2f', base, mon)",
                ),
                ("mart_customer_share_bounds", "shares = 0", "'violations=' || shares"),
                ("int_pricing_consistency", "prices = 0", "'violations=' || prices"),
                ("int_high_discount_flag_matches_policy", "flags = 0", "'violations=' || flags"),
                (
                    "mart_overall_as_of_date_deterministic",
                    "as_of = last_day",
                    "'as_of_date is the latest order date'",
                ),
            ],
            """(SELECT count(*) AS wide, sum(net) AS base, max(order_date) AS last_day,
                  count(*) FILTER (depth NOT BETWEEN 0 AND 0.7
                                   OR realized_price > list_price_at_sale) AS prices,
                  count(*) FILTER ((high = 1) <> (depth >= 0.20::DOUBLE)) AS flags,
                  (SELECT count(*) FROM raw_order_items) AS items,
                  (SELECT sum(total_revenue) FROM segments) AS seg,
                  (SELECT sum(revenue) FROM monthly) AS mon,
                  (SELECT count(*) FROM profile
                   WHERE revenue_high_discount_share NOT BETWEEN 0 AND 1
                      OR share_orders_discounted NOT BETWEEN 0 AND 1
                      OR share_orders_high_discount NOT BETWEEN 0 AND 1) AS shares,
                  (SELECT as_of_date FROM overall) AS as_of FROM lines)""",
        )
    )
    return " UNION ALL ".join(parts)


_FACTS = """
    SELECT count(*) AS n, sum(net) AS revenue, sum(listed) AS list_revenue, sum(gm) AS margin,
           sum(CASE WHEN order_item_id IS NULL OR order_id IS NULL OR customer_id IS NULL
                         OR product_id IS NULL OR net IS NULL OR depth IS NULL
                    THEN 1 ELSE 0 END) AS empty,
           sum(high_net) AS high_revenue, sum(depth * listed) / sum(listed) AS discount_direct,
           1 - sum(net) / sum(listed) AS discount_total,
           sum(margin_pct * net) / sum(net) AS margin_direct,
           sum(gm) / sum(net) AS margin_total,
           max(abs(1 - realized_price / list_price_at_sale - depth)) AS discount_gap,
           count(*) FILTER (realized_price > list_price_at_sale) AS above_list,
           date_diff('month', min(order_month), max(order_month)) + 1 AS months_expected,
           count(DISTINCT order_month) AS months_observed,
           count(DISTINCT customer_id) AS buyers,
           array_to_string(list_sort(list(DISTINCT year(order_date))), ',') AS years
    FROM lines"""


def _analysis() -> str:
    return _judged(
        [
            ("row_count_sanity", "n = wide", "'pricing=' || n || ', enriched=' || wide"),
            ("null_sanity_core_columns", "empty = 0", "'empty=' || CAST(empty AS BIGINT)"),
            (
                "magnitude_checks_positive_revenue",
                "revenue > 0 AND list_revenue >= revenue",
                "printf('revenue=%.2f, list_revenue=%.2f', revenue, list_revenue)",
            ),
            (
                "trend_continuity_monthly",
                "months_expected = months_observed",
                "'expected=' || months_expected || ', observed=' || months_observed",
            ),
            (
                "time_window_year_coverage",
                "years = seen_years",
                "'expected=' || years || ', observed=' || seen_years",
            ),
            (
                "subtotal_total_consistency",
                "abs(seg - revenue) <= greatest(1, revenue * 0.0001)",
                "printf('segment_total=%.2f, total=%.2f', seg, revenue)",
            ),
            (
                "denominator_correctness_shares",
                "shares = 0 AND high_revenue / revenue BETWEEN 0 AND 1",
                "'shares lie in [0, 1]'",
            ),
            (
                "aggregation_logic_weighted_discount",
                "abs(discount_direct - discount_total) <= 0.001",
                "printf('direct=%.6f, totals=%.6f', discount_direct, discount_total)",
            ),
            (
                "aggregation_logic_weighted_margin",
                "abs(margin_direct - margin_total) <= 0.001",
                "printf('direct=%.6f, totals=%.6f', margin_direct, margin_total)",
            ),
            (
                "population_coverage_transacting_customers",
                "buyers = profiled",
                "'transacting=' || buyers || ', profiled=' || profiled",
            ),
        ],
        """(SELECT f.*, (SELECT count(*) FROM enriched) AS wide,
              (SELECT array_to_string(list_sort(list(year)), ',') FROM yearly) AS seen_years,
              (SELECT sum(revenue) FROM segment_dependency) AS seg,
              (SELECT count(*) FROM yearly
               WHERE high_discount_revenue_share NOT BETWEEN 0 AND 1) AS shares,
              (SELECT count(*) FROM profile) AS profiled FROM line_facts f)""",
    )


def _review() -> str:
    links = {
        "fk_order_items_order": ("order_items", "orders"),
        "fk_orders_customer": ("orders", "customers"),
        "fk_order_items_product": ("order_items", "products"),
        "fk_orders_sales_rep": ("orders", "sales_reps"),
    }
    linked = " UNION ALL ".join(
        f"""SELECT '{name}' AS check_name, CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END
            AS status, 'missing=' || missing AS detail, 'technical' AS gate, 'High' AS severity,
            true AS blocker FROM links WHERE child = '{child}' AND parent = '{parent}'"""
        for name, (child, parent) in links.items()
    )
    lines = _gated(
        [
            (
                (
                    "join_explosion_order_items_to_enriched",
                    "items = wide",
                    "'order_items=' || items || ', enriched=' || wide",
                ),
                "technical", "High", True,
            ),
            (
                (
                    "join_explosion_enriched_to_pricing",
                    "wide = n",
                    "'enriched=' || wide || ', pricing=' || n",
                ),
                "technical", "High", True,
            ),
            (
                (
                    "discount_logic_consistency",
                    "discount_gap <= 1e-4",
                    "printf('max_abs_diff=%.6f', discount_gap)",
                ),
                "consistency", "High", True,
            ),
            (
                ("realized_lte_list", "above_list = 0", "'violations=' || above_list"),
                "consistency", "High", True,
            ),
            (
                (
                    "revenue_total_segment_match",
                    "abs(revenue - seg) <= greatest(1, revenue * 0.0001)",
                    "printf('pricing=%.2f, segment=%.2f', revenue, seg)",
                ),
                "consistency", "High", True,
            ),
            (
                (
                    "margin_proxy_consistency_line_vs_monthly",
                    "abs(margin_direct - margin_total) <= 0.001",
                    "printf('line=%.6f, monthly=%.6f', margin_direct, margin_total)",
                ),
                "consistency", "High", True,
            ),
            (
                (
                    "period_completeness_monthly",
                    "months_expected = months_observed",
                    "'expected=' || months_expected || ', observed=' || months_observed",
                ),
                "analytical", "Medium", False,
            ),
            (
                ("share_denominator_bounds", "shares = 0", "'rows_outside=' || shares"),
                "analytical", "High", False,
            ),
            (
                (
                    "weighted_discount_consistency",
                    "abs(discount_direct - discount_total) <= 0.001",
                    "printf('direct=%.6f, total=%.6f', discount_direct, discount_total)",
                ),
                "analytical", "High", False,
            ),
        ],
        """(SELECT f.*, (SELECT count(*) FROM enriched) AS wide,
              (SELECT count(*) FROM raw_order_items) AS items,
              (SELECT sum(total_revenue) FROM segments) AS seg,
              (SELECT count(*) FROM profile
               WHERE share_orders_discounted NOT BETWEEN 0 AND 1
                  OR share_orders_high_discount NOT BETWEEN 0 AND 1
                  OR revenue_high_discount_share NOT BETWEEN 0 AND 1) AS shares
            FROM line_facts f)""",
    )
    scores = _gated(
        [
            (
                (
                    "risk_score_nontrivial_variance",
                    "variance > 1",
                    "printf('variance=%.6f', variance)",
                ),
                "governance", "Medium", False,
            ),
            (
                (
                    "risk_tier_monotonicity_by_median_score",
                    "falls = 0",
                    "'median_scores=' || medians",
                ),
                "governance", "High", False,
            ),
            (
                ("main_risk_driver_alignment", "drivers = 0", "'mismatches=' || drivers"),
                "governance", "High", False,
            ),
            (
                (
                    "recommended_action_policy_alignment",
                    "actions = 0",
                    "'invalid_rows=' || actions",
                ),
                "governance", "Medium", False,
            ),
            (
                (
                    "score_stability_low_data_shrinkage",
                    "coalesce(low <= high + 2, true)",
                    "coalesce(printf('low_data=%.3f, high_data=%.3f', low, high),"
                    " 'not applicable: one of the two groups is empty')",
                ),
                "governance", "Medium", False,
            ),
        ],
        """(SELECT var_pop(governance_priority_score) AS variance,
              count(*) FILTER (CASE main_risk_driver
                  WHEN 'pricing_risk_score' THEN pricing_risk_score
                  WHEN 'discount_dependency_score' THEN discount_dependency_score
                  ELSE margin_erosion_score END
                  < greatest(pricing_risk_score, discount_dependency_score,
                             margin_erosion_score)) AS drivers,
              count(*) FILTER ((risk_tier = 'Low') <> (recommended_action = 'monitor only')
                  OR (risk_tier = 'Medium') <> (recommended_action = 'review segment pricing'))
                  AS actions,
              avg(abs(governance_priority_score - 50)) FILTER (low_data_flag = 1) AS low,
              avg(abs(governance_priority_score - 50)) FILTER (low_data_flag = 0) AS high,
              any_value(m.falls) AS falls, any_value(m.medians) AS medians
            FROM scores, (
                SELECT count(*) FILTER (v < before) AS falls,
                       string_agg(risk_tier || ':' || printf('%.3f', v), ', ' ORDER BY r)
                           AS medians
                FROM (SELECT risk_tier, v, r, lag(v) OVER (ORDER BY r) AS before
                      FROM (SELECT risk_tier, median(governance_priority_score) AS v,
                                   list_position(['Low', 'Medium', 'High', 'Critical'], risk_tier)
                                       AS r FROM scores GROUP BY risk_tier))) m)""",
    )
    return f"""SELECT * FROM ({linked})
        UNION ALL BY NAME SELECT * FROM ({lines}) UNION ALL BY NAME SELECT * FROM ({scores})"""


def _cross_output() -> str:
    return _gated(
        [
            (
                (
                    "cross_output_overall_health_consistency",
                    "gap <= 0.001",
                    "printf('max_diff=%.6f', gap)",
                ),
                "consistency", "High", False,
            ),
            (
                (
                    "dashboard_kpi_all_scope_consistency",
                    "abs(k.net_revenue - revenue) / revenue <= 0.001"
                    " AND abs(k.weighted_discount_pct - discount_total) <= 0.001",
                    "printf('revenue_diff=%.6f, discount_diff=%.6f',"
                    " abs(k.net_revenue - revenue) / revenue,"
                    " abs(k.weighted_discount_pct - discount_total))",
                ),
                "consistency", "High", False,
            ),
        ],
        """(SELECT f.*, greatest(abs(o.weighted_realized_discount - discount_total),
                                 abs(o.high_discount_revenue_share - high_revenue / revenue),
                                 abs(o.total_revenue - revenue) / revenue) AS gap
            FROM line_facts f, overall o) f,
           (SELECT * FROM kpis WHERE scope = 'open') k""",
    )


def _status_reports() -> str:
    parts = [
        f"""SELECT '{name}' AS check_name,
            CASE WHEN count(*) > 0 AND count(*) FILTER (status <> 'PASS') = 0 THEN 'PASS'
                 ELSE 'FAIL' END AS status,
            'rows=' || count(*) || ', failures=' || count(*) FILTER (status = 'FAIL')
                || ', invalid_statuses='
                || count(*) FILTER (status NOT IN ('PASS', 'FAIL')) AS detail,
            '{gate}' AS gate, 'High' AS severity, true AS blocker FROM ({report})"""
        for name, gate, report in (
            (
                "formal_analysis_validation_passthrough",
                "analytical",
                "SELECT * FROM analysis_checks",
            ),
            ("metric_contract_validation_passthrough", "governance", metric_contracts()),
        )
    ]
    return " UNION ALL ".join(parts)


_READINESS = """
    SELECT *, failed_blocker_checks = 0 AND failed_technical_checks = 0 AS technically_valid,
           failed_blocker_checks + failed_technical_checks + failed_analytical_checks = 0
               AS analytically_acceptable,
           failed_blocker_checks + failed_technical_checks + failed_analytical_checks = 0
               AS decision_support_only,
           failed_blocker_checks > 0 AS publish_blocked,
           CASE WHEN failed_blocker_checks > 0 OR failed_technical_checks > 0
                THEN 'publish-blocked'
                WHEN failed_analytical_checks = 0 THEN 'decision-support only'
                ELSE 'technical-only' END AS release_readiness_state
    FROM (SELECT count(*) FILTER (status = 'FAIL') AS failed_checks,
                 count(*) FILTER (status = 'FAIL' AND blocker) AS failed_blocker_checks,
                 count(*) FILTER (status = 'FAIL' AND gate = 'technical')
                     AS failed_technical_checks,
                 count(*) FILTER (status = 'FAIL' AND gate <> 'technical')
                     AS failed_analytical_checks
          FROM (SELECT check_name, status, gate, blocker FROM review_checks
                UNION ALL SELECT check_name, status, gate, blocker FROM cross_output
                UNION ALL SELECT check_name, status, gate, blocker FROM status_reports))"""

_NEVER_NEGATIVE = "price|discount|quantity|revenue|cost|orders|customers|share|variance"
_SIGNED = "residual|change|growth|delta|difference|deviation"


def _issues() -> str:
    single = ", ".join(
        f"('{table}', '{key}')" for table, (_, key, _) in _GRAINS.items() if "," not in key
    )
    select = (
        "SELECT table_name, column_name, '{severity}' AS severity, '{issue}' AS issue_type,"
        " {detail} AS detail FROM column_stats WHERE {test}"
    )
    null_text = "'null rate ' || printf('%.2f%%', nulls / rows * 100)"
    ratio_text = "'cardinality ratio ' || printf('%.2f%%', distincts / rows * 100)"
    rules = [
        ("High", "high_null_rate", null_text, "nulls / rows >= 0.30"),
        (
            "Medium",
            "moderate_null_rate",
            null_text,
            "nulls / rows >= 0.05 AND nulls / rows < 0.30",
        ),
        (
            "Medium",
            "high_cardinality_surprise",
            ratio_text,
            "column_type IN ('dimension', 'structural') AND distincts / rows > 0.90"
            " AND rows > 100",
        ),
        (
            "Low",
            "low_cardinality_surprise",
            "distincts || ' distinct values'",
            "column_type = 'metric' AND distincts BETWEEN 1 AND 5 AND rows > 100",
        ),
        (
            "High",
            "duplicate_risk_identifier",
            ratio_text,
            f"(table_name, column_name) IN ({single}) AND distincts / rows < 0.90",
        ),
        (
            "Medium",
            "mixed_format",
            "'numbers and other text in one column'",
            "dtype = 'string' AND numeric_like > 0.20 AND numeric_like < 0.80",
        ),
        (
            "High",
            "impossible_negative_value",
            "negatives || ' negative values'",
            f"column_type = 'metric' AND negatives > 0"
            f" AND regexp_matches(column_name, '{_NEVER_NEGATIVE}')"
            f" AND NOT regexp_matches(column_name, '{_SIGNED}')",
        ),
    ]
    parts = [
        select.format(severity=s, issue=i, detail=d, test=t) for s, i, d, t in rules
    ]
    for table in TABLES:
        names = {c[0] for c in _columns(table)}
        for low, high, severity, issue in (
            ("realized_unit_price", "list_price_at_sale", "High", "impossible_pricing"),
            ("unit_cost", "list_price", "Medium", "cost_above_list_price"),
        ):
            if {low, high} <= names:
                parts.append(f"""SELECT '{table}', '{low}', '{severity}', '{issue}',
                    count(*) || ' rows with {low} above {high}' FROM t_{table}
                    WHERE {low} > {high} HAVING count(*) > 0""")
    parts.append("""SELECT child, key, 'High', 'possible_join_issue',
        missing || ' rows without a match in ' || parent FROM links WHERE missing > 0""")
    parts.append("""SELECT 'customer_pricing_profile', 'customer_id', 'Medium',
        'population_exclusion', a - b || ' customers (' || printf('%.2f%%', (a - b) / a * 100)
            || ') have no orders'
        FROM (SELECT (SELECT count(*) FROM raw_customers) AS a,
                     (SELECT count(*) FROM profile) AS b) WHERE a > b""")
    return " UNION ALL ".join(parts)


COMMON = {
    "tenure": """
        SELECT customer_id, tenure_days,
               CASE WHEN tenure_days > 0 THEN CASE WHEN tenure_days <= 365 THEN '<1y'
                    WHEN tenure_days <= 730 THEN '1-2y' WHEN tenure_days <= 1095 THEN '2-3y'
                    WHEN tenure_days <= 1460 THEN '3-4y' ELSE '4y+' END END AS tenure_band
        FROM (SELECT customer_id, avg(days_since_signup) AS tenure_days
              FROM lines GROUP BY customer_id)""",
    "buckets": """
        SELECT * FROM (VALUES (0, '0-5%', -1.0::DOUBLE, 0.05::DOUBLE),
                              (1, '5-10%', 0.05::DOUBLE, 0.10::DOUBLE),
                              (2, '10-20%', 0.10::DOUBLE, 0.20::DOUBLE),
                              (3, '20-30%', 0.20::DOUBLE, 0.30::DOUBLE),
                              (4, '30%+', 0.30::DOUBLE, 9.0::DOUBLE)
                      ) AS b(bucket_order, discount_bucket, above, upto)""",
    **{f"t_{table}": _view(table) for table in TABLES},
    **{
        f"full_{table}": f"SELECT * FROM {TABLES[table][0]}"
        for table in _CONTRACTS
        if table in TABLES
    },
    "column_stats": " UNION ALL ".join(_stats(table) for table in TABLES),
    "raw_structure": _raw_structure(),
    "raw_integrity": _raw_integrity(),
    "raw_rules": _raw_rules(),
    "processed_checks": _processed(),
    "warehouse_checks": _warehouse(),
    "line_facts": _FACTS,
    "analysis_checks": _analysis(),
    "review_checks": _review(),
    "cross_output": _cross_output(),
    "status_reports": _status_reports(),
    "readiness": _READINESS,
    "issues": _issues(),
}
