"""Published columns of every registered query, and the casts that publish them.

Both engines publish through this list: same names, same types, rounded doubles, dates as
ISO text. Kinds: k text, i whole number, b boolean, d date, m money, r ratio or score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_DIGITS, RATIO_DIGITS = 4, 8

_CHECK = "check_name:k status:k failed_rows:i detail:k"
_RULE = "check_name:k status:k detail:k"
_REVIEW = "check_name:k status:k detail:k gate:k severity:k blocker:b"
_KPI = (
    "net_revenue:m list_revenue:m leakage:m weighted_discount_pct:r margin_at_risk:m"
    " margin_risk_share:r"
)
_SCORES = (
    "pricing_risk_score:r discount_dependency_score:r margin_erosion_score:r"
    " governance_priority_score:r"
)
_VALUE_POOL = (
    "revenue:m list_revenue:m revenue_forgone:m gross_margin_value:m high_discount_revenue:m"
    " order_items:i customers:i price_realization:r weighted_discount_pct:r margin_proxy_pct:r"
    " high_discount_revenue_share:r share_of_revenue_forgone:r"
)
_OVERALL = (
    "as_of_date:d total_revenue:m total_list_revenue:m total_margin_proxy_value:m"
    " avg_realized_discount:r weighted_realized_discount:r high_discount_revenue_share:r"
    " price_realization:r margin_proxy_pct:r"
)
_QUEUE = (
    "customer_id:i segment:k region:k risk_tier:k main_risk_driver:k recommended_action:k"
    " governance_priority_score:r total_revenue:m revenue_in_scope:m high_discount_revenue:m"
    " margin_at_risk_revenue:m discount_leakage_value:m priority_value_proxy:r"
)
_ACCOUNT = (
    "customer_id:i segment:k region:k risk_tier:k main_risk_driver:k recommended_action:k"
    " governance_priority_score:r filtered_revenue:m filtered_avg_discount:r"
)
_ITEMS = (
    "order_item_id:k order_id:i product_id:k quantity:i list_price_at_sale:m"
    " realized_unit_price:m discount_pct:r"
)
_SCOPE_DIMS = "segment:k region:k category:k sales_channel:k"

COLUMNS = {
    "a1_csv_source": "order_id:i customer_id:i order_date:d sales_channel:k sales_rep_id:i",
    "a2_typed_csv_bundle": "customer_id:i signup_date:d segment:k region:k company_size:k",
    "a1_csv_customers": "customer_id:i signup_date:d segment:k region:k company_size:k",
    "a1_csv_products": "product_id:k product_name:k category:k list_price:m unit_cost:m",
    "a1_csv_sales_reps": "sales_rep_id:i team:k region:k",
    "a1_csv_order_items": _ITEMS,
    "a2_typed_csv_products": "product_id:k product_name:k category:k list_price:m unit_cost:m",
    "a2_typed_csv_sales_reps": "sales_rep_id:i team:k region:k",
    "a2_typed_csv_orders": "order_id:i customer_id:i order_date:d sales_channel:k sales_rep_id:i",
    "a2_typed_csv_order_items": _ITEMS,
    "a2_quarantine": "table_name:k row_key:k fault:i column_name:k value:k",
    "a2_clean_rows": "table_name:k row_count:i",
    "a3_table_sink": "table_name:k format:k row_count:i",
    "a3_atomic_sink": "table_name:k format:k row_count:i",
    "a4_stg_customers": "customer_id:i signup_date:d segment:k region:k company_size:k",
    "a4_stg_products": "product_id:k product_name:k category:k list_price:m unit_cost:m",
    "a4_stg_orders": "order_id:i customer_id:i order_date:d sales_channel:k sales_rep_id:i",
    "a4_stg_order_items": _ITEMS,
    "a4_stg_sales_reps": "sales_rep_id:i team:k rep_region:k",
    "a5_policy_relation": (
        "high_discount_threshold:r discounted_threshold:r lines_high:i lines_discounted:i"
    ),
    "a6_json_records": "record:k",
    "a6_json_row_sets": "record_set:k row_count:i amount:m",
    "a7_model_run_log": "layer:k model_name:k row_count:i",
    "b1_line_financials": (
        "order_item_id:k line_list_revenue:m line_revenue:m line_cost:m gross_margin_value:m"
    ),
    "b2_margin_proxy_pct": "order_item_id:k margin_proxy_pct:r",
    "b3_line_price_realization": "order_item_id:k line_price_realization:r",
    "b4_discount_bucket": "order_item_id:k discount_depth:r discount_bucket:k",
    "b5_discount_flags": "order_item_id:k high_discount_flag:i discounted_flag:i",
    "b6_date_parts": (
        "order_item_id:k order_month:d order_quarter:k order_year:i month_label:k"
    ),
    "b7_days_since_signup": "order_item_id:k days_since_signup:i",
    "b8_discount_scope": (
        "order_item_id:k high_discount_revenue:m margin_at_risk_revenue:m"
        " discount_leakage_value:m"
    ),
    "b9_dashboard_measures": (
        "order_item_id:k discount_weighted_num:m high_discount_revenue:m margin_risk_revenue:m"
    ),
    "b10_safe_ratio": "customer_id:i margin_or_null:r margin_or_zero:r",
    "b11_rounded_columns": (
        "segment:k sales_channel:k revenue:m avg_discount_pct:r high_discount_share:r"
        " avg_margin_proxy_pct:r"
    ),
    "b12_tenure_band": "customer_id:i tenure_days:r tenure_band:k",
    "b13_clip": "customer_id:i margin_clipped:r share_clipped:r erosion_proxy:r",
    "b14_dependence_score": "product_id:k revenue:m dependence_score:r",
    "b15_null_fill": (
        "customer_id:i revenue_in_scope:m high_discount_revenue:m margin_at_risk_revenue:m"
        " discount_leakage_value:m"
    ),
    "c1_star_join": (
        "order_item_id:k order_id:i order_date:d customer_id:i signup_date:d segment:k region:k"
        " company_size:k sales_channel:k sales_rep_id:i team:k rep_region:k product_id:k"
        " product_name:k category:k quantity:i list_price_at_sale:m realized_unit_price:m"
        " discount_pct:r list_price:m unit_cost:m days_since_signup:i"
    ),
    "c2_join_contract": "dimension:k join_key:k duplicate_keys:i unmatched_rows:i examples:k",
    "c3_profile_left_join": (
        "customer_id:i total_revenue:m share_orders_discounted:r share_orders_high_discount:r"
        " repeat_discount_behavior:r"
    ),
    "c4_queue_left_join": (
        "customer_id:i governance_priority_score:r revenue_in_scope:m margin_at_risk_revenue:m"
        " discount_leakage_value:m"
    ),
    "c5_policy_cross_join": (
        "high_discount_threshold:r base_revenue:m lines_at_threshold:i revenue_at_threshold:m"
    ),
    "c6_anti_joins": "check_name:k missing_rows:i",
    "c7_semi_join": "order_item_id:k customer_id:i line_revenue:m",
    "c8_margin_full_outer": (
        "customer_id:i avg_margin_proxy_pct:r expected_margin_proxy_pct:r agrees:b"
    ),
    "c9_order_dates": (
        "order_id:i customer_id:i order_date:d signup_date:d before_signup:b"
    ),
    "c10_segment_high_risk": (
        "segment:k margin_erosion_proxy:r high_risk_customer_share:r high_risk_customers:i"
        " total_customers:i"
    ),
    "c11_path_parity": "mart:k metric:k rows:i differing_rows:i",
    "d1_overall": _OVERALL,
    "d2_monthly": (
        "order_month:d revenue:m list_revenue:m gross_margin_value:m avg_discount_pct:r"
        " high_discount_share:r weighted_discount_pct:r margin_proxy_pct:r"
    ),
    "d3_yearly": (
        "year:i revenue:m list_revenue:m margin_proxy_value:m avg_realized_discount:r"
        " high_discount_revenue:m price_realization:r weighted_discount:r margin_proxy_pct:r"
        " high_discount_revenue_share:r"
    ),
    "d4_product": (
        "product_id:k product_name:k category:k revenue:m list_revenue:m avg_discount_pct:r"
        " avg_margin_proxy_pct:r high_discount_share:r order_item_count:i price_realization:r"
    ),
    "d5_segment_population": (
        "segment:k total_revenue:m avg_discount_pct:r median_discount_pct:r"
        " share_high_discount:r avg_margin_proxy_pct:r realized_price_variance:m"
        " realized_price_std:m margin_erosion_proxy:r"
    ),
    "d6_segment_sample": (
        "segment:k total_revenue:m avg_discount_pct:r median_discount_pct:r"
        " share_high_discount:r avg_margin_proxy_pct:r realized_price_variance:m"
        " realized_price_std:m price_realization_residual_std:r"
        " price_realization_residual_abs_mean:r margin_erosion_proxy:r"
    ),
    "d7_segment_channel": (
        "segment:k sales_channel:k revenue:m avg_discount_pct:r high_discount_share:r"
        " order_item_count:i avg_margin_proxy_pct:r"
    ),
    "d8_order_level": (
        "customer_id:i order_id:i order_date:d order_revenue:m order_discount_depth:r"
        " high_discount_order:i discounted_order:i"
    ),
    "d9_customer_profile": (
        "customer_id:i segment:k region:k company_size:k total_orders:i total_order_items:i"
        " total_revenue:m avg_discount_pct:r weighted_discount_pct:r"
        " share_order_items_discounted:r product_diversity:i avg_margin_proxy_pct:r"
        " realized_price_cv:r avg_abs_price_realization_residual_pct:r"
        " share_orders_discounted:r share_orders_high_discount:r repeat_discount_behavior:r"
        " revenue_high_discount_share:r"
    ),
    "d10_repeat_behavior": "customer_id:i repeat_discount_behavior:r",
    "d11_segment_dependency": (
        "segment:k revenue:m avg_discount_pct:r high_discount_revenue:m"
        " repeat_discount_behavior:r high_discount_revenue_share:r avg_margin_proxy_pct:r"
    ),
    "d12_product_dependency": (
        "product_id:k product_name:k category:k revenue:m avg_discount_pct:r"
        " high_discount_revenue:m order_lines:i high_discount_revenue_share:r"
    ),
    "d13_erosion_base": (
        "segment:k category:k revenue:m list_revenue:m gross_margin_value:m avg_discount_pct:r"
        " high_discount_share:r order_lines:i margin_proxy_pct:r discount_leakage_value:m"
    ),
    "d14_rep_behavior": (
        "sales_rep_id:i team:k rep_region:k revenue:m order_lines:i avg_discount_pct:r"
        " discount_std:r avg_margin_proxy_pct:r"
    ),
    "d15_channel_region": (
        "sales_channel:k region:k revenue:m avg_discount_pct:r order_lines:i"
        " avg_margin_proxy_pct:r"
    ),
    "d16_product_channel_variance": (
        "product_id:k product_name:k category:k sales_channel:k revenue:m order_lines:i"
        " avg_discount_pct:r realized_price_mean:r realized_price_std:r"
        " price_realization_residual_abs_mean:r price_realization_residual_std:r"
        " realized_price_cv:r"
    ),
    "d17_tier_action": (
        "risk_tier:k recommended_action:k customers:i total_revenue:m avg_governance_priority:r"
    ),
    "d18_main_driver": "main_risk_driver:k customers:i total_revenue:m avg_priority:r",
    "d19_kpi_cube": (
        f"{_SCOPE_DIMS} net_revenue:m weighted_discount_pct:r high_discount_revenue_share:r"
        " margin_at_risk:m margin_at_risk_share:r"
    ),
    "d20_monthly_fact": (
        f"order_month:k {_SCOPE_DIMS} line_revenue:m line_list_revenue:m"
        " discount_weighted_num:m high_discount_revenue:m margin_risk_revenue:m"
    ),
    "d21_customer_fact": (
        f"order_month:k customer_id:i {_SCOPE_DIMS} filtered_revenue:m filtered_list_revenue:m"
        " filtered_discount_num:m"
    ),
    "d22_channel_comparison": (
        "sales_channel:k revenue:m avg_discount_pct:r avg_margin_proxy_pct:r"
    ),
    "d23_revenue_by_bucket": "bucket_order:i discount_bucket:k revenue:m",
    "d24_margin_by_bucket": "bucket_order:i discount_bucket:k margin_proxy_pct:r",
    "d25_discount_ladders": (
        "dimension:k value:k weighted_discount_pct:r margin_proxy_pct:r revenue:m"
    ),
    "d26_annual_value": (
        "order_year:i revenue:m list_revenue:m revenue_forgone:m gross_margin_value:m"
        " high_discount_revenue:m order_items:i price_realization:r weighted_discount_pct:r"
        " margin_proxy_pct:r high_discount_revenue_share:r"
    ),
    "d27_segment_value_pool": f"segment:k {_VALUE_POOL}",
    "d27_channel_value_pool": f"sales_channel:k {_VALUE_POOL}",
    "d28_tier_detail": (
        "risk_tier:k customers:i revenue:m avg_discount_pct:r avg_margin_proxy_pct:r"
        " revenue_high_discount_share:r avg_priority:r revenue_share:r"
    ),
    "d29_tenure_cohort": (
        "tenure_band:k avg_discount_pct:r avg_margin_proxy_pct:r customers:i"
    ),
    "d30_portfolio_counts": (
        "n_order_items:i n_customers:i n_products:i n_months:i n_segments:i n_channels:i"
        " n_regions:i n_categories:i high_tier_customers:i high_tier_revenue:m"
        " high_tier_avg_priority:r"
    ),
    "d30_realization_range": "pr_min:r pr_max:r pr_mean:r",
    "d31_weighted_average": "segment:k weighted_discount:r weighted_margin:r",
    "d32_filter_options": "filter:k option:k position:i",
    "d32_coverage": "coverage_start:k coverage_end:k pricing_rows:i customers:i",
    "e1_peer_residual": (
        "order_item_id:k product_id:k sales_channel:k price_realization_residual_pct:r"
        " abs_price_realization_residual_pct:r"
    ),
    "e2_previous_order": (
        "customer_id:i order_id:i order_date:d high_discount_order:i"
        " previous_high_discount_order:i"
    ),
    "e3_percentile_score": (
        "customer_id:i rel_depth:r rel_residual:r rel_order_share:r rel_revenue_share:r"
        " rel_repeat:r rel_margin:r"
    ),
    "e4_percent_rank": (
        "product_id:k avg_discount_rank:r high_share_rank:r low_margin_rank:r"
    ),
    "e5_rep_peer_zscore": (
        "sales_rep_id:i team:k rep_region:k avg_discount_pct:r peer_avg_discount:r"
        " peer_discount_std:r discount_zscore_vs_peers:r discount_outlier_flag:b"
    ),
    "e6_revenue_concentration": (
        "customer_id:i customer_rank:i customer_share:r cumulative_revenue_share:r"
    ),
    "e6_top_revenue_shares": "top10_rev_share:r top20_rev_share:r",
    "e7_month_over_month": "order_month:k weighted_discount_pct:r delta_pts:r",
    "e8_period_growth": (
        "start_year:i end_year:i start_revenue:m end_revenue:m growth_pct:r"
    ),
    "f1_ordered_lines": "order_item_id:k order_id:i order_date:d line_revenue:m",
    "f2_top_decile": "customer_id:i position:i revenue_high_discount_share:r total_revenue:m",
    "f3_review_queue": "customer_id:i risk_tier:k governance_priority_score:r",
    "f4_top_products": (
        "product_id:k product_name:k revenue:m high_discount_share:r deep_discount:b"
    ),
    "f5_top_dependence": (
        "product_id:k product_name:k category:k revenue:m high_discount_revenue_share:r"
        " dependence_score:r"
    ),
    "f6_top_values": "column_name:k value:k count:i share:r",
    "f7_queue_preview": _QUEUE,
    "f8_collapsed_tail": "label:k value:m",
    "f9_queue_table": _ACCOUNT,
    "g1_union_dedupe": f"{_SCOPE_DIMS} net_revenue:m margin_at_risk:m",
    "g2_month_gaps": "expected_months:i observed_months:i missing_months:i",
    "g3_month_by_flag": (
        "order_month:d standard_discount_revenue:m high_discount_revenue:m"
    ),
    "g4_segment_channel_heatmap": (
        "segment:k 1-URGENT:r 2-HIGH:r 3-MEDIUM:r 4-NOT SPECIFIED:r 5-LOW:r"
    ),
    "g5_bridge": "step_order:i step:k kind:k value:m",
    "g6_distinct_keys": "mart:k rows:i distinct_keys:i",
    "h1_correlation": "correlation:r",
    "h2_regression": "slope:r intercept:r",
    "h3_discount_quantiles": "median_discount:r p90_discount:r",
    "h3_score_quantile": "p90_priority:r customers_at_or_above:i",
    "h4_discount_histogram45": "bin:i lower:r upper:r rows:i",
    "h4_discount_histogram40": "bin:i lower:r upper:r rows:i",
    "h4_priority_histogram40": "bin:i lower:r upper:r rows:i",
    "h5_price_density": "x_bin:i y_bin:i rows:i",
    "h6_distribution_label": "median_discount:r p90_discount:r distribution:k",
    "h7_score_variances": (
        "governance_score_variance:r share_orders_high_discount_variance:r"
    ),
    "i1_scale_excess": (
        "customer_id:i abs_depth:r abs_residual:r abs_order_share:r abs_revenue_share:r"
        " abs_repeat:r"
    ),
    "i2_scale_shortfall": "customer_id:i abs_margin:r",
    "i3_reliability": "customer_id:i score_reliability_weight:r low_data_flag:i shrunk_pricing:r",
    "i4_components": (
        "customer_id:i raw_pricing_risk_score:r raw_discount_dependency_score:r"
        " raw_margin_erosion_score:r"
    ),
    "i5_priority": f"customer_id:i {_SCORES} score_reliability_weight:r",
    "i6_risk_tier": "customer_id:i governance_priority_score:r risk_tier:k",
    "i7_main_driver": (
        "customer_id:i pricing_risk_score:r discount_dependency_score:r margin_erosion_score:r"
        " main_risk_driver:k"
    ),
    "i8_recommended_action": (
        "customer_id:i risk_tier:k main_risk_driver:k recommended_action:k"
    ),
    "i9_risk_scores": (
        "customer_id:i segment:k region:k company_size:k total_orders:i total_revenue:m"
        " avg_discount_pct:r weighted_discount_pct:r share_orders_discounted:r"
        " share_orders_high_discount:r revenue_high_discount_share:r avg_margin_proxy_pct:r"
        f" {_SCORES} score_reliability_weight:r low_data_flag:i risk_tier:k"
        " main_risk_driver:k recommended_action:k"
    ),
    "j1_health_verdict": (
        "weighted_realized_discount:r high_discount_revenue_share:r margin_proxy_pct:r"
        " verdict:k reason:k"
    ),
    "j2_threshold_sensitivity": (
        "high_discount_threshold:r high_discount_revenue_share:r"
        " high_discount_order_item_share:r margin_proxy_pct_on_high_discount:r"
        " customer_share_above_policy_high_discount_revenue_threshold:r"
        " revenue_with_margin_at_risk:m"
    ),
    "j3_action_queue": _QUEUE,
    "j4_customer_dependency": (
        "customer_id:i segment:k total_revenue:m revenue_high_discount_share:r"
        " high_discount_revenue_value:m"
    ),
    "j5_dependency_concentration": (
        "top_decile_customers:i revenue_share_of_top_dependency_decile:r"
        " avg_repeat_discount_behavior:r avg_share_orders_discounted:r"
    ),
    "j6_margin_erosion": (
        "segment:k category:k revenue:m list_revenue:m gross_margin_value:m avg_discount_pct:r"
        " high_discount_share:r order_lines:i margin_proxy_pct:r discount_leakage_value:m"
        " margin_erosion_risk_score:r"
    ),
    "j7_rep_inconsistency": (
        "sales_rep_id:i team:k rep_region:k revenue:m order_lines:i avg_discount_pct:r"
        " discount_std:r avg_margin_proxy_pct:r peer_avg_discount:r peer_discount_std:r"
        " discount_zscore_vs_peers:r discount_outlier_flag:b"
    ),
    "j8_product_patterns": (
        "product_id:k product_name:k category:k revenue:m list_revenue:m order_lines:i"
        " avg_discount_pct:r high_discount_share:r price_realization:r avg_margin_proxy_pct:r"
        " pricing_pattern:k governance_concern_score:r"
    ),
    "j9_recommendations": "rule_order:i rule:k fired:b",
    "j10_recovery_scenarios": (
        "realization_improvement_pp:i revenue_capture_on_analysis_base:m"
        " new_price_realization:r"
    ),
    "j11_run_rate": (
        "two_point_capture:m analysis_years:r two_point_annual_run_rate:m shallowest_region:k"
        " deepest_region:k region_discount_range:r"
    ),
    "j12_intervention_queue": (
        "customer_id:i segment:k region:k total_revenue:m avg_discount_pct:r"
        " revenue_high_discount_share:r share_orders_high_discount:r repeat_discount_behavior:r"
    ),
    "j13_reconciliation": (
        "base_revenue:m segment_revenue:m monthly_revenue:m segment_agrees:b monthly_agrees:b"
    ),
    "j14_product_dependence": (
        "product_id:k product_name:k category:k revenue:m avg_discount_pct:r"
        " high_discount_share:r price_realization:r"
    ),
    "j15_cell_spotlight": (
        "segment:k sales_channel:k revenue:m avg_discount_pct:r high_discount_share:r"
        " order_item_count:i avg_margin_proxy_pct:r"
    ),
    "j16_monthly_trend": (
        "order_month:d revenue:m weighted_discount_pct:r margin_proxy_pct:r"
        " high_discount_share:r"
    ),
    "j17_pressure_map": (
        "segment:k sales_channel:k revenue:m avg_discount_pct:r avg_margin_proxy_pct:r"
        " high_discount_share:r"
    ),
    "k1_column_types": "table_name:k column_name:k column_type:k dtype:k",
    "k2_column_profile": (
        "table_name:k column_name:k column_type:k dtype:k null_rate:r distinct_count:i"
        " cardinality_ratio:r"
    ),
    "k3_table_summary": (
        "table_name:k grain:k primary_key:k foreign_keys:k row_count:i column_count:i"
        " date_coverage_start:k date_coverage_end:k duplicate_rows_on_primary_key:i"
    ),
    "k4_top_values": "table_name:k column_name:k value:k count:i share:r",
    "k5_numeric_summary": (
        "table_name:k column_name:k count:i mean:m std:m min:m p05:m median:m p95:m max:m"
        " zero_share:r negative_share:r"
    ),
    "k6_column_issues": "table_name:k column_name:k severity:k issue_type:k detail:k",
    "k7_join_counts": "table_name:k column_name:k parent:k missing_rows:i",
    "k8_population_coverage": (
        "total_customers_raw:i transacting_customers:i profiled_customers:i scored_customers:i"
        " excluded_non_transacting_customers:i excluded_non_transacting_share:r"
        " transacting_not_profiled_customers:i profiled_not_scored_customers:i"
    ),
    "k9_ranked_issues": (
        "severity_rank:i table_name:k column_name:k severity:k issue_type:k detail:k"
    ),
    "m1_raw_structure": _CHECK,
    "m2_raw_integrity": _CHECK,
    "m2_file_integrity": _CHECK,
    "m3_raw_pricing_rules": _CHECK,
    "m4_processed_checks": _CHECK,
    "m5_metric_contracts": "contract_table:k check_name:k status:k severity:k detail:k",
    "m6_warehouse_checks": _RULE,
    "m7_analysis_checks": _RULE,
    "m8_review_checks": _REVIEW,
    "m9_cross_output": _REVIEW,
    "m10_readiness": (
        "failed_checks:i failed_blocker_checks:i failed_technical_checks:i"
        " failed_analytical_checks:i technically_valid:b analytically_acceptable:b"
        " decision_support_only:b publish_blocked:b release_readiness_state:k"
    ),
    "m11_exclusions": "excluded_customers:i excluded_customer_pct:r severity:k",
    "m12_release_gate": "rule_name:k status:k detail:k",
    "m13_status_reports": _REVIEW,
    "n1_scoped_kpi": f"scope:k {_KPI}",
    "n2_revenue_coverage": "scope:k net_revenue:m period_revenue:m revenue_coverage_share:r",
    "n3_scoped_accounts": _ACCOUNT,
    "n4_posture": "scope:k posture:k posture_label:k",
    "n5_indicator_levels": (
        "scope:k weighted_discount_pct:r margin_risk_share:r high_risk_count:i"
        " weighted_discount_pct_level:k margin_risk_share_level:k high_risk_count_level:k"
    ),
    "n6_scoped_trend": "order_month:k weighted_discount_pct:r delta_pts:r",
    "n7_segment_ranking": "segment:k weighted_discount_points:r",
    "n8_region_ranking": "region:k margin_at_risk:m",
    "n9_action_revenue": "recommended_action:k filtered_revenue:m is_top:b",
    "n9_driver_revenue": "main_risk_driver:k filtered_revenue:m is_top:b",
    "n9_action_chart": "label:k value:m",
}


def columns_of(name: str) -> list[tuple[str, str]]:
    """(column, kind) pairs; column names may hold blanks, kinds are one letter."""
    pairs, words = [], []
    for word in COLUMNS[name].split(" "):
        words.append(word)
        if len(word) > 2 and word[-2] == ":":
            pairs.append((" ".join(words)[:-2], word[-1]))
            words = []
    return pairs


def publish(name: str, table: DataFrame) -> DataFrame:
    """Select and cast a query's columns for publication; the row order is kept."""
    return table.select(*[_published(c, kind).alias(c) for c, kind in columns_of(name)])


def _published(name: str, kind: str) -> Column:
    value = F.col(f"`{name}`")
    if kind == "i":
        return value.cast("bigint")
    if kind == "b":
        return value.cast("boolean")
    if kind == "d":
        return F.date_format(value, "yyyy-MM-dd")
    if kind in "mr":
        digits = MONEY_DIGITS if kind == "m" else RATIO_DIGITS
        return F.round(value.cast("double"), digits) + F.lit(0.0)
    return value.cast("string")


def published_sql(name: str, body: str) -> str:
    """The same publication for a SQL query over the columns of ``body``."""
    items = []
    for column, kind in columns_of(name):
        quoted = f'"{column}"'
        digits = MONEY_DIGITS if kind == "m" else RATIO_DIGITS
        items.append(
            {
                "i": f"CAST({quoted} AS BIGINT)",
                "b": f"CAST({quoted} AS BOOLEAN)",
                "d": f"strftime({quoted}, '%Y-%m-%d')",
                "m": f"round(CAST({quoted} AS DOUBLE), {digits}) + 0.0::DOUBLE",
                "r": f"round(CAST({quoted} AS DOUBLE), {digits}) + 0.0::DOUBLE",
                "k": f"CAST({quoted} AS VARCHAR)",
            }[kind]
            + f" AS {quoted}"
        )
    return f"SELECT {', '.join(items)} FROM ({body}) AS published"
