"""Expected results of the registered queries as SQL over the supplied tables.

``COMMON`` holds named building blocks; a query gets those it refers to, and what they
refer to, as a WITH clause. The SQL is written on its own, not generated from the plans.
"""

from __future__ import annotations

import re

from pricelens.registry import oracle_tables as tables
from pricelens.registry.shape import published_sql

_STORED = (
    "total_revenue avg_discount_pct weighted_discount_pct share_order_items_discounted"
    " avg_margin_proxy_pct realized_price_cv avg_abs_price_realization_residual_pct"
    " revenue_high_discount_share share_orders_discounted share_orders_high_discount"
    " repeat_discount_behavior"
).split()

COMMON = {
    "raw_customers": """
        SELECT c.c_custkey AS customer_id,
               CAST(coalesce(first_order, DATE '1995-01-01')
                    - CAST(c.c_custkey % 1461 AS INTEGER) AS DATE) AS signup_date,
               c.c_mktsegment AS segment, r.r_name AS region,
               CASE WHEN c.c_acctbal < 1000 THEN 'Small' WHEN c.c_acctbal < 4000 THEN 'Medium'
                    WHEN c.c_acctbal < 7500 THEN 'Large' ELSE 'Enterprise' END AS company_size
        FROM customer c
        JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey
        LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_order
                   FROM orders GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey""",
    "raw_products": """
        SELECT product_id, product_name, category, cents / 100.0::DOUBLE AS list_price,
               ((2 * cents * pct + 100) // 200) / 100.0::DOUBLE AS unit_cost
        FROM (SELECT concat_ws('/', p_brand, p_type) AS product_id,
                     concat_ws(' ', p_brand, p_type) AS product_name, p_type AS category,
                     (2 * CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT)
                      + count(*)) // (2 * count(*)) AS cents,
                     CASE p_type WHEN 'ECONOMY' THEN 45 WHEN 'STANDARD' THEN 50
                                 WHEN 'SMALL' THEN 50 WHEN 'MEDIUM' THEN 55
                                 WHEN 'LARGE' THEN 60 ELSE 65 END AS pct
              FROM part GROUP BY p_brand, p_type)""",
    "raw_sales_reps": """
        SELECT s_suppkey AS sales_rep_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'New Business' WHEN 1 THEN 'Expansion'
                                  ELSE 'Channel' END AS team,
               r_name AS rep_region
        FROM supplier JOIN nation ON n_nationkey = s_nationkey
                      JOIN region ON r_regionkey = n_regionkey""",
    "raw_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS sales_channel,
               o_orderkey % (SELECT count(*) FROM supplier) AS sales_rep_id
        FROM orders""",
    "raw_order_items": """
        SELECT order_item_id, order_id, product_id, quantity, price AS list_price_at_sale,
               price * (1.0::DOUBLE - depth) AS realized_unit_price, depth AS discount_pct
        FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                               CAST(l_quantity AS BIGINT),
                               CAST(round(l_extendedprice * 100) AS BIGINT)) AS order_item_id,
                     l_orderkey AS order_id, concat_ws('/', p_brand, p_type) AS product_id,
                     CAST(l_quantity AS BIGINT) AS quantity, p_retailprice AS price,
                     round_even(l_discount * 4 * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS depth
              FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "faults": """
        SELECT 'order_items' AS table_name, order_item_id AS row_key, 1 AS fault,
               'quantity' AS column_name, quantity || ' pcs' AS value
        FROM raw_order_items WHERE quantity >= 45
        UNION ALL SELECT 'order_items', order_item_id, 2, 'discount_pct',
               'about ' || CAST(round(discount_pct * 100) AS INTEGER)
        FROM raw_order_items WHERE quantity = 50
        UNION ALL SELECT 'orders', CAST(order_id AS VARCHAR), 1, 'order_date',
               strftime(order_date, '%d.%m.%Y') FROM raw_orders WHERE day(order_date) = 31
        UNION ALL SELECT 'products', product_id, 1, 'unit_cost', 'n/a'
        FROM raw_products WHERE category = 'ECONOMY'""",
    "held_rows": """
        SELECT table_name, row_count, (SELECT count(*) FROM faults f
               WHERE f.table_name = t.table_name AND fault = 1) AS held
        FROM (SELECT 'customers' AS table_name, count(*) AS row_count FROM raw_customers
              UNION ALL SELECT 'products', count(*) FROM raw_products
              UNION ALL SELECT 'sales_reps', count(*) FROM raw_sales_reps
              UNION ALL SELECT 'orders', count(*) FROM raw_orders
              UNION ALL SELECT 'order_items', count(*) FROM raw_order_items) t""",
    "enriched": """
        SELECT i.*, o.customer_id, o.order_date, o.sales_channel, o.sales_rep_id,
               c.signup_date, c.segment, c.region, c.company_size,
               p.product_name, p.category, p.list_price, p.unit_cost, s.team, s.rep_region,
               date_diff('day', c.signup_date, o.order_date) AS days_since_signup
        FROM raw_order_items i
        JOIN raw_orders o USING (order_id)
        JOIN raw_customers c ON c.customer_id = o.customer_id
        JOIN raw_products p ON p.product_id = i.product_id
        LEFT JOIN raw_sales_reps s ON s.sales_rep_id = o.sales_rep_id""",
    "priced": """
        SELECT e.*, realized_unit_price AS realized_price, discount_pct AS depth,
               quantity * list_price_at_sale AS listed, quantity * realized_unit_price AS net,
               quantity * unit_cost AS cost,
               quantity * realized_unit_price - quantity * unit_cost AS gm,
               CASE WHEN list_price_at_sale > 0 THEN realized_unit_price / list_price_at_sale
               END AS realization,
               CASE WHEN discount_pct >= 0.20::DOUBLE THEN 1 ELSE 0 END AS high,
               CASE WHEN discount_pct >= 0.05::DOUBLE THEN 1 ELSE 0 END AS discounted,
               CAST(date_trunc('month', order_date) AS DATE) AS order_month
        FROM enriched e""",
    "lines": """
        SELECT p.*, b.peer, CASE WHEN net > 0 THEN gm / net END AS margin_pct,
               CASE WHEN b.peer > 0 THEN (realization - b.peer) / b.peer ELSE 0 END AS residual,
               CASE WHEN high = 1 AND net > 0 AND gm / net < 0.35::DOUBLE THEN net
                    ELSE 0 END AS exposed,
               CASE WHEN high = 1 THEN net ELSE 0 END AS high_net
        FROM priced p
        LEFT JOIN (SELECT product_id, sales_channel,
                          round_even(avg(realization) * (2.0::DOUBLE ^ 40), 0)
                              / (2.0::DOUBLE ^ 40) AS peer
                   FROM priced GROUP BY product_id, sales_channel) b
          ON b.product_id = p.product_id AND b.sales_channel = p.sales_channel""",
    "ledger": """
        SELECT customer_id, order_id, order_date, sum(net) AS order_revenue,
               avg(depth) AS order_discount_depth, max(high) AS high_discount_order,
               max(discounted) AS discounted_order
        FROM lines GROUP BY customer_id, order_id, order_date""",
    "sequence": """
        SELECT *, lag(high_discount_order, 1, 0) OVER (
                      PARTITION BY customer_id ORDER BY order_date, order_id
                  ) AS previous_high_discount_order
        FROM ledger""",
    "order_stats": """
        SELECT customer_id, count(*) AS total_orders,
               avg(discounted_order) AS share_orders_discounted,
               avg(high_discount_order) AS share_orders_high_discount,
               sum(high_discount_order * previous_high_discount_order)
                   / greatest(count(*) - 1, 1) AS repeat_discount_behavior
        FROM sequence GROUP BY customer_id""",
    "profile_sums": """
        SELECT l.*, o.* EXCLUDE (customer_id)
        FROM (SELECT customer_id, min(segment) AS segment, min(region) AS region,
                     min(company_size) AS company_size, count(*) AS total_order_items,
                     sum(net) AS total_revenue, avg(depth) AS avg_discount_pct,
                     coalesce(sum(depth * listed) / nullif(sum(listed), 0), 0)
                         AS weighted_discount_pct,
                     avg(discounted) AS share_order_items_discounted,
                     count(DISTINCT product_id) AS product_diversity,
                     coalesce(sum(gm) / nullif(sum(net), 0), 0) AS avg_margin_proxy_pct,
                     coalesce(stddev_pop(realized_price) / nullif(avg(realized_price), 0), 0)
                         AS realized_price_cv,
                     avg(abs(residual)) AS avg_abs_price_realization_residual_pct,
                     coalesce(sum(high_net) / nullif(sum(net), 0), 0)
                         AS revenue_high_discount_share
              FROM lines GROUP BY customer_id) l
        LEFT JOIN order_stats o USING (customer_id)""",
    # Stored on a binary grid.
    "profile": "SELECT * REPLACE ("
    + ", ".join(
        f"round_even({name} * (2.0::DOUBLE ^ 40), 0) / (2.0::DOUBLE ^ 40) AS {name}"
        for name in _STORED
    )
    + ") FROM profile_sums",
    "signal_values": """
        SELECT customer_id,
               unnest(['depth', 'residual', 'order_share', 'revenue_share', 'repeat', 'margin'])
                   AS signal,
               unnest([weighted_discount_pct, avg_abs_price_realization_residual_pct,
                       share_orders_high_discount, revenue_high_discount_share,
                       repeat_discount_behavior, avg_margin_proxy_pct]) AS raw
        FROM profile""",
    "signal_ranks": """
        SELECT customer_id, signal, raw,
               (rank() OVER (PARTITION BY signal ORDER BY v) - 1
                + (count(*) OVER (PARTITION BY signal, v) + 1) / 2.0::DOUBLE)
                   / count(*) OVER (PARTITION BY signal) AS pct,
               min(v) OVER (PARTITION BY signal) = max(v) OVER (PARTITION BY signal) AS flat
        FROM (SELECT *, round_even(raw * 1e12::DOUBLE, 0) / 1e12::DOUBLE AS v
              FROM signal_values)""",
    "signals": """
        SELECT customer_id,
               max(rel) FILTER (signal = 'depth') AS rel_depth,
               max(rel) FILTER (signal = 'residual') AS rel_residual,
               max(rel) FILTER (signal = 'order_share') AS rel_order_share,
               max(rel) FILTER (signal = 'revenue_share') AS rel_revenue_share,
               max(rel) FILTER (signal = 'repeat') AS rel_repeat,
               max(rel) FILTER (signal = 'margin') AS rel_margin,
               max(breach) FILTER (signal = 'depth') AS abs_depth,
               max(breach) FILTER (signal = 'residual') AS abs_residual,
               max(breach) FILTER (signal = 'order_share') AS abs_order_share,
               max(breach) FILTER (signal = 'revenue_share') AS abs_revenue_share,
               max(breach) FILTER (signal = 'repeat') AS abs_repeat,
               max(breach) FILTER (signal = 'margin') AS abs_margin
        FROM (SELECT r.*,
                     CASE WHEN flat THEN 50.0::DOUBLE
                          WHEN signal = 'margin' THEN (1 - pct) * 100 ELSE pct * 100 END AS rel,
                     least(greatest((raw - edge) * sign, 0) / span * 100, 100) AS breach
              FROM signal_ranks r
              JOIN (VALUES ('depth', 0.18::DOUBLE, 0.20::DOUBLE, 1),
                           ('residual', 0.075::DOUBLE, 0.125::DOUBLE, 1),
                           ('order_share', 0.35::DOUBLE, 0.65::DOUBLE, 1),
                           ('revenue_share', 0.40::DOUBLE, 0.60::DOUBLE, 1),
                           ('repeat', 0.20::DOUBLE, 0.80::DOUBLE, 1),
                           ('margin', 0.38::DOUBLE, 0.38::DOUBLE, -1)
                   ) AS limits(signal, edge, span, sign) USING (signal))
        GROUP BY customer_id""",
    "raw_scores": """
        SELECT p.*, s.* EXCLUDE (customer_id),
               least(p.total_orders / 6.0::DOUBLE, 1.0::DOUBLE) AS weight,
               0.60::DOUBLE * (0.50::DOUBLE * rel_depth + 0.30::DOUBLE * rel_residual
                               + 0.20::DOUBLE * rel_order_share)
               + 0.40::DOUBLE * (0.45::DOUBLE * abs_depth + 0.30::DOUBLE * abs_residual
                                 + 0.25::DOUBLE * abs_order_share) AS raw_pricing,
               0.55::DOUBLE * (0.45::DOUBLE * rel_revenue_share + 0.35::DOUBLE * rel_repeat
                               + 0.20::DOUBLE * rel_order_share)
               + 0.45::DOUBLE * (0.45::DOUBLE * abs_revenue_share + 0.30::DOUBLE * abs_repeat
                                 + 0.25::DOUBLE * abs_order_share) AS raw_dependency,
               0.50::DOUBLE * (0.55::DOUBLE * rel_margin + 0.30::DOUBLE * rel_depth
                               + 0.15::DOUBLE * rel_revenue_share)
               + 0.50::DOUBLE * (0.55::DOUBLE * abs_margin + 0.25::DOUBLE * abs_depth
                                 + 0.20::DOUBLE * abs_revenue_share) AS raw_margin
        FROM profile p JOIN signals s USING (customer_id)""",
    "shrunk": """
        SELECT *, weight * raw_pricing + (1 - weight) * 50 AS s1,
               weight * raw_dependency + (1 - weight) * 50 AS s2,
               weight * raw_margin + (1 - weight) * 50 AS s3
        FROM raw_scores""",
    "rounded_scores": """
        SELECT *, round_even(s1 * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS pricing_risk_score,
               round_even(s2 * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS discount_dependency_score,
               round_even(s3 * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS margin_erosion_score,
               round_even((0.40::DOUBLE * s1 + 0.35::DOUBLE * s2 + 0.25::DOUBLE * s3)
                          * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS governance_priority_score,
               round_even(weight * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS score_reliability_weight,
               CASE WHEN total_orders < 6 THEN 1 ELSE 0 END AS low_data_flag
        FROM shrunk""",
    "labelled_scores": """
        SELECT *,
               CASE WHEN governance_priority_score >= 80 THEN 'Critical'
                    WHEN governance_priority_score >= 65 THEN 'High'
                    WHEN governance_priority_score >= 45 THEN 'Medium' ELSE 'Low' END AS risk_tier,
               CASE WHEN pricing_risk_score >= discount_dependency_score
                         AND pricing_risk_score >= margin_erosion_score THEN 'pricing_risk_score'
                    WHEN discount_dependency_score >= margin_erosion_score
                         THEN 'discount_dependency_score'
                    ELSE 'margin_erosion_score' END AS main_risk_driver
        FROM rounded_scores""",
    "scores": """
        SELECT *,
               CASE WHEN risk_tier = 'Low' THEN 'monitor only'
                    WHEN risk_tier = 'Medium' THEN 'review segment pricing'
                    WHEN main_risk_driver = 'pricing_risk_score' THEN 'review pricing variance'
                    WHEN main_risk_driver = 'discount_dependency_score'
                         THEN 'review discount terms'
                    ELSE 'review margin guardrails' END AS recommended_action
        FROM labelled_scores""",
    "queue": """
        SELECT * EXCLUDE (place) FROM (
            SELECT s.*, row_number() OVER (
                       ORDER BY CASE WHEN risk_tier IN ('Critical', 'High') THEN 0 ELSE 1 END,
                                governance_priority_score DESC, customer_id) AS place
            FROM scores s)
        WHERE risk_tier IN ('Critical', 'High') OR place <= 140""",
    "leakage": """
        SELECT customer_id, sum(net) AS revenue_in_scope,
               sum(high_net) AS high_discount_revenue, sum(exposed) AS margin_at_risk_revenue,
               sum(listed - net) AS discount_leakage_value
        FROM lines GROUP BY customer_id""",
    "action_queue": """
        SELECT s.*, l.revenue_in_scope, l.high_discount_revenue, l.margin_at_risk_revenue,
               l.discount_leakage_value,
               s.governance_priority_score / 100 * l.margin_at_risk_revenue
                   AS priority_value_proxy
        FROM scores s JOIN leakage l USING (customer_id)""",
    "overall": """
        SELECT max(order_date) AS as_of_date, sum(net) AS total_revenue,
               sum(listed) AS total_list_revenue, sum(gm) AS total_margin_proxy_value,
               avg(depth) AS avg_realized_discount,
               1 - sum(net) / sum(listed) AS weighted_realized_discount,
               sum(high_net) / sum(net) AS high_discount_revenue_share,
               sum(net) / sum(listed) AS price_realization,
               sum(gm) / sum(net) AS margin_proxy_pct
        FROM lines""",
    "monthly": """
        SELECT order_month, sum(net) AS revenue, sum(listed) AS list_revenue,
               sum(gm) AS gross_margin_value, avg(depth) AS avg_discount_pct,
               avg(high) AS high_discount_share,
               1 - sum(net) / sum(listed) AS weighted_discount_pct,
               sum(gm) / sum(net) AS margin_proxy_pct
        FROM lines GROUP BY order_month""",
    "yearly": """
        SELECT year(order_date) AS year, sum(net) AS revenue, sum(listed) AS list_revenue,
               sum(gm) AS margin_proxy_value, avg(depth) AS avg_realized_discount,
               sum(high_net) AS high_discount_revenue,
               sum(net) / sum(listed) AS price_realization,
               1 - sum(net) / sum(listed) AS weighted_discount,
               sum(gm) / sum(net) AS margin_proxy_pct,
               sum(high_net) / sum(net) AS high_discount_revenue_share, count(*) AS order_items
        FROM lines GROUP BY year(order_date)""",
    "products": """
        SELECT product_id, min(product_name) AS product_name, min(category) AS category,
               sum(net) AS revenue, sum(listed) AS list_revenue, avg(depth) AS avg_discount_pct,
               sum(gm) / sum(net) AS avg_margin_proxy_pct, avg(high) AS high_discount_share,
               count(*) AS order_item_count, sum(net) / sum(listed) AS price_realization,
               sum(high_net) AS high_discount_revenue,
               sum(high_net) / sum(net) AS high_discount_revenue_share,
               sum(high_net) / sum(net) * ln(1 + sum(net)) AS dependence_score
        FROM lines GROUP BY product_id""",
    "segments": """
        SELECT segment, sum(net) AS total_revenue, avg(depth) AS avg_discount_pct,
               median(depth) AS median_discount_pct, avg(high) AS share_high_discount,
               sum(gm) / sum(net) AS avg_margin_proxy_pct,
               var_pop(realized_price) AS pop_variance, stddev_pop(realized_price) AS pop_std,
               var_samp(realized_price) AS realized_price_variance,
               stddev_samp(realized_price) AS realized_price_std,
               stddev_samp(residual) AS price_realization_residual_std,
               avg(abs(residual)) AS price_realization_residual_abs_mean,
               (1 - greatest(least(sum(gm) / sum(net), 1), 0)) * avg(high) * 100
                   AS margin_erosion_proxy
        FROM lines GROUP BY segment""",
    "segment_channel": """
        SELECT segment, sales_channel, sum(net) AS revenue, avg(depth) AS avg_discount_pct,
               avg(high) AS high_discount_share, count(*) AS order_item_count,
               sum(gm) / sum(net) AS avg_margin_proxy_pct
        FROM lines GROUP BY segment, sales_channel""",
    "segment_dependency": """
        SELECT segment, sum(net) AS revenue, avg(depth) AS avg_discount_pct,
               sum(high_net) AS high_discount_revenue, any_value(r) AS repeat_discount_behavior,
               sum(high_net) / sum(net) AS high_discount_revenue_share,
               sum(gm) / sum(net) AS avg_margin_proxy_pct
        FROM lines JOIN (SELECT segment, avg(repeat_discount_behavior) AS r
                         FROM profile GROUP BY segment) USING (segment)
        GROUP BY segment""",
    "reps": """
        SELECT sales_rep_id, team, rep_region, sum(net) AS revenue, count(*) AS order_lines,
               avg(depth) AS avg_discount_pct, stddev_samp(depth) AS discount_std,
               sum(gm) / sum(net) AS avg_margin_proxy_pct
        FROM lines GROUP BY sales_rep_id, team, rep_region HAVING count(*) >= 120""",
    "rep_scores": """
        SELECT *, abs(discount_zscore_vs_peers) >= 2 AS discount_outlier_flag
        FROM (SELECT *, coalesce((avg_discount_pct - peer_avg_discount) / peer_discount_std, 0)
                            AS discount_zscore_vs_peers
              FROM (SELECT *, avg(avg_discount_pct) OVER peers AS peer_avg_discount,
                           nullif(stddev_samp(avg_discount_pct) OVER peers, 0)
                               AS peer_discount_std
                    FROM reps WINDOW peers AS (PARTITION BY team, rep_region)))""",
    "erosion_base": """
        SELECT segment, category, sum(net) AS revenue, sum(listed) AS list_revenue,
               sum(gm) AS gross_margin_value, avg(depth) AS avg_discount_pct,
               avg(high) AS high_discount_share, count(*) AS order_lines,
               sum(gm) / sum(net) AS margin_proxy_pct,
               sum(listed) - sum(net) AS discount_leakage_value
        FROM lines GROUP BY segment, category""",
    "erosion_ranks": """
        SELECT *, (rank() OVER (ORDER BY a) - 1 + (count(*) OVER (PARTITION BY a) + 1) / 2.0)
                      / count(*) OVER () AS r1,
               (rank() OVER (ORDER BY b) - 1 + (count(*) OVER (PARTITION BY b) + 1) / 2.0)
                      / count(*) OVER () AS r2,
               (rank() OVER (ORDER BY c) - 1 + (count(*) OVER (PARTITION BY c) + 1) / 2.0)
                      / count(*) OVER () AS r3
        FROM (SELECT *, round_even(avg_discount_pct * 1e12::DOUBLE, 0) AS a,
                     round_even(high_discount_share * 1e12::DOUBLE, 0) AS b,
                     round_even(margin_proxy_pct * 1e12::DOUBLE, 0) AS c FROM erosion_base)""",
    "product_ranks": """
        SELECT *, (rank() OVER (ORDER BY a) - 1 + (count(*) OVER (PARTITION BY a) + 1) / 2.0)
                      / count(*) OVER () AS r1,
               (rank() OVER (ORDER BY b) - 1 + (count(*) OVER (PARTITION BY b) + 1) / 2.0)
                      / count(*) OVER () AS r2,
               (rank() OVER (ORDER BY c) - 1 + (count(*) OVER (PARTITION BY c) + 1) / 2.0)
                      / count(*) OVER () AS r3
        FROM (SELECT *, round_even(avg_discount_pct * 1e12::DOUBLE, 0) AS a,
                     round_even(high_discount_share * 1e12::DOUBLE, 0) AS b,
                     round_even(avg_margin_proxy_pct * 1e12::DOUBLE, 0) AS c FROM products)""",
    "patterns": """
        SELECT *, CASE WHEN avg_discount_pct < 0.15 AND high_discount_share < 0.25
                            AND avg_margin_proxy_pct > 0.40 THEN 'Sold cleanly'
                       WHEN high_discount_share >= 0.75 OR avg_discount_pct >= 0.35
                            THEN 'Discount-reliant'
                       WHEN avg_margin_proxy_pct < 0.30 AND avg_discount_pct >= 0.25
                            THEN 'Margin-pressure'
                       ELSE 'Mixed' END AS pricing_pattern,
               100 * (0.40 * r1 + 0.35 * r2 + 0.25 * (1 - r3)) AS governance_concern_score,
               order_item_count AS order_lines
        FROM product_ranks""",
    "curve": """
        SELECT customer_id, revenue_high_discount_share, total_revenue,
               row_number() OVER by_revenue AS customer_rank,
               row_number() OVER by_revenue / count(*) OVER () AS customer_share,
               sum(total_revenue) OVER (ORDER BY total_revenue DESC, customer_id
                   ROWS UNBOUNDED PRECEDING) / sum(total_revenue) OVER ()
                   AS cumulative_revenue_share,
               row_number() OVER (ORDER BY revenue_high_discount_share DESC, total_revenue DESC,
                                  customer_id) - 1 AS position,
               count(*) OVER () AS customers
        FROM profile WINDOW by_revenue AS (ORDER BY total_revenue DESC, customer_id)""",
    "scope_lines": """
        SELECT strftime(order_date, '%Y-%m') AS order_month, customer_id, segment, region,
               category, sales_channel, net, listed, depth * listed AS given, high_net, exposed
        FROM lines""",
    "scopes": """
        SELECT 'open' AS scope, true AS inside, s.* FROM scope_lines s
        UNION ALL
        SELECT 'narrow', segment = 'BUILDING' AND sales_channel = '1-URGENT', s.*
        FROM scope_lines s WHERE order_month BETWEEN '1996-01' AND '1999-12'""",
    "kpis": """
        SELECT scope, sum(net) FILTER (inside) AS net_revenue,
               sum(listed) FILTER (inside) AS list_revenue, sum(given) FILTER (inside) AS leakage,
               sum(exposed) FILTER (inside) AS margin_at_risk, sum(net) AS period_revenue,
               sum(given) FILTER (inside) / sum(listed) FILTER (inside) AS weighted_discount_pct,
               sum(exposed) FILTER (inside) / sum(net) FILTER (inside) AS margin_risk_share,
               sum(net) FILTER (inside) / sum(net) AS revenue_coverage_share
        FROM scopes GROUP BY scope""",
    "accounts": """
        SELECT t.scope, q.*, t.filtered_revenue, t.filtered_avg_discount
        FROM scores q
        JOIN (SELECT scope, customer_id, sum(net) AS filtered_revenue,
                     sum(given) / sum(listed) AS filtered_avg_discount
              FROM scopes WHERE inside GROUP BY scope, customer_id HAVING sum(net) > 0) t
        USING (customer_id)
        WHERE t.scope = 'open' OR q.segment = 'BUILDING'""",
    "indicators": """
        SELECT *, CASE WHEN 'critical' IN (l1, l2, l3) THEN 'critical'
                       WHEN 'warn' IN (l1, l2, l3) THEN 'warn' ELSE 'ok' END AS posture
        FROM (SELECT k.*, n AS high_risk_count,
                     CASE WHEN weighted_discount_pct >= 0.20 THEN 'critical'
                          WHEN weighted_discount_pct >= 0.14 THEN 'warn' ELSE 'ok' END AS l1,
                     CASE WHEN margin_risk_share >= 0.20 THEN 'critical'
                          WHEN margin_risk_share >= 0.12 THEN 'warn' ELSE 'ok' END AS l2,
                     CASE WHEN n >= 80 THEN 'critical' WHEN n >= 35 THEN 'warn'
                          ELSE 'ok' END AS l3
              FROM kpis k
              JOIN (SELECT scope, count(*) FILTER (risk_tier IN ('High', 'Critical')) AS n
                    FROM accounts GROUP BY scope) USING (scope))""",
    "fit": """
        SELECT corr(avg_discount_pct, avg_margin_proxy_pct) AS correlation,
               regr_slope(100 * avg_margin_proxy_pct, 100 * avg_discount_pct) AS slope,
               regr_intercept(100 * avg_margin_proxy_pct, 100 * avg_discount_pct) AS intercept
        FROM profile""",
    "depth_quantiles": """
        SELECT quantile_cont(depth * 100, 0.5) AS median_discount,
               quantile_cont(depth * 100, 0.9) AS p90_discount
        FROM lines""",
    "mart_keys": """
        SELECT 'mart_customer_pricing_profile' AS mart, count(*) AS rows,
               count(DISTINCT customer_id) AS distinct_keys FROM profile
        UNION ALL SELECT 'mart_segment_pricing_summary', count(*), count(DISTINCT segment)
        FROM segments
        UNION ALL SELECT 'mart_product_pricing_summary', count(*), count(DISTINCT product_id)
        FROM products
        UNION ALL SELECT 'mart_monthly_pricing_health', count(*), count(DISTINCT order_month)
        FROM monthly
        UNION ALL SELECT 'mart_overall_pricing_health', count(*), count(DISTINCT as_of_date)
        FROM overall""",
    "links": """
        SELECT 1 AS place, 'order_items' AS child, 'order_id' AS key, 'orders' AS parent,
               count(*) AS missing FROM raw_order_items i
        WHERE NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.order_id = i.order_id)
        UNION ALL
        SELECT 2, 'orders', 'customer_id', 'customers', count(*) FROM raw_orders o
        WHERE NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id)
        UNION ALL
        SELECT 3, 'order_items', 'product_id', 'products', count(*) FROM raw_order_items i
        WHERE NOT EXISTS (SELECT 1 FROM raw_products p WHERE p.product_id = i.product_id)
        UNION ALL
        SELECT 4, 'orders', 'sales_rep_id', 'sales_reps', count(*) FROM raw_orders o
        WHERE NOT EXISTS (SELECT 1 FROM raw_sales_reps s
                          WHERE s.sales_rep_id = o.sales_rep_id)""",
}
COMMON.update(tables.COMMON)


def _histogram(source: str, value: str, cells: int) -> str:
    return f"""
        WITH v AS (SELECT {value} AS x FROM {source}),
             e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {cells} AS w FROM v),
             g AS (SELECT x, lo, w, least(CAST(floor((x - lo) / w) AS BIGINT), {cells - 1}) AS b
                   FROM v, e),
             h AS (SELECT b - CASE WHEN x < lo + b * w THEN 1 ELSE 0 END
                            + CASE WHEN x >= lo + (b + 1) * w AND b < {cells - 1} THEN 1
                                   ELSE 0 END AS bin, count(*) AS rows FROM g GROUP BY 1)
        SELECT r.bin, lo + r.bin * w AS lower, lo + (r.bin + 1) * w AS upper,
               coalesce(h.rows, 0) AS rows
        FROM e, (SELECT unnest(range({cells})) AS bin) r LEFT JOIN h ON h.bin = r.bin"""


def _value_pool(dimension: str) -> str:
    return f"""
        SELECT {dimension}, sum(net) AS revenue, sum(listed) AS list_revenue,
               sum(listed - net) AS revenue_forgone, sum(gm) AS gross_margin_value,
               sum(high_net) AS high_discount_revenue, count(*) AS order_items,
               count(DISTINCT customer_id) AS customers,
               sum(net) / sum(listed) AS price_realization,
               1 - sum(net) / sum(listed) AS weighted_discount_pct,
               sum(gm) / sum(net) AS margin_proxy_pct,
               sum(high_net) / sum(net) AS high_discount_revenue_share,
               sum(listed - net) / (SELECT sum(listed - net) FROM lines)
                   AS share_of_revenue_forgone
        FROM lines GROUP BY {dimension}"""


def _ladder(dimension: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {dimension} AS value,
        (sum(listed) - sum(net)) / sum(listed) AS weighted_discount_pct,
        sum(gm) / sum(net) AS margin_proxy_pct, sum(net) AS revenue
        FROM lines GROUP BY {dimension}"""


def _total(dimension: str | None) -> str:
    dims = ("segment", "region", "category", "sales_channel")
    labels = ", ".join(d if d == dimension else f"'All' AS {d}" for d in dims)
    group = f" GROUP BY {dimension}" if dimension else ""
    return f"SELECT {labels}, sum(net) AS net_revenue, sum(exposed) AS margin_at_risk FROM lines{group}"


def _sensitivity(threshold: str) -> str:
    return f"""
        SELECT {threshold} AS high_discount_threshold,
               sum(net) FILTER (depth >= {threshold}) / sum(net) AS high_discount_revenue_share,
               count(*) FILTER (depth >= {threshold}) / count(*)
                   AS high_discount_order_item_share,
               sum(gm) FILTER (depth >= {threshold}) / sum(net) FILTER (depth >= {threshold})
                   AS margin_proxy_pct_on_high_discount,
               (SELECT avg(CASE WHEN h / t >= 0.40::DOUBLE THEN 1 ELSE 0 END)
                FROM (SELECT sum(CASE WHEN depth >= {threshold} THEN net ELSE 0 END) AS h,
                             sum(net) AS t FROM lines GROUP BY customer_id))
                   AS customer_share_above_policy_high_discount_revenue_threshold,
               sum(net) FILTER (depth >= {threshold} AND margin_pct < 0.35::DOUBLE)
                   AS revenue_with_margin_at_risk
        FROM lines"""


def _trend(scope: str) -> str:
    return f"""
        SELECT order_month, d AS weighted_discount_pct,
               (d - lag(d) OVER (ORDER BY order_month)) * 100 AS delta_pts
        FROM (SELECT order_month, sum(given) / sum(listed) AS d FROM scopes
              WHERE scope = '{scope}' AND inside GROUP BY order_month)"""


def _revenue_by(label: str) -> str:
    return f"""
        SELECT {label}, filtered_revenue,
               row_number() OVER (ORDER BY filtered_revenue DESC, {label} DESC) = 1 AS is_top
        FROM (SELECT {label}, sum(filtered_revenue) AS filtered_revenue
              FROM accounts WHERE scope = 'open' GROUP BY {label})"""


_LINES = "SELECT * FROM lines"
_LINE_AMOUNTS = """SELECT order_item_id, listed AS line_list_revenue, net AS line_revenue,
    cost AS line_cost, gm AS gross_margin_value FROM lines"""

BODIES = {
    "a1_csv_source": "SELECT * FROM raw_orders",
    "a1_csv_customers": "SELECT * FROM raw_customers",
    "a1_csv_products": "SELECT * FROM raw_products",
    "a1_csv_sales_reps": "SELECT *, rep_region AS region FROM raw_sales_reps",
    "a1_csv_order_items": "SELECT * FROM raw_order_items",
    "a2_typed_csv_bundle": "SELECT * FROM raw_customers",
    "a2_typed_csv_products": "SELECT * FROM raw_products",
    "a2_typed_csv_sales_reps": "SELECT *, rep_region AS region FROM raw_sales_reps",
    "a2_typed_csv_orders": "SELECT * FROM raw_orders",
    "a2_typed_csv_order_items": "SELECT * FROM raw_order_items",
    "a2_quarantine": "SELECT * FROM faults",
    "a2_clean_rows": "SELECT table_name, row_count - held AS row_count FROM held_rows",
    "a3_atomic_sink": """SELECT mart AS table_name, format, rows AS row_count
        FROM mart_keys, (VALUES ('csv'), ('parquet')) AS f(format)""",
    "a3_table_sink": """SELECT mart AS table_name, format, rows AS row_count
        FROM mart_keys, (VALUES ('csv'), ('parquet')) AS f(format)""",
    "a4_stg_customers": "SELECT * FROM raw_customers",
    "a4_stg_products": "SELECT * FROM raw_products",
    "a4_stg_orders": "SELECT * FROM raw_orders",
    "a4_stg_order_items": "SELECT * FROM raw_order_items",
    "a4_stg_sales_reps": "SELECT * FROM raw_sales_reps",
    "a5_policy_relation": """SELECT 0.20 AS high_discount_threshold,
        0.05 AS discounted_threshold, sum(high) AS lines_high, sum(discounted) AS lines_discounted
        FROM lines""",
    "a6_json_records": """SELECT to_json({customer_id: customer_id, segment: segment,
        region: region, risk_tier: risk_tier, main_risk_driver: main_risk_driver,
        recommended_action: recommended_action,
        governance_priority_score: governance_priority_score}) AS record FROM scores""",
    "a7_model_run_log": """
        SELECT 'staging' AS layer, 'stg_customers' AS model_name, count(*) AS row_count
        FROM raw_customers
        UNION ALL SELECT 'staging', 'stg_products', count(*) FROM raw_products
        UNION ALL SELECT 'staging', 'stg_orders', count(*) FROM raw_orders
        UNION ALL SELECT 'staging', 'stg_order_items', count(*) FROM raw_order_items
        UNION ALL SELECT 'staging', 'stg_sales_reps', count(*) FROM raw_sales_reps
        UNION ALL SELECT 'intermediate', 'int_order_item_enriched', count(*) FROM enriched
        UNION ALL SELECT 'intermediate', 'int_order_item_pricing_metrics', count(*) FROM lines
        UNION ALL SELECT 'marts', mart, rows FROM mart_keys""",
    "b1_line_financials": _LINE_AMOUNTS,
    "b2_margin_proxy_pct": "SELECT order_item_id, margin_pct AS margin_proxy_pct FROM lines",
    "b3_line_price_realization": """SELECT order_item_id, realization AS line_price_realization
        FROM lines""",
    "b4_discount_bucket": """SELECT order_item_id, depth AS discount_depth,
        CASE WHEN depth <= 0.05 THEN '0-5%' WHEN depth <= 0.10 THEN '5-10%'
             WHEN depth <= 0.20 THEN '10-20%' WHEN depth <= 0.30 THEN '20-30%'
             WHEN depth IS NOT NULL THEN '30%+' END AS discount_bucket FROM lines""",
    "b5_discount_flags": """SELECT order_item_id, high AS high_discount_flag,
        discounted AS discounted_flag FROM lines""",
    "b6_date_parts": """SELECT order_item_id, order_month,
        year(order_date) || '-Q' || quarter(order_date) AS order_quarter,
        year(order_date) AS order_year, strftime(order_date, '%Y-%m') AS month_label
        FROM lines""",
    "b7_days_since_signup": _LINES,
    "b8_discount_scope": """SELECT order_item_id, high_net AS high_discount_revenue,
        exposed AS margin_at_risk_revenue, listed - net AS discount_leakage_value FROM lines""",
    "b9_dashboard_measures": """SELECT order_item_id, depth * listed AS discount_weighted_num,
        high_net AS high_discount_revenue, exposed AS margin_risk_revenue FROM lines""",
    "b10_safe_ratio": """SELECT customer_id,
        sum(gm) FILTER (high = 1) / sum(net) FILTER (high = 1) AS margin_or_null,
        coalesce(sum(gm) FILTER (high = 1) / sum(net) FILTER (high = 1), 0) AS margin_or_zero
        FROM lines GROUP BY customer_id""",
    "b11_rounded_columns": """SELECT segment, sales_channel,
        round_even(revenue * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS revenue,
        round_even(avg_discount_pct * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS avg_discount_pct,
        round_even(high_discount_share * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE
            AS high_discount_share,
        round_even(avg_margin_proxy_pct * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE
            AS avg_margin_proxy_pct
        FROM segment_channel""",
    "b12_tenure_band": "SELECT * FROM tenure",
    "b13_clip": """SELECT customer_id, m AS margin_clipped, s AS share_clipped,
        (1 - m) * s * 100 AS erosion_proxy
        FROM (SELECT customer_id,
                     greatest(least((avg_margin_proxy_pct - 0.2::DOUBLE) * 5, 1), 0) AS m,
                     greatest(least(share_orders_high_discount * 1.25::DOUBLE, 1), 0) AS s
              FROM profile)""",
    "b14_dependence_score": "SELECT * FROM products",
    "b15_null_fill": """SELECT c.customer_id, coalesce(revenue_in_scope, 0) AS revenue_in_scope,
        coalesce(high_discount_revenue, 0) AS high_discount_revenue,
        coalesce(margin_at_risk_revenue, 0) AS margin_at_risk_revenue,
        coalesce(discount_leakage_value, 0) AS discount_leakage_value
        FROM raw_customers c LEFT JOIN leakage USING (customer_id)""",
    "c1_star_join": "SELECT * FROM enriched",
    "c2_join_contract": """SELECT parent AS dimension, key AS join_key, duplicate_keys,
        missing AS unmatched_rows, '' AS examples
        FROM links JOIN (
            SELECT 'orders' AS parent, count(*) - count(DISTINCT order_id) AS duplicate_keys
            FROM raw_orders
            UNION ALL SELECT 'customers', count(*) - count(DISTINCT customer_id)
            FROM raw_customers
            UNION ALL SELECT 'products', count(*) - count(DISTINCT product_id) FROM raw_products
            UNION ALL SELECT 'sales_reps', count(*) - count(DISTINCT sales_rep_id)
            FROM raw_sales_reps) USING (parent)""",
    "c3_profile_left_join": """SELECT c.customer_id, coalesce(total_revenue, 0) AS total_revenue,
        coalesce(share_orders_discounted, 0) AS share_orders_discounted,
        coalesce(share_orders_high_discount, 0) AS share_orders_high_discount,
        coalesce(repeat_discount_behavior, 0) AS repeat_discount_behavior
        FROM raw_customers c LEFT JOIN profile p USING (customer_id)""",
    "c4_queue_left_join": "SELECT * FROM action_queue",
    "c5_policy_cross_join": """SELECT max(t) AS high_discount_threshold,
        sum(net) AS base_revenue, count(*) FILTER (depth >= t) AS lines_at_threshold,
        sum(net) FILTER (depth >= t) AS revenue_at_threshold
        FROM lines CROSS JOIN (SELECT 0.20::DOUBLE AS t) AS policy""",
    "c6_anti_joins": """SELECT 'anti_join_' || child || '_missing_' || parent AS check_name,
        missing AS missing_rows FROM links""",
    "c7_semi_join": """SELECT order_item_id, customer_id, net AS line_revenue FROM lines
        WHERE customer_id IN (SELECT customer_id FROM scores
                              WHERE risk_tier IN ('Critical', 'High'))""",
    "c8_margin_full_outer": """SELECT customer_id, avg_margin_proxy_pct,
        expected_margin_proxy_pct,
        abs(avg_margin_proxy_pct - expected_margin_proxy_pct) <= 1e-9 AS agrees
        FROM profile FULL JOIN (SELECT customer_id, sum(gm) / sum(net)
                                           AS expected_margin_proxy_pct
                                FROM lines GROUP BY customer_id) USING (customer_id)""",
    "c9_order_dates": """SELECT order_id, o.customer_id, order_date, signup_date,
        order_date < signup_date AS before_signup
        FROM raw_orders o LEFT JOIN raw_customers c ON c.customer_id = o.customer_id""",
    "c10_segment_high_risk": """SELECT s.segment, s.margin_erosion_proxy,
        avg(CASE WHEN risk_tier IN ('High', 'Critical') THEN 1 ELSE 0 END)
            AS high_risk_customer_share,
        count(*) FILTER (risk_tier IN ('High', 'Critical')) AS high_risk_customers,
        count(*) AS total_customers
        FROM segments s JOIN scores c ON c.segment = s.segment
        GROUP BY s.segment, s.margin_erosion_proxy""",
    "c11_path_parity": """
        SELECT 'overall' AS mart, unnest(['total_revenue', 'total_list_revenue',
            'total_margin_proxy_value', 'avg_realized_discount', 'weighted_realized_discount',
            'high_discount_revenue_share', 'price_realization', 'margin_proxy_pct']) AS metric,
            rows, 0 AS differing_rows FROM (SELECT count(*) AS rows FROM overall)
        UNION ALL SELECT 'monthly', unnest(['revenue', 'list_revenue', 'gross_margin_value',
            'avg_discount_pct', 'high_discount_share', 'weighted_discount_pct',
            'margin_proxy_pct']), rows, 0 FROM (SELECT count(*) AS rows FROM monthly)
        UNION ALL SELECT 'customers', unnest(['total_order_items', 'total_revenue',
            'avg_discount_pct', 'weighted_discount_pct', 'share_order_items_discounted',
            'product_diversity', 'avg_margin_proxy_pct', 'realized_price_cv',
            'avg_abs_price_realization_residual_pct', 'revenue_high_discount_share',
            'share_orders_discounted', 'share_orders_high_discount', 'total_orders',
            'repeat_discount_behavior']), rows, 0
        FROM (SELECT count(*) AS rows FROM profile)
        UNION ALL SELECT 'segments', unnest(['total_revenue', 'avg_discount_pct',
            'median_discount_pct', 'share_high_discount', 'avg_margin_proxy_pct',
            'realized_price_variance', 'realized_price_std', 'margin_erosion_proxy']), rows, 0
        FROM (SELECT count(*) AS rows FROM segments)
        UNION ALL SELECT 'products', unnest(['revenue', 'list_revenue', 'avg_discount_pct',
            'avg_margin_proxy_pct', 'high_discount_share', 'order_item_count',
            'price_realization']), rows, 0
        FROM (SELECT count(*) AS rows FROM products)""",
    "d1_overall": "SELECT * FROM overall",
    "d2_monthly": "SELECT * FROM monthly",
    "d3_yearly": "SELECT * FROM yearly",
    "d4_product": "SELECT * FROM products",
    "d5_segment_population": """SELECT * EXCLUDE (realized_price_variance, realized_price_std),
        pop_variance AS realized_price_variance, pop_std AS realized_price_std FROM segments""",
    "d6_segment_sample": "SELECT * FROM segments",
    "d7_segment_channel": "SELECT * FROM segment_channel",
    "d8_order_level": "SELECT * FROM ledger",
    "d9_customer_profile": "SELECT * FROM profile",
    "d10_repeat_behavior": "SELECT * FROM order_stats",
    "d11_segment_dependency": "SELECT * FROM segment_dependency",
    "d12_product_dependency": "SELECT *, order_item_count AS order_lines FROM products",
    "d13_erosion_base": "SELECT * FROM erosion_base",
    "d14_rep_behavior": "SELECT * FROM reps",
    "d15_channel_region": """SELECT sales_channel, region, sum(net) AS revenue,
        avg(depth) AS avg_discount_pct, count(*) AS order_lines,
        sum(gm) / sum(net) AS avg_margin_proxy_pct FROM lines GROUP BY sales_channel, region""",
    "d16_product_channel_variance": """SELECT *,
        realized_price_std / realized_price_mean AS realized_price_cv
        FROM (SELECT product_id, product_name, category, sales_channel, sum(net) AS revenue,
                     count(*) AS order_lines, avg(depth) AS avg_discount_pct,
                     avg(realized_price) AS realized_price_mean,
                     stddev_samp(realized_price) AS realized_price_std,
                     avg(abs(residual)) AS price_realization_residual_abs_mean,
                     stddev_samp(residual) AS price_realization_residual_std
              FROM lines GROUP BY ALL HAVING count(*) >= 25)""",
    "d17_tier_action": """SELECT risk_tier, recommended_action, count(*) AS customers,
        sum(total_revenue) AS total_revenue,
        avg(governance_priority_score) AS avg_governance_priority
        FROM scores GROUP BY risk_tier, recommended_action""",
    "d18_main_driver": """SELECT main_risk_driver, count(*) AS customers,
        sum(total_revenue) AS total_revenue, avg(governance_priority_score) AS avg_priority
        FROM scores GROUP BY main_risk_driver""",
    "d19_kpi_cube": """SELECT coalesce(segment, 'All') AS segment,
        coalesce(region, 'All') AS region, coalesce(category, 'All') AS category,
        coalesce(sales_channel, 'All') AS sales_channel, sum(net) AS net_revenue,
        sum(given) / sum(listed) AS weighted_discount_pct,
        sum(high_net) / sum(net) AS high_discount_revenue_share,
        sum(exposed) AS margin_at_risk, sum(exposed) / sum(net) AS margin_at_risk_share
        FROM scope_lines GROUP BY CUBE (segment, region, category, sales_channel)""",
    "d20_monthly_fact": """SELECT order_month, segment, region, category, sales_channel,
        sum(net) AS line_revenue, sum(listed) AS line_list_revenue,
        sum(given) AS discount_weighted_num, sum(high_net) AS high_discount_revenue,
        sum(exposed) AS margin_risk_revenue
        FROM scope_lines GROUP BY order_month, segment, region, category, sales_channel""",
    "d21_customer_fact": """SELECT order_month, customer_id, segment, region, category,
        sales_channel, sum(net) AS filtered_revenue, sum(listed) AS filtered_list_revenue,
        sum(given) AS filtered_discount_num
        FROM scope_lines
        GROUP BY order_month, customer_id, segment, region, category, sales_channel""",
    "d22_channel_comparison": """SELECT sales_channel, sum(net) AS revenue,
        avg(depth) AS avg_discount_pct, sum(gm) / sum(net) AS avg_margin_proxy_pct
        FROM lines GROUP BY sales_channel""",
    "d23_revenue_by_bucket": """SELECT bucket_order, discount_bucket,
        coalesce(sum(net), 0) AS revenue FROM buckets LEFT JOIN lines
        ON depth > above AND depth <= upto GROUP BY bucket_order, discount_bucket""",
    "d24_margin_by_bucket": """SELECT bucket_order, discount_bucket,
        sum(gm) / sum(net) AS margin_proxy_pct FROM buckets LEFT JOIN lines
        ON depth > above AND depth <= upto GROUP BY bucket_order, discount_bucket""",
    "d25_discount_ladders": " UNION ALL ".join(
        _ladder(d) for d in ("sales_channel", "region", "category")
    ),
    "d26_annual_value": """SELECT *, year AS order_year, list_revenue - revenue
        AS revenue_forgone, margin_proxy_value AS gross_margin_value,
        weighted_discount AS weighted_discount_pct FROM yearly""",
    "d27_segment_value_pool": _value_pool("segment"),
    "d27_channel_value_pool": _value_pool("sales_channel"),
    "d28_tier_detail": """SELECT risk_tier, count(*) AS customers,
        sum(total_revenue) AS revenue, avg(avg_discount_pct) AS avg_discount_pct,
        avg(avg_margin_proxy_pct) AS avg_margin_proxy_pct,
        avg(revenue_high_discount_share) AS revenue_high_discount_share,
        avg(governance_priority_score) AS avg_priority,
        sum(total_revenue) / (SELECT sum(total_revenue) FROM scores) AS revenue_share
        FROM scores GROUP BY risk_tier""",
    "d29_tenure_cohort": """SELECT tenure_band, avg(avg_discount_pct) AS avg_discount_pct,
        avg(avg_margin_proxy_pct) AS avg_margin_proxy_pct, count(*) AS customers
        FROM tenure JOIN profile USING (customer_id)
        WHERE tenure_band IS NOT NULL GROUP BY tenure_band""",
    "d30_portfolio_counts": """SELECT n.*, t.* FROM
        (SELECT count(*) AS n_order_items, count(DISTINCT customer_id) AS n_customers,
                count(DISTINCT product_id) AS n_products, count(DISTINCT order_month) AS n_months,
                count(DISTINCT segment) AS n_segments,
                count(DISTINCT sales_channel) AS n_channels, count(DISTINCT region) AS n_regions,
                count(DISTINCT category) AS n_categories FROM lines) n,
        (SELECT count(*) AS high_tier_customers, coalesce(sum(total_revenue), 0)
                    AS high_tier_revenue, avg(governance_priority_score) AS high_tier_avg_priority
         FROM scores WHERE risk_tier IN ('High', 'Critical')) t""",
    "d30_realization_range": """SELECT min(p) AS pr_min, max(p) AS pr_max, avg(p) AS pr_mean
        FROM (SELECT sum(net) / sum(listed) AS p FROM lines GROUP BY order_month)""",
    "d31_weighted_average": """SELECT segment, sum(depth * listed) / sum(listed)
        AS weighted_discount, sum(margin_pct * net) / sum(net) AS weighted_margin
        FROM lines GROUP BY segment""",
    "d32_filter_options": """
        SELECT filter, option, row_number() OVER (PARTITION BY filter ORDER BY option) AS position
        FROM (SELECT DISTINCT 'segment' AS filter, segment AS option FROM scope_lines
              UNION SELECT 'region', region FROM scope_lines
              UNION SELECT 'category', category FROM scope_lines
              UNION SELECT 'sales_channel', sales_channel FROM scope_lines
              UNION SELECT 'order_month', order_month FROM scope_lines)
        UNION ALL SELECT unnest(['segment', 'region', 'category', 'sales_channel']), 'All', 0""",
    "d32_coverage": """SELECT strftime(min(order_date), '%Y-%m-%d') AS coverage_start,
        strftime(max(order_date), '%Y-%m-%d') AS coverage_end, count(*) AS pricing_rows,
        count(DISTINCT customer_id) AS customers FROM lines""",
    "e1_peer_residual": """SELECT order_item_id, product_id, sales_channel,
        residual AS price_realization_residual_pct,
        abs(residual) AS abs_price_realization_residual_pct FROM lines""",
    "e2_previous_order": "SELECT * FROM sequence",
    "e3_percentile_score": "SELECT * FROM signals",
    "e4_percent_rank": """SELECT product_id, r1 AS avg_discount_rank, r2 AS high_share_rank,
        1 - r3 AS low_margin_rank FROM product_ranks""",
    "e5_rep_peer_zscore": "SELECT * FROM rep_scores",
    "e6_revenue_concentration": "SELECT * FROM curve",
    "e6_top_revenue_shares": """SELECT
        max(cumulative_revenue_share) FILTER (customer_rank = floor(customers * 0.10::DOUBLE))
            AS top10_rev_share,
        max(cumulative_revenue_share) FILTER (customer_rank = floor(customers * 0.20::DOUBLE))
            AS top20_rev_share FROM curve""",
    "e7_month_over_month": _trend("open"),
    "e8_period_growth": """SELECT a.year AS start_year, b.year AS end_year,
        a.revenue AS start_revenue, b.revenue AS end_revenue,
        CASE WHEN b.year > a.year THEN (b.revenue / a.revenue - 1) * 100 END AS growth_pct
        FROM yearly a, yearly b
        WHERE a.year = (SELECT min(year) FROM yearly) AND b.year = (SELECT max(year) FROM yearly)""",
    "f1_ordered_lines": """SELECT order_item_id, order_id, order_date, net AS line_revenue
        FROM lines ORDER BY order_date, order_id, order_item_id""",
    "f2_top_decile": "SELECT * FROM curve WHERE position < ceil(customers * 0.10::DOUBLE)",
    "f3_review_queue": "SELECT * FROM queue",
    "f4_top_products": """SELECT *, high_discount_share >= 0.30 AS deep_discount FROM products
        ORDER BY revenue DESC, product_id LIMIT 12""",
    "f5_top_dependence": "SELECT * FROM products ORDER BY dependence_score DESC, product_id LIMIT 15",
    "f6_top_values": tables.top_values(),
    "f7_queue_preview": """SELECT * FROM action_queue
        ORDER BY priority_value_proxy DESC, governance_priority_score DESC,
                 margin_at_risk_revenue DESC, customer_id LIMIT 5""",
    "f8_collapsed_tail": """SELECT CASE WHEN n <= 6 OR place <= 5 THEN product_id
        ELSE 'Other actions' END AS label, sum(revenue) AS value
        FROM (SELECT *, row_number() OVER (ORDER BY revenue DESC, product_id) AS place,
                     count(*) OVER () AS n FROM products) GROUP BY 1""",
    "f9_queue_table": """SELECT * FROM accounts WHERE scope = 'open'
        ORDER BY filtered_revenue DESC, customer_id LIMIT 120""",
    "g1_union_dedupe": " UNION ALL ".join(
        _total(d) for d in (None, "segment", "region", "category", "sales_channel")
    ),
    "g2_month_gaps": """SELECT count(*) AS expected_months, count(seen) AS observed_months,
        count(*) - count(seen) AS missing_months
        FROM (SELECT CAST(unnest(generate_series(min(order_month), max(order_month),
                                                 INTERVAL 1 MONTH)) AS DATE) AS m FROM lines)
        LEFT JOIN (SELECT DISTINCT order_month AS seen FROM lines) ON seen = m""",
    "g3_month_by_flag": """SELECT order_month,
        sum(CASE WHEN high = 0 THEN net ELSE 0 END) AS standard_discount_revenue,
        sum(high_net) AS high_discount_revenue FROM lines GROUP BY order_month""",
    "g4_segment_channel_heatmap": """SELECT segment,
        avg(depth) FILTER (sales_channel = '1-URGENT') AS "1-URGENT",
        avg(depth) FILTER (sales_channel = '2-HIGH') AS "2-HIGH",
        avg(depth) FILTER (sales_channel = '3-MEDIUM') AS "3-MEDIUM",
        avg(depth) FILTER (sales_channel = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
        avg(depth) FILTER (sales_channel = '5-LOW') AS "5-LOW"
        FROM lines GROUP BY segment""",
    "g5_bridge": """
        SELECT unnest([0, 1, 2, 3, 4]) AS step_order,
               unnest(['List revenue', 'Discount given', 'Net revenue', 'Margin at risk',
                       'Protected revenue']) AS step,
               unnest(['Total', 'Reduction', 'Total', 'Reduction', 'Total']) AS kind,
               unnest([l, n - l, n, -least(x, n), greatest(n - x, 0)]) AS value
        FROM (SELECT sum(listed) AS l, sum(net) AS n, sum(exposed) AS x FROM lines)""",
    "g6_distinct_keys": "SELECT * FROM mart_keys",
    "h1_correlation": "SELECT * FROM fit",
    "h2_regression": "SELECT * FROM fit",
    "h3_discount_quantiles": "SELECT * FROM depth_quantiles",
    "h3_score_quantile": """SELECT p AS p90_priority, (SELECT count(*) FROM scores
        WHERE governance_priority_score >= p) AS customers_at_or_above
        FROM (SELECT quantile_cont(governance_priority_score, 0.9) AS p FROM scores)""",
    "h4_discount_histogram45": _histogram("lines", "depth * 100", 45),
    "h4_discount_histogram40": _histogram("lines", "depth * 100", 40),
    "h4_priority_histogram40": _histogram("scores", "governance_priority_score", 40),
    "h5_price_density": """
        WITH e AS (SELECT min(list_price_at_sale) AS x0,
                          (max(list_price_at_sale) - min(list_price_at_sale)) / 55 AS xw,
                          min(realized_price) AS y0,
                          (max(realized_price) - min(realized_price)) / 55 AS yw FROM lines),
             g AS (SELECT list_price_at_sale AS x, realized_price AS y, e.*,
                          least(CAST(floor((list_price_at_sale - x0) / xw) AS BIGINT), 54) AS i,
                          least(CAST(floor((realized_price - y0) / yw) AS BIGINT), 54) AS j
                   FROM lines, e)
        SELECT i - CASE WHEN x < x0 + i * xw THEN 1 ELSE 0 END
                 + CASE WHEN x >= x0 + (i + 1) * xw AND i < 54 THEN 1 ELSE 0 END AS x_bin,
               j - CASE WHEN y < y0 + j * yw THEN 1 ELSE 0 END
                 + CASE WHEN y >= y0 + (j + 1) * yw AND j < 54 THEN 1 ELSE 0 END AS y_bin,
               count(*) AS rows
        FROM g GROUP BY 1, 2""",
    "h6_distribution_label": """SELECT *, CASE WHEN median_discount >= 15 OR p90_discount >= 30
        THEN 'Material deep-discount tail' ELSE 'Moderately concentrated' END AS distribution
        FROM depth_quantiles""",
    "h7_score_variances": """SELECT (SELECT var_pop(governance_priority_score) FROM scores)
        AS governance_score_variance,
        (SELECT var_pop(share_orders_high_discount) FROM profile)
        AS share_orders_high_discount_variance""",
    "i1_scale_excess": "SELECT * FROM signals",
    "i2_scale_shortfall": "SELECT * FROM signals",
    "i3_reliability": """SELECT customer_id, weight AS score_reliability_weight,
        CASE WHEN total_orders < 6 THEN 1 ELSE 0 END AS low_data_flag, s1 AS shrunk_pricing
        FROM shrunk""",
    "i4_components": """SELECT customer_id, raw_pricing AS raw_pricing_risk_score,
        raw_dependency AS raw_discount_dependency_score, raw_margin AS raw_margin_erosion_score
        FROM raw_scores""",
    "i5_priority": "SELECT * FROM rounded_scores",
    "i6_risk_tier": "SELECT * FROM scores",
    "i7_main_driver": "SELECT * FROM scores",
    "i8_recommended_action": "SELECT * FROM scores",
    "i9_risk_scores": "SELECT * FROM scores",
    "j1_health_verdict": """SELECT *, CASE verdict
        WHEN 'Healthy pricing discipline' THEN 'Discount intensity and margin proxy remain within'
             || ' the configured healthy thresholds.'
        WHEN 'Mixed pricing quality' THEN 'At least one pricing-health metric falls outside the'
             || ' healthy range but remains within mixed thresholds.'
        ELSE 'At least one pricing-health metric falls outside the configured mixed thresholds.'
        END AS reason
        FROM (SELECT *, CASE
                  WHEN weighted_realized_discount <= 0.12 AND high_discount_revenue_share <= 0.20
                       AND margin_proxy_pct >= 0.45 THEN 'Healthy pricing discipline'
                  WHEN weighted_realized_discount <= 0.18 AND high_discount_revenue_share <= 0.30
                       AND margin_proxy_pct >= 0.40 THEN 'Mixed pricing quality'
                  ELSE 'Discount-reliant growth risk' END AS verdict FROM overall)""",
    "j2_threshold_sensitivity": " UNION ALL ".join(
        _sensitivity(t) for t in ("0.15::DOUBLE", "0.20::DOUBLE", "0.25::DOUBLE")
    ),
    "j3_action_queue": "SELECT * FROM action_queue",
    "j4_customer_dependency": """SELECT *, revenue_high_discount_share * total_revenue
        AS high_discount_revenue_value FROM profile""",
    "j5_dependency_concentration": """SELECT count(*) FILTER (inside) AS top_decile_customers,
        sum(total_revenue) FILTER (inside) / sum(total_revenue)
            AS revenue_share_of_top_dependency_decile,
        (SELECT avg(repeat_discount_behavior) FROM profile) AS avg_repeat_discount_behavior,
        (SELECT avg(share_orders_discounted) FROM profile) AS avg_share_orders_discounted
        FROM (SELECT *, position < ceil(customers * 0.10::DOUBLE) AS inside FROM curve)""",
    "j6_margin_erosion": """SELECT *, 100 * (0.45 * r1 + 0.30 * r2 + 0.25 * (1 - r3))
        AS margin_erosion_risk_score FROM erosion_ranks""",
    "j7_rep_inconsistency": "SELECT * FROM rep_scores",
    "j8_product_patterns": "SELECT * FROM patterns",
    "j9_recommendations": """
        WITH f AS (SELECT (SELECT high_discount_revenue_share FROM overall) AS share,
                          (SELECT max(high_discount_revenue_share) FROM segment_dependency) AS top,
                          (SELECT count(*) FROM rep_scores WHERE discount_outlier_flag) AS reps,
                          (SELECT count(*) FROM patterns
                           WHERE pricing_pattern = 'Discount-reliant') AS reliant,
                          (SELECT count(*) FROM action_queue) AS queued)
        SELECT unnest(range(8)) AS rule_order,
               unnest(['tighten_approval_thresholds', 'review_segment_architecture',
                       'investigate_rep_outliers', 'maintain_rep_monitoring',
                       'redesign_product_guardrails', 'monitor_mixed_products',
                       'activate_intervention_queue', 'track_recurring_kpis']) AS rule,
               unnest([share >= 0.30, top >= 0.40, reps > 0, reps = 0, reliant > 0, reliant = 0,
                       queued > 0, true]) AS fired
        FROM f""",
    "j10_recovery_scenarios": """SELECT pp AS realization_improvement_pp,
        total_list_revenue * (pp / 100) AS revenue_capture_on_analysis_base,
        price_realization + pp / 100 AS new_price_realization
        FROM overall, (VALUES (1), (2), (3)) AS points(pp)""",
    "j11_run_rate": """
        WITH r AS (SELECT region, 1 - sum(net) / sum(listed) AS d FROM lines GROUP BY region),
             y AS (SELECT greatest(count(DISTINCT order_month) / 12, 1.0::DOUBLE) AS years
                   FROM lines)
        SELECT total_list_revenue * 0.02::DOUBLE AS two_point_capture, years AS analysis_years,
               total_list_revenue * 0.02::DOUBLE / years AS two_point_annual_run_rate,
               (SELECT arg_min(region, d) FROM r) AS shallowest_region,
               (SELECT arg_max(region, d) FROM r) AS deepest_region,
               (SELECT max(d) - min(d) FROM r) AS region_discount_range
        FROM overall, y""",
    "j12_intervention_queue": "SELECT * FROM profile WHERE revenue_high_discount_share >= 0.40",
    "j13_reconciliation": """SELECT *, abs(base_revenue - segment_revenue) <= 0.01
        AS segment_agrees, abs(base_revenue - monthly_revenue) <= 0.01 AS monthly_agrees
        FROM (SELECT sum(net) AS base_revenue FROM lines),
             (SELECT sum(total_revenue) AS segment_revenue FROM segments),
             (SELECT sum(revenue) AS monthly_revenue FROM monthly)""",
    "j14_product_dependence": "SELECT * FROM products",
    "j15_cell_spotlight": """SELECT * FROM segment_channel
        WHERE segment = 'BUILDING' AND sales_channel = '5-LOW'""",
    "j16_monthly_trend": "SELECT * FROM monthly",
    "j17_pressure_map": "SELECT * FROM segment_channel",
    "k1_column_types": tables.column_types(),
    "k2_column_profile": tables.column_profile(),
    "k3_table_summary": tables.table_summary(),
    "k4_top_values": tables.top_values(),
    "k5_numeric_summary": tables.numeric_summary(),
    "k6_column_issues": "SELECT * FROM issues",
    "k7_join_counts": """SELECT child AS table_name, key AS column_name, parent,
        missing AS missing_rows FROM links
        UNION ALL SELECT 'customer_risk_scores', 'customer_id', 'customer_pricing_profile',
        count(*) FROM scores WHERE customer_id NOT IN (SELECT customer_id FROM profile)""",
    "k8_population_coverage": """SELECT *,
        greatest(total_customers_raw - transacting_customers, 0)
            AS excluded_non_transacting_customers,
        greatest(total_customers_raw - transacting_customers, 0) / total_customers_raw
            AS excluded_non_transacting_share,
        greatest(transacting_customers - profiled_customers, 0)
            AS transacting_not_profiled_customers,
        greatest(profiled_customers - scored_customers, 0) AS profiled_not_scored_customers
        FROM (SELECT (SELECT count(DISTINCT customer_id) FROM raw_customers)
                         AS total_customers_raw,
                     (SELECT count(DISTINCT customer_id) FROM raw_orders)
                         AS transacting_customers,
                     (SELECT count(DISTINCT customer_id) FROM profile) AS profiled_customers,
                     (SELECT count(DISTINCT customer_id) FROM scores) AS scored_customers)""",
    "k9_ranked_issues": """SELECT *, CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2
        ELSE 3 END AS severity_rank FROM issues""",
    "m1_raw_structure": "SELECT * FROM raw_structure",
    "m2_raw_integrity": "SELECT * FROM raw_integrity",
    "m2_file_integrity": """SELECT check_name, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END
            AS status, failed AS failed_rows, detail
        FROM (SELECT check_name, detail, failed_rows + (SELECT count(*) FROM faults
                  WHERE table_name || '_' || column_name || '_numeric' = check_name) AS failed
              FROM raw_integrity
              UNION ALL SELECT table_name || '_quarantine', 'no row is held', held
              FROM held_rows)""",
    "m3_raw_pricing_rules": "SELECT * FROM raw_rules",
    "m4_processed_checks": "SELECT * FROM processed_checks",
    "m5_metric_contracts": tables.metric_contracts(),
    "m6_warehouse_checks": "SELECT * FROM warehouse_checks",
    "m7_analysis_checks": "SELECT * FROM analysis_checks",
    "m8_review_checks": "SELECT * FROM review_checks",
    "m9_cross_output": "SELECT * FROM cross_output",
    "m10_readiness": "SELECT * FROM readiness",
    "m11_exclusions": """SELECT total - profiled AS excluded_customers,
        (total - profiled) / total AS excluded_customer_pct,
        CASE WHEN total = profiled THEN 'None' WHEN (total - profiled) / total > 0.05
             THEN 'Medium' ELSE 'Low' END AS severity
        FROM (SELECT (SELECT count(DISTINCT customer_id) FROM raw_customers) AS total,
                     (SELECT count(DISTINCT customer_id) FROM profile) AS profiled)""",
    "m12_release_gate": f"""
        WITH contracts AS ({tables.metric_contracts()}),
             c AS (SELECT count(*) AS n, count(*) FILTER (status = 'FAIL') AS f FROM contracts)
        SELECT rule_name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, detail
        FROM (SELECT unnest(['readiness_flag_technically_valid',
                  'readiness_flag_analytically_acceptable',
                  'readiness_flag_decision_support_only', 'readiness_flag_publish_blocked',
                  'release_readiness_state', 'max_failed_checks', 'max_failed_blocker_checks',
                  'metric_contract_report_valid']) AS rule_name,
              unnest([technically_valid, analytically_acceptable, decision_support_only,
                  NOT publish_blocked, release_readiness_state = 'decision-support only',
                  failed_checks <= 0, failed_blocker_checks <= 0, n > 0 AND f <= 0]) AS ok,
              unnest(['expected=true, observed=' || technically_valid,
                  'expected=true, observed=' || analytically_acceptable,
                  'expected=true, observed=' || decision_support_only,
                  'expected=false, observed=' || publish_blocked,
                  'expected=decision-support only, observed=' || release_readiness_state,
                  'max=0, observed=' || failed_checks,
                  'max=0, observed=' || failed_blocker_checks,
                  'rows=' || n || ', failures=' || f || ', invalid_statuses=0']) AS detail
              FROM readiness, c)""",
    "m13_status_reports": "SELECT * FROM status_reports",
    "n1_scoped_kpi": "SELECT * FROM kpis",
    "n2_revenue_coverage": "SELECT * FROM kpis",
    "n3_scoped_accounts": "SELECT * FROM accounts WHERE scope = 'narrow'",
    "n4_posture": """SELECT scope, posture, CASE posture WHEN 'critical' THEN 'Intervene now'
        WHEN 'warn' THEN 'Tight watch' ELSE 'Controlled' END AS posture_label FROM indicators""",
    "n5_indicator_levels": """SELECT *, l1 AS weighted_discount_pct_level,
        l2 AS margin_risk_share_level, l3 AS high_risk_count_level FROM indicators""",
    "n6_scoped_trend": _trend("narrow"),
    "n7_segment_ranking": """SELECT segment, sum(given) / sum(listed) * 100
        AS weighted_discount_points FROM scope_lines GROUP BY segment""",
    "n8_region_ranking": """SELECT region, sum(exposed) AS margin_at_risk
        FROM scope_lines GROUP BY region""",
    "n9_action_revenue": _revenue_by("recommended_action"),
    "n9_driver_revenue": _revenue_by("main_risk_driver"),
    "n9_action_chart": """SELECT recommended_action AS label, sum(filtered_revenue) AS value
        FROM accounts WHERE scope = 'open' GROUP BY recommended_action""",
}

BODIES["a6_json_row_sets"] = f"""
    SELECT 'kpi_cube' AS record_set, count(*) AS row_count, sum(net_revenue) AS amount
    FROM ({BODIES["d19_kpi_cube"]})
    UNION ALL SELECT 'monthly_facts', count(*), sum(line_revenue) FROM ({BODIES["d20_monthly_fact"]})
    UNION ALL SELECT 'accounts', count(*), sum(filtered_revenue) FROM accounts WHERE scope = 'open'
    UNION ALL SELECT 'account_facts', count(*), sum(filtered_revenue)
    FROM ({BODIES["d21_customer_fact"]})"""


def _needed(text: str) -> list[str]:
    """Building blocks a text refers to, each after those it builds on."""
    ordered: list[str] = []

    def visit(part: str) -> None:
        words = set(re.findall(r"\w+", part))
        for name in COMMON:
            if name in words and name not in ordered and name not in visiting:
                visiting.append(name)
                visit(COMMON[name])
                ordered.append(name)

    visiting: list[str] = []
    visit(text)
    return ordered


def sql(name: str) -> str:
    """The full SQL of a registered query."""
    body = BODIES[name]
    blocks = ",\n".join(f"{block} AS ({COMMON[block]})" for block in _needed(body))
    return f"WITH {blocks}\n{published_sql(name, body)}"
