"""SQL twins of the named analyses."""

from __future__ import annotations

from oracle_sql_pack.generated import with_tables

ANALYSIS_SQL = {
    "ana_retail_trends": ("retail", ["fact_sales", "dim_date"], """
        SELECT 'day' AS grain, full_date::VARCHAR AS period, sum(revenue) AS revenue, count(*) AS n_sales
        FROM fact_sales JOIN dim_date USING (date_key) GROUP BY 2
        UNION ALL SELECT 'week', date_trunc('week', full_date)::DATE::VARCHAR, sum(revenue), count(*)
        FROM fact_sales JOIN dim_date USING (date_key) GROUP BY 2
        UNION ALL SELECT 'month', strftime(full_date, '%Y-%m'), sum(revenue), count(*)
        FROM fact_sales JOIN dim_date USING (date_key) GROUP BY 2"""),
    "ana_retail_stores": ("retail", ["fact_sales", "dim_store"], """
        SELECT store_key, region, revenue, n_sales, rank() OVER (PARTITION BY region ORDER BY revenue DESC) AS rank_in_region
        FROM (SELECT store_key, region, sum(revenue) AS revenue, count(*) AS n_sales
              FROM fact_sales JOIN dim_store USING (store_key) GROUP BY ALL)"""),
    "ana_retail_segments": ("retail", ["fact_sales", "dim_customer", "dim_date"], """
        SELECT customer_key, loyalty_tier, recency_days, frequency, monetary,
               (ntile(5) OVER (ORDER BY recency_days DESC, customer_key))::INTEGER AS r_score,
               (ntile(5) OVER (ORDER BY frequency, customer_key))::INTEGER AS f_score,
               (ntile(5) OVER (ORDER BY monetary, customer_key))::INTEGER AS m_score
        FROM (SELECT customer_key, (SELECT max(date_key) FROM dim_date) - max(date_key) AS recency_days,
                     count(*) AS frequency, sum(revenue) AS monetary FROM fact_sales GROUP BY 1)
        JOIN dim_customer USING (customer_key)"""),
    "ana_retail_turnover": ("retail", ["fact_sales", "fact_inventory"], """
        WITH b AS (SELECT i.product_key, stock, coalesce(sold, 0)::BIGINT AS sold
                   FROM (SELECT product_key, sum(stock_on_hand)::BIGINT AS stock FROM fact_inventory GROUP BY 1) i
                   LEFT JOIN (SELECT product_key, sum(quantity)::BIGINT AS sold FROM fact_sales GROUP BY 1) s USING (product_key))
        SELECT *, CASE WHEN turnover >= (SELECT sum(sold)::DOUBLE / nullif(sum(stock), 0)::DOUBLE FROM b) THEN 'fast' ELSE 'slow' END AS mover
        FROM (SELECT *, sold::DOUBLE / nullif(stock, 0)::DOUBLE AS turnover FROM b)"""),
    "ana_retail_seasonality": ("retail", ["fact_sales", "dim_product", "dim_date"],
        "SELECT category, " + ", ".join(
            f"coalesce(sum(revenue) FILTER (month = {m}), 0)::DOUBLE * 12 / sum(revenue)::DOUBLE AS m{m}" for m in range(1, 13))
        + " FROM fact_sales JOIN dim_product USING (product_key) JOIN dim_date USING (date_key) GROUP BY category"),
    "ana_ecom_funnel": ("ecommerce", ["fact_web_events"], """
        SELECT stage_no, stage, n_customers, n_events, n_customers::DOUBLE / lag(n_customers) OVER (ORDER BY stage_no) AS step_rate
        FROM (SELECT list_position(['page_view', 'product_view', 'add_to_cart', 'checkout_start', 'purchase'], event_type)::INTEGER AS stage_no,
                     event_type AS stage, count(DISTINCT customer_key) AS n_customers, count(*) AS n_events
              FROM fact_web_events WHERE event_type <> 'remove_from_cart' GROUP BY 1, 2)"""),
    "ana_ecom_channels": ("ecommerce", ["fact_orders", "dim_customer"], """
        SELECT acquisition_channel, count(DISTINCT customer_key) AS n_customers, count(order_id) AS n_orders, sum(order_value) AS gmv
        FROM dim_customer LEFT JOIN fact_orders USING (customer_key) GROUP BY 1"""),
    "ana_ecom_abandonment": ("ecommerce", ["fact_web_events"], """
        SELECT count(*) AS cart_sessions, count(*) FILTER (b IS NULL) AS abandoned,
               count(*) FILTER (b IS NULL)::DOUBLE / nullif(count(*), 0) AS abandon_rate
        FROM (SELECT DISTINCT session_id FROM fact_web_events WHERE event_type = 'add_to_cart')
        LEFT JOIN (SELECT DISTINCT session_id, 1 AS b FROM fact_web_events WHERE event_type = 'purchase') USING (session_id)"""),
    "ana_ecom_affinity": ("ecommerce", ["fact_order_items"], """
        WITH i AS (SELECT DISTINCT order_id, product_key FROM fact_order_items),
             s AS (SELECT product_key, count(*) AS n FROM i GROUP BY 1)
        SELECT a.product_key AS product_a, b.product_key AS product_b, count(*) AS n_orders,
               count(*)::DOUBLE * (SELECT count(DISTINCT order_id) FROM i) / (any_value(sa.n) * any_value(sb.n)) AS lift
        FROM i a JOIN i b ON a.order_id = b.order_id AND a.product_key < b.product_key
        JOIN s sa ON sa.product_key = a.product_key JOIN s sb ON sb.product_key = b.product_key GROUP BY 1, 2"""),
    "ana_ecom_ltv": ("ecommerce", ["fact_orders", "dim_customer", "dim_date"], """
        SELECT *, sum(gmv) OVER (PARTITION BY cohort ORDER BY order_month ROWS UNBOUNDED PRECEDING)::DECIMAL(38,2) AS cum_gmv
        FROM (SELECT strftime(signup_date, '%Y-%m') AS cohort, strftime(full_date, '%Y-%m') AS order_month,
                     sum(order_value) AS gmv, count(DISTINCT customer_key) AS n_customers
              FROM fact_orders JOIN dim_customer USING (customer_key) JOIN dim_date USING (date_key) GROUP BY 1, 2)"""),
    "ana_bank_unusual": ("banking", ["fact_transactions"], """
        SELECT transaction_id, account_key, amount FROM (
          SELECT *, count(*) OVER w AS n, sum(c) OVER w AS s, sum(c * c) OVER w AS q
          FROM (SELECT *, (amount * 100)::HUGEINT AS c FROM fact_transactions) WINDOW w AS (PARTITION BY account_key))
        WHERE (n * c - s) * (n * c - s) * 10000 > (n * q - s * s) * 28900"""),
    "ana_bank_bursts": ("banking", ["fact_transactions"], """
        SELECT account_key, date_key, count(*) AS n_txns, count(DISTINCT branch_key) AS n_branches
        FROM fact_transactions GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "ana_bank_defaults": ("banking", ["fact_loans", "dim_customer"], """
        SELECT segment, count(*) AS n_loans, count(*) FILTER (status = 'Default') AS n_defaults, sum(principal) AS principal,
               count(*) FILTER (status = 'Default')::DOUBLE / count(*) AS default_rate
        FROM fact_loans JOIN dim_customer USING (customer_key) GROUP BY 1"""),
    "ana_bank_branches": ("banking", ["fact_transactions", "dim_branch"], """
        SELECT branch_key, branch_name, region, count(*) AS n_txns, sum(abs(amount)) AS volume, sum(amount) AS net_flow
        FROM fact_transactions JOIN dim_branch USING (branch_key) GROUP BY ALL"""),
    "ana_bank_behaviour": ("banking", ["fact_transactions", "dim_account"],
        "SELECT customer_key, " + ", ".join(
            f"count(*) FILTER (transaction_type = '{k}') AS n_{k.lower()}"
            for k in ("Deposit", "Withdrawal", "Transfer", "Payment", "Fee", "Interest"))
        + " FROM fact_transactions JOIN dim_account USING (account_key) GROUP BY 1"),
    "ana_bank_portfolio": ("banking", ["fact_loans"], """
        SELECT loan_type, status, count(*) AS n_loans, sum(principal) AS principal, sum(monthly_payment) AS monthly_payment
        FROM fact_loans GROUP BY GROUPING SETS ((loan_type, status), (loan_type), (status), ())"""),
    "ana_health_utilisation": ("healthcare", ["fact_encounters", "dim_date"], """
        SELECT visit_type, year, month, count(*) AS n_encounters FROM fact_encounters JOIN dim_date USING (date_key) GROUP BY ALL"""),
    "ana_health_cost_cube": ("healthcare", ["fact_encounters", "fact_procedures", "dim_diagnosis"], """
        SELECT icd10_code, cpt_code, count(*) AS n_procedures, sum(charge_amount) AS charges
        FROM fact_procedures JOIN (SELECT encounter_id, diagnosis_key FROM fact_encounters) USING (encounter_id)
        JOIN dim_diagnosis USING (diagnosis_key) GROUP BY CUBE (icd10_code, cpt_code)"""),
    "ana_health_stay": ("healthcare", ["fact_encounters", "dim_date"], """
        WITH a AS (SELECT * FROM fact_encounters WHERE length_of_stay > 0),
             q AS (SELECT quantile_disc(length_of_stay, 0.25) AS q1, quantile_disc(length_of_stay, 0.75) AS q3 FROM a)
        SELECT year, month, count(*) AS n_stays, count(*) FILTER (length_of_stay > (SELECT q3 + (q3 - q1) * 0.25 FROM q)) AS n_outliers,
               sum(length_of_stay)::DOUBLE / count(*) AS avg_stay
        FROM a JOIN dim_date USING (date_key) GROUP BY year, month"""),
    "ana_health_doctors": ("healthcare", ["fact_encounters", "dim_doctor"], """
        SELECT *, dense_rank() OVER (PARTITION BY specialty ORDER BY n_encounters DESC) AS rank_in_specialty
        FROM (SELECT doctor_key, specialty, count(*) AS n_encounters, sum(total_charges) AS charges
              FROM fact_encounters JOIN dim_doctor USING (doctor_key) GROUP BY ALL)"""),
    "ana_health_denials": ("healthcare", ["fact_billing", "fact_encounters", "dim_patient"], """
        SELECT insurance_type, count(*) AS n_claims, count(*) FILTER (claim_status = 'Denied') AS n_denied,
               count(*) FILTER (claim_status = 'Denied')::DOUBLE / count(*) AS denial_rate
        FROM fact_billing JOIN (SELECT encounter_id, patient_key FROM fact_encounters) USING (encounter_id)
        JOIN dim_patient USING (patient_key) GROUP BY 1"""),
    "ana_saas_growth": ("saas", ["fact_subscriptions", "dim_date"], """
        SELECT *, (mrr - prev_mrr)::DOUBLE / nullif(prev_mrr, 0)::DOUBLE AS growth
        FROM (SELECT full_date, sum(mrr) AS mrr, lag(sum(mrr)) OVER (ORDER BY full_date) AS prev_mrr
              FROM fact_subscriptions JOIN dim_date ON snapshot_date_key = date_key WHERE status = 'Active' GROUP BY 1)"""),
    "ana_saas_churn": ("saas", ["fact_churn"], """
        SELECT reason, count(*) AS n_churned, sum(mrr_lost) AS mrr_lost, sum(tenure_months)::DOUBLE / count(*) AS avg_tenure
        FROM fact_churn GROUP BY 1"""),
    "ana_saas_at_risk": ("saas", ["fact_usage", "dim_date"], """
        SELECT * FROM (SELECT customer_key, month, calls, lag(calls) OVER (PARTITION BY customer_key ORDER BY month) AS prev_calls
          FROM (SELECT customer_key, strftime(full_date, '%Y-%m') AS month, sum(api_calls)::BIGINT AS calls
                FROM fact_usage JOIN dim_date USING (date_key) GROUP BY 1, 2)) WHERE calls * 2 < prev_calls"""),
    "ana_saas_retention": ("saas", ["fact_subscriptions", "dim_customer", "dim_date"], """
        SELECT strftime(signup_date, '%Y-%m') AS cohort,
               date_diff('month', date_trunc('month', signup_date), date_trunc('month', full_date))::INTEGER AS age_months,
               count(DISTINCT customer_key) AS n_customers
        FROM fact_subscriptions JOIN dim_customer USING (customer_key) JOIN dim_date ON snapshot_date_key = date_key
        WHERE status = 'Active' GROUP BY 1, 2"""),
    "ana_saas_upgrades": ("saas", ["fact_subscriptions", "fact_usage"], """
        WITH u AS (SELECT customer_key, count(*) FILTER (up) AS y FROM (
                     SELECT customer_key, plan_key > lag(plan_key) OVER (PARTITION BY customer_key ORDER BY snapshot_date_key) AS up
                     FROM fact_subscriptions) GROUP BY 1),
             c AS (SELECT customer_key, sum(api_calls) AS x FROM fact_usage GROUP BY 1)
        SELECT count(*) AS n_customers, round(corr(y::DOUBLE, x::DOUBLE), 6) AS correlation FROM c JOIN u USING (customer_key)"""),
    "ana_saas_health": ("saas", ["fact_usage"], """
        SELECT customer_key, logins, calls, features,
               0.0::DOUBLE + ((rank() OVER (ORDER BY logins) - 1) * 50)::DOUBLE / (count(*) OVER () - 1)::DOUBLE
               + ((rank() OVER (ORDER BY calls) - 1) * 30)::DOUBLE / (count(*) OVER () - 1)::DOUBLE
               + ((rank() OVER (ORDER BY features) - 1) * 20)::DOUBLE / (count(*) OVER () - 1)::DOUBLE AS health_score
        FROM (SELECT customer_key, sum(logins)::BIGINT AS logins, sum(api_calls)::BIGINT AS calls, count(DISTINCT feature) AS features
              FROM fact_usage GROUP BY 1)"""),
    "ana_logi_ontime": ("logistics", ["fact_shipments", "fact_deliveries", "dim_date"], """
        SELECT year, month, count(*) AS n_delivered, count(*) FILTER (on_time)::DOUBLE * 100 / count(*) AS on_time_pct
        FROM fact_shipments JOIN fact_deliveries USING (shipment_id) JOIN dim_date USING (date_key)
        WHERE delivery_status = 'Delivered' GROUP BY 1, 2"""),
    "ana_logi_routes": ("logistics", ["fact_shipments", "dim_route"], """
        SELECT *, rank() OVER (PARTITION BY origin_city, destination_city ORDER BY cost_per_mile) AS rank_in_pair
        FROM (SELECT route_key, origin_city, destination_city, sum(shipping_cost)::DOUBLE / sum(s.distance_miles)::DOUBLE AS cost_per_mile,
                     count(*) AS n_shipments FROM fact_shipments s JOIN dim_route USING (route_key) GROUP BY ALL)"""),
    "ana_logi_fleet": ("logistics", ["fact_fleet_usage", "dim_date"], """
        SELECT vehicle_key, count(DISTINCT date_key) AS active_days, sum(miles_driven)::BIGINT AS miles,
               count(DISTINCT date_key)::DOUBLE / (SELECT count(*) FROM dim_date) AS utilisation
        FROM fact_fleet_usage GROUP BY 1"""),
    "ana_logi_cost_per_mile": ("logistics", ["fact_shipments", "dim_route"], """
        SELECT route_type, sum(shipping_cost) AS total_cost, sum(s.distance_miles)::BIGINT AS total_miles,
               sum(shipping_cost)::DOUBLE / sum(s.distance_miles)::DOUBLE AS cost_per_mile
        FROM fact_shipments s JOIN dim_route USING (route_key) GROUP BY 1"""),
    "ana_logi_throughput": ("logistics", ["fact_shipments"], """
        SELECT warehouse_key, sum(o)::BIGINT AS n_outbound, sum(i)::BIGINT AS n_inbound, sum(w)::BIGINT AS weight_lbs FROM (
          SELECT origin_warehouse_key AS warehouse_key, 1 AS o, 0 AS i, weight_lbs AS w FROM fact_shipments
          UNION ALL SELECT dest_warehouse_key, 0, 1, weight_lbs FROM fact_shipments) GROUP BY 1"""),
}


def analysis_sql() -> dict[str, str]:
    out = {}
    for name, (industry, tables, body) in ANALYSIS_SQL.items():
        if body.lstrip().startswith("WITH "):  # a body with its own CTEs continues the list
            head = with_tables(industry, tables, "")
            out[name] = head.rstrip() + ",\n" + body.lstrip()[5:]
        else:
            out[name] = with_tables(industry, tables, body)
    return out
