"""SQL twins of the key figures and the report's SQL queries."""

from __future__ import annotations

from oracle_sql_pack.base import WINDOW, between, chance, choice, drawn, key_drawn, money, rows, skew, weighted
from oracle_sql_pack.generated import with_tables
from wareloom.functions.draws import SPAN

KPI_SQL = {
    "rep_retail_kpi": ("retail", ["fact_sales"], """
        SELECT sum(revenue) AS total_revenue, sum(revenue)::DOUBLE / count(revenue) AS avg_transaction,
               count(*) AS n_transactions FROM fact_sales"""),
    "rep_retail_top5": ("retail", ["fact_sales"], """
        SELECT product_key, sum(revenue) AS revenue FROM fact_sales GROUP BY product_key
        ORDER BY revenue DESC, product_key LIMIT 5"""),
    "rep_ecom_kpi": ("ecommerce", ["fact_orders"], """
        SELECT count(*) AS n_orders, sum(order_value) AS gmv, sum(order_value)::DOUBLE / count(order_value) AS aov
        FROM fact_orders"""),
    "rep_ecom_status": ("ecommerce", ["fact_orders"], """
        SELECT status, count(*) AS n, count(*)::DOUBLE * 100 / (SELECT count(*) FROM fact_orders) AS pct
        FROM fact_orders WHERE status IS NOT NULL GROUP BY status"""),
    "rep_bank_flow": ("banking", ["fact_transactions"], """
        SELECT sum(amount) FILTER (amount > 0) AS deposits, abs(sum(amount) FILTER (amount < 0)) AS withdrawals,
               sum(amount) AS net_flow FROM fact_transactions"""),
    "rep_bank_types": ("banking", ["fact_transactions"], """
        SELECT transaction_type, count(*) AS n FROM fact_transactions GROUP BY 1"""),
    "rep_health_kpi": ("healthcare", ["fact_encounters"], """
        SELECT count(*) AS n_encounters, sum(total_charges) AS total_charges,
               sum(total_charges)::DOUBLE / count(*) AS avg_charge FROM fact_encounters"""),
    "rep_health_visits": ("healthcare", ["fact_encounters"], """
        SELECT visit_type, count(*) AS n, count(*)::DOUBLE * 100 / (SELECT count(*) FROM fact_encounters) AS pct
        FROM fact_encounters GROUP BY 1"""),
    "rep_saas_kpi": ("saas", ["fact_subscriptions"], """
        SELECT sum(mrr) AS mrr, sum(arr) AS arr, count(*) AS n_active FROM fact_subscriptions WHERE status = 'Active'"""),
    "rep_saas_kpi_latest": ("saas", ["fact_subscriptions"], """
        SELECT sum(mrr) AS mrr, sum(arr) AS arr, count(*) AS n_active FROM fact_subscriptions
        WHERE status = 'Active' AND snapshot_date_key = (SELECT max(snapshot_date_key) FROM fact_subscriptions)"""),
    "rep_saas_plans": ("saas", ["fact_subscriptions"], """
        SELECT plan_key, count(*) AS n FROM fact_subscriptions WHERE status = 'Active' GROUP BY 1"""),
    "rep_logi_kpi": ("logistics", ["fact_shipments"], """
        SELECT count(*) AS n_shipments, sum(weight_lbs)::BIGINT AS total_weight,
               sum(distance_miles)::BIGINT AS total_miles, sum(shipping_cost) AS total_cost FROM fact_shipments"""),
    "rep_logi_ontime": ("logistics", ["fact_deliveries"], """
        SELECT count(*) FILTER (on_time)::DOUBLE * 100 / count(*) AS on_time_pct FROM fact_deliveries"""),
}

QUERY_SQL = {
    "sql_retail_top_stores": ("retail", ["fact_sales", "dim_store"], """
        SELECT s.store_key, s.store_name, s.city, sum(f.revenue) AS total_revenue
        FROM fact_sales f JOIN dim_store s USING (store_key) GROUP BY ALL
        ORDER BY total_revenue DESC, s.store_key LIMIT 10"""),
    "sql_ecom_daily": ("ecommerce", ["fact_orders", "dim_date"], """
        SELECT full_date, count(order_id) AS orders, sum(order_value) AS gmv,
               sum(order_value)::DOUBLE / count(*) AS aov
        FROM fact_orders JOIN dim_date USING (date_key) GROUP BY full_date"""),
    "sql_ecom_moving": ("ecommerce", ["fact_orders", "dim_date"], """
        SELECT full_date, gmv, (sum(gmv) OVER w)::DOUBLE / count(*) OVER w AS gmv_7d
        FROM (SELECT full_date, sum(order_value) AS gmv FROM fact_orders JOIN dim_date USING (date_key) GROUP BY 1)
        WINDOW w AS (ORDER BY full_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    "sql_bank_customer": ("banking", ["fact_transactions", "dim_account", "dim_customer"], """
        SELECT customer_id, count(transaction_id) AS txn_count,
               sum(greatest(amount, 0)) AS deposits, sum(greatest(-amount, 0)) AS withdrawals
        FROM fact_transactions JOIN dim_account USING (account_key) JOIN dim_customer USING (customer_key)
        GROUP BY customer_id"""),
    "sql_health_costly_dx": ("healthcare", ["fact_encounters", "dim_diagnosis"], """
        SELECT diagnosis_key, diagnosis_description, count(encounter_id) AS encounter_count,
               sum(total_charges)::DOUBLE / count(*) AS avg_charges, sum(total_charges) AS total_charges
        FROM fact_encounters JOIN dim_diagnosis USING (diagnosis_key) GROUP BY ALL
        ORDER BY total_charges DESC, diagnosis_key LIMIT 10"""),
    "sql_saas_mrr": ("saas", ["fact_subscriptions", "dim_date"], """
        SELECT year, month, sum(mrr) AS total_mrr, count(DISTINCT customer_key) AS active_customers
        FROM fact_subscriptions JOIN dim_date ON snapshot_date_key = date_key
        WHERE status = 'Active' GROUP BY year, month"""),
    "sql_logi_routes": ("logistics", ["fact_shipments", "dim_route", "fact_deliveries"], """
        SELECT route_key, origin_city, destination_city, count(*) AS shipment_count,
               sum(shipping_cost)::DOUBLE / count(*) AS avg_cost,
               sum(actual_transit_days)::DOUBLE / nullif(count(actual_transit_days), 0) AS avg_days,
               count(*) FILTER (on_time)::DOUBLE * 100 / count(*) AS on_time_pct
        FROM fact_shipments JOIN dim_route USING (route_key) JOIN fact_deliveries USING (shipment_id)
        GROUP BY ALL"""),
}


LABELS = {
    "rep_retail_top5": ("product_key", "revenue"), "rep_ecom_status": ("status", "n"),
    "rep_bank_types": ("transaction_type", "n"), "rep_health_visits": ("visit_type", "n"), "rep_saas_plans": ("plan_key", "n"),
}
# One-row key figures: column -> whether it is shown with two decimals.
COLUMNS = {
    "rep_retail_kpi": {"total_revenue": 0, "avg_transaction": 1, "n_transactions": 0},
    "rep_ecom_kpi": {"n_orders": 0, "gmv": 0, "aov": 1},
    "rep_bank_flow": {"deposits": 0, "withdrawals": 0, "net_flow": 0},
    "rep_health_kpi": {"n_encounters": 0, "total_charges": 0, "avg_charge": 1},
    "rep_saas_kpi": {"mrr": 0, "arr": 0, "n_active": 0},
    "rep_saas_kpi_latest": {"mrr": 0, "arr": 0, "n_active": 0},
    "rep_logi_kpi": {"n_shipments": 0, "total_weight": 0, "total_miles": 0, "total_cost": 0},
    "rep_logi_ontime": {"on_time_pct": 1},
}


def insights_sql() -> dict[str, str]:
    out = {}
    for industry in ("retail", "ecommerce", "banking", "healthcare", "saas", "logistics"):
        parts, needed = [], []
        for name, (i, tables, body) in KPI_SQL.items():
            if i != industry:
                continue
            needed += tables
            head = f"'{name.removeprefix('rep_')}' AS section, '{tables[0]}' AS table_name"
            if name in LABELS:
                label, value = LABELS[name]
                parts.append(f"SELECT {head}, {label}::VARCHAR AS metric, {value}::VARCHAR AS value FROM ({body})")
            else:
                for c, is_double in COLUMNS[name].items():
                    text = f"{c}::DECIMAL(38,2)::VARCHAR" if is_double else f"{c}::VARCHAR"
                    parts.append(f"SELECT {head}, '{c}' AS metric, {text} AS value FROM ({body})")
        out[f"rep_insights_{industry}"] = with_tables(industry, needed, " UNION ALL ".join(parts))
    return out


def draw_sql() -> dict[str, str]:
    nc = "(SELECT count(*) FROM customer)"
    growth = 1.05
    m = "((year(e) - year(s)) * 12 + month(e) - month(s) + 1)"
    g = drawn(rows("(SELECT count(*) FROM lineitem)"), "retail.fact_sales", "id + 1", ["date_key", "date_key:day"])
    return {
        "growth_curve": f"""
            WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n_orders FROM orders GROUP BY 1)
            SELECT month, n_orders, floor((SELECT arg_min(n_orders, month) FROM o)::DOUBLE * pow({growth}::DOUBLE,
                   date_diff('month', (SELECT min(month) FROM o), month)::DOUBLE))::BIGINT AS expected_orders FROM o""",
        "growth_dates": f"""
            WITH {WINDOW}, g AS (SELECT id, s, e, h_date_key_day AS hd, date_trunc('month', s)::DATE AS s0,
              least(greatest(floor(ln(1.0::DOUBLE + (h_date_key::DOUBLE / {SPAN}::DOUBLE) * (pow({growth}::DOUBLE, {m}) - 1.0::DOUBLE))
                    / ln({growth}::DOUBLE))::INTEGER, 0), {m} - 1)::INTEGER AS k FROM ({g}), win),
            b AS (SELECT *, greatest((s0 + to_months(k))::DATE, s) AS lo, least(last_day((s0 + to_months(k))::DATE), e) AS hi FROM g)
            SELECT id + 1 AS sale_id, 1 + date_diff('day', s, lo) + hd % (date_diff('day', lo, hi) + 1) AS date_key FROM b""",
        "draw_skewed_keys": f"""
            SELECT {skew('h_customer', nc, 'draws', 'customer')} AS customer_key, count(*) AS n_draws
            FROM ({drawn('SELECT o_orderkey FROM orders', 'draws', 'o_orderkey', ['customer'])}) GROUP BY 1""",
        "draw_sample": f"""
            SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY h, o_orderkey) AS position
            FROM ({key_drawn('SELECT * FROM orders', 'sample', 'o_orderkey', 'h')})
            QUALIFY position <= (SELECT count(*) FROM orders) // 10""",
        "draw_primitives": f"""
            SELECT o_orderkey, {between('h_int', -5, 5)} AS int_draw, {money(between('h_money', 100, 99999))} AS money_draw,
                   {choice('h_choice', ['a', 'b', 'c'])} AS choice_draw, {weighted('h_weighted', {'x': 70, 'y': 20, 'z': 10})} AS weighted_draw,
                   {chance('h_chance', 0.05)} AS chance_draw, h_first % 30 AS pair_first,
                   (h_first % 30 + 1 + h_second % 29) % 30 AS pair_second, 'Q' || quarter(o_orderdate) AS quarter,
                   printf('ORD-%06d', o_orderkey) AS order_label
            FROM ({drawn('SELECT * FROM orders', 'draws', 'o_orderkey', ['int', 'money', 'choice', 'weighted', 'chance', 'first', 'second'])})""",
    }


def report_sql() -> dict[str, str]:
    out = {n: with_tables(i, t, q) for n, (i, t, q) in {**KPI_SQL, **QUERY_SQL}.items()}
    out.update(insights_sql())
    out.update(draw_sql())
    columns = {
        "retail": {"dim_date": 12, "dim_customer": 10, "dim_product": 7, "dim_store": 9, "fact_sales": 9, "fact_inventory": 6},
        "ecommerce": {"dim_date": 12, "dim_customer": 10, "dim_product": 6, "dim_channel": 3, "fact_orders": 7, "fact_order_items": 6, "fact_web_events": 7},
        "banking": {"dim_date": 12, "dim_customer": 11, "dim_account": 7, "dim_branch": 6, "fact_transactions": 8, "fact_loans": 10, "fact_cards": 7},
        "healthcare": {"dim_date": 12, "dim_patient": 10, "dim_doctor": 6, "dim_hospital": 7, "dim_diagnosis": 4, "fact_encounters": 9, "fact_procedures": 6, "fact_billing": 7},
        "saas": {"dim_date": 12, "dim_customer": 7, "dim_plan": 5, "dim_product": 3, "fact_subscriptions": 7, "fact_usage": 7, "fact_churn": 7},
        "logistics": {"dim_date": 12, "dim_route": 7, "dim_vehicle": 7, "dim_warehouse": 7, "fact_shipments": 9, "fact_deliveries": 7, "fact_fleet_usage": 7},
    }
    for industry, tables in columns.items():
        parts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {c} AS n_columns FROM {t}" for t, c in tables.items())
        out[f"dataset_summary_{industry}"] = with_tables(
            industry, list(tables),
            f"SELECT * FROM ({parts}) UNION ALL SELECT 'Total', sum(n_rows)::BIGINT, NULL FROM ({parts})")
    return out
