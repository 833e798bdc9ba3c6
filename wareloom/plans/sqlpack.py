"""The SQL queries of the report, run through ``spark.sql`` on given tables.

``{name}`` placeholders are bound to DataFrames, so no view stays in the catalog.
A key closes every ORDER BY that a LIMIT depends on. Facts are summed per foreign key
before they meet a dimension, so a hot key reaches the join as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RETAIL_TOP_STORES = """
WITH f AS (SELECT store_key, SUM(revenue) AS revenue FROM {fact_sales} GROUP BY store_key)
SELECT s.store_key, s.store_name, s.city, CAST(SUM(f.revenue) AS DECIMAL(38,2)) AS total_revenue
FROM f JOIN {dim_store} s ON f.store_key = s.store_key
GROUP BY s.store_key, s.store_name, s.city
ORDER BY total_revenue DESC, s.store_key
LIMIT 10"""

_DAILY = """
WITH f AS (
  SELECT date_key, COUNT(order_id) AS orders, SUM(order_value) AS gmv, COUNT(order_value) AS valued
  FROM {fact_orders} GROUP BY date_key),
daily AS (
  SELECT d.full_date, SUM(f.orders) AS orders, CAST(SUM(f.gmv) AS DECIMAL(38,2)) AS gmv, SUM(f.valued) AS valued
  FROM f JOIN {dim_date} d ON f.date_key = d.date_key
  GROUP BY d.full_date)"""

ECOM_DAILY = _DAILY + """
SELECT full_date, orders, gmv, CAST(gmv AS DOUBLE) / valued AS aov
FROM daily ORDER BY full_date"""

# The title of the daily query promises a moving average; this variant has one. Its
# window sees one row per calendar day, at most 1801.
ECOM_MOVING = _DAILY + """
SELECT full_date, gmv, CAST(SUM(gmv) OVER w AS DOUBLE) / COUNT(gmv) OVER w AS gmv_7d
FROM daily
WINDOW w AS (ORDER BY full_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""

BANK_CUSTOMER = """
WITH t AS (
  SELECT account_key, COUNT(transaction_id) AS txn_count,
         SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS deposits,
         SUM(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS withdrawals
  FROM {fact_transactions} GROUP BY account_key)
SELECT c.customer_id, SUM(t.txn_count) AS txn_count,
       CAST(SUM(t.deposits) AS DECIMAL(38,2)) AS deposits,
       CAST(SUM(t.withdrawals) AS DECIMAL(38,2)) AS withdrawals
FROM t
JOIN {dim_account} a ON t.account_key = a.account_key
JOIN {dim_customer} c ON a.customer_key = c.customer_key
GROUP BY c.customer_id"""

HEALTH_COSTLY_DX = """
WITH e AS (
  SELECT diagnosis_key, COUNT(encounter_id) AS n, SUM(total_charges) AS charges, COUNT(total_charges) AS charged
  FROM {fact_encounters} GROUP BY diagnosis_key)
SELECT x.diagnosis_key, x.diagnosis_description, SUM(e.n) AS encounter_count,
       CAST(SUM(e.charges) AS DOUBLE) / SUM(e.charged) AS avg_charges,
       CAST(SUM(e.charges) AS DECIMAL(38,2)) AS total_charges
FROM e JOIN {dim_diagnosis} x ON e.diagnosis_key = x.diagnosis_key
GROUP BY x.diagnosis_key, x.diagnosis_description
ORDER BY total_charges DESC, x.diagnosis_key
LIMIT 10"""

SAAS_MRR = """
WITH s AS (
  SELECT snapshot_date_key, customer_key, SUM(mrr) AS mrr
  FROM {fact_subscriptions} WHERE status = 'Active'
  GROUP BY snapshot_date_key, customer_key)
SELECT d.year, d.month, CAST(SUM(s.mrr) AS DECIMAL(38,2)) AS total_mrr,
       COUNT(DISTINCT s.customer_key) AS active_customers
FROM s JOIN {dim_date} d ON s.snapshot_date_key = d.date_key
GROUP BY d.year, d.month
ORDER BY d.year, d.month"""

LOGI_ROUTES = """
WITH f AS (
  SELECT s.route_key, COUNT(s.shipment_id) AS shipments, COUNT(*) AS n,
         SUM(s.shipping_cost) AS cost, COUNT(s.shipping_cost) AS costed,
         SUM(d.actual_transit_days) AS days, COUNT(d.actual_transit_days) AS timed,
         SUM(CASE WHEN d.on_time THEN 1 ELSE 0 END) AS on_time
  FROM {fact_shipments} s JOIN {fact_deliveries} d ON s.shipment_id = d.shipment_id
  GROUP BY s.route_key)
SELECT r.route_key, r.origin_city, r.destination_city, SUM(f.shipments) AS shipment_count,
       CAST(SUM(f.cost) AS DOUBLE) / SUM(f.costed) AS avg_cost,
       CAST(SUM(f.days) AS DOUBLE) / nullif(SUM(f.timed), 0) AS avg_days,
       CAST(SUM(f.on_time) AS DOUBLE) * 100 / SUM(f.n) AS on_time_pct
FROM f JOIN {dim_route} r ON f.route_key = r.route_key
GROUP BY r.route_key, r.origin_city, r.destination_city
ORDER BY shipment_count DESC, r.route_key"""

# name -> (industry, tables read, text)
QUERIES = {
    "sql_retail_top_stores": ("retail", ["fact_sales", "dim_store"], RETAIL_TOP_STORES),
    "sql_ecom_daily": ("ecommerce", ["fact_orders", "dim_date"], ECOM_DAILY),
    "sql_ecom_moving": ("ecommerce", ["fact_orders", "dim_date"], ECOM_MOVING),
    "sql_bank_customer": ("banking", ["fact_transactions", "dim_account", "dim_customer"], BANK_CUSTOMER),
    "sql_health_costly_dx": ("healthcare", ["fact_encounters", "dim_diagnosis"], HEALTH_COSTLY_DX),
    "sql_saas_mrr": ("saas", ["fact_subscriptions", "dim_date"], SAAS_MRR),
    "sql_logi_routes": ("logistics", ["fact_shipments", "dim_route", "fact_deliveries"], LOGI_ROUTES),
}


def run(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One of the named queries on tables of its industry."""
    _, needed, text = QUERIES[name]
    return spark.sql(text, **{t: tables[t] for t in needed})
