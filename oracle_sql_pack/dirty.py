"""DuckDB twins of the missing cells in dirtied data sets."""

from __future__ import annotations

from oracle_sql_pack.base import chance, drawn, key_drawn
from oracle_sql_pack.generated import with_tables

RATE = 0.10
#: Share of cells that go missing, by kind of table, and the greatest share of a column.
DIMENSION, FACT, MOST = 0.3, 0.5, 0.2
CALENDAR = (12, "date_key", "full_date quarter month_name day_name", "year month week day day_of_week is_weekend is_holiday")

#: Of each table: number of columns, row key, then the columns that may be dirtied, those landing as text and the others.
TABLES = {
    "retail": {
        "dim_date": CALENDAR,
        "dim_customer": (10, "customer_key", "first_name last_name gender city state loyalty_tier signup_date", "age"),
        "dim_product": (7, "product_key", "sku product_name category brand", "unit_price unit_cost"),
        "dim_store": (9, "store_key", "store_name city state region format open_date", "sqft"),
        "fact_sales": (9, "sale_id", "", "quantity unit_price discount revenue"),
        "fact_inventory": (6, "(product_key - 1) * (SELECT count(*) FROM dim_store) + store_key", "", "stock_on_hand reorder_level is_low_stock"),
    },
    "ecommerce": {
        "dim_date": CALENDAR,
        "dim_customer": (10, "customer_key", "email first_name last_name city state country signup_date acquisition_channel", ""),
        "dim_product": (6, "product_key", "product_name category brand", "unit_price"),
        "dim_channel": (3, "channel_key", "channel_name platform", ""),
        "fact_orders": (7, "order_id", "status", "order_value shipping_cost"),
        "fact_order_items": (6, "item_id", "", "quantity unit_price line_total"),
        "fact_web_events": (7, "event_id", "event_type", ""),
    },
    "banking": {
        "dim_date": CALENDAR,
        "dim_customer": (11, "customer_key", "first_name last_name date_of_birth ssn_last4 city state customer_since segment", "credit_score"),
        "dim_account": (7, "account_key", "account_type open_date status", "current_balance"),
        "dim_branch": (6, "branch_key", "branch_name city state region", ""),
        "fact_transactions": (8, "transaction_id", "transaction_type channel reference", "amount"),
        "fact_loans": (10, "loan_id", "loan_type status", "principal interest_rate term_months monthly_payment"),
        "fact_cards": (7, "card_txn_id", "merchant_category card_type", "amount is_international"),
    },
    "healthcare": {
        "dim_date": CALENDAR,
        "dim_patient": (10, "patient_key", "first_name last_name date_of_birth gender blood_type city state insurance_type", ""),
        "dim_doctor": (6, "doctor_key", "first_name last_name specialty", "years_experience"),
        "dim_hospital": (7, "hospital_key", "hospital_name city state hospital_type", "bed_count"),
        "dim_diagnosis": (4, "diagnosis_key", "icd10_code diagnosis_description category", ""),
        "fact_encounters": (9, "encounter_id", "visit_type", "length_of_stay total_charges"),
        "fact_procedures": (6, "procedure_id", "cpt_code procedure_description", "charge_amount"),
        "fact_billing": (7, "billing_id", "claim_status", "total_charges allowed_amount paid_amount patient_responsibility"),
    },
    "saas": {
        "dim_date": CALENDAR,
        "dim_customer": (7, "customer_key", "company_name industry country signup_date", "employee_count"),
        "dim_plan": (5, "plan_key", "plan_name features", "monthly_price annual_price"),
        "dim_product": (3, "product_key", "product_name category", ""),
        "fact_subscriptions": (7, "customer_key * 1048576 + snapshot_date_key", "status", "mrr arr seats"),
        "fact_usage": (7, "usage_id", "feature", "logins api_calls data_storage_mb"),
        "fact_churn": (7, "churn_id", "reason", "mrr_lost tenure_months"),
    },
    "logistics": {
        "dim_date": CALENDAR,
        "dim_route": (7, "route_key", "origin_city destination_city route_type", "distance_miles transit_days"),
        "dim_vehicle": (7, "vehicle_key", "vehicle_type fuel_type status", "capacity_lbs year"),
        "dim_warehouse": (7, "warehouse_key", "warehouse_name city state warehouse_type", "sqft"),
        "fact_shipments": (9, "shipment_id", "", "weight_lbs distance_miles shipping_cost"),
        "fact_deliveries": (7, "delivery_id", "delivery_status", "expected_transit_days actual_transit_days on_time delivery_attempts"),
        "fact_fleet_usage": (7, "usage_id", "", "miles_driven fuel_gallons hours_operated maintenance_flag"),
    },
}
#: Row keys that do not count 1, 2, 3, ...: their rows are numbered in hash order before some of them are repeated.
SPARSE = {"fact_subscriptions", "fact_churn"}
#: Keys that are missing by nature.
OPTIONAL = {"fact_web_events": ["product_key"]}


def null_rate(column: str, dimension: bool) -> float:
    p = RATE * (DIMENSION if dimension else FACT)
    if any(w in column for w in ("phone", "fax", "middle")):
        p *= 2
    elif any(w in column for w in ("name", "email", "id")):
        p *= 0.3
    return min(p, MOST)


def _rows(table: str, key: str) -> str:
    """A table's rows with _row_key and, for facts, the repeated ones with their copy number."""
    source = f"SELECT *, ({key})::BIGINT AS _row_key FROM {table}"
    if table.startswith("dim_"):
        return source
    if table in SPARSE:
        number = "_no"
        source = (f"SELECT * EXCLUDE (h), row_number() OVER (ORDER BY h, _row_key) - 1 AS _no "
                  f"FROM ({key_drawn(source, 'quality.row order', '_row_key', 'h')})")
    else:
        number = "_row_key - 1"
    n = f"(SELECT count(*) FROM {table})"
    picks = key_drawn(f"SELECT unnest(range(floor({n} * {RATE * 0.02}::DOUBLE)::BIGINT)) AS id", "quality.duplicates", "id", "h")
    times = f"SELECT pick, row_number() OVER (PARTITION BY pick ORDER BY id) AS c FROM (SELECT id, h % {n} AS pick FROM ({picks}))"
    return (f"SELECT t.*, 0::BIGINT AS _copy_no FROM ({source}) t UNION ALL "
            f"SELECT t.*, c AS _copy_no FROM ({source}) t JOIN ({times}) p ON {number} = p.pick")


def _missing(table: str, columns: int, key: str, texts: str, others: str) -> str:
    dimension = table.startswith("dim_")
    names = [*texts.split(), *others.split()]
    source = drawn(_rows(table, key), "quality", "_row_key", [f"null:{c}" for c in names], sub=None if dimension else "_copy_no")
    nulls, spelled = [f"({c} IS NULL)::INTEGER" for c in OPTIONAL.get(table, [])] or ["0"], ["0"]
    for c in names:
        h = f"h_null_{c}"
        hit = chance(h, null_rate(c, dimension))
        if c in texts.split():
            nulls.append(f"CASE WHEN {hit} THEN ({h} % 100 < 55)::INTEGER ELSE ({c} IS NULL)::INTEGER END")
            spelled.append(f"({hit} AND {h} % 100 >= 55)::INTEGER")
        else:
            nulls.append(f"({hit} OR {c} IS NULL)::INTEGER")
    return f"""SELECT '{table}' AS table_name, sum({' + '.join(nulls)})::BIGINT AS n_missing, sum({' + '.join(spelled)})::BIGINT AS n_sentinels,
        (count(*) * {columns})::BIGINT AS n_cells FROM ({source})"""


def dirty_sql() -> dict[str, str]:
    out = {}
    for industry, tables in TABLES.items():
        parts = " UNION ALL ".join(_missing(t, *spec) for t, spec in tables.items())
        out[f"dataset_dirty_{industry}"] = with_tables(
            industry, list(tables),
            f"SELECT *, CASE WHEN n_cells > 0 THEN n_missing::DOUBLE * 100 / n_cells ELSE 0.0 END AS pct_missing FROM ({parts})")
    return out
