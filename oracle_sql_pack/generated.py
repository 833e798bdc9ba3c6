"""SQL definitions of the 42 generated tables over the driver tables' row counts.

Lookups are written as joins here, while the Spark side recomputes them from the
key, so both sides check each other.
"""

from __future__ import annotations

from oracle_sql_pack.base import (
    WINDOW, between, chance, choice, day, drawn, money, pick, rows, share, skew, key_drawn, weighted,
)
from wareloom.functions import pools
from wareloom.plans import banking, ecommerce, healthcare, logistics, retail, saas

# Row counts of each generated data set, as SQL over the driver tables.
N = {
    "retail": {
        "customers": "(SELECT count(*) FROM customer)", "products": "(SELECT count(*) FROM part)",
        "stores": "(SELECT count(*) FROM supplier)", "transactions": "(SELECT count(*) FROM lineitem)",
    },
    "ecommerce": {
        "customers": "(SELECT count(*) FROM customer)", "products": "(SELECT count(*) FROM part)",
        "orders": "(SELECT count(*) FROM orders)",
    },
    "banking": {
        "customers": "(SELECT count(*) FROM customer)", "accounts": "(SELECT count(*) FROM part)",
        "branches": "(SELECT count(*) FROM supplier)", "transactions": "(SELECT count(*) FROM orders)",
    },
    "healthcare": {
        "patients": "(SELECT count(*) FROM customer)", "doctors": "(SELECT count(*) FROM supplier)",
        "hospitals": "(SELECT count(*) FROM supplier)", "encounters": "(SELECT count(*) FROM orders)",
    },
    "saas": {"customers": "(SELECT count(*) FROM customer)"},
    "logistics": {
        "routes": "(SELECT count(*) FROM part)", "vehicles": "(SELECT count(*) FROM supplier)",
        "warehouses": "(SELECT count(*) FROM supplier)", "shipments": "(SELECT count(*) FROM orders)",
    },
}

E_, S_, D_ = "(SELECT e FROM win)", "(SELECT s FROM win)", "(SELECT d FROM win)"


def back(days: int) -> str:
    return f"(({S_} - {days})::DATE)"


def years(n: int) -> str:
    return f"(({E_} - INTERVAL {n} YEAR)::DATE)"


def date_key(h: str = "h_date_key") -> str:
    return f"1 + {h} % {D_}"


def padded(prefix: str, key: str, width: int) -> str:
    return f"printf('{prefix}-%0{width}d', {key})"


NAMES = f"{choice('h_first_name', pools.FIRST_NAMES)} AS first_name, {choice('h_last_name', pools.LAST_NAMES)} AS last_name"
PLACE = f"{choice('h_city', pools.CITIES)} AS city, {choice('h_state', pools.STATES)} AS state"
PRODUCT_NAME = (f"{choice('h_word', pools.WORDS)} || ' ' || category[1:4] || ' ' || "
                f"{between('h_model', 100, 999)}::VARCHAR AS product_name")

DIM_DATE = f"""
SELECT id + 1 AS date_key, f AS full_date, year(f)::INTEGER AS year, 'Q' || quarter(f) AS quarter,
       month(f)::INTEGER AS month, strftime(f, '%B') AS month_name, week(f)::INTEGER AS week,
       day(f)::INTEGER AS day, (isodow(f) - 1)::INTEGER AS day_of_week, strftime(f, '%A') AS day_name,
       isodow(f) >= 6 AS is_weekend, month(f) = 12 AND day(f) IN (24, 25, 31) AS is_holiday
FROM (SELECT id, ({S_} + id::INTEGER)::DATE AS f FROM ({rows(D_)}))"""


def _table(industry: str, table: str, n: str, cols: list[str], select: str, key: str = "id + 1", src: str | None = None) -> str:
    return f"SELECT {select} FROM ({drawn(src or rows(n), f'{industry}.{table}', key, cols)})"


def _retail(stores: str) -> dict[str, str]:
    n = N["retail"]
    return {
        "dim_date": DIM_DATE,
        "dim_customer": _table(
            "retail", "dim_customer", n["customers"],
            ["first_name", "last_name", "age", "gender", "city", "state", "loyalty_tier", "signup_date"],
            f"""id + 1 AS customer_key, {padded('CUST', 'id + 1', 6)} AS customer_id, {NAMES},
            {between('h_age', 18, 75)}::INTEGER AS age, {choice('h_gender', ['M', 'F'])} AS gender, {PLACE},
            {weighted('h_loyalty_tier', retail.LOYALTY)} AS loyalty_tier,
            {day(back(365), E_, 'h_signup_date')} AS signup_date"""),
        "dim_product": f"""
        SELECT product_key, sku, product_name, category, brand, {money('price')} AS unit_price,
               {money(share('price', between('h_cost_ratio', 4000, 7000)))} AS unit_cost
        FROM (SELECT *, {PRODUCT_NAME} FROM (""" + _table(
            "retail", "dim_product", n["products"],
            ["category", "unit_price", "word", "model", "brand", "cost_ratio"],
            f"""id + 1 AS product_key, {padded('SKU', 'id + 1', 6)} AS sku,
            {choice('h_category', retail.CATEGORIES)} AS category, {choice('h_brand', pools.LAST_NAMES)} AS brand,
            {between('h_unit_price', 500, 50000)} AS price, h_word, h_model, h_cost_ratio""") + "))",
        "dim_store": _table(
            "retail", "dim_store", stores,
            ["name_city", "name_format", "city", "state", "region", "format", "sqft", "open_date"],
            f"""id + 1 AS store_key, {padded('STR', 'id + 1', 4)} AS store_id,
            {choice('h_name_city', pools.CITIES)} || ' ' || {choice('h_name_format', retail.STORE_FORMATS)} AS store_name,
            {PLACE}, {choice('h_region', retail.REGIONS)} AS region, {choice('h_format', retail.STORE_FORMATS)} AS format,
            {between('h_sqft', 5000, 50000)}::INTEGER AS sqft, {day(back(1825), S_, 'h_open_date')} AS open_date"""),
        "fact_sales": f"""
        SELECT sale_id, f.date_key, customer_key, f.product_key, store_key, qty::INTEGER AS quantity, p.unit_price,
               {money('disc')} AS discount, {money('gross - disc')} AS revenue
        FROM (SELECT f.*, gross, {share('gross', 'rate')} AS disc FROM (""" + _table(
            "retail", "fact_sales", n["transactions"],
            ["date_key", "customer_key", "product_key", "store_key", "quantity", "discount_rate"],
            f"""id + 1 AS sale_id, {date_key()} AS date_key,
            {skew('h_customer_key', n['customers'], 'retail.fact_sales', 'customer_key')} AS customer_key,
            {skew('h_product_key', n['products'], 'retail.fact_sales', 'product_key')} AS product_key,
            1 + h_store_key % {stores} AS store_key, {between('h_quantity', 1, 10)} AS qty,
            {between('h_discount_rate', 0, 2000)} AS rate""") + """) f
          JOIN dim_product USING (product_key), LATERAL (SELECT (unit_price * 100)::BIGINT * qty AS gross)) f
        JOIN dim_product p USING (product_key)""",
        "fact_inventory": _table(
            "retail", "fact_inventory", "", ["stock_on_hand", "reorder_level"],
            f"""product_key, store_key, {D_}::BIGINT AS date_key,
            {between('h_stock_on_hand', 0, 500)}::INTEGER AS stock_on_hand,
            {between('h_reorder_level', 20, 100)}::INTEGER AS reorder_level,
            {between('h_stock_on_hand', 0, 500)} < {between('h_reorder_level', 20, 100)} AS is_low_stock""",
            key=f"(product_key - 1) * {stores} + store_key - 1",
            src="SELECT product_key, store_key FROM dim_product, dim_store"),
    }


def _ecommerce() -> dict[str, str]:
    n = N["ecommerce"]
    channels = ", ".join(f"({k}::BIGINT, '{a}', '{b}')" for k, a, b in ecommerce.CHANNELS)
    lines = drawn("SELECT * FROM order_lines", "ecommerce.fact_order_items", "order_id * 8 + line",
                  ["product_key", "quantity"])
    return {
        "dim_date": DIM_DATE,
        "dim_customer": f"""
        SELECT customer_key, customer_id,
               lower(regexp_replace(first_name || '.' || last_name, '[^A-Za-z.]', '', 'g')) || mail AS email,
               first_name, last_name, city, state, 'USA' AS country, signup_date, acquisition_channel FROM (""" + _table(
            "ecommerce", "dim_customer", n["customers"],
            ["first_name", "last_name", "email_number", "email_domain", "city", "state", "signup_date", "acquisition_channel"],
            f"""id + 1 AS customer_key, {padded('CUST', 'id + 1', 6)} AS customer_id, {NAMES}, {PLACE},
            {between('h_email_number', 1, 9999)}::VARCHAR || '@' || {choice('h_email_domain', pools.EMAIL_DOMAINS)} AS mail,
            {day(back(365), E_, 'h_signup_date')} AS signup_date,
            {choice('h_acquisition_channel', ecommerce.ACQUISITION)} AS acquisition_channel""") + ")",
        "dim_product": f"""
        SELECT product_key, product_id, {PRODUCT_NAME}, category, brand, {money('price')} AS unit_price FROM (""" + _table(
            "ecommerce", "dim_product", n["products"], ["category", "unit_price", "word", "model", "brand"],
            f"""id + 1 AS product_key, {padded('PROD', 'id + 1', 6)} AS product_id,
            {choice('h_category', ecommerce.CATEGORIES)} AS category, {choice('h_brand', pools.LAST_NAMES)} AS brand,
            {between('h_unit_price', 1000, 100000)} AS price, h_word, h_model""") + ")",
        "dim_channel": f"SELECT * FROM (VALUES {channels}) AS t(channel_key, channel_name, platform)",
        "order_lines": f"""
        SELECT order_id, unnest(range(1, n_items + 1)) AS line, n_items
        FROM (SELECT id + 1 AS order_id, 1 + w % 5 AS n_items
              FROM ({key_drawn(rows(n['orders']), 'ecommerce.fact_orders.n_items', 'id + 1', 'w')}))""",
        "fact_order_items": f"""
        SELECT row_number() OVER (ORDER BY order_id, line) AS item_id, order_id, product_key, qty::INTEGER AS quantity,
               unit_price, (unit_price * qty)::DECIMAL(18,2) AS line_total
        FROM (SELECT order_id, line, {between('h_quantity', 1, 3)} AS qty,
              {skew('h_product_key', n['products'], 'ecommerce.fact_order_items', 'product_key')} AS product_key
              FROM ({lines})) JOIN dim_product USING (product_key)""",
        "fact_orders": """
        SELECT o.* EXCLUDE (order_value), v.order_value, FROM (""" + _table(
            "ecommerce", "fact_orders", n["orders"],
            ["date_key", "customer_key", "channel_key", "shipping_cost", "status"],
            f"""id + 1 AS order_id, {date_key()} AS date_key,
            {skew('h_customer_key', n['customers'], 'ecommerce.fact_orders', 'customer_key')} AS customer_key,
            {between('h_channel_key', 1, 5)} AS channel_key, 0 AS order_value,
            {money(between('h_shipping_cost', 0, 1500))} AS shipping_cost,
            {weighted('h_status', ecommerce.ORDER_STATUS)} AS status""") + """) o
        LEFT JOIN (SELECT order_id, sum(line_total)::DECIMAL(18,2) AS order_value
                   FROM fact_order_items GROUP BY order_id) v USING (order_id)""",
        "fact_web_events": _table(
            "ecommerce", "fact_web_events", f"{n['orders']} * 10",
            ["date_key", "customer_key", "no_product", "product_key", "channel_key", "event_type", "session_id"],
            f"""id + 1 AS event_id, {date_key()} AS date_key,
            {skew('h_customer_key', n['customers'], 'ecommerce.fact_web_events', 'customer_key')} AS customer_key,
            CASE WHEN NOT {chance('h_no_product', 0.3)} THEN
            {skew('h_product_key', n['products'], 'ecommerce.fact_web_events', 'product_key')} END AS product_key,
            {between('h_channel_key', 1, 5)} AS channel_key, {weighted('h_event_type', ecommerce.EVENT_TYPES)} AS event_type,
            'SES-' || {between('h_session_id', 100000, 999999)}::VARCHAR AS session_id"""),
    }


def _banking() -> dict[str, str]:
    n = N["banking"]

    def ladder(col, part, unit):
        terms = banking.LOAN_TERMS
        def one(k):
            v = terms[k][part]
            if part == 2:
                return f"({list(v)})[h_{col} % {len(v)} + 1]"
            return f"({v[0] * unit} + h_{col} % {(v[1] - v[0]) * unit + 1})"
        return f"CASE loan_type WHEN 'Mortgage' THEN {one('Mortgage')} WHEN 'Auto' THEN {one('Auto')} ELSE {one(None)} END"

    return {
        "dim_date": DIM_DATE,
        "dim_customer": _table(
            "banking", "dim_customer", n["customers"],
            ["first_name", "last_name", "date_of_birth", "ssn_last4", "city", "state", "credit_score", "customer_since", "segment"],
            f"""id + 1 AS customer_key, {padded('CIF', 'id + 1', 8)} AS customer_id, {NAMES},
            {day(f'(({years(81)} + 1)::DATE)', years(18), 'h_date_of_birth')} AS date_of_birth,
            {between('h_ssn_last4', 1000, 9999)}::VARCHAR AS ssn_last4, {PLACE},
            {between('h_credit_score', 300, 850)}::INTEGER AS credit_score,
            {day(back(3650), S_, 'h_customer_since')} AS customer_since,
            {weighted('h_segment', banking.SEGMENTS)} AS segment"""),
        "dim_account": _table(
            "banking", "dim_account", n["accounts"],
            ["customer_key", "account_type", "open_date", "status", "current_balance"],
            f"""id + 1 AS account_key, {padded('ACCT', 'id + 1', 10)} AS account_id,
            1 + h_customer_key % {n['customers']} AS customer_key,
            {choice('h_account_type', banking.ACCOUNT_TYPES)} AS account_type,
            {day(back(1825), E_, 'h_open_date')} AS open_date, {weighted('h_status', banking.ACCOUNT_STATUS)} AS status,
            {money(between('h_current_balance', 10000, 10000000))} AS current_balance"""),
        "dim_branch": _table(
            "banking", "dim_branch", n["branches"], ["name_city", "city", "state", "region"],
            f"""id + 1 AS branch_key, {padded('BR', 'id + 1', 4)} AS branch_id,
            {choice('h_name_city', pools.CITIES)} || ' Branch' AS branch_name, {PLACE},
            {choice('h_region', banking.BRANCH_REGIONS)} AS region"""),
        "fact_transactions": f"""
        SELECT * EXCLUDE (cents), CASE WHEN transaction_type IN ('Withdrawal', 'Payment', 'Fee')
               THEN -{money('cents')} ELSE {money('cents')} END AS amount FROM (""" + _table(
            "banking", "fact_transactions", n["transactions"],
            ["date_key", "account_key", "branch_key", "transaction_type", "amount", "channel", "reference"],
            f"""id + 1 AS transaction_id, {date_key()} AS date_key,
            {skew('h_account_key', n['accounts'], 'banking.fact_transactions', 'account_key')} AS account_key,
            1 + h_branch_key % {n['branches']} AS branch_key,
            {weighted('h_transaction_type', banking.TXN_TYPES)} AS transaction_type,
            {between('h_amount', 1000, 500000)} AS cents, {choice('h_channel', banking.TXN_CHANNELS)} AS channel,
            'REF-' || {between('h_reference', 100000000, 999999999)}::VARCHAR AS reference""") + ")",
        "fact_loans": f"""
        SELECT loan_id, date_key, customer_key, branch_key, loan_type, {money('cents')} AS principal,
               (rate::DECIMAL(9,2) / 100)::DECIMAL(5,2) AS interest_rate, term::INTEGER AS term_months,
               ((cents / 100.0::DOUBLE) * (rate / 120000.0::DOUBLE)
                / (1 - pow(1 + rate / 120000.0::DOUBLE, -term)))::DECIMAL(18,2) AS monthly_payment, status
        FROM (SELECT *, {ladder('principal', 0, 100)} AS cents, {ladder('interest_rate', 1, 1)} AS rate,
              {ladder('term_months', 2, 1)} AS term FROM (""" + _table(
            "banking", "fact_loans", f"{n['customers']} // 3",
            ["date_key", "customer_key", "branch_key", "loan_type", "principal", "interest_rate", "term_months", "status"],
            f"""id + 1 AS loan_id, {date_key()} AS date_key, 1 + h_customer_key % {n['customers']} AS customer_key,
            1 + h_branch_key % {n['branches']} AS branch_key, {choice('h_loan_type', banking.LOAN_TYPES)} AS loan_type,
            h_principal, h_interest_rate, h_term_months, {weighted('h_status', banking.LOAN_STATUS)} AS status""") + "))",
        "fact_cards": _table(
            "banking", "fact_cards", f"{n['transactions']} // 2",
            ["date_key", "customer_key", "merchant_category", "amount", "card_type", "is_international"],
            f"""id + 1 AS card_txn_id, {date_key()} AS date_key,
            {skew('h_customer_key', n['customers'], 'banking.fact_cards', 'customer_key')} AS customer_key,
            {choice('h_merchant_category', banking.MERCHANTS)} AS merchant_category,
            {money(between('h_amount', 500, 50000))} AS amount, {choice('h_card_type', ['Debit', 'Credit'])} AS card_type,
            {chance('h_is_international', 0.05)} AS is_international"""),
    }


def _healthcare() -> dict[str, str]:
    n = N["healthcare"]
    dx = ", ".join(f"({i + 1}::BIGINT, '{c}', '{t}', '{t.split()[0]}')" for i, (c, t) in enumerate(healthcare.DIAGNOSES))
    proc = drawn("SELECT * FROM encounter_lines", "healthcare.fact_procedures", "encounter_id * 8 + line",
                 ["procedure", "charge_amount"])
    return {
        "dim_date": DIM_DATE,
        "dim_patient": _table(
            "healthcare", "dim_patient", n["patients"],
            ["first_name", "last_name", "date_of_birth", "gender", "blood_type", "city", "state", "insurance_type"],
            f"""id + 1 AS patient_key, {padded('MRN', 'id + 1', 8)} AS patient_id, {NAMES},
            {day(f'(({years(91)} + 1)::DATE)', years(1), 'h_date_of_birth')} AS date_of_birth,
            {choice('h_gender', ['M', 'F'])} AS gender, {choice('h_blood_type', healthcare.BLOOD_TYPES)} AS blood_type,
            {PLACE}, {choice('h_insurance_type', healthcare.INSURANCE)} AS insurance_type"""),
        "dim_doctor": _table(
            "healthcare", "dim_doctor", n["doctors"],
            ["doctor_id", "first_name", "last_name", "specialty", "years_experience"],
            f"""id + 1 AS doctor_key, 'NPI-' || {between('h_doctor_id', 1000000000, 9999999999)}::VARCHAR AS doctor_id,
            {NAMES}, {choice('h_specialty', healthcare.SPECIALTIES)} AS specialty,
            {between('h_years_experience', 1, 35)}::INTEGER AS years_experience"""),
        "dim_hospital": _table(
            "healthcare", "dim_hospital", n["hospitals"],
            ["name_city", "name_word", "city", "state", "bed_count", "hospital_type"],
            f"""id + 1 AS hospital_key, {padded('HOSP', 'id + 1', 4)} AS hospital_id,
            {choice('h_name_city', pools.CITIES)} || ' ' || {choice('h_name_word', healthcare.HOSPITAL_WORDS)} AS hospital_name,
            {PLACE}, {between('h_bed_count', 50, 500)}::INTEGER AS bed_count,
            {choice('h_hospital_type', healthcare.HOSPITAL_TYPES)} AS hospital_type"""),
        "dim_diagnosis": f"SELECT * FROM (VALUES {dx}) AS t(diagnosis_key, icd10_code, diagnosis_description, category)",
        "fact_encounters": f"""
        SELECT * EXCLUDE (h_total_charges, stay),
               (CASE WHEN visit_type = 'Outpatient' THEN 0 ELSE stay END)::INTEGER AS length_of_stay,
               CASE WHEN visit_type = 'Outpatient' THEN {money(between('h_total_charges', 10000, 100000))}
                    ELSE {money(between('h_total_charges', 20000, 5000000))} END AS total_charges FROM (""" + _table(
            "healthcare", "fact_encounters", n["encounters"],
            ["date_key", "patient_key", "doctor_key", "hospital_key", "diagnosis_key", "visit_type", "length_of_stay", "total_charges"],
            f"""id + 1 AS encounter_id, {date_key()} AS date_key,
            {skew('h_patient_key', n['patients'], 'healthcare.fact_encounters', 'patient_key')} AS patient_key,
            1 + h_doctor_key % {n['doctors']} AS doctor_key, 1 + h_hospital_key % {n['hospitals']} AS hospital_key,
            {between('h_diagnosis_key', 1, 10)} AS diagnosis_key, {weighted('h_visit_type', healthcare.VISIT_TYPES)} AS visit_type,
            {between('h_length_of_stay', 1, 10)} AS stay, h_total_charges""") + ")",
        "encounter_lines": f"""
        SELECT encounter_id, unnest(range(1, k + 1)) AS line
        FROM (SELECT id + 1 AS encounter_id, 1 + w % 4 AS k FROM
              ({key_drawn(rows(n['encounters']), 'healthcare.fact_encounters.n_procedures', 'id + 1', 'w')}))""",
        "fact_procedures": f"""
        SELECT row_number() OVER (ORDER BY encounter_id, line) AS procedure_id, encounter_id, e.doctor_key,
               {pick([c for c, _ in healthcare.PROCEDURES], 'h_procedure % 7')} AS cpt_code,
               {pick([d for _, d in healthcare.PROCEDURES], 'h_procedure % 7')} AS procedure_description,
               {money(between('h_charge_amount', 5000, 200000))} AS charge_amount
        FROM ({proc}) JOIN fact_encounters e USING (encounter_id)""",
        "fact_billing": f"""
        SELECT encounter_id AS billing_id, encounter_id, total_charges, {money('allowed')} AS allowed_amount,
               {money('paid')} AS paid_amount, (total_charges - {money('paid')})::DECIMAL(18,2) AS patient_responsibility,
               {weighted('h_claim_status', healthcare.CLAIM_STATUS)} AS claim_status
        FROM (SELECT *, {share('allowed', between('h_paid_ratio', 7000, 10000))} AS paid
              FROM (SELECT *, {share('(total_charges * 100)::BIGINT', between('h_allowed_ratio', 3000, 8000))} AS allowed
                    FROM ({drawn('SELECT encounter_id, total_charges FROM fact_encounters', 'healthcare.fact_billing',
                                 'encounter_id', ['allowed_ratio', 'paid_ratio', 'claim_status'])})))""",
    }


def _saas() -> dict[str, str]:
    n = N["saas"]["customers"]
    plans = ", ".join(f"({k}::BIGINT, '{a}', {m}::DECIMAL(18,2), {y}::DECIMAL(18,2), '{f}')" for k, a, m, y, f in saas.PLANS)
    products = ", ".join(f"({k}::BIGINT, '{a}', '{c}')" for k, a, c in saas.PRODUCTS)
    snap = drawn("SELECT date_key, customer_key FROM dim_date JOIN dim_customer ON full_date >= signup_date WHERE day = 1",
                 "saas.fact_subscriptions", f"customer_key * {saas.KEY_DAYS} + date_key", ["plan_key", "status", "seats"])
    churn = drawn("""SELECT c.*, e FROM (SELECT customer_key, signup_date, row_number() OVER (ORDER BY h_churn_sample, customer_key) AS churn_id
                     FROM dim_customer_draws) c, win
                     WHERE churn_id <= floor((SELECT count(*) FROM dim_customer) * 0.15::DOUBLE) AND signup_date < e""",
                  "saas.fact_churn", "customer_key", ["churn_date", "plan_key", "reason"])
    cust = f"""id + 1 AS customer_key, {padded('ORG', 'id + 1', 6)} AS customer_id,
            {choice('h_company', pools.LAST_NAMES)} || ' ' || {choice('h_company_suffix', pools.COMPANY_SUFFIXES)} AS company_name,
            {choice('h_industry', saas.INDUSTRIES)} AS industry,
            {choice('h_employee_count', saas.EMPLOYEES)}::INTEGER AS employee_count,
            {choice('h_country', saas.COUNTRIES)} AS country, {day(back(730), E_, 'h_signup_date')} AS signup_date"""
    return {
        "dim_date": DIM_DATE,
        "dim_customer_draws": _table(
            "saas", "dim_customer", n,
            ["company", "company_suffix", "industry", "employee_count", "country", "signup_date", "churn_sample"],
            cust + ", h_churn_sample"),
        "dim_customer": "SELECT * EXCLUDE (h_churn_sample) FROM dim_customer_draws",
        "dim_plan": f"SELECT * FROM (VALUES {plans}) AS t(plan_key, plan_name, monthly_price, annual_price, features)",
        "dim_product": f"SELECT * FROM (VALUES {products}) AS t(product_key, product_name, category)",
        "fact_subscriptions": f"""
        SELECT date_key AS snapshot_date_key, customer_key, plan_key, monthly_price AS mrr,
               (monthly_price * 12)::DECIMAL(18,2) AS arr, {weighted('h_status', saas.SUB_STATUS)} AS status,
               (CASE WHEN plan_key > 1 THEN {between('h_seats', 1, 50)} ELSE 1 END)::INTEGER AS seats
        FROM (SELECT *, {weighted('h_plan_key', saas.PLAN_WEIGHTS)}::BIGINT AS plan_key FROM ({snap})) JOIN dim_plan USING (plan_key)""",
        "fact_usage": _table(
            "saas", "fact_usage", f"{n} * {D_} // 3",
            ["date_key", "customer_key", "feature", "logins", "api_calls", "data_storage_mb"],
            f"""id + 1 AS usage_id, {date_key()} AS date_key,
            {skew('h_customer_key', n, 'saas.fact_usage', 'customer_key')} AS customer_key,
            {choice('h_feature', saas.FEATURES)} AS feature, {between('h_logins', 1, 50)}::INTEGER AS logins,
            {between('h_api_calls', 0, 10000)}::INTEGER AS api_calls,
            {between('h_data_storage_mb', 10, 5000)}::INTEGER AS data_storage_mb"""),
        "fact_churn": f"""
        SELECT churn_id, date_diff('day', {S_}, churn_date) + 1 AS date_key, customer_key, plan_key,
               monthly_price AS mrr_lost, {choice('h_reason', saas.REASONS)} AS reason,
               (date_diff('day', signup_date, churn_date) // 30)::INTEGER AS tenure_months
        FROM (SELECT *, {between('h_plan_key', 1, 5)} AS plan_key,
              {day('(signup_date + 30)', 'e', 'h_churn_date')} AS churn_date FROM ({churn})) JOIN dim_plan USING (plan_key)
        WHERE churn_date BETWEEN {S_} AND {E_}""",
    }


def _logistics() -> dict[str, str]:
    n = N["logistics"]
    places = pools.CITIES[: pools.ROUTE_CITY_COUNT]
    fleet_src = f"""SELECT date_key, vehicle_key, position, row_number() OVER (ORDER BY date_key, vehicle_key) AS usage_id
        FROM ({key_drawn(f"SELECT date_key, vehicle_key, (date_key - 1) * {n['vehicles']} + vehicle_key - 1 AS position "
                          "FROM dim_date, dim_vehicle WHERE status = 'Active'",
                          'logistics.fact_fleet_usage.used', 'position', 'w')}) WHERE {chance('w', 0.7)}"""
    return {
        "dim_date": DIM_DATE,
        "dim_route": _table(
            "logistics", "dim_route", n["routes"],
            ["origin_city", "destination_city", "distance_miles", "transit_days", "route_type"],
            f"""id + 1 AS route_key, {padded('RT', 'id + 1', 5)} AS route_id,
            {pick(places, 'h_origin_city % 30')} AS origin_city,
            {pick(places, '(h_origin_city % 30 + 1 + h_destination_city % 29) % 30')} AS destination_city,
            {between('h_distance_miles', 50, 3000)}::INTEGER AS distance_miles,
            {between('h_transit_days', 1, 7)}::INTEGER AS transit_days, {choice('h_route_type', logistics.ROUTE_TYPES)} AS route_type"""),
        "dim_vehicle": f"""
        SELECT * EXCLUDE (w), {weighted('w', logistics.VEHICLE_STATUS)} AS status
        FROM (({key_drawn(_table(
            "logistics", "dim_vehicle", n["vehicles"], ["vehicle_type", "capacity_lbs", "fuel_type", "year"],
            f"id + 1 AS vehicle_key, {padded('VH', 'id + 1', 5)} AS vehicle_id, "
            f"{choice('h_vehicle_type', logistics.VEHICLE_TYPES)} AS vehicle_type, "
            f"{between('h_capacity_lbs', 1000, 100000)}::INTEGER AS capacity_lbs, "
            f"{choice('h_fuel_type', logistics.FUELS)} AS fuel_type, {between('h_year', 2015, 2024)}::INTEGER AS year"),
            'logistics.dim_vehicle.status', 'vehicle_key', 'w')}))""",
        "dim_warehouse": _table(
            "logistics", "dim_warehouse", n["warehouses"], ["name_city", "city", "state", "sqft", "warehouse_type"],
            f"""id + 1 AS warehouse_key, {padded('WH', 'id + 1', 4)} AS warehouse_id,
            {choice('h_name_city', pools.CITIES)} || ' DC' AS warehouse_name, {PLACE},
            {between('h_sqft', 50000, 500000)}::INTEGER AS sqft, {choice('h_warehouse_type', logistics.WAREHOUSE_TYPES)} AS warehouse_type"""),
        "fact_shipments": f"""
        SELECT shipment_id, date_key, route_key, vehicle_key, origin_warehouse_key, dest_warehouse_key,
               weight::INTEGER AS weight_lbs, r.distance_miles, {money('(weight * rate + 50) // 100')} AS shipping_cost FROM (""" + _table(
            "logistics", "fact_shipments", n["shipments"],
            ["date_key", "route_key", "vehicle_key", "origin_warehouse_key", "dest_warehouse_key", "weight_lbs", "cost_per_lb"],
            f"""id + 1 AS shipment_id, {date_key()} AS date_key,
            {skew('h_route_key', n['routes'], 'logistics.fact_shipments', 'route_key')} AS route_key,
            1 + h_vehicle_key % {n['vehicles']} AS vehicle_key, 1 + h_origin_warehouse_key % {n['warehouses']} AS origin_warehouse_key,
            1 + h_dest_warehouse_key % {n['warehouses']} AS dest_warehouse_key, {between('h_weight_lbs', 100, 10000)} AS weight,
            {between('h_cost_per_lb', 5000, 20000)} AS rate""") + ") JOIN dim_route r USING (route_key)",
        "fact_deliveries": f"""
        SELECT shipment_id AS delivery_id, shipment_id, transit_days AS expected_transit_days,
               (CASE WHEN st = 'Delivered' THEN greatest(1, transit_days + delta) END)::INTEGER AS actual_transit_days,
               st AS delivery_status, CASE WHEN st = 'Delivered' THEN transit_days + delta <= transit_days END AS on_time,
               (CASE WHEN st IN ('Delivered', 'Failed') THEN {between('h_delivery_attempts', 1, 3)} ELSE 0 END)::INTEGER AS delivery_attempts
        FROM (SELECT *, {weighted('h_delivery_status', logistics.DELIVERY_STATUS)} AS st, {between('h_delay', -1, 3)} AS delta
              FROM ({drawn('SELECT shipment_id, transit_days FROM fact_shipments JOIN dim_route USING (route_key)',
                           'logistics.fact_deliveries', 'shipment_id', ['delivery_status', 'delay', 'delivery_attempts'])}))""",
        "fact_fleet_usage": f"""
        SELECT usage_id, date_key, vehicle_key, {between('h_miles_driven', 50, 500)}::INTEGER AS miles_driven,
               {money(between('h_fuel_gallons', 2000, 10000))} AS fuel_gallons,
               (({between('h_hours_operated', 40, 120)})::DECIMAL(9,1) / 10)::DECIMAL(5,1) AS hours_operated,
               {chance('h_maintenance_flag', 0.05)} AS maintenance_flag
        FROM ({drawn(fleet_src, 'logistics.fact_fleet_usage', 'position',
                     ['miles_driven', 'fuel_gallons', 'hours_operated', 'maintenance_flag'])})""",
    }


CTES = {
    "retail": _retail(N["retail"]["stores"]),
    "ecommerce": _ecommerce(),
    "banking": _banking(),
    "healthcare": _healthcare(),
    "saas": _saas(),
    "logistics": _logistics(),
}


def with_tables(industry: str, tables: list[str], body: str) -> str:
    """WITH clause of the named tables and whatever they refer to, then ``body``."""
    ctes = CTES[industry]
    needed, todo = set(), list(tables)
    while todo:
        t = todo.pop()
        if t in needed:
            continue
        needed.add(t)
        text = ctes[t]
        todo += [o for o in ctes if o != t and f" {o} " in text.replace(")", " ").replace("\n", " ").replace(",", " ") + " "]
    ordered = []

    def visit(t):
        if t in ordered:
            return
        text = ctes[t].replace(")", " ").replace("\n", " ").replace(",", " ") + " "
        for o in ctes:
            if o != t and f" {o} " in text:
                visit(o)
        ordered.append(t)

    for t in ctes:
        if t in needed:
            visit(t)
    return "WITH " + ",\n".join([WINDOW] + [f"{t} AS ({ctes[t]})" for t in ordered]) + "\n" + body
