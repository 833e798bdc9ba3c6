"""Declared keys of the 42 tables: table -> (primary key, {foreign key: dimension})."""

_DATE = ("dim_date", "date_key")


def _fk(**refs):
    return {col: (table, key) for col, (table, key) in refs.items()}


KEYS = {
    "retail": {
        "dim_date": (["date_key"], {}),
        "dim_customer": (["customer_key"], {}),
        "dim_product": (["product_key"], {}),
        "dim_store": (["store_key"], {}),
        "fact_sales": (["sale_id"], _fk(
            date_key=_DATE, customer_key=("dim_customer", "customer_key"),
            product_key=("dim_product", "product_key"), store_key=("dim_store", "store_key"))),
        "fact_inventory": (["product_key", "store_key", "date_key"], _fk(
            date_key=_DATE, product_key=("dim_product", "product_key"), store_key=("dim_store", "store_key"))),
    },
    "ecommerce": {
        "dim_date": (["date_key"], {}),
        "dim_customer": (["customer_key"], {}),
        "dim_product": (["product_key"], {}),
        "dim_channel": (["channel_key"], {}),
        "fact_orders": (["order_id"], _fk(
            date_key=_DATE, customer_key=("dim_customer", "customer_key"), channel_key=("dim_channel", "channel_key"))),
        "fact_order_items": (["item_id"], _fk(
            order_id=("fact_orders", "order_id"), product_key=("dim_product", "product_key"))),
        "fact_web_events": (["event_id"], _fk(
            date_key=_DATE, customer_key=("dim_customer", "customer_key"),
            product_key=("dim_product", "product_key"), channel_key=("dim_channel", "channel_key"))),
    },
    "banking": {
        "dim_date": (["date_key"], {}),
        "dim_customer": (["customer_key"], {}),
        "dim_account": (["account_key"], _fk(customer_key=("dim_customer", "customer_key"))),
        "dim_branch": (["branch_key"], {}),
        "fact_transactions": (["transaction_id"], _fk(
            date_key=_DATE, account_key=("dim_account", "account_key"), branch_key=("dim_branch", "branch_key"))),
        "fact_loans": (["loan_id"], _fk(
            date_key=_DATE, customer_key=("dim_customer", "customer_key"), branch_key=("dim_branch", "branch_key"))),
        "fact_cards": (["card_txn_id"], _fk(date_key=_DATE, customer_key=("dim_customer", "customer_key"))),
    },
    "healthcare": {
        "dim_date": (["date_key"], {}),
        "dim_patient": (["patient_key"], {}),
        "dim_doctor": (["doctor_key"], {}),
        "dim_hospital": (["hospital_key"], {}),
        "dim_diagnosis": (["diagnosis_key"], {}),
        "fact_encounters": (["encounter_id"], _fk(
            date_key=_DATE, patient_key=("dim_patient", "patient_key"), doctor_key=("dim_doctor", "doctor_key"),
            hospital_key=("dim_hospital", "hospital_key"), diagnosis_key=("dim_diagnosis", "diagnosis_key"))),
        "fact_procedures": (["procedure_id"], _fk(
            encounter_id=("fact_encounters", "encounter_id"), doctor_key=("dim_doctor", "doctor_key"))),
        "fact_billing": (["billing_id"], _fk(encounter_id=("fact_encounters", "encounter_id"))),
    },
    "saas": {
        "dim_date": (["date_key"], {}),
        "dim_customer": (["customer_key"], {}),
        "dim_plan": (["plan_key"], {}),
        "dim_product": (["product_key"], {}),
        "fact_subscriptions": (["snapshot_date_key", "customer_key"], _fk(
            snapshot_date_key=_DATE, customer_key=("dim_customer", "customer_key"), plan_key=("dim_plan", "plan_key"))),
        "fact_usage": (["usage_id"], _fk(date_key=_DATE, customer_key=("dim_customer", "customer_key"))),
        "fact_churn": (["churn_id"], _fk(
            date_key=_DATE, customer_key=("dim_customer", "customer_key"), plan_key=("dim_plan", "plan_key"))),
    },
    "logistics": {
        "dim_date": (["date_key"], {}),
        "dim_route": (["route_key"], {}),
        "dim_vehicle": (["vehicle_key"], {}),
        "dim_warehouse": (["warehouse_key"], {}),
        "fact_shipments": (["shipment_id"], _fk(
            date_key=_DATE, route_key=("dim_route", "route_key"), vehicle_key=("dim_vehicle", "vehicle_key"),
            origin_warehouse_key=("dim_warehouse", "warehouse_key"),
            dest_warehouse_key=("dim_warehouse", "warehouse_key"))),
        "fact_deliveries": (["delivery_id"], _fk(shipment_id=("fact_shipments", "shipment_id"))),
        "fact_fleet_usage": (["usage_id"], _fk(date_key=_DATE, vehicle_key=("dim_vehicle", "vehicle_key"))),
    },
}
