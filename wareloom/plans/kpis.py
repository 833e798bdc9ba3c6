"""Key figures per industry, as one small DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def mean_of(col: str):
    """Mean of a decimal column as a double, from its exact sum."""
    return F.sum(col).cast("double") / F.count(col)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Counts of the known values and their percentage of all rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col(col).isNotNull()).select(
        col, "n", (F.col("n").cast("double") * 100 / total).alias("pct")
    )


def retail_kpi(t: Tables) -> DataFrame:
    return t["fact_sales"].agg(
        F.sum("revenue").cast("decimal(38,2)").alias("total_revenue"),
        mean_of("revenue").alias("avg_transaction"),
        F.count(F.lit(1)).alias("n_transactions"),
    )


def retail_top5(t: Tables, k: int = 5) -> DataFrame:
    """Best products by revenue; equal revenue is ordered by key."""
    return (
        t["fact_sales"].groupBy("product_key")
        .agg(F.sum("revenue").cast("decimal(38,2)").alias("revenue"))
        .orderBy(F.desc("revenue"), "product_key")
        .limit(k)
    )


def ecom_kpi(t: Tables) -> DataFrame:
    return t["fact_orders"].agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("order_value").cast("decimal(38,2)").alias("gmv"),
        mean_of("order_value").alias("aov"),
    )


def ecom_status(t: Tables) -> DataFrame:
    return distribution(t["fact_orders"], "status")


def bank_flow(t: Tables) -> DataFrame:
    amount = F.col("amount")
    zero = F.lit(0).cast("decimal(18,2)")
    return t["fact_transactions"].agg(
        F.sum(F.when(amount > 0, amount).otherwise(zero)).cast("decimal(38,2)").alias("deposits"),
        F.sum(F.when(amount < 0, -amount).otherwise(zero)).cast("decimal(38,2)").alias("withdrawals"),
        F.sum(amount).cast("decimal(38,2)").alias("net_flow"),
    )


def bank_types(t: Tables) -> DataFrame:
    return (
        t["fact_transactions"].where(F.col("transaction_type").isNotNull())
        .groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n"))
    )


def health_kpi(t: Tables) -> DataFrame:
    return t["fact_encounters"].agg(
        F.count(F.lit(1)).alias("n_encounters"),
        F.sum("total_charges").cast("decimal(38,2)").alias("total_charges"),
        mean_of("total_charges").alias("avg_charge"),
    )


def health_visits(t: Tables) -> DataFrame:
    return distribution(t["fact_encounters"], "visit_type")


def saas_kpi(t: Tables) -> DataFrame:
    """Recurring revenue over all monthly snapshots, as the report defines it."""
    active = t["fact_subscriptions"].where(F.col("status") == "Active")
    return active.agg(
        F.sum("mrr").cast("decimal(38,2)").alias("mrr"),
        F.sum("arr").cast("decimal(38,2)").alias("arr"),
        F.count(F.lit(1)).alias("n_active"),
    )


def saas_kpi_latest(t: Tables) -> DataFrame:
    """The same figures for the latest snapshot only."""
    subs = t["fact_subscriptions"]
    latest = subs.agg(F.max("snapshot_date_key")).scalar()
    return saas_kpi({"fact_subscriptions": subs.where(F.col("snapshot_date_key") == latest)})


def saas_plans(t: Tables) -> DataFrame:
    active = t["fact_subscriptions"].where(F.col("status") == "Active")
    return active.groupBy("plan_key").agg(F.count(F.lit(1)).alias("n"))


def logi_kpi(t: Tables) -> DataFrame:
    return t["fact_shipments"].agg(
        F.count(F.lit(1)).alias("n_shipments"),
        F.sum("weight_lbs").alias("total_weight"),
        F.sum("distance_miles").alias("total_miles"),
        F.sum("shipping_cost").cast("decimal(38,2)").alias("total_cost"),
    )


def logi_ontime(t: Tables) -> DataFrame:
    """On-time deliveries as a percentage of all rows, delivered or not."""
    return t["fact_deliveries"].agg(
        (F.sum(F.when(F.col("on_time"), 1).otherwise(0)).cast("double") * 100 / F.count(F.lit(1))).alias("on_time_pct")
    )


# name -> (industry, tables read, function)
KPIS = {
    "rep_retail_kpi": ("retail", ["fact_sales"], retail_kpi),
    "rep_retail_top5": ("retail", ["fact_sales"], retail_top5),
    "rep_ecom_kpi": ("ecommerce", ["fact_orders"], ecom_kpi),
    "rep_ecom_status": ("ecommerce", ["fact_orders"], ecom_status),
    "rep_bank_flow": ("banking", ["fact_transactions"], bank_flow),
    "rep_bank_types": ("banking", ["fact_transactions"], bank_types),
    "rep_health_kpi": ("healthcare", ["fact_encounters"], health_kpi),
    "rep_health_visits": ("healthcare", ["fact_encounters"], health_visits),
    "rep_saas_kpi": ("saas", ["fact_subscriptions"], saas_kpi),
    "rep_saas_kpi_latest": ("saas", ["fact_subscriptions"], saas_kpi_latest),
    "rep_saas_plans": ("saas", ["fact_subscriptions"], saas_plans),
    "rep_logi_kpi": ("logistics", ["fact_shipments"], logi_kpi),
    "rep_logi_ontime": ("logistics", ["fact_deliveries"], logi_ontime),
}
