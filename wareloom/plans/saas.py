"""Subscription business: monthly snapshots, usage and churn."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions import pools
from wareloom.functions.draws import Draws, padded_id, pick
from wareloom.operators.ranking import sample_rows
from wareloom.plans.common import date_key, dim_date, int_col, keyed, seeded, spread

# Fixed values.
INDUSTRIES = ["Technology", "Finance", "Healthcare", "Retail", "Manufacturing"]
EMPLOYEES = [10, 50, 100, 500, 1000, 5000]
COUNTRIES = ["USA", "UK", "Canada", "Germany", "Australia"]
PLANS = [
    (1, "Free", 0, 0, "Basic"),
    (2, "Starter", 29, 290, "Core"),
    (3, "Pro", 99, 990, "Advanced"),
    (4, "Business", 299, 2990, "Full"),
    (5, "Enterprise", 999, 9990, "Custom"),
]
PLAN_WEIGHTS = {1: 10, 2: 30, 3: 35, 4: 20, 5: 5}
PRODUCTS = [
    (1, "Core Platform", "Platform"),
    (2, "Analytics Add-on", "Add-on"),
    (3, "API Access", "Add-on"),
    (4, "Premium Support", "Service"),
    (5, "Training", "Service"),
]
SUB_STATUS = {"Active": 90, "Churned": 7, "Paused": 3}
FEATURES = ["Dashboard", "Reports", "API", "Export", "Import", "Settings", "Users"]
REASONS = ["Price", "Features", "Competition", "No longer needed", "Poor support", "Other"]
CHURN_SHARE = 0.15
KEY_DAYS = 1 << 20  # more than any calendar, so (customer, day) packs into one key


def _signup(u: Draws, cfg: GenConfig) -> Column:
    return u.date_between("signup_date", cfg.start_date - timedelta(days=730), cfg.end_date)


def _customers(spark: SparkSession, cfg: GenConfig) -> tuple[DataFrame, Draws]:
    u = Draws(cfg.seed, "saas.dim_customer", "_c")
    return u.attach(keyed(spark, cfg, "customers", "customer_key"), "customer_key"), u


def plan_price(plan_key: Column) -> Column:
    """Monthly dollars of a plan, from the five fixed plans."""
    return pick([p[2] for p in PLANS], plan_key - F.lit(1)).cast("bigint")


def dim_customer(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = _customers(spark, cfg)
    return df.select(
        "customer_key",
        padded_id("ORG", F.col("customer_key"), 6).alias("customer_id"),
        F.concat_ws(
            " ", u.choice("company", pools.LAST_NAMES), u.choice("company_suffix", pools.COMPANY_SUFFIXES)
        ).alias("company_name"),
        u.choice("industry", INDUSTRIES).alias("industry"),
        u.choice("employee_count", EMPLOYEES).alias("employee_count"),
        u.choice("country", COUNTRIES).alias("country"),
        _signup(u, cfg).alias("signup_date"),
    )


def dim_plan(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    return spark.createDataFrame(
        PLANS, "plan_key bigint, plan_name string, monthly_price int, annual_price int, features string"
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("monthly_price", "annual_price")})


def dim_product(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, "product_key bigint, product_name string, category string")


def fact_subscriptions(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """A row per customer and first day of a month from the signup on.

    Each customer expands into its own months, which replaces the
    range join of months and customers. Given customers are dealt over
    the tasks for that. Late ones have no months: a filter on their day
    would be inferred for every table that joins them by key, and each
    of its rows would draw that day to be filtered by it.
    """
    df, c = _customers(spark, cfg)
    since = F.greatest(F.col("_signup"), F.lit(cfg.start_date))
    first = F.when(F.dayofmonth(since) == 1, since).otherwise(F.date_add(F.last_day(since), 1))
    df = spread(spark, cfg, df.select("customer_key", _signup(c, cfg).alias("_signup")), "customer_key", cfg.n("customers") * cfg.months)
    months = F.sequence("_first", F.lit(cfg.end_date), F.expr("interval 1 month"))
    df = (
        df.withColumn("_first", first)
        .select("customer_key", F.explode(F.when(F.col("_first") <= F.lit(cfg.end_date), months)).alias("_day"))
        .withColumn(
            "snapshot_date_key", F.date_diff("_day", F.lit(cfg.start_date)).cast("bigint") + F.lit(1)
        )
    )
    u = Draws(cfg.seed, "saas.fact_subscriptions")
    df = u.attach(df, f"customer_key * {KEY_DAYS} + snapshot_date_key")
    df = df.withColumn("plan_key", u.weighted("plan_key", PLAN_WEIGHTS).cast("bigint"))
    df = df.withColumn("_price", plan_price(F.col("plan_key")))
    return df.select(
        "snapshot_date_key", "customer_key", "plan_key",
        F.col("_price").cast("decimal(18,2)").alias("mrr"),
        (F.col("_price") * F.lit(12)).cast("decimal(18,2)").alias("arr"),
        u.weighted("status", SUB_STATUS).alias("status"),
        int_col(F.when(F.col("plan_key") > 1, u.randint("seats", 1, 50)).otherwise(F.lit(1))).alias("seats"),
    )


def fact_usage(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_usage", "customers", "usage_id", cfg.n("customers") * cfg.n_days // 3)
    return df.select(
        "usage_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("customer_key", cfg.n("customers")).alias("customer_key"),
        u.choice("feature", FEATURES).alias("feature"),
        int_col(u.randint("logins", 1, 50)).alias("logins"),
        int_col(u.randint("api_calls", 0, 10000)).alias("api_calls"),
        int_col(u.randint("data_storage_mb", 10, 5000)).alias("data_storage_mb"),
    )


def fact_churn(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """A fixed share of the customers, sampled without replacement.

    ``churn_id`` is the sample position; customers whose churn would fall outside
    the calendar leave gaps in it.
    """
    n = cfg.n("customers")
    df, c = _customers(spark, cfg)
    df = df.select("customer_key", _signup(c, cfg).alias("_signup"), c.bits("churn_sample").alias("_draw"))
    df = sample_rows(df, "_draw", ["customer_key"], int(n * CHURN_SHARE), n)
    u = Draws(cfg.seed, "saas.fact_churn")
    df = u.attach(df.where(F.col("_signup") < F.lit(cfg.end_date)), "customer_key")
    earliest = F.date_add("_signup", 30)
    span = F.greatest(F.date_diff(F.lit(cfg.end_date), earliest), F.lit(0)).cast("bigint")
    df = df.withColumn("_churn", F.date_add(earliest, (u.bits("churn_date") % (span + F.lit(1))).cast("int")))
    df = df.where(F.col("_churn").between(F.lit(cfg.start_date), F.lit(cfg.end_date)))
    df = df.withColumn("plan_key", u.randint("plan_key", 1, len(PLANS)))
    return df.select(
        F.col("_rank").alias("churn_id"),
        (F.date_diff("_churn", F.lit(cfg.start_date)).cast("bigint") + F.lit(1)).alias("date_key"),
        "customer_key",
        "plan_key",
        plan_price(F.col("plan_key")).cast("decimal(18,2)").alias("mrr_lost"),
        u.choice("reason", REASONS).alias("reason"),
        F.floor(F.date_diff("_churn", "_signup") / F.lit(30)).cast("int").alias("tenure_months"),
    )


TABLES = {
    "dim_date": dim_date,
    "dim_customer": dim_customer,
    "dim_plan": dim_plan,
    "dim_product": dim_product,
    "fact_subscriptions": fact_subscriptions,
    "fact_usage": fact_usage,
    "fact_churn": fact_churn,
}
