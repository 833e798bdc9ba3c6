"""Online retail: orders, items and click events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions import pools
from wareloom.functions.draws import Draws, key_draw, money, padded_id
from wareloom.operators.ranking import expand_with_running_id
from wareloom.plans.common import (
    city, date_key, dim_date, first_name, int_col, keyed, last_name, positions, product_name, seeded, state,
)

# Fixed values.
CATEGORIES = ["Electronics", "Fashion", "Home", "Beauty", "Sports", "Books"]
ACQUISITION = ["Organic", "Paid Search", "Social", "Referral", "Email"]
CHANNELS = [
    (1, "Web", "Desktop"),
    (2, "Mobile App", "iOS"),
    (3, "Mobile App", "Android"),
    (4, "Marketplace", "Amazon"),
    (5, "Social", "Instagram"),
]
ORDER_STATUS = {"Delivered": 70, "Shipped": 15, "Processing": 10, "Cancelled": 5}
EVENT_TYPES = {
    "page_view": 40, "product_view": 25, "add_to_cart": 15,
    "remove_from_cart": 5, "checkout_start": 10, "purchase": 5,
}
MAX_ITEMS = 5
EVENTS_PER_ORDER = 10


def dim_customer(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_customer", "customers", "customer_key")
    df = df.withColumns({"first_name": first_name(u), "last_name": last_name(u)})
    handle = F.lower(F.regexp_replace(F.concat_ws(".", "first_name", "last_name"), "[^A-Za-z.]", ""))
    return df.select(
        "customer_key",
        padded_id("CUST", F.col("customer_key"), 6).alias("customer_id"),
        F.concat(
            handle, u.randint("email_number", 1, 9999).cast("string"), F.lit("@"),
            u.choice("email_domain", pools.EMAIL_DOMAINS),
        ).alias("email"),
        "first_name",
        "last_name",
        city(u).alias("city"),
        state(u).alias("state"),
        F.lit("USA").alias("country"),
        u.date_between("signup_date", cfg.start_date - timedelta(days=365), cfg.end_date).alias("signup_date"),
        u.choice("acquisition_channel", ACQUISITION).alias("acquisition_channel"),
    )


def product_price(u: Draws) -> Column:
    return u.randint("unit_price", 1000, 100000)


def dim_product(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_product", "products", "product_key")
    return df.withColumn("category", u.choice("category", CATEGORIES)).select(
        "product_key",
        padded_id("PROD", F.col("product_key"), 6).alias("product_id"),
        product_name(u, F.col("category")).alias("product_name"),
        "category",
        u.choice("brand", pools.LAST_NAMES).alias("brand"),
        money(product_price(u)).alias("unit_price"),
    )


def dim_channel(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    return spark.createDataFrame(CHANNELS, "channel_key bigint, channel_name string, platform string")


def _n_items(cfg: GenConfig, order_id: str) -> Column:
    """Items per order as a function of the order key alone."""
    h = key_draw(cfg.seed, "ecommerce.fact_orders.n_items", order_id)
    return F.lit(1) + h % F.lit(MAX_ITEMS)


def _lines(df: DataFrame, cfg: GenConfig) -> DataFrame:
    """Add product, quantity and cents to rows of (order_id, line)."""
    u = Draws(cfg.seed, "ecommerce.fact_order_items", "_i")
    p = Draws(cfg.seed, "ecommerce.dim_product", "_p")
    df = u.attach(df, "order_id * 8 + line")
    df = df.withColumns({
        "product_key": u.skewed_key("product_key", cfg.n("products")),
        "_qty": u.randint("quantity", 1, 3),
    })
    df = p.attach(df, "product_key")
    return df.withColumn("_price", product_price(p)).withColumn("_total", F.col("_price") * F.col("_qty"))


def fact_orders(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """Order headers; the value is the sum of the lines.

    Lines are expanded next to their order and summed there: the range of order keys
    already groups them, so the sum needs no shuffle. The header columns are drawn
    afterwards from the order key, so nothing is joined either.
    """
    lines = keyed(spark, cfg, "orders", "order_id").withColumn(
        "line", F.explode(F.sequence(F.lit(1).cast("bigint"), _n_items(cfg, "order_id")))
    )
    values = _lines(lines, cfg).groupBy("order_id").agg(F.sum("_total").alias("_value"))
    u = Draws(cfg.seed, "ecommerce.fact_orders")
    return u.attach(values, "order_id").select(
        "order_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("customer_key", cfg.n("customers")).alias("customer_key"),
        u.randint("channel_key", 1, len(CHANNELS)).alias("channel_key"),
        money(F.col("_value")).alias("order_value"),
        money(u.randint("shipping_cost", 0, 1500)).alias("shipping_cost"),
        u.weighted("status", ORDER_STATUS).alias("status"),
    )


def fact_order_items(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    items = expand_with_running_id(
        spark, cfg.n("orders"), lambda p: _n_items(cfg, f"{p} + 1"), source=positions(spark, cfg, "orders", name="position") if cfg.keys else None)
    items = items.select(
        F.col("running_id").alias("item_id"),
        (F.col("position") + F.lit(1)).alias("order_id"),
        F.col("ordinal").alias("line"),
    )
    return _lines(items, cfg).select(
        "item_id", "order_id", "product_key",
        int_col(F.col("_qty")).alias("quantity"),
        money(F.col("_price")).alias("unit_price"),
        money(F.col("_total")).alias("line_total"),
    )


def fact_web_events(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_web_events", "orders", "event_id", cfg.n("orders") * EVENTS_PER_ORDER)
    return df.select(
        "event_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("customer_key", cfg.n("customers")).alias("customer_key"),
        F.when(~u.chance("no_product", 0.3), u.skewed_key("product_key", cfg.n("products"))).alias("product_key"),
        u.randint("channel_key", 1, len(CHANNELS)).alias("channel_key"),
        u.weighted("event_type", EVENT_TYPES).alias("event_type"),
        F.concat(F.lit("SES-"), u.randint("session_id", 100000, 999999).cast("string")).alias("session_id"),
    )


TABLES = {
    "dim_date": dim_date,
    "dim_customer": dim_customer,
    "dim_product": dim_product,
    "dim_channel": dim_channel,
    "fact_orders": fact_orders,
    "fact_order_items": fact_order_items,
    "fact_web_events": fact_web_events,
}
