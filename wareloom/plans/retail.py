"""Retail star schema."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions import pools
from wareloom.functions.draws import Draws, money, padded_id, share
from wareloom.plans.common import (
    city, date_key, dim_date, first_name, int_col, last_name, positions, positions_at, product_name, seeded, state,
)

# Fixed values.
CATEGORIES = ["Electronics", "Clothing", "Grocery", "Home", "Sports", "Beauty"]
LOYALTY = {"Bronze": 50, "Silver": 30, "Gold": 15, "Platinum": 5}
STORE_FORMATS = ["Superstore", "Express", "Outlet", "Mall"]
REGIONS = ["North", "South", "East", "West"]


def dim_customer(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_customer", "customers", "customer_key")
    return df.select(
        "customer_key",
        padded_id("CUST", F.col("customer_key"), 6).alias("customer_id"),
        first_name(u).alias("first_name"),
        last_name(u).alias("last_name"),
        int_col(u.randint("age", 18, 75)).alias("age"),
        u.choice("gender", ["M", "F"]).alias("gender"),
        city(u).alias("city"),
        state(u).alias("state"),
        u.weighted("loyalty_tier", LOYALTY).alias("loyalty_tier"),
        u.date_between("signup_date", cfg.start_date - timedelta(days=365), cfg.end_date).alias("signup_date"),
    )


def product_price(u: Draws) -> Column:
    return u.randint("unit_price", 500, 50000)


def dim_product(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_product", "products", "product_key")
    return df.withColumns(
        {"category": u.choice("category", CATEGORIES), "_price": product_price(u)}
    ).select(
        "product_key",
        padded_id("SKU", F.col("product_key"), 6).alias("sku"),
        product_name(u, F.col("category")).alias("product_name"),
        "category",
        u.choice("brand", pools.LAST_NAMES).alias("brand"),
        money(F.col("_price")).alias("unit_price"),
        money(share(F.col("_price"), u.randint("cost_ratio", 4000, 7000))).alias("unit_cost"),
    )


def dim_store(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_store", "stores", "store_key")
    return df.select(
        "store_key",
        padded_id("STR", F.col("store_key"), 4).alias("store_id"),
        F.concat_ws(" ", city(u, "name_city"), u.choice("name_format", STORE_FORMATS)).alias("store_name"),
        city(u).alias("city"),
        state(u).alias("state"),
        u.choice("region", REGIONS).alias("region"),
        u.choice("format", STORE_FORMATS).alias("format"),
        int_col(u.randint("sqft", 5000, 50000)).alias("sqft"),
        u.date_between("open_date", cfg.start_date - timedelta(days=1825), cfg.start_date).alias("open_date"),
    )


def fact_sales(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """Sales at the product's list price, which is recomputed from the product key.

    Price draws are a function of the key, so the lookup needs no join at any size.
    """
    df, u = seeded(spark, cfg, "fact_sales", "transactions", "sale_id")
    p = Draws(cfg.seed, "retail.dim_product", "_p")
    df = df.select(
        "sale_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("customer_key", cfg.n("customers")).alias("customer_key"),
        u.skewed_key("product_key", cfg.n("products")).alias("product_key"),
        u.randint("store_key", 1, cfg.n("stores")).alias("store_key"),
        u.randint("quantity", 1, 10).alias("_qty"),
        u.randint("discount_rate", 0, 2000).alias("_rate"),
    )
    df = p.attach(df, "product_key").withColumn("_price", product_price(p))
    gross = F.col("_price") * F.col("_qty")
    df = df.withColumn("_discount", share(gross, F.col("_rate")))
    return df.select(
        "sale_id", "date_key", "customer_key", "product_key", "store_key",
        int_col(F.col("_qty")).alias("quantity"),
        money(F.col("_price")).alias("unit_price"),
        money(F.col("_discount")).alias("discount"),
        money(gross - F.col("_discount")).alias("revenue"),
    )


def fact_inventory(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """Closing stock of every product in every store.

    Each product expands into its stores, so the product of the two
    dimensions is a scan of the products and no join. Rows follow from their
    position, and ``rows_at`` looks single ones up by it.
    """
    pairs = cfg.n("products") * cfg.n("stores")
    df = _stock(cfg, positions(spark, cfg, "products", pairs, split=True))
    df.rows_at = lambda picks, k: _stock(cfg, positions_at(spark, cfg, "products", pairs, picks, k), "_times")
    return df


def _stock(cfg: GenConfig, df: DataFrame, *also: str) -> DataFrame:
    u = Draws(cfg.seed, "retail.fact_inventory")
    return u.attach(df, "id").select(
        (F.col("_share") + F.lit(1)).alias("product_key"),
        (F.col("_place") + F.lit(1)).alias("store_key"),
        F.lit(cfg.n_days).cast("bigint").alias("date_key"),
        int_col(u.randint("stock_on_hand", 0, 500)).alias("stock_on_hand"),
        int_col(u.randint("reorder_level", 20, 100)).alias("reorder_level"),
        *also,
    ).withColumn("is_low_stock", F.col("stock_on_hand") < F.col("reorder_level"))


TABLES = {
    "dim_date": dim_date,
    "dim_customer": dim_customer,
    "dim_product": dim_product,
    "dim_store": dim_store,
    "fact_sales": fact_sales,
    "fact_inventory": fact_inventory,
}
