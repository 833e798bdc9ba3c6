"""Whole data sets: generate, dirty, summarise, write and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.operators import profile, quality
from wareloom.plans import banking, ecommerce, healthcare, logistics, retail, saas
from wareloom.plans.model import KEYS

GENERATORS = {
    "retail": retail.TABLES,
    "ecommerce": ecommerce.TABLES,
    "banking": banking.TABLES,
    "healthcare": healthcare.TABLES,
    "saas": saas.TABLES,
    "logistics": logistics.TABLES,
}


def generate(spark: SparkSession, cfg: GenConfig) -> dict[str, DataFrame]:
    """All tables of an industry as lazy DataFrames; dimensions come first."""
    return {name: table(spark, cfg, name) for name in GENERATORS[cfg.industry]}


def table(spark: SparkSession, cfg: GenConfig, name: str) -> DataFrame:
    return GENERATORS[cfg.industry][name](spark, cfg)


def known_rows(cfg: GenConfig, name: str) -> int | None:
    """Row count where it follows from the configuration alone."""
    n = cfg.n
    counts = {
        "retail": {
            "fact_sales": lambda: n("transactions"), "fact_inventory": lambda: n("products") * n("stores"),
        },
        "ecommerce": {
            "fact_orders": lambda: n("orders"),
            "fact_web_events": lambda: n("orders") * ecommerce.EVENTS_PER_ORDER,
        },
        "banking": {
            "fact_transactions": lambda: n("transactions"), "fact_loans": lambda: n("customers") // 3,
            "fact_cards": lambda: n("transactions") // 2,
        },
        "healthcare": {"fact_encounters": lambda: n("encounters"), "fact_billing": lambda: n("encounters")},
        "saas": {"fact_usage": lambda: n("customers") * cfg.n_days // 3},
        "logistics": {"fact_shipments": lambda: n("shipments"), "fact_deliveries": lambda: n("shipments")},
    }[cfg.industry].get(name)
    return counts() if counts else None


def _row_key(cfg: GenConfig, name: str) -> tuple:
    """(key expression, whether it counts 1..n) of a table's rows."""
    if name == "fact_inventory":
        return (F.col("product_key") - 1) * cfg.n("stores") + F.col("store_key"), True
    if name == "fact_subscriptions":
        return F.col("customer_key") * saas.KEY_DAYS + F.col("snapshot_date_key"), False
    (key,), _ = KEYS[cfg.industry][name]
    return F.col(key), name != "fact_churn"


def _landed(df: DataFrame, key: Column) -> DataFrame:
    return quality.landing(df).withColumn("_row_key", key.cast("bigint"))


def dirty(tables: dict[str, DataFrame], cfg: GenConfig) -> dict[str, DataFrame]:
    """The tables in landing form with the configured rate of errors.

    A ``dim_`` name selects the dimension rules, any other name the fact rules. A generated table
    that looks rows up by position (``rows_at``) does so for the repeated ones; a table derived from it does not.
    """
    if cfg.quality_rate == 0:
        return dict(tables)
    out = {}
    for name, df in tables.items():
        key, dense = _row_key(cfg, name)
        lookup = getattr(df, "rows_at", None)
        rows_at = None if lookup is None else lambda picks, k, f=lookup, key=key: _landed(f(picks, k), key)
        df = _landed(df, key)
        if name.startswith("dim_"):
            df = quality.inject_dimension(df, cfg.quality_rate, cfg.seed, "_row_key")
        else:
            rows = known_rows(cfg, name)
            rows = tables[name].count() if rows is None else rows
            df = quality.inject_fact(df, cfg.quality_rate, cfg.seed, "_row_key", rows, dense=dense, rows_at=rows_at)
        out[name] = df.drop("_row_key")
    return out


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table with a total."""
    return profile.summary(tables)


def run(spark: SparkSession, cfg: GenConfig) -> dict[str, DataFrame]:
    """Generate, dirty, write and report; returns the tables as written."""
    from wareloom import report
    from wareloom.sources import files

    tables = dirty(generate(spark, cfg), cfg)
    if not cfg.generate_report:
        return files.write_dataset(spark, tables, cfg)
    # The profile is observed while the tables are written: it costs no scan of its own.
    found = {name: Observation(f"profile {name}") for name in tables}
    written = files.write_dataset(spark, {name: df.observe(found[name], *profile.metrics(df)) for name, df in tables.items()}, cfg)
    report.write_report(report.build(spark, written, cfg, profile.observed(spark, written, found)), cfg.output_dir)
    return written
