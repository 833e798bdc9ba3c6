"""SQL text per registered query name."""

from __future__ import annotations

from oracle_sql_pack.analyses import analysis_sql
from oracle_sql_pack.dirty import dirty_sql
from oracle_sql_pack.generated import CTES, with_tables
from oracle_sql_pack.quality import quality_sql
from oracle_sql_pack.reports import report_sql

FIXED_DIMS = {
    ("ecommerce", "dim_channel"): ("fact_orders", "channel_key", "n_orders"),
    ("healthcare", "dim_diagnosis"): ("fact_encounters", "diagnosis_key", "n_encounters"),
    ("saas", "dim_plan"): ("fact_subscriptions", "plan_key", "n_snapshots"),
}
HELPERS = {"order_lines", "encounter_lines", "dim_customer_draws"}


def generated_sql() -> dict[str, str]:
    out = {}
    for industry, tables in CTES.items():
        for table in tables:
            if table in HELPERS:
                continue
            name = f"gen_{industry}_{table}"
            if (industry, table) in FIXED_DIMS:
                fact, key, count = FIXED_DIMS[industry, table]
                out[name] = with_tables(industry, [table, fact], f"""
                SELECT d.*, u.{count} FROM {table} d
                LEFT JOIN (SELECT {key}, count(*) AS {count} FROM {fact} GROUP BY {key}) u USING ({key})""")
            elif table != "dim_date" and (industry, table) != ("saas", "dim_product"):
                out[name] = with_tables(industry, [table], f"SELECT * FROM {table}")
    return out


def all_sql() -> dict[str, str]:
    return {**report_sql(), **analysis_sql(), **generated_sql(), **quality_sql(), **dirty_sql()}
