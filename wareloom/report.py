"""The analysis report as one long table: (section, table_name, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.config import GenConfig
from wareloom.operators import profile, quality
from wareloom.operators.validate import union_all
from wareloom.plans import kpis

# KPI query -> label column of its rows; the others have a single row.
LABELS = {
    "rep_retail_top5": ("product_key", "revenue"), "rep_ecom_status": ("status", "n"),
    "rep_bank_types": ("transaction_type", "n"), "rep_health_visits": ("visit_type", "n"), "rep_saas_plans": ("plan_key", "n"),
}


def _text(df: DataFrame, col: str) -> Column:
    """A value as text; doubles are shown with two decimals."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        c = c.cast("decimal(38,2)")
    return c.cast("string")


def _rows(df: DataFrame, section: str, table: Column, values: dict[str, str]) -> DataFrame:
    """One row per (metric, column) of a wide result."""
    pairs = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.coalesce(_text(df, col), F.lit("")).alias("value"))
        for metric, col in values.items()
    ])
    return df.select(F.lit(section).alias("section"), table.alias("table_name"), F.inline(pairs))


def noise_rows(tables: dict[str, DataFrame], cfg: GenConfig) -> list[tuple[str, str, str, str]]:
    """One row per kind of edit that the quality rate brings into each table, with its rate."""
    rows = []
    for name, df in tables.items():
        for kind, rate in quality.edit_rates(name, df, cfg.quality_rate).items():
            rows.append(("noise", name, kind, f"{rate:.4f}"))
    return rows


def configuration(spark: SparkSession, cfg: GenConfig, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [
        ("industry", cfg.industry), ("size", cfg.size), ("months", str(cfg.months)),
        ("growth_rate", f"{cfg.growth_rate}%"), ("quality", f"{cfg.quality} ({int(cfg.quality_rate * 100)}%)"),
        ("seed", str(cfg.seed)), ("as_of", cfg.as_of.isoformat()),
    ]
    rows = [("configuration", "", m, v) for m, v in rows]
    if cfg.quality_rate > 0:
        rows += noise_rows(tables, cfg)
    return spark.createDataFrame(rows, "section string, table_name string, metric string, value string")


def profile_rows(measured: DataFrame) -> DataFrame:
    """The overview, statistics and missing sections of ``profile.measure``'s rows; these are read once."""
    def row(section: str, table: Column, metric: Column, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), table.alias("table_name"), metric.alias("metric"),
            F.coalesce(value.cast("string"), F.lit("")).alias("value"))

    table, shown = F.col("table_name"), lambda c: c.cast("decimal(38,2)")
    # As many rows as tables: the window is small, and spares a second reading for the sum.
    first = F.row_number().over(W.orderBy("table_name")) == 1
    total = F.array(row("overview", F.lit(""), F.lit("total_rows"), F.sum("n_rows").over(W.partitionBy())))
    plain = F.array(
        row("overview", table, F.lit("rows"), F.col("n_rows")), row("overview", table, F.lit("columns"), F.col("n_columns")),
        row("missing", table, F.lit("missing"), F.col("n_missing")), row("missing", table, F.lit("sentinels"), F.col("n_sentinels")),
        row("missing", table, F.lit("cells"), F.col("n_cells")), row("missing", table, F.lit("percent"), shown(F.col("pct_missing"))))
    stats = F.flatten(F.transform("stats", lambda x: F.array(*[
        row("statistics", table, F.concat_ws(" ", F.lit(n), x["column_name"]), shown(x[c]))
        for n, c in (("min", "min_value"), ("max", "max_value"), ("mean", "mean_value"))])))
    rows = measured.select(F.concat(F.when(first, total).otherwise(F.filter(total, lambda _: F.lit(False))), plain, stats).alias("_rows"))
    return rows.select(F.inline("_rows"))


def build(spark: SparkSession, tables: dict[str, DataFrame], cfg: GenConfig, measured: DataFrame | None = None) -> DataFrame:
    """All report numbers of a data set; nothing runs before the result is used.

    The profile comes from one aggregate a table, or from ``measured`` numbers (see ``profile.observed``).
    """
    measured = profile.measure(tables) if measured is None else measured
    return union_all([configuration(spark, cfg, tables), profile_rows(measured), *insights(tables, cfg)])


def insights(tables: dict[str, DataFrame], cfg: GenConfig) -> list[DataFrame]:
    """The industry's key figures in long form."""
    parts = []
    for name, (industry, needed, function) in kpis.KPIS.items():
        if industry != cfg.industry or any(t not in tables for t in needed):
            continue
        df = function(tables)
        section, table = F.lit(name.removeprefix("rep_")).alias("section"), F.lit(needed[0]).alias("table_name")
        if name in LABELS:
            label, value = LABELS[name]
            parts.append(df.select(
                section, table, F.col(label).cast("string").alias("metric"),
                F.coalesce(_text(df, value), F.lit("")).alias("value"),
            ))
        else:
            parts.append(_rows(df, name.removeprefix("rep_"), F.lit(needed[0]), {c: c for c in df.columns}))
    return parts


def write_report(df: DataFrame, output_dir: str, fmt: str = "csv") -> str:
    """Write the report beside the data as one small file."""
    from wareloom.sources.files import write_table

    return write_table(df.repartition(1), output_dir, "analysis_report", fmt)
