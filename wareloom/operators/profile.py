"""Profiles of whole tables: sizes, numeric ranges and missing cells.

``overview``, ``numeric_stats`` and ``missing`` give one section each; ``measure`` takes all of them from one aggregate a table, and
``observed`` from the rows as they are written, without a scan of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.operators.validate import union_all

NULL_SPELLINGS = ["", "N/A", "null"]  # fixed values: missing text written by the noise operators


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns) per table."""
    return union_all([
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ])


def total_rows(tables: dict[str, DataFrame]) -> DataFrame:
    return overview(tables).agg(F.sum("n_rows").alias("total_rows"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """The overview with a closing ``Total`` row."""
    each = overview(tables)
    total = each.agg(F.sum("n_rows").alias("n_rows")).select(
        F.lit("Total").alias("table_name"), "n_rows", F.lit(None).cast("int").alias("n_columns")
    )
    return each.unionByName(total)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _number(df: DataFrame, name: str) -> Column:
    """A numeric cell; NaN counts as missing."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def _mean(c: Column) -> Column:
    """Mean from a decimal sum, which does not depend on the order of the rows.

    A column with a value too large (or infinite) for that falls back to the mean of doubles.
    """
    exact = c.try_cast("decimal(24,6)")
    return F.when(F.count(exact) == F.count(c), F.sum(exact).cast("double") / F.count(c)).otherwise(F.avg(c.cast("double")))


def _bounds(df: DataFrame, i: int, name: str) -> list[Column]:
    v = _number(df, name)
    return [F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}"), _mean(v).alias(f"mean{i}")]


def _stats(cols: list[str]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"), F.col(f"mean{i}").alias("mean_value"),
        )
        for i, c in enumerate(cols)
    ])


def numeric_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, min_value, max_value, mean_value) of every numeric column.

    One aggregate pass per table.
    """
    parts = []
    for name, df in tables.items():
        cols = numeric_columns(df)
        if cols:
            aggs = [a for i, c in enumerate(cols) for a in _bounds(df, i, c)]
            parts.append(df.agg(*aggs).select(F.lit(name).alias("table_name"), F.inline(_stats(cols))))
    return union_all(parts)


def _gaps(df: DataFrame) -> list[Column]:
    nulls = [F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    spelled = [F.when(F.col(c).isin(NULL_SPELLINGS), 1).otherwise(0) for c in texts]
    add = lambda xs: sum(xs[1:], xs[0]).cast("bigint") if xs else F.lit(0).cast("bigint")
    return [
        F.coalesce(F.sum(add(nulls)), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(add(spelled)), F.lit(0)).alias("n_sentinels"),
        (F.count(F.lit(1)) * F.lit(len(df.columns))).alias("n_cells"),
    ]


def _with_share(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "pct_missing",
        F.when(F.col("n_cells") > 0, F.col("n_missing").cast("double") * 100 / F.col("n_cells")).otherwise(F.lit(0.0)),
    )


def missing(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_missing, n_sentinels, n_cells, pct_missing).

    ``n_missing`` counts true nulls as the report does; ``n_sentinels`` counts the
    spelled-out ones that such a count overlooks.
    """
    return _with_share(union_all([df.agg(*_gaps(df)).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]))


def metrics(df: DataFrame) -> list[Column]:
    """Every number of a table's profile, as aggregates over its rows."""
    return [F.count(F.lit(1)).alias("n_rows"), *_gaps(df), *[a for i, c in enumerate(numeric_columns(df)) for a in _bounds(df, i, c)]]


MEASURED = ("table_name string, n_rows bigint, n_columns int, n_missing bigint, n_sentinels bigint, n_cells bigint, "
            "stats array<struct<column_name: string, min_value: double, max_value: double, mean_value: double>>")


def measure(tables: dict[str, DataFrame]) -> DataFrame:
    """A row a table with all sections of its profile (``MEASURED`` and pct_missing); each table is read once."""
    schema = T.StructType.fromDDL(MEASURED)
    parts = []
    for name, df in tables.items():
        cols = numeric_columns(df)
        stats = (_stats(cols) if cols else F.array()).cast(schema["stats"].dataType)
        parts.append(df.agg(*metrics(df)).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_missing", "n_sentinels", "n_cells",
            stats.alias("stats")))
    return _with_share(union_all(parts))


def observed(spark: SparkSession, tables: dict[str, DataFrame], found: dict[str, Observation]) -> DataFrame:
    """What ``measure`` gives, from the metrics that were observed while the tables were written."""
    rows = []
    for name, observation in found.items():
        got, cols = observation.get, numeric_columns(tables[name])
        stats = [(c, got[f"lo{i}"], got[f"hi{i}"], got[f"mean{i}"]) for i, c in enumerate(cols)]
        rows.append((name, got["n_rows"], len(tables[name].columns), got["n_missing"], got["n_sentinels"], got["n_cells"], stats))
    return _with_share(spark.createDataFrame(rows, MEASURED))
