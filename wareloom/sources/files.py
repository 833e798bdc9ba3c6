"""Sinks and sources: CSV, Parquet, JSON lines and catalog tables.

Layout: ``{output_dir}/{format}/{table}/``; catalog tables use the output folder's
name as schema unless one is given. Month partitions lie in ``month=yyyy-MM`` folders below.

``replace_table`` and ``replace_saved`` put a new version in the place of an old one only after it is written whole and its rows have been
checked against what was to be written, so a failed write leaves the old table readable. ``read_checked`` sorts out malformed rows.
"""

from __future__ import annotations

import re
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.config import GenConfig

FILE_FORMATS = ("parquet", "csv", "json")
# Whitespace is data here, and NULL must stay apart from the empty string.
CSV_OPTIONS = {
    "header": True, "nullValue": "", "emptyValue": '""', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

# A bare empty field reads as the null marker, a quoted one as the empty string.
CSV_READ = {"nullValue": "\\N", "emptyValue": ""}


def path_of(output_dir: str, fmt: str, table: str) -> str:
    return f"{output_dir.rstrip('/')}/{fmt}/{table}"


def _write(df: DataFrame, target: str, fmt: str, mode: str = "overwrite", partition_by: list[str] | None = None, dynamic: bool = False) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(target)
    elif fmt == "parquet":
        writer.parquet(target)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(target)
    else:
        raise ValueError(f"unknown file format {fmt!r}")


def write_table(df: DataFrame, output_dir: str, table: str, fmt: str, partition_by: list[str] | None = None) -> str:
    """Write one table, replacing what was there; returns its folder."""
    target = path_of(output_dir, fmt, table)
    _write(df, target, fmt, partition_by=partition_by)
    return target


def month_of(cfg: GenConfig, key: str = "date_key") -> Column:
    """The month, as yyyy-MM, of a date key of the configured window."""
    return F.date_format(F.date_add(F.lit(cfg.start_date - timedelta(days=1)), F.col(key).cast("int")), "yyyy-MM")


def write_months(df: DataFrame, output_dir: str, table: str, fmt: str, month: Column, cluster_by: list[str]) -> str:
    """Write a table as month partitions; months without rows in ``df`` stay as they are.

    Rows are ranged by month and the clustering columns: a large month becomes several files, each with its own range of values,
    which readers skip by the files' statistics; small months share a task and cost a file each. Only the months that are written are
    replaced.
    """
    target = path_of(output_dir, fmt, table)
    order = ["month", *cluster_by]
    ranged = df.withColumn("month", month).repartitionByRange(*order).sortWithinPartitions(*order)
    _write(ranged, target, fmt, partition_by=["month"], dynamic=True)
    return target


def _check(df: DataFrame) -> list[Column]:
    """Number of rows and a sum of row hashes, the same in any order and partitioning."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).alias("hash")]


def _staged(df: DataFrame, target: str, fmt: str, schema: T.StructType) -> None:
    """Write to a folder of its own and compare what can be read there with what went in."""
    seen = Observation(f"staged {uuid.uuid4().hex}")
    _write(df.observe(seen, *_check(df)), target, fmt, mode="errorifexists")
    back = _reader(df.sparkSession, fmt, schema).load(target)
    found = back.agg(*_check(back)).first()
    if (found["n"], found["hash"]) != (seen.get["n"], seen.get["hash"]):
        raise OSError(f"{target}: {found['n']} rows can be read of {seen.get['n']} written, or their content differs")


def replace_table(df: DataFrame, output_dir: str, table: str, fmt: str) -> str:
    """Replace a table's folder by a checked new version; while that is written, and if it fails, the old one can be read."""
    spark, target = df.sparkSession, path_of(output_dir, fmt, table)
    staging = f"{path_of(output_dir, fmt, '')}_staged_{table}_{uuid.uuid4().hex}"
    old = staging.replace("_staged_", "_old_")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(target).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        _staged(df, staging, fmt, df.schema)
    except BaseException:
        fs.delete(jvm_path(staging), True)
        raise
    if fs.exists(jvm_path(target)):
        fs.rename(jvm_path(target), jvm_path(old))
    if not fs.rename(jvm_path(staging), jvm_path(target)):
        fs.rename(jvm_path(old), jvm_path(target))
        raise OSError(f"{staging} could not be moved to {target}")
    fs.delete(jvm_path(old), True)
    spark.catalog.refreshByPath(target)
    return target


def replace_saved(spark: SparkSession, df: DataFrame, schema: str, table: str, location: str) -> str:
    """Point a catalog table at a checked new version below ``location``: one change in the catalog, without a moment of no table.

    The folder of the version before is left for readers that still use it.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    version, name = f"{location.rstrip('/')}/{table}/version={uuid.uuid4().hex}", f"`{schema}`.`{table}`"
    _staged(df, version, "parquet", df.schema)
    if spark.catalog.tableExists(f"{schema}.{table}") and spark.table(name).schema == spark.read.parquet(version).schema:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
        spark.catalog.refreshTable(f"{schema}.{table}")
    else:  # a new table, or new columns
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{version}'")
    return f"{schema}.{table}"


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | str):
    reader = spark.read.schema(schema).format(fmt)
    return reader.options(**{**CSV_OPTIONS, **CSV_READ}) if fmt == "csv" else reader


CORRUPT = "_malformed"


def read_checked(spark: SparkSession, output_dir: str, table: str, fmt: str, schema: T.StructType, target: str) -> dict[str, int]:
    """Sort a CSV or JSON table into ``{target}/parquet/{table}`` and, row by row as text with its file, ``{target}/rejects/{table}``.

    A row is malformed if it does not fit the schema: a value of another type, cells too few or too many, broken syntax. Returns the number of good and
    rejected rows, which are counted as they are written.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("Parquet files hold their schema: there is nothing to sort out")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # Only cells that are asked for are parsed: the always true comparison asks for all, so a row is malformed by any of them.
    parsed = F.xxhash64(*[F.col(f"`{c}`") for c in schema.names]) >= F.lit(-(2**63))
    rows = _reader(spark, fmt, wide).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True).load(path_of(output_dir, fmt, table))
    whole = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row"), F.when(parsed, F.col(CORRUPT)).alias(CORRUPT),
        F.col("_metadata.file_path").alias("file"))
    parts = {
        "good": whole.where(F.col(CORRUPT).isNull()).select("row.*"),
        "rejected": whole.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "file"),
    }
    counts = {}
    for name, df in parts.items():
        seen = Observation(f"{name} {uuid.uuid4().hex}")
        _write(df.observe(seen, F.count(F.lit(1)).alias("n")), path_of(target, "parquet" if name == "good" else "rejects", table), "parquet")
        counts[name] = seen.get["n"]
    return counts


def read_table(spark: SparkSession, output_dir: str, table: str, fmt: str, schema: T.StructType | str) -> DataFrame:
    """Read one table with an explicit schema."""
    return _reader(spark, fmt, schema).load(path_of(output_dir, fmt, table))


def schema_name(output_dir: str) -> str:
    return re.sub(r"\W+", "_", output_dir.rstrip("/").split("/")[-1]).strip("_") or "output"


def save_table(spark: SparkSession, df: DataFrame, schema: str, table: str, partition_by: list[str] | None = None) -> str:
    """Replace a catalog table."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(f"`{schema}`.`{table}`")
    return f"{schema}.{table}"


def write_dataset(spark: SparkSession, tables: dict[str, DataFrame], cfg: GenConfig) -> dict[str, DataFrame]:
    """Write every table in the configured format, or in all of them.

    The first copy is read back and feeds the further formats and the report, so a
    table is computed once and later steps start from durable files.
    """
    out = {}
    wanted = ["parquet", "csv", "json", "table"] if cfg.format == "all" else [cfg.format]
    for name, df in tables.items():
        current = df
        for fmt in wanted:
            if fmt == "table":
                full = save_table(spark, current, schema_name(cfg.output_dir), name)
                again = spark.table(full)
            else:
                write_table(current, cfg.output_dir, name, fmt)
                again = read_table(spark, cfg.output_dir, name, fmt, df.schema)
            if current is df:
                current = again
        out[name] = current
    return out
