"""Shared scratch space, bounded arithmetic and name-safe columns for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a NULL id in join keys; sorts before every real id.
NULL_ID = -(2**63)
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); an own one only in local mode, where all is one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="wareloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application, and bound the batches they get.

    A batch of the default 10,000 rows of long texts would take a worker's memory; a size that the user has set is kept.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
        spark.conf.set(BATCH_SETTING, "4m")
    if getattr(sc, "_wareloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="wareloom-code-"), "wareloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._wareloom_shipped = True


def trim() -> None:
    """Give a worker's freed memory back to the system; workers live on, beside other tasks' workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: lost executors cost no recomputation past this point."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text"):
    return F.coalesce(col(name), F.lit(""))


def wrapped(docs: DataFrame, **columns) -> DataFrame:
    """The rows as one struct column beside computed ones: no name of the input can clash."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
