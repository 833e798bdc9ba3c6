"""Configurations whose sizes and dates follow a folder of Parquet tables.

The registered queries generate data on the tables they are given: the keys of the
generated rows are read from them, row counts come from Parquet metadata, the window
from the order dates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import BASE_COUNTS, GenConfig
from wareloom.operators.ranking import dense_index, expand_with_running_id

#: Tables whose rows are counted, and their key.
COUNTED = {
    "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
}
_cache: dict[tuple, "Extent"] = {}


@dataclass(frozen=True)
class Extent:
    counts: dict
    keys: dict  # least and greatest key of each table
    first: date
    last: date


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def _state(spark: SparkSession, folder: str) -> tuple:
    """What tells whether the counted files have changed: their number, bytes and latest change. No file is opened."""
    files = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{t}.parquet" for t in COUNTED])
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max(F.unix_micros("modificationTime"))).first())


def extent(spark: SparkSession, folder: str) -> Extent:
    """Row counts, key ranges and dates of the folder, measured once per session and state of its files."""
    key = (spark.sparkContext.applicationId, folder, *_state(spark, folder))
    if key not in _cache:
        counts = None
        for t, k in COUNTED.items():
            one = load(spark, folder, t).agg(
                F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"), F.min(k).cast("bigint").alias("lo"), F.max(k).cast("bigint").alias("hi"))
            counts = one if counts is None else counts.unionAll(one)
        span = load(spark, folder, "orders").agg(
            F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi")
        ).first()
        rows = counts.collect()
        _cache[key] = Extent({r.t: r.n for r in rows}, {r.t: (r.lo, r.hi) for r in rows}, span.lo, span.hi)
    return _cache[key]


#: Given table behind each entity of a generated data set.
SPINES = {
    "customers": "customer", "patients": "customer",
    "products": "part", "accounts": "part", "routes": "part",
    "stores": "supplier", "branches": "supplier", "doctors": "supplier",
    "hospitals": "supplier", "vehicles": "supplier", "warehouses": "supplier",
    "orders": "orders", "transactions": "orders", "encounters": "orders", "shipments": "orders",
}
#: A retail transaction is a line of an order.
SPINES_OF = {"retail": {"transactions": "lineitem"}}


def _numbers(spark: SparkSession, folder: str, x: Extent, table: str) -> DataFrame:
    """k: 1, 2, 3, … for the rows of a table, in order of their keys, which may have gaps.

    Keys without gaps are shifted where they are. Line items share the key of their order, so the lines of each are counted first.
    """
    key, n, (low, high) = COUNTED[table], x.counts[table], x.keys[table]
    if not n:
        return spark.range(0).withColumnRenamed("id", "k")
    rows = load(spark, folder, table)
    if table == "lineitem":
        lines = rows.groupBy((F.col(key).cast("bigint") - F.lit(low)).alias("position")).agg(F.count(F.lit(1)).alias("n_lines"))
        numbered = expand_with_running_id(spark, high - low + 1, lambda _: F.col("n_lines"), source=lines)
        return numbered.select(F.col("running_id").alias("k"))
    if high - low + 1 == n:
        return rows.select((F.col(key).cast("bigint") - F.lit(low - 1)).alias("k"))
    return dense_index(spark, rows.select(key), low, high).select(F.col("index").alias("k"))


def config(spark: SparkSession, folder: str, industry: str, **changes) -> GenConfig:
    """The industry over the folder's tables: generated rows enrich the keys that the tables hold."""
    x = extent(spark, folder)
    spines = {e: SPINES_OF.get(industry, {}).get(e, SPINES[e]) for e in BASE_COUNTS[industry]}
    keys = {e: _numbers(spark, folder, x, t) for e, t in spines.items()}
    return GenConfig(
        industry=industry, as_of=x.last, months=max(1, (x.last - x.first).days // 30),
        counts={e: x.counts[t] for e, t in spines.items()}, keys=keys, **changes
    )
