"""Unique row identity for tables without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.draws import div, key_draw
from wareloom.functions.text import fingerprint

CHUNK = 65_536  # copies of one row that a task expands


def number_copies(df: DataFrame, chunk: int = CHUNK, derived: dict[str, Column] | None = None) -> DataFrame:
    """Add ``_dup_no`` = 1..m to the m identical copies of each row.

    ``derived`` columns are functions of the row's content. They are computed before the shuffle, which all readers of
    the result share, and so once however often the result is read.

    Copies are collapsed by a grouped count, which combines before the shuffle, and
    expanded again. Rows with very many copies are first cut into chunks that are
    spread over the cluster, so no task holds one hot row's copies.
    """
    derived = derived or {}
    counted = df.withColumns(derived) if derived else df
    # Grouping columns that are never NULL stay so; as aggregates they would not, and each draw from them would check for it.
    grouped = counted.groupBy(*df.columns, *derived).agg(F.count(F.lit(1)).alias("_m"))
    cols = [*df.columns, *derived]
    one = F.lit(1).cast("bigint")
    few = grouped.where(F.col("_m") <= chunk).select(*cols, F.explode(F.sequence(one, F.col("_m"))).alias("_dup_no"))
    chunks = (
        grouped.where(F.col("_m") > chunk)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), div(F.col("_m") - one, chunk))))
        .repartition(*df.columns, "_chunk")
    )
    first = F.col("_chunk") * F.lit(chunk) + one
    many = chunks.select(
        *cols, F.explode(F.sequence(first, F.least(first + F.lit(chunk - 1), F.col("_m")))).alias("_dup_no")
    )
    return few.unionByName(many)


def identify(df: DataFrame, seed: int) -> DataFrame:
    """Add ``_row_key``, a 52-bit key drawn from the row's content and copy number."""
    cols = df.columns
    numbered = number_copies(df, derived={"_print": fingerprint(df, cols)})
    return numbered.select(
        *cols, "_print", "_dup_no", key_draw(seed, "identity", "_print", "_dup_no").alias("_row_key")
    )
