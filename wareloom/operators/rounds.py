"""Work on huge tables in rounds of keys, so that only one round's shuffle lies on disk at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_ROWS = 1_000_000_000  # rows that one round shuffles
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir), if one is set."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)


def in_rounds(df: DataFrame, key: str, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``function(df)``, where each result row follows from the rows of one ``key`` alone.

    Tables of up to ``ROUND_ROWS`` rows, and all where no shared folder is set, take one lazy go. Larger ones are read once a
    round; a round has the rows of its share of the keys, and its results are written to the shared folder before the next.
    """
    spark = df.sparkSession
    rounds = -(-df.count() // ROUND_ROWS)
    folder = shared_folder(spark) if rounds > 1 else None
    if folder is None:
        return function(df)
    paths, before = [], spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # a round's shuffle files go as soon as its results are written
    try:
        for i in range(rounds):
            part = function(df.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == F.lit(i)))
            paths.append(f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}")
            part.write.parquet(paths[-1])
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(part.schema).parquet(*paths)
