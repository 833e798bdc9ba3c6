"""First occurrences of keys, streamed through a range-partitioned, sorted table.

Rows are range-partitioned by (key, order, payload) and sorted, so a key with very many rows lies in several
neighbouring partitions. Each task streams its rows and holds one key and one number. A partition's first key may have
begun in an earlier partition; such rows are settled by the partitions' border records, two a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

LATER, OPEN, BORDER = 0, 1, 2


def _marked(batches: Iterator[pa.RecordBatch], n_keys: int, order: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Later rows, least rows of the partition's first key (OPEN), and first and last key with their least order (BORDER)."""
    held: tuple | None = None  # last key, its least order, whether it is the partition's first

    def border(key, least):
        row = [[x] for x in key] + [[0]] * (len(schema) - n_keys - 1) + [[BORDER]]
        row[order] = [least]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i).to_numpy() for i in range(n_keys)]
        place = batch.column(order).to_numpy()
        new = np.zeros(n, bool)
        new[0] = held is None or tuple(int(k[0]) for k in keys) != held[0]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        lead = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        least = np.full(n, held[1] if held else 0, np.int64)
        if len(lead):
            least = np.where(run >= 0, place[lead[run]], least)
        first = (run == -1) if held and held[2] else (run == 0) if held is None else np.zeros(n, bool)
        later = place > least
        if held is None:
            yield border([int(k[0]) for k in keys], int(least[0]))
        keep = np.flatnonzero(later | first)
        if len(keep):
            kind = np.where(later[keep], LATER, OPEN).astype(np.int8)
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(kind)], schema=schema)
        held = tuple(int(k[-1]) for k in keys), int(least[-1]), bool(first[-1])
    if held:
        yield border(held[0], held[1])


def later(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The rows whose order exceeds the least order of their key; all columns are longs without nulls."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c not in (*keys, order)]
    df = df.select(*keys, order, *rest)
    schema = T.StructType([*[T.StructField(f.name, T.LongType()) for f in df.schema], T.StructField("_kind", T.ByteType())])
    arrow = pa.schema([*[(c, pa.int64()) for c in df.columns], ("_kind", pa.int8())])
    # The salt splits rows that are equal in all columns; they get equal answers, so it is dropped again.
    placing = [*keys, order, *rest, "_salt"]
    placed = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*placing).sortWithinPartitions(*placing)
    n_keys, at = len(keys), len(keys)

    def mark(batches):
        return _marked(batches, n_keys, at, arrow)

    found = written(placed.drop("_salt").mapInArrow(mark, schema), name)
    borders = found.where(f"_kind = {BORDER}").groupBy(*keys).agg(F.min(order).alias("_least"))
    # Two rows a partition: bounded by the number of partitions.
    settled = found.where(f"_kind = {OPEN}").join(F.broadcast(borders), keys).where(F.col(order) > F.col("_least"))
    return found.where(f"_kind = {LATER}").select(*df.columns).unionByName(settled.select(*df.columns))
