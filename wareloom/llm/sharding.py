"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, size, text_crc32), nulls first. The permutation maps row
number to shuffled position; ``shard = position % shards`` and ``slot = position div shards``. Both can be computed
for any row number without looking at other rows, shard sizes differ by one row at most (law ``rows``), and
slots of a shard have no gaps.

Edge cases: a null text has size 1 and checksum 0 as the empty text has; a null doc_id is the lowest id; rows
equal in all three columns are interchangeable, so any numbering among them gives the same result; an empty table
gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, written

PRIME = 2**31 - 1
ROUNDS = 6
#: A walk leaves [0, N) with chance below 1/sqrt(N) a step, and can last sqrt(N) steps at most.
MAX_WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Coefficients of the quadratic round functions, from a multiplicative congruential generator."""
    state, keys = seed % (PRIME - 1) + 1, []
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            for _ in range(5):
                state = state * 48271 % PRIME
            three.append(state)
        keys.append(tuple(three))
    return keys


def mix(x: str, a, b, c) -> str:
    """SQL text of a*x^2 + b*x + c modulo the prime; every product stays below 2^62."""
    r = f"(({x}) % {PRIME})"
    return f"((({r} * {r} % {PRIME}) * {a} + {r} * {b} + {c}) % {PRIME})"


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds global ``row`` numbers in the order of keys, and the row count ``total``.

    Rows are range-partitioned with a salt behind the keys, so that no repeated key fills one partition, and
    written, so that counts and rows come from the same partitioning. Only one count a partition is gathered.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in [*keys, "_salt"]]
    placed = written(
        salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt").withColumns({
            "_part": F.spark_partition_id().cast("long"),
            "_in_part": F.monotonically_increasing_id().bitwiseAND(2**33 - 1),
        }), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    ordered = Window.orderBy("_part")
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("total"))
    # One row a partition of a written table: bounded by the number of its files.
    return placed.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_before") + F.col("_in_part")).drop(
        "_part", "_in_part", "_before")


def permuted(df: DataFrame, seed: int) -> DataFrame:
    """Adds ``position``, the image of ``row`` under a permutation of [0, total)."""
    keys = round_keys(seed)
    df = df.withColumn("_a", F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long"))
    df = df.withColumn("_b", F.expr("(total + _a - 1) div _a"))
    df = df.withColumns({"_l": F.expr("row div _b"), "_r": F.expr("row % _b")})
    for i, k in enumerate(keys):
        if i % 2 == 0:
            df = df.withColumn("_l", F.expr(f"(_l + {mix('_r', *k)}) % _a"))
        else:
            df = df.withColumn("_r", F.expr(f"(_r + {mix('_l', *k)}) % _b"))
    df = df.withColumn("_p", F.expr("_l * _b + _r"))
    steps = ", ".join(f"named_struct('odd', {i % 2}, 'a', {a}L, 'b', {b}L, 'c', {c}L)" for i, (a, b, c) in enumerate(keys))
    again = (
        f"aggregate(array({steps}), named_struct('l', v div _b, 'r', v % _b), (s, k) -> IF(k.odd = 0, "
        f"named_struct('l', (s.l + {mix('s.r', 'k.a', 'k.b', 'k.c')}) % _a, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {mix('s.l', 'k.a', 'k.b', 'k.c')}) % _b)), s -> s.l * _b + s.r)")
    walked = (
        f"CASE WHEN _p < total THEN _p ELSE aggregate(sequence(1, {MAX_WALK}), _p, "
        f"(v, i) -> CASE WHEN v < total THEN v ELSE {again} END) END")
    df = df.withColumn("position", F.expr(walked))
    guard = F.when(F.col("position") < F.col("total"), F.col("position")).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return df.withColumn("position", guard).drop("_a", "_b", "_l", "_r", "_p")


def shard(docs: DataFrame, shards: int = 16, seed: int = 20261201) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(col("text"), F.lit(""))
    slim = docs.select(
        col("doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = permuted(numbered(slim, ["doc_id", "size", "text_crc32"]), seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"cast(position % {shards} AS int)").alias("shard"), F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def position_of(row: int, total: int, seed: int = 20261201) -> int:
    """The same permutation for one row number, without Spark."""
    a = math.isqrt(total - 1) + 1 if total else 0
    b = -(-total // a)
    while True:
        left, right = divmod(row, b)
        for i, (x2, x1, x0) in enumerate(round_keys(seed)):
            x = (left if i % 2 else right) % PRIME
            y = (x * x % PRIME * x2 + x * x1 + x0) % PRIME
            if i % 2:
                right = (right + y) % b
            else:
                left = (left + y) % a
        row = left * b + right
        if row < total:
            return row
