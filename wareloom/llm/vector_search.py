"""Nearest neighbours by a block matrix join with quantised tiles.

Queries and candidates are dealt to the cells of a grid, a block of each a cell, so that a cell's size is bounded and
neither side is broadcast. In a cell both blocks are quantised to int8 with a scale a vector; one matrix product of
int8 tiles gives distances, and the quantisation residuals give hard bounds on their error: the true distance lies
within the sum of the two residual norms. A candidate survives if its lower bound does not exceed the k-th least
upper bound; survivors' distances are computed from the original vectors in double precision and merged by heaps. The cells'
short lists are merged by Spark's top-k window, which keeps k rows a query before it shuffles. Nothing is
approximate in the end: every candidate that could be among the k nearest is recomputed.

Where squares leave the range of doubles (components beyond some 1e150) the bounds say nothing, so all such pairs are recomputed, scaled by
a power of two.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; of
rows with one id the lexicographically least vector counts (they are reduced before they meet in a task); vectors of different lengths are not compared; ties go to the
smaller vec_id; a query without candidates has no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, ship, written

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 2048
TILE = 1024
#: Power of two that brings any double into the range whose squares are doubles, for up to 2^40 components.
SHRINK = -540


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the vectors that take part."""
    rows = vectors.select(col("vec_id").cast("long").alias("vec_id"), col("embedding").cast("array<double>").alias("v"))
    valid = rows.where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND exists(v, x -> x <> 0) AND "
        "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return valid.groupBy("vec_id").agg(F.min("v").alias("v"))


class Block:
    """Vectors of one length: originals, int8 codes, scales, and the norms of what the codes leave over."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.scale = np.abs(vectors).max(axis=1) / 127
        self.scale[self.scale == 0] = np.finfo(float).tiny
        self.code = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        self.left = np.linalg.norm(vectors - self.code * self.scale[:, None], axis=1)
        self.square = (self.code.astype(np.int64) ** 2).sum(axis=1) * self.scale**2
        # Products of codes are integers; single precision holds them exactly up to 2^24.
        self.kind = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64


def blocks(frame: pd.DataFrame) -> dict[int, Block]:
    """By length."""
    size = frame["v"].str.len().to_numpy()
    return {int(n): Block(frame["vec_id"].to_numpy(np.int64)[size == n], np.stack(frame["v"].to_numpy()[size == n])) for n in np.unique(size)}


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, squares added in the order of components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - y[:, j]
        total += d * d
    out = np.sqrt(total)
    huge = np.flatnonzero(~np.isfinite(total))
    if len(huge):
        out[huge] = np.ldexp(exact(np.ldexp(x[huge], SHRINK), np.ldexp(y[huge], SHRINK)), -SHRINK)
    return out


def nearest(q: Block, c: Block, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of each query's k nearest in the block."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]  # of (-distance, -id): the worst on top
    reach = np.full(len(q.ids), np.inf)  # the k-th least upper bound so far
    uppers = np.full((len(q.ids), k), np.inf)
    own = q.code.astype(q.kind)
    for at in range(0, len(c.ids), TILE):
        t = slice(at, at + TILE)
        product = own @ c.code[t].astype(q.kind).T
        square = q.square[:, None] + c.square[None, t] - 2 * (q.scale[:, None] * c.scale[None, t]) * product
        near = np.sqrt(np.maximum(square, 0))
        slack = q.left[:, None] + c.left[None, t] + 1e-6 * (np.sqrt(q.square)[:, None] + np.sqrt(c.square)[None, t])
        same = q.ids[:, None] == c.ids[None, t]
        lower = near - slack
        lower[~np.isfinite(lower)] = 0.0
        upper = near + slack
        upper[same | ~np.isfinite(upper)] = np.inf
        both = np.concatenate([uppers, upper], axis=1)
        uppers = np.partition(both, k - 1, axis=1)[:, :k]
        reach = uppers.max(axis=1)
        rows, cols = np.nonzero((lower <= reach[:, None]) & ~same)
        distance = exact(q.x[rows], c.x[t][cols])
        for r, i, d in zip(rows.tolist(), c.ids[t][cols].tolist(), distance.tolist()):
            entry, heap = (-d, -i), heaps[r]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return [(int(i), -n, -d) for i, heap in zip(q.ids, heaps) for d, n in heap]


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of each vector that is_query(vec_id) holds for."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(usable(vectors), "vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    g, h = max(-(-n // CANDIDATE_BLOCK), 1), max(-(-m // QUERY_BLOCK), 1)
    spot = lambda name, parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias(name)
    # A stated query set against all rows, in blocks: block (i, j) of the grid is cell i * h + j.
    c = rows.select("vec_id", "v", spot("i", g)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    q = queries.select("vec_id", "v", spot("j", h)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    cell = (F.col("i") * h + F.col("j")).alias("cell")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore", invalid="ignore"):
            mine, theirs = blocks(left), blocks(right)
            found = [x for size in theirs if size in mine for x in nearest(theirs[size], mine[size], k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    short = c.select(cell, "vec_id", "v").groupBy("cell").cogroup(q.select(cell, "vec_id", "v").groupBy("cell")).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return short.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
