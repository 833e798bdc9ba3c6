"""Connected components of an edge table, by alternating star contractions; no neighbourhood is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dealt_join
from .common import written


def _stars(edges: DataFrame, node: str, other: str, n: int) -> DataFrame:
    """u, v, m: each of the n edges at most with the least of u and its neighbours. Minima are pre-aggregated before the shuffle."""
    e = edges.select(F.col(node).alias("u"), F.col(other).alias("v"))
    # Written, as the join reads them three times: the driver keeps every plan with all its repeated branches.
    least = written(e.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"), F.count("*").alias("_degree")), "least")
    # The centre of a large star is dealt over many tasks.
    return dealt_join(e, least, [("u", "_u")], "_degree", F.xxhash64("v"), total=n).withColumn("m", F.least("u", "m"))


def _open(edges: DataFrame) -> int:
    """The number of edges (u, v), u > v, all distinct, while some node has two parents or is parent and child; then 0."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("parents"), F.max("parent").alias("parent"))
    found = nodes.agg(F.sum("parents").alias("n"), F.max((F.col("parents") + F.col("parent") > 1) & (F.col("parents") > 0)).alias("open")).first()
    return found.n if found.open else 0


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each component, for every node of links (a, b)."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    # Edges always lead to a smaller node, so once all components are stars, their centres are the least nodes.
    while n := _open(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "u", "v", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        small = _stars(large, "u", "v", n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
