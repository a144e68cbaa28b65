"""Connected components by alternating large and small stars, as DataFrames.

Every round is written to the shared folder, which cuts the lineage and lets
the work go on after lost executors. Only row counts and checksums reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) for every node of an edge, where root is the least node.

    ``edges`` has columns u and v of one orderable type; direction and
    repeats don't matter, nulls and loops are dropped.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = space.save(edges, "edges-0")

    def mark(df: DataFrame) -> tuple:
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        return tuple(df.agg(F.count(F.lit(1)), digest).first())

    seen, k = mark(edges), 0
    while seen[0]:
        k += 1
        edges = space.save(_small(_large(edges)), f"edges-{k}")
        now = mark(edges)
        space.delete(f"edges-{k - 1}")
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
