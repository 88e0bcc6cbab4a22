"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is
a few joins and map-side combined aggregates; no node's neighbours are gathered in one
row, and only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _stars(edges: DataFrame, keep_all: bool) -> DataFrame:
    """Point neighbours at the smallest node in sight.

    ``edges`` hold (u, v). Large star: every v above u moves to the smallest neighbour
    of u. Small star: v and u themselves move to the smallest neighbour at or below u.
    """
    if keep_all:
        near = edges.union(edges.select("v", "u"))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    moved = moved.where(F.col("v") > F.col("u")) if keep_all else moved.where(F.col("v") != F.col("m"))
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not keep_all:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v); root is the component's smallest node.

    Loops and repeated edges are allowed; edges with a null end are ignored. Each round
    is checkpointed in the shared folder, so a lost executor costs at most one round.
    """
    edges = durable(edges.where("u <> v").select("u", "v").distinct())
    state = None
    while True:
        digest = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (digest[0], digest[1]) == state:
            break
        state = (digest[0], digest[1])
        if not digest[0]:
            break
        edges = durable(_stars(_stars(edges, True), False))
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.select("u", "v").union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
