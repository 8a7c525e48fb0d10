"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which the result must have settled; each at least halves the depth of the remaining trees.
MOST_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself: its larger neighbours, or its smaller and itself."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = near.join(least, "u")
    out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) if small else joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable from it) of every node of a table of links (u, v) between longs.

    Alternating stars, as published for map-reduce: no step gathers the neighbours of a node, and each round is written to
    the shared folder.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", True)
    state = None
    for _ in range(MOST_ROUNDS):
        edges = materialize(_star(_star(edges, False), True), "links", True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
    raise RuntimeError("the components did not settle")
