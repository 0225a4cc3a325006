"""Connected components of an edge table by alternating large and small stars.

Each round sends every node's larger neighbours to its smallest one (large star), then
every node's smaller neighbours to the smallest (small star), until nothing changes; the
edges then are stars around the smallest node of each component. Minima are aggregated
before the shuffle, and no neighbour list is ever built, so a hub with any number of edges
is only a skewed join key, which the adaptive join splits. Rounds are written below the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, smaller_too: bool) -> DataFrame:
    """One half-round over directed edges (u, v): v and the smallest of u's neighbourhood."""
    root = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(root, "u")
    if smaller_too:
        hooked = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    else:
        hooked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.filter("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v): each node that isn't the smallest of its component, and that smallest node.

    ``edges``: two columns of one orderable type; loops, repeats and either direction are
    fine, nulls are ignored. Raises if it hasn't settled after ``max_rounds`` rounds."""
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now, seen = materialise(now, "edges"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, smaller_too=False)
        now = materialise(_star(large, smaller_too=True), "edges")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
