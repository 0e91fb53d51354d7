"""Connected components by alternating large and small stars.

Every round is two joins on a node's smallest neighbour; a node with many
links is split like any skewed join side. Edges are written to the shared
folder after each round, so lineage stays short and lost executors cost one
round at most. Nothing but one row of sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): all point to the smallest node that u sees; large: from u's larger neighbours, else from the smaller ones and u."""
    if large:
        both = edges.union(edges.select("v", "u"))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    met = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable. links: two columns of bigint, any order, repeats and self-links allowed."""
    u, v = links.columns
    edges = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "links")
    before = None
    for _ in range(rounds):
        old, edges = edges, stored(_star(_star(edges, True), False), "links")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("the links did not settle")
