"""Connected components of a distributed edge list: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .checkpoints import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v). Each node's neighbours are attached to the smallest of them; minima are combined before the shuffle."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.where("m < u").select("u", F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
    return out.union(own).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (u, v). Each step is checkpointed to the shared folder."""
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = checkpointed(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = checkpointed(_star(_star(now, True), False))
        fresh = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if fresh == state:
            break
        state = fresh
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return stars.union(loops).groupBy("node").agg(F.min("component").alias("component"))
