"""Connected components of an edge list: in one task up to a bound, by alternating large-star and small-star steps beyond."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import written


#: Edges that one task joins (16 bytes each, about 100 MB in a worker); the answer is the same either way.
TASK_EDGES = 400_000


def _joined(batches):
    """All edges of a small list to (id, component) by union and find; a root is the smallest id of its set."""
    parent: dict[int, int] = {}
    find = parent.get

    def top(x):
        while (p := find(x, x)) != x:
            parent[x] = x = find(p, p)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "component"])


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Minima are combined before the shuffle; hubs are only joined to their minimum."""
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


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, component (smallest id reachable) of every id in ``edges`` (u, v); self-links and repeats are harmless."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    if now.count() <= TASK_EDGES:
        return written(now.coalesce(1).mapInArrow(_joined, "id long, component long"), name)
    state = None
    while True:
        # A forest of stars whose centres are minima: no u has two v, and no v is a u.
        now = written(_starred(_starred(now, True), False), name)
        fresh = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if fresh == state:
            break
        state = fresh
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return written(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(centres), name)
