"""Nearest rows by place, for DataFrames of any size: equi-joins on grid cells that widen until the nearest is certain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import expr
from .checkpoints import checkpointed


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, slack: float = 0.0, limit: float = math.inf, start: float | None = None) -> DataFrame:
    """left_id, right_id, miles: for each row of ``left`` the rows of ``right`` at most ``slack`` miles farther than its nearest.

    Both have their id, lon and lat (degrees, not across the date line). Without slack one row each: of those equally
    near to a millionth of a mile the one with the smallest id. Rows farther than ``limit`` miles are no match. Rows with
    a null place, and all where the other side is empty, are left out.

    A round looks at the 3 x 3 cells around a row. With cells of m miles its answer is certain where the nearest, and
    the slack, lie within m; the other rows go to the next round with cells twice as wide. ``start`` is the first m; by
    default cells that hold two rows of ``right`` on average.
    """
    left = left.select(F.col(left_id).alias("a"), "lon", "lat").where("lon is not null and lat is not null")
    right = right.select(F.col(right_id).alias("b"), F.col("lon").alias("x"), F.col("lat").alias("y")).where("lon is not null and lat is not null")
    box = right.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(k) for k, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))]).first()
    own = left.agg(*[f(c).alias(k) for k, f, c in (("x0", F.min, "lon"), ("x1", F.max, "lon"), ("y0", F.min, "lat"), ("y1", F.max, "lat"))]).first()
    kinds = f"{left_id} {dict(left.dtypes)['a']}, {right_id} {dict(right.dtypes)['b']}, miles double"
    if not box.n or own.x0 is None:
        return left.sparkSession.createDataFrame([], kinds)
    steepest = max(abs(v) for v in (box.y0, box.y1, own.y0, own.y1))
    per_lon = 69.0 * max(1e-3, math.cos(math.radians(min(steepest, 89.9))))
    wide, tall = (max(box.x1, own.x1) - min(box.x0, own.x0)) * 69.2, (max(box.y1, own.y1) - min(box.y0, own.y0)) * 69.2
    m = start or max(1e-3, math.sqrt(2 * max((box.x1 - box.x0) * per_lon, 1e-3) * max((box.y1 - box.y0) * 69.0, 1e-3) / box.n))
    m = max(m, 2 * slack)
    todo, out = left, None
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while True:
        last = m >= min(limit + slack, wide + tall)
        cell = lambda c, side: F.floor(F.col(c) / side).cast("long")
        # A hundredth wider than m miles: the great circle is shorter than the way along the parallel.
        sides = (1.01 * m / per_lon, 1.01 * m / 69.0)
        here = right.withColumn("cx", cell("x", sides[0])).withColumn("cy", cell("y", sides[1]))
        asked = todo.withColumn("c", around).withColumn("cx", cell("lon", sides[0]) + F.col("c.i")).withColumn("cy", cell("lat", sides[1]) + F.col("c.j")).drop("c")
        met = asked.join(here, ["cx", "cy"]).withColumn("miles", expr("haversine_miles", "lon", "lat", "x", "y")).where(F.col("miles") <= limit)
        best = met.groupBy("a").agg(F.min(F.struct(F.floor(F.col("miles") * 1e6 + 0.5).alias("q"), F.col("b"), F.col("miles"))).alias("z")).select("a", "z.b", "z.miles")
        sure = best if last else best.where(F.col("miles") <= m - slack)
        if slack:
            near = sure.select("a", F.col("miles").alias("least"))
            sure = met.join(near, "a").where(F.col("miles") <= F.col("least") + slack).select("a", "b", "miles")
        sure = checkpointed(sure)
        out = sure if out is None else out.union(sure)
        if last:
            break
        todo = checkpointed(todo.join(sure.select("a").distinct(), "a", "left_anti"))
        if todo.isEmpty():
            break
        m *= 2
    return out.select(F.col("a").alias(left_id), F.col("b").alias(right_id), "miles")


def positions(rows: DataFrame, *keys: str) -> DataFrame:
    """The different places of ``rows`` (of each of ``keys``): lon, lat, ids (sorted, repeated ones too) and the first as ``at``."""
    found = rows.where("lon is not null and lat is not null").groupBy(*keys, "lon", "lat").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return found.withColumn("at", F.col("ids")[0])


def bounds(*sides: DataFrame):
    """x0, x1, y0, y1 and n of the lon and lat of all sides; x0 is null without rows."""
    rows = [s.select("lon", "lat") for s in sides]
    whole = rows[0]
    for other in rows[1:]:
        whole = whole.union(other)
    return whole.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.count(F.lit(1)).alias("n")).first()


def within(left: DataFrame, right: DataFrame, miles: float, box, split: int = 1) -> DataFrame:
    """Pairs of rows of ``left`` (lon, lat, other columns) and ``right`` (the same, columns renamed to b_...) at most ``miles`` apart, with miles.

    Cells are ``miles`` / ``split`` wide (a hundredth more: the great circle is shorter than the way along the parallel),
    and each row of ``left`` asks the cells up to ``split`` away; only ``right`` is put into a table, each part by its task.
    """
    steepest = max(abs(box.y0), abs(box.y1)) if box.y0 is not None else 0.0
    sides = [1.01 * miles / split / per for per in (69.0 * max(1e-3, math.cos(math.radians(min(steepest, 89.9)))), 69.0)]
    cell = lambda c, side: F.floor(F.col(c) / side).cast("long")
    reach = range(-split, split + 1)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach]))
    asked = left.withColumn("c", around).withColumn("cx", cell("lon", sides[0]) + F.col("c.i")).withColumn("cy", cell("lat", sides[1]) + F.col("c.j")).drop("c")
    here = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns]).withColumn("cx", cell("b_lon", sides[0])).withColumn("cy", cell("b_lat", sides[1]))
    met = asked.join(here.hint("shuffle_hash"), ["cx", "cy"]).drop("cx", "cy")
    return met.withColumn("miles", expr("haversine_miles", "lon", "lat", "b_lon", "b_lat")).where(F.col("miles") <= miles)


def nearest_others(rows: DataFrame, k: int) -> DataFrame:
    """a, b, place: the ``k`` nearest other rows of each row of ``rows`` (id, lon, lat), by distance to a millionth of a mile, then id.

    The k nearest are certain where the last of them lies within the width of a cell; other rows ask cells twice as wide.
    """
    rows = rows.where("lon is not null and lat is not null").select("id", "lon", "lat")
    box = bounds(rows)
    if not box.n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1).cast("long").alias("place")).limit(0)
    wide, tall = (box.x1 - box.x0) * 69.2, (box.y1 - box.y0) * 69.2
    m = max(1e-3, math.sqrt(k * max(wide, 1e-3) * max(tall, 1e-3) / box.n))
    by = Window.partitionBy("a").orderBy(F.floor(F.col("miles") * 1e6 + 0.5), "b")
    todo, out = rows, None
    while True:
        last = m >= wide + tall
        met = within(todo, rows, m, box).where("id <> b_id").select(F.col("id").alias("a"), F.col("b_id").alias("b"), "miles")
        best = met.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= k)
        sure = best if last else best.join(best.where((F.col("place") == k) & (F.col("miles") <= m - 2e-6)).select("a"), "a", "left_semi")
        sure = checkpointed(sure.select("a", "b", "place"))
        out = sure if out is None else out.union(sure)
        if last:
            return out
        todo = checkpointed(todo.join(sure.select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
        if todo.isEmpty():
            return out
        m *= 2
