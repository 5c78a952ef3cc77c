"""Queries for the nearest row by place, and oracles that compare all pairs (JOIN-04, 06, 07, 11, 15, 30, SRC-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.expressions import expr, render
from ..operators.nearest import nearest
from .kernel_queries import _rows

_ANCHORS = "SELECT anchor_id, lon, lat, has_parking FROM @anchors() a"
_SEGMENTS = "SELECT seg_id, lon, lat, direction, miles FROM @segments() s"
#: The rules of one target: ascents, and segments of four miles at least.
_TARGETS = f"{_SEGMENTS} WHERE direction = 'ascent' OR miles >= 4"
_ENDS = "SELECT seg_id * 2 + k AS end_id, lon + k * 1e-2 AS lon, lat FROM @segments() s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) e"


def _nearest_of(left: str, right: str, ids: tuple[str, str], **limits):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nearest(_rows(spark, sf_dir, left), _rows(spark, sf_dir, right), *ids, **limits).select(*ids)

    return run


def _first(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1")


#: Miles within which rows count as equally near until the query's own order decides.
_TIE = 2e-6


def _nearest_of_each(anchors: DataFrame, right: DataFrame, id_: str, kinds: list[str]) -> DataFrame:
    """anchor_id, ``id_``, miles: the nearest rows of each kind (a condition), with those equally near."""
    found = [nearest(anchors, right.where(kind), "anchor_id", id_, slack=_TIE) for kind in kinds]
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment whose nearer end is nearest; one that may only be climbed counts half a mile more, so the nearest of both kinds decide."""
    ends = _rows(spark, sf_dir, _ENDS.replace("SELECT seg_id * 2", "SELECT direction, seg_id * 2"))
    near = _nearest_of_each(_rows(spark, sf_dir, _ANCHORS), ends, "end_id", ["direction = 'ascent'", "direction <> 'ascent'"])
    near = near.withColumn("seg_id", F.floor(F.col("end_id") / 2).cast("long")).join(_rows(spark, sf_dir, _SEGMENTS).select("seg_id", "direction"), "seg_id")
    score = F.floor((F.col("miles") + F.when(F.col("direction") == "ascent", 0.5).otherwise(0.0)) * 1e6 + 0.5)
    return _first(near, "anchor_id", score, "seg_id").select("anchor_id", "seg_id")


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the segments up to half a mile farther than the nearest: those of a mile at least, then by direction, distance and id.

    The nearest of each length and direction decide; the nearest of all is one of them.
    """
    segments = _rows(spark, sf_dir, _SEGMENTS)
    kinds = [f"{'' if long else 'NOT '}coalesce(miles >= 1, false) AND direction = '{d}'" for long in (True, False) for d in ("ascent", "both")]
    near = _nearest_of_each(_rows(spark, sf_dir, _ANCHORS), segments, "seg_id", kinds)
    near = near.withColumn("least", F.min("miles").over(Window.partitionBy("anchor_id"))).where(F.col("miles") <= F.col("least") + 0.5)
    near = near.join(segments.select("seg_id", "direction", F.col("miles").alias("length")), "seg_id")
    return _first(near, "anchor_id", F.when(F.col("length") >= 1, 0).otherwise(1), "direction", F.floor(F.col("miles") * 1e6 + 0.5), "seg_id").select("anchor_id", "seg_id")


def _facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _rows(spark, sf_dir, "SELECT anchor_id, @q(@mercator_lon(-12940000e0 + anchor_id * 100),1e4) AS mercator FROM @anchors() a")
    return QUERIES["join_04_nearest_segment"](spark, sf_dir).join(places, "anchor_id").select("anchor_id", F.col("mercator").alias("lon"), "seg_id")


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by how far the nearest anchor is (in fortieths of a mile) and by their length in fifths of a mile."""
    near = nearest(_rows(spark, sf_dir, _SEGMENTS), _rows(spark, sf_dir, _ANCHORS), "seg_id", "anchor_id")
    near = near.join(_rows(spark, sf_dir, _SEGMENTS).select("seg_id", F.col("miles").alias("length")), "seg_id")
    return near.groupBy(expr("match_confidence", "miles / 40", "length / 5").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "join_10_match_confidence": _tiers,
    "join_04_nearest_segment": _nearest_of(_ANCHORS, _SEGMENTS, ("anchor_id", "seg_id")),
    "join_06_nearest_brute_force": _nearest_of(f"{_ANCHORS} WHERE has_parking", _SEGMENTS, ("anchor_id", "seg_id"), limit=3.0),
    "join_07_nearest_trailhead": _nearest_of(_SEGMENTS, _ANCHORS, ("seg_id", "anchor_id")),
    "join_11_orientation_match": _oriented,
    "join_15_edge_preference": _preferred,
    "join_30_rule_target": _nearest_of(_ANCHORS, _TARGETS, ("anchor_id", "seg_id")),
    "src_22_facilities": _facilities,
}

_AWAY = "@haversine_miles(a.lon,a.lat,s.lon,s.lat)"
_PAIRS = "SELECT {key}, arg_min({other}, (@q({away},1e6), {other})) AS {other} FROM {left} a, {right} s WHERE {where} GROUP BY {key}"


def _all_pairs(key: str, other: str, left: str, right: str, where: str = "true", away: str = _AWAY) -> str:
    return render(_PAIRS.format(key=key, other=other, left=f"({left})", right=f"({right})", where=where, away=away), "duckdb")


ORACLES = {
    "join_10_match_confidence": render(f"SELECT @match_confidence(d / 40,length / 5) AS tier, count(*) AS n FROM (SELECT s.seg_id, min({_AWAY}) AS d, any_value(s.miles) AS length FROM ({_ANCHORS}) a, ({_SEGMENTS}) s GROUP BY s.seg_id) x GROUP BY tier", "duckdb"),
    "join_04_nearest_segment": _all_pairs("anchor_id", "seg_id", _ANCHORS, _SEGMENTS),
    "join_06_nearest_brute_force": _all_pairs("anchor_id", "seg_id", _ANCHORS, _SEGMENTS, f"has_parking AND {_AWAY} <= 3"),
    "join_07_nearest_trailhead": _all_pairs("seg_id", "anchor_id", _ANCHORS, _SEGMENTS),
    "join_11_orientation_match": _all_pairs("anchor_id", "seg_id", _ANCHORS, _SEGMENTS, away=f"(least({_AWAY}, @haversine_miles(a.lon,a.lat,s.lon + 1e-2,s.lat)) + CASE WHEN s.direction = 'ascent' THEN 5e-1 ELSE 0 END)"),
    "join_15_edge_preference": render(
        f"WITH p AS (SELECT a.anchor_id, s.seg_id, s.direction, s.miles, {_AWAY} AS d FROM ({_ANCHORS}) a, ({_SEGMENTS}) s), n AS (SELECT anchor_id, min(d) AS least FROM p GROUP BY anchor_id) "
        "SELECT p.anchor_id, arg_min(seg_id, (CASE WHEN miles >= 1 THEN 0 ELSE 1 END, direction, @q(d,1e6), seg_id)) AS seg_id FROM p JOIN n ON n.anchor_id = p.anchor_id WHERE d <= least + 5e-1 GROUP BY p.anchor_id",
        "duckdb",
    ),
    "join_30_rule_target": _all_pairs("anchor_id", "seg_id", _ANCHORS, _TARGETS),
    "src_22_facilities": render("SELECT a.anchor_id, @q(@mercator_lon(-12940000e0 + a.anchor_id * 100),1e4) AS lon, n.seg_id FROM @anchors() a JOIN (", "duckdb") + _all_pairs("anchor_id", "seg_id", _ANCHORS, _SEGMENTS) + ") n ON n.anchor_id = a.anchor_id",
}
