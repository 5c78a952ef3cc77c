"""Coverage matching on the relational tables (JOIN-12, JOIN-13, AUD-05), with oracles that state it anew.

A part is a segment: it runs east from its place for ``p_size`` ten-thousandths of a degree, over a bend in the middle.
An order is a track; each part that it has lines for was recorded for the share ``l_quantity`` / 50 of its length,
``l_discount`` fiftieths of a degree to the north of it, and backwards where it was returned. The ends of a segment lie
at the part's price, and at that plus its size less 25.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import render
from ..operators.coverage import completion_review, coverage_audit, coverage_match

_POINT = "named_struct('lon', CAST({} AS DOUBLE), 'lat', CAST({} AS DOUBLE))"
_LEGS = "SELECT l_orderkey AS track_id, l_partkey AS seg_id, max(l_quantity) / 50 AS share, min(l_discount) / 50 AS north, max(l_returnflag) = 'R' AS back FROM {lineitem} GROUP BY l_orderkey, l_partkey"
_PARTS = "SELECT p_partkey AS seg_id, CASE WHEN p_partkey % 11 = 0 THEN 'ascent' ELSE 'both' END AS direction, p_retailprice AS low, p_size, @lon(p_partkey) AS lon, @lat(p_partkey) AS lat FROM {part}"


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("part", "lineitem") if "{" + n + "}" in sql]
    return spark.sql(render(sql), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ", ".join(_POINT.format(*at) for at in (("lon", "lat"), ("lon + p_size * 5e-5", "lat + p_size * 2e-5"), ("lon + p_size * 1e-4", "lat")))
    return _read(spark, sf_dir, f"SELECT seg_id, direction, low AS start_elevation, low + p_size - 25 AS end_elevation, array({points}) AS line FROM ({_PARTS})")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ", ".join(_POINT.format(*at) for at in (("lon", "lat + north"), ("lon + share * p_size * 5e-5", "lat + north + share * p_size * 2e-5"), ("lon + share * p_size * 1e-4", "lat + north")))
    sql = f"SELECT /*+ MERGE(p) */ track_id, seg_id AS part, CASE WHEN back THEN reverse(array({points})) ELSE array({points}) END AS points FROM ({_LEGS}) JOIN ({_PARTS}) p USING (seg_id)"
    return _read(spark, sf_dir, sql)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "SELECT DISTINCT l_orderkey AS track_id, l_partkey AS seg_id FROM {lineitem}")


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage_match(segments(spark, sf_dir), tracks(spark, sf_dir))
    return found.select("track_id", "seg_id", "close", "samples")


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = completion_review(segments(spark, sf_dir), tracks(spark, sf_dir), _claims(spark, sf_dir))
    return found.select("track_id", "seg_id", "planned", F.floor(F.col("fraction") * 1000 + 0.5).cast("long").alias("permille"), "direction_ok", "status")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage_audit(segments(spark, sf_dir), tracks(spark, sf_dir), _claims(spark, sf_dir))
    return found.select("track_id", "seg_id", F.floor(F.col("ratio") * 1000 + 0.5).cast("long").alias("permille"), "failure")


# The oracle: all samples against all edges in bands of latitude, and distances by projection onto the edge's line.
_SET = r"""
WITH seg AS (SELECT p_partkey AS seg_id, CASE WHEN p_partkey % 11 = 0 THEN 'ascent' ELSE 'both' END AS direction, p_size AS z, p_size - 25 AS climb, -116.43 + (p_partkey * 7919 % 5000) / 10000.0::DOUBLE AS x, 43.48 + (p_partkey * 104729 % 3700) / 10000.0::DOUBLE AS y FROM part),
corner AS (SELECT seg_id, v, x + z * v * 5e-5::DOUBLE AS x, y + CASE v WHEN 1 THEN z * 2e-5::DOUBLE ELSE 0 END AS y FROM seg, range(3) r(v)),
half AS (SELECT a.seg_id, a.v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, 2 * 3958.7613 * asin(sqrt(power(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2))) AS len FROM corner a JOIN corner b ON b.seg_id = a.seg_id AND b.v = a.v + 1),
steps AS (SELECT *, greatest(1, ceil(len / 0.03))::BIGINT AS n FROM half),
pt AS (SELECT seg_id, v, unnest(range(CASE v WHEN 0 THEN 0 ELSE 1 END, n + 1)) AS s, n, x1, y1, x2, y2 FROM steps),
smp AS (SELECT seg_id, v * 100000 + s AS k, x1 + (x2 - x1) * s / n AS x, y1 + (y2 - y1) * s / n AS y FROM pt),
size AS (SELECT seg_id, count(*) AS n, min(k) AS head, max(k) AS tail FROM smp GROUP BY seg_id),
leg AS (SELECT l_orderkey AS track_id, l_partkey AS part, max(l_quantity) / 50 AS share, min(l_discount) / 50 AS north, max(l_returnflag) = 'R' AS back FROM lineitem GROUP BY l_orderkey, l_partkey),
way AS (SELECT track_id, part, CASE WHEN back THEN 2 - v ELSE v END AS i, c.x + (share - 1) * z * v * 5e-5::DOUBLE AS x, seg.y + north + CASE v WHEN 1 THEN share * z * 2e-5::DOUBLE ELSE 0 END AS y FROM leg JOIN seg ON seg.seg_id = part JOIN corner c ON c.seg_id = part),
edge AS (SELECT a.track_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM way a JOIN way b ON b.track_id = a.track_id AND b.part = a.part AND b.i = a.i + 1),
band AS (SELECT *, unnest(range(floor(least(y1, y2) / 0.005)::BIGINT - 1, floor(greatest(y1, y2) / 0.005)::BIGINT + 2)) AS f FROM edge),
pair AS (SELECT b.track_id, s.seg_id, s.k, (s.x - x1) * 69.172 * cos(radians(s.y)) AS px, (s.y - y1) * 69.0 AS py, (x2 - x1) * 69.172 * cos(radians(s.y)) AS ex, (y2 - y1) * 69.0 AS ey FROM band b JOIN smp s ON floor(s.y / 0.005)::BIGINT = b.f AND s.x BETWEEN least(b.x1, b.x2) - 0.002 AND greatest(b.x1, b.x2) + 0.002),
gap AS (SELECT track_id, seg_id, k, min(CASE WHEN ex * ex + ey * ey = 0 OR px * ex + py * ey <= 0 THEN sqrt(px * px + py * py) WHEN px * ex + py * ey >= ex * ex + ey * ey THEN sqrt(power(px - ex, 2) + power(py - ey, 2)) ELSE abs(px * ey - py * ex) / sqrt(ex * ex + ey * ey) END) AS d FROM pair GROUP BY track_id, seg_id, k),
hit AS (SELECT g.track_id, g.seg_id, count(*) AS close, any_value(n) AS n, bool_or(k = head) AS at_start, bool_or(k = tail) AS at_end FROM gap g JOIN size USING (seg_id) WHERE d <= 0.045 GROUP BY g.track_id, g.seg_id),
claim AS (SELECT DISTINCT track_id, part AS seg_id FROM leg JOIN seg ON seg.seg_id = part),
ends AS (SELECT h.track_id, h.seg_id, w.part, w.i, 2 * asin(least(1, sqrt(power(sin(radians(w.y - s.y) / 2), 2) + cos(radians(s.y)) * cos(radians(w.y)) * power(sin(radians(w.x - s.x) / 2), 2)))) AS to_start, 2 * asin(least(1, sqrt(power(sin(radians(w.y - e.y) / 2), 2) + cos(radians(e.y)) * cos(radians(w.y)) * power(sin(radians(w.x - e.x) / 2), 2)))) AS to_end FROM hit h JOIN seg ON seg.seg_id = h.seg_id AND seg.direction = 'ascent' JOIN corner s ON s.seg_id = h.seg_id AND s.v = 0 JOIN corner e ON e.seg_id = h.seg_id AND e.v = 2 JOIN way w ON w.track_id = h.track_id WHERE h.at_start AND h.at_end),
turn AS (SELECT track_id, seg_id, arg_min(part * 10 + i, (to_start, part, i)) < arg_min(part * 10 + i, (to_end, part, i)) AS ahead FROM ends GROUP BY track_id, seg_id)
"""
_REVIEW = """, r AS (SELECT track_id, seg_id, c.seg_id IS NOT NULL AS planned, coalesce(close, 0) AS close, coalesce(h.n, 1) AS n, coalesce(at_start, false) AS s, coalesce(at_end, false) AS e FROM hit h FULL JOIN (SELECT * FROM claim) c USING (track_id, seg_id)),
q AS (SELECT r.*, seg.direction, 100 * close >= 85 * r.n AND s AND e AS ok, CASE WHEN seg.direction <> 'ascent' THEN true WHEN NOT (100 * close >= 85 * r.n AND s AND e) OR climb = 0 THEN NULL WHEN climb > 0 THEN ahead ELSE NOT ahead END AS direction_ok FROM r JOIN seg ON seg.seg_id = r.seg_id LEFT JOIN turn t ON t.track_id = r.track_id AND t.seg_id = r.seg_id)
SELECT track_id, seg_id, planned, CAST(floor(close * 1000.0 / n + 0.5) AS BIGINT) AS permille, direction_ok, CASE WHEN ok AND direction_ok THEN 'completed' WHEN ok AND NOT direction_ok THEN 'wrong_ascent_direction' WHEN ok THEN 'direction_unverified' WHEN s <> e AND 100 * close < 35 * n THEN 'near_touch' WHEN 10 * close >= 2 * n THEN 'partial' WHEN s OR e THEN 'near_touch' ELSE 'not_matched' END AS status
FROM q WHERE planned OR ok OR s OR e OR 10 * close >= 2 * n"""

QUERIES = {"join_12_coverage_match": _match, "join_13_completion_review": _review, "aud_05_official_coverage": _audit}
ORACLES = {
    "join_12_coverage_match": _SET + "SELECT track_id, seg_id, close, n AS samples FROM hit WHERE 100 * close >= 55 * n",
    "join_13_completion_review": _SET + _REVIEW,
    "aud_05_official_coverage": _SET
    + ", r AS (SELECT c.track_id, c.seg_id, coalesce(close, 0) AS close, coalesce(h.n, 1) AS n, t.ahead FROM claim c LEFT JOIN hit h ON h.track_id = c.track_id AND h.seg_id = c.seg_id LEFT JOIN turn t ON t.track_id = c.track_id AND t.seg_id = c.seg_id), f AS (SELECT *, 'claimed_segment_not_covered' AS failure FROM r WHERE 100 * close < 85 * n UNION ALL SELECT *, 'direction_rule_violated' FROM r WHERE NOT ahead) SELECT track_id, seg_id, CAST(floor(close * 1000.0 / n + 0.5) AS BIGINT) AS permille, failure FROM f",
}
