"""Readers and sinks over files written from the relational tables, with oracles on the tables themselves (SRC, SNK, STR-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import render
from ..operators.checkpoints import scratch
from ..sources import readers, writers
from .kernel_queries import _rows

_PARTS = "SELECT p_partkey AS k, p_name AS name, p_size AS z, @lon(p_partkey) AS lon, @lat(p_partkey) AS lat FROM part"


def _collection(spark, sf_dir, name: str, root: str) -> str:
    """A folder of GeoJSON documents of at most 1,000 parts each; every seventh is a line of two parts, the fifth of which is a lone point."""
    rows = _rows(spark, sf_dir, _PARTS)
    vertex = lambda dx: F.array(F.col("lon") + dx, F.col("lat"))
    line, several = F.array(vertex(0.0), vertex(0.01), vertex(0.02)), F.array(F.array(vertex(0.0), vertex(0.01)), F.when(F.col("k") % 5 == 0, F.array(vertex(0.03))).otherwise(F.array(vertex(0.03), vertex(0.04))))
    shape = F.when(F.col("k") % 7 == 0, F.struct(F.lit("MultiLineString").alias("type"), F.to_json(several).alias("coordinates"))).otherwise(F.struct(F.lit("LineString").alias("type"), F.to_json(line).alias("coordinates")))
    feature = F.concat(F.lit('{"properties":'), F.to_json(F.struct(F.col("k").alias("segId"), F.col("name").alias("segName"), (F.col("z") * 528).alias("LengthFt"))), F.lit(',"geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}}"))
    docs = rows.groupBy(F.floor(F.col("k") / 1000).alias("chunk")).agg(F.concat(F.lit(f'{{"{root}":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    path = scratch(spark, name)
    docs.write.partitionBy("chunk").text(path)
    return f"{path}/*"


def _documents(spark, sf_dir):
    rows = readers.features(spark, _collection(spark, sf_dir, "features", "features"))
    return rows.select(F.col("properties.segId").cast("long").alias("seg_id"), F.col("properties.segName").alias("name"), "kind")


def _flat(spark, sf_dir):
    rows = readers.flattened(readers.features(spark, _collection(spark, sf_dir, "flat", "features")))
    return rows.select(F.col("properties.segId").cast("long").alias("seg_id"), F.size("points").cast("long").alias("n"))


def _parts(spark, sf_dir):
    rows = readers.line_parts(readers.features(spark, _collection(spark, sf_dir, "parts", "features")))
    return rows.select(F.col("properties.segId").cast("long").alias("seg_id"), F.col("part").cast("long").alias("part"), F.size("points").cast("long").alias("n"))


def _legacy(spark, sf_dir):
    simple = _rows(spark, sf_dir, _PARTS + " WHERE p_partkey % 7 > 0")  # the legacy documents have no lines of several parts
    vertices = F.array(*[F.array(F.col("lon") + d, F.col("lat")) for d in (0.0, 0.01)])
    feature = F.struct(F.struct(F.col("k").cast("string").alias("segId"), F.col("name").alias("segName"), (F.col("z") * 528).alias("LengthFt")).alias("properties"), F.struct(vertices.alias("coordinates")).alias("geometry"))
    path = scratch(spark, "legacy")
    simple.groupBy(F.floor(F.col("k") / 1000).alias("chunk")).agg(F.to_json(F.struct(F.collect_list(feature).alias("trailSegments"))).alias("value")).write.partitionBy("chunk").text(path)
    rows = readers.legacy_segments(spark, f"{path}/*")
    return rows.select("seg_id", "name", "direction", F.floor("length_ft").cast("long").alias("feet"))


def _efforts(spark, sf_dir):
    """A folder of JSON files, one for each customer's orders; a segment effort for each order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    effort = F.struct(F.col("o_orderpriority").alias("name"), F.floor("o_totalprice").alias("distance"), (F.col("o_orderkey") % 1000).alias("elapsed_time")) if "o_orderpriority" in rows.columns else F.struct(F.col("o_orderstatus").alias("name"), F.floor("o_totalprice").alias("distance"), (F.col("o_orderkey") % 1000).alias("elapsed_time"))
    docs = rows.groupBy(F.pmod(F.col("o_custkey"), F.lit(20)).alias("id")).agg(F.collect_list(effort).alias("segment_efforts"))
    path = scratch(spark, "efforts")
    docs.select(F.col("id").alias("chunk"), F.to_json(F.struct("id", F.lit("runs").alias("name"), "segment_efforts")).alias("value")).write.partitionBy("chunk").text(path)
    found = readers.efforts(spark, f"{path}/*")
    return found.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("minutes") * 60 + 0.5)).cast("long").alias("seconds"))


def _gpx(spark, sf_dir):
    points = _rows(spark, sf_dir, "SELECT CAST(track_id AS STRING) AS name, 0 AS segment, idx AS ordinal, lon, lat FROM @track() t")
    path = scratch(spark, "gpx")
    # A file for each track: a GPX file has one root.
    writers.gpx_documents(points).select("name", F.col("gpx").alias("value")).write.partitionBy("name").text(path)
    return readers.gpx_points(spark, f"{path}/*").select(F.col("track").cast("long").alias("track_id"), F.col("ordinal").cast("long").alias("ordinal"), F.floor(F.col("lon") * 1e4 + 0.5).cast("long").alias("lon"), F.floor(F.col("lat") * 1e4 + 0.5).cast("long").alias("lat"))


def _csv(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("anchor"), F.when(F.col("s_acctbal") > 2000, F.struct(F.lit(True).alias("parking"))).alias("place"))
    path = scratch(spark, "csv")
    writers.write_csv(rows, path)
    return spark.read.option("header", True).csv(path).select(F.col("anchor_id").cast("long").alias("anchor_id"), "anchor_name", F.coalesce("place_parking", F.lit("none")).alias("parking"))


def _markdown(spark, sf_dir):
    rows = _rows(spark, sf_dir, "SELECT CAST(status AS STRING) AS status, outing_id, minutes FROM @outings() o")
    return writers.markdown_sections(rows, "status", ["minutes", "outing_id"], ["outing_id", "minutes"], 10)


def _hashes(spark, sf_dir):
    """Files named by their first line's key, one for each nation."""
    path = scratch(spark, "hash")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nations.select(F.col("n_nationkey").alias("chunk"), F.col("n_name").alias("value")).write.partitionBy("chunk").text(path)
    found = writers.manifest(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", "chunk=([0-9]+)", 1).cast("long").alias("nation"), F.col("digest").alias("sha256"))


def _absent(spark, sf_dir):
    """Optional documents: those that are there, and none for a path where nothing is."""
    here = readers.optional(spark, scratch(spark, "absent"), "region long, name string")
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    path = scratch(spark, "present")
    rows.write.json(path)
    return here.union(readers.optional(spark, path, "region long, name string", lambda s, p: s.read.schema("region long, name string").json(p)))


QUERIES = {
    "src_01_json_documents": _documents,
    "src_04_flattened_geometry": _flat,
    "src_05_line_parts": _parts,
    "src_11_json_folder": _efforts,
    "src_13_gpx_points": _gpx,
    "src_25_optional_source": _absent,
    "src_27_legacy_segments": _legacy,
    "snk_02_csv": _csv,
    "snk_04_markdown": _markdown,
    "str_21_file_hash": _hashes,
}
ORACLES = {
    "src_01_json_documents": "SELECT p_partkey AS seg_id, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN 'MultiLineString' ELSE 'LineString' END AS kind FROM part",
    "src_04_flattened_geometry": "SELECT p_partkey AS seg_id, CAST(CASE WHEN p_partkey % 7 > 0 OR p_partkey % 5 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n FROM part",
    "src_05_line_parts": "SELECT p_partkey AS seg_id, CAST(0 AS BIGINT) AS part, CAST(CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 1, 2 FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 > 0",
    "src_11_json_folder": "SELECT CAST(o_custkey % 20 AS BIGINT) AS activity_id, count(*) AS n, CAST(sum(o_orderkey % 1000) AS BIGINT) AS seconds FROM orders WHERE floor(o_totalprice) / 1609.344 >= 0.05 AND o_orderkey % 1000 > 0 GROUP BY 1",
    "src_13_gpx_points": render("SELECT track_id, CAST(idx - 1 AS BIGINT) AS ordinal, @q(lon,1e4) AS lon, @q(lat,1e4) AS lat FROM @track() t", "duckdb"),
    "src_25_optional_source": "SELECT CAST(r_regionkey AS BIGINT) AS region, r_name AS name FROM region",
    "src_27_legacy_segments": "SELECT CAST(p_partkey AS VARCHAR) AS seg_id, p_name AS name, 'both' AS direction, CAST(p_size * 528 AS BIGINT) AS feet FROM part WHERE p_partkey % 7 > 0",
    "snk_02_csv": "SELECT CAST(s_suppkey AS BIGINT) AS anchor_id, s_name AS anchor_name, CASE WHEN s_acctbal > 2000 THEN 'true' ELSE 'none' END AS parking FROM supplier",
    "snk_04_markdown": render("WITH r AS (SELECT status, outing_id, minutes, row_number() OVER (PARTITION BY status ORDER BY minutes, outing_id) AS n FROM @outings() o) SELECT status, '## ' || status || chr(10) || chr(10) || '| outing_id | minutes |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || outing_id || ' | ' || CAST(minutes AS VARCHAR) || ' |', chr(10) ORDER BY n) || chr(10) AS markdown FROM r WHERE n <= 10 GROUP BY status", "duckdb"),
    "str_21_file_hash": "SELECT CAST(n_nationkey AS BIGINT) AS nation, sha256(n_name || chr(10)) AS sha256 FROM nation",
}
