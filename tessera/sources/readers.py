"""Readers of the planning formats: GeoJSON, GPX, CSV activity exports, state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import render

_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
_LINE, _LINES = "array<array<double>>", "array<array<array<double>>>"


def _points(coordinates) -> Column:
    """array<struct<lon,lat>> of arrays of numbers; further dimensions go."""
    return F.transform(coordinates, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def features(spark: SparkSession, path: str) -> DataFrame:
    """properties (map), kind, coordinates (JSON text) of every feature of GeoJSON collections; one row each."""
    docs = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    return docs.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def line_parts(rows: DataFrame) -> DataFrame:
    """Adds part, points: one row for each part of a line; parts of a multi-line under two points go, other kinds have none."""
    single = F.array(F.from_json("coordinates", _LINE))
    several = F.filter(F.from_json("coordinates", _LINES), lambda p: F.size(p) >= 2)
    parts = F.when(F.col("kind") == "LineString", single).when(F.col("kind") == "MultiLineString", several)
    return rows.select("*", F.posexplode(parts).alias("part", "__line")).withColumn("points", _points(F.col("__line"))).drop("__line")


def flattened(rows: DataFrame) -> DataFrame:
    """Adds points: all vertices of a line or multi-line in one array."""
    several = F.flatten(F.from_json("coordinates", _LINES))
    line = F.when(F.col("kind") == "LineString", F.from_json("coordinates", _LINE)).when(F.col("kind") == "MultiLineString", several)
    return rows.withColumn("points", _points(line))


def official_segments(spark: SparkSession, path: str) -> DataFrame:
    """seg_id, seg_name, trail_name, miles, direction, points, start, end, bounding box; empty geometries go, several parts are an error."""
    p = F.col("properties")
    rows = flattened(features(spark, path))
    parts = F.when(F.col("kind") == "MultiLineString", F.size(F.from_json("coordinates", _LINES))).otherwise(1)
    rows = rows.where(F.size("points") > 0).withColumn("__ok", F.when(parts > 1, F.raise_error(F.lit("segments of several parts are not supported"))).otherwise(True)).where("__ok")
    name = F.coalesce(p["segName"], F.lit(""))
    return rows.select(
        p["segId"].cast("long").alias("seg_id"), name.alias("seg_name"), F.regexp_replace(F.trim(name), r"\s+\d+$", "").alias("trail_name"), (F.coalesce(p["LengthFt"].cast("double"), F.lit(0.0)) / 5280).alias("miles"),
        F.coalesce(p["direction"], F.lit("both")).alias("direction"), F.coalesce(p["activity_type"], F.lit("foot")).alias("activity_type"), "points", F.col("points")[0].alias("start"), F.element_at("points", -1).alias("end"),
        *(f(F.col(f"points.{k}")).alias(n) for n, f, k in (("west", F.array_min, "lon"), ("south", F.array_min, "lat"), ("east", F.array_max, "lon"), ("north", F.array_max, "lat"))),
    )


def named_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """name (first one given of several properties), source, part, points of lines of at least two points."""
    p = F.col("properties")
    name = F.coalesce(*(F.nullif(p[k], F.lit("")) for k in ("TrailName", "Name", "SystemName", "OBJECTID")), F.lit("unnamed"))
    return line_parts(features(spark, path)).where(F.size("points") >= 2).select(name.alias("name"), F.lit(source).alias("source"), "part", "points")


def trailheads(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat, parking_minutes of point features; coordinates from the properties, else the geometry."""
    p, at = F.col("properties"), F.from_json("coordinates", "array<double>")
    return features(spark, path).where("kind = 'Point'").select(
        F.coalesce(p["name"], p["Name"], p["TrailheadName"], F.lit("unnamed")).alias("name"), F.coalesce(p["lon"].cast("double"), at[0]).alias("lon"), F.coalesce(p["lat"].cast("double"), at[1]).alias("lat"), F.coalesce(p["parking_minutes"].cast("int"), F.lit(8)).alias("parking_minutes")
    )


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """path, track, segment, ordinal, lon, lat, elevation_m, time of all track points of GPX files."""
    point = "struct<_lat:double,_lon:double,ele:double,time:string>"
    rows = spark.read.format("xml").option("rowTag", "trk").schema(f"name string, trkseg array<struct<trkpt:array<{point}>>>").load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("name").alias("track"), F.posexplode("trkseg").alias("segment", "s"))
    return rows.select("path", "track", "segment", F.posexplode("s.trkpt").alias("ordinal", "p")).select("path", "track", "segment", "ordinal", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ele").alias("elevation_m"), F.try_to_timestamp("p.time").alias("time"))


def activity_paces(spark: SparkSession, path: str) -> DataFrame:
    """id, pace (minutes a mile) of foot activities of at least half a mile in a CSV export; rows with bad numbers go."""
    rows = spark.read.option("header", True).csv(path)
    miles, minutes = F.expr("try_cast(distance_m AS DOUBLE)") / 1609.344, F.expr("try_cast(moving_time_s AS DOUBLE)") / 60
    return rows.where(F.col("sport_type").isin("Run", "TrailRun", "Hike", "Walk")).where((miles >= 0.5) & (minutes > 0)).select("id", (minutes / miles).alias("pace"))


def activity_days(spark: SparkSession, path: str) -> DataFrame:
    """id, day, year, weekday (0 is Monday), weekend, minutes, miles of runs in a CSV export."""
    rows, day = spark.read.option("header", True).csv(path), F.to_date(F.substring("start_date_local", 1, 10))
    return rows.where("sport_type = 'Run'").select("id", day.alias("day"), F.year(day).alias("year"), F.weekday(day).alias("weekday"), (F.weekday(day) >= 5).alias("weekend"), (F.expr("try_cast(moving_time_s AS DOUBLE)") / 60).alias("minutes"), (F.expr("try_cast(distance_m AS DOUBLE)") / 1609.344).alias("miles"))


def efforts(spark: SparkSession, path: str) -> DataFrame:
    """activity_id, activity, name, miles, minutes of the segment efforts in a folder of JSON files; undecodable files go."""
    schema = "id long, name string, segment_efforts array<struct<name:string,distance:double,elapsed_time:double>>, _broken string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken is null")
    e = rows.select(F.col("id").alias("activity_id"), F.col("name").alias("activity"), F.explode("segment_efforts").alias("e"))
    return e.select("activity_id", "activity", "e.name", (F.col("e.distance") / 1609.344).alias("miles"), (F.col("e.elapsed_time") / 60).alias("minutes")).where("miles >= 0.05 and minutes > 0")


def line_miles(points: str = "points") -> Column:
    """Length of an array of points."""
    body = render("@haversine_miles(x.a.lon,x.a.lat,x.b.lon,x.b.lat)")
    return F.expr(f"aggregate(zip_with(slice({points}, 1, size({points}) - 1), slice({points}, 2, size({points}) - 1), (a, b) -> struct(a, b)), 0D, (t, x) -> t + {body})")


#: The legacy planner's segment: ids are text, lengths feet.
LEGACY_SEGMENT = "seg_id string, name string, start struct<lon:double,lat:double>, end struct<lon:double,lat:double>, length_ft double, direction string, points array<struct<lon:double,lat:double>>"
#: The legacy planner's settings, one row.
LEGACY_CONFIG = "start_date date, end_date date, pace_minutes double, grade_factor double, daily_minutes int, drive_speed_mph double, max_days int"


def legacy_segments(spark: SparkSession, path: str) -> DataFrame:
    """Rows of LEGACY_SEGMENT from documents with ``trailSegments``; a segment without vertices goes."""
    schema = "trailSegments array<struct<properties:map<string,string>,geometry:struct<coordinates:array<array<double>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("trailSegments").alias("s")).where("size(s.geometry.coordinates) > 0")
    p, points = F.col("s.properties"), _points(F.col("s.geometry.coordinates"))
    rows = rows.select(
        F.coalesce(p["segId"], F.lit("")).alias("seg_id"), F.coalesce(p["segName"], F.lit("")).alias("name"), points[0].alias("start"), F.element_at(points, -1).alias("end"),
        F.coalesce(p["LengthFt"].cast("double"), F.lit(0.0)).alias("length_ft"), F.coalesce(p["direction"], F.lit("both")).alias("direction"), points.alias("points"),
    )
    return rows


def optional(spark: SparkSession, path: str, schema: str, read=None) -> DataFrame:
    """What ``read(spark, path)`` (by default JSON of ``schema``) gives, or an empty DataFrame of ``schema`` where nothing is at ``path``."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return read(spark, path) if read else spark.read.schema(schema).option("multiLine", True).json(path)
