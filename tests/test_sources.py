import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.expressions import expr, render
from tessera.operators.components import connected_components
from tessera.sources import readers, writers
from tessera.streaming import ledger


def collection(tmp_path, *features):
    path = f"{tmp_path}/a.json"
    with open(path, "w") as f:
        json.dump({"features": [{"properties": p, "geometry": {"type": k, "coordinates": c}} for p, k, c in features]}, f)
    return path


def test_geojson(spark, tmp_path):
    path = collection(tmp_path, ({"segId": 7, "segName": "Long Hill 2", "LengthFt": 5280}, "LineString", [[-116, 43, 9], [-116, 43.1]]), ({"segId": 8, "segName": "X", "direction": "ascent"}, "LineString", []), ({"Name": "Lot"}, "Point", [-116.5, 43.5]), ({"TrailName": ""}, "MultiLineString", [[[1, 2]], [[1, 2], [3, 4]]]))
    rows = readers.official_segments(spark, collection(tmp_path, ({"segId": 7, "segName": "Long Hill 2", "LengthFt": 5280}, "LineString", [[-116, 43, 9], [-116, 43.1]]), ({"segId": 8}, "LineString", []))).withColumn("d", readers.line_miles())
    (r,) = rows.collect()
    assert (r.seg_id, r.trail_name, r.miles, r.direction, r.start.lat, r.north) == (7, "Long Hill", 1.0, "both", 43.0, 43.1) and abs(r.d - 6.909) < 0.01
    path = collection(tmp_path, ({"Name": "Lot"}, "Point", [-116.5, 43.5]), ({"TrailName": "", "Name": "N"}, "MultiLineString", [[[1, 2]], [[1, 2], [3, 4]]]))
    assert [(r.name, r.lon, r.parking_minutes) for r in readers.trailheads(spark, path).collect()] == [("Lot", -116.5, 8)]
    assert [(r.name, r.source, len(r.points)) for r in readers.named_lines(spark, path, "r2r").collect()] == [("N", "r2r", 2)]
    with pytest.raises(Exception, match="several parts"):
        readers.official_segments(spark, collection(tmp_path, ({"segId": 1}, "MultiLineString", [[[1, 2], [3, 4]], [[1, 2], [3, 4]]]))).collect()


def test_gpx_and_csv(spark, tmp_path):
    pts = spark.createDataFrame([("a & b", 0, k, -116.0 - k, 43.5) for k in range(3)], "name string, segment int, ordinal int, lon double, lat double")
    (doc,) = writers.gpx_documents(pts).collect()
    (tmp_path / "t.gpx").write_text(doc.gpx)
    back = readers.gpx_points(spark, f"{tmp_path}/t.gpx").orderBy("ordinal").collect()
    assert [(r.track, r.lon) for r in back] == [("a & b", -116.0), ("a & b", -117.0), ("a & b", -118.0)]
    (tmp_path / "a.csv").write_text("id,sport_type,start_date_local,distance_m,moving_time_s\n1,Run,2026-06-20T08:00:00,3218.688,1200\n2,Ride,2026-06-20,9000,900\n3,Run,2026-06-19,bad,1\n")
    assert [(r.id, r.pace) for r in readers.activity_paces(spark, f"{tmp_path}/a.csv").collect()] == [("1", 10.0)]
    assert [(r.id, r.weekend) for r in readers.activity_days(spark, f"{tmp_path}/a.csv").collect()] == [("1", True), ("3", False)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/1.json").write_text(json.dumps({"id": 5, "name": "run", "segment_efforts": [{"name": "x", "distance": 1609.344, "elapsed_time": 600}, {"name": "y", "distance": 1, "elapsed_time": 1}]}))
    (tmp_path / "d/2.json").write_text("{oops")
    assert [(r.activity_id, r.name, r.minutes) for r in readers.efforts(spark, f"{tmp_path}/d").collect()] == [(5, "x", 10.0)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k int, ordinal int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "k int, ordinal int, v string")
    assert sorted((r.k, r.v) for r in writers.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    (tmp_path / "x.txt").write_text("write to a@b.org")
    (tmp_path / "y.txt").write_text("fine")
    assert writers.unsafe_files(spark, str(tmp_path)).count() == 1
    m = writers.manifest(spark, f"{tmp_path}/*.txt")
    assert writers.manifest_problems(m, m).count() == 0 and writers.manifest_problems(m, m.limit(1)).first().problem == "missing"
    assert writers.redacted(spark.createDataFrame([("a@b.org x", 1)], "t string, n int"), ["t"]).first().t == "[private] x"


def test_ledger(spark, tmp_path):
    rows = [("e", "d1", 1, 101, "completed"), ("e", "d1", 2, 102, "completed"), ("e", "d2", 1, 103, "completed"), ("e", "d3", 1, 103, "blocked"), ("e", "d3", 1, 104, "missed")]
    df = spark.createDataFrame(rows, ledger.SCHEMA)
    assert sorted((r.segment_id, r.state) for r in ledger.folded(df).collect()) == [(102, "completed"), (103, "blocked"), (104, "open")]
    assert [r.segment_id for r in ledger.phone_progress(df).collect()] == [102]
    for k, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, ledger.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ledger.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ledger.start_ledger(stream, f"{tmp_path}/ledger", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.schema(ledger.SCHEMA).parquet(f"{tmp_path}/ledger")
    assert sorted((r.day_id, r.segment_id) for r in got.collect()) == [("d1", 102), ("d2", 103), ("d3", 103), ("d3", 104)]


def test_text_and_expressions(spark):
    df = spark.createDataFrame([("abc", "abcd"), ("abc", "abc"), ("", "x"), ("kitten", "sitting")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(text.name_similarity("a", "b")).collect()] == [0.9, 1.0, 0.0, 0.615]
    assert text.visible("<p>a&amp;b<script>x<y</script> c</p>") == "a&b c" and text.natural("a10") > text.natural("a9")
    assert spark.range(1).select(expr("turn_phrase", "-80e0")).first()[0] == "turn left"
    assert "@" not in render("@normal_name(x)")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "u long, v long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 9)]
    assert ledger.islands(df.select(F.lit(1).alias("k"), F.to_date(F.lit("2026-06-01")).alias("d")), "k", "d").first().days == 1
