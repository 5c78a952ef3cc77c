"""Sinks: GPX text, keyed CSV upsert, manifests, redaction and the public-safety scan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Patterns that no published file may hold.
PRIVATE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?i)\b(token|secret|api[_-]?key)\b\s*[=:]")


def write_document(document: dict, path: str) -> None:
    """One small report as indented JSON with a final newline (driver side)."""
    with open(path, "w") as f:
        f.write(json.dumps(document, indent=2) + "\n")


def gpx_documents(points: DataFrame) -> DataFrame:
    """name, gpx: one GPX text for each name of points (name, segment, ordinal, lon, lat)."""
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"/>', "lat", "lon")
    lines = points.groupBy("name", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", point.alias("p")))), lambda x: x["p"]), "").alias("body"))
    tracks = lines.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "body"))), lambda x: F.concat(F.lit("<trkseg>"), x["body"], F.lit("</trkseg>"))), "").alias("body"))
    escaped = F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return tracks.select("name", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="tessera"><trk><name>'), escaped, F.lit("</name>"), F.col("body"), F.lit("</trk></gpx>")).alias("gpx"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, of equal keys the last of ``new``, else the last of ``old`` (by ``ordinal``)."""
    rows = old.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("__rank"), F.desc("ordinal"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__rank")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, digest of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def manifest_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem (missing, unexpected, mismatch) of two manifests."""
    a = actual.select("path", F.col("digest").alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when(F.col("found") != F.col("digest"), "mismatch")
    return expected.join(a, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")


def redacted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Only the named columns, private patterns in their texts replaced."""
    kinds = dict(rows.dtypes)

    def clean(name):
        out = F.col(name)
        for pattern in PRIVATE if kinds[name] == "string" else ():
            out = F.regexp_replace(out, pattern, "[private]")
        return out.alias(name)

    return rows.select(*map(clean, keep))


def unsafe_files(spark: SparkSession, path: str, tokens: tuple[str, ...] = ()) -> DataFrame:
    """path, reason of text files that hold a token or a private pattern."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    tests = [(F.col("value").contains(t), t) for t in tokens] + [(F.col("value").rlike(p), p) for p in PRIVATE]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))
    return rows.select("path", F.explode(found).alias("reason"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of the files at ``path``."""
    return manifest(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("digest").alias("sha256"))


def flat_columns(rows: DataFrame) -> DataFrame:
    """Nested structs as columns named with their path (``a.b`` becomes a_b); arrays and maps as JSON text."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def leaves(kind, at):
        for field in kind:
            column = f"{at}.`{field.name}`" if at else f"`{field.name}`"
            if isinstance(field.dataType, StructType):
                yield from leaves(field.dataType, column)
            else:
                value = F.to_json(column) if isinstance(field.dataType, (ArrayType, MapType)) else F.col(column)
                yield value.alias(column.replace("`", "").replace(".", "_"))

    return rows.select(*leaves(rows.schema, ""))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, nested columns flattened; nulls are empty."""
    flat_columns(rows).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def markdown_sections(rows: DataFrame, section: str, order: list[str], columns: list[str], most: int) -> DataFrame:
    """section, markdown: a heading and a table of the first ``most`` rows (by ``order``) of each section."""
    cells = lambda values: F.concat(F.lit("| "), F.array_join(F.array(*values), " | "), F.lit(" |"))
    shown = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where(F.col("__n") <= most)
    lines = ranked.groupBy(section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", cells(shown).alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)])
    return lines.select(section, F.concat(F.lit("## "), F.col(section).cast("string"), F.lit(f"\n\n{head}\n"), F.col("body"), F.lit("\n")).alias("markdown"))


def gpx_zip(documents: DataFrame, path: str) -> None:
    """One ZIP of small reports: name.gpx for each row of name, gpx, in name order (driver side, row by row)."""
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in documents.orderBy("name").toLocalIterator():
            z.writestr(zipfile.ZipInfo(f"{r.name}.gpx"), r.gpx)
