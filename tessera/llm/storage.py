"""Shared storage: where operators write tables and files that every executor must see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests), a temporary one.

    A temporary folder is only made for a local master: on a cluster the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, root, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in shared storage, read again: cuts the lineage and fixes the rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) for a shared URI; works in the driver and in Python workers."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_atomic(uri: str, write) -> None:
    """Call write(stream) on a temporary name, then rename: repeated attempts leave one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, buffer_size=1 << 20) as out:
        write(out)
    fs.move(temporary, path)


#: Bytes that one Arrow batch sent to Python may hold: bounds worker memory where texts are long.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES; a smaller one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def shared_if_small(df: DataFrame, rows: int, lists: str | None = None) -> DataFrame:
    """``df`` (a written table) marked for broadcast where it has at most ``rows`` rows, else as it is.

    With ``lists``, an array column, its elements are counted, not the rows.
    """
    from pyspark.sql import functions as F

    n = (df.agg(F.sum(F.size(lists))).first()[0] or 0) if lists else df.count()
    return F.broadcast(df) if n <= rows else df


#: Bits of a sieve, in words of 64: at most 262,144 rows whatever the number of keys.
SIEVE_BITS = 24


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """__word, __bits: the bitmap of the hashes of ``column``. Its size has a bound, so it may be broadcast; more keys let more pass."""
    from pyspark.sql import functions as F

    h = f"(xxhash64(`{column}`) & {(1 << SIEVE_BITS) - 1}L)"
    bits = keys.select(F.expr(f"shiftright({h}, 6)").alias("__word"), F.expr(f"shiftleft(1L, cast({h} & 63 as int))").alias("__bits"))
    return bits.groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))


def sifted(df: DataFrame, column: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be a key of the sieve, rows whose ``column`` is none), without a shuffle of ``df``."""
    from pyspark.sql import functions as F

    h = f"(xxhash64(`{column}`) & {(1 << SIEVE_BITS) - 1}L)"
    met = df.withColumn("__word", F.expr(f"shiftright({h}, 6)")).join(F.broadcast(bitmap), "__word", "left")
    met = met.withColumn("__hit", F.expr(f"coalesce((__bits & shiftleft(1L, cast({h} & 63 as int))) <> 0, false)"))
    return tuple(met.where(side).drop("__word", "__bits", "__hit") for side in ("__hit", "not __hit"))
