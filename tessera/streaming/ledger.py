"""The progress ledger as a stream: latest review of a day wins, state is folded per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.checkpoints import checkpointed

SCHEMA = "epoch string, day_id string, version long, segment_id long, kind string"


def latest_reviews(events: DataFrame) -> DataFrame:
    """Rows of the highest version of each (epoch, day_id): a later review replaces the whole day."""
    newest = events.groupBy("epoch", "day_id").agg(F.max("version").alias("version"))
    return events.join(newest, ["epoch", "day_id", "version"])


def folded(events: DataFrame) -> DataFrame:
    """epoch, segment_id, state: completed unless blocked at the end; a missed segment alone is open."""
    by = latest_reviews(events).groupBy("epoch", "segment_id").agg(F.bool_or(F.col("kind") == "blocked").alias("b"), F.bool_or(F.col("kind").isin("completed", "extra_completed")).alias("c"))
    return by.select("epoch", "segment_id", F.when(F.col("b"), "blocked").when(F.col("c"), "completed").otherwise("open").alias("state"))


def phone_progress(events: DataFrame) -> DataFrame:
    """epoch, segment_id of (completed or extra) less missed and blocked."""
    kinds = latest_reviews(events).groupBy("epoch", "segment_id").agg(F.collect_set("kind").alias("k"))
    done, gone = F.array(F.lit("completed"), F.lit("extra_completed")), F.array(F.lit("missed"), F.lit("blocked"))
    return kinds.where(F.arrays_overlap("k", done) & ~F.arrays_overlap("k", gone)).select("epoch", "segment_id")


def locked_baseline(current: DataFrame, existing: DataFrame | None, force: bool = False) -> DataFrame:
    """The first baseline stays unless forced."""
    return existing if existing is not None and not force else current


def start_ledger(events: DataFrame, ledger_path: str, checkpoint: str):
    """Stream reviews into the ledger: each micro-batch replaces its (epoch, day_id) partitions by their newest version."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        try:
            old = spark.read.schema(SCHEMA).parquet(ledger_path)
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], SCHEMA)
        touched = batch.select("epoch", "day_id").distinct()
        rows = checkpointed(latest_reviews(old.join(touched, ["epoch", "day_id"], "left_semi").unionByName(batch)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "day_id").parquet(ledger_path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Day windows of a stream of events (ts, user_id, value) with a watermark: n, total by user."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def islands(rows: DataFrame, key: str, day: str) -> DataFrame:
    """key, first_day, days of runs of consecutive days."""
    d = rows.select(key, F.col(day).alias("d")).distinct()
    run = F.date_sub("d", F.row_number().over(Window.partitionBy(key).orderBy("d")))
    return d.withColumn("run", run).groupBy(key, "run").agg(F.min("d").alias("first_day"), F.count(F.lit(1)).alias("days")).drop("run")
