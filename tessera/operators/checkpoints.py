"""Checkpoints go to the shared folder of the session; a local session without one gets a temporary folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, root, True)
        context.setCheckpointDir(root)
    return df.checkpoint()


def scratch(spark, name: str) -> str:
    """A new path in the shared checkpoint folder, for files that a query writes and reads again."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        checkpointed(spark.range(1))
    return f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
