"""Session helpers: reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; only a session in one process may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textlens-checkpoints-")
    context.setCheckpointDir(configured)


def settle(df: DataFrame) -> DataFrame:
    """Compute a reduced table once and keep it in reliable storage.

    For small results of expensive plans that are read more than once, such as counts
    drawn from all texts. A lost executor costs a re-read, not another pass.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: for tables that are scanned many
    times. Unlike ``settle`` it keeps columns apart, so a scan reads those it needs."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
