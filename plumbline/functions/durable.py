"""Frames that are stored once and read back, so that reruns see the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Where all tasks run in the driver's own process and nothing is set, a
    temporary folder serves.  On a cluster it would not be shared, so there a
    missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and continue from the stored rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the checkpoint folder, read again, so that its true size is known to what joins it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
