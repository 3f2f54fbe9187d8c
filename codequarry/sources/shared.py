"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder its context was given.

    A single-machine session without either gets a new one; on a cluster, a
    folder of the driver's machine would be invisible to others, so there the
    setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to storage every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def new_location(spark: SparkSession, name: str) -> str:
    """A location in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps repeat none of its work, and a lost executor loses none."""
    location = new_location(df.sparkSession, name)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
