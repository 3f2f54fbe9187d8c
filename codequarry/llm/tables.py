"""Reading tables, stored intermediate results and small plan helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or that of the session's context.

    Only a single-machine session without either gets a new one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to storage every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage, survives lost executors and keeps only the columns
    that a later step reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`stored`, bucketed by ``key``, so that a later join or cogroup on it need not shuffle ``df``."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    (df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("compression", "zstd")
     .option("path", f"{shared_dir(spark).rstrip('/')}/{unique}").saveAsTable(unique))
    return spark.table(unique)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)), F.lit(0))
