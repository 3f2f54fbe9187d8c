"""The ``files`` table: building, reading, writing and spreading it.

Canonical columns: ``repo STRING, path STRING, size BIGINT, is_binary BOOLEAN,
text STRING``.  ``is_binary`` is computed once from the bytes (P3) so that no
later operator has to look at them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import decode_utf8, has_nul

TASKS_PER_CORE = 4

FILE_COLUMNS = ["repo", "path", "size", "is_binary", "text"]


def as_files(df: DataFrame, repo: Column, path: Column, text: Column) -> DataFrame:
    """A ``files`` table over any DataFrame that holds text."""
    named = df.select(repo.alias("repo"), path.alias("path"), text.alias("text"))
    return named.select(
        "repo", "path",
        F.octet_length("text").cast("bigint").alias("size"),
        has_nul(F.substring("text", 1, 512).cast("binary")).alias("is_binary"),
        "text",
    )


def from_content(df: DataFrame) -> DataFrame:
    """A ``files`` table from ``repo, path, content BINARY``."""
    return df.select(
        "repo", "path",
        F.octet_length("content").cast("bigint").alias("size"),
        has_nul(F.col("content")).alias("is_binary"),
        decode_utf8(F.col("content")).alias("text"),
    )


def read_files(spark: SparkSession, location: str) -> DataFrame:
    """A ``files`` table packed as Parquet."""
    return spark.read.parquet(location).select(*FILE_COLUMNS)


def write_files(files: DataFrame, location: str) -> None:
    """K1: store a snapshot at a new location; an existing one is never changed.

    Rows are clustered by repository so that a reader filtering on ``repo``
    skips row groups; range partitioning on the pair splits a huge repository.
    """
    (files.repartitionByRange("repo", "path").sortWithinPartitions("repo", "path")
        .write.mode("errorifexists").parquet(location))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input that is too small to fill the cluster's cores.

    A scan yields about one task per 128 MB, so an input below that per core
    leaves cores idle during regex or token work.  Only such an input is
    shuffled, which bounds the shuffle by cores x 128 MB; anything larger, or
    of unknown size, keeps its scan partitions.  Several tasks per core even
    out texts of very different lengths.  The rows are counted on the way as
    an observed metric: Spark does not move filters below one, so they too run
    in all tasks rather than in the few that scan.
    """
    if not hasattr(df, "_jdf"):  # a remote session shows no estimate; keep its partitions
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * (128 << 20):
        return df
    spread_out = df.repartition(cores * TASKS_PER_CORE, *keys)
    return spread_out.observe(f"spread_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
