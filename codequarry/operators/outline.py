"""Symbol outlines of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.paths import extension
from codequarry.functions.symbols import symbol_array
from codequarry.functions.text import lf, line_count, truncate

# Fixed value: the usual length of a shown signature.
SHOWN = 120


def _typed(files: DataFrame) -> DataFrame:
    """Files with LF text and extension as columns, so no line derives them again."""
    return files.select("repo", "path", lf(F.col("text")).alias("text"),
                        F.lower(extension(F.col("path"))).alias("ext"))


def outline(files: DataFrame, shown: int | None = None) -> DataFrame:
    """``repo, path, line_no, kind, signature``: a narrow flat-map over files; ``shown`` cuts long signatures."""
    rows = _typed(files).select("repo", "path", F.inline(symbol_array(F.col("text"), F.col("ext"))))
    return rows if shown is None else rows.withColumn("signature", truncate(F.col("signature"), shown))


def outline_summary(files: DataFrame) -> DataFrame:
    """``repo, path, line_count, symbols`` per file, without a shuffle."""
    typed = _typed(files)
    return typed.select("repo", "path", line_count(F.col("text")).alias("line_count"),
                        F.size(symbol_array(F.col("text"), F.col("ext"))).alias("symbols"))
