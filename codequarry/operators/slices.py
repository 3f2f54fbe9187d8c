"""Line-range reads for a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.ignore_rules import is_ignored
from codequarry.functions.paths import slashes, normalize
from codequarry.functions.text import lf, line_count, split_lines
from codequarry.operators.eligible import lookup, request_status, with_rules


def slice_status(files: DataFrame, slices: DataFrame, patterns: Sequence[str] = (),
                 rules: DataFrame | None = None, max_size: int | None = None) -> DataFrame:
    """One row per request: its status and the range that will be read.

    Columns ``slice_id, repo, path, status, first_line, last_line,
    total_lines`` and the LF ``text`` of an accepted file.  ``rules`` are the
    repositories' own ignore rules; a larger file than ``max_size`` is refused.
    """
    asked, own_rules = with_rules(slices, rules)
    found = lookup(asked, files)
    ignored = is_ignored(normalize(slashes(F.col("path"))), patterns=patterns, repo_rules=own_rules)
    refused = request_status(F.col("path"), F.col("_found"), ignored, F.col("size"), F.col("is_binary"), max_size)
    judged = found.select("slice_id", "repo", "path", "start_line", "end_line",
                          refused.alias("refused"), lf(F.col("text")).alias("text"))
    total = F.when(F.col("refused").isNull(), line_count(F.col("text")))
    sized = judged.withColumn("total_lines", total)
    start = F.coalesce(F.nullif(F.col("start_line"), F.lit(0)), F.lit(1))
    end = F.least(F.coalesce(F.nullif(F.col("end_line"), F.lit(0)), F.col("total_lines")), F.col("total_lines"))
    status = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when((start < 0) | (end < 0), F.lit("bad_range"))
        .when(start > F.col("total_lines"), F.lit("start_past_end"))
        .otherwise(F.lit("ok"))
    )
    ranged = sized.select("slice_id", "repo", "path", status.alias("status"), start.alias("_start"),
                          end.alias("_end"), "total_lines", "text")
    ok = F.col("status") == "ok"
    return ranged.select(
        "slice_id", "repo", "path", "status", F.when(ok, F.col("_start")).alias("first_line"),
        F.when(ok, F.col("_end")).alias("last_line"), "total_lines", F.when(ok, F.col("text")).alias("text"),
    )


def slice_lines(files: DataFrame, slices: DataFrame, patterns: Sequence[str] = (),
                rules: DataFrame | None = None, max_size: int | None = None) -> DataFrame:
    """The requested lines: ``slice_id, repo, path, status, line_no, text``.

    A refused or empty request yields one row without a line.
    """
    judged = slice_status(files, slices, patterns, rules, max_size)
    length = F.greatest(F.col("last_line") - F.col("first_line") + 1, F.lit(0))
    chosen = F.slice(split_lines(F.col("text")), F.col("first_line"), length)
    rows = judged.select("slice_id", "repo", "path", "status", "first_line",
                         F.posexplode_outer(chosen).alias("pos", "line"))
    return rows.select("slice_id", "repo", "path", "status",
                       (F.col("first_line") + F.col("pos")).alias("line_no"), F.col("line").alias("text"))
