"""The shared file filter (P1-P8) and its per-file explanation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import ignore_rules as ig
from codequarry.functions import paths
from codequarry.operators.shared import broadcast_checked

# Usual size limits in bytes, for callers that want one; no operator applies them by itself.
SEARCH_MAX_SIZE = 1572864
READ_MAX_SIZE = 2097152


def repository_rules(files: DataFrame) -> DataFrame:
    """``repo, rules`` compiled from each repository's root ``.gitignore``.

    Only the ignore files themselves pass through the Python helper.  Their
    number is checked, so that file texts are not shuffled to meet them.
    """
    @F.pandas_udf(ig.RULES_TYPE)
    def compile_file(texts):
        return texts.map(lambda t: [
            {"regex": r.regex, "negated": r.negated} for r in ig.compile_patterns((t or "").split("\n"))
        ])

    own = files.filter(F.col("path") == ".gitignore")
    return broadcast_checked(own.select("repo", compile_file("text").alias("rules")))


def with_ignored(
    files: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None
) -> DataFrame:
    """Add ``ignored``; ``rules`` comes from :func:`repository_rules`."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else False
    if rules is None:
        return files.withColumn("ignored", ig.is_ignored(F.col("path"), is_dir, patterns))
    joined = files.join(rules.withColumnRenamed("rules", "_rules"), "repo", "left")
    return joined.withColumn(
        "ignored", ig.is_ignored(F.col("path"), is_dir, patterns, F.col("_rules"))
    ).drop("_rules")


def _reasons(
    max_size: int | None, max_depth: int | None, exts: str | Iterable[str] | None,
    path_pattern: str | None, sensitive: bool, binary: bool,
) -> list[tuple[str, Column]]:
    """Named rejections, cheap path tests first, then size, then content."""
    path = F.col("path")
    wanted = [
        ("depth", paths.within_depth(path, max_depth)),
        ("extension", paths.extension_in(path, exts)),
        ("path", paths.path_contains(path, path_pattern)),
    ]
    reasons = [(name, ~keep) for name, keep in wanted if keep is not None]
    if sensitive:
        reasons.append(("sensitive", paths.is_sensitive(path)))
    if max_size is not None:
        reasons.append(("size", F.coalesce(F.col("size"), F.lit(0)) > max_size))
    if binary:
        reasons.append(("binary", F.col("is_binary")))
    return reasons


def eligible(
    files: DataFrame,
    *,
    exts: str | Iterable[str] | None = None,
    path_pattern: str | None = None,
    max_size: int | None = None,
    max_depth: int | None = None,
    sensitive: bool = True,
    binary: bool = True,
    ignore: bool = True,
    patterns: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> DataFrame:
    """Files an operator may look at: every predicate of the shared filter."""
    out = files
    for _, reject in _reasons(max_size, max_depth, exts, path_pattern, sensitive, binary):
        out = out.filter(~reject)
    if ignore:
        out = with_ignored(out, patterns, rules).filter(~F.col("ignored")).drop("ignored")
    return out


def eligibility(
    files: DataFrame,
    *,
    exts: str | Iterable[str] | None = None,
    path_pattern: str | None = None,
    max_size: int | None = None,
    max_depth: int | None = None,
    patterns: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> DataFrame:
    """``repo, path, reason``: the first reason to leave a file out, or ``ok``."""
    marked = with_ignored(files, patterns, rules)
    reason = F.when(F.col("ignored"), F.lit("ignored"))
    for name, reject in _reasons(max_size, max_depth, exts, path_pattern, True, True):
        reason = reason.when(reject, F.lit(name))
    return marked.select("repo", "path", reason.otherwise(F.lit("ok")).alias("reason"))


def request_status(request_path: Column, found: Column, ignored: Column, size: Column,
                   is_binary: Column, max_size: int | None = None) -> Column:
    """Why a request for one file is refused, NULL when it is not."""
    status = (
        F.when(paths.escapes_root(request_path), F.lit("denied"))
        .when(paths.is_sensitive(paths.slashes(request_path)), F.lit("sensitive"))
        .when(ignored, F.lit("ignored"))
        .when(~found, F.lit("missing"))
    )
    if max_size is not None:
        status = status.when(F.coalesce(size, F.lit(0)) > max_size, F.lit("too_large"))
    return status.when(is_binary, F.lit("binary")).otherwise(F.lit(None).cast(T.StringType()))


def with_rules(requests: DataFrame, rules: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """Requests with their repository's compiled ignore rules, and that column; neither when there are none."""
    if rules is None:
        return requests, None
    return requests.join(rules.withColumnRenamed("rules", "_rules"), "repo", "left"), F.col("_rules")


def lookup(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with the columns of the file they name, absent files included.

    Contents are first cut down to the requested files by a semi join, a
    broadcast one when the requests are few, so an unrequested text never
    enters the outer join.
    """
    norm = requests.withColumn("_path", paths.normalize(paths.slashes(F.col("path"))))
    wanted = broadcast_checked(norm.select("repo", F.col("_path").alias("path")).distinct())
    hits = (files.join(wanted, ["repo", "path"], "left_semi")
            .select("repo", F.col("path").alias("_path"), "size", "is_binary", "text",
                    F.lit(True).alias("_found")))
    return norm.join(hits, ["repo", "_path"], "left").withColumn(
        "_found", F.coalesce(F.col("_found"), F.lit(False))
    )
