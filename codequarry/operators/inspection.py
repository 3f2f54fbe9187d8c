"""Outlines and dependencies of requested files, with a status for every request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.ignore_rules import is_ignored
from codequarry.functions.imports import first_of_each, import_array, resolve_import
from codequarry.functions.paths import ancestors, extension, normalize, slashes
from codequarry.functions.symbols import symbol_array
from codequarry.functions.text import lf, line_count
from codequarry.operators.dependencies import dependents, imports
from codequarry.operators.eligible import lookup, request_status, with_rules
from codequarry.operators.shared import broadcast_checked


def inspected(files: DataFrame, requests: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None,
              max_size: int | None = None) -> DataFrame:
    """``request_id, repo, path, status, target`` of each request, and the LF ``text`` and ``ext`` of an accepted file.

    ``requests`` has ``request_id, repo, path``; ``target`` is the path in its
    normal form.  A path below which files lie is a ``directory``.  The
    requested files are kept, since they are read once more for each use.
    """
    asked, own_rules = with_rules(requests, rules)
    found = lookup(asked, files)
    target = normalize(slashes(F.col("path")))
    refused = request_status(F.col("path"), F.col("_found"), is_ignored(target, patterns=patterns, repo_rules=own_rules),
                             F.col("size"), F.col("is_binary"), max_size)
    judged = found.select("request_id", "repo", "path", refused.alias("refused"), target.alias("target"), lf(F.col("text")).alias("text")).persist()
    absent = broadcast_checked(judged.filter("refused = 'missing'").select("repo", F.rtrim("target", F.lit("/")).alias("folder")).distinct())
    folders = files.select("repo", F.explode(ancestors(F.col("path"))).alias("folder")).join(absent, ["repo", "folder"], "left_semi").distinct()
    folders = broadcast_checked(folders.withColumn("is_folder", F.lit(True)))
    placed = judged.withColumn("folder", F.rtrim("target", F.lit("/"))).join(folders, ["repo", "folder"], "left")
    status = F.when(F.col("is_folder") & (F.col("refused") == "missing"), "directory").otherwise(F.coalesce("refused", F.lit("ok")))
    ok = F.col("refused").isNull()
    return placed.select("request_id", "repo", "path", status.alias("status"), "target", F.when(ok, F.col("text")).alias("text"),
                         F.when(ok, F.lower(extension(F.col("target")))).alias("ext"))


def outline_requests(files: DataFrame, requests: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None,
                     max_size: int | None = None) -> DataFrame:
    """``request_id, repo, path, status, line_count, symbols`` of every request; the last two are null when it is refused."""
    found = inspected(files, requests, patterns, rules, max_size)
    symbols = F.when(F.col("status") == "ok", symbol_array(F.col("text"), F.col("ext")))
    return found.select("request_id", "repo", "path", "status", line_count(F.col("text")).alias("line_count"), symbols.alias("symbols"))


def dependency_requests(files: DataFrame, requests: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None,
                        max_size: int | None = None) -> DataFrame:
    """``request_id, repo, path, status, internal, external, dependents``: what each requested file imports and how many import it.

    ``files`` is expected to be filtered by ``eligible``; only requested files
    are matched against the imports of the others.
    """
    found = inspected(files, requests, patterns, rules, max_size)
    specified = first_of_each(import_array(F.col("text"), F.col("ext")))
    local = F.transform(specified, lambda i: resolve_import(F.col("target"), i["specifier"]))
    judged = found.select("request_id", "repo", "path", "status", "target", F.when(F.col("status") == "ok", local).alias("local"))
    targets = judged.filter("status = 'ok'").select("repo", F.col("target").alias("path")).distinct()
    counts = dependents(imports(files), targets).groupBy("repo", F.col("dst").alias("target")).agg(F.count("*").alias("n"))
    internal = F.size(F.filter("local", lambda x: x.isNotNull()))
    counted = judged.join(counts, ["repo", "target"], "left")
    ok = F.col("status") == "ok"
    return counted.select("request_id", "repo", "path", "status", F.when(ok, internal).alias("internal"),
                          F.when(ok, F.size("local") - internal).alias("external"), F.when(ok, F.coalesce("n", F.lit(0))).alias("dependents"))
