"""Validated find-and-replace patches that produce a new snapshot."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions.ignore_rules import is_ignored
from codequarry.functions.paths import normalize, slashes
from codequarry.functions.text import bind, has_nul, lf, line_count, occurrences, replace_first
from codequarry.operators.eligible import lookup, request_status, with_rules
from codequarry.operators.shared import broadcast_checked
from codequarry.sources.tables import FILE_COLUMNS, as_files

PATCHES_PER_PASS = 256

STATE = (
    "struct<text:string,applied:int,"
    "results:array<struct<patch_id:string,seq:int,status:string,occurrences:int,old_lines:int,new_lines:int>>>"
)


@dataclass(frozen=True)
class PatchRun:
    """``results``: one row per patch; ``changed``: files rows with new text."""

    results: DataFrame
    changed: DataFrame


def _apply_one(state: Column, patch: Column) -> Column:
    """Judge one patch against the file as the patch before left it, and apply it if it is valid.

    Whether the file is text, and how its lines end, is looked at anew for
    every patch, so the outcome does not depend on how patches are grouped.
    """
    content, new = state["text"], lf(patch["replacement"])
    read = F.struct(
        lf(content).alias("text"), F.contains(content, F.lit("\r\n")).alias("crlf"), lf(patch["target"]).alias("target"),
        has_nul(F.substring(content, 1, 512).cast("binary")).alias("binary"))

    def found(file: Column) -> Column:
        hits = F.when(file["binary"] | (file["target"] == ""), F.lit(0)).otherwise(occurrences(file["text"], file["target"]))
        return F.struct(*[file[name].alias(name) for name in ("text", "crlf", "target", "binary")], hits.alias("hits"))

    def judged(file: Column) -> Column:
        status = (
            F.when(file["binary"], F.lit("binary"))
            .when(file["target"] == "", F.lit("empty_target"))
            .when(file["hits"] == 0, F.lit("not_found"))
            .when((file["hits"] > 1) & ~patch["allow_multiple"], F.lit("ambiguous"))
            .otherwise(F.lit("applied"))
        )
        return bind(status, lambda s: F.struct(s.alias("status"), replaced(file, s).alias("after")))

    def replaced(file: Column, status: Column) -> Column:
        return F.when(status != "applied", file["text"]).when(
            patch["allow_multiple"], F.replace(file["text"], file["target"], new)).otherwise(
            replace_first(file["text"], file["target"], new))

    def outcome(file: Column, end: Column) -> Column:
        ok, after = end["status"] == "applied", end["after"]
        result = F.struct(
            patch["patch_id"].alias("patch_id"), patch["seq"].alias("seq"), end["status"].alias("status"), file["hits"].alias("occurrences"),
            F.when(~file["binary"], line_count(file["text"])).alias("old_lines"), F.when(~file["binary"], line_count(after)).alias("new_lines"),
        )
        written = F.when(~ok, content).when(file["crlf"], F.replace(after, F.lit("\n"), F.lit("\r\n"))).otherwise(after)
        return F.struct(
            written.alias("text"), (state["applied"] + ok.cast("int")).alias("applied"),
            F.array_append(state["results"], result).alias("results"),
        ).cast(STATE)

    # each step is bound, so that a text is searched and replaced once for each patch
    return bind(bind(read, found), lambda file: bind(judged(file), lambda end: outcome(file, end)))


def _one_pass(files: DataFrame, patches: DataFrame, patterns: Sequence[str],
              rules: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Fold every file's patches, in ``seq`` order, over its text."""
    grouped = patches.groupBy("repo", "path").agg(F.sort_array(F.collect_list(
        F.struct("seq", "patch_id", "target", "replacement", "allow_multiple"))).alias("_patches"))
    asked, own_rules = with_rules(grouped, rules)
    found = lookup(asked, files)
    ignored = is_ignored(normalize(slashes(F.col("path"))), patterns=patterns, repo_rules=own_rules)
    refused = request_status(F.col("path"), F.col("_found"), ignored, F.col("size"), F.col("is_binary"))
    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("applied"), F.array().alias("results")).cast(STATE)
    judged = found.withColumn("_refused", refused)
    folded = judged.withColumn("_end", F.when(
        F.col("_refused").isNull(), F.aggregate("_patches", start, _apply_one)
    ))
    rejected = F.transform("_patches", lambda p: F.struct(
        p["patch_id"].alias("patch_id"), p["seq"].alias("seq"), F.col("_refused").alias("status"),
        F.lit(0).alias("occurrences"), F.lit(None).cast("int").alias("old_lines"),
        F.lit(None).cast("int").alias("new_lines")))
    results = folded.select("repo", "path", F.inline(
        F.when(F.col("_refused").isNull(), F.col("_end.results")).otherwise(rejected)))
    # one request path per file carries the change; spellings are merged below
    changed = folded.filter(F.col("_end.applied") > 0)
    return results, as_files(changed, F.col("repo"), F.col("_path"), F.col("_end.text"))


def shared_checkpoint(spark: SparkSession) -> None:
    """Make sure checkpoints go to the folder that the session names for all executors."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to storage every executor can reach")
    sc.setCheckpointDir(shared)


def apply_patches(
    files: DataFrame, patches: DataFrame, patterns: Sequence[str] = (), per_pass: int = PATCHES_PER_PASS,
    rules: DataFrame | None = None,
) -> PatchRun:
    """Apply ``patches`` (``patch_id, seq, repo, path, target, replacement,
    allow_multiple``) to ``files``.

    Patches of one file apply in ``seq`` order, each to the outcome of the
    one before.  A file with more than ``per_pass`` patches is taken through
    several passes, so no task collects an unbounded list; the passes look at
    patched files only.  ``rules`` are the repositories' own ignore rules.
    """
    cleaned = patches.withColumn("path", F.when(
        F.startswith(slashes(F.col("path")), F.lit("/")), F.col("path")
    ).otherwise(normalize(slashes(F.col("path")))))
    most = cleaned.groupBy("repo", "path").count().agg(F.max("count")).first()[0] or 0
    passes = math.ceil(most / per_pass)
    if passes <= 1:
        return PatchRun(*_one_pass(files, cleaned, patterns, rules))
    shared_checkpoint(files.sparkSession)
    order = Window.partitionBy("repo", "path").orderBy("seq", "patch_id")
    numbered = cleaned.withColumn("_turn", F.floor((F.row_number().over(order) - 1) / per_pass)).checkpoint()
    named = broadcast_checked(cleaned.select("repo", normalize(slashes(F.col("path"))).alias("path")).distinct())
    patched = files.join(named, ["repo", "path"], "left_semi").checkpoint()
    results, current, ever = None, patched, None
    for turn in range(passes):
        part, changed = _one_pass(current, numbered.filter(F.col("_turn") == turn).drop("_turn"), patterns, rules)
        part, changed = part.checkpoint(), changed.checkpoint()
        results = part if results is None else results.unionByName(part)
        ever = changed if ever is None else snapshot(ever, changed)
        current = snapshot(current, changed)
    return PatchRun(results, ever)


def snapshot(files: DataFrame, changed: DataFrame) -> DataFrame:
    """K1: the files with changed ones replaced; unchanged texts are not shuffled
    when the changed keys are few."""
    keys = broadcast_checked(changed.select("repo", "path"))
    kept = files.join(keys, ["repo", "path"], "left_anti")
    return kept.select(*FILE_COLUMNS).unionByName(changed.select(*FILE_COLUMNS))
