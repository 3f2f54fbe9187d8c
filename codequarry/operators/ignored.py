"""Ignore verdicts found once per folder and handed down.

A file in a deep tree shares all its folders with its neighbours, so rules are
tested on each distinct folder once.  Files below an ignored folder are not
tested at all; the others are tested by their own path only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import ignore_rules as ig
from codequarry.functions.paths import ancestors, dirname
from codequarry.functions.text import lf, split_lines
from codequarry.operators.shared import broadcast_checked


def own_verdicts(entries: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None) -> DataFrame:
    """``repo, entry, own``: whether the rules name each distinct ``entry`` itself (folders end in a slash).

    Patterns common to all repositories are literals.  A repository's own
    rules meet its entries as one row each, sorted by rule, so that a task
    compiles a rule once for all entries of a repository; the last rule that
    matches decides.
    """
    common = F.coalesce(ig.verdict(F.col("entry"), ig.compile_patterns([*ig.DEFAULT_PATTERNS, *patterns])), F.lit(False))
    if rules is None:
        return entries.select("repo", "entry", common.alias("own"))
    listed = rules.select("repo", F.posexplode("rules").alias("pos", "rule"))
    met = entries.join(listed, "repo").sortWithinPartitions("repo", "pos")
    # a regular expression that comes from a column is kept compiled while it stays the same
    matching = F.when(F.regexp_instr("entry", F.col("rule.regex")) > 0, F.col("pos"))
    last = met.groupBy("repo", "entry").agg(F.max_by(~F.col("rule.negated"), matching).alias("_last"))
    return entries.join(last, ["repo", "entry"], "left").select("repo", "entry", F.coalesce("_last", common).alias("own"))


def ignored_folders(files: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None) -> DataFrame:
    """``repo, folder``: every folder holding files that is ignored, by itself or by a folder above it.

    The verdict of a folder is handed down by one equi-join of each folder's
    ancestors with the folders that rules name.
    """
    holding = files.select("repo", dirname(F.col("path")).alias("folder")).filter("folder <> '.'").distinct()
    chain = holding.select("repo", "folder", F.explode(F.array_append(ancestors(F.col("folder")), F.col("folder"))).alias("above"))
    entries = chain.select("repo", F.concat("above", F.lit("/")).alias("entry")).distinct()
    named = own_verdicts(entries, patterns, rules).filter("own").select("repo", F.rtrim("entry", F.lit("/")).alias("above"))
    return chain.join(broadcast_checked(named), ["repo", "above"], "left_semi").select("repo", "folder").distinct()


def ignored_paths(files: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None) -> DataFrame:
    """``repo, path`` of every distinct ignored file; the same files as ``with_ignored`` marks."""
    listing = files.select("repo", "path", dirname(F.col("path")).alias("folder"))
    folders = broadcast_checked(ignored_folders(files, patterns, rules))
    below = listing.join(folders, ["repo", "folder"], "left_semi").select("repo", "path").distinct()
    others = listing.join(folders, ["repo", "folder"], "left_anti").select("repo", F.col("path").alias("entry")).distinct()
    named = own_verdicts(others, patterns, rules).filter("own").select("repo", F.col("entry").alias("path"))
    return below.unionByName(named)


def visible(files: DataFrame, patterns: Sequence[str] = (), rules: DataFrame | None = None) -> DataFrame:
    """``files`` without the ignored ones; texts stay where they are as long as the ignored paths are few."""
    return files.join(broadcast_checked(ignored_paths(files, patterns, rules)), ["repo", "path"], "left_anti").select(*files.columns)


def _backward(line: Column) -> Column:
    """Whether a class of the line holds a range that runs backwards."""
    classes = F.regexp_extract_all(line, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    ranges = F.flatten(F.transform(classes, lambda c: F.regexp_extract_all(c, F.lit(r"([^\\]-[^\\])"), F.lit(1))))
    return F.exists(ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))


def ignore_report(files: DataFrame) -> DataFrame:
    """``repo, line_no, line, kind, problem``: every line of each repository's root ``.gitignore``.

    ``kind`` is ``blank``, ``comment``, ``negated``, ``pattern``, or ``void``
    for a line that names nothing.  ``problem`` tells what is wrong with a
    pattern: a ``backward range``, an ``unclosed class`` or a ``dangling
    escape``; null when nothing is.  No such line stops the others.
    """
    own = files.filter(F.col("path") == ".gitignore")
    cut = own.select("repo", F.posexplode(split_lines(lf(F.coalesce("text", F.lit(""))))).alias("_at", "raw"))
    line = F.regexp_replace("raw", r"(?<!\\) +$", "")
    body = F.regexp_replace("line", r"^!?/*|/+$", "")
    kind = (F.when(F.col("line") == "", "blank").when(F.startswith(F.col("line"), F.lit("#")), "comment").when(body == "", "void")
            .when(F.startswith(F.col("line"), F.lit("!")), "negated").otherwise("pattern"))
    problem = F.when(F.col("kind").isin("negated", "pattern"), (
        F.when(_backward(F.col("line")), "backward range").when(F.rlike("line", F.lit(r"(?<!\\)\[[^\]]*$")), "unclosed class")
        .when(F.rlike("line", F.lit(r"(?<!\\)(?:\\\\)*\\$")), "dangling escape")))
    return (cut.select("repo", (F.col("_at") + 1).alias("line_no"), line.alias("line")).withColumn("kind", kind)
            .select("repo", "line_no", "line", "kind", problem.alias("problem")))
