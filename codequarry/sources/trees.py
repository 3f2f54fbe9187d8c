"""Reading directory trees, hidden and underscore names included.

Spark's own file index leaves out names that start with ``_`` or ``.``, which
for source trees loses ``__init__.py`` and ``.gitignore``.  Directories are
therefore listed level by level on the executors, so neither the driver nor
one task ever holds a tree, and the listed files are spread before they are
read.  The root must be storage that every executor mounts.

With ``prune``, ignore rules are applied while listing: a root's own
``.gitignore`` is compiled once, where the root is listed, and handed down
with each directory.  An ignored directory is never entered, so an entry needs
a verdict of its own only.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.ignore_rules import DEFAULT_PATTERNS, compile_patterns
from codequarry.functions.paths import escapes_root, normalize, slashes
from codequarry.sources.shared import stored
from codequarry.sources.tables import from_content

LISTING = "repo string, root string, path string, is_dir boolean, size bigint"
# Rules travel as (regex, negated) pairs, the last match decides; null where nothing is pruned.
_LEVEL = f"{LISTING}, rules array<struct<regex:string,negated:boolean>>"
ROWS_PER_BATCH = 10_000
BYTES_PER_BATCH = 32 << 20


@functools.lru_cache(maxsize=256)
def _compiled(rules: tuple[tuple[str, bool], ...]) -> list[tuple[re.Pattern, bool]]:
    return [(re.compile(regex), negated) for regex, negated in rules]


def _root_rules(root: str, patterns: Sequence[str]) -> list[tuple[str, bool]]:
    """The default rules, ``patterns`` and the root's own ignore file, in this order."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as handle:
            own = handle.read().split("\n")
    except OSError:
        own = []
    return [(rule.regex, rule.negated) for rule in compile_patterns([*DEFAULT_PATTERNS, *patterns, *own])]


def _is_ignored(entry: str, rules: tuple[tuple[str, bool], ...]) -> bool:
    verdict = False
    for pattern, negated in _compiled(rules):
        if verdict == negated and pattern.search(entry):
            verdict = not negated
    return verdict


def _lister(patterns: Sequence[str], prune: bool):
    """Lists each directory once, streaming its entries in bounded batches."""
    names = ["repo", "root", "path", "is_dir", "size", "rules"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for repo, root, path, rules in zip(batch["repo"], batch["root"], batch["path"], batch["rules"]):
                if not prune:
                    held = ()
                elif path == "":
                    held = tuple(_root_rules(root, patterns))
                else:
                    held = tuple((r["regex"], r["negated"]) for r in rules)
                handed = [{"regex": regex, "negated": negated} for regex, negated in held] if prune else None
                try:
                    scan = os.scandir(os.path.join(root, path))
                except OSError:
                    continue
                with scan:
                    for entry in scan:
                        child = f"{path}/{entry.name}" if path else entry.name
                        try:
                            is_dir = entry.is_dir(follow_symlinks=False)
                            if not is_dir and not entry.is_file(follow_symlinks=False):
                                continue
                            if held and _is_ignored(f"{child}/" if is_dir else child, held):
                                continue
                            size = None if is_dir else entry.stat(follow_symlinks=False).st_size
                        except OSError:
                            continue
                        rows.append((repo, root, child, is_dir, size, handed if is_dir else None))
                        if len(rows) >= ROWS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def list_tree(
    spark: SparkSession, roots: dict[str, str] | DataFrame, max_depth: int | None = None,
    prune: bool = False, patterns: Sequence[str] = (),
) -> DataFrame:
    """Listing ``repo, root, path, is_dir, size`` of every tree in ``roots``, a mapping or a table ``repo, root``.

    One pass per directory level; a level is stored once and feeds the next,
    so the work is proportional to the entries.  With ``prune`` ignored
    entries (default rules, then ``patterns``, then the root's
    ``.gitignore``) are left out and ignored directories never entered.
    """
    tops = roots if isinstance(roots, DataFrame) else spark.createDataFrame(list(roots.items()), "repo string, root string")
    level = tops.selectExpr("repo", "root", "'' AS path", "true AS is_dir", "cast(NULL AS bigint) AS size",
                            "cast(NULL AS array<struct<regex:string,negated:boolean>>) AS rules")
    found: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth <= max_depth:
        dirs = level.filter("is_dir")
        level = stored(dirs.repartition("repo", "path").mapInPandas(_lister(patterns, prune), _LEVEL), "level")
        if level.isEmpty():
            break
        found.append(level.drop("rules"))
        depth += 1
    out = spark.createDataFrame([], LISTING)
    for part in found:
        out = out.unionByName(part)
    return out


def _read_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read listed files, flushing by bytes so a batch stays small."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for repo, root, path in zip(batch["repo"], batch["root"], batch["path"]):
            try:
                with open(os.path.join(root, path), "rb") as handle:
                    content = handle.read()
            except OSError:
                continue
            rows.append((repo, path, content))
            held += len(content)
            if held >= BYTES_PER_BATCH:
                yield pd.DataFrame(rows, columns=["repo", "path", "content"])
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["repo", "path", "content"])


def read_trees(
    spark: SparkSession,
    roots: dict[str, str] | DataFrame,
    max_depth: int | None = None,
    max_size: int | None = None,
    prune: bool = False,
    patterns: Sequence[str] = (),
) -> DataFrame:
    """A ``files`` table of every regular file below ``roots``; ``prune`` and ``patterns`` as in :func:`list_tree`.

    Unreadable files are left out.  ``max_size`` is tested on the listing,
    before any file is opened.
    """
    listed = list_tree(spark, roots, max_depth, prune, patterns).filter("NOT is_dir")
    if max_size is not None:
        listed = listed.filter(F.col("size") <= max_size)
    # a hash of the path spreads a hot directory or repository over all tasks
    content = listed.repartition("repo", "path").mapInPandas(
        _read_content, "repo string, path string, content binary"
    )
    return from_content(content)


def read_visible(spark: SparkSession, location: str, repo: str) -> DataFrame:
    """S1 through the built-in ``binaryFile`` source, for object stores.

    Size filters reach the scan, but names starting with ``_`` or ``.`` are
    not returned by Spark; use :func:`read_trees` where they matter.
    """
    base = location.rstrip("/") + "/"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location))
    inside = F.substring_index(F.col("path"), base, -1)
    return from_content(raw.select(F.lit(repo).alias("repo"), inside.alias("path"), "content"))


def _write_one(root: str, path: str, content: bytes, overwrite: bool) -> str:
    """Write aside and rename, so that a reader sees the old or the new file; a repeated attempt has the same outcome."""
    target = os.path.join(root, path)
    folder = os.path.dirname(target)
    held = os.path.realpath(root)
    if os.path.commonpath([held, os.path.realpath(folder)]) != held:
        return "denied"
    if os.path.isdir(target):
        return "directory"
    if not overwrite and os.path.exists(target):
        with open(target, "rb") as handle:
            return "written" if handle.read() == content else "exists"
    draft = os.path.join(folder, f".draft-{uuid.uuid4().hex}")
    try:
        os.makedirs(folder, exist_ok=True)
        with open(draft, "xb") as handle:
            handle.write(content)
        os.replace(draft, target)
    except OSError:
        if os.path.exists(draft):
            os.unlink(draft)
        return "failed"
    return "written"


def write_trees(files: DataFrame, roots: dict[str, str] | DataFrame, overwrite: bool = False) -> DataFrame:
    """K1: write a files table as directory trees, one root per repository; ``repo, path, status`` of every file.

    ``roots`` is a mapping or a table ``repo, root``, on storage that every
    executor mounts.  ``denied`` paths lead out of the root, by name or
    through a link; ``binary`` files are not written, since their text has
    lost bytes; ``exists`` is a file with other content that ``overwrite``
    would replace; ``directory`` stands where the file should, and
    ``no_root`` says that the repository has none.  The files are written
    once, when this is called, each task writing its own.
    """
    spark = files.sparkSession
    tops = roots if isinstance(roots, DataFrame) else spark.createDataFrame(list(roots.items()), "repo string, root string")
    tidy = normalize(slashes(F.col("path")))
    refused = (F.when(F.col("root").isNull(), F.lit("no_root")).when(escapes_root(F.col("path")), F.lit("denied"))
               .when((tidy == ".") | tidy.endswith("/"), F.lit("directory")).when(F.col("is_binary"), F.lit("binary")))
    asked = files.join(tops, "repo", "left").select("repo", "path", "root", tidy.alias("tidy"), refused.alias("status"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = [known or _write_one(root, tidy, (text or "").encode(), overwrite)
                      for root, tidy, known, text in zip(batch["root"], batch["tidy"], batch["status"], batch["text"])]
            yield pd.DataFrame({"repo": batch["repo"], "path": batch["path"], "status": status})

    return stored(asked.mapInPandas(run, "repo string, path string, status string"), "written")
