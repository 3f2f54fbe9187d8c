"""Directory trees in table form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.functions.text import bind
from codequarry.operators.eligible import with_ignored
from codequarry.operators.shared import broadcast_checked
from codequarry.sources.shared import stored

# Fixed value: the usual depth of a tree listing, for callers that want one.
MAX_DEPTH = 4


def directories(files: DataFrame) -> DataFrame:
    """H1: ``repo, path`` of every directory that holds a file at any depth."""
    return _directories(files).select("repo", "path")


def _directories(files: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Each directory of depth ``least`` to ``most`` once; ``is_dir``, being aggregated, keeps tests that use it behind the grouping."""
    above = paths.ancestors(F.col("path"))
    if least or most is not None:
        above = F.slice(above, least + 1, 2**31 - 1 if most is None else max(most - least + 1, 0))
    return files.select("repo", F.explode(above).alias("path")).groupBy("repo", "path").agg(F.max(F.lit(True)).alias("is_dir"))


def tree(
    files: DataFrame,
    max_depth: int | None = None,
    sub_path: str | None = None,
    patterns: Sequence[str] = (),
    rules: DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    """H2: ``repo, path, is_dir, depth, name, size_kb``, in pre-order.

    Depth counts from ``sub_path`` when one is given (P8).  Only names and
    sizes are read; directory names are combined before they are shuffled, and
    only those of a listed depth.  Entries are sorted by a key found once for
    each, as an expression in ``orderBy`` is evaluated at every comparison;
    the key travels in place of the path.  Files are dealt once before: a sort
    reads its input twice, and would derive paths, sizes and ignore verdicts
    twice.
    """
    listed = files.select("repo", "path", "size")
    sub = (sub_path or "").strip().replace("\\", "/").strip("/")
    if sub:
        listed = listed.filter(F.startswith("path", F.lit(sub + "/")))
    top = sub.count("/") + 1 if sub else 0
    most = None if max_depth is None else top + max_depth
    inside = listed if most is None else listed.filter(bind(F.col("path"), paths.depth) <= most)
    dirs = _directories(listed, top, most).withColumn("size", F.lit(None).cast("bigint"))

    def shown(entries: DataFrame) -> DataFrame:
        return with_ignored(entries, patterns, rules).filter(~F.col("ignored")).select(
            "repo", paths.order_key(F.col("path")).alias("_key") if ordered else "path", "is_dir", "size")

    kept = shown(inside.withColumn("is_dir", F.lit(False)))
    if ordered:
        both = kept.repartition("repo", "_key").unionByName(shown(dirs))
        kept = both.orderBy("repo", "_key").withColumn("path", paths.from_order_key(F.col("_key")))
    else:
        kept = kept.unionByName(shown(dirs))
    return kept.select("repo", "path", "is_dir", (paths.depth(F.col("path")) - top).alias("depth"),
                       paths.basename(F.col("path")).alias("name"), paths.size_kb(F.col("size")).alias("size_kb"))


def places(listed: DataFrame) -> DataFrame:
    """The rows of a listing ordered by ``repo``, with ``place``, their number within the repository, from 1.

    Each task numbers its own rows; only the number of rows that a repository
    has in each task is compared between tasks, so that no task meets a whole
    repository.  The ordered rows are stored first, as both steps must see the
    same tasks.
    """
    held = stored(listed.withColumn("_at", F.monotonically_increasing_id()), "listed").withColumn("_task", F.shiftright("_at", 33))
    parts = held.groupBy("repo", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("repo").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = broadcast_checked(parts.select(F.col("repo").alias("_repo"), F.col("_task").alias("_of"),
                                            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    met = held.join(starts, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("_task") == F.col("_of")))
    return met.select(*listed.columns, (F.col("_at") + F.col("_shift")).cast("int").alias("place"))
