"""Change sets and line statistics between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.shared import broadcast_checked, top_per_group

# Fixed value: untracked files named in a report.
UNTRACKED_SHOWN = 10


def _hashes(**snapshots: DataFrame) -> DataFrame:
    """One row per file with a content hash per snapshot, NULL where absent.

    A single aggregation over hashes: contents are never shuffled, and one
    exchange replaces a chain of full outer joins.
    """
    tagged = None
    for name, files in snapshots.items():
        part = files.select("repo", "path", F.lit(name).alias("snapshot"),
                            F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("repo", "path").agg(*[
        F.max(F.when(F.col("snapshot") == name, F.col("hash"))).alias(name) for name in snapshots
    ])


def _letter(old: Column, new: Column) -> Column:
    """Status letter of one step, NULL when nothing changed."""
    return (
        F.when(old.isNull() & new.isNotNull(), F.lit("A"))
        .when(old.isNotNull() & new.isNull(), F.lit("D"))
        .when(old != new, F.lit("M"))
    )


def classify_changes(base: DataFrame, staged: DataFrame, working: DataFrame) -> DataFrame:
    """``repo, path, bucket, status``; a file may be staged and modified.

    Staged compares base with staged, modified compares staged with working,
    and a working file that is not staged is untracked.
    """
    sides = _hashes(base=base, staged=staged, working=working)
    index = _letter(F.col("base"), F.col("staged"))
    tree = F.when(F.col("staged").isNotNull(), _letter(F.col("staged"), F.col("working")))
    untracked = F.when(F.col("staged").isNull() & F.col("working").isNotNull(), F.lit("?"))
    rows = F.array(*[
        F.struct(F.lit(bucket).alias("bucket"), status.alias("status"))
        for bucket, status in [("staged", index), ("modified", tree), ("untracked", untracked)]
    ])
    return sides.select("repo", "path", F.inline(F.filter(rows, lambda r: r["status"].isNotNull())))


def change_counts(changes: DataFrame) -> DataFrame:
    """A10: files per repository and bucket."""
    return changes.groupBy("repo", "bucket").agg(F.count("*").alias("files"))


def untracked_preview(changes: DataFrame, shown: int = UNTRACKED_SHOWN) -> DataFrame:
    """The first untracked files of each repository and how many more there are."""
    untracked = changes.filter(F.col("bucket") == "untracked").select("repo", "path")
    totals = untracked.groupBy("repo").agg(F.count("*").alias("_n"))
    first = top_per_group(untracked, ["repo"], [F.col("path")], shown)
    more = F.greatest(F.col("_n") - shown, F.lit(0))
    return first.join(totals, "repo").select("repo", "rank", "path", more.alias("more"))


def _line_hashes(files: DataFrame, name: str) -> DataFrame:
    """``repo, path`` and the sorted 128-bit hashes of the lines as a diff sees them: a final line break opens no further line."""
    body = F.regexp_replace("text", r"\n\z", "")
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return files.select("repo", "path", F.sort_array(hashes).alias(name))


def _balance(old: Column, new: Column) -> Column:
    """``struct<n, added, removed>``: lines in excess on either side, from one walk along both sorted arrays."""
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def signed(side: Column, sign: int) -> Column:
        return F.transform(F.coalesce(side, empty), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(sign).alias("sign")))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("n"), zero.alias("added"), zero.alias("removed"))

    def step(state: Column, line: Column) -> Column:
        same = (state["a"] == line["a"]) & (state["b"] == line["b"])
        return F.struct(
            line["a"].alias("a"), line["b"].alias("b"), (F.when(same, state["n"]).otherwise(zero) + line["sign"]).alias("n"),
            (state["added"] + F.when(same, zero).otherwise(F.greatest(state["n"], zero))).alias("added"),
            (state["removed"] + F.when(same, zero).otherwise(F.greatest(-state["n"], zero))).alias("removed"))

    def closed(state: Column) -> Column:
        return F.struct((state["added"] + F.greatest(state["n"], zero)).alias("added"),
                        (state["removed"] + F.greatest(-state["n"], zero)).alias("removed"))

    return F.aggregate(F.sort_array(F.concat(signed(old, -1), signed(new, 1))), start, step, closed)


def diff_stat(base: DataFrame, working: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """``repo, path, added, removed`` of every file whose content differs.

    Lines are compared as multisets, so a line that only moved counts as
    unchanged.  With ``staged`` given, untracked files are left out.  Only
    changed files are split into lines.  Both versions of a file meet in one
    row as sorted line hashes: no line is ever a key, and no text is shuffled.
    """
    sides = _hashes(base=base, working=working)
    changed = sides.filter(~F.col("base").eqNullSafe(F.col("working"))).select("repo", "path", "base")
    if staged is not None:
        tracked = staged.select("repo", "path", F.lit(True).alias("_staged"))
        changed = changed.join(tracked, ["repo", "path"], "left").filter(
            F.col("base").isNotNull() | F.col("_staged").isNotNull())
    changed = broadcast_checked(changed.select("repo", "path"))

    def hashed(files: DataFrame, name: str) -> DataFrame:
        return _line_hashes(files.select("repo", "path", "text").join(changed, ["repo", "path"], "left_semi"), name)

    met = hashed(base, "old").join(hashed(working, "new"), ["repo", "path"], "full")
    return met.select("repo", "path", _balance(F.col("old"), F.col("new")).alias("n")).select("repo", "path", "n.added", "n.removed")


def diff_total(stat: DataFrame) -> DataFrame:
    """Totals per repository."""
    return stat.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
