"""An index in immutable segments, refreshed without being built anew (K2, K3).

A refresh analyses the changed files into a segment of its own, marks the rows
of changed and removed files in older segments as deleted, and writes by how
much each affected term's document frequency and each scope's totals change.
Nothing that exists is rewritten; a version names the segments and changes
that make it up and is written last, so that a refresh that fails is never
seen.  The statistics of a version are the sums of its changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.operators.index import FIELDS, Index, check_scope, index_docs, index_postings
from codequarry.operators.shared import broadcast_checked

# Folders that the files of a segment are dealt over; a refresh opens those of changed files.
PARTS = 64
_KEY = ["repo", "path"]
_LENGTHS = [f"fl_{f}" for f in FIELDS]
_ENTRY = "version long, kind string, segment string, change string"


def _part() -> Column:
    return F.pmod(F.xxhash64(*_KEY), F.lit(PARTS)).cast("int")


def _manifest(spark: SparkSession, location: str, version: int | None = None) -> tuple[int, str, list[str], list[str]]:
    """Version, scope kind, segments and changes of the newest or a given version."""
    rows = spark.read.schema(_ENTRY).parquet(f"{location}/manifest")
    chosen = rows.agg(F.max("version")).first()[0] if version is None else version
    entries = rows.filter(F.col("version") == chosen).collect()
    if not entries:
        raise ValueError(f"no version {chosen} in {location}")
    return (chosen, entries[0].kind, sorted({r.segment for r in entries if r.segment}), sorted({r.change for r in entries if r.change}))


def _publish(spark: SparkSession, location: str, version: int, kind: str, segments: list[str], changes: list[str]) -> int:
    rows = [(version, kind, s, None) for s in segments] + [(version, kind, None, c) for c in changes]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("append").parquet(f"{location}/manifest")
    return version


def _write_segment(files: DataFrame, location: str, kind: str) -> str:
    """Analyse ``files`` into a new segment; each file's row also lists its terms, found in the row, so that they can be counted out again."""
    name = uuid.uuid4().hex
    order = ["scope", "field", "term", *_KEY]
    postings = index_postings(files, kind)
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{location}/segments/{name}/postings")
    docs = index_docs(files, kind, terms=True).withColumn("part", _part()).repartition("part")
    # rows of one key are counted out together, so each lists the terms of all
    named = F.col("repo").isNotNull() & F.col("path").isNotNull()
    terms = F.when(named, F.flatten(F.collect_list("terms").over(Window.partitionBy("part", *_KEY))))
    (docs.withColumn("terms", terms).sortWithinPartitions("part", *_KEY)
     .write.partitionBy("part").parquet(f"{location}/segments/{name}/docs"))
    return name


def _rows(spark: SparkSession, location: str, segments: list[str], table: str, schema: str) -> DataFrame:
    """The rows of several segments, each with the ``segment`` it stands in."""
    out = spark.createDataFrame([], f"{schema}, segment string")
    for name in segments:
        rows = spark.read.schema(schema).option("basePath", f"{location}/segments/{name}/{table}").parquet(f"{location}/segments/{name}/{table}")
        out = out.unionByName(rows.withColumn("segment", F.lit(name)))
    return out


_DOCS = ("scope string, repo string, path string, ext string, line_count int, symbols string, fl_symbols int, fl_file int, fl_content int, "
         "terms array<struct<field:string,term:string>>, part int")
_POSTINGS = "scope string, repo string, path string, field string, term string, tf int, fl int"
_DEAD = "part int, segment string, repo string, path string"
_TERMS = "scope string, field string, term string, df long"
_TOTALS = "scope string, n_docs long, " + ", ".join(f"{c} long" for c in _LENGTHS)


def _changes(spark: SparkSession, location: str, changes: list[str], table: str, schema: str) -> DataFrame:
    paths = [f"{location}/changes/{name}/{table}" for name in changes]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write_change(location: str, docs: DataFrame, sign: Column, dead: DataFrame) -> str:
    """Store by how much ``docs`` (with ``terms``), each counted ``sign`` times, change the statistics, and which rows are ``dead``."""
    name = uuid.uuid4().hex
    signed = docs.withColumn("sign", sign.cast("bigint"))
    terms = signed.select("scope", "sign", F.inline("terms")).groupBy("scope", "field", "term").agg(F.sum("sign").alias("df")).filter("df <> 0")
    totals = signed.groupBy("scope").agg(F.sum("sign").alias("n_docs"), *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in _LENGTHS])
    terms.write.parquet(f"{location}/changes/{name}/terms")
    totals.write.parquet(f"{location}/changes/{name}/totals")
    dead.select("part", "segment", *_KEY).write.parquet(f"{location}/changes/{name}/dead")
    return name


def create_segments(files: DataFrame, location: str, scope: str = "corpus") -> int:
    """Index ``files`` (already filtered by ``eligible``) at a new location; returns the version."""
    spark = files.sparkSession
    segment = _write_segment(files, location, check_scope(scope))
    docs = _rows(spark, location, [segment], "docs", _DOCS)
    change = _write_change(location, docs, F.lit(1), docs.limit(0))
    return _publish(spark, location, 1, scope, [segment], [change])


def refresh_segments(spark: SparkSession, location: str, changed: DataFrame, removed: DataFrame | None = None) -> int:
    """Replace the changed files, drop the removed ones; returns the new version.

    ``changed`` is a files table, ``removed`` has ``repo, path``; a file that
    the index does not hold is added, or nothing to remove.  Of the older
    segments only the folders of these files are read.  Earlier versions stay
    readable.
    """
    version, kind, segments, changes = _manifest(spark, location)
    keys = changed.select(*_KEY)
    stale = (keys if removed is None else keys.unionByName(removed.select(*_KEY))).distinct().withColumn("part", _part())
    live = _live(_rows(spark, location, segments, "docs", _DOCS), _changes(spark, location, changes, "dead", _DEAD))
    old = live.join(broadcast_checked(stale), ["part", *_KEY], "left_semi")
    segment = _write_segment(changed, location, kind)
    new = _rows(spark, location, [segment], "docs", _DOCS)
    both = old.withColumn("of", F.lit(-1)).unionByName(new.withColumn("of", F.lit(1)))
    change = _write_change(location, both, F.col("of"), old)
    return _publish(spark, location, version + 1, kind, [*segments, segment], [*changes, change])


def _live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows that no later refresh has replaced."""
    return rows.join(broadcast_checked(dead.select("segment", *_KEY)), ["segment", *_KEY], "left_anti")


def read_segments(spark: SparkSession, location: str, version: int | None = None) -> Index:
    """A version (the newest by default) as an index that every search takes."""
    _, kind, segments, changes = _manifest(spark, location, version)
    dead = _changes(spark, location, changes, "dead", _DEAD)
    docs = _live(_rows(spark, location, segments, "docs", _DOCS), dead).drop("segment", "terms", "part")
    postings = _live(_rows(spark, location, segments, "postings", _POSTINGS), dead).drop("segment")
    vocab = _changes(spark, location, changes, "terms", _TERMS).groupBy("scope", "field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    totals = _changes(spark, location, changes, "totals", _TOTALS).groupBy("scope").agg(
        *[F.sum(c).alias(c) for c in ("n_docs", *_LENGTHS)]).filter("n_docs > 0")
    stats = totals.select("scope", "n_docs", F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), (F.col(f"fl_{f}") / F.col("n_docs")).alias("avg_fl")) for f in FIELDS])).alias("s"))
    return Index(docs, postings, vocab, stats.select("scope", "s.field", "n_docs", "s.avg_fl"), kind)


def compact_segments(spark: SparkSession, location: str) -> int:
    """Merge all segments and changes of the newest version into one of each; returns the new version."""
    version, kind, segments, changes = _manifest(spark, location)
    dead = _changes(spark, location, changes, "dead", _DEAD)
    name = uuid.uuid4().hex
    order = ["scope", "field", "term", *_KEY]
    postings = _live(_rows(spark, location, segments, "postings", _POSTINGS), dead).drop("segment")
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{location}/segments/{name}/postings")
    docs = _live(_rows(spark, location, segments, "docs", _DOCS), dead).drop("segment")
    docs.repartition("part").sortWithinPartitions(*_KEY).write.partitionBy("part").parquet(f"{location}/segments/{name}/docs")
    merged = _rows(spark, location, [name], "docs", _DOCS)
    change = _write_change(location, merged, F.lit(1), merged.limit(0))
    return _publish(spark, location, version + 1, kind, [name], [change])
