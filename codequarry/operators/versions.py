"""Versions of a files table that share the folders they have in common (K1).

The files are dealt over folders by a hash of their key.  A commit writes anew
only the folders of changed and removed files; a version is a manifest of which
write holds each folder, so two versions share all folders in which they agree,
a version is read by one plain scan, and going back copies no data.  A version
is published last, by a rename that fails where its number is taken: a commit
that stops halfway is never seen, and of two commits on the same parent only
one gets the number.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.changes import classify_changes
from codequarry.operators.shared import broadcast_checked
from codequarry.sources.shared import stored
from codequarry.sources.tables import FILE_COLUMNS

# A commit rewrites whole folders, so on large tables a folder should hold a few GB at most.
FOLDERS = 1024
ATTEMPTS = 8

_KEY = ["repo", "path"]
_FILES = "repo string, path string, size bigint, is_binary boolean, text string"
_HEADER = "version long, parent long, action string, folders int, manifest string"
_ENTRY = "manifest string, folder int, write string, files long, bytes long"


class VersionConflict(RuntimeError):
    """Another commit was published after the version that this one builds on."""


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64(*_KEY), F.lit(folders)).cast("int")


def _header(spark: SparkSession, location: str, version: int | None = None) -> dict:
    """What is published of a version, by default the newest."""
    headers = spark.read.schema(_HEADER).json(f"{location}/versions")
    chosen = headers.orderBy(F.desc("version")) if version is None else headers.filter(F.col("version") == version)
    found = chosen.first()
    if found is None:
        raise ValueError(f"no version {version} in {location}")
    return found.asDict()


def _entries(spark: SparkSession, location: str, header: dict) -> dict[int, tuple[str, int, int]]:
    """``folder: (write, files, bytes)``; at most one entry for each folder, whatever the table's size."""
    rows = spark.read.schema(_ENTRY).parquet(f"{location}/manifests/{header['manifest']}")
    return {r.folder: (r.write, r.files, r.bytes) for r in rows.collect()}


def _scan(spark: SparkSession, location: str, held: dict[int, str]) -> DataFrame:
    """The rows of the named folders, as one scan."""
    if not held:
        return spark.createDataFrame([], _FILES)
    paths = [f"{location}/data/write={write}/folder={folder}" for folder, write in sorted(held.items())]
    return spark.read.schema(_FILES).option("basePath", f"{location}/data").parquet(*paths).select(*FILE_COLUMNS)


def _write(files: DataFrame, location: str, folders: int) -> dict[int, tuple[str, int, int]]:
    """Store ``files`` as a new write; the entries of the folders it fills.

    Ranges over folder and key split a large folder over several tasks.
    """
    write, order = uuid.uuid4().hex, ["folder", *_KEY]
    target = f"{location}/data/write={write}"
    dealt = files.select(*FILE_COLUMNS, _folder(folders).alias("folder"))
    dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("folder").parquet(target)
    held = files.sparkSession.read.schema(f"{_FILES}, folder int").parquet(target)
    filled = held.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).collect()
    return {r.folder: (write, r.files, r.bytes or 0) for r in filled}


def _write_manifest(spark: SparkSession, location: str, entries: dict[int, tuple[str, int, int]]) -> str:
    name = uuid.uuid4().hex
    rows = [(name, folder, *entry) for folder, entry in sorted(entries.items())]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.parquet(f"{location}/manifests/{name}")
    return name


def _publish(spark: SparkSession, location: str, header: dict) -> bool:
    """Make the version visible at once, unless its number is taken.

    The header is written aside and renamed without overwriting, as streaming
    queries publish the entries of their logs.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    draft = hadoop.Path(f"{location}/drafts/{uuid.uuid4().hex}")
    target = hadoop.Path(f"{location}/versions/{header['version']:012d}.json")
    store = target.getFileSystem(conf)
    store.mkdirs(target.getParent())
    out = store.create(draft, False)
    try:
        out.write(bytearray(json.dumps(header).encode()))
    finally:
        out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(store.getUri(), conf).rename(
            store.makeQualified(draft), store.makeQualified(target), plain)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def create_versions(files: DataFrame, location: str, folders: int = FOLDERS) -> int:
    """Store ``files`` as version 1 at a new location, dealt over ``folders`` folders for good; returns the version."""
    spark = files.sparkSession
    manifest = _write_manifest(spark, location, _write(files, location, folders))
    if not _publish(spark, location, {"version": 1, "parent": None, "action": "create", "folders": folders, "manifest": manifest}):
        raise VersionConflict(f"{location} already holds versions")
    return 1


def commit_files(
    spark: SparkSession, location: str, changed: DataFrame, removed: DataFrame | None = None, parent: int | None = None
) -> int:
    """Replace or add the ``changed`` files, drop the ``removed`` keys (``repo, path``); returns the new version.

    A key that is both changed and removed is kept as changed; removing what
    is not there does nothing.  With ``parent`` the commit raises
    ``VersionConflict`` unless that version is still the newest, for changes
    computed from its texts; without it a commit that loses a race is made
    again on the winner's version.  Only the folders of these files are read.
    """
    changed = stored(changed.select(*FILE_COLUMNS), "changed")
    keys = changed.select(*_KEY)
    stale = stored((keys if removed is None else keys.unionByName(removed.select(*_KEY))).distinct(), "stale")
    for _ in range(ATTEMPTS):
        newest = _header(spark, location)
        if parent is not None and newest["version"] != parent:
            raise VersionConflict(f"version {newest['version']} was published after {parent}")
        entries, folders = _entries(spark, location, newest), newest["folders"]
        touched = {r.folder for r in stale.select(_folder(folders).alias("folder")).distinct().collect()}
        old = _scan(spark, location, {f: entries[f][0] for f in touched if f in entries})
        kept = old.join(broadcast_checked(stale), _KEY, "left_anti").select(*FILE_COLUMNS)
        fresh = _write(kept.unionByName(changed), location, folders) if touched else {}
        shared = {f: e for f, e in entries.items() if f not in touched}
        header = {"version": newest["version"] + 1, "parent": newest["version"], "action": "commit", "folders": folders,
                  "manifest": _write_manifest(spark, location, shared | fresh)}
        if _publish(spark, location, header):
            return header["version"]
    raise VersionConflict(f"lost {ATTEMPTS} races in {location}")


def roll_back(spark: SparkSession, location: str, version: int) -> int:
    """Publish a new version with the files of an earlier one; no data is copied."""
    wanted = _header(spark, location, version)
    for _ in range(ATTEMPTS):
        newest = _header(spark, location)["version"]
        header = wanted | {"version": newest + 1, "parent": newest, "action": f"roll back to {version}"}
        if _publish(spark, location, header):
            return header["version"]
    raise VersionConflict(f"lost {ATTEMPTS} races in {location}")


def read_version(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    """The files table of a version, by default the newest."""
    entries = _entries(spark, location, _header(spark, location, version))
    return _scan(spark, location, {folder: write for folder, (write, _, _) in entries.items()})


def changes_between(spark: SparkSession, location: str, old: int, new: int) -> DataFrame:
    """``repo, path, status`` (A, D, M) between two versions; folders that both share are not read."""
    before, after = (_entries(spark, location, _header(spark, location, v)) for v in (old, new))
    differ = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    left, right = (_scan(spark, location, {f: e[0] for f, e in side.items() if f in differ}) for side in (before, after))
    return classify_changes(left, right, right).filter("bucket = 'staged'").select(*_KEY, "status")


def version_log(spark: SparkSession, location: str) -> DataFrame:
    """One row per version: ``version, parent, action, files, bytes, folders_written``.

    ``folders_written`` counts the folders that the parent does not hold alike.
    """
    headers = spark.read.schema(_HEADER).json(f"{location}/versions")
    entries = spark.read.schema(_ENTRY).parquet(f"{location}/manifests/*")
    held = headers.select("version", "parent", "manifest").join(entries, "manifest")
    above = held.select(F.col("version").alias("parent"), "folder", "write", F.lit(True).alias("_shared"))
    marked = held.join(above, ["parent", "folder", "write"], "left")
    sums = marked.groupBy("version").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
        F.count_if(F.col("_shared").isNull()).alias("folders_written"))
    zero = F.lit(0).cast("bigint")
    return headers.join(sums, "version", "left").select(
        "version", "parent", "action",
        *[F.coalesce(c, zero).alias(c) for c in ("files", "bytes", "folders_written")])
