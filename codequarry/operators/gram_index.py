"""Line search through an index of three-character grams.

Whatever a literal or pattern requires of a matching line (see
``functions.pattern_grams``) is looked up before any line is cut: only files
that hold the required grams are read.  The index may name too many files,
never too few, and the lines themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.functions.pattern_grams import grams, literal_needs, regex_needs
from codequarry.functions.text import bind, js_trim, lf, split_lines, truncate
from codequarry.operators import line_search as ls
from codequarry.operators.shared import broadcast_checked, top_per_group
from codequarry.sources.shared import stored

PARTS = 32
# Shares that each folder of grams is dealt over when it is written.
SHARES = 16
# The rarest needs of a query that are looked up; the lines decide about the others.
NEEDS_ASKED = 3
# Requests without needs are taken through all files so many at once.
NEEDLESS_AT_ONCE = 1000

REQUESTS = "query_id string, query string, use_regex boolean, exts string, path_pattern string, max_results int"


@dataclass(frozen=True)
class GramIndex:
    """``files(part, gram, file)`` and ``stats(gram, n)``; ``file`` is :func:`file_key`."""

    files: DataFrame
    stats: DataFrame


def file_key() -> Column:
    """A number for ``(repo, path)``; two files that share one are looked up together."""
    return F.xxhash64("repo", "path")


def _part() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int")


def write_gram_index(files: DataFrame, location: str) -> None:
    """Index ``files`` (already filtered by ``eligible``) at a new location, ordered by gram."""
    offered = files.select(F.explode(grams(lf(F.col("text")))).alias("gram"), file_key().alias("file"))
    share = F.pmod(F.xxhash64("gram", "file"), F.lit(SHARES)).alias("share")
    order = ["part", "gram", "file"]
    # one shuffle: equal rows meet in the share that is written; its tasks are not merged, since grams pack well and a few MB are much to sort
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = offered.select(_part().alias("part"), share, "gram", "file").repartition(tasks, "part", "share")
    (dealt.distinct().drop("share").sortWithinPartitions(*order)
     .write.mode("errorifexists").partitionBy("part").parquet(f"{location}/files"))
    held = files.sparkSession.read.parquet(f"{location}/files")
    held.groupBy("gram").agg(F.count("*").alias("n")).write.mode("errorifexists").parquet(f"{location}/stats")


def read_gram_index(spark: SparkSession, location: str) -> GramIndex:
    """A stored index."""
    return GramIndex(*[spark.read.parquet(f"{location}/{name}") for name in ("files", "stats")])


def needs_of(requests: DataFrame) -> DataFrame:
    """``query_id, need, gram``: the grams of which one must occur, for each need of each request."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(row.query_id, need, gram) for row in frame.itertuples()
                    for need, choices in enumerate(regex_needs(row.query) if row.use_regex else literal_needs(row.query)) for gram in sorted(choices)]
            yield pd.DataFrame(rows, columns=["query_id", "need", "gram"])

    return requests.select("query_id", "query", "use_regex").mapInPandas(run, "query_id string, need int, gram string")


def _rarest(needs: DataFrame, stats: DataFrame, n_needs: int) -> DataFrame:
    """``query_id, need, gram, n``: the needs of each request that the fewest files meet."""
    counted = needs.join(stats, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = counted.groupBy("query_id", "need").agg(F.sum("n").alias("size"))
    first = top_per_group(sizes, ["query_id"], [F.col("size"), F.col("need")], n_needs, "place").select("query_id", "need")
    return counted.join(first, ["query_id", "need"])


def candidates(index: GramIndex, needs: DataFrame, needs_asked: int = NEEDS_ASKED) -> DataFrame:
    """``query_id, file`` of every file that meets the ``needs_asked`` rarest needs of a request.

    A request without needs is in none.
    """
    asked = stored(_rarest(needs, index.stats, needs_asked).withColumn("part", _part()), "rarest")
    n_needs = asked.groupBy("query_id").agg(F.count_distinct("need").alias("n_needs"))
    wanted = broadcast_checked(asked.filter("n > 0").select("part", "gram", "query_id", "need"))
    met = index.files.join(wanted, ["part", "gram"]).groupBy("query_id", "file").agg(F.count_distinct("need").alias("met"))
    return met.join(n_needs, "query_id").filter("met = n_needs").select("query_id", "file")


def prepared(requests: DataFrame) -> DataFrame:
    """Requests in the form of ``REQUESTS`` with ``status`` (``ok``, ``empty``, ``invalid_regex``) and the tests of paths spelled out.

    ``exts`` may be a comma list or an array; a null limit means all lines.
    """
    kinds = dict(requests.dtypes)

    def own(name: str, kind: str) -> Column:
        return F.col(name) if name in kinds else F.lit(None).cast(kind)

    named = F.array_join(own("exts", "string"), ",") if kinds.get("exts", "").startswith("array") else own("exts", "string")
    query = js_trim(F.coalesce(F.col("query"), F.lit("")))
    regex = F.coalesce(own("use_regex", "boolean"), F.lit(False))
    pattern = F.concat(F.lit("(?iu)"), query)
    exts = F.filter(F.transform(F.split(F.lower(named), ","), js_trim), lambda e: e != "")
    dotted = F.transform(exts, lambda e: F.when(F.startswith(e, F.lit(".")), e).otherwise(F.concat(F.lit("."), e)))
    inside = F.lower(js_trim(paths.slashes(own("path_pattern", "string"))))
    status = F.when(query == "", "empty").when(regex & ~ls.valid_pattern(pattern), "invalid_regex").otherwise("ok")
    return requests.select(
        "query_id", query.alias("query"), regex.alias("use_regex"), F.when(F.size(dotted) > 0, dotted).alias("exts"),
        F.when(inside != "", inside).alias("inside"), own("max_results", "int").cast("int").alias("max_results"), status.alias("status"))


def request_statuses(requests: DataFrame) -> DataFrame:
    """``query_id, status`` of every request, refused ones included, in one pass."""
    return prepared(requests).select("query_id", "status")


def _file_fits(exts: Column, inside: Column) -> Column:
    """P5, P6 with the request's own values."""
    path = F.col("path")
    named = F.coalesce(F.array_contains(exts, F.lower(paths.extension(path))), F.lit(True))
    return named & F.coalesce(F.contains(F.lower(paths.slashes(path)), inside), F.lit(True))


def _matching_lines(met: DataFrame, shown: int | None) -> DataFrame:
    """``query_id, max_results, repo, path, line_no, line`` of files with the requests ``asked`` of them.

    A file is cut once, and each of its requests goes through all lines, so a
    pattern is compiled once for a file; lines that do not match are never rows.
    """
    numbered = F.transform(split_lines(lf(F.col("text"))), lambda raw, i: F.struct(
        (i + 1).alias("line_no"), raw.alias("raw"), F.lower(raw).alias("low")))

    def matching(lines: Column, q: Column) -> Column:
        pattern, plain = F.concat(F.lit("(?iu)"), q["query"]), F.lower(q["query"])
        kept = F.when(q["use_regex"], F.filter(lines, lambda x: F.rlike(x["raw"], pattern))).otherwise(
            F.filter(lines, lambda x: F.contains(x["low"], plain)))
        return F.transform(kept, lambda x: F.struct(
            q["query_id"].alias("query_id"), q["max_results"].alias("max_results"), x["line_no"].alias("line_no"), x["raw"].alias("raw")))

    hits = bind(numbered, lambda lines: F.flatten(F.transform("asked", lambda q: matching(lines, q))))
    found = met.select("repo", "path", F.inline(hits))
    return found.select("query_id", "max_results", "repo", "path", "line_no", truncate(js_trim(F.col("raw")), shown).alias("line"))


def _cut(met: DataFrame, shown: int | None, most: int) -> DataFrame:
    """Each request's first lines, all where it has no limit; ``most`` is the largest limit.

    Requests are parted before lines are matched, so each is matched once.
    """
    def hits(wanted: Callable[[Column], Column]) -> DataFrame:
        own = met.select("repo", "path", "text", F.filter("asked", wanted).alias("asked"))
        return _matching_lines(own.filter(F.size("asked") > 0), shown)

    unlimited = hits(lambda q: q["max_results"].isNull()).withColumn("rank", F.lit(None).cast("int"))
    limited = top_per_group(hits(lambda q: q["max_results"].isNotNull()), ["query_id"], [F.col("repo"), F.col("path"), F.col("line_no")],
                            "max_results", most=most)
    columns = ["query_id", "rank", "repo", "path", "line_no", "line"]
    return limited.select(*columns).unionByName(unlimited.select(*columns))


def _searched(files: DataFrame, asked: DataFrame, needs: DataFrame, pairs: DataFrame, shown: int | None) -> DataFrame:
    """The lines of each request, from its candidates ``pairs (query_id, repo, path)`` or, without needs, from all files."""
    request = F.struct("query_id", "query", "use_regex", "max_results")
    fitting = pairs.join(asked, "query_id").filter(_file_fits(F.col("exts"), F.col("inside")))
    grouped = fitting.groupBy("repo", "path").agg(F.collect_list(request).alias("asked"))
    met = files.select("repo", "path", "text").join(broadcast_checked(grouped), ["repo", "path"])
    needless = asked.join(needs.select("query_id").distinct(), "query_id", "left_anti")
    blocks = -(-needless.count() // NEEDLESS_AT_ONCE)
    for block in range(blocks):
        part = needless.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        every = part.agg(F.collect_list(F.struct(request.alias("request"), "exts", "inside"))).scalar()
        fits = F.filter("every", lambda q: _file_fits(q["exts"], q["inside"]))
        own = files.withColumn("every", every).select("repo", "path", "text", F.transform(fits, lambda q: q["request"]).alias("asked"))
        met = met.unionByName(own.filter(F.size("asked") > 0))
    most = asked.agg(F.max("max_results")).first()[0] or 0
    return _cut(met, shown, most)


def search_indexed(files: DataFrame, index: GramIndex, requests: DataFrame, shown: int | None = ls.SHOWN) -> DataFrame:
    """``query_id, rank, repo, path, line_no, line`` for a table of requests (see ``REQUESTS``) over indexed files.

    Only candidate files are cut into lines.  Requests without needs, such as
    those shorter than a gram, read every file that passes their filters.
    Blank and invalid requests match nothing (see :func:`request_statuses`);
    ``rank`` is null where a request has no limit, and of each line ``shown``
    characters are returned (``None``: all).
    """
    asked = stored(prepared(requests).filter("status = 'ok'").drop("status"), "asked")
    needs = stored(needs_of(asked), "needs")
    found = broadcast_checked(candidates(index, needs))
    pairs = files.select("repo", "path", file_key().alias("file")).join(found, "file").select("query_id", "repo", "path")
    return _searched(files, asked, needs, pairs, shown)


def search_table(files: DataFrame, requests: DataFrame, shown: int | None = ls.SHOWN) -> DataFrame:
    """The same for files without an index, whatever the number of requests.

    A first pass keeps, for each file, those of its grams that any request
    needs.  Their counts tell the rarest need of each request, which is its
    key: only the files that offer it are cut into lines, in a second pass.
    """
    asked = stored(prepared(requests).filter("status = 'ok'").drop("status"), "asked")
    needs = stored(needs_of(asked), "needs")
    spelled = broadcast_checked(needs.select("gram").distinct())
    offered = files.select("repo", "path", F.explode(grams(lf(F.col("text")))).alias("gram")).join(spelled, "gram")
    offered = stored(offered, "offered")
    counts = offered.groupBy("gram").agg(F.count("*").alias("n"))
    keys = _rarest(needs, counts, 1).select("query_id", "gram")
    pairs = offered.join(broadcast_checked(keys), "gram").select("query_id", "repo", "path").distinct()
    return _searched(files, asked, needs, pairs, shown)
