"""Line search: literal or regular expression, one query or many."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.functions.text import js_trim, lf, split_lines, truncate
from codequarry.operators.shared import broadcast_checked, top_per_group

# Default number of matches and length of a shown line.
MAX_RESULTS = 30
SHOWN = 200


@dataclass(frozen=True)
class LineQuery:
    """One search request."""

    query: str
    query_id: str = "q"
    use_regex: bool = False
    max_results: int | None = MAX_RESULTS
    exts: str | Iterable[str] | None = None
    path_pattern: str | None = None
    status: str = field(default="ok", compare=False)


def to_lines(files: DataFrame) -> DataFrame:
    """S3: ``repo, path, line_no, text``, one row per line."""
    return files.select(
        "repo", "path", F.posexplode(split_lines(lf(F.col("text")))).alias("pos", "text")
    ).select("repo", "path", (F.col("pos") + 1).alias("line_no"), "text")


def valid_pattern(pattern: Column) -> Column:
    """Whether the regex engine takes a pattern; no job fails over one that it refuses."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def check_queries(spark: SparkSession, queries: Sequence[LineQuery]) -> list[LineQuery]:
    """Mark blank queries and patterns the regex engine refuses, all in one job."""
    cleaned = [replace(q, query=q.query.strip()) for q in queries]
    asked = [(i, _pattern(q.query)) for i, q in enumerate(cleaned) if q.query and q.use_regex]
    bad: set[int] = set()
    if asked:
        table = spark.createDataFrame(asked, "i int, pattern string")
        bad = {r.i for r in table.filter(~valid_pattern(F.col("pattern"))).collect()}
    return [replace(q, status="empty" if not q.query else "invalid_regex" if i in bad else "ok") for i, q in enumerate(cleaned)]


def _pattern(regex: str) -> str:
    return "(?iu)" + regex


def _line_test(query: LineQuery, line: Column, lowered: Column) -> Column:
    if query.use_regex:
        return F.rlike(line, F.lit(_pattern(query.query)))
    return F.contains(lowered, F.lit(query.query.lower()))


def _file_test(query: LineQuery) -> Column:
    """P5, P6 of one query."""
    path = F.col("path")
    tests = [paths.extension_in(path, query.exts), paths.path_contains(path, query.path_pattern)]
    keep = F.lit(True)
    for test in tests:
        keep = keep if test is None else keep & test
    return keep


def search_lines(files: DataFrame, query: LineQuery | str, shown: int | None = SHOWN, **options) -> DataFrame:
    """Matching lines of one query: ``repo, path, line_no, line``, of which ``shown`` characters (``None``: all).

    ``files`` is expected to be filtered by ``eligible``.  A narrow scan that
    ends in a distributed top-n by (repo, path, line); ``max_results=None``
    keeps every match, unordered.
    """
    asked = LineQuery(query, **options) if isinstance(query, str) else query
    asked, = check_queries(files.sparkSession, [asked])
    if asked.status != "ok":
        raise ValueError(f"{asked.status}: {asked.query!r}")
    kept = files.filter(_file_test(asked))
    if not asked.use_regex:
        # a file without the text anywhere has no matching line to explode
        kept = kept.filter(F.contains(F.lower("text"), F.lit(asked.query.lower())))
    hits = to_lines(kept).filter(_line_test(asked, F.col("text"), F.lower("text"))).select(
        "repo", "path", "line_no", truncate(js_trim(F.col("text")), shown).alias("line")
    )
    if asked.max_results is None:
        return hits
    return hits.orderBy("repo", "path", "line_no").limit(asked.max_results)


def search_many(files: DataFrame, queries: Sequence[LineQuery], shown: int | None = SHOWN) -> DataFrame:
    """Many queries in one pass: ``query_id, rank, repo, path, line_no, line``.

    Each line is read once and tested against every query's own literals, so
    there is no join; each query keeps its first ``max_results`` lines.
    Blank or invalid queries match nothing (see :func:`query_statuses`).
    """
    spark = files.sparkSession
    good = [q for q in check_queries(spark, queries) if q.status == "ok"]
    lines = to_lines_tested(files, good)
    hits = lines.select(
        F.explode("hits").alias("hit"), "repo", "path", "line_no",
        truncate(js_trim(F.col("text")), shown).alias("line"),
    ).select("hit.query_id", "hit.max_results", "repo", "path", "line_no", "line")
    bounds = [q.max_results for q in good]
    ordered = [F.col("repo"), F.col("path"), F.col("line_no")]
    if any(b is None for b in bounds):
        out = top_per_group(hits, ["query_id"], ordered, "max_results")
    else:
        out = top_per_group(hits, ["query_id"], ordered, max(bounds, default=0))
        out = out.filter(F.col("rank") <= F.col("max_results"))
    return out.select("query_id", "rank", "repo", "path", "line_no", "line")


def to_lines_tested(files: DataFrame, queries: Sequence[LineQuery]) -> DataFrame:
    """Lines with ``hits``: the queries that match them; lines without are dropped."""
    empty = F.array().cast("array<struct<query_id:string,max_results:int>>")
    if not queries:
        return to_lines(files).select("*", empty.alias("hits")).limit(0)
    wanted = files.select(
        "repo", "path", "text", *[_file_test(q).alias(f"_f{i}") for i, q in enumerate(queries)]
    )
    flags = [f"_f{i}" for i in range(len(queries))]
    any_file = F.lit(False)
    for flag in flags:
        any_file = any_file | F.col(flag)
    lines = wanted.filter(any_file).select(
        "repo", "path", *flags, F.posexplode(split_lines(lf(F.col("text")))).alias("pos", "text")
    ).select("repo", "path", *flags, (F.col("pos") + 1).alias("line_no"), "text",
             F.lower("text").alias("_low"))
    matched = F.array_compact(F.array(*[
        F.when(F.col(f"_f{i}") & _line_test(q, F.col("text"), F.col("_low")),
               F.struct(F.lit(q.query_id).alias("query_id"),
                        F.lit(2**31 - 1 if q.max_results is None else q.max_results).alias("max_results")))
        for i, q in enumerate(queries)
    ]))
    return lines.select("repo", "path", "line_no", "text", matched.alias("hits"))


def query_statuses(spark: SparkSession, queries: Sequence[LineQuery]) -> DataFrame:
    """``query_id, status`` of every request, rejected ones included."""
    rows = [(q.query_id, q.status) for q in check_queries(spark, queries)]
    return spark.createDataFrame(rows, "query_id string, status string")


def match_counts(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of matches per group."""
    return hits.groupBy(*by).agg(F.count("*").alias("matches"))


def search_literals(files: DataFrame, queries: DataFrame, shown: int | None = SHOWN) -> DataFrame:
    """Literal search for a *table* of queries (``query_id, query``), of any size.

    Testing every line against every query would be a cross join.  Instead a
    query is keyed by its first three characters (or all, when shorter); a
    line offers each distinct gram it contains, the two meet in an equi-join
    and the full text is then verified.  Output: ``query_id, repo, path,
    line_no, line``, every match.
    """
    asked = queries.select("query_id", F.lower(js_trim(F.col("query"))).alias("_q")).filter(F.col("_q") != "")
    keyed = broadcast_checked(asked.select("query_id", "_q", F.substring("_q", 1, 3).alias("_gram")))
    sizes = [r[0] for r in keyed.select(F.length("_gram")).distinct().collect()]  # at most 1, 2, 3
    lines = to_lines(files).select("repo", "path", "line_no", "text", F.lower("text").alias("_low"))
    lines = lines.withColumn("_chars", F.split("_low", "", -1))

    def grams(size: int) -> Column:
        last = F.length("_low") - size
        chars = F.col("_chars")
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), last), lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])
        )).otherwise(F.array().cast("array<string>"))

    every = [grams(size) for size in sizes] or [F.array().cast("array<string>")]
    offered = lines.withColumn("_gram", F.explode(F.array_distinct(F.concat(*every))))
    met = offered.join(keyed, "_gram").filter(F.contains("_low", F.col("_q")))
    return met.select("query_id", "repo", "path", "line_no",
                      truncate(js_trim(F.col("text")), shown).alias("line"))
