"""URL filters over dated lists: a temporal as-of join.

Dated list entries become validity intervals, one after the other for each
pattern of a list.  Each distinct pair of URL and fetch time is exploded into
the few patterns that the URL can match, and an equi-join on the pattern keeps
the interval that holds its fetch time.  A very common host is a hot key of
that join, so the pairs are dealt over salts and each interval is repeated
once for every salt; intervals of one list and pattern never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)"
SALTS = 8


def host_of(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and every parent of at least two labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host != "", ends).otherwise(F.array().cast("array<string>"))


def prefixes_of(host: Column, url: Column) -> Column:
    """The host followed by each directory of the path, ending in a slash."""
    path = F.regexp_extract(F.lower(url), PATH, 1)
    parts = F.split(F.regexp_extract(path, r"^(/.*)/", 1), "/")
    n = F.size(parts)
    whole = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when((host != "") & path.contains("/"), whole).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, verdict, kind, pattern, valid_from, valid_to`` from ``list, verdict, kind, pattern, action, at``.

    An ``add`` entry is valid until the next entry of its list, kind and
    pattern, whatever that entry's verdict (for ever without one); a
    ``remove`` entry opens nothing.  On the same instant ``remove`` wins, then
    ``block``, then ``allow``.  Rows with a null verdict, pattern or time, or
    another verdict or action, are void and repeated entries count once.
    """
    real = entries.filter("pattern is not null and at is not null and action in ('add', 'remove') and verdict in ('allow', 'block')")
    strength = F.when(F.col("action") == "remove", 2).when(F.col("verdict") == "block", 1).otherwise(0)
    instants = real.groupBy("list", "kind", F.lower("pattern").alias("pattern"), "at").agg(F.max(strength).alias("strength"))
    of_pattern = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    return (instants.withColumn("valid_to", F.lead("at").over(of_pattern)).filter("strength < 2")
            .select("list", F.when(F.col("strength") == 1, "block").otherwise("allow").alias("verdict"), "kind", "pattern",
                    F.col("at").alias("valid_from"), "valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """``page_id, url, host, fetched_at, status, list, kind, pattern, n_active`` for every capture.

    ``status`` is the verdict (``block`` or ``allow``) of the most specific
    entry active at fetch time: a path prefix before a host before a domain,
    the longer pattern first, ``block`` before ``allow`` on the same pattern,
    then the list's name; ``none`` without one.  ``n_active`` counts the
    active entries that match.  A null or malformed URL, or a null fetch time,
    matches nothing.  Rows may repeat; each is evaluated.  A verdict depends
    on URL and time alone, so it is found once for each such pair and looked
    up by it: no row number has to be the same in two evaluations.
    """
    rows = captures.select("page_id", "url", "fetched_at")
    named = rows.filter("url is not null and fetched_at is not null").select("url", "fetched_at").distinct().withColumn("host", host_of(F.col("url")))

    def keyed(kind: str, rank: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), k.alias("pattern")))

    keys = F.concat(keyed("domain", 1, domains_of(F.col("host"))),
                    keyed("host", 2, F.when(F.col("host") != "", F.array("host")).otherwise(F.array().cast("array<string>"))),
                    keyed("prefix", 3, prefixes_of(F.col("host"), F.col("url"))))
    asked = (named.select("url", "fetched_at", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(salts)).cast("int").alias("_salt"),
                          F.explode(keys).alias("k")).select("url", "fetched_at", "_salt", "k.*"))
    held = intervals(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = (asked.join(held, ["kind", "pattern", "_salt"])
              .filter((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))))
    best = F.struct("rank", F.length("pattern").alias("size"), (F.col("verdict") == "block").alias("block"), "verdict", "list", "kind", "pattern")
    decided = active.groupBy("url", "fetched_at").agg(F.max(best).alias("b"), F.count("*").alias("n_active"))
    return rows.join(decided, ["url", "fetched_at"], "left").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at", F.coalesce("b.verdict", F.lit("none")).alias("status"),
        F.col("b.list").alias("list"), F.col("b.kind").alias("kind"), F.col("b.pattern").alias("pattern"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))
