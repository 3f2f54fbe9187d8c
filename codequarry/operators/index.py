"""The ranked-search index as tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.functions.symbols import symbol_array
from codequarry.functions.text import lf, line_count
from codequarry.functions.tokens import field_length, term_counts, tokens
from codequarry.operators.shared import broadcast_checked
from codequarry.sources.shared import stored

FIELDS = ["symbols", "file", "content"]
# Numbers that mark hashed terms at most.
MARKS = 1 << 16
Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Index:
    """Index tables.

    ``docs(scope, repo, path, ext, line_count, symbols, fl_<field>...)``,
    ``postings(scope, repo, path, field, term, tf, fl)``,
    ``vocab(scope, field, term, df)``,
    ``field_stats(scope, field, n_docs, avg_fl)``.

    ``scope`` is the set of files that document frequencies and averages are
    taken over: the repository, or ``*`` for the corpus as a whole.  ``kind``
    says which of the two (``repo`` or ``corpus``) the index was built for.
    Where postings are not kept, ``files`` are what they are found in.
    """

    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    field_stats: DataFrame
    kind: str = "corpus"
    files: DataFrame | None = None

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """All postings of the ``terms (term)``, and maybe of others.

        Where they are found in the files, a file's other tokens are dropped
        before they are counted.
        """
        return self.postings if self.files is None else index_postings(self.files, self.kind, among=may_be(terms))

    def persist(self) -> Index:
        """K2: keep the tables for further searches in this session."""
        return Index(*[t.persist() for t in self.tables()], self.kind)

    def unpersist(self) -> None:
        """K3: forget the kept tables."""
        for table in self.tables():
            table.unpersist()

    def tables(self) -> list[DataFrame]:
        return [self.docs, self.postings, self.vocab, self.field_stats]


def _fields(files: DataFrame, scope: str, carried: Sequence[str] = ()) -> DataFrame:
    """The three texts of each file that are ranked, and columns of its own row."""
    flat = files.select("repo", "path", *carried, lf(F.col("text")).alias("content"),
                        F.lower(paths.extension(F.col("path"))).alias("_ext"))
    signatures = F.transform(symbol_array(F.col("content"), F.col("_ext")), lambda s: s["signature"])
    return flat.select(
        (F.col("repo") if scope == "repo" else F.lit("*")).alias("scope"),
        "repo", "path", *carried, "content", F.array_join(signatures, " ").alias("symbols"), F.col("path").alias("file"),
    )


def index_docs(files: DataFrame, scope: str = "corpus", terms: bool = False) -> DataFrame:
    """One row per file with its field lengths, and the ``terms`` of its postings where asked for."""
    fields = _fields(files, scope)

    def named(field: str) -> Column:
        return F.transform(term_counts(tokens(F.col(field))), lambda t: F.struct(F.lit(field).alias("field"), t["term"].alias("term")))

    return fields.select(
        "scope", "repo", "path", paths.extension(F.col("path")).alias("ext"),
        line_count(F.col("content")).alias("line_count"), "symbols",
        *[field_length(F.col(f)).alias(f"fl_{f}") for f in FIELDS],
        *([F.concat(*[named(f) for f in FIELDS]).alias("terms")] if terms else []),
    )


def index_postings(files: DataFrame, scope: str = "corpus", keep: Sequence[str] = (), among: Test | None = None) -> DataFrame:
    """A1: one row per (file, field, term); built inside each row, no shuffle.

    ``keep`` names columns of the file's own row (its own or ``fl_<field>``) to carry along.
    ``among`` tells which terms are wanted; a field's length counts all.
    """
    fields = _fields(files, scope, [c for c in keep if c in files.columns])

    def tagged(field: str) -> Column:
        return F.transform(term_counts(tokens(F.col(field), among)), lambda t: F.struct(
            F.lit(field).alias("field"), t["term"].alias("term"), t["tf"].alias("tf"),
            F.col(f"fl_{field}").alias("fl"),
        ))

    measured = fields.select("*", *[field_length(F.col(f)).alias(f"fl_{f}") for f in FIELDS])
    return measured.select("scope", "repo", "path", *keep, F.inline(F.concat(*[tagged(f) for f in FIELDS])))


def index_vocab(postings: DataFrame) -> DataFrame:
    """A2: document frequency per field; combined before the shuffle."""
    return postings.groupBy("scope", "field", "term").agg(F.count("*").alias("df"))


def index_field_stats(docs: DataFrame) -> DataFrame:
    """A3: number of files and mean field length of each scope."""
    means = docs.groupBy("scope").agg(
        F.count("*").alias("n_docs"), *[F.avg(f"fl_{f}").alias(f) for f in FIELDS]
    )
    return means.select("scope", "n_docs", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("avg_fl")) for f in FIELDS
    ])).alias("s")).select("scope", "s.field", "n_docs", "s.avg_fl")


def index_statistics(files: DataFrame, scope: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """A2, A3: the tables of :func:`index_vocab` and :func:`index_field_stats` from one pass over the files.

    Each field offers its distinct terms, which need not be counted, and a
    null that stands for the file itself.  The sums are stored, as both tables
    are read from them.
    """
    fields = _fields(files, scope)
    none = F.array().cast("array<string>")
    own = [F.struct(F.lit(f).alias("field"), field_length(F.col(f)).alias("fl"),
                    F.coalesce(F.array_distinct(tokens(F.col(f))), none).alias("terms")) for f in FIELDS]
    offered = fields.select("scope", F.explode(F.array(*own)).alias("own")).select(
        "scope", "own.field", "own.fl", F.explode(F.array_append("own.terms", F.lit(None).cast("string"))).alias("term"))
    counted = stored(offered.groupBy("scope", "field", "term").agg(
        F.count("*").alias("n"), F.sum("fl").alias("total"), F.count("fl").alias("measured")), "statistics")
    vocab = counted.filter("term IS NOT NULL").select("scope", "field", "term", F.col("n").alias("df"))
    stats = counted.filter("term IS NULL").select("scope", "field", F.col("n").alias("n_docs"), F.try_divide("total", "measured").alias("avg_fl"))
    return vocab, stats


def may_be(terms: DataFrame) -> Test:
    """Tells of a term whether it may be one of ``terms (term)``: always for these, for few others.

    Hashes are marked in an array of at most ``MARKS`` numbers of 64 bits.
    """
    hashes = terms.select(F.xxhash64("term").alias("h")).distinct()
    size = min(MARKS, 1 << max(4, (hashes.count() // 8).bit_length()))

    def places(h: Column) -> tuple[Column, Column]:
        at = F.pmod(h, F.lit(size * 64))
        return F.shiftright(at, 6).cast("int"), (at % 64).cast("int")

    word, bit = places(F.col("h"))
    marked = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).collect()
    found = dict(map(tuple, marked))
    marks = F.from_json(F.lit(json.dumps([found.get(i, 0) for i in range(size)])), "array<bigint>")  # folded to a constant

    def test(term: Column) -> Column:
        word, bit = places(F.xxhash64(term))
        return F.call_function("shiftright", F.get(marks, word), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1

    return test


def _complete(docs: DataFrame, postings: DataFrame, kind: str) -> Index:
    return Index(docs, postings, index_vocab(postings), index_field_stats(docs), kind)


def check_scope(scope: str) -> str:
    if scope not in ("corpus", "repo"):
        raise ValueError(f"unknown scope {scope!r}")
    return scope


def build_index(files: DataFrame, scope: str = "corpus", persist: bool | str = False) -> Index:
    """Index files (already filtered by ``eligible``).

    The two base tables are narrow; only vocabulary counts are shuffled.
    With ``persist`` the base tables are kept before the derived ones are
    declared, so those read the kept rows.  ``persist="statistics"`` keeps the
    derived tables only, for a single search over files whose postings are
    many times the memory: it reads the files once for these and once more for
    the postings of the asked terms.
    """
    check_scope(scope)
    docs, postings = index_docs(files, scope), index_postings(files, scope)
    if persist == "statistics":
        vocab, stats = index_statistics(files, scope)
        return Index(docs, postings, vocab.persist(), stats.persist(), scope, files)
    if persist:
        docs, postings = docs.persist(), postings.persist()
    index = _complete(docs, postings, scope)
    return index.persist() if persist else index


def restrict(index: Index, exts: str | Iterable[str] | None = None, path_pattern: str | None = None) -> Index:
    """The index of a filtered corpus: P5 and P6 come before statistics.

    Postings carry their path, so no file is read again and nothing is joined.
    """
    tests = [paths.extension_in(F.col("path"), exts), paths.path_contains(F.col("path"), path_pattern)]
    docs, postings = index.docs, index.postings
    for test in tests:
        if test is not None:
            docs, postings = docs.filter(test), postings.filter(test)
    return index if all(t is None for t in tests) else _complete(docs, postings, index.kind)


def under_filters(index: Index, filters: Sequence[tuple[Iterable[str] | None, str | None]]) -> Index:
    """One index for several filters (extensions, path pattern), with statistics of each filtered corpus.

    Scopes become ``number of the filter/scope``.  Both tables are scanned
    once, whatever the number of filters.
    """
    path = F.col("path")

    def passes(exts: Iterable[str] | None, pattern: str | None) -> Column:
        tests = [t for t in (paths.extension_in(path, exts), paths.path_contains(path, pattern)) if t is not None]
        keep = F.lit(True)
        for test in tests:
            keep = keep & test
        return keep

    numbers = F.array_compact(F.array(*[F.when(passes(*f), F.lit(str(i))) for i, f in enumerate(filters)]))

    def spread(table: DataFrame) -> DataFrame:
        rest = [c for c in table.columns if c != "scope"]
        under = table.select("scope", *rest, F.explode(numbers).alias("_filter"))
        return under.select(F.concat_ws("/", "_filter", "scope").alias("scope"), *rest)

    return _complete(spread(index.docs), spread(index.postings), index.kind)


def filter_of(scope: Column) -> Column:
    """The number of the filter in a scope of :func:`under_filters`."""
    return F.substring_index(scope, "/", 1).cast("int")


def write_index(index: Index, location: str) -> None:
    """K2: store the index; postings are range-partitioned by term.

    A reader looking for a few terms skips all other row groups, and since
    the path is part of the range a very common term spans many files.  The
    postings are kept while ranges, rows and counts are found in them.
    """
    held = [t.persist() for t in (index.postings, index.vocab) if not t.is_cached]
    index.docs.write.mode("errorifexists").parquet(f"{location}/docs")
    about = index.docs.sparkSession.createDataFrame([(index.kind,)], "kind string")
    about.write.mode("errorifexists").parquet(f"{location}/about")
    keys = ["scope", "field", "term", "path"]
    for name, table, order in [
        ("postings", index.postings, keys), ("vocab", index.vocab, keys[:3]),
        ("field_stats", index.field_stats, keys[:2]),
    ]:
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
            "errorifexists").parquet(f"{location}/{name}")
    for table in held:
        table.unpersist()


def read_index(spark: SparkSession, location: str) -> Index:
    """K2: a stored index."""
    names = ["docs", "postings", "vocab", "field_stats"]
    kind = spark.read.parquet(f"{location}/about").first()["kind"]
    return Index(*[spark.read.parquet(f"{location}/{n}") for n in names], kind)


def refresh_index(index: Index, changed: DataFrame, removed: DataFrame | None = None) -> Index:
    """K3: replace the rows of changed files, drop those of removed ones.

    ``changed`` is a files table, ``removed`` has ``repo, path``.  Only the
    changed files are analysed, in the index's own scope; the rest pass
    through an anti join on the changed keys.
    """
    keys = changed.select("repo", "path")
    stale = keys if removed is None else keys.unionByName(removed.select("repo", "path"))
    stale = broadcast_checked(stale.distinct())

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(stale, ["repo", "path"], "left_anti").select(*new.columns).unionByName(new)

    return _complete(replaced(index.docs, index_docs(changed, index.kind)),
                     replaced(index.postings, index_postings(changed, index.kind)), index.kind)
