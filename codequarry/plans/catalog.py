"""The registered queries: each runs an operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.functions.text import line_count, lf
from codequarry.operators import block_index as bi
from codequarry.operators import changes as ch
from codequarry.operators import dependencies as dep
from codequarry.operators import gram_index as gi
from codequarry.operators import ignored as ign
from codequarry.operators import index as ix
from codequarry.operators import inspection as ins
from codequarry.operators import line_search as ls
from codequarry.operators import outline as ol
from codequarry.operators import patches as pt
from codequarry.operators import ranking as rk
from codequarry.operators import segments as sg
from codequarry.operators import slices as sl
from codequarry.operators import stack as st
from codequarry.operators import tree as tr
from codequarry.operators import versions as vs
from codequarry.operators.eligible import eligibility, eligible, repository_rules, with_ignored
from codequarry.plans.corpora import CODE, CONFIG, WINDOWS, corpus
from codequarry.sources.shared import new_location
from codequarry.sources.tables import as_files, from_content, spread
from codequarry.sources.trees import read_trees, write_trees

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; the oracle SQL uses the same values.
LITERAL = "license"
REGEX = r"lic[ea]n[sc]e|copyright|[a-z0-9._-]+@[a-z0-9-]+\.[a-z]+"
MULTI = [
    ls.LineQuery("LICENSE", "lit", max_results=7),
    ls.LineQuery("é.*ç", "accent", use_regex=True, max_results=5, path_pattern="FR/"),
    ls.LineQuery(r"\d{3}[-. ]\d{4}", "digits", use_regex=True, max_results=9),
    ls.LineQuery("the ", "typed", max_results=4, exts="txt, .md", path_pattern="en/"),
    ls.LineQuery("the ", "none", max_results=4, exts=["py"]),
]
PAGE_QUERY = ls.LineQuery("<h1>", "pages", max_results=None, exts="htm", path_pattern="/EN/")
MAX_SIZE = 40
MAX_DEPTH = 6
RANK_QUERIES = [
    ("q1", "license copyright notice"),
    ("q2", "Licens permision GRANTED"),
    ("q3", "the the tion"),
    ("q4", "réaux éoution doc_12"),
    ("q5", "softwear provided"),
]
CODE_QUERIES = [("c1", "load widget"), ("c2", "getName point_12"), ("c3", "p_77 price_")]
FILTERED = [
    rk.RankQuery("license the", "f1", 5, path_pattern="/doc_1"),
    rk.RankQuery("éaux licens", "f2", 6, exts="txt", path_pattern="FR/"),
    rk.RankQuery("license", "f3", 4),
]
TOP = 10
# (query_id, query, use_regex, exts, path_pattern, max_results)
REQUESTS = [
    ("all", "LICENSE", False, None, None, None),
    ("pattern", REGEX, True, None, None, None),
    ("words", r"lic[ea]n[sc]e|copyright", True, "", " ", 20),
    ("short", "th", False, "txt", "/DOC_1", 4),
    ("refused", "license(", True, None, None, 5),
    ("blank", " ", False, None, None, 3),
    ("accent", "é.*ç", True, ".TXT, md", "FR/", 5),
    ("typed", "the ", False, "txt, .md", "en/", 4),
    ("none", "the ", False, "py", None, 4),
]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return eligible(corpus(spark, sf, "docs"))


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return eligible(corpus(spark, sf, "code"))


def _listing(files: DataFrame) -> DataFrame:
    """Names only, kept because they are read several times."""
    return files.select("repo", "path").persist()


def _rank_queries(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id string, query string")


def lines_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "docs").select("repo", "path", line_count(lf(F.col("text"))).alias("lines"))


def search_literal(spark: SparkSession, sf: str) -> DataFrame:
    return ls.search_lines(_docs(spark, sf), LITERAL, max_results=30)


def search_regex(spark: SparkSession, sf: str) -> DataFrame:
    return ls.search_lines(_docs(spark, sf), REGEX, use_regex=True, max_results=None)


def search_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    return ls.search_many(_docs(spark, sf), MULTI)


def search_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ls.search_lines(eligible(corpus(spark, sf, "pages")), PAGE_QUERY)


def search_literal_table(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    lines = ls.to_lines(benchmark.select(F.lit("b").alias("repo"), F.col("item_id").cast("string").alias("path"), "text"))
    asked = lines.select(F.concat_ws(":", "path", "line_no").alias("query_id"), F.col("text").alias("query"))
    return ls.search_literals(_docs(spark, sf), asked)


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, gi.REQUESTS)


def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    docs, location = _docs(spark, sf), new_location(spark, "grams")
    gi.write_gram_index(docs, location)
    return gi.search_indexed(docs, gi.read_gram_index(spark, location), _requests(spark))


def search_table(spark: SparkSession, sf: str) -> DataFrame:
    return gi.search_table(_docs(spark, sf), _requests(spark))


def search_table_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every benchmark passage is a request with filters and a limit of its own."""
    lines = ls.to_lines(spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.lit("b").alias("repo"), F.col("item_id").cast("string").alias("path"), "text"))
    requests = lines.selectExpr(
        "concat_ws(':', path, line_no) AS query_id", "text AS query", "path % 3 = 0 AS use_regex",
        "CASE path % 4 WHEN 0 THEN array('TXT', '.md') WHEN 1 THEN array('py') END AS exts",
        "CASE WHEN path % 5 = 0 THEN 'EN/' END AS path_pattern", "CASE WHEN path % 7 <> 0 THEN cast(path % 7 AS int) END AS max_results")
    return gi.search_table(_docs(spark, sf), requests)


def search_statuses(spark: SparkSession, sf: str) -> DataFrame:
    requests = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "cast(doc_id AS string) AS query_id", "doc_id % 5 = 2 AS use_regex",
        "CASE doc_id % 5 WHEN 0 THEN concat(chr(9), ' ') WHEN 1 THEN NULL WHEN 2 THEN concat(doc_id, '(', lang) ELSE text END AS query")
    return gi.request_statuses(requests)


def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = ls.search_lines(_docs(spark, sf), REGEX, use_regex=True, max_results=None)
    return ls.match_counts(hits, ["repo"])


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    winding = F.concat(F.lit("x//./"), paths.dirname(p), F.lit("/../up/"), paths.basename(p))
    return corpus(spark, sf, "code").select(
        "repo", "path", paths.extension(p).alias("ext"), paths.basename(p).alias("base"),
        paths.dirname(p).alias("dir"), paths.depth(p).alias("depth"),
        paths.normalize(winding).alias("folded"), paths.size_kb(F.col("size")).alias("size_kb"),
        paths.strip_module_extension(p).alias("module"),
    )


def eligible_reasons(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    return eligibility(files, max_size=MAX_SIZE, max_depth=MAX_DEPTH, rules=repository_rules(files))


def eligible_counts(spark: SparkSession, sf: str) -> DataFrame:
    return eligible_reasons(spark, sf).groupBy("reason").agg(F.count("*").alias("files"))


def eligible_files(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    return eligible(files, max_size=MAX_SIZE, max_depth=MAX_DEPTH,
                    rules=repository_rules(files)).select("repo", "path", "size")


def ignored_files(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    return with_ignored(files, rules=repository_rules(files)).filter("ignored").select("repo", "path")


def ignored_inherited(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    return ign.ignored_paths(files, rules=repository_rules(files))


def ignore_report(spark: SparkSession, sf: str) -> DataFrame:
    return ign.ignore_report(corpus(spark, sf, "config"))


def tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    return tr.tree(files, tr.MAX_DEPTH, rules=repository_rules(files))


def tree_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return tr.tree(corpus(spark, sf, "code"), max_depth=1, sub_path="src/orders")


def tree_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return tr.directories(corpus(spark, sf, "code"))


def outline_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return ol.outline(_code(spark, sf), ol.SHOWN)


def outline_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ol.outline(_code(spark, sf)).groupBy("repo", "kind").agg(F.count("*").alias("symbols"))


def outline_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ol.outline_summary(_code(spark, sf))


# A request for each part's file, some spelled in another way and some for what may not be read.
REQUESTED = ("CASE p_partkey % 9 WHEN 3 THEN 'src/parts/gone.ts' WHEN 4 THEN '../up.ts' WHEN 5 THEN 'src/parts/key.pem' "
             f"WHEN 6 THEN 'dist/p.ts' WHEN 7 THEN 'src/parts/' ELSE './src/./' || substring({CODE[1].path}, 5) END")


def _file_requests(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "cast(p_partkey AS string) AS request_id", f"{CODE[1].repo} AS repo", f"{REQUESTED} AS path")


def outline_status(spark: SparkSession, sf: str) -> DataFrame:
    found = ins.outline_requests(_code(spark, sf), _file_requests(spark, sf))
    return found.withColumn("symbols", F.when(F.col("symbols").isNotNull(), F.size("symbols")))


def dependency_status(spark: SparkSession, sf: str) -> DataFrame:
    return ins.dependency_requests(_code(spark, sf), _file_requests(spark, sf))


def imports_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return dep.imports(_code(spark, sf))


def imports_internal_external(spark: SparkSession, sf: str) -> DataFrame:
    return dep.import_counts(dep.imports(_code(spark, sf)))


def dependents(spark: SparkSession, sf: str) -> DataFrame:
    files = _code(spark, sf)
    return dep.dependents(dep.imports(files), _listing(files))


def dependent_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = _code(spark, sf)
    return dep.dependent_lines(dep.dependents(dep.imports(files), _listing(files)), files)


def impact_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = _code(spark, sf)
    listing = _listing(files)
    return dep.impact(dep.dependents(dep.imports(files), listing), listing)


def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return ix.index_postings(_docs(spark, sf)).drop("scope")


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ix.index_vocab(ix.index_postings(_docs(spark, sf))).drop("scope")


def field_lengths(spark: SparkSession, sf: str) -> DataFrame:
    stats = ix.index_field_stats(ix.index_docs(_docs(spark, sf), scope="repo"))
    return stats.select("scope", "field", "n_docs", (F.floor(F.col("avg_fl") * 1e4 + 0.5) / 1e4).alias("avg_fl"))


def rank_exact(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    index = ix.build_index(_docs(spark, sf), persist=True)
    return rk.score_documents(index, asked, prefix=False, fuzzy=False).drop("scope")


def rank_query_status(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "cast(doc_id AS string) AS query_id",
        "CASE doc_id % 4 WHEN 0 THEN concat(chr(9), ' ', chr(10)) WHEN 1 THEN NULL ELSE concat(' ', text) END AS query")
    return rk.query_statuses(asked)


def _scores(spark: SparkSession, sf: str, **kinds: bool) -> DataFrame:
    index = ix.build_index(_docs(spark, sf), persist=True)
    return rk.score_documents(index, _rank_queries(spark, RANK_QUERIES), **kinds).drop("scope")


def rank_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, fuzzy=False)


def rank_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


def rank_topk_pct(spark: SparkSession, sf: str) -> DataFrame:
    index = ix.build_index(_docs(spark, sf), persist=True)
    return rk.search_ranked(index, _rank_queries(spark, RANK_QUERIES), TOP).drop("scope")


def rank_repo_scope(spark: SparkSession, sf: str) -> DataFrame:
    index = ix.build_index(_docs(spark, sf), scope="repo", persist=True)
    return rk.search_ranked(index, _rank_queries(spark, RANK_QUERIES), 3)


def _blocks(spark: SparkSession, sf: str, scope: str) -> bi.BlockIndex:
    location = new_location(spark, "blocks")
    bi.write_block_index(_docs(spark, sf), location, scope)
    return bi.read_block_index(spark, location)


def rank_topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return bi.search_blocks(_blocks(spark, sf, "corpus"), _rank_queries(spark, RANK_QUERIES), TOP).hits.drop("scope")


def rank_repo_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return bi.search_blocks(_blocks(spark, sf, "repo"), _rank_queries(spark, RANK_QUERIES), 3).hits


def rank_filtered(spark: SparkSession, sf: str) -> DataFrame:
    index = ix.build_index(_docs(spark, sf), persist=True)
    return rk.search_filtered(index, FILTERED).drop("scope")


def rank_code(spark: SparkSession, sf: str) -> DataFrame:
    index = ix.build_index(_code(spark, sf), persist="statistics")
    return rk.search_ranked(index, _rank_queries(spark, CODE_QUERIES), TOP).drop("scope")


def rank_key_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf)
    asked = _rank_queries(spark, RANK_QUERIES)
    hits = rk.search_ranked(ix.build_index(files, persist=True), asked, TOP)
    shown = rk.describe(hits, files, asked)
    return shown.select("query_id", "rank", "repo", "path", "line_count", "symbol_preview",
                        F.posexplode_outer("key_lines").alias("n", "key")).select(
        "query_id", "rank", "repo", "path", "line_count", "symbol_preview",
        F.col("key.line").alias("line"), F.col("key.text").alias("text"))


def _edited(files: DataFrame, every: int, words: str) -> DataFrame:
    number = F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("bigint")
    return as_files(files.filter(number % every == 0), F.col("repo"), F.col("path"), F.concat(F.lit(words), F.col("text")))


def _removed(files: DataFrame) -> DataFrame:
    return files.filter(F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("bigint") % 10 == 1).select("repo", "path")


def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf)
    return ix.refresh_index(ix.build_index(files), _edited(files, 10, "edited anew "), _removed(files)).vocab.drop("scope")


def index_refresh_repo(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf)
    return ix.refresh_index(ix.build_index(files, "repo"), _edited(files, 10, "edited anew "), _removed(files)).vocab


def _segments(spark: SparkSession, sf: str, scope: str = "corpus") -> ix.Index:
    """The index after two refreshes, of which the second edits some files once more."""
    files, location = _docs(spark, sf), new_location(spark, "segments")
    sg.create_segments(files, location, scope)
    sg.refresh_segments(spark, location, _edited(files, 20, "edited once "))
    sg.refresh_segments(spark, location, _edited(files, 10, "edited anew "), _removed(files))
    return sg.read_segments(spark, location)


def segments_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).vocab.drop("scope")


def segments_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).postings.drop("scope")


def segments_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = _segments(spark, sf, "repo").field_stats
    return stats.select("scope", "field", "n_docs", (F.floor(F.col("avg_fl") * 1e4 + 0.5) / 1e4).alias("avg_fl"))


def _slices(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return documents.selectExpr(
        "cast(doc_id AS string) AS slice_id", "source AS repo",
        "CASE WHEN doc_id % 11 = 3 THEN 'gone.txt' WHEN doc_id % 11 = 4 THEN '../up.txt' "
        "WHEN doc_id % 11 = 5 THEN 'a/.env' WHEN doc_id % 11 = 6 THEN 'dist/a.txt' "
        "ELSE './' || lang || '/doc_' || cast(doc_id AS string) || '.txt' END AS path",
        "CASE WHEN doc_id % 9 = 0 THEN -1 WHEN doc_id % 9 = 1 THEN NULL ELSE cast(doc_id % 9 - 2 AS int) END AS start_line",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE cast(doc_id % 5 + 1 AS int) END AS end_line",
    )


def slice_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sl.slice_lines(corpus(spark, sf, "docs"), _slices(spark, sf))


def slice_status(spark: SparkSession, sf: str) -> DataFrame:
    return sl.slice_status(corpus(spark, sf, "docs"), _slices(spark, sf)).drop("text")


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf}/part.parquet"))
    path = ("CASE WHEN p_partkey % 11 = 3 THEN 'lib/gone_' || cast(p_partkey AS string) "
            "WHEN p_partkey % 13 = 4 THEN '../p_' || cast(p_partkey AS string) "
            "WHEN p_partkey % 17 = 5 THEN 'lib/' || cast(p_partkey AS string) || '.pem' "
            "ELSE 'lib/p_' || cast(p_partkey AS string) || '.yml' END")
    both = [
        ("1", "'size: '", "'size: $&' || cast(p_partkey AS string)", "false"),
        ("2", "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'e: ' ELSE 'absent' END",
         "'e = ' || chr(13) || chr(10)", "p_partkey % 2 = 0"),
    ]
    out = None
    for seq, target, replacement, multiple in both:
        rows = part.selectExpr(
            f"cast(p_partkey AS string) || '#{seq}' AS patch_id", f"{seq} AS seq",
            "'shop_' || cast(p_partkey % 7 AS string) AS repo", f"{path} AS path",
            f"{target} AS target", f"{replacement} AS replacement", f"{multiple} AS allow_multiple")
        out = rows if out is None else out.unionByName(rows)
    return out


def patch_results(spark: SparkSession, sf: str) -> DataFrame:
    return pt.apply_patches(corpus(spark, sf, "working"), _patches(spark, sf)).results


def patch_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "working")
    run = pt.apply_patches(files, _patches(spark, sf))
    return pt.snapshot(files, run.changed).drop("is_binary")


def patch_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return patch_results(spark, sf).groupBy("status").agg(F.count("*").alias("patches"))


VERSION_FOLDERS = 16


def _versions(spark: SparkSession, sf: str) -> str:
    """A store of five versions: base, staged, working, patched, and base once more."""
    base, staged, working = [corpus(spark, sf, name) for name in ("base", "staged", "working")]
    location = new_location(spark, "versions")
    vs.create_versions(base, location, VERSION_FOLDERS)
    for old, new in ((base, staged), (staged, working)):
        changed = new.join(old.select("repo", "path", F.col("text").alias("before")), ["repo", "path"], "left")
        gone = old.join(new, ["repo", "path"], "left_anti").select("repo", "path")
        vs.commit_files(spark, location, changed.filter("before IS NULL OR before <> text"), gone)
    patched = pt.apply_patches(vs.read_version(spark, location, 3), _patches(spark, sf))
    vs.commit_files(spark, location, patched.changed, parent=3)
    vs.roll_back(spark, location, 1)
    return location


def version_files(spark: SparkSession, sf: str) -> DataFrame:
    location, out = _versions(spark, sf), None
    for version in range(1, 6):
        files = vs.read_version(spark, location, version).select(F.lit(version).alias("version"), "repo", "path", "size", "text")
        out = files if out is None else out.unionByName(files)
    return out


def version_changes(spark: SparkSession, sf: str) -> DataFrame:
    location = _versions(spark, sf)
    steps = [vs.changes_between(spark, location, old, new).withColumn("step", F.lit(f"{old}-{new}")) for old, new in ((1, 2), (1, 3), (5, 1))]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def version_log(spark: SparkSession, sf: str) -> DataFrame:
    return vs.version_log(spark, _versions(spark, sf)).drop("folders_written")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return ch.classify_changes(*[corpus(spark, sf, name) for name in ("base", "staged", "working")])


def changes_classified(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ch.change_counts(_changes(spark, sf))


def untracked_preview(spark: SparkSession, sf: str) -> DataFrame:
    return ch.untracked_preview(_changes(spark, sf))


def diff_stat(spark: SparkSession, sf: str) -> DataFrame:
    return ch.diff_stat(corpus(spark, sf, "base"), corpus(spark, sf, "working"), corpus(spark, sf, "staged"))


def diff_total(spark: SparkSession, sf: str) -> DataFrame:
    return ch.diff_total(ch.diff_stat(corpus(spark, sf, "base"), corpus(spark, sf, "working")))


def trees_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All configuration files written as directory trees, one for each repository, listed and read back."""
    files = corpus(spark, sf, "config")
    base = new_location(spark, "trees").removeprefix("file:")
    roots = files.select("repo").distinct().select("repo", F.concat_ws("/", F.lit(base), "repo").alias("root"))
    write_trees(files, roots)
    return read_trees(spark, roots)


def decoded_content(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bytes, with malformed UTF-8 between two texts, and a line break of two characters."""
    files = corpus(spark, sf, "docs")
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FFC30D0A")), F.encode(F.col("path"), "UTF-8"))
    decoded = from_content(files.select("repo", "path", content.alias("content")))
    return decoded.select("repo", "path", "size", "is_binary", "text", line_count(lf(F.col("text"))).alias("lines"))


def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every entry in its repository's listing."""
    return tr.places(tr.tree(corpus(spark, sf, "code")).select("repo", "path"))


def dependents_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that are named by a part of their path, by a longer path, twice, and by themselves."""
    files = eligible(corpus(spark, sf, "modules"))
    return dep.dependents(dep.imports(files), _listing(files))


def rank_code_key_lines(spark: SparkSession, sf: str) -> DataFrame:
    files, asked = _code(spark, sf), _rank_queries(spark, CODE_QUERIES)
    hits = rk.search_ranked(ix.build_index(files, persist="statistics"), asked, TOP)
    shown = rk.describe(hits, files, asked)
    return shown.select("query_id", "rank", "repo", "path", "line_count", "symbol_preview",
                        F.posexplode_outer("key_lines").alias("n", "key")).select(
        "query_id", "rank", "repo", "path", "line_count", "symbol_preview",
        F.col("key.line").alias("line"), F.col("key.text").alias("text"))


def index_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked search over an index that was written and read back."""
    location = new_location(spark, "index")
    ix.write_index(ix.build_index(_docs(spark, sf)), location)
    return rk.search_ranked(ix.read_index(spark, location), _rank_queries(spark, RANK_QUERIES), TOP).drop("scope")


def _config_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for every customer's file, every second one spelled with back-slashes."""
    path = f"CASE WHEN c_custkey % 2 = 1 THEN replace({CONFIG[0].path}, '/', chr(92)) ELSE {CONFIG[0].path} END"
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "cast(c_custkey AS string) AS id", f"{CONFIG[0].repo} AS repo", f"{path} AS path")


def slice_status_ignored(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    asked = _config_requests(spark, sf).selectExpr("id AS slice_id", "repo", "path", "2 AS start_line", "cast(NULL AS int) AS end_line")
    return sl.slice_status(files, asked, rules=repository_rules(files)).drop("text")


def patch_results_ignored(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf, "config")
    asked = _config_requests(spark, sf).selectExpr(
        "id AS patch_id", "1 AS seq", "repo", "path", "'segment' AS target", "'market' AS replacement", "false AS allow_multiple")
    run = pt.apply_patches(files, asked, rules=repository_rules(files))
    return run.results.select("patch_id", "repo", "status", "occurrences", "old_lines")


def patch_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Files with either line end after a patch over two lines, found once, and one of a word found twice."""
    files = corpus(spark, sf, "windows")
    patches = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        f"{WINDOWS[0].repo} AS repo", "'win/p_' || cast(p_partkey AS string) || '.ini' AS path", "cast(p_partkey AS string) AS patch_id",
        "explode(array(1, 2)) AS seq", "p_size").selectExpr(
        "patch_id", "seq", "repo", "path", "CASE seq WHEN 1 THEN 'size: ' || p_size || chr(10) || 'end' ELSE 'size' END AS target",
        "CASE seq WHEN 1 THEN 'size: 0' || chr(13) || chr(10) || 'more' || chr(10) || 'end' ELSE 'weight' END AS replacement",
        "seq = 2 AND patch_id % 3 = 0 AS allow_multiple")
    return pt.snapshot(files, pt.apply_patches(files, patches).changed).drop("is_binary")


def tech_stack(spark: SparkSession, sf: str) -> DataFrame:
    return st.tech_stack(corpus(spark, sf, "manifest"))


def manifest_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.manifests(corpus(spark, sf, "manifest"))
    lists = ["dependencies", "dev_dependencies", "scripts"]
    return rows.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in rows.columns])


def readme_preview(spark: SparkSession, sf: str) -> DataFrame:
    return st.readme_preview(corpus(spark, sf, "manifest"))


QUERIES: dict[str, Query] = {f.__name__: f for f in [
    lines_per_file, search_literal, search_regex, search_multi_query, search_path_filter,
    search_literal_table, search_indexed, search_table, search_table_filtered, search_statuses, match_counts, path_parts, eligible_reasons, eligible_counts, eligible_files,
    ignored_files, ignored_inherited, ignore_report, tree_rows, tree_subtree, tree_dirs, outline_symbols, outline_kind_counts,
    outline_summary, outline_status, dependency_status, imports_extracted, imports_internal_external, dependents, dependent_lines,
    impact_counts, term_frequencies, term_stats, field_lengths, rank_exact, rank_query_status, rank_prefix, rank_fuzzy,
    rank_topk_pct, rank_repo_scope, rank_topk_blocks, rank_repo_blocks, rank_filtered, rank_code, rank_key_lines, index_refresh,
    index_refresh_repo, segments_vocab, segments_postings, segments_stats,
    slice_lines, slice_status, patch_results, patch_snapshot, patch_status_counts, version_files, version_changes, version_log,
    changes_classified, change_counts, untracked_preview, diff_stat, diff_total,
    tech_stack, manifest_keys, readme_preview, trees_round_trip, decoded_content, tree_order, dependents_suffix,
    rank_code_key_lines, index_stored, slice_status_ignored, patch_results_ignored, patch_line_ends,
]}
