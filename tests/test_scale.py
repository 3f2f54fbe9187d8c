"""Plans and helpers that keep the work in proportion to the input."""

from pyspark.sql import functions as F

from codequarry.functions import ignore_rules as ig
from codequarry.functions import paths
from codequarry.functions.pattern_grams import grams
from codequarry.operators import dependencies as dep
from codequarry.operators import gram_index as gi
from codequarry.operators import index as ix
from codequarry.operators import ranking as rk
from codequarry.operators import tree as tr
from codequarry.operators.shared import broadcast_checked


def test_rows_past_the_bound_stay_kept(spark):
    held = broadcast_checked(spark.range(50), max_rows=10)
    assert held.is_cached and held.count() == 50


def test_statistics_only_index_keeps_no_postings(spark, make_files):
    files = make_files(("r", "a.py", "def load(x):\n  pass"), ("r", "b.md", "# load more"))
    index = ix.build_index(files, persist="statistics")
    assert not index.postings.is_cached and index.vocab.is_cached
    asked = spark.createDataFrame([("q", "load")], "query_id string, query string")
    whole = rk.search_ranked(ix.build_index(files, persist=True), asked).collect()
    assert whole and rk.search_ranked(index, asked).collect() == whole


def test_needed_parts_of_ignore_patterns(spark):
    assert ig.compile_patterns(["*.log", "a/**/Long?name"])[0].needed == (".log", "long")
    assert ig.compile_patterns(["*.log", "[ab]"])[0].needed == ()
    rows = spark.createDataFrame([("x/BUILD/a",), ("x/rebuild/a",), ("k.PEM",), (None,)], "p string")
    assert [r[0] for r in rows.select(ig.is_ignored(F.col("p"))).collect()] == [True, False, True, None]


def test_files_of_other_names_offer_no_suffixes(spark, make_files):
    files = make_files(("r", "src/use.ts", 'import a from "./lib/m.js";'), ("r", "src/lib/m.ts", "x"), ("r", "src/lib/other.ts", "x"))
    got = dep.dependents(dep.imports(files), files.select("repo", "path")).collect()
    assert [tuple(r) for r in got] == [("r", "src/use.ts", "src/lib/m.ts", "exact")]


def test_order_key_sorts_as_components_do(spark):
    parts = ["", "a", "b", "a-", "a\x00", "a\x00b", "a\x01", "a\x01\x01b", "\x00", "\x01", "\x01\x02", "\x02", "é", "😀"]
    names = [*parts, *(f"{x}/{y}" for x in parts for y in parts), *(f"{x}/a/{x}" for x in parts)]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    keyed = rows.select("path", paths.order_key(F.col("path")).alias("key")).withColumn("back", paths.from_order_key(F.col("key"))).collect()
    assert all(r.back == r.path for r in keyed)
    assert [r.path for r in sorted(keyed, key=lambda r: r.key.encode())] == sorted(names, key=lambda n: [c.encode() for c in n.split("/")])


def test_listing_is_sorted_by_a_column_and_tests_each_directory_once(spark, make_files):
    files = make_files(("r", "a/b/x.ts", ""), ("r", "a/b/y.ts", ""), ("r", "a-b/build/z", ""), ("r", "a/b/c/d/z", ""), ("s", "a/b/", ""))
    plan = tr.tree(files, max_depth=1, sub_path="a")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [repo" in plan and "split(" not in plan
    below = plan.split("partial_max(", 1)[1].split("LocalTableScan", 1)[0].split("Scan", 1)[0]
    assert "node_modules" not in below
    got = [tuple(r) for r in tr.tree(files, max_depth=1, sub_path="a").select("repo", "path", "is_dir", "depth").collect()]
    assert got == [("r", "a/b", True, 0), ("r", "a/b/c", True, 1), ("r", "a/b/x.ts", False, 1), ("r", "a/b/y.ts", False, 1),
                   ("s", "a/b", True, 0), ("s", "a/b/", False, 1)]


def test_places_need_no_task_with_a_whole_repository(spark):
    names = [(repo, f"d{i % 7}/f{i // 2:03d}") for repo in (None, "one", "two") for i in range(60)] + [("three", "x")]
    rows = spark.createDataFrame(names, "repo string, path string")
    listed = rows.repartitionByRange(9, "repo", "path").sortWithinPartitions("repo", "path")
    placed = tr.places(listed)
    assert "row_number" not in placed._jdf.queryExecution().optimizedPlan().toString()
    want, seen = [], {}
    for repo, path in sorted(names, key=lambda n: (n[0] or "", n[1])):
        seen[repo] = seen.get(repo, 0) + 1
        want.append((repo, path, seen[repo]))
    assert sorted(map(tuple, placed.collect()), key=lambda r: (r[0] or "", r[2])) == want
    assert dict(placed.dtypes)["place"] == "int"


def test_statistics_of_one_pass_and_postings_of_asked_terms(spark, make_files):
    rows = [("r", "a.py", "def load_it(x):\r\n  load load"), ("r", "a.py", "def load_it(x):\r\n  load load"), ("s", "b.md", "# Load more"), ("s", "c.txt", ""),
            (None, "d.ts", "class Loads {"), ("s", None, "load"), ("s", "e.py", None)]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    for scope in ("corpus", "repo"):
        postings = ix.index_postings(files, scope)
        vocab, stats = ix.index_statistics(files, scope)
        assert sorted(map(tuple, vocab.collect()), key=repr) == sorted(map(tuple, ix.index_vocab(postings).collect()), key=repr)
        want = ix.index_field_stats(ix.index_docs(files, scope))
        assert stats.columns == want.columns and sorted(map(tuple, stats.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        index = ix.build_index(files, scope, persist="statistics")
        asked = spark.createDataFrame([("load",), ("more",)], "term string")
        found = index.postings_of(asked)
        assert found.count() < postings.count()
        assert sorted(map(tuple, found.join(asked, "term", "left_semi").collect()), key=repr) == sorted(
            map(tuple, postings.join(asked, "term", "left_semi").collect()), key=repr)


def test_every_marked_term_may_be(spark):
    terms = spark.range(3000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    test = ix.may_be(terms)
    others = spark.range(3000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("term"))
    assert terms.filter(test(F.col("term"))).count() == 3000 and others.filter(test(F.col("term"))).count() < 1000
    assert terms.filter(ix.may_be(terms.limit(0))(F.col("term"))).count() == 0


def test_rules_shuffle_no_vocabulary(spark, make_files):
    index = ix.build_index(make_files(("r", "a.py", "def load(x):\n  loaded"), ("r", "b.md", "# lood more")), persist="statistics")
    rules = rk.scoring_rules(index, spark.createDataFrame([("load",)], "qt string"))
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # of the starts of asked words and of near candidates; the vocabulary's terms have none
    got = {(r.field, r.term): r.worth for r in rules.collect()}
    assert {t for _, t in got} == {"load", "loaded", "lood"} and len(rules.columns) == 6


def test_grams_are_sorted_in_as_many_tasks_as_a_shuffle_has(spark, make_files, tmp_path):
    files = make_files(*[("r", f"{i}.txt", " ".join(f"{i * k * 7919:x}" for k in range(60))) for i in range(20)])
    gi.write_gram_index(files, f"{tmp_path}/grams")
    written = {name.name.split("-")[1] for name in (tmp_path / "grams" / "files").glob("part=*/part-*.parquet")}
    assert len(written) > 1
    held = gi.read_gram_index(spark, f"{tmp_path}/grams").files
    assert held.count() == held.select("gram", "file").distinct().count() == files.select(F.explode(grams(F.col("text")))).count()
