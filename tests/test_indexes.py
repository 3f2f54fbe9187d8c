"""Indexes that skip, segments that are refreshed, and listings that prune."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry.functions.ignore_rules import compile_pattern
from codequarry.functions.pattern_grams import fold, folded, grams, literal_needs, regex_needs
from codequarry.operators import block_index as bi
from codequarry.operators import gram_index as gi
from codequarry.operators import index as ix
from codequarry.operators import line_search as ls
from codequarry.operators import ranking as rk
from codequarry.operators import segments as sg
from codequarry.operators import stack as st
from codequarry.operators.eligible import eligibility, repository_rules
from codequarry.operators.shared import top_per_group
from codequarry.sources import trees


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*(columns or frame.columns)).collect()), key=repr)


@pytest.mark.parametrize("pattern, needs", [
    ("license", [{"lic"}, {"ice"}, {"cen"}, {"ens"}, {"nse"}]), ("a|b", []), (r"\d{3}[-. ]\d{4}", []), ("a(bc|de)fgh+i", [{"fgh"}]),
    ("x(abc)?def", [{"def"}]), (r"(?i)abc", []), (r"\p{L}abc", []), ("abc(", []), ("(?=xyz)hell", [{"hel"}, {"ell"}]), ("lic[ea]n", [{"lic"}, {"ice", "ica"}, {"cen", "can"}]),
    ("foo|bar", [{"foo", "bar"}]), ("ab+cd", [{"bcd"}]), ("[a&&b]cde", []), ("a{0}bcd", [{"bcd"}]), ("ab{x}", []), (r"\Qab\Ecd", []), (r"foo\.b", [{"foo"}, {"oo."}, {"o.b"}])])
def test_needs_of_patterns(pattern, needs):
    assert regex_needs(pattern) == needs


def test_what_matches_meets_the_needs():
    draw = random.Random(8)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "[ab]", "[^a]", "[a-c]", "(ab|c)", "(?:abc)+", "b?", "c*", "a+", "b{2}", ".", r"\w", "(a|bc)?", "c{1,2}", "(?!c)", "|"]
    met = 0
    for _ in range(30000):
        pattern = "".join(draw.choices(pieces, k=draw.randrange(1, 7)))
        line = "".join(draw.choices("abcAB", k=draw.randrange(3, 16)))
        if re.search(pattern, line, re.IGNORECASE):
            text = folded(line)
            for need in regex_needs(pattern):
                met += 1
                assert any(gram in text for gram in need), (pattern, line)
    assert met > 300


def test_folding_is_that_of_the_matcher(spark):
    odd = ["LİCENSE", "licenſe", "Kelvin", "ΑΣ ΟΔΟΣ", "İı", "straße", "µm", "É"]
    table = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r.f for r in table.select(fold(F.col("t")).alias("f")).collect()] == [folded(t) for t in odd]
    found = spark.createDataFrame([("ab\ncdé😀x",)], "t string").select(grams(F.col("t")).alias("g")).first().g
    assert found == ["cdé", "dé😀", "é😀x"] and literal_needs("ab") == []


REQUESTS = [
    ("plain", "LICENSE", False, None, None, None), ("dotted", "lıcense", True, None, None, None), ("kelvin", "kelvin", True, None, None, None), ("sigma", "οδος", True, None, None, None),
    ("short", "li", False, None, None, 2), ("regex", "lic[ea]nse|copy(right|left)", True, None, None, None), ("any", "[0-9]+", True, "MD, ts", None, 3),
    ("path", "license", False, None, " SRC\\", None), ("bad", "a(", True, None, None, None), ("blank", "\t", False, None, None, None), ("null", None, False, None, None, None),
    ("zero", "license", False, None, None, 0), ("none", "zzzz", False, None, None, 4)]


def test_indexed_search_equals_line_search(spark, make_files, tmp_path):
    files = make_files(
        ("r", "src/a.ts", "MIT License\r\nno\nLİCENSE 12"), ("r", "b.md", "licanse 7\ncopyleft\nlicense 3 license"), ("s", "c.txt", "Kelvin licenſe 9"),
        ("s", "d.txt", "ΟΔΟΣ οδοσ\n"), ("s", "e.ts", ""), ("t", "f.md", "lic\nense 4"))
    requests = spark.createDataFrame(REQUESTS, gi.REQUESTS)
    gi.write_gram_index(files, f"{tmp_path}/grams")
    index = gi.read_gram_index(spark, f"{tmp_path}/grams")
    for got in (gi.search_indexed(files, index, requests), gi.search_table(files, requests)):
        found = rows(got, "query_id", "repo", "path", "line_no", "line")
        for query_id, query, use_regex, exts, path_pattern, limit in REQUESTS:
            if query_id not in ("bad", "blank", "null"):
                want = ls.search_lines(files, query, use_regex=use_regex, exts=exts, path_pattern=path_pattern, max_results=limit)
                assert [f[1:] for f in found if f[0] == query_id] == rows(want), query_id
        assert not {f[0] for f in found} & {"bad", "blank", "null", "zero", "none"}
        assert {r["rank"] for r in got.filter("query_id = 'plain'").collect()} == {None}
    assert dict(rows(gi.request_statuses(requests)))["bad"] == "invalid_regex"
    assert [s for q, s in rows(gi.request_statuses(requests)) if q in ("blank", "null")] == ["empty", "empty"]
    named = gi.candidates(index, gi.needs_of(gi.prepared(requests).filter("status = 'ok'")))
    assert named.filter("query_id = 'plain'").count() == 3  # LİCENSE and licenſe are folded alike; the lines decide
    arrays = spark.createDataFrame([("x", "license", [".MD"])], "query_id string, query string, exts array<string>")
    assert rows(gi.search_table(files, arrays), "path", "line_no") == [("b.md", 3)]
    assert gi.search_table(files, requests.limit(0)).count() == 0 and gi.search_table(files.limit(0), requests).count() == 0
    long = make_files(("r", "l.txt", "license " + "x" * 500))
    one = spark.createDataFrame([("q", "license")], "query_id string, query string")
    assert len(gi.search_table(long, one, shown=None).first().line) == 508 == len(ls.search_lines(long, "license", shown=None).first().line)
    assert len(gi.search_table(long, one).first().line) == 203


def test_block_search_equals_ranked_search_and_skips(spark, make_files, tmp_path):
    draw = random.Random(1)
    words = ["tree", "trees", "walk", "leaf", "node", "graph", "edge", "road", "lake", "hill"]
    files = make_files(*[(f"r{i % 3}", f"d{i}.txt", " ".join(draw.choices(words, range(1, 11), k=draw.randrange(3, 60)))) for i in range(240)])
    asked = spark.createDataFrame([("one", "tree", 3), ("two", "walk leaf walk", None), ("three", "  ", 5), ("four", "tre nod", 1), ("five", "lake", 0), ("six", "absent", 4)],
                                  "query_id string, query string, max_results int")
    for scope in ("corpus", "repo"):
        bi.write_block_index(files, f"{tmp_path}/{scope}", scope, block_files=4)
        index = bi.read_block_index(spark, f"{tmp_path}/{scope}")
        for widening in ((1, 8), ()) if scope == "corpus" else ((1, 8),):
            found = bi.search_blocks(index, asked, widening=widening)
            assert rows(found.hits) == rows(rk.search_ranked(ix.build_index(files, scope), asked))
            if widening:
                assert 0 < found.read.count() < 0.6 * found.matched.count()
    assert rows(bi.search_blocks(index, asked, 2).hits) == rows(rk.search_ranked(ix.build_index(files, "repo"), asked, 2))
    assert bi.search_blocks(index, asked.limit(0)).hits.count() == 0


def test_segments_equal_a_full_build(spark, make_files, tmp_path):
    first = [("r", "a.ts", "class Apple {\nx"), ("r", "b.md", "# pie\napple"), ("s", "c.txt", "apple tree"), ("s", "gone.txt", "old words")]
    for scope in ("repo",):
        location = f"{tmp_path}/{scope}"
        assert sg.create_segments(make_files(*first), location, scope) == 1
        assert sg.refresh_segments(spark, location, make_files(("r", "b.md", "# cake"), ("t", "new.txt", "apple new"))) == 2
        removed = spark.createDataFrame([("s", "gone.txt"), ("s", "never.txt")], "repo string, path string")
        assert sg.refresh_segments(spark, location, make_files(("r", "b.md", "# pie again apple"), ("t", "new.txt", "")), removed) == 3
        want = ix.build_index(make_files(*first[:1], ("r", "b.md", "# pie again apple"), first[2], ("t", "new.txt", "")), scope)

        def same(index, want=want):
            for a, b in zip(index.tables(), want.tables(), strict=True):
                assert rows(a, *sorted(a.columns)) == rows(b, *sorted(b.columns))

        same(sg.read_segments(spark, location))
        same(sg.read_segments(spark, location, 1), ix.build_index(make_files(*first), scope))
        # a refresh that stopped before it was published is not seen
        sg._write_segment(make_files(("z", "z.txt", "lost")), location, scope)
        same(sg.read_segments(spark, location))
        assert sg.compact_segments(spark, location) == 4
        same(sg.read_segments(spark, location))
        assert sg.refresh_segments(spark, location, make_files(("r", "b.md", "# pie again apple"))) == 5
        same(sg.read_segments(spark, location))
        with pytest.raises(ValueError):
            sg.read_segments(spark, location, 9)


def test_refresh_keeps_the_scope_of_the_index(spark, make_files, tmp_path):
    files = make_files(("r", "a.ts", "apple"), ("s", "b.md", "pie"))
    changed = make_files(("s", "b.md", "pie apple"))
    fresh = ix.refresh_index(ix.build_index(files, "repo"), changed)
    want = ix.build_index(make_files(("r", "a.ts", "apple"), ("s", "b.md", "pie apple")), "repo")
    for a, b in zip(fresh.tables(), want.tables(), strict=True):
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(b.columns))
    ix.write_index(fresh, f"{tmp_path}/i")
    assert ix.read_index(spark, f"{tmp_path}/i").kind == "repo"


def test_bad_ignore_lines_match_nothing(spark, make_files):
    for line in ("[z-a]x", "[z-a]", "[a\\]", "x[", "[", "[[]", "[a-\\d]*", "[!z-a]q", "[]", "***", "[\\]]"):
        pattern = compile_pattern(line)
        assert pattern is None or re.compile(pattern.body)
    files = make_files(("r", ".gitignore", "[z-a]*\n*.log\n[\n[^\n"), ("r", "a.log", ""), ("r", "z.txt", ""), ("s", "a.log", ""), ("s", ".gitignore", "[a-c].log"))
    assert rows(eligibility(files, rules=repository_rules(files)).filter("path like '%.log' OR path = 'z.txt'")) == [
        ("r", "a.log", "ignored"), ("r", "z.txt", "ok"), ("s", "a.log", "ignored")]


def test_pruned_listing_never_enters_ignored_directories(spark, tmp_path):
    tree = {
        "one": {".gitignore": "*.log\n!keep.log\n/gen/\n[z-a]\n", "src/a.py": "1", "src/x.log": "", "src/keep.log": "", "gen/deep/b.py": "", "sub/gen/c.py": "",
                "node_modules/m/deep/index.js": "", ".git/objects/ab/cd": "", "src/node_modules/n.js": ""},
        "two": {"gen/d.py": "", "x.log": "", "build/e.py": "", ".env": "k"}}
    for repo, files in tree.items():
        for name, text in files.items():
            os.makedirs(os.path.dirname(tmp_path / repo / name), exist_ok=True)
            (tmp_path / repo / name).write_text(text)
    roots = spark.createDataFrame([(repo, str(tmp_path / repo)) for repo in tree] + [("none", str(tmp_path / "none"))], "repo string, root string")
    listed = trees.list_tree(spark, roots, prune=True)
    kept = [("one", ".gitignore"), ("one", "src"), ("one", "src/a.py"), ("one", "src/keep.log"), ("one", "sub"), ("one", "sub/gen"), ("one", "sub/gen/c.py"), ("two", "gen"),
            ("two", "gen/d.py"), ("two", "x.log")]
    assert rows(listed, "repo", "path") == kept
    read = trees.read_trees(spark, roots, prune=True, patterns=["d.*"])
    assert rows(read, "repo", "path") == [k for k in kept if k[1] not in ("src", "sub", "sub/gen", "gen", "gen/d.py")]
    # the same verdicts as on the table of all files
    everything = trees.read_trees(spark, roots)
    judged = eligibility(everything, rules=repository_rules(everything)).filter("reason <> 'ignored'")
    assert rows(judged, "repo", "path") == [k for k in kept if k[1] not in ("src", "sub", "sub/gen", "gen")]
    assert rows(trees.list_tree(spark, roots, 0, prune=True), "path") == [(".gitignore",), ("gen",), ("src",), ("sub",), ("x.log",)]


def test_column_limits_are_cut_before_the_shuffle(spark):
    data = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 3 == 1, 0).when(F.col("id") % 3 == 2, 2500).otherwise(4).alias("n"))
    got = top_per_group(data, ["k"], [F.col("v")], "n", most=2500)
    assert rows(got) == rows(top_per_group(data, ["k"], [F.col("v")], "n"))
    cut = top_per_group(data.withColumn("n", F.lit(4)), ["k"], [F.col("v")], "n", most=4)
    assert "WindowGroupLimit" in cut._jdf.queryExecution().toString()
    nulls = top_per_group(data.withColumn("n", F.lit(None).cast("int")), ["k"], [F.col("v")], "n", most=4)
    assert nulls.count() == 0


def test_whole_results_on_request(spark, make_files):
    keys = ", ".join(f'"d{i}": "1"' for i in range(15))
    files = make_files(("r", "package.json", f'{{"name": "n", "dependencies": {{{keys}}}}}'), ("r", "README.md", "\n".join("abcdefg")))
    assert len(st.manifests(files, None).first().dependencies) == 15 and len(st.manifests(files).first().dependencies) == 10
    assert st.readme_preview(files, None).first().preview == "\n".join("abcdefg")
    code = make_files(("r", "a.ts", "\n".join(f"export function walk{i}(a, b, c) {{ // {'x' * 200}" for i in range(6))))
    asked = spark.createDataFrame([("q", "walk1")], "query_id string, query string")
    hits = rk.search_ranked(ix.build_index(code), asked)
    every = rk.describe(hits, code, spark.createDataFrame([("q", "walk")], "query_id string, query string"), None, None, None).first()
    assert len(every.key_lines) == 6 and len(every.key_lines[0].text) > 200 and every.symbol_preview.count("walk") == 6
    assert rows(rk.search_filtered(ix.build_index(code), [rk.RankQuery("walk1", "q", 5, exts=(e for e in ["ts"]))]), "path") == [("a.ts",)]
