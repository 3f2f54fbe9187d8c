"""Operators on small hand-written file tables."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codequarry.operators import changes as ch
from codequarry.operators import dependencies as dep
from codequarry.operators import ignored as ign
from codequarry.operators import index as ix
from codequarry.operators import inspection as ins
from codequarry.operators import line_search as ls
from codequarry.operators import patches as pt
from codequarry.operators import ranking as rk
from codequarry.operators import slices as sl
from codequarry.operators import stack as st
from codequarry.operators import tree as tr
from codequarry.operators.eligible import READ_MAX_SIZE, SEARCH_MAX_SIZE, eligibility, eligible, repository_rules, with_ignored
from codequarry.operators.shared import broadcast_checked, heavy_hashes, salted_join, top_per_group
from codequarry.sources import tables, trees


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def test_eligibility_reasons(spark, make_files):
    files = make_files(
        ("r", ".gitignore", "*.log\n!keep.log\n"), ("r", "a.log", "x"), ("r", "keep.log", "x"), ("s", "a.log", "x"),
        ("r", "bin.dat", b"a\0"), ("r", "id_rsa", "x"), ("r", "big.txt", "x" * 100), ("r", "a/b/c/d.ts", "x"),
        ("r", "node_modules/m.js", "x"))
    got = dict(((r, p), w) for r, p, w in rows(
        eligibility(files, max_size=50, max_depth=2, rules=repository_rules(files)), "repo", "path", "reason"))
    assert got == {
        ("r", ".gitignore"): "ok", ("r", "a.log"): "ignored", ("r", "keep.log"): "ok", ("s", "a.log"): "ok",
        ("r", "bin.dat"): "binary", ("r", "id_rsa"): "sensitive", ("r", "big.txt"): "size",
        ("r", "a/b/c/d.ts"): "depth", ("r", "node_modules/m.js"): "ignored"}
    kept = eligible(files, max_size=50, max_depth=2, rules=repository_rules(files))
    assert {(r, p) for r, p in rows(kept, "repo", "path")} == {k for k, v in got.items() if v == "ok"}
    assert rows(eligible(files, exts="ts, .LOG", path_pattern="B\\C"), "path") == [("a/b/c/d.ts",)]


def test_size_limit_is_inclusive(spark, make_files):
    files = make_files(("r", "a", "x" * 1572864), ("r", "b", "x" * 1572865))
    assert rows(eligible(files, max_size=SEARCH_MAX_SIZE), "path") == [("a",)]
    assert len(rows(eligible(files), "path")) == 2


def test_line_search(spark, make_files):
    files = make_files(("r", "a.ts", "one\r\nTwo É here\r\n"), ("r", "b.py", "two\n" + "two" + "z" * 300))
    assert rows(ls.search_lines(files, "TWO", max_results=2), "path", "line_no", "line") == [
        ("a.ts", 2, "Two É here"), ("b.py", 1, "two")]
    assert rows(ls.search_lines(files, "é", use_regex=True), "path", "line_no") == [("a.ts", 2)]
    long = ls.search_lines(files, "twozz", exts=["py"]).first()["line"]
    assert len(long) == 203 and long.endswith("...")
    assert ls.search_lines(files, "absent").count() == 0
    for bad, status in [("  ", "empty"), ("(", "invalid_regex")]:
        with pytest.raises(ValueError, match=status):
            ls.search_lines(files, bad, use_regex=True)


def test_search_many_and_table_agree(spark, make_files):
    files = make_files(*[("r", f"f{i}.txt", f"alpha {i}\nbeta\nAlpha beta {i}") for i in range(6)])
    queries = [ls.LineQuery("ALPHA", "a", max_results=None), ls.LineQuery("beta 3", "b"), ls.LineQuery("3", "c"),
               ls.LineQuery(" ", "blank"), ls.LineQuery("(", "bad", use_regex=True)]
    many = ls.search_many(files, queries)
    table = ls.search_literals(files, spark.createDataFrame(
        [(q.query_id, q.query) for q in queries[:4]], "query_id string, query string"))
    assert rows(many, "query_id", "path", "line_no") == rows(table, "query_id", "path", "line_no")
    assert rows(ls.match_counts(many, ["query_id"]), "query_id", "matches") == [("a", 12), ("b", 1), ("c", 2)]
    assert rows(ls.query_statuses(spark, queries), "query_id", "status")[3:] == [("blank", "empty"), ("c", "ok")]
    limited = ls.search_many(files, [ls.LineQuery("alpha", "a", max_results=3)])
    assert rows(limited, "rank", "path", "line_no") == [(1, "f0.txt", 1), (2, "f0.txt", 3), (3, "f1.txt", 1)]


def test_dependents(spark, make_files):
    files = make_files(
        ("r", "src/a.ts", 'import x from "./util.js"\nimport y from "./util"\nimport fs from "fs"'),
        ("r", "src/util.ts", "export const a = 1"), ("r", "util.ts", ""), ("r", "lib/src/util.py", ""),
        ("r", "src/util/index.ts", 'import "../a"'), ("s", "src/util.ts", ""), ("r", "src/util.go", ""))
    edges = dep.imports(files)
    assert rows(edges.filter("path = 'src/a.ts'"), "line_no", "specifier", "resolved", "is_internal") == [
        (1, "./util.js", "src/util.js", True), (2, "./util", "src/util", True), (3, "fs", None, False)]
    pairs = dep.dependents(edges, files)
    assert rows(pairs, "src", "dst", "match_type") == [
        ("src/a.ts", "lib/src/util.py", "suffix"), ("src/a.ts", "src/util.ts", "exact"),
        ("src/a.ts", "util.ts", "suffix"), ("src/util/index.ts", "src/a.ts", "exact")]
    assert dict(rows(dep.impact(pairs, files).filter("repo = 'r'"), "path", "dependents"))["util.ts"] == 1
    assert rows(dep.import_counts(edges), "path", "internal", "external")[0] == ("src/a.ts", 2, 1)


def test_tree(spark, make_files):
    files = make_files(("r", "a-b/x", ""), ("r", "a/b/c", "x" * 1536), ("r", "a/b.ts", ""), ("r", "dist/x", ""))
    got = [tuple(r) for r in tr.tree(files).select("path", "is_dir", "depth", "name", "size_kb").collect()]
    assert got == [("a", True, 0, "a", None), ("a/b", True, 1, "b", None), ("a/b/c", False, 2, "c", 1.5),
                   ("a/b.ts", False, 1, "b.ts", 0.0), ("a-b", True, 0, "a-b", None), ("a-b/x", False, 1, "x", 0.0)]
    assert rows(tr.tree(files, max_depth=0, sub_path="a/"), "path", "depth") == [("a/b", 0), ("a/b.ts", 0)]


def test_slices(spark, make_files):
    files = make_files(("r", "a.txt", "1\n2\n3\r\n"), ("r", "b.bin", b"\0"), ("r", ".env", "x"), ("r", "big", "x" * 2097153))
    asked = spark.createDataFrame([
        ("all", "a.txt", None, None), ("part", "./a.txt", 2, 99), ("zero", "a.txt", 0, 1), ("past", "a.txt", 9, None),
        ("neg", "a.txt", -1, None), ("bin", "b.bin", 1, 1), ("env", ".env", 1, 1), ("big", "big", 1, 1),
        ("gone", "c", 1, 1), ("up", "../a.txt", 1, 1), ("empty", "a.txt", 3, 2)],
        "slice_id string, path string, start_line int, end_line int").withColumn("repo", F.lit("r"))
    got = {}
    for i, status, n, text in rows(sl.slice_lines(files, asked, max_size=READ_MAX_SIZE), "slice_id", "status", "line_no", "text"):
        got.setdefault((i, status), []).append((n, text))
    assert got[("all", "ok")] == [(1, "1"), (2, "2"), (3, "3"), (4, "")]
    assert got[("part", "ok")] == [(2, "2"), (3, "3"), (4, "")]
    assert got[("zero", "ok")] == [(1, "1")] and got[("empty", "ok")] == [(None, None)]
    assert {s for _, s in got} == {"ok", "start_past_end", "bad_range", "binary", "sensitive", "too_large", "missing", "denied"}


PATCHES = "patch_id string, seq int, repo string, path string, target string, replacement string, allow_multiple boolean"


def test_patches(spark, make_files):
    files = make_files(("r", "a.txt", "x\r\nold\r\nx"), ("r", "b.txt", "aaaa"), ("r", ".env", "x"), ("r", "c.bin", b"x\0"))
    run = pt.apply_patches(files, spark.createDataFrame([
        ("p1", 1, "r", "a.txt", "x\nold", "$& new\r\nold", False), ("p2", 2, "r", "a.txt", "new", "newer", False),
        ("p3", 3, "r", "a.txt", "x", "y", False), ("p4", 1, "r", "b.txt", "aa", "b", True),
        ("p5", 2, "r", "b.txt", "", "b", True), ("p6", 1, "r", ".env", "x", "y", False),
        ("p7", 1, "r", "c.bin", "x", "y", False), ("p8", 1, "r", "nope", "x", "y", False),
        ("p9", 1, "r", "../a.txt", "x", "y", False), ("q1", 4, "r", "a.txt", "zzz", "y", False)], PATCHES))
    assert dict(rows(run.results, "patch_id", "status")) == {
        "p1": "applied", "p2": "applied", "p3": "applied", "p4": "applied", "p5": "empty_target", "p6": "sensitive",
        "p7": "binary", "p8": "missing", "p9": "denied", "q1": "not_found"}
    new = dict(rows(pt.snapshot(files, run.changed), "path", "text"))
    assert new["a.txt"] == "$& newer\r\nold\r\ny" and new["b.txt"] == "bb" and new[".env"] == "x"


def test_patch_passes_agree(spark, make_files):
    files = make_files(("r", "a.txt", "0"), ("r", "b.txt", "0"))
    steps = [(f"{p}{i}", i, "r", f"{p}.txt", str(i), str(i + 1), False) for p in "ab" for i in range(7 if p == "a" else 2)]
    patches = spark.createDataFrame(steps, PATCHES)
    one, many = pt.apply_patches(files, patches), pt.apply_patches(files, patches, per_pass=2)
    assert rows(one.results, "patch_id", "status", "occurrences") == rows(many.results, "patch_id", "status", "occurrences")
    assert rows(one.changed, "path", "text") == rows(many.changed, "path", "text") == [("a.txt", "7"), ("b.txt", "2")]


def test_changes(spark, make_files):
    base = make_files(("r", "same", "1"), ("r", "mod", "1"), ("r", "del", "1"), ("r", "unstaged", "1"), ("r", "both", "1"))
    staged = make_files(("r", "same", "1"), ("r", "mod", "2"), ("r", "add", "1"), ("r", "unstaged", "1"), ("r", "both", "2"))
    working = make_files(("r", "same", "1"), ("r", "mod", "2"), ("r", "add", "1"), ("r", "both", "3\n4\n"), ("r", "new", "n"))
    got = ch.classify_changes(base, staged, working)
    assert rows(got, "path", "bucket", "status") == [
        ("add", "staged", "A"), ("both", "modified", "M"), ("both", "staged", "M"), ("del", "staged", "D"),
        ("mod", "staged", "M"), ("new", "untracked", "?"), ("unstaged", "modified", "D")]
    assert rows(ch.diff_stat(base, working, staged), "path", "added", "removed") == [
        ("add", 1, 0), ("both", 2, 1), ("del", 0, 1), ("mod", 1, 1), ("unstaged", 0, 1)]
    assert ch.diff_stat(base, base).count() == 0
    many = make_files(*[("r", f"n{i:02}", "") for i in range(12)])
    preview = ch.untracked_preview(ch.classify_changes(base, base, base.unionByName(many)))
    assert preview.count() == 10 and preview.first()["more"] == 2


def test_stack_and_manifests(spark, make_files):
    deps = ",".join(f'"d{i}":"1"' for i in range(11))
    files = make_files(
        ("a", "package.json", '{"name":"x","dependencies":{%s},"scripts":{"b":"1","a":"2"}}' % deps),
        ("b", "package.json", "{bad"), ("c", "package.json", '{"name":""}'), ("a", "sub/go.mod", ""),
        ("a", "Dockerfile", ""), ("d", "pyproject.toml", ""), ("d", "README.md", "1\n2\n3\n4\n5\n6"))
    assert rows(st.tech_stack(files), "repo", "technology") == [
        ("a", "Docker"), ("a", "Node.js"), ("b", "Node.js"), ("c", "Node.js"), ("d", "Python")]
    got = {r.repo: r for r in st.manifests(files).collect()}
    assert got["a"].dependencies == [f"d{i}" for i in range(10)] and got["a"].n_dependencies == 11
    assert got["a"].more_dependencies and got["a"].scripts == ["b", "a"] and got["a"].version == "0.0.0"
    assert got["b"].status == "corrupt" and got["c"].name == "unnamed" and got["c"].n_dependencies == 0
    assert st.readme_preview(files).first()["preview"] == "1\n2\n3\n4\n5"


def bm25(tf, df, n, fl, avg):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * fl / avg)))


def test_hand_computed_score(spark, make_files):
    files = make_files(("r", "a.ts", "class Apple {\napple pie"), ("r", "b.txt", "apples"), ("r", "c.txt", "pie"))
    asked = spark.createDataFrame([("q", "apple apple")], "query_id string, query string")
    got = {r.path: r.score for r in rk.score_documents(ix.build_index(files), asked).collect()}
    # symbols: "class Apple" has 2 raw tokens, the empty texts 1 each; content: class Apple apple pie
    content = {"a.ts": 4, "b.txt": 1, "c.txt": 1}
    avg = sum(content.values()) / 3
    a = 2 * (3.0 * bm25(1, 1, 3, 2, 4 / 3) + bm25(2, 1, 3, content["a.ts"], avg))
    b = 2 * 0.7 * 6 / (6 + 0.3) * bm25(1, 1, 3, 1, avg)
    assert got.keys() == {"a.ts", "b.txt"}
    assert got["a.ts"] == pytest.approx(a, abs=1e-6) and got["b.txt"] == pytest.approx(b, abs=1e-6)


def test_ranked_search_and_refresh(spark, make_files, tmp_path):
    files = make_files(
        ("r", "tree.ts", "export function getTree(a) {\n  return walk(a);\n}"), ("r", "use.ts", "getTree(1)\n\ngettree"),
        ("r", "x.md", "# other"), ("s", "y.md", "tree"))
    asked = spark.createDataFrame([("q1", "getTree", 5), ("q2", "  ", 5), ("q3", "tree", 1)],
                                  "query_id string, query string, max_results int")
    index = ix.build_index(files)
    top = rk.search_ranked(index, asked)
    got = rows(top, "query_id", "rank", "path", "pct")
    assert got[0] == ("q1", 1, "tree.ts", 100) and [g[0] for g in got] == ["q1", "q1", "q3"]
    shown = {(r.query_id, r.path): r for r in rk.describe(top, files, asked).collect()}
    assert [tuple(k) for k in shown["q1", "use.ts"].key_lines] == [(1, "getTree(1)"), (3, "gettree")]
    assert shown["q1", "tree.ts"].symbol_preview == "export function getTree(a)"
    narrowed = rk.search_filtered(index, [rk.RankQuery("tree", "f", 5, exts="md"), rk.RankQuery("tree", "g", 5)])
    assert rows(narrowed.filter("query_id = 'f'"), "path") == [("y.md",)]

    changed = make_files(("r", "x.md", "# tree again"))
    removed = spark.createDataFrame([("s", "y.md")], "repo string, path string")
    fresh = ix.refresh_index(index, changed, removed)
    rebuilt = ix.build_index(files.filter("path NOT IN ('x.md', 'y.md')").unionByName(changed))
    for a, b in zip(fresh.tables(), rebuilt.tables()):
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns))
    ix.write_index(rebuilt, f"{tmp_path}/index")
    stored = ix.read_index(spark, f"{tmp_path}/index")
    assert rows(rk.search_ranked(stored, asked), "query_id", "path", "score") == rows(
        rk.search_ranked(rebuilt, asked), "query_id", "path", "score")


def test_reading_trees(spark, tmp_path):
    for name, data in {".gitignore": b"*.log", "pkg/__init__.py": b"import os", "a/b/c.txt": b"\xffx", "bin": b"\0"}.items():
        path = tmp_path / "repo" / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(data)
    files = trees.read_trees(spark, {"r": str(tmp_path / "repo")})
    assert rows(files, "path", "size", "is_binary", "text") == [
        (".gitignore", 5, False, "*.log"), ("a/b/c.txt", 2, False, "�x"), ("bin", 1, True, "\0"),
        ("pkg/__init__.py", 9, False, "import os")]
    assert rows(trees.read_visible(spark, str(tmp_path / "repo"), "r"), "path") == [("a/b/c.txt",), ("bin",)]
    tables.write_files(files, f"{tmp_path}/packed")
    assert rows(tables.read_files(spark, f"{tmp_path}/packed"), "path", "text") == rows(files, "path", "text")


def test_shared_helpers(spark):
    data = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    names = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for bound in (0, 10**6):
        joined = salted_join(data, names, ["k"], 5, "v", max_rows=bound)
        assert rows(joined, "k", "v", "w") == rows(data.join(names, "k"), "k", "v", "w")
    assert heavy_hashes(data, ["k"]) == [spark.range(1).select(F.xxhash64(F.lit(0).cast("long"))).first()[0]]
    assert heavy_hashes(data.filter("k > 0"), ["k"]) == [] == heavy_hashes(data.filter("false"), ["k"])
    limits = data.withColumn("n", F.lit(4))
    first = top_per_group(limits, ["k"], [F.col("v")], "n")
    assert rows(first, "k", "v", "rank") == rows(top_per_group(data, ["k"], [F.col("v")], 4), "k", "v", "rank")


def test_scan_reads_only_needed_columns(spark, make_files, tmp_path):
    tables.write_files(make_files(("r", "a/b.ts", "x")), f"{tmp_path}/files")
    files = tables.read_files(spark, f"{tmp_path}/files")
    plan = st.tech_stack(files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<repo:string,path:string>" in plan and "PushedFilters: [In(path" in plan
    plan = tr.tree(files)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1]


def test_reads_and_patches_honour_repository_rules(spark, make_files):
    files = make_files(("r", ".gitignore", "*.log\n"), ("r", "a.log", "secret\n"), ("r", "b.txt", "open\n"), ("s", "a.log", "kept\n"))
    rules = repository_rules(files)
    asked = spark.createDataFrame([("1", "r", "a.log", 1, 1), ("2", "r", "b.txt", 1, 1), ("3", "s", "a.log", 1, 1)],
                                  "slice_id string, repo string, path string, start_line int, end_line int")
    got = {r.slice_id: (r.status, r.text) for r in sl.slice_lines(files, asked, rules=rules).collect()}
    assert got == {"1": ("ignored", None), "2": ("ok", "open"), "3": ("ok", "kept")}
    patches = asked.selectExpr("slice_id AS patch_id", "1 AS seq", "repo", "path", "'e' AS target", "'E' AS replacement", "true AS allow_multiple")
    assert {r.patch_id: r.status for r in pt.apply_patches(files, patches, rules=rules).results.collect()} == {
        "1": "ignored", "2": "applied", "3": "applied"}
    assert {r.slice_id: r.status for r in sl.slice_status(files, asked, max_size=5).collect()}["1"] == "too_large"


def test_patches_do_not_depend_on_passes(spark, make_files):
    files = make_files(("r", "a.txt", "one\r\ntwo\rX\n"), ("r", "b.txt", "plain\n"), ("r", "c.txt", "a\rX\nb\n"))
    edits = [("1", 1, "a.txt", "one", "uno"), ("2", 2, "a.txt", "uno", "1\n1"), ("3", 1, "b.txt", "plain", "pl\0ain"), ("4", 2, "b.txt", "ain", "x"),
             ("5", 1, "c.txt", "X", ""), ("6", 2, "c.txt", "b", "c")]
    patches = spark.createDataFrame([(i, n, "r", p, t, new, False) for i, n, p, t, new in edits],
                                    "patch_id string, seq int, repo string, path string, target string, replacement string, allow_multiple boolean")
    runs = [pt.apply_patches(files, patches, per_pass=n) for n in (256, 2, 1)]
    statuses = [{r.patch_id: r.status for r in run.results.collect()} for run in runs]
    assert statuses[0] == {"1": "applied", "2": "applied", "3": "applied", "4": "binary", "5": "applied", "6": "applied"}
    texts = [{r.path: r.text for r in run.changed.collect()} for run in runs]
    assert statuses[0] == statuses[1] == statuses[2] and texts[0] == texts[1] == texts[2]
    assert texts[0]["c.txt"] == "a\r\nc\r\n"


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    wide = spark.range(20).select("id", F.array_repeat(F.repeat(F.lit("x"), 500), 10).alias("words"))

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(broadcast_checked(wide))
    assert not hinted(broadcast_checked(wide, max_rows=19))
    assert not hinted(broadcast_checked(wide, max_bytes=90_000))
    assert hinted(broadcast_checked(wide.limit(0), max_bytes=0))


def test_imports_keep_first_lines_without_a_shuffle(spark, make_files):
    text = 'import "./b"\nimport x from "./b"\nimport "fs"\nimport y from "./b"\nimport "./a"\nimport "fs"'
    edges = dep.imports(make_files(("r", "a.ts", text), ("r", "none.ts", ""), ("r", "b.md", 'import "./a"')))
    assert rows(edges, "path", "line_no", "specifier") == [("a.ts", 1, "./b"), ("a.ts", 3, "fs"), ("a.ts", 5, "./a")]
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()
    assert dep.dependents(edges, make_files(("r", "a.ts", ""))).count() == 0  # a file that imports itself


def test_blank_ranked_queries_are_reported(spark):
    asked = spark.createDataFrame([("a", " x "), ("b", " \t\n"), ("c", ""), ("d", None)], "query_id string, query string")
    assert rows(rk.query_statuses(asked), "query_id", "status") == [("a", "ok"), ("b", "empty"), ("c", "empty"), ("d", "empty")]
    assert rk.query_statuses(asked.limit(0)).count() == 0


def test_ranked_search_takes_null_limits_and_no_queries(spark, make_files):
    index = ix.build_index(make_files(("r", "a.txt", "alpha beta\n")))
    asked = spark.createDataFrame([("q", "alpha", None)], "query_id string, query string, max_results int")
    assert rk.search_ranked(index, asked).count() == 1
    assert rk.search_filtered(index, []).count() == 0


def test_requests_for_outlines_and_dependencies(spark, make_files):
    files = make_files(
        ("r", "src/a.ts", 'import { b } from "./b";\r\nimport fs from "fs";\r\nimport { own } from "./a";\r\nexport function walk(a) {\r\n'),
        ("r", "src/b.ts", "class B {"), ("r", "lib/deep/src/b.ts", ""), ("r", "src/bin.ts", b"a\0"), ("s", "use.py", "from .src.b import x\n"))
    paths = ["src/a.ts", "./src//a.ts", "src\\b.ts", "src", "lib/deep/", "gone.ts", "../up.ts", "/abs.ts", "id_rsa", "dist/x.ts", "src/bin.ts"]
    asked = spark.createDataFrame([(str(i), "r", p) for i, p in enumerate(paths)], "request_id string, repo string, path string")
    want = ["ok", "ok", "ok", "directory", "directory", "missing", "denied", "denied", "sensitive", "ignored", "binary"]
    found = {r.request_id: r for r in ins.outline_requests(files, asked).collect()}
    assert [found[str(i)].status for i in range(len(paths))] == want
    assert found["0"].line_count == 5 and [s.line_no for s in found["1"].symbols] == [4] and found["5"].symbols is None
    deps = {r.request_id: (r.status, r.internal, r.external, r.dependents) for r in ins.dependency_requests(files, asked).collect()}
    # a file that imports itself is no dependent of its own; src/b is met as a whole path
    assert deps["0"] == deps["1"] == ("ok", 2, 1, 0) and deps["2"] == ("ok", 0, 0, 1) and deps["3"] == ("directory", None, None, None)
    assert rows(dep.dependents(dep.imports(files), files), "src", "dst", "match_type") == [("src/a.ts", "lib/deep/src/b.ts", "suffix"), ("src/a.ts", "src/b.ts", "exact")]


def test_skewed_join_copies_only_heavy_keys(spark):
    data = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    names = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = salted_join(data, names, ["k"], 6, "v", max_rows=0)
    assert rows(joined, "k", "v", "w") == rows(data.join(names, "k"), "k", "v", "w")
    tasks = joined.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct()
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert tasks.count() > 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_line_balances_are_multisets(spark, make_files):
    cases = {"a": ("x\ny\nx\n", "x\nx\nx\nz"), "b": ("", "\n"), "c": ("one", ""), "d": ("p\nq\nr", "r\nq\np\n"), "e": ("t\n" * 300, "t\n" * 299 + "u\n\n")}
    base = make_files(*[("r", n, old) for n, (old, _) in cases.items()], ("r", "gone", "1\n2"))
    work = make_files(*[("r", n, new) for n, (_, new) in cases.items()], ("r", "new", "1\n\n2\n"), ("r", "blank", ""))

    def lines(text):
        return Counter(text.removesuffix("\n").split("\n")) if text else Counter()

    want = [(n, (lines(new) - lines(old)).total(), (lines(old) - lines(new)).total())
            for n, (old, new) in {**cases, "gone": ("1\n2", ""), "new": ("", "1\n\n2\n"), "blank": ("", "")}.items()]
    stat = ch.diff_stat(base, work)
    assert rows(stat, "path", "added", "removed") == sorted(want)
    plan = stat._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "line" in x]


def test_inherited_verdicts_agree_with_walking_each_path(spark, make_files):
    names = ["a.log", "keep.log", "src/a.log", "src/deep/er/keep.log", "dist/x/y.txt", "src/dist/z/q.txt", "tmp/a/b/c", "src/tmp/a", "x.py", "node_modules/p/i.js",
             "out/keep/a.txt", "out/b.txt", "docs/a[1].md", "Build/a"]
    ignore = {"r": "*.log\n!keep.log\n/tmp/\n[z-a]*\n", "s": "!dist\nout/\n!out/keep/\nsrc/**/er\n", "t": "", "u": "*\n!*/\n!*.md\n"}
    files = make_files(*[(r, p, "x") for r in [*ignore, "v"] for p in names], *[(r, ".gitignore", text) for r, text in ignore.items()])
    for rules in (None, repository_rules(files)):
        for patterns in ((), ("docs", "!docs/*.md", "*.py")):
            want = rows(with_ignored(files, patterns, rules).filter("ignored"), "repo", "path")
            assert rows(ign.ignored_paths(files, patterns, rules), "repo", "path") == want
            assert ign.visible(files, patterns, rules).count() == files.count() - len(want)
    assert ign.ignored_paths(files.filter("false")).count() == 0
    verdicts = ign.own_verdicts(files.select("repo", F.col("path").alias("entry")), (), repository_rules(files))
    assert "Sort [repo" in verdicts._jdf.queryExecution().executedPlan().toString()  # one compilation for each rule and task


def test_ignore_report_names_bad_lines(spark, make_files):
    text = "# c\n\n*.log  \r\n!keep\n[z-a]x\n[ab\nend\\\nend\\\\\n!\n/\n[a-z][9-0]\nopen\\[x\n\\#n"
    got = rows(ign.ignore_report(make_files(("r", ".gitignore", text), ("r", "sub/.gitignore", "x"))), "line_no", "line", "kind", "problem")
    assert got == sorted([
        (1, "# c", "comment", None), (2, "", "blank", None), (3, "*.log", "pattern", None), (4, "!keep", "negated", None),
        (5, "[z-a]x", "pattern", "backward range"), (6, "[ab", "pattern", "unclosed class"), (7, "end\\", "pattern", "dangling escape"),
        (8, "end\\\\", "pattern", None), (9, "!", "void", None), (10, "/", "void", None), (11, "[a-z][9-0]", "pattern", "backward range"),
        (12, "open\\[x", "pattern", None), (13, "\\#n", "pattern", None)], key=repr)
