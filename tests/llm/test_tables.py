"""Top-k search, page text, URL lists, tries and the pipeline."""

import numpy as np
import pytest

from codequarry.llm import catalog, elias_fano, pages, topk, url_lists
from codequarry.llm.components import components
from codequarry.llm.oracles import ORACLES
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_match_their_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 6) / 7]) for i in range(150)]
    rows += [(150, None), (151, [1.0, None]), (152, [float("nan")] * 6), (153, [float("inf")] * 6), (154, []), (155, [0.5, 0.5]), (156, [1e30] + [0.0] * 5), (157, [-1e30] + [0.0] * 5), (100, rows[100][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.quantised(table)
    got = topk.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5, shard=40, block=2).collect()
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i < 150}
    for own in (0, 50, 100):
        best = sorted(((-int(q[own] @ v), i) for i, v in q.items() if i != own))[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == own) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {r.query_id for r in got} == {0, 50, 100}
    none = vectors.filter("false")
    assert topk.top_inner_products(none, none).count() == 0


def test_components_are_the_smallest_nodes(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (70, 60), (80, 80), (60, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_elias_fano_lists_and_levels():
    draw = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (900, 3), (900, 10**9), (5000, 2**40)):
        values = np.sort(draw.integers(0, top, n)).astype(np.uint64)
        held = elias_fano.Monotone(elias_fano.Monotone.encode(values))
        ask = np.concatenate((values, draw.integers(0, top + 5, 500).astype(np.uint64)))
        at, same = held.successor(ask)
        assert (at == np.searchsorted(values, ask)).all() and (same == np.isin(ask, values)).all() and (held.get(np.arange(n)) == values).all()
    pairs = np.unique(draw.integers(0, 200, (3000, 2)), axis=0).astype(np.uint64)
    level = elias_fano.mapped(elias_fano.Level.encode(pairs[:, 0], pairs[:, 1], -draw.random(len(pairs)), np.ones(len(pairs))))
    assert (level.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (level.find(pairs[:, 0], pairs[:, 1] + np.uint64(1000)) == -1).all()
    assert (level.successors_of(7)[0] == pairs[pairs[:, 0] == 7, 1]).all()


PAGE = """<html><head><title>No</title></head><body class="has-sidebar"><header>Site name</header><nav><a href="/">Home</a></nav>
<div id="cookie-notice">We use cookies</div><h2>Title &amp; more</h2><p>A first   paragraph of some length,&nbsp;with <b>bold</b><br>words.
<p class="ad">Buy this<p>Short.<script>var a = "<p>not text</p>";</script><section class="comments"><p>Nice article, says a reader</p></section>
<form>Name <input name=q></form><p>Last paragraph of the text, long enough to count.</p><footer>Imprint"""


def test_main_text_of_odd_pages(spark):
    want = "Title & more\nA first paragraph of some length, with bold words.\nShort.\nLast paragraph of the text, long enough to count."
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<nav>menu</nav>"), (5, "x", "only plain text"), (6, "y", "a < b &lt; c <p"),
            (7, "z", "<main><h1>T</h1><p>x</p></main><p>outside " + "long text " * 30), (8, "l", "<p>" + "word " * 50_000)]
    rows += [(9, "m", '<body><article class="post with-sidebar"><p>one</p><article class="comment"><p>no</p></article></article>'),
             (10, "n", '<div class="content no-sidebar"><p>' + "two " * 20 + '</p></div><div class="sidebar-left"><p>' + "no " * 30 + "</p></div>")]
    got = {r.page_id: r for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[i].text for i in (2, None, 4)] == ["", "", ""] and got[5].text == "only plain text" and got[7].text == "T\nx"
    assert got[9].text == "one" and got[10].text == ("two " * 20).strip()
    assert got[6].text == "a < b < c" and got[8].n_chars == 249_999


def test_url_lists_as_of_fetch_time(spark):
    entries = spark.createDataFrame([
        ("a", "block", "domain", "bad.example", "add", 10), ("a", "block", "domain", "bad.example", "remove", 20), ("a", "block", "domain", "bad.example", "add", 30),
        ("a", "block", "domain", "bad.example", "add", 10), ("b", "allow", "prefix", "x.bad.example/ok/", "add", 12), ("c", "block", "host", "same.example", "add", 5),
        ("c", "block", "host", "same.example", "remove", 5), ("d", "block", "host", None, "add", 1), ("d", "block", "host", "late.example", "add", None),
    ], "list string, verdict string, kind string, pattern string, action string, at long")
    asked = [(1, "http://x.bad.example/a", 9), (2, "http://X.bad.example/a", 10), (3, "http://bad.example", 19), (4, "http://bad.example", 20), (5, "http://bad.example", 99),
             (6, "http://x.bad.example/ok/p?q=/", 15), (7, "http://x.bad.example/okay", 15), (8, "http://same.example/", 6), (9, None, 5), (10, "nonsense", 5),
             (11, "http://bad.example", None), (12, "http://notbad.example/", 15), (2, "http://X.bad.example/a", 10)]
    rows = url_lists.evaluate(spark.createDataFrame(asked, "page_id long, url string, fetched_at long"), entries).collect()
    assert len(rows) == len(asked)
    assert {r.page_id: r.status for r in rows} == {1: "none", 2: "block", 3: "block", 4: "none", 5: "block", 6: "allow", 7: "block", 8: "none",
                                                   9: "none", 10: "none", 11: "none", 12: "none"}
    assert url_lists.evaluate(spark.createDataFrame([], "page_id long, url string, fetched_at long"), entries.filter("false")).count() == 0


def test_url_list_entries_end_each_other_whatever_their_verdict(spark):
    entries = spark.createDataFrame([
        ("a", "block", "host", "turn.example", "add", 10), ("a", "allow", "host", "Turn.example", "add", 20), ("a", "allow", "host", "turn.example", "remove", 30),
        ("b", "allow", "host", "both.example", "add", 10), ("b", "block", "host", "both.example", "add", 10), ("c", None, "host", "void.example", "add", 1),
        ("d", "maybe", "host", "void.example", "add", 1), ("b", "allow", "domain", "two.example", "add", 5), ("c", "block", "domain", "two.example", "add", 7),
    ], "list string, verdict string, kind string, pattern string, action string, at long")
    want = {("turn", 9): ("none", 0), ("turn", 10): ("block", 1), ("turn", 19): ("block", 1), ("turn", 20): ("allow", 1), ("turn", 30): ("none", 0),
            ("both", 10): ("block", 1), ("void", 50): ("none", 0), ("two", 6): ("allow", 1), ("two", 7): ("block", 2)}
    # a hot address: one URL and time holds most rows, over shuffled partitions, with other columns beside
    asked = [(i, f"http://{name}.example/", at, "x", "y") for i, (name, at) in enumerate([*want, *[("turn", 19)] * 300])]
    captures = spark.createDataFrame(asked, "page_id long, url string, fetched_at long, status string, _salt string").repartition(7)
    got = url_lists.evaluate(captures, entries).collect()
    assert sorted(r.page_id for r in got) == list(range(len(asked)))
    assert all((r.status, r.n_active) == want[r.host.split(".")[0], r.fetched_at] for r in got)


def test_pipeline_stages_do_what_they_say(spark):
    import corpus_pipeline as cp
    from codequarry.llm import compression, minhash, suffixes
    from codequarry.llm.tables import read

    docs = read(spark, SF, "documents")
    good = {r.doc_id for r in compression.scored(docs, compression.train(docs, read(spark, SF, "labels"))).filter("score >= 0.7").collect()}
    first = cp.quality_stage(spark, docs, SF).persist()
    assert {r.doc_id for r in first.collect()} == good
    second = cp.dedup_stage(spark, first, SF).persist()
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in minhash.near_duplicates(first, 80).filter("kept").collect()}
    third = cp.decontamination_stage(spark, second, SF).persist()
    clean = suffixes.digest(suffixes.verbatim_matches(second, read(spark, SF, "benchmark"))).filter("not contaminated")
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in clean.collect()}
    fourth = cp.pii_stage(spark, third, SF)
    assert fourth.count() == third.count() and fourth.columns == list(cp.COLUMNS)
    last = {r.doc_id for r in cp.mixing_stage(spark, fourth, SF).collect()}
    assert last and last <= {r.doc_id for r in third.collect()}
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == last


def test_pipeline_takes_odd_rows(spark, make_docs):
    import corpus_pipeline as cp

    rows = [(None, "no id"), (1, None), (2, ""), (3, "a text of six words here"), (3, "a text of six words here"), (4, "a text of six words here")]
    for _, stage in cp.STAGES:
        assert stage(spark, make_docs(), SF).count() == 0
        assert set(stage(spark, make_docs(*rows), SF).columns) == set(cp.COLUMNS)
    kept = [r.doc_id for r in cp.dedup_stage(spark, make_docs(*rows), SF).collect()]
    assert sorted(map(str, kept)) == ["1", "2", "3", "None"]
