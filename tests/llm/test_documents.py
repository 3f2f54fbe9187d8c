"""Near-duplicates, decontamination, scores and pseudonyms against brute force and on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from math import log10

import pytest
import zstandard

from codequarry.llm import compression, language_model, mixing, minhash, pseudonyms, suffixes, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BASE = [f"w{i}" for i in range(120)]
ODD = [(None, "some words without an id at all"), (900, None), (901, ""), (902, " \n\t "), (903, "two words"), (904, "two words"),
       (905, "Two WORDS"), (906, "long " * 30_000)]


def near_rows():
    rows = [(i, " ".join(BASE[:100] + [f"own{i}x{j}" for j in range(i % 14)])) for i in range(1, 90)]
    rows += [(200 + i, " ".join([f"z{i}q{j}" for j in range(30)])) for i in range(5)] + [(300 + i, "the same text of seven words here") for i in range(40)]
    return rows + ODD


def brute_components(rows, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        own = {tuple(words[j:j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        if i is not None:
            sets.setdefault(i, []).append(own)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(make_docs, percent):
    rows = near_rows()
    got = minhash.near_duplicates(make_docs(*rows), percent).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    lost, = [r for r in got if r.doc_id is None]
    assert lost.component_id is None and lost.kept
    assert {r.doc_id: r.n_shingles for r in got}[901] == 0


def test_long_lists_are_met_exactly(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT_LIST", 1)
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_rows()
    got = minhash.near_duplicates(make_docs(*rows), 85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_components(rows, 85)


def test_near_duplicates_of_nothing_and_of_repeated_rows(make_docs):
    assert minhash.near_duplicates(make_docs()).count() == 0
    text = "a text of more than five words stands here"
    got = minhash.near_duplicates(make_docs((3, text), (5, text), (5, "other words stand in this second text"), (7, "other words stand in this second text"), (9, text[::-1]))).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]
    got = minhash.near_duplicates(make_docs((5, text), (5, text), (5, "other words stand in this second text"), (7, "other words stand in this second text"))).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {5}


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    words, hit, names = cut(text), set(), set()
    for name, item in items:
        test = cut(item)
        size = min(10, len(test))
        for j in range(len(test) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == test[j:j + size]:
                    hit.update(range(i, i + size))
                    names |= {str(name)} - {"None"}
    return len(words), len(hit), sorted(names)


ITEMS = [(1, " ".join(f"q{i}" for i in range(25))), (10, "One two, three!"), (2, "single"), (3, None), (4, ""), (5, "--- ..."),
         (6, " ".join(f"q{i}" for i in range(5, 18))), (None, "nobody names this item of words"), (1, " ".join(f"q{i}" for i in range(25)))]


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_decontamination_equals_brute_force(spark, make_docs, block_words):
    q = [f"Q{i}" for i in range(25)]
    rows = [*ODD, (1, "x " + " ".join(q)), (2, " ".join(q[3:14]) + " y " + " ".join(q[10:21])), (3, " ".join(q[:9])), (4, "one TWO three single"),
            (5, "nobody names this item of words"), (1, "a second text, single"), (6, "single " * 50), (6, "single " * 50)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = suffixes.verbatim_matches(make_docs(*rows), bench, block_words=block_words)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in suffixes.digest(found).collect())
    want = Counter()
    for i, text in rows:
        n, hit, names = brute_hits(text, ITEMS)
        want[i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0] += 1
    assert got == want
    whole, = [r for r in found.collect() if r.doc_id == 1 and r.n_words == 26]
    assert ("1", 0, 1, 25) in {tuple(m) for m in whole.matches}
    kept = suffixes.decontaminated(make_docs(*rows), bench, block_words=block_words)
    assert kept.columns == make_docs().columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if not brute_hits(t, ITEMS)[1])


def test_decontamination_of_nothing(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.verbatim_matches(make_docs(), none).count() == 0
    assert [r.n_hit for r in suffixes.verbatim_matches(make_docs((1, "words")), none).collect()] == [0]


def test_language_scores_equal_brute_force(make_docs):
    rows = [*ODD, *((i, f"the cat {i % 3} sat on the mat number {i % 5}") for i in range(60))]
    got = {(r.doc_id, r.n_tokens): r for r in language_model.language_scores(make_docs(*rows), prior=5.0, shard_tokens=40_000).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    ones = Counter(x for i, ws in words if not held(i) for x in ws)
    twos = Counter(p for i, ws in words if not held(i) for p in zip(["<"] + ws, ws))
    n, v, texts = sum(ones.values()), len(ones), sum(not held(i) for i, _ in words)
    for i, ws in words:
        base = [(ones[x] + 0.5) / (n + 0.5 * (v + 1)) for x in ws]
        model = sum(log10((twos[h, x] + 5 * p) / ((texts if h == "<" else ones[h]) + 5)) for h, x, p in zip(["<"] + ws, ws, base))
        r = got[i, len(ws)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(ones[x] > 0 for x in ws), n)
        assert r.base_score == pytest.approx(sum(map(log10, base)))
        assert r.score == pytest.approx(model, abs=2e-4 * len(ws))
    assert language_model.language_scores(make_docs()).count() == 0


def judged(make_docs, make_labels):
    good = [(i, f"A calm and plain sentence about the weather of day {i}, and then another one.") for i in range(0, 120, 2)]
    bad = [(i, f"BUY!! NOW!! CHEAP!! $$$ %%% you st0pid іdiot number {i} $$$ %%%") for i in range(1, 120, 2)]
    labels = make_labels(*((i, 1, 0) for i, _ in good), *((i, 0, 1) for i, _ in bad), (None, 1, 1), (5000, None, None), (906, 1, 0))
    return make_docs(*good, *bad, *ODD), labels


def test_quality_and_toxicity_separate_unseen_rows(make_docs, make_labels):
    docs, labels = judged(make_docs, make_labels)
    for found, good_is in ((compression.quality(docs, labels), 1), (toxicity.toxicity(docs, labels), 0)):
        rows = found.collect()
        assert len(rows) == 128 and all(0 <= r.score <= 1 for r in rows)
        unseen = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 200]
        right = sum(r.predicted == (good_is if r.doc_id % 2 == 0 else 1 - good_is) for r in unseen)
        assert right >= 0.9 * len(unseen)
        assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    assert toxicity.scored(make_docs((1, "words")), toxicity.learn(toxicity.Sample({0: [], 1: []}, {0: 0, 1: 0}))).first().score == pytest.approx(0.5)
    assert compression.quality(make_docs((1, "words"), (2, None)), make_labels()).count() == 2


def test_toxicity_matches_equal_brute_force(make_docs):
    model = toxicity.Model({" bad ": 2.0, " ba": 1.5, " idi": 3.0, " idiot ": 2.5, " fool ": 1.0, " can ": 0.7},
                           ("trash can", "bad idea"), toxicity.np.array([0.5, 0.25, 1.0, -2.0]))
    words = ["bad", "b4d", "BАD", "idiot", "idiotic", "1d1ot!", "fool", "can", "trash", "idea", "bank", "calm", "fo\u200bol", "10", "a-bad", "\u00e9t\u00e9"]
    rows = [*ODD, *((i, " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 23))) for i in range(1, 200))]
    got = Counter((r.doc_id, round(r.weight, 9), r.n_matches, round(r.score, 9)) for r in toxicity.scored(make_docs(*rows), model).collect())
    want = Counter()
    for i, text in rows:
        flat = toxicity.fold(text or "").split()
        spared = {j + d for phrase in model.exceptions for j in range(len(flat) - 1) if flat[j:j + 2] == phrase.split() for d in (0, 1)}
        hits = [max((w, e) for e, w in model.weights.items() if f" {x} ".startswith(e)) for j, x in enumerate(flat)
                if j not in spared and any(f" {x} ".startswith(e) for e in model.weights)]
        total, kinds = sum(w for w, _ in hits), sum(w for w, _ in set(hits))
        x = [toxicity.math.log1p(total), toxicity.math.log1p(100 * total / (len(flat) + (1 if flat else 2) + 20)), toxicity.math.log1p(kinds)]
        score = 1 / (1 + toxicity.math.exp(-(0.5 * x[0] + 0.25 * x[1] + x[2] - 2.0)))
        want[i, round(total, 9), len(hits), round(score, 9)] += 1
    assert got == want


def test_lexicon_is_cut_only_on_request():
    texts = {1: [f"{w} word{i}" for i in range(60) for w in ("nasty", "ugly")], 0: [f"calm word{i}" for i in range(120)]}
    sample = toxicity.Sample(texts, {0: 120, 1: 120})
    whole, few = toxicity.learn(sample, max_entries=None), toxicity.learn(sample, max_entries=2)
    assert len(few.weights) == 2 < len(whole.weights) and set(few.weights) < set(whole.weights)


def test_quality_scores_equal_compressing_by_hand(make_docs):
    good, bad = b"a calm and plain sentence about the weather " * 20, b"$$$ buy now %%% cheap !!! " * 30
    model = compression.Model(good, bad, compression.np.array([0.3, -0.2, 0.5, 1.0, -0.7]))
    rows = [*ODD, *((i, f"a calm sentence {i} about the weather " * (i % 7)) for i in range(60)), *((100 + i, "buy now %%% " * i) for i in range(40))]
    pair = [zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad)]
    want = Counter()
    for i, text in rows:
        data = (text or "").encode()
        g, b = (len(c.compress(data)) if data else 0 for c in pair)
        z = 0.3 * 100 * (b - g) / (len(data) + 20) - 0.2 * 10 * (b - g) / (b + g + 20) + 0.5 * (b - g) / (b + g + 20) ** 0.5 + (b + g + 20) / (len(data) + 20) - 0.7
        want[i, round(1 / (1 + toxicity.math.exp(-z)), 9)] += 1
    assert Counter((r.doc_id, round(r.score, 9)) for r in compression.scored(make_docs(*rows), model).collect()) == want
    kept = Counter(r.doc_id for r in compression.accepted(make_docs(*rows), model, 0.5).collect())
    assert kept == Counter(i for (i, s), n in want.items() for _ in range(n) if s >= 0.5)
    assert compression._dictionary(["few", "", "texts"]) == b"few\ntexts"


def test_pseudonyms_of_numbers_are_a_keyed_permutation():
    """Every value of a small domain has one image, inside the domain and allowed, and another key gives another order."""
    for size, allowed in ((10, None), (97, None), (256, lambda v: v % 2 == 0), (1000, lambda v: v % 7 != 0)):
        inside = [v for v in range(size) if allowed is None or allowed(v)]
        args = () if allowed is None else (allowed,)
        images = [pseudonyms.permute(v, size, b"k1", "t", *args) for v in inside]
        assert sorted(images) == inside
        other = [pseudonyms.permute(v, size, b"k2", "t", *args) for v in inside]
        assert sorted(other) == inside and (size == 10 or other != images)


def test_folding_and_exceptions():
    assert toxicity.fold("You ST0PID, 1diot!! іdіоt 2024") == " you stopid idiot idiot 2024 "
    model = toxicity.Model({" clown ": 2.0, " clo": 1.0})
    found = toxicity.matched(toxicity.fold("A clown, a clown fish and clothes"), model.automaton())
    assert sorted(w for w, _ in found.values()) == [1.0, 2.0]


def test_pseudonyms_keep_format_and_links(make_docs):
    key = b"a key"
    text = ("Card 4111 1111 1111 1111 or 4111111111111112, born 2024-02-29, seen 31.12.1999, 31.02.1999, call +1 (974) 555-3436, "
            "host 97.51.17.173, 300.1.1.1, mail jo.81@mail7.example.com, IBAN GB82WEST12345698765432, SSN 078-05-1120, 000-12-3456.")
    new, spans = pseudonyms.replaced(text, key)
    assert Counter(k for k, _, _ in spans) == {"card": 1, "iso": 1, "dotted": 1, "phone": 1, "ip": 1, "email": 1, "iban": 1, "ssn": 1}
    for same in ("4111111111111112", "31.02.1999", "300.1.1.1", "000-12-3456"):
        assert same in new
    for gone in ("4111 1111 1111 1111", "2024-02-29", "31.12.1999", "974) 555", "97.51.17.173", "jo.81@", "WEST12345698765432", "078-05-1120"):
        assert gone not in new
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4})", new)[1]
    assert pseudonyms.luhn(card.replace(" ", "")) and pseudonyms.replaced(card.replace(" ", ""), key)[1]
    assert pseudonyms.pseudonym("card", "4111-1111-1111-1111", key).replace("-", " ") == card
    assert len({pseudonyms.permute(i, 1000, key, "t", lambda v: v % 3 == 0) for i in range(0, 1000, 3)}) == 334
    got = pseudonyms.pseudonymised(make_docs(*ODD, (1, text), (1, text)), key, spans="found").collect()
    assert {(r.doc_id, r.text) for r in got if r.doc_id != 1} == set(ODD) and [r.text for r in got if r.doc_id == 1] == [new, new]
    assert pseudonyms.pseudonymised(make_docs(), key).columns == make_docs().columns


def test_raking_reaches_the_targets(spark):
    cells = spark.createDataFrame([(s, k, 10 + 7 * s * k) for s in range(4) for k in range(3)], "s int, k int, weight long")
    targets = {"s": spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0), (3, 4.0), (9, 5.0)], "value int, share double"),
               "k": spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 1.0)], "value int, share double")}
    fitted = mixing.rake(cells, targets).toPandas()
    total = fitted["weight"].sum()
    assert list(fitted.groupby("s")["fitted"].sum() / total) == pytest.approx([1 / 8, 1 / 8, 2 / 8, 4 / 8], abs=1e-6)
    assert list(fitted.groupby("k")["fitted"].sum() / total) == pytest.approx([3 / 6, 2 / 6, 1 / 6], abs=1e-6)
    assert mixing.rake(cells.filter("false"), targets).count() == 0


def test_raking_ends_where_targets_contradict_each_other(spark):
    cells = spark.createDataFrame([(0, 0, 5), (1, 1, 5)], "s int, k int, weight long")
    targets = {"s": spark.createDataFrame([(0, 1.0), (1, 3.0)], "value int, share double"),
               "k": spark.createDataFrame([(0, 3.0), (1, 1.0)], "value int, share double")}
    assert sorted(r.fitted for r in mixing.rake(cells, targets, rounds=8).collect()) == pytest.approx([2.5, 7.5])


def test_calibration_keeps_the_share_asked_for(spark):
    fitted = spark.createDataFrame([(1, 50.0), (10, 30.0), (10, 15.0), (100, 20.0), (100, 6.0)], "weight long, fitted double").repartition(3)
    rows = [tuple(r) for r in fitted.collect()]
    for keep in (0.01, 0.1, 0.3, 0.5, 0.9, 0.999):
        scale = mixing.calibration(fitted, keep)
        assert sum(w * min(1, scale * f / w) for w, f in rows) == pytest.approx(keep * 221)
    assert mixing.calibration(fitted, 1.0) * 0.06 >= 1 - 1e-9
    assert mixing.calibration(fitted.filter("false"), 0.5) == 1.0


def test_mixing_takes_odd_rows(spark, make_docs):
    rows = mixing.mixed(make_docs(*ODD)).collect()
    assert len(rows) == len(ODD) and all(0 <= r._per_billion <= 10**9 for r in rows)
    assert mixing.mixed(make_docs()).count() == 0
    nulls = make_docs((1, "a b"), (2, None)).selectExpr("doc_id", "text", "cast(null as string) as source", "cast(null as string) as lang")
    assert {(r._source, r._tokens) for r in mixing.mixed(nulls).collect()} == {("unknown", 3), ("unknown", 1)}
