"""Whitening, clusters and reply trees against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from codequarry.llm import catalog, centroids, chat, whitening
from codequarry.llm.whitening import contour_vectors, eigenvalues_above, slices

SF = "/root/testdata/sf0.001"


def spectrum(values, seed=1):
    turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return turned @ np.diag(values) @ turned.T


@pytest.mark.parametrize("values", [
    np.arange(30.0, 0, -1), np.r_[np.full(12, 5.0), np.full(12, 5.0 + 1e-13), np.full(6, 1.0)], np.r_[1e6, 3, 3, 3, np.full(26, 1e-3)],
    np.r_[np.linspace(2, 1, 5), np.zeros(25)], np.r_[np.full(15, 9.0), 4 + 1e-9, 4, 3, np.ones(12)], np.r_[7.0], np.zeros(4)])
def test_components_of_many_spectra(spark, values):
    matrix = spectrum(values)
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.components(spark, matrix, 16)
    want = np.sort(values[values > 1e-10 * max(1, values.max())])[::-1][:16]
    assert len(found) == len(want) and np.allclose(found, want, rtol=1e-12, atol=1e-12 * max(1, values.max()))
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max(initial=0) < 1e-12
    assert np.abs(vectors @ matrix - found[:, None] * vectors).max(initial=0) < 1e-11 * max(1, values.max())


def test_inertia_and_slices_count_all_eigenvalues():
    draw = np.random.default_rng(4)
    for dims in (1, 2, 3, 17, 40):
        a = draw.standard_normal((dims, dims))
        a = a + a.T
        truth = np.linalg.eigvalsh(a)
        for shift in (*draw.uniform(-8, 8, 20), 0.0):
            assert eigenvalues_above(a, shift) == (truth > shift).sum()
    assert eigenvalues_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    cut = slices(spectrum(np.arange(1.0, 41)), 16)
    assert sum(n for _, _, n in cut) == 16 and all(n <= whitening.MOST_IN_SLICE for _, _, n in cut)
    assert all(a[1] <= b[0] for a, b in zip(cut, cut[1:], strict=False))
    inner = contour_vectors(np.diag([1.0, 2.0, 3.0, 4.0]), 1.5, 3.5, 2)
    assert np.allclose(np.sort(np.abs(inner).argmax(axis=1)), [1, 2]) and np.allclose(np.abs(inner).max(axis=1), 1)


def check_whitening(rows, got, dims):
    """Every promise of the result, from plain numpy over the usable rows of one length."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    x = [np.floor(64 * v).astype(int) + 1_000_000 for _, v in kept]
    distinct = [np.array(v, object) for v in {tuple(v.tolist()) for v in x}]
    n, sums = len(distinct), sum(distinct)
    centred = np.array([(n * v - sums).astype(float) / n for v in distinct])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(kept) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    explained = {r.component: r.explained for r in got}
    assert all(abs(explained[c] / (values[c - 1] / covariance.trace()) - 1) < 1e-10 for c in explained)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    deviation = sorted((i, int(((n * v.astype(object) - sums) ** 2).sum())) for (i, _), v in zip(kept, x, strict=True))
    assert sorted((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == deviation
    # the whitened rows: as many as kept, of unit covariance over distinct rows, and made of the covariance's own directions
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, r.whitened)
    w = {tuple(v.tolist()): np.array([by_row[i][c] for c in range(1, k + 1)]) for (i, _), v in zip(kept, x, strict=True)}
    white = np.array([w[tuple(v.tolist())] for v in distinct])
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9 and np.abs(white.mean(axis=0)).max() < 1e-9
    directions = np.linalg.lstsq(centred, white * np.sqrt(values[:k]), rcond=None)[0]
    assert np.abs(covariance @ directions - directions * values[:k]).max() < 1e-7 * values[0]


def test_whitening_against_numpy(spark):
    draw = np.random.default_rng(7)
    rows = [(i, [float(v) for v in draw.integers(-40, 40, 6) / 32]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(50)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [])]
    rows += [(5, rows[5][1])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, x string")
    check_whitening(rows, whitening.whitened(table).collect(), 6)
    assert whitening.whitened(table.filter("false")).count() == 0
    lone = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(lone).count() == 0


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, catalog.op11_whitening(spark, SF).collect(), 64)


def test_whitening_of_large_entries_other_lengths_and_null_ids(spark):
    rows = [(None, [2.0**40, 1.0, 0.0]), (1, [-(2.0**40), 2.0, 0.0]), (2, [0.0, 4.0, 1.0]), (3, [3e38, 0.0, 0.0]), (4, [1.0, 2.0]), (5, [2.0, 2.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whitened(table).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["1", "2", "4", "5", "None"]
    assert {r.n for r in got if r.vec_id in (4, 5)} == {2}
    x = np.array([[int(64 * c) + 1_000_000 for c in v] for _, v in rows[:3]], object)
    assert next(int(r.deviation) for r in got if r.vec_id == 1) == int(((3 * x[1] - x.sum(axis=0)) ** 2).sum())


def plain_clusters(rows, dims, clusters, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    kept = [(i, q) for i, q in kept if max(map(abs, q)) < 2**27]
    centres = [q for _, q in sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), c) for c, m in enumerate(centres)) for _, q in kept]

    for _ in range(rounds):
        near = assign()
        for c in range(len(centres)):
            mine = [q for (_, q), (_, own) in zip(kept, near, strict=True) if own == c]
            if mine:
                centres[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), centres


@pytest.mark.parametrize("leading", [0, 2, 8, 50])
def test_clusters_equal_a_plain_version(spark, leading):
    draw = np.random.default_rng(9)
    rows = [(i, [float(v) for v in draw.integers(-6, 7, 8) / 13 + (i % 3)]) for i in range(150)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [1.0]), (304, []), (305, [1e30] * 8), (None, [0.5] * 8)]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    result, centres = centroids.clustered(table, 8, clusters=12, rounds=3, leading=leading)
    want, plain = plain_clusters(rows, 8, 12, 3)
    held = result.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in held) == want and centres.tolist() == plain
    if leading == 8:
        assert max(r.n_verified for r in held) < 12  # the bound leaves centroids out


def test_few_or_no_vectors_and_empty_clusters(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], schema)
    result = centroids.digest(*centroids.clustered(two, 2, clusters=5)).collect()
    assert {(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in result} == {(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)}
    assert {r.centroid_sha256 for r in result} == {hashlib.sha256(b"256,0").hexdigest()}
    assert centroids.digest(*centroids.clustered(two.filter("false"), 2)).count() == 0


def test_bounds_hold_far_from_the_origin():
    draw = np.random.default_rng(2)
    x = draw.integers(-3, 4, (500, 16)) + 2**26
    axes = np.linalg.qr(draw.standard_normal((16, 16)))[0]
    mean, centres = np.zeros(16), x[:20].copy()
    lead, rest = centroids.rotated(x, mean, axes, 5)
    c_lead, c_rest = centroids.rotated(centres, mean, axes, 5)
    cluster, distance, _ = centroids.nearest(x, lead, rest, centres, c_lead, c_rest)
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def plain_paths(messages):
    parent = {}
    for tree, node, up, *_ in messages:
        parent[tree, node] = (tree, up) if up is not None else None
    has_reply = {up for up in parent.values() if up in parent}
    paths = {}
    for leaf in parent:
        if leaf not in has_reply:
            path, at = [], leaf
            while at in parent and at not in path:
                path.append(at)
                at = parent[at]
            if at not in path:
                paths[leaf] = path[::-1]
    return paths


def test_paths_branches_and_masks_of_random_trees(spark):
    draw = random.Random(3)
    messages = []
    for tree in (1, 2, 3, None):
        for node in range(25 if tree != 3 else 90):
            up = None if node == 0 else node - 1 if tree == 3 else draw.randrange(-1, node)  # tree 3 is one long chain; -1 is missing
            messages.append((tree, node, up, draw.choice(["user", "assistant", None]), draw.choice([None, "a", "b\n", "</s>", "\\</s>", "<|im_end|>\n", "[INST]<|im_start|>x"]), node % 4 / 2))
    messages += [(9, 1, 3, "user", "x", 0.0), (9, 2, 1, "user", "y", 0.0), (9, 3, 2, "user", "z", 0.0), (9, 4, 3, "user", "into a circle", 0.0), (9, 5, 5, "user", "itself", 0.0),
                 (9, 6, None, "assistant", "alone", None)]
    table = spark.createDataFrame([(*m, "u") for m in messages], "tree_id long, node_id long, parent_id long, role string, text string, score double, leaf string")
    paths = plain_paths(messages)
    said = {m[:2]: (m[3] or "", m[4] or "") for m in messages}
    score = {m[:2]: m[5] or 0.0 for m in messages}
    every = chat.conversations(table, table, branches=None)
    read = every.select("tree_id", "leaf_id", "rank", "n_turns", chat.turns_of(every.formatted).alias("turns"), chat.learned_text(every.formatted, every.loss).alias("learned")).collect()
    assert len(read) == len(paths) and {r["rank"] for r in read} == {None}
    for r in read:
        want = [said[n] for n in paths[r.tree_id, r.leaf_id]]
        assert [tuple(t) for t in r.turns] == want and r.n_turns == len(want)
        assert r.learned == "".join(text for role, text in want if role == "assistant")
    best = chat.conversations(table, table, branches=2).collect()
    mean = {leaf: sum(score[n] for n in path) / len(path) for leaf, path in paths.items()}
    for tree in {leaf[0] for leaf in paths}:
        order = sorted((-round(m, 10), leaf[1]) for leaf, m in mean.items() if leaf[0] == tree)[:2]
        assert [r.leaf_id for r in sorted(best, key=lambda r: r["rank"]) if r.tree_id == tree] == [leaf for _, leaf in order]
    assert chat.conversations(table.filter("false"), table.filter("false")).count() == 0


def test_templates_round_trip(spark):
    draw = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "%", "%0A", "\n", "user", "é", "<\\|im_end|>", "<\\\\/s>", "😀", "%25", ""]
    texts = ["".join(draw.choices(parts, k=draw.randrange(7))) for _ in range(400)]
    rows = [(i // 4, i % 4, texts[i], texts[-i]) for i in range(400)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat.conversations(*chat.linear(table), learned=texts[0])
    read = {r.tree_id: r for r in out.select("tree_id", "formatted", chat.turns_of(out.formatted).alias("turns")).collect()}
    for conv in range(100):
        assert [tuple(t) for t in read[conv].turns] == [(role, text) for c, _, role, text in rows if c == conv]
        assert read[conv].formatted.count("<|im_start|>") == 4 and "</s>" not in read[conv].formatted and "[INST]" not in read[conv].formatted


def test_linear_conversations_with_repeated_and_null_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (1, 2, None, "c"), (None, 1, "assistant", "n"), (2, 5, "assistant", ""), (1, 0, "assistant", "a")]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, tree_id string")
    got = {r.conv_id: r for r in chat.digest(chat.conversations(*chat.linear(table))).collect()}
    sha = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in
           {1: "system\n\nassistant\na\nuser\na\nuser\na\n\nc\n", None: "assistant\nn\n", 2: "assistant\n\n"}.items()}
    assert {k: (r.n_turns, r.turns_sha256) for k, r in got.items()} == {1: (5, sha[1]), None: (1, sha[None]), 2: (1, sha[2])}
    assert got[1].loss_chars == 1 and got[2].loss_chars == 0
    shuffled = {r.conv_id: r for r in chat.digest(chat.conversations(*chat.linear(table.repartition(7)))).collect()}
    assert shuffled == got
