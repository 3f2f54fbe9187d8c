"""Versions of a files table that share folders."""

import pytest

from codequarry.operators import patches as pt
from codequarry.operators import versions as vs
from codequarry.sources.trees import read_trees, write_trees


def rows(frame):
    return sorted((r.repo, r.path, r.size, r.is_binary, r.text) for r in frame.collect())


def keys(spark, *pairs):
    return spark.createDataFrame(list(pairs), "repo string, path string")


FIRST = [("r", f"src/f{i}.txt", f"text {i}\n") for i in range(40)] + [("s", "b.bin", b"a\x00b")]


@pytest.fixture()
def store(make_files, tmp_path):
    location = f"{tmp_path}/store"
    assert vs.create_versions(make_files(*FIRST), location, folders=16) == 1
    return location


def test_versions_stay_readable_and_share_folders(spark, make_files, store):
    changed = make_files(("r", "src/f3.txt", "anew"), ("t", "new.txt", ""))
    assert vs.commit_files(spark, store, changed, keys(spark, ("r", "src/f4.txt"), ("r", "src/f3.txt"), ("x", "never"))) == 2
    second = [f for f in FIRST if f[1] not in ("src/f3.txt", "src/f4.txt")] + [("r", "src/f3.txt", "anew"), ("t", "new.txt", "")]
    assert rows(vs.read_version(spark, store)) == rows(make_files(*second))
    assert rows(vs.read_version(spark, store, 1)) == rows(make_files(*FIRST))
    before, after = (vs._entries(spark, store, vs._header(spark, store, v)) for v in (1, 2))
    differ = {f for f in before | after if before.get(f) != after.get(f)}
    assert 0 < len(differ) <= 4 and len(before) > 8
    changes = vs.changes_between(spark, store, 1, 2)
    assert sorted(map(tuple, changes.collect())) == [("r", "src/f3.txt", "M"), ("r", "src/f4.txt", "D"), ("t", "new.txt", "A")]
    read = {p.split("folder=")[1].split("/")[0] for p in changes.inputFiles()}
    assert read <= {str(f) for f in differ}
    assert vs.changes_between(spark, store, 1, 1).count() == 0


def test_going_back_copies_nothing(spark, make_files, store):
    vs.commit_files(spark, store, make_files(("r", "src/f3.txt", "anew")))
    assert vs.roll_back(spark, store, 1) == 3
    assert rows(vs.read_version(spark, store)) == rows(make_files(*FIRST))
    assert set(vs.read_version(spark, store).inputFiles()) == set(vs.read_version(spark, store, 1).inputFiles())
    log = sorted(map(tuple, vs.version_log(spark, store).collect()))
    size = sum(len(t) for _, _, t in FIRST)
    assert [r[:5] for r in log] == [(1, None, "create", 41, size), (2, 1, "commit", 41, size - 3), (3, 2, "roll back to 1", 41, size)]
    assert [r[5] for r in log[1:]] == [1, 1]
    with pytest.raises(ValueError):
        vs.roll_back(spark, store, 9)


def test_commits_are_all_or_nothing(spark, make_files, store):
    # a commit that stopped before it was published
    vs._write_manifest(spark, store, vs._write(make_files(("z", "z.txt", "lost")), store, 16))
    assert rows(vs.read_version(spark, store)) == rows(make_files(*FIRST))
    # a number is given once
    taken = vs._header(spark, store) | {"action": "second"}
    assert not vs._publish(spark, store, taken)
    assert vs._header(spark, store)["action"] == "create"
    with pytest.raises(vs.VersionConflict):
        vs.create_versions(make_files(("z", "z.txt", "other")), store, 16)
    assert vs.commit_files(spark, store, make_files(("r", "src/f3.txt", "one")), parent=1) == 2
    with pytest.raises(vs.VersionConflict):
        vs.commit_files(spark, store, make_files(("r", "src/f3.txt", "two")), parent=1)


def test_a_lost_race_is_run_again_on_the_winner(spark, make_files, store, monkeypatch):
    publish, lost = vs._publish, []

    def beaten_once(session, location, header):
        if not lost:
            lost.append(header)
            assert publish(session, location, header | {"action": "winner"})
        return publish(session, location, header)

    monkeypatch.setattr(vs, "_publish", beaten_once)
    assert vs.commit_files(spark, store, make_files(("r", "src/f5.txt", "mine"))) == 3
    texts = {r.path: r.text for r in vs.read_version(spark, store).collect()}
    assert texts["src/f5.txt"] == "mine" and len(texts) == 41


def test_empty_tables_and_commits(spark, make_files, store, tmp_path):
    empty = make_files(("a", "b", "c")).limit(0)
    assert vs.commit_files(spark, store, empty) == 2
    assert vs.commit_files(spark, store, empty, keys(spark, *[(r, p) for r, p, _ in FIRST])) == 3
    assert vs.read_version(spark, store).count() == 0
    assert vs.commit_files(spark, store, make_files(("a", "b", "c"))) == 4
    assert rows(vs.read_version(spark, store)) == [("a", "b", 1, False, "c")]
    other = f"{tmp_path}/other"
    assert vs.create_versions(empty, other) == 1
    assert vs.read_version(spark, other).count() == 0
    assert vs.version_log(spark, other).first()["files"] == 0


def test_patches_are_committed_on_the_version_they_were_judged_on(spark, make_files, store):
    files = vs.read_version(spark, store, 1)
    patch = spark.createDataFrame([("p", 1, "r", "./src/f7.txt", "text 7", "seven", False)],
                                  "patch_id string, seq int, repo string, path string, target string, replacement string, allow_multiple boolean")
    run = pt.apply_patches(files, patch)
    assert vs.commit_files(spark, store, run.changed, parent=1) == 2
    assert rows(vs.read_version(spark, store)) == rows(pt.snapshot(files, run.changed))


def test_trees_are_written_once_and_read_back(spark, make_files, tmp_path):
    root, outside = tmp_path / "r", tmp_path / "outside"
    outside.mkdir()
    (root / "taken").mkdir(parents=True)
    (root / "old.txt").write_text("old")
    (root / "same.txt").write_text("same")
    (root / "link").symlink_to(outside)
    files = make_files(("r", "a/b.txt", "text é\r\n"), ("r", ".hidden/_x", ""), ("r", "old.txt", "new"), ("r", "same.txt", "same"),
                       ("r", "taken", "x"), ("r", "../up.txt", "x"), ("r", "link/in.txt", "x"), ("r", "bin", b"\x00"),
                       ("r", "d\\e.txt", "slashed"), ("s", "a.txt", "x"), ("r", "old.txt/below", "x"))
    done = {(r.repo, r.path): r.status for r in write_trees(files, {"r": str(root)}).collect()}
    assert done == {("r", "a/b.txt"): "written", ("r", ".hidden/_x"): "written", ("r", "old.txt"): "exists", ("r", "same.txt"): "written",
                    ("r", "taken"): "directory", ("r", "../up.txt"): "denied", ("r", "link/in.txt"): "denied", ("r", "bin"): "binary",
                    ("r", "d\\e.txt"): "written", ("s", "a.txt"): "no_root", ("r", "old.txt/below"): "failed"}
    held = {r.path: r.text for r in read_trees(spark, {"r": str(root)}).collect()}
    assert held == {"a/b.txt": "text é\r\n", ".hidden/_x": "", "old.txt": "old", "same.txt": "same", "d/e.txt": "slashed"}
    assert not list(outside.iterdir())
    again = write_trees(files.filter("path = 'old.txt'"), {"r": str(root)}, overwrite=True)
    assert again.first()["status"] == "written" and (root / "old.txt").read_text() == "new"
