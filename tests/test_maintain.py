from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lineloom.operators import maintain
from lineloom.plans import search, stats
from lineloom.plans.index import build_index
from lineloom.schemas import CHANGES, PROJECTS
from lineloom.sources import store

NOON = datetime(2024, 5, 1, 12, 0, 0)
BASE = [
    ("one", "a.py", "import os\ndef first():\n", NOON),
    ("one", "b.py", "class Second:\n", NOON),
    ("two", "a.py", "third = 3\n", NOON),
    (None, "c.php", "<?php\nuse A\\B;\n", NOON),
]


def contents(index):
    """Everything an index holds, as plain sets."""
    rows = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()), key=str)
    return {
        "files": rows(index.files, "project", "path", "language", "last_modified", "content", "head"),
        "symbols": rows(index.symbols, "project", "path", "name", "type", "line", "column", "scope"),
        "imports": rows(index.imports, "project", "path", "import_path", "import_name"),
        "postings": rows(index.postings, "file_id", "field", "term", "pos"),
    }


def changes(spark, *rows):
    return spark.createDataFrame([(p, path, a, ts, i, text) for i, (p, path, a, ts, text) in enumerate(rows)], CHANGES)


def test_diff(corpus):
    scan = corpus(
        ("one", "a.py", "x", NOON + timedelta(milliseconds=700)),
        ("one", "b.py", "x", NOON - timedelta(seconds=1)),
        ("two", "a.py", "x", NOON + timedelta(seconds=1)),
        (None, "d.py", "x", NOON),
    )
    index = build_index(corpus(*BASE))
    rows = maintain.diff_files(scan, index.files).collect()
    assert {(r.project, r.path): r.status for r in rows} == {
        ("one", "a.py"): "skipped",
        ("one", "b.py"): "changed",
        ("two", "a.py"): "changed",
        (None, "c.php"): "missing",
        (None, "d.py"): "new",
    }


def test_refresh(corpus):
    index = build_index(corpus(*BASE))
    assert contents(maintain.refresh(index, corpus(*BASE))) == contents(index)
    later = [BASE[0], ("one", "b.py", "class Renamed:\n", NOON + timedelta(days=1)), ("two", "new.py", "n = 1\n", NOON)]
    kept = maintain.refresh(index, corpus(*later))
    assert contents(kept) == contents(build_index(corpus(*later, BASE[2], BASE[3])))
    pruned = maintain.refresh(index, corpus(*later), prune=True)
    assert contents(pruned) == contents(build_index(corpus(*later)))


def test_projects(spark, corpus):
    projects = spark.createDataFrame(
        [(n, f"/src/{n}", "indexed", 1, 1, NOON, NOON, NOON) for n in ("one", "two")], PROJECTS
    )
    more = maintain.add_project(maintain.add_project(projects, "/src/deep/three/"), "/src/one", "again")
    assert sorted((r.name, r.folder_path, r.status) for r in more.collect()) == [
        ("one", "/src/one", "indexed"),
        ("three", "/src/deep/three", "pending"),
        ("two", "/src/two", "indexed"),
    ]
    index = build_index(corpus(*BASE), projects=projects)
    left = maintain.remove_project(index, "/src/one")
    assert contents(left) == contents(build_index(corpus(*BASE[2:])))
    assert [r.name for r in left.projects.collect()] == ["two"]
    assert maintain.remove_project(index, "one").files.count() == 2
    assert maintain.remove_project(index, "none").files.count() == 4


def test_store(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    index = build_index(corpus(*BASE))
    assert store.write_index(index, path) == 0
    assert contents(store.read_index(spark, path)) == contents(index)
    feed = changes(
        spark,
        ("one", "a.py", "unlink", NOON, None),
        ("one", "a.py", "add", NOON + timedelta(hours=1), "def again():\n"),
        ("two", "a.py", "change", NOON, "x = 1\n"),
        ("two", "a.py", "unlink", NOON + timedelta(hours=1), None),
        ("two", "n.py", "add", NOON, "n = 1\n"),
        ("two", "node_modules/n.js", "add", NOON, "var n = 1\n"),
    )
    after = build_index(
        corpus(
            ("one", "a.py", "def again():\n", NOON + timedelta(hours=1)), ("two", "n.py", "n = 1\n", NOON), BASE[1], BASE[3]
        )
    )
    assert contents(maintain.apply_changes(index, feed)) == contents(after)
    assert store.commit_changes(spark, path, feed, run_id="x#1") == 1
    assert store.commit_changes(spark, path, feed, run_id="x#1") is None
    assert contents(store.read_index(spark, path)) == contents(after)
    # What a run left behind that died before its last step is not seen, and overwritten.
    after.files.write.parquet(f"{path}/files/segment=2")
    assert contents(store.read_index(spark, path)) == contents(after)
    # The same feed again, as a new run, changes nothing.
    assert store.commit_changes(spark, path, feed) == 2
    assert contents(store.read_index(spark, path)) == contents(after)
    assert store.compact_index(spark, path) == 3
    assert contents(store.read_index(spark, path)) == contents(after)
    assert search.search_code(store.read_index(spark, path), "again").count() == 1
    store.clear_index(spark, path)
    assert not any(contents(store.read_index(spark, path)).values())
    assert store.read_runs(spark, path).count() == 5


def test_reindex_all(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    scan = corpus(*BASE[:3]).withColumn("error", F.when(F.col("path") == "b.py", "denied"))
    folders = {"one": "/src/one", "two": "/src/two"}
    store.reindex_all(spark, path, scan, folders=folders)
    first = contents(store.read_index(spark, path))
    assert [f[:2] for f in first["files"]] == [("one", "a.py"), ("two", "a.py")]
    store.reindex_all(spark, path, scan, prune=True, folders=folders)
    assert contents(store.read_index(spark, path)) == first
    fixed = corpus(("one", "b.py", "class Fixed:\n", NOON), BASE[2])
    store.reindex_all(spark, path, fixed, prune=True, folders=folders)
    index = store.read_index(spark, path)
    assert contents(index) == contents(build_index(fixed))
    log = [(r.indexed, r.skipped, r.failed, r.symbols, r.imports) for r in index.runs.orderBy("segment").collect()]
    assert log == [(2, 0, 1, 2, 1), (0, 2, 1, 0, 0), (1, 1, 0, 1, 0)]
    shown = stats.list_projects(index.projects).collect()
    assert [(r.name, r.folder, r.status, r.files, r.symbols) for r in shown] == [
        ("one", "/src/one", "indexed", 1, 1),
        ("two", "/src/two", "indexed", 1, 1),
    ]
    # Leftovers of a failed run must not come to light with a run that writes less.
    build_index(corpus(*BASE)).files.write.parquet(f"{path}/files/segment=3")
    store.remove_stored_project(spark, path, "/src/two")
    index = store.read_index(spark, path)
    assert contents(index) == contents(build_index(corpus(("one", "b.py", "class Fixed:\n", NOON))))
    assert [r.name for r in index.projects.collect()] == ["one"]


def test_any_order_of_batches_is_a_full_build(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    for i, row in enumerate(BASE):
        project, file, text, time = row
        batch = changes(spark, (project, file, "add", time, "old = 1\n"), (project, file, "change", time, text))
        store.commit_changes(spark, path, batch, run_id=str(i))
    assert contents(store.read_index(spark, path)) == contents(build_index(corpus(*BASE)))


def test_unknown_project_raises_on_request(spark):
    from lineloom.operators.corpus import require_project

    projects = spark.createDataFrame([("one", "/src/one", "indexed", 1, 1, NOON, NOON, NOON)], PROJECTS)
    require_project(projects, "/src/one")
    with pytest.raises(ValueError):
        require_project(projects, "two")


def test_full_and_incremental_runs_agree_over_a_tree(spark, tmp_path):
    """Any language, sizes of broken text, no body read without need, closed folders never pruned."""
    import os

    from lineloom.sources.tree import list_trees

    tree, path = tmp_path / "tree", str(tmp_path / "index")
    for name, body in {"x.go": b"func x\n", "sub/y.py": b"def y():\n", "bad.py": b"z = '\xff\xfe'\n"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(body)
    listed = list_trees(spark, {"p": str(tree)}, languages=None)
    store.index_corpus(store.read_bodies(listed), path)
    rows = lambda: sorted((r.path, r.file_size, r.language) for r in store.read_index(spark, path).files.collect())
    first = rows()
    assert [r[0] for r in first] == ["bad.py", "sub/y.py", "x.go"] and first[0][1] == 9
    for name in ("x.go", "sub/y.py", "bad.py"):
        os.utime(tree / name, (1_800_000_000, 1_800_000_000))
    store.reindex_all(spark, path, list_trees(spark, {"p": str(tree)}, languages=None), prune=True)
    assert rows() == first
    last = store.read_runs(spark, path).orderBy(F.desc("segment")).first()
    assert (last.indexed, last.skipped, last.failed) == (3, 0, 0)
    # Nothing has changed, so a listing that points nowhere is never opened.
    blind = list_trees(spark, {"p": str(tree)}, languages=None).withColumn("full_path", F.lit("/nowhere"))
    store.reindex_all(spark, path, blind, prune=True)
    last = store.read_runs(spark, path).orderBy(F.desc("segment")).first()
    assert (last.indexed, last.skipped, last.failed) == (0, 3, 0) and rows() == first
    # A folder that could not be listed shields what was known below it.
    closed = spark.createDataFrame(
        [("p", "sub", str(tree / "sub"), None, None, "denied", None)], blind.select("project", "path", "full_path", "mtime", "file_size", "error", "last_modified").schema
    )
    store.reindex_all(spark, path, closed, prune=True)
    assert [r[0] for r in rows()] == ["sub/y.py"]


def test_folders_of_one_name_stay_apart(spark, corpus):
    empty = spark.createDataFrame([], PROJECTS)
    projects = maintain.add_project(maintain.add_project(empty, "/a/app"), "/b/app/")
    projects = maintain.add_project(maintain.add_project(projects, "/a/app"), "/c/lib", "app")
    names = {r.folder_path: r.name for r in projects.collect()}
    assert names == {"/a/app": "app", "/b/app": "/b/app", "/c/lib": "/c/lib"}
    rows = [(names[f], "a.py", f"def of_{f[1]}():\n", NOON) for f in names]
    index = build_index(corpus(*rows), projects=projects)
    assert index.files.count() == 3
    for left, gone in ((["/b/app", "/c/lib"], "/a/app"), (["/b/app", "/c/lib"], "app"), (["/a/app", "/c/lib"], "/b/app")):
        after = maintain.remove_project(index, gone)
        assert sorted(r.folder_path for r in after.projects.collect()) == left
        assert contents(after) == contents(build_index(corpus(*[r for f, r in zip(names, rows) if f in left])))
    found = stats.list_projects(projects).collect()
    assert [(r.name, r.folder) for r in found] == [("/b/app", "/b/app"), ("/c/lib", "/c/lib"), ("app", "/a/app")]
