import os

from lineloom.sources.tree import read_tree, read_trees


def test_read_tree(spark, tmp_path):
    files = {
        "pkg/__init__.py": b"",
        "_private/x.py": b"x = 1\n",
        "A.PY": b"y = 2\r\n",
        "bad.py": b"z = '\xff'\n",
        "notes.md": b"no",
        ".eslintrc.js": b"no",
        "node_modules/x.js": b"no",
        "src/.hidden/b.py": b"no",
        "deep/a/b/c/d.ts": b"let d = 1;",
        "deep/a/dist/c.js": b"no",
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        os.utime(path, (1_700_000_000.9, 1_700_000_000.9))
    os.symlink(tmp_path, tmp_path / "deep" / "loop")
    os.symlink(tmp_path / "missing.py", tmp_path / "dangling.py")
    rows = {r.path: r for r in read_tree(spark, str(tmp_path), "p").collect()}
    assert sorted(rows) == ["A.PY", "_private/x.py", "bad.py", "deep/a/b/c/d.ts", "pkg/__init__.py"]
    assert rows["bad.py"].content == "z = '�'\n"
    assert rows["A.PY"].content == "y = 2\r\n"
    assert rows["pkg/__init__.py"].content == "" and rows["pkg/__init__.py"].file_size == 0
    assert {r.last_modified.timestamp() for r in rows.values()} == {1_700_000_000}
    assert {r.error for r in rows.values()} == {None}
    for levels in (0, 1, 5):
        assert read_tree(spark, str(tmp_path), levels=levels).count() == 5


def test_read_trees(spark, tmp_path):
    for project in ("one", "two"):
        (tmp_path / project).mkdir()
        (tmp_path / project / "a.py").write_text(f"{project} = 1\n")
    rows = read_trees(spark, {p: str(tmp_path / p) for p in ("one", "two")}, partitions=2).collect()
    assert sorted((r.project, r.path, r.content) for r in rows) == [
        ("one", "a.py", "one = 1\n"),
        ("two", "a.py", "two = 1\n"),
    ]
    assert read_tree(spark, str(tmp_path / "one")).first().project == "one"
