from pyspark.sql import functions as F

from lineloom import functions as fn
from lineloom.functions.text import phrase_terms


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens(spark):
    got = lambda text, **kw: value(spark, fn.tokens(F.lit(text), **kw))
    assert got("Try_catch, error-2!") == ["try", "catch", "error", "2"]
    assert got("Élan cafe\u0301 naïve") == ["elan", "cafe", "naive"]
    assert got("Élan", fold_accents=False) == ["élan"]
    assert got("") == []
    for text in ("Try_catch, error-2!", "Élan cafe\u0301 naïve", "日本 x\ue000y"):
        assert got(text) == phrase_terms(text)
    assert fn.query_terms("b a B") == ["b", "a"]


def test_snippets(spark):
    text = "\n".join("abcdefgh")
    got = lambda line, n: value(spark, fn.snippet(F.lit(text), line, n))
    assert got(1, 3) == "a\nb\nc\nd\ne"
    assert got(5, 1) == "d\ne\nf\ng"
    assert got(8, 2) == "f\ng\nh"
    assert got(20, 2) == ""
    assert value(spark, fn.snippet(F.lit("only"), 1, 3)) == "only"
    assert value(spark, fn.snippet_head(F.lit(text), 5, 500)) == "a\nb\nc\nd\ne"
    assert value(spark, fn.snippet_head(F.lit("x" * 600), 5, 500)) == "x" * 500 + "..."
    assert value(spark, fn.snippet_head(F.lit("x" * 500), 5, 500)) == "x" * 500


def test_line_column(spark):
    got = lambda at: tuple(value(spark, fn.line_column(F.lit("ab\ncd\n"), at)))
    assert [got(i) for i in (0, 1, 2, 3, 6)] == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


def test_strip_blanks(spark):
    assert value(spark, fn.strip_blanks(F.lit("\ufeff\u00a0\t x y \r\n\u2003"))) == "x y"


def test_name_tests(spark):
    has = lambda a, b, **kw: value(spark, fn.name_contains(F.lit(a), b, **kw))
    assert has("handleClick", "CLICK")
    assert not has("handleClick", "le%k")
    assert has("handleClick", "le%k", wildcards=True)
    assert has("App\\User", "p\\u%r", wildcards=True)
    assert has("a_b", "_") and not has("ab", "_")
    assert value(spark, fn.name_starts_with(F.lit("HandleClick"), "handle"))


def test_languages(spark):
    paths = {
        "a/B.PY": "python", "x.test.tsx": "typescript", ".py": "unknown", "Makefile": "unknown", "a.py/b": "unknown",
        "a.yml": "yaml", "h.h": "c", "x.": "unknown", "d/.js": "unknown", "..ts": "typescript",
    }
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert dict(rows.select("path", fn.language_of(F.col("path"))).collect()) == paths


def test_excluded(spark):
    paths = {
        "node_modules/x.js": True, ".venv/a.py": True, "src/.hidden/b.py": True, "a/build/c.js": True,
        "building/c.js": False, "src/__init__.py": False, "_private/x.py": False, ".eslintrc.js": False, "dist": False,
    }
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert dict(rows.select("path", fn.excluded(F.col("path"))).collect()) == paths
    assert value(spark, fn.excluded(F.lit("a/x.log"), suffixes=(".log",)))


def test_relative_path(spark):
    got = lambda path, root: value(spark, fn.relative_path(F.lit(path), root))
    assert got("/srv/app/./src//a/../b.py", "/srv/app") == "src/b.py"
    assert got("C:\\app\\src\\b.py", "C:\\app\\") == "src/b.py"
    assert got("a/b.py", "") == "a/b.py"
