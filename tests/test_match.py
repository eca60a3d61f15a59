import random

import pytest
from pyspark.sql import functions as F

from lineloom.functions.text import phrase_terms
from lineloom.operators import bulk, match
from lineloom.operators.postings import build_postings
from lineloom.plans import lookup, search, stats
from lineloom.plans.index import build_index


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "e", "rare"]
    weights = [30, 20, 10, 5, 3, 1]
    return {
        f"f{i:02}.py": " ".join(rng.choices(words, weights, k=rng.randint(0, 25))) for i in range(60)
    } | {"rare/path.md": "nothing here", "empty.md": ""}


@pytest.fixture(scope="module")
def postings(files, texts):
    return build_postings(files(*[("p", path, text) for path, text in texts.items()])).join(
        files(*[("p", path, text) for path, text in texts.items()]).select("file_id", "path"), "file_id"
    ).cache()


def found(postings, matches):
    return {r.path for r in postings.join(matches, "file_id", "left_semi").select("path").distinct().collect()}


def brute(texts, test):
    return {path for path, text in texts.items() if test(text.split())}


def near(tokens, terms, k):
    spots = [[i for i, t in enumerate(tokens) if t == term] for term in terms]
    if not all(spots):
        return False
    return any(
        max(at) - min(at) - 1 <= k
        for end in range(len(tokens))
        for at in [[max((i for i in s if i <= end), default=None) for s in spots]]
        if None not in at
    )


@pytest.mark.parametrize("terms", [["a"], ["a", "rare"], ["c", "d", "e"], ["missing"], ["a", "missing"]])
def test_all_and_any(postings, texts, terms):
    every = found(postings, match.match_all(postings, terms))
    some = found(postings, match.match_any(postings, terms))
    assert every == brute(texts, lambda t: all(x in t for x in terms))
    assert some == brute(texts, lambda t: any(x in t for x in terms))
    assert found(postings, match.match_phrase(postings, terms)) <= every <= some


def test_no_terms_match_nothing(postings):
    assert match.match_all(postings, []).isEmpty()


def test_not(postings, texts):
    got = found(postings, match.match_not(postings, ["a", "b"], ["c", "rare"]))
    assert got == brute(texts, lambda t: "a" in t and "b" in t and "c" not in t and "rare" not in t)


@pytest.mark.parametrize("phrase", ["a b", "a a", "a b a", "b a a b", "rare a"])
def test_phrase(postings, texts, phrase):
    got = found(postings, match.match_phrase(postings, phrase.split()))
    assert got == brute(texts, lambda t: f" {phrase} " in f" {' '.join(t)} ")


@pytest.mark.parametrize("terms,k", [(["a", "rare"], 0), (["d", "e"], 1), (["c", "d", "e"], 3), (["b", "rare"], 5)])
def test_near(postings, texts, terms, k):
    assert found(postings, match.match_near(postings, terms, k)) == brute(texts, lambda t: near(t, terms, k))


def test_prefix_and_fields(postings, texts):
    assert found(postings, match.match_prefix(postings, "ra")) == brute(texts, lambda t: "rare" in t)
    both = found(postings, match.match_all(postings, ["rare"], match.ALL_FIELDS))
    assert both == brute(texts, lambda t: "rare" in t) | {"rare/path.md"}
    assert found(postings, match.match_all(postings, ["nothing", "path"], match.ALL_FIELDS)) == {"rare/path.md"}


def test_bulk_is_a_loop_of_single_queries(spark, postings):
    asked = {1: ["a"], 2: ["a", "rare"], 3: ["c", "d", "e"], 4: ["a", "missing"], 6: ["b", "b", "d"]}
    queries = spark.createDataFrame([(q, t) for q, terms in asked.items() for t in terms], "query_id bigint, term string")
    got = bulk.bulk_match_all(postings, queries, salts=3).cache()
    for q, terms in asked.items():
        one = got.filter(F.col("query_id") == q).select("file_id")
        assert found(postings, one) == found(postings, match.match_all(postings, terms)), q
        assert one.count() == one.distinct().count()


def test_bulk_search_limit(spark, files, texts):
    table = files(*[("p", path, text) for path, text in texts.items()])
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, term string")
    rows = bulk.bulk_search(build_postings(table), table, queries, limit=3).orderBy("query_id", "path").collect()
    want = lambda word: sorted(brute(texts, lambda t: word in t))[:3]
    assert [r.path for r in rows] == want("a") + want("b")


def test_contains_pairs(spark):
    rng = random.Random(3)
    values = ["".join(rng.choices("abAB.", k=rng.randint(0, 9))) for _ in range(150)] + ["x\ny z", "aaaaaa"]
    needles = ["", "a", "B", "ab", "aba", "aaa", "bab.", "ABAB", "y z", "\n", "zzz", "aaaaaaaa"]
    rows = bulk.contains_pairs(
        spark.createDataFrame([(v,) for v in values], "value string"),
        spark.createDataFrame([(n,) for n in needles], "needle string"),
        salts=3,
    ).collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == {
        (n, v.lower()) for n in needles for v in values if n.lower() in v.lower()
    }


@pytest.fixture(scope="module")
def index(corpus):
    return build_index(
        corpus(
            ("one", "a.py", "import os\nfrom lib.util import x\ndef handleClick():\n  pass\nhandle = 1\n"),
            ("two", "a.py", "def handle_click():\n  click\n" + "line\n" * 9),
            ("two", "click/b.js", "import { x } from './lib/util';\nfunction other() {\n}\n"),
            (None, "c.py", "Handle = 2\nHandle = 3\n" + "y" * 600),
        )
    )


def test_bulk_lookup_is_a_loop_of_single_lookups(spark, index):
    index = index.with_tables(symbols=index.symbols.cache(), imports=index.imports.cache())
    for limit in (1, 50):
        needles = ["handle", "click", "o"]
        got = bulk.bulk_find_symbol(
            index.symbols, spark.createDataFrame([(n,) for n in needles], "needle string"), limit
        ).collect()
        for needle in needles:
            one = lookup.find_symbol(index.symbols, needle, limit).collect()
            key = lambda r: (r.name, r.type, r.path, r.project, r.line)
            assert sorted(map(key, one), key=str) == sorted((key(r) for r in got if r.needle == needle), key=str)
        targets = ["lib", "os", ""]
        deps = bulk.bulk_dependents(
            index.imports, spark.createDataFrame([(t,) for t in targets], "target string"), limit
        ).collect()
        for target in targets:
            assert len(lookup.get_dependents(index.imports, target, limit).collect()) == sum(
                r.target == target for r in deps
            ), (target, limit)


def test_search(index):
    rows = search.search_code(index, "def").collect()
    assert [(r.project, r.path) for r in rows] == [("one", "a.py"), ("two", "a.py")]
    assert rows[1].snippet == "def handle_click():\n  click\nline\nline\nline"
    assert rows[1].content_length == len("def handle_click():\n  click\n" + "line\n" * 9)
    clipped = search.search_code(index, "handle 2 3").first()
    assert clipped.snippet.endswith("y...") and len(clipped.snippet) == 503
    assert [r.path for r in search.search_code(index, "click").collect()] == ["a.py"]
    assert [r.path for r in search.search_files(index, "click").collect()] == ["a.py", "click/b.js"]
    phrase = match.match_phrase(index.postings, ["lib", "util", "import"])
    assert [r.path for r in search.search_code(index, phrase).collect()] == ["a.py"]
    assert search.search_code(index, "def", project="nowhere").isEmpty()
    assert [r.project for r in search.search_code(index, "def", project="two").collect()] == ["two"]


def test_accents(corpus):
    rows = ("p", "a.py", "L'été à Genève"), ("p", "b.py", "ete")
    for fold, want in ((True, ["a.py", "b.py"]), (False, ["a.py"])):
        index = build_index(corpus(*rows), fold_accents=fold)
        assert [r.path for r in search.search_code(index, "ÉTÉ").collect()] == want


def test_context(index):
    rows = search.get_context(index, "handle").collect()
    assert [(r.kind, r.path, r.name, r.line) for r in rows] == [
        ("file_match", "c.py", None, None),
        ("file_match", "a.py", None, None),
        ("file_match", "a.py", None, None),
        ("symbol_match", "a.py", "handleClick", 3),
        ("symbol_match", "a.py", "handle_click", 1),
        ("symbol_match", "c.py", "Handle", 1),
        ("symbol_match", "a.py", "handle", 5),
    ]
    assert rows[0].snippet.endswith("...") and len(rows[0].snippet) == 303
    halves = search.get_context(index, "handle", limit=3).collect()
    assert [r.kind for r in halves] == ["file_match", "symbol_match"]


def test_first_rows_are_those_of_the_nested_loop(spark):
    """Needles that nearly every value has, rare ones and long digits; many files that import several matching paths."""
    rng = random.Random(8)
    digits = [str(10**11 + rng.randrange(10**9)) for _ in range(40)]
    names = [rng.choice(["Alpha", "data", "x"]) + rng.choice(["/", ".", "a/b", ""]) + rng.choice(digits + ["", "lib/Util"]) for _ in range(400)]
    rows = [(b"", f"p{rng.randrange(3)}", f"f{rng.randrange(60)}.py", "python", rng.choice(names), rng.choice([None, "n"]), "import") for _ in range(900)]
    imports = spark.createDataFrame(rows, "file_id binary, project string, path string, language string, import_path string, import_name string, import_type string").cache()
    needles = ["/", "a", "", "A/B", digits[0], digits[1][3:9], "lib/util", "nowhere", "alpha"]
    targets = spark.createDataFrame([(n,) for n in needles], "target string")
    symbols = imports.selectExpr(
        "file_id", "project", "path", "language", "import_path AS name", "coalesce(import_name, 'm') AS type", "length(path) AS line", "1 AS column", "'' AS scope"
    )
    for limit in (1, 7, None):
        got = bulk.bulk_dependents(imports, targets, limit, salts=4).collect()
        hits = bulk.bulk_find_symbol(symbols, targets.withColumnRenamed("target", "needle"), limit, salts=4).collect()
        for needle in needles:
            order = lambda r: (r[0], r[1], r[3] is not None, r[3] or "")
            want = sorted({(p, f, lang, name) for _, p, f, lang, path, name, _ in rows if needle.lower() in path.lower()}, key=order)[:limit]
            assert sorted((tuple(r)[1:] for r in got if r.target == needle), key=order) == want, (needle, limit)
            place = lambda r: (r.type, r.path, r.project, r.line, r.column, r.name)
            want = sorted(place(r) for r in symbols.filter(F.contains(F.lower("name"), F.lit(needle.lower()))).collect())[:limit]
            assert sorted(place(r) for r in hits if r.needle == needle) == want, (needle, limit)


def test_a_common_term_is_cut(spark):
    """Every file has one term, and one has most of the rows: no task of the join gets the lot."""
    postings = spark.range(40_000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS file_id", "'p' AS project", "'content' AS field", "IF(id % 10 < 9, 'the', concat('t', id % 500)) AS term", "1 AS pos")
    from lineloom.operators.hot import hot_keys, split_join

    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("the",), ("t5",), ("t77",)], "term string")
        # Splits as large as the parts that the other keys come in.
        joined = split_join(asked, postings, "term", F.col("file_id"), 256, hot_keys(postings, "term", 256))
        sizes = sorted(r["count"] for r in joined.filter("term = 'the'").groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 36_000 and len(sizes) >= 30 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bulk_lookup_derives_its_rows_once(spark, index):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    symbols = index.symbols.cache()
    needles = spark.createDataFrame([("handle",), ("o",)], "needle string")
    bulk.bulk_find_symbol(symbols.mapInArrow(run, symbols.schema), needles).collect()
    assert seen.value == symbols.count()


def test_statistics_of_a_derived_index_take_one_pass(index):
    rows = stats.index_stats(index)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_walked(") == 1
    one = rows.first()
    assert (one.indexed_files, one.total_symbols, one.total_imports) == (4, index.symbols.count(), index.imports.count())


def test_search_of_a_derived_index_makes_no_rows_of_tokens(spark, files):
    from dataclasses import replace

    from lineloom.functions.text import query_terms
    from lineloom.plans.index import index_of_files
    from lineloom.plans.search import get_context

    derived = index_of_files(
        files(
            ("p", "a/order.js", "const total = 12;\nfunction orderTwelve() {}"),
            ("p", "b.py", "order = 12\norder12 = 1"),
            ("p", "c.py", "orders 12\nÉtat = 3"),
            ("p", "c.py", "12 order"),  # a key that repeats counts as one file
            ("p", "d.ts", r"const aorder = 1; // order 120"),
            (None, "e.php", "12"),
            ("p", "f.md", "order 12"),
        )
    )
    rows = get_context(derived, "order")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(terms" not in plan
    stored = replace(derived, derived=False)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(rows, get_context(stored, "order"))
    for query in ("order 12", "État 12", "etat", "order 12 js", ""):
        for fields in (match.CONTENT, match.ALL_FIELDS):
            terms = query_terms(query)
            assert same(match.match_texts(derived.files, terms, fields), match.match_all(derived.postings, terms, fields))
