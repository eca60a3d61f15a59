"""What a stored index reads for a lookup, and how often a run looks at a text."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lineloom.plans import lookup, search
from lineloom.plans.index import build_index
from lineloom.schemas import PROJECTS
from lineloom.sources import store
from lineloom.sources.table import corpus_from_table

FILES = 14_000


@pytest.fixture(scope="module")
def corpus(spark):
    """Files of eight projects, dealt in no order, too random to shrink much."""
    rows = spark.range(FILES).select(F.pmod(F.xxhash64("id"), F.lit(FILES)).alias("at"), "id").orderBy(F.xxhash64("at"))
    noise = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(i)), 256) for i in range(3)])
    body = F.concat(F.lit("import lib_"), F.col("id") % 7, F.lit("\ndef f_"), F.col("id"), F.lit("():\n    return '"), noise, F.lit("'\n"))
    return corpus_from_table(
        rows,
        path=F.concat(F.lit("dir"), F.col("id") % 50, F.lit("/file_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".py")),
        content=body,
        project=F.concat(F.lit("project_"), F.col("id") % 8),
        last_modified=F.timestamp_seconds(F.lit(1704067200) + F.col("id")),
    )


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "index")
    now = datetime(2024, 1, 1)
    projects = spark.createDataFrame([(f"project_{i}", f"/src/{i}", "indexed", 0, 0, now, now, now) for i in range(8)], PROJECTS)
    whole = dict(store.ROW_GROUP)
    store.ROW_GROUP |= dict.fromkeys(store.ROW_GROUP, 10_000)
    try:
        store.index_corpus(corpus, path, projects, partitions=8)
    finally:
        store.ROW_GROUP.update(whole)
    return path


def row_groups(path):
    import glob

    import pyarrow.parquet as pq

    return sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def scanned(df):
    """Rows of the result, and rows that its scans of stored tables gave."""
    rows = df.collect()
    found, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        elif plan.nodeName().startswith("Scan parquet"):
            found += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.length())]
    return rows, found


def test_lookups_read_little(spark, stored, corpus):
    for table in ("files", "names", "code"):
        assert row_groups(f"{stored}/{table}/segment=0") >= (100 if table == "files" else 30)
    index, fresh = store.read_index(spark, stored), build_index(corpus)
    path = "dir17/file_001017.py"
    # A path may be in every project: two row groups of each at most. With its project it is in one place.
    for got, want, few in (
        (lookup.get_file(index.files, path), lookup.get_file(fresh.files, path), 1_600),
        (lookup.get_file(index.files, path, "project_1"), lookup.get_file(fresh.files, path, "project_1"), 300),
        (lookup.get_imports(index.imports, path), lookup.get_imports(fresh.imports, path), FILES // 4),
        (lookup.get_imports(index.imports, path, "project_1"), lookup.get_imports(fresh.imports, path, "project_1"), FILES // 12),
    ):
        rows, read = scanned(got)
        assert rows == want.collect() and rows and 0 < read <= few, read
    # A project is an eighth of all; its name is looked up in a table of its own.
    got = lookup.list_files(index.names, limit=20, project="/src/3", projects=index.projects)
    rows, read = scanned(got)
    assert rows == lookup.list_files(fresh.files, limit=20, project="project_3").collect() and len(rows) == 20
    assert FILES // 8 <= read < FILES // 4, read


def test_rows_of_the_stored_index(spark, stored, corpus):
    index, fresh = store.read_index(spark, stored), build_index(corpus)
    key = lambda df: df.select(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(30,0)")), F.count("*")).first()
    for table in ("files", "symbols", "imports", "postings"):
        assert key(getattr(index, table)) == key(getattr(fresh, table)), table
    assert key(index.names) == key(fresh.names)
    ends = index.files.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("project", "path")).alias("a"), F.max(F.struct("project", "path")).alias("b"))
    ends = sorted((tuple(r.a), tuple(r.b)) for r in ends.collect())
    assert len(ends) == 8 and all(one[1] < two[0] for one, two in zip(ends, ends[1:]))


def test_each_text_is_tokenised_once(spark, corpus, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    real = store.build_postings

    def counting(files, *more):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return real(files.mapInArrow(run, files.schema), *more)

    monkeypatch.setattr(store, "build_postings", counting)
    monkeypatch.setattr(store, "SAMPLE_BYTES", 5_000)
    some = corpus.filter("file_size > 0")
    path = str(tmp_path / "index")
    store.index_corpus(some, path, partitions=4)
    # Once for the postings, and the sample for their bounds.
    assert FILES <= seen.value < FILES * 1.1
    sizes = [r["count"] for r in store.read_index(spark, path).postings.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_search_in_the_stored_index(spark, stored, corpus):
    index, fresh = store.read_index(spark, stored), build_index(corpus)
    for query, project in (("lib_3", None), ("lib_3", "project_5"), ("f_77 return", None), ("nothing_here", None), ("lib_1", "/src/2")):
        name = {"/src/2": "project_2"}.get(project, project)
        got = search.search_code(index, query.replace("_", " "), 20, project).collect()
        assert got == search.search_code(fresh, query.replace("_", " "), 20, name).collect()
    none = fresh.with_tables(files=fresh.files.withColumn("project", F.lit(None).cast("string")))
    assert len(search.search_code(none, "return", 5).collect()) == 5


def test_failed_rows_are_left_alone(spark, corpus, tmp_path):
    from lineloom.operators import maintain

    path = str(tmp_path / "index")
    some = corpus.filter("path LIKE 'dir1/%'")
    extra = lambda *rows: spark.createDataFrame(rows, "project string, path string, content string, last_modified timestamp, file_size bigint, error string")
    good = some.withColumn("error", F.lit(None).cast("string"))
    with_errors = good.unionByName(extra(("project_1", "bad.py", None, None, None, "denied"), ("project_1", "closed", None, None, None, "denied")))
    store.index_corpus(with_errors, path)
    assert store.read_index(spark, path).files.count() == some.count() == build_index(with_errors).files.count()
    assert store.read_runs(spark, path).first().failed == 2
    # An unreadable file and folder, seen by a later scan: nothing is replaced, nothing below is pruned.
    index = build_index(some)
    later = good.filter("path <> 'dir1/file_000001.py'").limit(3)
    errors = extra(("project_1", "dir1/file_000001.py", None, None, None, "denied"), ("project_3", "dir1", None, None, None, "denied"))
    after = maintain.refresh(index, later.unionByName(errors), prune=True)
    left = {(r.project, r.path) for r in after.files.collect()}
    before = {(r.project, r.path) for r in some.collect()}
    want = {(r.project, r.path) for r in later.collect()} | {k for k in before if k[0] == "project_3"} | {("project_1", "dir1/file_000001.py")}
    assert left == want and after.files.filter("content IS NULL").isEmpty()
