"""An index on storage, as plain parquet.

``<path>/<table>/segment=<n>`` holds what run ``n`` wrote. Files, symbols and imports lie in ranges of project and path, in
that order and in small row groups, so that a lookup reads little; ``names`` repeats files without their bodies for
listings and searches. Symbols and imports are written by one pass, as ``code/segment=<n>/table=<table>``. A run adds rows and, in
``removed``, the keys of the files it replaces or deletes in earlier segments, so its
cost follows the change and not the index. One row in ``<path>/runs``, appended last,
makes a run visible; readers never see half of one, and what a failed run left behind is
emptied by the next. ``base`` in that row is the first segment that still counts: a full write
or a clear starts a new base. There is one writer at a time.
"""

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom import schemas
from lineloom.functions.paths import file_id
from lineloom.operators.corpus import filter_kept, index_files, readable, unreadable
from lineloom.operators.derive import extract_all
from lineloom.operators.maintain import (
    TABLES,
    add_project,
    below,
    diff_files,
    latest_changes,
    project_names,
    update_projects,
    upserts_of,
)
from lineloom.operators.postings import build_postings
from lineloom.operators.ranges import into_ranges, range_bounds
from lineloom.plans.index import Index
from lineloom.plans.stats import project_stats
from lineloom.sources.tree import read_bodies

SCHEMAS = {
    "files": schemas.FILES,
    "names": schemas.NAMES,
    "code": schemas.CODE,
    "postings": schemas.POSTINGS,
    "removed": schemas.REMOVED,
    "projects": schemas.PROJECTS,
}
# Text behind one range of postings. Corpora of many terabytes are better indexed in
# several runs, which keeps the number of ranges in one shuffle moderate.
RANGE_BYTES = 256 << 20
# Row groups of files and names, and of symbols and imports.
ROW_GROUP = {"files": 8 << 20, "names": 2 << 20, "code": 2 << 20, "postings": 32 << 20}
# Text that is tokenised for the bounds of one range of postings, and the part files it is taken from.
SAMPLE_BYTES, SAMPLE_FILES = 64 << 10, 32
SEGMENT = T.StructField("segment", T.LongType())
CODE = ("symbols", "imports")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log, one row per committed run."""
    try:
        return spark.read.schema(schemas.RUNS).parquet(f"{path}/runs")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.RUNS)


def log_run(spark: SparkSession, path: str, segment: int, base: int, run_id: str | None = None,
            started_at: datetime | None = None, **counts: int) -> None:
    """Append the row that commits a run."""
    now = datetime.now(timezone.utc)
    counts = [counts.get(c, 0) for c in ("indexed", "skipped", "failed", "symbols", "imports")]
    row = (run_id or uuid.uuid4().hex, segment, base, started_at or now, now, *counts)
    spark.createDataFrame([row], schemas.RUNS).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def _last(runs: DataFrame) -> tuple[int, int]:
    """Segment and base of the last run, ``(-1, 0)`` before the first."""
    row = runs.agg(F.max(F.struct("segment", "base")).alias("last")).first()
    return (row.last.segment, row.last.base) if row.last else (-1, 0)


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    folder = "code" if table in CODE else table
    schema = T.StructType([*SCHEMAS[folder].fields, SEGMENT])
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/{folder}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.filter(F.col("table") == table) if folder == "code" else rows


def _stored(spark: SparkSession, path: str, table: str, segment: int) -> DataFrame:
    """One table of one segment."""
    folder = "code" if table in CODE else table
    rows = spark.read.schema(SCHEMAS[folder]).parquet(f"{path}/{folder}/segment={segment}")
    return rows.filter(F.col("table") == table) if folder == "code" else rows


def _next_segment(spark: SparkSession, path: str) -> tuple[int, int]:
    """Segment for a new run, emptied of what a failed run left there, and the base so far."""
    last, base = _last(read_runs(spark, path))
    for table, schema in SCHEMAS.items():
        try:
            spark.read.schema(schema).parquet(f"{path}/{table}/segment={last + 1}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            _write(spark.createDataFrame([], schema), path, table, last + 1)
    return last + 1, base


def read_index(spark: SparkSession, path: str, fold_accents: bool = True) -> Index:
    """The index as of the last committed run; ``fold_accents`` as it was written.

    Only while there are segments after the base does a read check for replaced files;
    ``compact_index`` folds them in.
    """
    runs = read_runs(spark, path)
    last, base = _last(runs)
    live = F.col("segment").between(base, last)
    removed = (
        _table(spark, path, "removed")
        .filter(live)
        .groupBy("file_id")
        .agg(F.max("segment").alias("removed_in"))
    )

    def table(name: str) -> DataFrame:
        rows = _table(spark, path, name).filter(live)
        if last > base:
            replaced = (rows["file_id"] == removed["file_id"]) & (F.col("segment") < F.col("removed_in"))
            rows = rows.join(removed, replaced, "left_anti")
        return rows.select(*COLUMNS[name])

    projects = _table(spark, path, "projects").filter(F.col("segment") <= last)
    newest = projects.agg(F.max("segment")).scalar()
    return Index(
        **{name: table(name) for name in TABLES},
        projects=projects.filter(F.col("segment") == newest).drop("segment"),
        runs=runs,
        fold_accents=fold_accents,
        narrow=table("names"),
    )


COLUMNS = {"symbols": schemas.SYMBOLS.names, "imports": schemas.IMPORTS.names} | {t: s.names for t, s in SCHEMAS.items()}


def _write(df: DataFrame, path: str, table: str, segment: int) -> None:
    """Write one table of a segment, over whatever a failed run left there."""
    rows = df.select(*SCHEMAS[table].names)
    writer = rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP.get(table, 128 << 20))
    if table == "code":
        writer = writer.partitionBy("table")
    writer.parquet(f"{path}/{table}/segment={segment}")


def _pieces(spark: SparkSession, size: int) -> int:
    """Number of ranges for so much text."""
    return max(-(-size // RANGE_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20), 1)


PLACE = ("project", "path")


def _write_files(files: DataFrame, keys: DataFrame, path: str, segment: int, partitions: int | None) -> list[list]:
    """Write the files of a segment in ranges of project and path, then their names; gives the bounds of the ranges.

    ``keys(project, path, file_size)`` are about those of the files; only they are read for the bounds.
    """
    spark = files.sparkSession
    keys = keys.select(*PLACE, F.col("file_size").cast("bigint"))
    if partitions is None:
        partitions = _pieces(spark, keys.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0])
    bounds = range_bounds(keys, partitions, "file_size")
    ranged = into_ranges(files, [F.col(c) for c in PLACE], bounds).sortWithinPartitions(*PLACE)
    _write(ranged, path, "files", segment)
    names = _stored(spark, path, "files", segment).drop("content")
    _write(into_ranges(names, [F.col(c) for c in PLACE], _thinned(bounds, 8)).sortWithinPartitions(*PLACE), path, "names", segment)
    return bounds


def _thinned(bounds: list[list], times: int) -> list[list]:
    """Bounds for a table that is so many times smaller; some for the cores stay."""
    return bounds[:: max(min(times, len(bounds) // 8), 1)]


def _posting_bounds(files: DataFrame, fold_accents: bool, ranges: int) -> list[list]:
    """Bounds of term and file, from the tokens of some files of some of the part files, spread evenly."""
    if ranges < 2:
        return []
    parts = sorted(files.inputFiles())
    chosen = parts[:: -(-len(parts) // SAMPLE_FILES)]
    some = files.sparkSession.read.schema(schemas.FILES).parquet(*chosen)
    size = some.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    every = max(size // (ranges * SAMPLE_BYTES), 1)
    some = some.filter(F.pmod(F.xxhash64("file_id"), F.lit(every)) == 0)
    tokens = build_postings(some, fold_accents).select("term", F.hex("file_id").alias("file"), F.concat("field", F.col("pos").cast("string")).alias("at"))
    return [bound[:2] for bound in range_bounds(tokens, ranges)]


def _write_derived(spark: SparkSession, path: str, segment: int, fold_accents: bool, partitions: int | None, bounds: list[list]) -> None:
    """Derive the other tables from the stored files of a segment, each file's text once for the code and once for the postings."""
    files = _stored(spark, path, "files", segment)
    code = into_ranges(extract_all(files), [F.col(c) for c in PLACE], _thinned(bounds, 4))
    _write(code.sortWithinPartitions("table", *PLACE, "line", "import_path"), path, "code", segment)
    if partitions is None:
        partitions = _pieces(spark, files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0])
    _write_postings(build_postings(files, fold_accents), _posting_bounds(files, fold_accents, partitions), path, segment)


def _write_postings(postings: DataFrame, bounds: list[list], path: str, segment: int) -> None:
    """Postings by term, so a lookup opens few files; by file within a term, so that a term found in every file is
    cut into many ranges."""
    ranged = into_ranges(postings, [F.col("term"), F.hex("file_id")], bounds)
    _write(ranged.sortWithinPartitions("term", "file_id", "field", "pos"), path, "postings", segment)


def _count(spark: SparkSession, path: str, table: str, segment: int) -> int:
    return _stored(spark, path, table, segment).count()


def _counts(spark: SparkSession, path: str, segment: int) -> dict[str, int]:
    code = {r.table: r["count"] for r in spark.read.schema(schemas.CODE).parquet(f"{path}/code/segment={segment}").groupBy("table").count().collect()}
    return {"indexed": _count(spark, path, "names", segment), **{t: code.get(t, 0) for t in CODE}}


def write_index(index: Index, path: str, partitions: int | None = None) -> int:
    """Write a whole index as a new base; gives its segment number."""
    spark = index.files.sparkSession
    started = datetime.now(timezone.utc)
    segment, _ = _next_segment(spark, path)
    bounds = _write_files(index.files, index.names, path, segment, partitions)
    code = [getattr(index, t).withColumn("table", F.lit(t)) for t in CODE]
    code = into_ranges(code[0].unionByName(code[1], allowMissingColumns=True), [F.col(c) for c in PLACE], _thinned(bounds, 4))
    _write(code.sortWithinPartitions("table", *PLACE, "line", "import_path"), path, "code", segment)
    _write_postings(index.postings, _posting_bounds(_stored(spark, path, "files", segment), index.fold_accents, len(bounds) + 1), path, segment)
    if index.projects is not None:
        _write(index.projects, path, "projects", segment)
    log_run(spark, path, segment, segment, started_at=started, **_counts(spark, path, segment))
    return segment


def index_corpus(
    corpus: DataFrame,
    path: str,
    projects: DataFrame | None = None,
    fold_accents: bool = True,
    partitions: int | None = None,
    **rule,
) -> int:
    """Index a whole corpus as a new base, the way to store a first index.

    ``corpus`` has the files, or is a listing of ``list_trees``, whose bodies are then read. Keys and sizes are read first,
    for the ranges; the bodies once, and everything else is derived from the stored copy. Rows with an ``error`` are counted as failed
    and not indexed. ``partitions`` is the number of ranges, by size if not given. ``rule`` says
    which files are held, as for ``filter_kept``; later runs take the same.
    """
    spark = corpus.sparkSession
    started = datetime.now(timezone.utc)
    segment, _ = _next_segment(spark, path)
    if "content" not in corpus.columns:
        corpus = _staged(corpus, path, "listing")
    failed = unreadable(corpus).count() if "error" in corpus.columns else 0
    kept = filter_kept(readable(corpus), **rule)
    size = F.col("file_size") if "file_size" in corpus.columns else F.octet_length("content")
    keys = kept.select(*PLACE, size.alias("file_size"))
    listed = "content" not in corpus.columns
    if listed:
        kept = read_bodies(kept, partitions)
    bounds = _write_files(index_files(readable(kept)), keys, path, segment, partitions)
    _write_derived(spark, path, segment, fold_accents, partitions, bounds)
    if projects is not None:
        _write(projects, path, "projects", segment)
    counts = _counts(spark, path, segment)
    if listed:
        failed += keys.count() - counts["indexed"]
    log_run(spark, path, segment, segment, started_at=started, failed=failed, **counts)
    return segment


def _staged(df: DataFrame, path: str, name: str) -> DataFrame:
    """Rows that a run needs several times, stored; the next run writes over them."""
    df.write.mode("overwrite").parquet(f"{path}/staged/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/staged/{name}")


def compact_index(spark: SparkSession, path: str, partitions: int | None = None) -> int:
    """Fold all segments of an index into one."""
    return write_index(read_index(spark, path), path, partitions)


def clear_index(spark: SparkSession, path: str) -> None:
    """Empty files, symbols, imports and text index; projects stay."""
    segment, _ = _next_segment(spark, path)
    for table in ("files", "names", "code", "postings"):
        _write(spark.createDataFrame([], SCHEMAS[table]), path, table, segment)
    log_run(spark, path, segment, segment)


def commit_changes(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    run_id: str | None = None,
    fold_accents: bool = True,
    partitions: int | None = None,
    rule: dict | None = None,
    **counts: int,
) -> int | None:
    """Add a change feed to a stored index as one run; the last change of a path wins.

    With a ``run_id`` that was committed before, nothing happens: a restarted stream may
    hand in the same batch twice. ``rule`` has the options of ``filter_kept``.
    """
    started = datetime.now(timezone.utc)
    runs = read_runs(spark, path)
    if run_id and not runs.filter(F.col("run_id") == run_id).isEmpty():
        return None
    segment, base = _next_segment(spark, path)
    touched = changes.select(file_id(F.col("project"), F.col("path")).alias("file_id")).distinct()
    _write(touched, path, "removed", segment)
    keys = changes.select(*PLACE, (F.col("file_size") if "file_size" in changes.columns else F.octet_length("content")).alias("file_size"))
    bounds = _write_files(upserts_of(latest_changes(changes), **(rule or {})), keys, path, segment, partitions)
    _write_derived(spark, path, segment, fold_accents, partitions, bounds)
    found = _counts(spark, path, segment)
    log_run(spark, path, segment, base, run_id, started, **{**counts, **found, "indexed": counts.get("indexed", found["indexed"])})
    return segment


def remove_stored_project(spark: SparkSession, path: str, project: str) -> int:
    """Take a project, given by name or folder, out of a stored index."""
    started = datetime.now(timezone.utc)
    index = read_index(spark, path)
    segment, base = _next_segment(spark, path)
    name = F.broadcast(project_names(index.projects, project))
    _write(index.names.join(name, "project", "left_semi"), path, "removed", segment)
    rest = index.projects.join(name, F.col("name") == F.col("project"), "left_anti")
    _write(rest, path, "projects", segment)
    log_run(spark, path, segment, base, started_at=started)
    return segment


def reindex_all(
    spark: SparkSession,
    path: str,
    scan: DataFrame,
    prune: bool = False,
    fold_accents: bool = True,
    folders: dict[str, str] | None = None,
    partitions: int | None = None,
    **rule,
) -> int:
    """Bring a stored index up to a scan of all its projects, in one run.

    ``scan`` is a corpus, or a listing of ``list_trees``: then only files that are new or changed
    are opened. What differs is stored once, by key, and everything else follows from that. Files
    with an ``error`` are counted as failed and left as they were; with ``prune``, what lies below a
    folder with an error is not taken for gone. ``folders`` registers ``{project: folder}``; status
    and times change for the projects of the scan and of ``folders``. ``rule`` as for ``filter_kept``.
    """
    started = datetime.now(timezone.utc)
    index = read_index(spark, path, fold_accents)
    segment, base = _next_segment(spark, path)
    if "error" not in scan.columns:
        scan = scan.withColumn("error", F.lit(None).cast("string"))
    if "content" not in scan.columns:
        # Listed once: what follows must not see different states of the trees.
        scan = _staged(scan, path, "listing")
    failed = F.col("error").isNotNull()
    kept = filter_kept(scan.filter(~failed), **rule)
    known = diff_files(scan.select("project", "path", "last_modified"), index.names)
    wanted = kept.select("project", "path").withColumn("kept", F.lit(True))
    troubled = scan.filter(failed).select("project", "path").withColumn("failed", F.lit(True))
    keyed = lambda df, *more: df.select(file_id(F.col("project"), F.col("path")).alias("file_id"), *more)
    diff = (
        keyed(known, "project", "path", "status")
        .join(keyed(wanted, "kept"), "file_id", "left")
        .join(keyed(troubled, "failed"), "file_id", "left")
    )
    status = (
        F.when(F.col("failed"), "failed")
        .when((F.col("status") == "missing") | F.col("kept"), F.col("status"))
        .otherwise("missing")
    )
    diff = _staged(diff.select("file_id", "project", "path", status.alias("status")), path, "diff")

    fresh = kept.withColumn("file_id", file_id(F.col("project"), F.col("path"))).join(
        diff.filter(F.col("status").isin("new", "changed")).select("file_id"), "file_id", "left_semi"
    )
    keys = fresh.select(*PLACE, "file_size")
    if "content" not in scan.columns:
        fresh = readable(read_bodies(fresh, partitions))
    bounds = _write_files(index_files(fresh), keys, path, segment, partitions)
    stored = _stored(spark, path, "names", segment).select("file_id")
    removed = stored
    if prune:
        missing = diff.filter(F.col("status") == "missing").select("file_id", "project", "path")
        # Failed rows are few; folders among them shield what lies below.
        hidden = below(missing, diff.filter(F.col("status") == "failed").select("project", "path"))
        removed = removed.unionByName(missing.join(hidden, "file_id", "left_anti").select("file_id"))
    _write(removed, path, "removed", segment)
    _write_derived(spark, path, segment, fold_accents, partitions, bounds)

    by_status = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    due = by_status.get("new", 0) + by_status.get("changed", 0)
    counts = _counts(spark, path, segment)
    counts |= {"skipped": by_status.get("skipped", 0), "failed": by_status.get("failed", 0) + due - counts["indexed"]}
    projects = index.projects
    for name, folder in (folders or {}).items():
        projects = add_project(projects, folder, name)
    gone_now = _stored(spark, path, "removed", segment)
    after = {
        t: getattr(index, t).join(gone_now, "file_id", "left_anti").select("project").unionByName(_stored(spark, path, t, segment).select("project"))
        for t in ("names", "symbols")
    }
    touched = diff.filter(F.col("status") != "missing").select("project")
    if folders:
        touched = touched.unionByName(spark.createDataFrame([(n,) for n in folders], "project string"))
    stats = project_stats(after["names"], after["symbols"])
    _write(update_projects(projects, stats, datetime.now(timezone.utc), touched), path, "projects", segment)
    log_run(spark, path, segment, base, started_at=started, **counts)
    return segment
