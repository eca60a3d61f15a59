"""Keeping an index fresh: what changed, and the tables after the change."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.paths import file_id, file_name
from lineloom.operators.corpus import filter_kept, index_files, readable, unreadable
from lineloom.plans.index import Index, index_of_files

TABLES = ("files", "symbols", "imports", "postings")


def diff_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    """``(project, path, status)`` of a scan against an index.

    Status is ``new``, ``changed`` (another modification second, earlier or later),
    ``skipped`` (the same) or ``missing`` (indexed, but not in the scan). Only keys and
    times take part in the join, no file bodies.
    """
    found = scan.select(
        file_id(F.col("project"), F.col("path")).alias("file_id"),
        F.col("project").alias("found_project"),
        F.col("path").alias("found_path"),
        F.date_trunc("second", F.col("last_modified")).alias("found_time"),
    )
    known = files.select("file_id", "project", F.col("path"), F.col("last_modified").alias("known_time"))
    status = (
        F.when(F.col("path").isNull(), "new")
        .when(F.col("found_path").isNull(), "missing")
        .when(F.col("found_time").eqNullSafe(F.col("known_time")), "skipped")
        .otherwise("changed")
    )
    return found.join(known, "file_id", "full_outer").select(
        F.when(F.col("path").isNull(), F.col("found_project")).otherwise(F.col("project")).alias("project"),
        F.coalesce("path", "found_path").alias("path"),
        status.alias("status"),
    )


def below(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files ``(project, path, ...)`` that lie below one of ``folders`` ``(project, path)``; ``""`` is the root."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = folders.select(F.col("project").alias("_project"), F.col("path").alias("_folder")).distinct()
    same = F.col("_project").eqNullSafe(F.col("project")) & (F.col("_folder") == F.col("_parent"))
    return files.withColumn("_parent", F.explode(parents)).join(held, same, "left_semi").drop("_parent").distinct()


def changes_of_scan(scan: DataFrame, files: DataFrame, prune: bool = False) -> DataFrame:
    """The scan as a change feed against the index: ``add``, ``change``, and with
    ``prune`` also ``unlink`` for indexed files that are gone.

    Rows of the scan with an ``error`` are no files: what the index has under their path, and below it, stays as it was.
    """
    failed = unreadable(scan)
    scan = readable(scan)
    diff = diff_files(scan, files).select(
        file_id(F.col("project"), F.col("path")).alias("file_id"), "project", "path", "status"
    )
    keyed = scan.withColumn("file_id", file_id(F.col("project"), F.col("path")))
    changed = keyed.join(diff.filter(F.col("status").isin("new", "changed")).select("file_id", "status"), "file_id").select(
        "project",
        "path",
        F.when(F.col("status") == "new", "add").otherwise("change").alias("action"),
        F.col("last_modified").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        "content",
        *([F.col("file_size")] if "file_size" in scan.columns else []),
    )
    if not prune:
        return changed
    missing = diff.filter(F.col("status") == "missing").drop("status")
    key = file_id(F.col("project"), F.col("path")).alias("file_id")
    hidden = below(missing, failed).select("file_id").unionByName(failed.select(key))
    missing = missing.join(hidden, "file_id", "left_anti")
    gone = files.join(missing, "file_id", "left_semi").select(
        "project",
        "path",
        F.lit("unlink").alias("action"),
        F.col("last_modified").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("content"),
    )
    return changed.unionByName(gone, allowMissingColumns=True)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path by time, then sequence number.

    ``file_size`` is an optional column of a feed, for bodies that are not stored byte by byte.
    """
    size = [F.col("file_size").cast("bigint").alias("file_size")] if "file_size" in changes.columns else []
    last = F.struct(F.col("ts"), F.coalesce("seq", F.lit(0)).alias("seq"), "action", "content", *size)
    return changes.groupBy("project", "path").agg(F.max(last).alias("last")).select("project", "path", "last.*")


def upserts_of(changes: DataFrame, **rule) -> DataFrame:
    """Rows of ``files`` that added and changed paths get; ``rule`` as for ``filter_kept``."""
    octets = F.octet_length("content").cast("bigint")
    size = F.coalesce(F.col("file_size").cast("bigint"), octets) if "file_size" in changes.columns else octets
    kept = filter_kept(changes.filter(F.col("action").isin("add", "change")), **rule)
    return index_files(kept.select("project", "path", "content", F.col("ts").alias("last_modified"), size.alias("file_size")))


def apply_changes(index: Index, changes: DataFrame, **rule) -> Index:
    """The index after a change feed ``(project, path, action, ts, seq, content[, file_size])``.

    Rows of every touched file leave all tables; added and changed files come back
    freshly derived. The last change of a path wins. ``rule`` says which files are held, as
    for ``filter_kept``.
    """
    last = latest_changes(changes)
    touched = last.select(file_id(F.col("project"), F.col("path")).alias("file_id"))
    fresh = index_of_files(upserts_of(last, **rule), index.fold_accents)
    return index.with_tables(
        **{
            t: getattr(index, t).join(touched, "file_id", "left_anti").unionByName(getattr(fresh, t))
            for t in TABLES
        }
    )


def refresh(index: Index, scan: DataFrame, prune: bool = False, **rule) -> Index:
    """Re-index what a scan shows as new or changed; ``prune`` also drops what is gone."""
    return apply_changes(index, changes_of_scan(scan, index.files, prune), **rule)


def add_project(projects: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """Projects with one more folder; a folder that is registered stays as it is.

    A project is told apart by its name, which is the key of its rows in all tables. Where another folder
    has that name already, the folder's whole path is taken, so that ``/a/app`` and ``/b/app`` stay apart.
    """
    spark = projects.sparkSession
    folder = folder.rstrip("/") or "/"
    wanted = F.coalesce(F.lit(name), file_name(F.lit(folder)))
    taken = projects.filter((F.col("name") == wanted) & (F.col("folder_path") != folder)).agg(F.count("*")).scalar() > 0
    row = spark.range(1).select(
        F.when(taken, folder).otherwise(wanted).alias("name"),
        F.lit(folder).alias("folder_path"),
        F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("file_count"),
        F.lit(0).cast("bigint").alias("symbol_count"),
        F.lit(None).cast("timestamp").alias("last_indexed"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )
    known = projects.filter(F.col("folder_path") == folder).select("folder_path")
    return projects.unionByName(row.join(known, "folder_path", "left_anti"))


def project_names(projects: DataFrame, project: str) -> DataFrame:
    """Name of the project given by name or folder; one row at most."""
    return (
        projects.filter((F.col("name") == project) | (F.col("folder_path") == project))
        .orderBy("folder_path")
        .limit(1)
        .select(F.col("name").alias("project"))
    )


def remove_project(index: Index, project: str) -> Index:
    """The index without a project, given by name or folder, and without all its rows."""
    if index.projects is None:
        gone = F.col("project").eqNullSafe(F.lit(project))
        return index.with_tables(**{t: getattr(index, t).filter(~gone) for t in TABLES})
    name = F.broadcast(project_names(index.projects, project))
    left = {t: getattr(index, t).join(name, "project", "left_anti") for t in TABLES}
    rest = index.projects.join(name, F.col("name") == F.col("project"), "left_anti")
    return index.with_tables(projects=rest, **left)


def update_projects(projects: DataFrame, stats: DataFrame, finished_at, touched: DataFrame | None = None) -> DataFrame:
    """Projects after a run: counts of ``project_stats``; status and times only of the projects
    ``touched`` by it (column ``project``), or of all."""
    counted = stats.withColumnsRenamed(
        {"project": "name", "file_count": "new_files", "symbol_count": "new_symbols"}
    )
    done = F.lit(finished_at).cast("timestamp")
    rows = projects.join(counted, "name", "left").withColumn("_in", F.lit(True))
    if touched is not None:
        names = touched.select(F.col("project").alias("name"), F.lit(True).alias("_in")).filter("name IS NOT NULL").distinct()
        rows = rows.drop("_in").join(names, "name", "left")
    inside = F.coalesce("_in", F.lit(False))
    return rows.select(
        "name",
        "folder_path",
        F.when(inside, "indexed").otherwise(F.col("status")).alias("status"),
        F.coalesce("new_files", F.lit(0)).alias("file_count"),
        F.coalesce("new_symbols", F.lit(0)).alias("symbol_count"),
        F.when(inside, done).otherwise(F.col("last_indexed")).alias("last_indexed"),
        "created_at",
        F.when(inside, done).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def run_summary(diff: DataFrame, symbols: DataFrame, imports: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: files indexed, skipped and failed in a run, and the symbols and imports
    of the files that were indexed.

    ``failed`` has the ``(project, path)`` that could not be read.
    """
    key = file_id(F.col("project"), F.col("path")).alias("file_id")
    rows = diff.select(key, "status")
    if failed is not None:
        bad = failed.select(key.alias("file_id"), F.lit(True).alias("bad"))
        rows = rows.join(bad, "file_id", "left").select(
            "file_id", F.when(F.col("bad"), "failed").otherwise(F.col("status")).alias("status")
        )
    indexed = rows.filter(F.col("status").isin("new", "changed"))
    one = lambda df: df.join(indexed, "file_id", "left_semi").agg(F.count("*")).scalar()
    return rows.agg(
        F.count_if(F.col("status").isin("new", "changed")).alias("indexed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).select("*", one(symbols).alias("symbols"), one(imports).alias("imports"))
