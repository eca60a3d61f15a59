"""Counts and listings of the dashboard."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators.derive import extract_all
from lineloom.plans.index import Index

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def index_stats(index: Index) -> DataFrame:
    """One row: files, symbols, imports, and the size of all content in MB."""
    if index.derived:
        # One pass over the texts for both.
        found = extract_all(index.files).agg(*[F.count_if(F.col("table") == t).alias(f"total_{t}") for t in ("symbols", "imports")])
    else:
        symbols, imports = (
            getattr(index, t).agg(F.count("*").alias(f"total_{t}")) for t in ("symbols", "imports")
        )
        found = symbols.crossJoin(imports)
    files = index.files.agg(F.count("*").alias("indexed_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    # One row each.
    return files.crossJoin(found).select(
        "indexed_files", "total_symbols", "total_imports", F.round(F.col("bytes") / (1024 * 1024), 2).alias("size_mb")
    )


def language_breakdown(files: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """Files and symbols per language, most files first."""
    counted = symbols.groupBy("language").agg(F.count("*").alias("symbols"))
    rows = (
        files.groupBy("language")
        .agg(F.count("*").alias("file_count"))
        .join(counted, "language", "left")
        .select("language", "file_count", F.coalesce("symbols", F.lit(0)).alias("symbol_count"))
        .orderBy(F.desc("file_count"), "language")
    )
    return rows if limit is None else rows.limit(limit)


def symbols_by_type(symbols: DataFrame) -> DataFrame:
    """Symbols per type, most frequent first."""
    return symbols.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def recent_files(files: DataFrame, limit: int = 100, language: str | None = None) -> DataFrame:
    """Most recently modified files with their size in KB."""
    rows = files.filter(F.col("language") == language) if language else files
    return (
        rows.orderBy(F.desc("last_modified"), "path", "project")
        .limit(limit)
        .select(
            "project",
            "path",
            "language",
            F.round(F.col("file_size") / 1024, 2).alias("size_kb"),
            F.col("last_modified").alias("modified_at"),
        )
    )


def index_activity(files: DataFrame, runs: DataFrame, limit: int = 10) -> DataFrame:
    """Latest files, each next to the time the last run finished."""
    return recent_files(files, limit).select(
        runs.agg(F.max("finished_at")).scalar().alias("last_indexed"),
        "project",
        "path",
        "language",
        "modified_at",
    )


def list_projects(projects: DataFrame) -> DataFrame:
    """Projects by name with their counts and the ISO time of the last run."""
    return projects.orderBy("name", "folder_path").select(
        "name",
        F.col("folder_path").alias("folder"),
        "status",
        F.col("file_count").alias("files"),
        F.col("symbol_count").alias("symbols"),
        F.date_format("last_indexed", ISO).alias("last_indexed"),
    )


def project_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols per project, also for files without one."""
    counted = symbols.groupBy("project").agg(F.count("*").alias("symbols"))
    totals = files.groupBy("project").agg(F.count("*").alias("file_count"))
    return totals.join(counted, totals["project"].eqNullSafe(counted["project"]), "left").select(
        totals["project"], "file_count", F.coalesce("symbols", F.lit(0)).alias("symbol_count")
    )
