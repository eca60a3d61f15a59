"""Lookups: symbols, files, imports, dependents, listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.text import file_lines, name_contains, name_starts_with
from lineloom.operators.corpus import for_project


def find_symbol(
    symbols: DataFrame,
    name: str,
    limit: int = 50,
    project: str | None = None,
    projects: DataFrame | None = None,
    mode: str = "contains",
    wildcards: bool = False,
) -> DataFrame:
    """Symbols whose name contains (``mode='prefix'``: starts with) a text, by type and path."""
    hit = (
        name_starts_with(F.col("name"), name)
        if mode == "prefix"
        else name_contains(F.col("name"), name, wildcards)
    )
    return (
        for_project(symbols, project, projects)
        .filter(hit)
        .orderBy("type", "path", "project", "line", "column", "name")
        .limit(limit)
        .select("name", "type", "path", "language", "project", "line", "column", "scope")
    )


def _at(df: DataFrame, path: str, project: str | None) -> DataFrame:
    found = df.filter(F.col("path") == path)
    return found.filter(F.col("project") == project) if project else found


def get_file(files: DataFrame, path: str, project: str | None = None) -> DataFrame:
    """Numbered lines of a file, each with the file's language, size and line count."""
    rows = file_lines(F.col("content"))
    return _at(files, path, project).select(
        "project",
        "path",
        "language",
        F.col("file_size").alias("size"),
        F.size(rows).alias("lines"),
        F.posexplode(rows).alias("at", "content"),
    ).select(
        "project", "path", "language", "size", "lines", (F.col("at") + 1).alias("line_number"), "content"
    )


def get_imports(imports: DataFrame, path: str, project: str | None = None) -> DataFrame:
    """Imports of a file, by import path."""
    return (
        _at(imports, path, project)
        .orderBy("import_path", "import_name", "project")
        .select("project", "import_path", "import_name", "import_type")
    )


def get_dependents(
    imports: DataFrame, target: str, limit: int = 50, wildcards: bool = False
) -> DataFrame:
    """Distinct files and names that import a path containing the target text."""
    return (
        imports.filter(name_contains(F.col("import_path"), target, wildcards))
        .select("project", "path", "language", "import_name")
        .distinct()
        .orderBy("path", "project", "import_name")
        .limit(limit)
    )


def list_files(
    files: DataFrame,
    language: str | None = None,
    limit: int = 100,
    project: str | None = None,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Files by path, optionally of one language or project."""
    rows = for_project(files, project, projects)
    if language:
        rows = rows.filter(F.col("language") == language)
    return rows.orderBy("path", "project").limit(limit).select("path", "language", "file_size", "project")
