"""Filters and projections on a corpus of files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions import paths, text


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", paths.language_of(F.col("path")))


def filter_supported(
    files: DataFrame, languages: tuple[str, ...] = paths.SUPPORTED_LANGUAGES
) -> DataFrame:
    """Keep files in a supported language, found by extension if not yet a column."""
    known = F.col("language") if "language" in files.columns else paths.language_of(F.col("path"))
    return files.filter(known.isin(*languages))


def filter_excluded(
    files: DataFrame,
    names: tuple[str, ...] = paths.EXCLUDED_DIRECTORIES,
    suffixes: tuple[str, ...] = (),
) -> DataFrame:
    """Drop files below hidden or excluded directories, or with one of ``suffixes``."""
    return files.filter(~paths.excluded(F.col("path"), names, suffixes))


def filter_kept(
    files: DataFrame,
    languages: tuple[str, ...] | None = None,
    names: tuple[str, ...] = paths.EXCLUDED_DIRECTORIES,
    suffixes: tuple[str, ...] = (),
) -> DataFrame:
    """The one rule of what an index holds, for full and incremental runs alike.

    Files outside of hidden and excluded directories, without one of ``suffixes``, in one of
    ``languages``; ``None`` keeps every language.
    """
    kept = files if languages is None else filter_supported(files, languages)
    return filter_excluded(kept, names, suffixes)


def readable(corpus: DataFrame) -> DataFrame:
    """The rows of a corpus or listing that are files: those without an ``error``, where there is that column."""
    return corpus.filter(F.col("error").isNull()) if "error" in corpus.columns else corpus


def unreadable(corpus: DataFrame) -> DataFrame:
    """``(project, path)`` of the files and folders that could not be read."""
    if "error" not in corpus.columns:
        return corpus.select("project", "path").limit(0)
    return corpus.filter(F.col("error").isNotNull()).select("project", "path")


def for_project(df: DataFrame, project: str | None, projects: DataFrame | None = None) -> DataFrame:
    """Rows of one project, given by name or folder path; all rows for ``None``.

    The name is looked up first, as a single value that the scan gets as its filter: a stored table
    ordered by project is read only where the project is.
    """
    if not project:
        return df
    if projects is None:
        return df.filter(F.col("project") == project)
    named = projects.filter((F.col("name") == project) | (F.col("folder_path") == project))
    return df.filter(F.col("project") == named.agg(F.min_by("name", "folder_path")).scalar())


def require_project(projects: DataFrame, project: str) -> None:
    """Raise ``ValueError`` for an unknown project, for single calls that want it."""
    known = projects.filter((F.col("name") == project) | (F.col("folder_path") == project))
    if known.isEmpty():
        raise ValueError(f"Project not found: {project}")


def filter_rows_text(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose listed columns, written side by side, contain the query text."""
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return df.filter(text.name_contains(shown, query))


def lines(files: DataFrame, skip: bool = True) -> DataFrame:
    """One row per line, numbered from 1: ``line``, ``text`` as is and ``trimmed``.

    With ``skip``, blank lines and whole-line comments of Python and PHP are left out.
    """
    kept = [c for c in files.columns if c != "content"]
    rows = files.select(
        *kept, F.posexplode(text.file_lines(F.col("content"))).alias("at", "text")
    ).select(*kept, (F.col("at") + 1).alias("line"), "text", text.strip_blanks(F.col("text")).alias("trimmed"))
    return rows.filter(is_code(F.col("trimmed"))) if skip else rows


def is_code(trimmed: Column) -> Column:
    """Neither blank nor a whole-line comment."""
    # Asked once of each line, as making it may cost more than the question.
    return (
        F.when(F.col("language") == "python", trimmed.rlike(r"\A[^#]"))
        .when(F.col("language") == "php", trimmed.rlike(r"\A(?!//)[^#]"))
        .otherwise(trimmed != "")
    )


def index_files(corpus: DataFrame) -> DataFrame:
    """The ``files`` table of an index: key, language, sizes and the head for snippets.

    ``head`` keeps one character more than any snippet shows, so that clipping it
    later still tells whether something was cut off.
    """
    content = F.col("content")
    return corpus.select(
        paths.file_id(F.col("project"), F.col("path")).alias("file_id"),
        "project",
        "path",
        paths.language_of(F.col("path")).alias("language"),
        F.date_trunc("second", F.col("last_modified")).alias("last_modified"),
        F.col("file_size").cast("bigint").alias("file_size"),
        F.length(content).cast("bigint").alias("content_length"),
        F.substring(F.substring_index(content, "\n", 5), 1, 501).alias("head"),
        "content",
    )
