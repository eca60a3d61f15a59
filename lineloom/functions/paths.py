"""Path expressions: language, exclusion, normal form, file key."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "py": "python",
    "php": "php",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "cpp": "cpp",
    "c": "c",
    "h": "c",
    "rb": "ruby",
    "sh": "bash",
    "sql": "sql",
    "json": "json",
    "md": "markdown",
    "yml": "yaml",
    "yaml": "yaml",
}
# Languages that are indexed, and directories that never are.
SUPPORTED_LANGUAGES = ("javascript", "typescript", "python", "php")
EXCLUDED_DIRECTORIES = (
    "node_modules",
    ".git",
    "dist",
    "build",
    ".next",
    ".venv",
    "__pycache__",
    ".pytest_cache",
    "vendor",
    ".bundle",
)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    """Language by file extension, ``unknown`` when there is none or it is not listed.

    A name that only starts with a dot (``.py``) has no extension.
    """
    extension = F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def excluded(
    path: Column,
    names: tuple[str, ...] = EXCLUDED_DIRECTORIES,
    suffixes: tuple[str, ...] = (),
) -> Column:
    """True when a directory on the path is hidden or named in ``names``,
    or the file name ends with one of ``suffixes``."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hit = F.exists(directories, lambda part: part.isin(*names) | part.startswith("."))
    for suffix in suffixes:
        hit = hit | F.endswith(path, F.lit(suffix))
    return hit


def relative_path(path: Column, root: str) -> Column:
    """``/``-separated path below ``root`` with ``.``, ``..`` and empty steps resolved.

    The steps are folded from the left over an array that never grows beyond the
    path itself, so this stays one expression per row.
    """

    def resolved(text: Column) -> Column:
        steps = F.filter(
            F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/"),
            lambda s: ~s.isin("", "."),
        )
        return F.aggregate(
            steps,
            F.array().cast("array<string>"),
            lambda done, step: F.when(
                step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            ).otherwise(F.concat(done, F.array(step))),
        )

    full = F.array_join(resolved(path), "/")
    base = F.array_join(resolved(F.lit(root)), "/")
    inside = F.when(base == "", full).when(
        F.startswith(full, F.concat(base, F.lit("/"))), F.substring(full, F.length(base) + 2, F.length(full))
    )
    return F.coalesce(inside, full)


def file_id(project: Column, path: Column) -> Column:
    """128-bit key of a file; a missing project differs from an empty one."""
    return F.unhex(F.md5(F.concat(F.coalesce(project, F.lit("\u0000")), F.lit("\n"), path)))
