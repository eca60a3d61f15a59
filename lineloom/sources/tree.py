"""Folder trees as a corpus.

Spark's own file sources skip every name that starts with ``_`` or ``.``, so package
files like ``__init__.py`` would be lost. Here a Python data source lists the trees, one
partition per folder near the root, and gives only paths, times and sizes. Those rows
are spread evenly before the bodies are read, so one crowded folder does not make one
slow task. The folders must be mounted on every executor.
"""

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lineloom.functions.paths import EXCLUDED_DIRECTORIES, SUPPORTED_LANGUAGES, language_of

LISTED = "project string, path string, full_path string, mtime double, file_size bigint, error string"
READ = "project string, path string, mtime double, file_size bigint, body binary, error string"
BATCH_BYTES = 16 << 20


def _is_listed(name: str, excluded: tuple[str, ...]) -> bool:
    return not name.startswith(".") and name not in excluded


def _leads_up(folder: str, name: str) -> bool:
    """A link to one of its own parents, which would never end."""
    here = os.path.realpath(folder) + os.sep
    return here.startswith(os.path.join(os.path.realpath(os.path.join(folder, name)), ""))


def _entries(folder: str) -> list[os.DirEntry]:
    """What a folder holds; nothing if it cannot be listed, which its own reader tells."""
    try:
        return list(os.scandir(folder))
    except OSError:
        return []


class _Folder(InputPartition):
    def __init__(self, project: str, root: str, folder: str, deep: bool):
        super().__init__((project, folder))
        self.project, self.root, self.folder, self.deep = project, root, folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], excluded: tuple[str, ...], levels: int):
        self.roots, self.excluded, self.levels = roots, excluded, levels

    def partitions(self) -> list[InputPartition]:
        """Folders down to ``levels`` on their own, those at the last level with all below."""
        found = []
        for project, root in self.roots.items():
            level = [root]
            for depth in range(self.levels + 1):
                deep = depth == self.levels
                found += [_Folder(project, root, folder, deep) for folder in level]
                if not deep:
                    level = [
                        entry.path
                        for folder in level
                        for entry in _entries(folder)
                        if entry.is_dir()
                        and _is_listed(entry.name, self.excluded)
                        and not _leads_up(folder, entry.name)
                    ]
        return found

    def read(self, partition: _Folder) -> Iterator[tuple]:
        """Files, and a row with ``error`` for every folder and file that cannot be looked at."""

        def row(full: str, stat: os.stat_result | None, error: OSError | None) -> tuple:
            inside = os.path.relpath(full, partition.root).replace(os.sep, "/")
            inside = "" if inside == "." else inside
            return (partition.project, inside, full, stat and stat.st_mtime, stat and stat.st_size, error and str(error))

        closed: list[OSError] = []
        for folder, folders, names in os.walk(partition.folder, followlinks=True, onerror=closed.append):
            folders[:] = sorted(
                name
                for name in folders
                if partition.deep and _is_listed(name, self.excluded) and not _leads_up(folder, name)
            )
            for name in sorted(names):
                if name.startswith("."):
                    continue
                full = os.path.join(folder, name)
                try:
                    stat = os.stat(full)
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
                except OSError as problem:
                    yield row(full, None, problem)
                else:
                    yield row(full, stat, None)
        for problem in closed:
            yield row(problem.filename, None, problem)


class TreeSource(DataSource):
    """``format("source_tree")`` with the options ``root.<project>``, ``excluded``, ``levels``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        roots = {k[5:]: v for k, v in self.options.items() if k.startswith("root.")}
        excluded = tuple(self.options.get("excluded", "").split("\n"))
        return _TreeReader(roots, excluded, int(self.options.get("levels", "2")))


def _read_bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add file bodies, handing on a few megabytes at a time."""
    columns = ["project", "path", "mtime", "file_size", "body", "error"]
    rows, held = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            body, error = None, row.error
            if error is None:
                try:
                    with open(row.full_path, "rb") as file:
                        body = file.read()
                except OSError as problem:
                    error = str(problem)
            rows.append((row.project, row.path, row.mtime, row.file_size, body, error))
            held += len(body or b"")
            if held >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns).astype({"file_size": "Int64"})
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns).astype({"file_size": "Int64"})


def list_trees(
    spark: SparkSession,
    roots: dict[str, str],
    languages: tuple[str, ...] | None = SUPPORTED_LANGUAGES,
    excluded: tuple[str, ...] = EXCLUDED_DIRECTORIES,
    levels: int = 2,
) -> DataFrame:
    """Files of several folders, ``{project: root}``, without opening them.

    Hidden names and ``excluded`` folders are not entered. A folder or file that cannot be looked
    at is a row with ``error``; a folder's path is that of the folder, the root's is empty.
    """
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("levels", levels).option("excluded", "\n".join(excluded))
    for project, root in roots.items():
        reader = reader.option(f"root.{project}", os.path.abspath(root))
    kept = F.lit(True) if languages is None else language_of(F.col("path")).isin(*languages) | F.col("error").isNotNull()
    return reader.load().filter(kept).withColumn("last_modified", F.timestamp_seconds(F.floor("mtime")))


def read_bodies(listed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Corpus of the listed files. Bytes that are not UTF-8 become replacement characters; a file
    that cannot be read has no content and says why in ``error``."""
    rows = listed.select("project", "path", "full_path", "mtime", "file_size", "error")
    spread = rows.repartition(partitions) if partitions else rows.repartition("full_path")
    return spread.mapInPandas(_read_bodies, READ).select(
        "project",
        "path",
        F.make_valid_utf8(F.col("body").cast("string")).alias("content"),
        F.timestamp_seconds(F.floor("mtime")).alias("last_modified"),
        "file_size",
        "error",
    )


def read_trees(
    spark: SparkSession,
    roots: dict[str, str],
    languages: tuple[str, ...] | None = SUPPORTED_LANGUAGES,
    excluded: tuple[str, ...] = EXCLUDED_DIRECTORIES,
    levels: int = 2,
    partitions: int | None = None,
) -> DataFrame:
    """Corpus of several folders, ``{project: root}``, tagged by project: ``list_trees`` with bodies."""
    return read_bodies(list_trees(spark, roots, languages, excluded, levels), partitions)


def read_tree(spark: SparkSession, root: str, project: str | None = None, **options) -> DataFrame:
    """Corpus of one folder; the project is named after the folder unless given."""
    root = os.path.abspath(root)
    return read_trees(spark, {project or os.path.basename(root): root}, **options)
