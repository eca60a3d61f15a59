"""An index: the derived tables of one corpus, as DataFrames."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lineloom.operators.corpus import index_files, readable
from lineloom.operators.derive import extract_imports, extract_symbols
from lineloom.operators.postings import build_postings


@dataclass(frozen=True)
class Index:
    """Tables of ``lineloom.schemas``; ``projects`` and ``runs`` may be missing.

    ``fold_accents`` says how the postings were cut, so that query texts are cut alike. ``narrow`` is
    a stored copy of ``files`` without the bodies, if there is one. ``derived``: symbols, imports and postings are not
    stored, but made from ``files`` each time.
    """

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    postings: DataFrame
    projects: DataFrame | None = None
    runs: DataFrame | None = None
    fold_accents: bool = True
    narrow: DataFrame | None = None
    derived: bool = False

    @property
    def names(self) -> DataFrame:
        """``files`` without the bodies."""
        return self.files.drop("content") if self.narrow is None else self.narrow

    def with_tables(self, **tables: DataFrame) -> "Index":
        if "files" in tables:
            tables.setdefault("narrow", None)
        if tables.keys() & {"files", "symbols", "imports", "postings"}:
            tables.setdefault("derived", False)
        return replace(self, **tables)


def index_of_files(files: DataFrame, fold_accents: bool = True, **more: DataFrame) -> Index:
    """Index over a table that already has the columns of ``files``."""
    return Index(
        files=files,
        symbols=extract_symbols(files),
        imports=extract_imports(files),
        postings=build_postings(files, fold_accents),
        fold_accents=fold_accents,
        derived=True,
        **more,
    )


def build_index(corpus: DataFrame, fold_accents: bool = True, **more: DataFrame) -> Index:
    """Index over a corpus ``(project, path, content, last_modified, file_size)``; rows with an ``error`` are no files."""
    return index_of_files(index_files(readable(corpus)), fold_accents, **more)
