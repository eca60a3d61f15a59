"""Rows of several tables in one frame, told apart by ``table``: symbols and imports that one pass finds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = ["name", "type", "line", "column", "scope"]
IMPORT = ["import_path", "import_name", "import_type"]
_KINDS = {c: "int" if c in ("line", "column") else "string" for c in [*SYMBOL, *IMPORT]}
#: Type of an array of such rows.
TAGGED = f"array<struct<table:string,{','.join(f'{c}:{k}' for c, k in _KINDS.items())}>>"


def _tagged(table: str, row: Column, columns: list[str]) -> Column:
    value = lambda c, kind: (row[c] if c in columns else F.lit(None)).cast(kind).alias(c)
    return F.struct(F.lit(table).alias("table"), *[value(c, kind) for c, kind in _KINDS.items()])


def tagged_symbol(row: Column) -> Column:
    """A struct of a symbol's columns as a row for both tables."""
    return _tagged("symbols", row, SYMBOL)


def tagged_import(row: Column) -> Column:
    """A struct of an import's columns as a row for both tables."""
    return _tagged("imports", row, IMPORT)


def rows_of(found: DataFrame, rows: str, always: str) -> DataFrame:
    """The structs of the array column ``rows``, one row each beside their file; ``always`` is a field that none leaves null.

    An inner ``inline`` would have Spark ask first if the array is empty, and make it twice for that.
    """
    return found.select("file_id", "project", "path", "language", F.inline_outer(rows)).filter(F.col(always).isNotNull())


def untagged(rows: DataFrame, table: str) -> DataFrame:
    """The rows of one of the tables, with its own columns."""
    columns = SYMBOL if table == "symbols" else IMPORT
    return rows.filter(F.col("table") == table).select("file_id", "project", "path", "language", *columns)
