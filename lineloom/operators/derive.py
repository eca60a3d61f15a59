"""Every symbol and import of a corpus, whatever the language."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.text import name_contains
from lineloom.operators.extract import RULES, line_imports, line_rows, line_symbols
from lineloom.operators.extract_js import LANGUAGES, script_imports, script_rows, script_symbols


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of all files; a language without rules gives none."""
    return line_symbols(files).unionByName(script_symbols(files))


def extract_symbols_named(files: DataFrame, needle: str) -> DataFrame:
    """Symbol rows whose name contains a text; only files that can have such a name are read for symbols.

    A name stands in its text as it is, but for escapes, which are masked in script files.
    """
    # In lower case a sigma depends on what stands behind it.
    low = lambda text: F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))
    may = lambda text: F.contains(low(text), low(F.lit(needle))) | F.contains(text, F.lit("\\"))
    # Languages first, and a text that is made by columns is made once for the test.
    some = files.filter(F.col("language").isin(*RULES, *LANGUAGES)).filter(F.exists(F.array("content"), may))
    return extract_symbols(some).filter(name_contains(F.col("name"), needle))


def extract_imports(files: DataFrame) -> DataFrame:
    """Import rows of all files; a language without rules gives none."""
    return line_imports(files).unionByName(script_imports(files))


def extract_all(files: DataFrame) -> DataFrame:
    """Symbols and imports of all files in one pass over their texts, as rows of ``operators.tagged``."""
    return line_rows(files).unionByName(script_rows(files))
