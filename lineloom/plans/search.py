"""Full-text reads: code search, dashboard search, combined context."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.text import clip, name_contains, query_terms
from lineloom.operators.corpus import for_project
from lineloom.operators.derive import extract_symbols_named
from lineloom.operators.match import ALL_FIELDS, CONTENT, match_all, match_texts
from lineloom.plans.index import Index


def _first_matches(
    index: Index, query: str | DataFrame, fields: Sequence[str], limit: int, project: str | None
) -> DataFrame:
    """The first matching files by project and path; file bodies are not read.

    Only keys meet the matches. The few that are shown, as many as the limit says, are then single values
    for the scan: a stored table in order of projects is read for them only where they lie.
    """
    matches = query
    if isinstance(query, str):
        terms = query_terms(query, index.fold_accents)
        if index.derived:
            matches = match_texts(index.files, terms, fields, index.fold_accents)
        else:
            matches = match_all(index.postings, terms, fields)
    names = for_project(index.names.select("file_id", "project", "path"), project, index.projects)
    first = names.join(matches, "file_id", "left_semi").orderBy("project", "path").limit(limit)
    shown = first.agg(F.min("project").alias("low"), F.max("project").alias("high"), F.collect_list("file_id").alias("ids"))
    low, high, ids = (shown.select(c).scalar() for c in ("low", "high", "ids"))
    within = F.col("project").isNull() | ((F.col("project") >= low) & (F.col("project") <= high))
    return index.names.filter(within & F.array_contains(ids, F.col("file_id"))).orderBy("project", "path").limit(limit)


def search_code(
    index: Index, query: str | DataFrame, limit: int = 20, project: str | None = None
) -> DataFrame:
    """Files whose content matches, with the head of each file.

    ``query`` is a text whose words must all occur, or the ``file_id`` rows of any match
    form or combination of them.
    """
    return _first_matches(index, query, CONTENT, limit, project).select(
        "path", "language", "project", clip(F.col("head"), 500).alias("snippet"), "content_length"
    )


def search_files(index: Index, query: str | DataFrame, limit: int = 20) -> DataFrame:
    """Files that match in content or path, with their size in KB."""
    return _first_matches(index, query, ALL_FIELDS, limit, None).select(
        "project", "path", "language", F.round(F.col("file_size") / 1024, 2).alias("size_kb")
    )


def get_context(index: Index, query: str, limit: int = 30, project: str | None = None) -> DataFrame:
    """Matching files, then symbols whose name contains the query, half of the limit each.

    Several symbols of one name in one file count once, at their first place.
    """
    half = limit // 2
    nothing = F.lit(None).cast("string")
    files = _first_matches(index, query, ALL_FIELDS, half, project).select(
        F.lit("file_match").alias("kind"),
        "project",
        "path",
        "language",
        clip(F.substring_index("head", "\n", 4), 300).alias("snippet"),
        nothing.alias("name"),
        nothing.alias("symbol_type"),
        F.lit(None).cast("int").alias("line"),
        nothing.alias("scope"),
    )
    if index.derived:
        named = extract_symbols_named(index.files, query)
    else:
        named = index.symbols.filter(name_contains(F.col("name"), query))
    first = (
        for_project(named, project, index.projects)
        .orderBy("type", "project", "path", "name", "line", "column")
        .limit(half)
    )
    same = W.partitionBy("project", "path", "name").orderBy("type", "line", "column")
    symbols = (
        first.withColumn("rank", F.row_number().over(same))
        .filter(F.col("rank") == 1)
        .orderBy("type", "project", "path", "name", "line", "column")
        .select(
            F.lit("symbol_match").alias("kind"),
            "project",
            "path",
            "language",
            nothing.alias("snippet"),
            "name",
            F.col("type").alias("symbol_type"),
            "line",
            "scope",
        )
    )
    return files.unionByName(symbols)
