"""Repeated passages of lines, found with overlapping windows of three lines.

Every three consecutive lines are hashed (128 bits). A window that stands at more than one place is
kept at its first, by document id and line, and its lines are covered at all others. Covered lines are
merged and removed. A line's text never goes altogether: its first place lies in no later window.
With ``sentences``, lines are cut after sentence marks first and windows hold three sentences, over line
ends or within a line.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.saved import saved

LINES = 3
#: Where units end; the same for Java's and Python's expressions.
LINE_END = "\n"
SENTENCE_END = r"\n|(?<=[.!?]) "


def _kept_text(text: str, starts: list, end: str) -> str:
    """The text without the units that the windows at the places cover; a line end between two units that stay is kept."""
    parts = re.split(f"({end})", text)
    kept = np.ones(len(parts) // 2 + 1 + LINES, bool)
    for i in range(LINES):
        kept[np.array(starts, np.int64) + i] = False
    out, gap = [], ""
    for at, unit in enumerate(parts[::2]):
        if kept[at]:
            out += [gap, unit] if out else [unit]
            gap = ""
        if at * 2 + 1 < len(parts) and gap != "\n":
            gap = parts[at * 2 + 1]
    return "".join(out)


def _without(end: str):
    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), places.to_pylist())
        return pa.array([None if text is None else _kept_text(text, starts, end) for text, starts in pairs], pa.string())

    return cut


def later_windows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: str = LINE_END) -> DataFrame:
    """``(id, places)``: the first units (from 0) of the windows that stand somewhere before, per document."""
    lines = F.split(F.col(text_col), end)

    def hashes(salt: int):
        each = F.transform("lines", lambda line: F.xxhash64(F.lit(salt), line))
        return each

    hashed = (
        documents.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), lines.alias("lines"))
        .filter(F.size("lines") >= LINES)
        .select("id", hashes(1).alias("g"), hashes(2).alias("h"))
    )
    at = F.sequence(F.lit(0), F.size("g") - LINES)

    def window(name: str, i):
        return F.xxhash64(*[F.get(F.col(name), i + k) for k in range(LINES)]).alias(name)

    windows = saved(
        hashed.select("id", F.explode(F.transform(at, lambda i: F.struct(i.alias("place"), window("g", i), window("h", i)))).alias("w"))
        .select("id", "w.place", "w.g", "w.h")
    )
    place = F.struct("id", "place")
    repeated = windows.groupBy("g", "h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = saved(repeated.filter("first < last").select("g", "h", "first"))
    later = windows.join(repeated.hint("merge"), ["g", "h"]).filter(place > F.col("first"))
    return later.groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = False) -> DataFrame:
    """All rows and columns of ``documents``, with the lines of later windows taken out of the text.

    A text may become empty; no row is dropped. Texts of fewer than three lines, null texts and rows
    with a null id stay as they are. Rows of one id are taken for one document, so exact repeats of a
    row get the same text. Empty lines are lines like any other. ``sentences`` takes sentences for lines; then
    all that goes by lines goes too.
    """
    end = SENTENCE_END if sentences else LINE_END
    places = later_windows(documents, id_col, text_col, end).withColumnsRenamed({"id": "__lines_id", "places": "__lines_places"})
    joined = documents.join(places.hint("shuffle_hash"), F.col(id_col) == F.col("__lines_id"), "left")
    # Only texts that lose lines go through Python.
    changed = _without(end)(F.when(F.col("__lines_places").isNotNull(), F.col(text_col)), F.col("__lines_places"))
    text = F.when(F.col("__lines_places").isNull(), F.col(text_col)).otherwise(changed)
    return joined.withColumn(text_col, text).select(*documents.columns)


def line_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_lines, n_kept, kept_sha256)`` for every row, a null text being empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col), text.alias("text"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    kept = without_repeats(rows, id_col, "text")
    return kept.select(
        id_col,
        "n_lines",
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


#: The same in DuckDB's SQL.
SQL = """
WITH l AS (
  SELECT doc_id, len(x) AS n_lines, x, unnest(range(1, len(x) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x[i:i + 2] ORDER BY doc_id, i) AS n FROM l WHERE i + 2 <= n_lines
), c AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM w WHERE n > 1
), k AS (
  SELECT l.doc_id, any_value(n_lines) AS n_lines, coalesce(string_agg(x[l.i], chr(10) ORDER BY l.i) FILTER (c.i IS NULL), '') AS text
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines,
       CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_kept, sha256(text) AS kept_sha256
FROM k
"""
