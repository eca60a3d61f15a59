from lineloom.functions.paths import (
    excluded,
    file_id,
    file_name,
    language_of,
    relative_path,
)
from lineloom.functions.text import (
    clip,
    line_column,
    name_contains,
    name_starts_with,
    phrase_terms,
    query_terms,
    snippet,
    snippet_head,
    strip_blanks,
    tokens,
)

__all__ = [
    "clip",
    "excluded",
    "file_id",
    "file_name",
    "language_of",
    "line_column",
    "name_contains",
    "name_starts_with",
    "phrase_terms",
    "query_terms",
    "relative_path",
    "snippet",
    "snippet_head",
    "strip_blanks",
    "tokens",
]
