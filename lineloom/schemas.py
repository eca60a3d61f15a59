"""Fixed schemas of the derived tables; nothing is inferred at read time.

``file_id`` is the 128-bit md5 of ``(project, path)``: it is computed without any
global counter and stays collision-free for corpora of many billion files.
``language`` is repeated on symbols and imports, and ``head`` / ``content_length`` are
kept next to ``content``, so that listings and searches read no file bodies and need
no join back to ``files`` for a label.
"""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema of ``name type, ...``, without needing a session yet."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PROJECTS = _struct(
    "name string, folder_path string, status string, file_count bigint, symbol_count bigint,"
    " last_indexed timestamp, created_at timestamp, updated_at timestamp"
)
CORPUS = _struct(
    "project string, path string, content string, last_modified timestamp, file_size bigint"
)
FILES = _struct(
    "file_id binary, project string, path string, language string, last_modified timestamp,"
    " file_size bigint, content_length bigint, head string, content string"
)
#: What listings and searches need of ``files``, stored once more without the bodies.
NAMES = T.StructType([f for f in FILES.fields if f.name != "content"])
SYMBOLS = _struct(
    "file_id binary, project string, path string, language string, name string, type string,"
    " line int, column int, scope string"
)
IMPORTS = _struct(
    "file_id binary, project string, path string, language string, import_path string,"
    " import_name string, import_type string"
)
#: Symbols and imports as one pass finds them.
CODE = T.StructType([T.StructField("table", T.StringType()), *SYMBOLS.fields, *IMPORTS.fields[4:]])
POSTINGS = _struct(
    "file_id binary, project string, field string, term string, pos int"
)
CHANGES = _struct(
    "project string, path string, action string, ts timestamp, seq bigint, content string"
)
REMOVED = _struct("file_id binary")
RUNS = _struct(
    "run_id string, segment bigint, base bigint, started_at timestamp, finished_at timestamp,"
    " indexed bigint, skipped bigint, failed bigint, symbols bigint, imports bigint"
)
