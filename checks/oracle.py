"""The corpora of ``bindings``, written in SQL: named parts a query's SQL is put together from."""

#: The blanks that trimming takes away.
BLANK = (
    r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

#: Languages by extension.
LANGUAGE = """
CASE lower(regexp_extract(path, '[^/]+\\.([^./]+)$', 1))
  WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript'
  WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'php' THEN 'php' WHEN 'java' THEN 'java'
  WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'cpp' THEN 'cpp' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c'
  WHEN 'rb' THEN 'ruby' WHEN 'sh' THEN 'bash' WHEN 'sql' THEN 'sql' WHEN 'json' THEN 'json'
  WHEN 'md' THEN 'markdown' WHEN 'yml' THEN 'yaml' WHEN 'yaml' THEN 'yaml' ELSE 'unknown' END"""

DOCS = f"""
docs AS (SELECT *, {LANGUAGE} AS language FROM (
  SELECT source AS project,
    source || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'js'
      WHEN 'de' THEN 'php' WHEN 'es' THEN 'ts' ELSE 'md' END AS path,
    text AS content, CAST(strlen(text) AS BIGINT) AS file_size,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS last_modified
  FROM documents))"""

PROJECTS = """
projects AS (SELECT source AS name, '/corpus/' || source AS folder_path, count(*) AS file_count,
  max(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE) AS last_indexed
  FROM documents GROUP BY source)"""

WEB = f"""
web AS (SELECT *, {LANGUAGE} AS language FROM (
  SELECT CAST(NULL AS VARCHAR) AS project, url AS path, html AS content,
    CAST(strlen(html) AS BIGINT) AS file_size,
    TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 MINUTE AS last_modified FROM pages))"""

LINK = r"""'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'"""
LINKS = f"""
links AS (SELECT project, path, language, unnest(regexp_extract_all(content, {LINK}, 1)) AS import_path,
  nullif(unnest(regexp_extract_all(content, {LINK}, 2)), '') AS import_name FROM web)"""

CODE = f"""
blocks AS (SELECT o_custkey AS owner, o_orderkey // 1048576 AS block, count(*) AS n,
  string_agg('    def order_' || o_orderkey || '(self):' || chr(10) || 'ORDER_' || o_orderkey || ' = '
    || o_custkey, chr(10) ORDER BY o_orderkey) AS py,
  string_agg('  order_' || o_orderkey || '(self) {{' || chr(10) || '    const hidden = ' || o_orderkey
    || ';' || chr(10) || '  }}', chr(10) ORDER BY o_orderkey) AS js
  FROM orders GROUP BY ALL),
owned AS (SELECT * FROM blocks JOIN customer ON owner = c_custkey JOIN nation ON c_nationkey = n_nationkey),
stock AS (SELECT p_partkey % (SELECT count(*) FROM supplier) AS owner, p_partkey // 1048576 AS block,
  string_agg('const PART_' || p_partkey || ' = ' || p_size || ';', chr(10) ORDER BY p_partkey) AS php
  FROM part GROUP BY ALL),
code AS (SELECT *, {LANGUAGE} AS language, CAST(strlen(content) AS BIGINT) AS file_size,
    TIMESTAMP '2024-01-01 00:00:00' + owner * INTERVAL 1 MINUTE AS last_modified FROM (
  SELECT n_name AS project, 'customer_' || owner || '_' || block || '.py' AS path, owner,
    'import os' || chr(10) || 'from nation_' || n_nationkey || ' import base' || chr(10) || 'class C' || owner
    || '(Base):' || chr(10) || py AS content FROM owned
  UNION ALL
  SELECT n_name, 'customer_' || owner || '_' || block || '.js', owner,
    'import {{ base }} from ''./nation_' || n_nationkey || ''';' || chr(10) || 'const config_' || owner
    || ' = require(''config/' || owner || ''');' || chr(10) || 'export class C' || owner
    || ' extends Base {{' || chr(10) || js || chr(10) || '}}' || chr(10) || 'function total_' || owner
    || '() {{' || chr(10) || '  const sum = 0;' || chr(10) || '}}' || chr(10)
    || 'const' || chr(10) || '  late_' || owner || ' = ' || owner || ';' || chr(10)
    || 'function' || chr(10) || '  run_' || owner || '() {{ const inner = 1; }}' || chr(10)
    || 'const far_' || owner || ' = require(' || chr(10) || '  ''far/' || owner || '''' || chr(10)
    || '), near_' || owner || ' = [1, 2],' || chr(10) || '  last_' || owner || ' = {{ k: 1 }};' || chr(10)
    || 'export default function main_' || owner || '() {{' || chr(10) || '  let own;' || chr(10) || '}}' || chr(10)
    || 'handler_' || owner || ' = function () {{ var no = 1; }};' FROM owned
  UNION ALL
  SELECT n_name, 'supplier_' || owner || '_' || block || '.php', owner,
    '<?php' || chr(10) || 'require_once ''nation_' || n_nationkey || '.php'';' || chr(10)
    || 'use Nation\\N' || n_nationkey || '\\Base;' || chr(10) || 'class S' || owner || ' extends Base {{'
    || chr(10) || 'public function find_' || owner || '($id) {{' || chr(10) || php
  FROM stock JOIN supplier ON owner = s_suppkey JOIN nation ON s_nationkey = n_nationkey))"""

LINES = f"""
raw_lines AS (SELECT project, path, language, unnest(string_split(content, chr(10))) AS text,
  generate_subscripts(string_split(content, chr(10)), 1) AS line FROM %s),
trim_lines AS (SELECT *, regexp_replace(regexp_replace(text, '^{BLANK}+', ''), '{BLANK}+$', '') AS trimmed
  FROM raw_lines),
ln AS (SELECT * FROM trim_lines WHERE trimmed <> ''
  AND NOT (language IN ('python', 'php') AND trimmed[1] = '#')
  AND NOT (language = 'php' AND trimmed[1:2] = '//'))"""


def line_symbols(name: str, language: str, type_: str, pattern: str, at: str, more: str = "") -> str:
    pattern = pattern.replace(r"\s", BLANK)
    return f"""
{name} AS (SELECT project, path, language, regexp_extract(trimmed, '{pattern}', 1) AS name, '{type_}' AS type,
  line, greatest(strpos(text, {at or f"regexp_extract(trimmed, '{pattern}', 1)"}), 1) AS col,
  CAST(NULL AS VARCHAR) AS scope FROM ln
  WHERE language = '{language}' AND regexp_matches(trimmed, '{pattern}'){more})"""


#: The line patterns of symbols, imports and includes, from here to the rendered script files.
PY_FUNCTION = line_symbols("py_function", "python", "function", r"^def\s+(\w+)\s*\(", "'def'")
PY_CLASS = line_symbols("py_class", "python", "class", r"^class\s+(\w+)\s*[\(:]", "'class'")
PY_VARIABLE = line_symbols(
    "py_variable", "python", "variable", r"^(\w+)\s*=", "",
    r" AND text[1] NOT IN (' ', chr(9)) AND NOT regexp_matches(trimmed,"
    rf" '^(if|for|while|with|try|except|finally){BLANK}*=')",
)
PHP_FUNCTION = line_symbols(
    "php_function", "php", "function",
    r"^(?:public\s+|private\s+|protected\s+)?function\s+(\w+)\s*\(", "'function'",
)
PHP_CLASS = line_symbols(
    "php_class", "php", "class", r"^(?:abstract\s+)?class\s+(\w+)\s*(?:extends|implements|\{)", "'class'"
)
PHP_CONSTANT = line_symbols("php_constant", "php", "constant", r"^(?:const|public\s+const)\s+(\w+)\s*=", "")

_IMPORT = r"^(?:from\s+([\w.]+)\s+)?import\s+([\w\s,*]+)".replace(r"[\w\s", rf"[\w{BLANK[1:-1]}").replace(r"\s", BLANK)
PY_IMPORT = f"""
py_import AS (SELECT project, path, language, regexp_extract(trimmed, '{_IMPORT}', 1) AS import_path,
  nullif(regexp_replace(regexp_extract(trimmed, '{_IMPORT}', 2), '{BLANK}+$', ''), '') AS import_name,
  CASE WHEN regexp_extract(trimmed, '{_IMPORT}', 1) = '' THEN 'import' ELSE 'from_import' END AS import_type
  FROM ln WHERE language = 'python' AND regexp_matches(trimmed, '{_IMPORT}'))"""
_REQUIRE = r"""^(?:require|include|require_once|include_once)\s+[''"]([^''"]+)[''"]""".replace(r"\s", BLANK)
PHP_REQUIRE = f"""
php_require AS (SELECT project, path, language, regexp_extract(trimmed, '{_REQUIRE}', 1) AS import_path,
  CAST(NULL AS VARCHAR) AS import_name, 'require' AS import_type
  FROM ln WHERE language = 'php' AND regexp_matches(trimmed, '{_REQUIRE}'))"""
_USE = r"^use\s+([\w\\]+)".replace(r"\s", BLANK)
PHP_USE = rf"""
php_use AS (SELECT project, path, language, regexp_extract(trimmed, '{_USE}', 1) AS import_path,
  nullif(string_split(regexp_extract(trimmed, '{_USE}', 1), '\')[-1], '') AS import_name, 'use' AS import_type
  FROM ln WHERE language = 'php' AND regexp_matches(trimmed, '{_USE}'))"""

# What the rendered script files declare, known from how they were written.
JS_SYMBOLS = """
js_at AS (SELECT n_name AS project, 'customer_' || owner || '_' || block || '.js' AS path, owner, n FROM owned),
js_symbols AS (
  SELECT project, path, 'javascript' AS language, 'config_' || owner AS name, 'variable' AS type,
    2 AS line, 6 AS col, CAST(NULL AS VARCHAR) AS scope FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'C' || owner, 'class', 3, 7, 'export' FROM js_at
  UNION ALL SELECT n_name, 'customer_' || o_custkey || '_' || o_orderkey // 1048576 || '.js', 'javascript',
    'order_' || o_orderkey, 'method', 1 + 3 * row_number() OVER (
      PARTITION BY o_custkey, o_orderkey // 1048576 ORDER BY o_orderkey), 2, 'C' || o_custkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT project, path, 'javascript', 'total_' || owner, 'function', 5 + 3 * n, 0, NULL FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'sum', 'variable', 6 + 3 * n, 8, 'total_' || owner FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'late_' || owner, 'variable', 9 + 3 * n, 2, NULL FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'run_' || owner, 'function', 10 + 3 * n, 0, NULL FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'inner', 'variable', 11 + 3 * n, 13 + len('run_' || owner), 'run_' || owner FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'far_' || owner, 'variable', 12 + 3 * n, 6, NULL FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'near_' || owner, 'variable', 14 + 3 * n, 3, NULL FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'last_' || owner, 'variable', 15 + 3 * n, 2, NULL FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'main_' || owner, 'function', 16 + 3 * n, 15, 'export' FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'own', 'variable', 17 + 3 * n, 6, 'export' FROM js_at
  UNION ALL SELECT project, path, 'javascript', 'handler_' || owner, 'function', 19 + 3 * n, 0, NULL FROM js_at)"""
JS_IMPORTS = """
js_imports AS (
  SELECT n_name AS project, 'customer_' || owner || '_' || block || '.js' AS path, 'javascript' AS language,
    './nation_' || n_nationkey AS import_path, 'base' AS import_name, 'import' AS import_type FROM owned
  UNION ALL SELECT n_name, 'customer_' || owner || '_' || block || '.js', 'javascript', 'config/' || owner,
    'config_' || owner, 'require' FROM owned
  UNION ALL SELECT n_name, 'customer_' || owner || '_' || block || '.js', 'javascript', 'far/' || owner,
    'far_' || owner, 'require' FROM owned)"""

_SYMBOLS = ",".join([PY_FUNCTION, PY_CLASS, PY_VARIABLE, PHP_FUNCTION, PHP_CLASS, PHP_CONSTANT, JS_SYMBOLS]) + """,
symbols AS (SELECT * FROM py_function UNION ALL SELECT * FROM py_class UNION ALL SELECT * FROM py_variable
  UNION ALL SELECT * FROM php_function UNION ALL SELECT * FROM php_class UNION ALL SELECT * FROM php_constant
  UNION ALL SELECT * FROM js_symbols)"""
SYMBOLS = ",".join([CODE, LINES % "code", _SYMBOLS])
# Every file there is: rendered ones, pages and documents, whose scripts are prose that declares nothing.
ALL_SYMBOLS = ",".join([CODE, WEB, DOCS]) + """,
every AS (SELECT project, path, language, content FROM code UNION ALL SELECT project, path, language, content FROM web
  UNION ALL SELECT project, path, language, content FROM docs),""" + ",".join([LINES % "every", _SYMBOLS])
_IMPORTS = ",".join([PY_IMPORT, PHP_REQUIRE, PHP_USE, JS_IMPORTS]) + """,
imports AS (SELECT * FROM py_import UNION ALL SELECT * FROM php_require UNION ALL SELECT * FROM php_use
  UNION ALL SELECT * FROM js_imports)"""
IMPORTS = ",".join([CODE, LINES % "code", _IMPORTS])
SYMBOLS_AND_IMPORTS = SYMBOLS + "," + _IMPORTS

POSTINGS = r"""
toks AS (SELECT project, path, 'content' AS field, regexp_extract_all(lower(content), '[\p{L}\p{N}\p{Co}]+') AS t
  FROM %(files)s UNION ALL
  SELECT project, path, 'path', regexp_extract_all(lower(path), '[\p{L}\p{N}\p{Co}]+') FROM %(files)s),
postings AS (SELECT project, path, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks)"""
DOC_POSTINGS = DOCS + "," + POSTINGS % {"files": "docs"}

SCAN = DOCS + "," + WEB + """,
scan AS (SELECT project, path, content, file_size, language, CASE WHEN toxic = 1
    THEN last_modified - INTERVAL 1 HOUR ELSE last_modified END AS last_modified
  FROM docs LEFT JOIN labels ON doc_id = CAST(regexp_extract(path, 'doc_(\\d+)', 1) AS BIGINT)
  WHERE coalesce(quality, 1) <> 0
  UNION ALL SELECT project, path, content, file_size, language, last_modified FROM web),
diff AS (SELECT coalesce(s.project, d.project) AS project, coalesce(s.path, d.path) AS path,
  CASE WHEN d.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'missing'
    WHEN s.last_modified = d.last_modified THEN 'skipped' ELSE 'changed' END AS status
  FROM scan s FULL JOIN docs d ON s.path = d.path AND s.project IS NOT DISTINCT FROM d.project)""".replace("\\\\", "\\")

FEED = """
feed AS (SELECT 'p' || user_id % 8 AS project, 'f' || user_id || '.py' AS path,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS action,
  ts, event_id AS seq, props AS content FROM events)"""


def sessions(keys: str, minutes: int) -> str:
    return FEED + f""",
marked AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, seq) + INTERVAL {minutes} MINUTE
  THEN 1 ELSE 0 END AS opens FROM feed),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS nr
  FROM marked),
sessions AS (SELECT *, min(ts) OVER (PARTITION BY {keys}, nr) AS start FROM numbered)"""
