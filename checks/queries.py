"""Every operator over the given tables, each next to the SQL that must agree with it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import bindings as b
from checks import oracle as o
from lineloom import functions as fn
from lineloom.operators import bulk, corpus, derive, extract, maintain, match
from lineloom.operators import extract_js as script
from lineloom.operators.postings import build_postings
from lineloom.plans import lookup, search, stats
from lineloom.streaming import feed as feeds
from lineloom.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PLACE = ["project", "path"]
SYMBOL = [*PLACE, "name", "type", "line", "column as col", "scope"]
IMPORT = [*PLACE, "import_path", "import_name", "import_type"]
SQL_SYMBOL = "project, path, name, type, line::INTEGER AS line, col::INTEGER AS col, scope"
SQL_IMPORT = "project, path, import_path, import_name, import_type"


def query(sql: str | None = None, name: str | None = None):
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE[key] = sql
        return function

    return add


# Corpus: sources, filters, projections


@query(f"WITH {o.DOCS} SELECT project, path, content, file_size, last_modified FROM docs")
def corpus_from_table(spark, sf):
    return b.documents(spark, sf)


@query(f"WITH {o.DOCS}, {o.WEB} SELECT project, path, language FROM docs UNION ALL SELECT project, path, language FROM web")
def with_language(spark, sf):
    both = b.documents(spark, sf).unionByName(b.pages(spark, sf))
    return corpus.with_language(both.drop("content")).select(*PLACE, "language")


@query(f"""WITH {o.CODE}, {o.DOCS} SELECT project, path FROM docs
  WHERE language IN ('javascript', 'typescript', 'python', 'php') UNION ALL SELECT project, path FROM code""")
def filter_supported(spark, sf):
    both = b.documents(spark, sf).unionByName(b.code(spark, sf))
    return corpus.filter_supported(both).select(*PLACE)


# The folder names in the SQL.
@query(f"""WITH {o.DOCS}, placed AS (SELECT project, CASE language WHEN 'python' THEN '.venv/' || path
    WHEN 'php' THEN 'lib/vendor/' || path WHEN 'javascript' THEN 'src/build/' || path
    WHEN 'typescript' THEN 'building/' || path ELSE path END AS path FROM docs)
  SELECT project, path FROM placed WHERE NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', '.git',
    'dist', 'build', '.next', '.venv', '__pycache__', '.pytest_cache', 'vendor', '.bundle'])
    AND NOT regexp_matches(path, '(^|/)[.][^/]*/')""")
def filter_excluded(spark, sf):
    files = corpus.with_language(b.documents(spark, sf).drop("content"))
    folder = (
        F.when(F.col("language") == "python", ".venv/")
        .when(F.col("language") == "php", "lib/vendor/")
        .when(F.col("language") == "javascript", "src/build/")
        .when(F.col("language") == "typescript", "building/")
        .otherwise("")
    )
    placed = files.withColumn("path", F.concat(folder, "path"))
    return corpus.filter_excluded(placed).select(*PLACE)


@query(f"WITH {o.DOCS} SELECT '/srv/./' || project || '//x/..\\' || path AS full_path, project || '/' || path AS path FROM docs")
def relative_path(spark, sf):
    full = b.text("/srv/./", F.col("project"), "//x/..\\", F.col("path"))
    files = b.documents(spark, sf).select(full.alias("full_path"))
    return files.select("full_path", fn.relative_path(F.col("full_path"), "/srv/").alias("path"))


@query(f"WITH {o.DOCS} SELECT project, path FROM docs WHERE project = 'src3'")
def for_project(spark, sf):
    projects = b.projects(spark, sf)
    return corpus.for_project(b.documents(spark, sf), "/corpus/src3", projects).select(*PLACE)


@query(f"WITH {o.DOCS} SELECT project, path, language FROM docs WHERE contains(lower(path || ' ' || language), '7.ph')")
def filter_rows_text(spark, sf):
    files = corpus.with_language(b.documents(spark, sf).drop("content")).select(*PLACE, "language")
    return corpus.filter_rows_text(files, ["path", "language"], "7.PH")


# Extraction


@query(f"WITH {o.DOCS}, {o.LINES % 'docs'} SELECT project, path, line::INTEGER AS line, text, trimmed FROM ln")
def lines(spark, sf):
    return corpus.lines(b.document_files(spark, sf)).select(*PLACE, "line", "text", "trimmed")


@query(f"WITH {o.SYMBOLS} SELECT {SQL_SYMBOL} FROM symbols")
def extract_symbols(spark, sf):
    return derive.extract_symbols(b.code_files(spark, sf)).selectExpr(*SYMBOL)


@query(f"WITH {o.IMPORTS} SELECT {SQL_IMPORT} FROM imports")
def extract_imports(spark, sf):
    return derive.extract_imports(b.code_files(spark, sf)).select(*IMPORT)


@query(f"WITH {o.CODE}, {o.JS_SYMBOLS} SELECT {SQL_SYMBOL} FROM js_symbols")
def extract_js(spark, sf):
    return script.script_symbols(b.code_files(spark, sf)).selectExpr(*SYMBOL)


@query(f"WITH {o.CODE}, {o.JS_IMPORTS} SELECT {SQL_IMPORT} FROM js_imports")
def extract_js_imports(spark, sf):
    return script.script_imports(b.code_files(spark, sf)).select(*IMPORT)


def _script_part(name: str, where: str, table: str = "symbols") -> None:
    """One kind of declarations or imports of the rendered script files."""
    part, columns = (o.JS_SYMBOLS, SQL_SYMBOL) if table == "symbols" else (o.JS_IMPORTS, SQL_IMPORT)
    found = script.script_symbols if table == "symbols" else script.script_imports
    query(f"WITH {o.CODE}, {part} SELECT {columns} FROM js_{table} WHERE {where}", name)(
        lambda spark, sf: found(b.code_files(spark, sf)).filter(where).selectExpr(*(SYMBOL if table == "symbols" else IMPORT))
    )


_script_part("js_require", "import_type = 'require'", "imports")
_script_part("js_variables", "type = 'variable'")
_script_part("js_export_default", "scope = 'export' AND type <> 'class'")
_script_part("js_assigned_function", "name LIKE 'handler%'")


def _symbol_rule(name: str, part: str) -> None:
    sql = f"WITH {o.CODE}, {o.LINES % 'code'}, {part} SELECT {SQL_SYMBOL} FROM {name}"
    query(sql, name)(lambda spark, sf: extract.line_symbols(b.code_files(spark, sf), (name,)).selectExpr(*SYMBOL))


def _import_rule(name: str, part: str) -> None:
    sql = f"WITH {o.CODE}, {o.LINES % 'code'}, {part} SELECT {SQL_IMPORT} FROM {name}"
    query(sql, name)(lambda spark, sf: extract.line_imports(b.code_files(spark, sf), (name,)).select(*IMPORT))


_import_rule("py_import", o.PY_IMPORT)
_symbol_rule("py_function", o.PY_FUNCTION)
_symbol_rule("py_class", o.PY_CLASS)
_symbol_rule("py_variable", o.PY_VARIABLE)
_import_rule("php_require", o.PHP_REQUIRE)
_import_rule("php_use", o.PHP_USE)
_symbol_rule("php_function", o.PHP_FUNCTION)
_symbol_rule("php_class", o.PHP_CLASS)
_symbol_rule("php_constant", o.PHP_CONSTANT)


@query(f"""WITH {o.DOCS} SELECT project, path, array_to_string(list_slice(string_split(content, chr(10)), 1, 6), chr(10))
  AS near, array_to_string(list_slice(string_split(content, chr(10)), 7, 12), chr(10)) AS far FROM docs""")
def snippet(spark, sf):
    content = F.col("content")
    return b.documents(spark, sf).select(
        *PLACE, fn.snippet(content, 3).alias("near"), fn.snippet(content, 9, 2).alias("far")
    )


@query(f"""WITH {o.DOCS}, heads AS (SELECT project, path,
    array_to_string(list_slice(string_split(content, chr(10)), 1, 5), chr(10)) AS h5,
    array_to_string(list_slice(string_split(content, chr(10)), 1, 4), chr(10)) AS h4 FROM docs)
  SELECT project, path, CASE WHEN length(h5) > 500 THEN substr(h5, 1, 500) || '...' ELSE h5 END AS search,
    CASE WHEN length(h4) > 300 THEN substr(h4, 1, 300) || '...' ELSE h4 END AS context FROM heads""")
def snippet_head(spark, sf):
    content = F.col("content")
    return b.documents(spark, sf).select(
        *PLACE,
        fn.snippet_head(content, 5, 500).alias("search"),
        fn.snippet_head(content, 4, 300).alias("context"),
    )


@query(f"""WITH {o.DOCS}, cut AS (SELECT project, path, string_split(substr(content, 1, length(content) // 2), chr(10))
  AS parts FROM docs) SELECT project, path, len(parts)::INTEGER AS line, (length(parts[-1]) + 1)::INTEGER AS col FROM cut""")
def line_column(spark, sf):
    content = F.col("content")
    at = fn.line_column(content, F.floor(F.length(content) / 2).cast("int"))
    return b.documents(spark, sf).select(*PLACE, at.alias("at")).select(
        *PLACE, F.col("at.line").alias("line"), F.col("at.column").alias("col")
    )


# Full text


@query(f"""WITH {o.DOCS}, t AS (SELECT project, path, unnest(regexp_extract_all(strip_accents(lower(content)),
  '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS term FROM docs) SELECT project, path, term, count(*) AS n FROM t GROUP BY ALL""")
def tokens(spark, sf):
    words = b.documents(spark, sf).select(*PLACE, F.explode(fn.tokens(F.col("content"))).alias("term"))
    return words.groupBy(*PLACE, "term").agg(F.count("*").alias("n"))


@query(f"WITH {o.DOC_POSTINGS} SELECT project, path, field, term, pos::INTEGER AS pos FROM postings", "build_postings")
def all_postings(spark, sf):
    files = b.document_files(spark, sf)
    places = files.select("file_id", "path")
    return build_postings(files, fold_accents=False).join(places, "file_id").select(*PLACE, "field", "term", "pos")


def _match(name: str, sql: str, form) -> None:
    """A match form over the documents, shown by place."""

    def run(spark, sf):
        files = b.document_files(spark, sf)
        found = form(build_postings(files, fold_accents=False))
        return files.select("file_id", *PLACE).join(found, "file_id", "left_semi").select(*PLACE)

    query(f"WITH {o.DOC_POSTINGS} {sql}", name)(run)


HAS = "SELECT project, path FROM postings WHERE field = 'content' AND term"
_match("match_all", f"{HAS} = 'of' INTERSECT {HAS} = 'the' INTERSECT {HAS} = 'with'",
       lambda p: match.match_all(p, ["of", "the", "with"]))
_match("match_term", f"SELECT DISTINCT * FROM ({HAS} = 'avec')", lambda p: match.match_all(p, ["avec"]))
_match("match_any", f"{HAS} = 'avec' UNION {HAS} = 'und'", lambda p: match.match_any(p, ["avec", "und"]))
_match("match_not", f"({HAS} = 'the' INTERSECT {HAS} = 'of') EXCEPT ({HAS} = 'with' UNION {HAS} = 'for')",
       lambda p: match.match_not(p, ["the", "of"], ["with", "for"]))
_match("match_phrase", """SELECT DISTINCT a.project, a.path FROM postings a JOIN postings b
    ON a.project = b.project AND a.path = b.path AND b.field = 'content' AND b.pos = a.pos + 1
  WHERE a.field = 'content' AND a.term = 'of' AND b.term = 'the'""",
       lambda p: match.match_phrase(p, ["of", "the"]))
_match("match_prefix", f"SELECT DISTINCT * FROM ({HAS} LIKE 'whst%')", lambda p: match.match_prefix(p, "whst"))
_match("match_near", """SELECT DISTINCT a.project, a.path FROM postings a JOIN postings b
    ON a.project = b.project AND a.path = b.path AND b.field = 'content' AND abs(b.pos - a.pos) - 1 <= 3
  WHERE a.field = 'content' AND a.term = 'with' AND b.term = 'that'""",
       lambda p: match.match_near(p, ["with", "that"], 3))
_match("match_fields", """SELECT project, path FROM postings WHERE term = 'the' INTERSECT
  SELECT project, path FROM postings WHERE term = 'py'""",
       lambda p: match.match_all(p, ["the", "py"], match.ALL_FIELDS))

BULK = r"""asked AS (SELECT DISTINCT item_id AS query_id,
    unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}]+')) AS term FROM benchmark),
  needed AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
  has AS (SELECT DISTINCT project, path, term FROM postings WHERE field = 'content'),
  found AS (SELECT query_id, project, path FROM asked JOIN has USING (term) JOIN needed USING (query_id)
    GROUP BY query_id, project, path, n HAVING count(*) = n)"""


@query(f"WITH {o.DOC_POSTINGS}, {BULK} SELECT query_id, project, path FROM found")
def bulk_match_all(spark, sf):
    files = b.document_files(spark, sf)
    found = bulk.bulk_match_all(build_postings(files, fold_accents=False), b.bulk_terms(spark, sf))
    return found.join(files.select("file_id", *PLACE), "file_id").select("query_id", *PLACE)


@query(f"""WITH {o.DOC_POSTINGS}, {BULK} SELECT query_id, project, path, language FROM found
  JOIN docs USING (project, path) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY project, path) <= 5""")
def bulk_search(spark, sf):
    files = b.document_files(spark, sf)
    return bulk.bulk_search(build_postings(files, fold_accents=False), files, b.bulk_terms(spark, sf), limit=5)


# Queries


@query(f"""WITH {o.DOC_POSTINGS}, hit AS ({HAS} = 'for' INTERSECT {HAS} = 'that' INTERSECT {HAS} = 'this'),
  top AS (SELECT docs.*, array_to_string(list_slice(string_split(content, chr(10)), 1, 5), chr(10)) AS h
    FROM docs JOIN hit USING (project, path) ORDER BY project, path LIMIT 20)
  SELECT path, language, project, CASE WHEN length(h) > 500 THEN substr(h, 1, 500) || '...' ELSE h END AS snippet,
    length(content)::BIGINT AS content_length FROM top""")
def search_code(spark, sf):
    return search.search_code(b.document_index(spark, sf), "for that this")


@query(f"""WITH {o.DOC_POSTINGS}, hit AS (SELECT project, path FROM postings WHERE term = 'that' INTERSECT
    SELECT project, path FROM postings WHERE term = 'src4')
  SELECT project, path, language, round(file_size / 1024, 2) AS size_kb FROM docs JOIN hit USING (project, path)
  ORDER BY project, path LIMIT 20""")
def search_files(spark, sf):
    return search.search_files(b.document_index(spark, sf), "that src4")


@query(f"""WITH {o.SYMBOLS}, {o.POSTINGS % {"files": "code"}}, hit AS (
    SELECT project, path FROM postings WHERE term = 'customer' INTERSECT
    SELECT project, path FROM postings WHERE term = '12'),
  ranked AS (SELECT * FROM symbols WHERE contains(lower(name), 'customer 12')
    ORDER BY type, project, path, name, line, col LIMIT 15),
  heads AS (SELECT project, path, language, array_to_string(list_slice(string_split(content, chr(10)), 1, 4), chr(10))
    AS h FROM code JOIN hit USING (project, path) ORDER BY project, path LIMIT 15)
  SELECT 'file_match' AS kind, project, path, language, CASE WHEN length(h) > 300 THEN substr(h, 1, 300) || '...'
    ELSE h END AS snippet, NULL::VARCHAR AS name, NULL::VARCHAR AS symbol_type, NULL::INTEGER AS line,
    NULL::VARCHAR AS scope FROM heads
  UNION ALL SELECT 'symbol_match', project, path, language, NULL, name, type, line::INTEGER, scope FROM ranked
  QUALIFY row_number() OVER (PARTITION BY project, path, name ORDER BY type, line, col) = 1""")
def get_context(spark, sf):
    return search.get_context(b.code_index(spark, sf), "customer 12")


@query(f"""WITH {o.SYMBOLS}, {o.POSTINGS % {"files": "code"}}, ranked AS (SELECT * FROM symbols
    WHERE contains(lower(name), 'sum') ORDER BY type, project, path, name, line, col LIMIT 15),
  heads AS (SELECT project, path, language, array_to_string(list_slice(string_split(content, chr(10)), 1, 4), chr(10))
    AS h FROM code JOIN (SELECT DISTINCT project, path FROM postings WHERE term = 'sum') USING (project, path)
    ORDER BY project, path LIMIT 15)
  SELECT 'file_match' AS kind, project, path, language, CASE WHEN length(h) > 300 THEN substr(h, 1, 300) || '...'
    ELSE h END AS snippet, NULL::VARCHAR AS name, NULL::VARCHAR AS symbol_type, NULL::INTEGER AS line,
    NULL::VARCHAR AS scope FROM heads
  UNION ALL SELECT 'symbol_match', project, path, language, NULL, name, type, line::INTEGER, scope FROM ranked
  QUALIFY row_number() OVER (PARTITION BY project, path, name ORDER BY type, line, col) = 1""")
def get_context_symbols(spark, sf):
    return search.get_context(b.code_index(spark, sf), "sum")


FOUND = "name, type, path, language, project, line::INTEGER AS line, col::INTEGER AS col, scope"


@query(f"""WITH {o.SYMBOLS} SELECT {FOUND} FROM symbols WHERE contains(lower(name), 'order_1')
  ORDER BY type, path, project, line, col, name LIMIT 50""")
def find_symbol(spark, sf):
    symbols = derive.extract_symbols(b.code_files(spark, sf))
    return lookup.find_symbol(symbols, "Order_1").withColumnRenamed("column", "col")


@query(f"""WITH {o.SYMBOLS} SELECT {FOUND} FROM symbols WHERE starts_with(lower(name), 'c1') AND project = 'NATION_7'
  ORDER BY type, path, project, line, col, name LIMIT 50""")
def find_symbol_prefix(spark, sf):
    symbols = derive.extract_symbols(b.code_files(spark, sf))
    found = lookup.find_symbol(symbols, "c1", project="NATION_7", mode="prefix")
    return found.withColumnRenamed("column", "col")


@query(f"""WITH {o.CODE}, {o.LINES % 'code'} SELECT r.project, r.path, r.language, file_size AS size,
  (length(content) - length(replace(content, chr(10), '')) + 1)::INTEGER AS lines, line::INTEGER AS line_number,
  text AS content FROM raw_lines r JOIN code c ON r.path = c.path WHERE r.path = 'supplier_7_0.php'""")
def get_file(spark, sf):
    return lookup.get_file(b.code_files(spark, sf), "supplier_7_0.php")


@query(f"""WITH {o.CODE}, {o.DOCS} SELECT path, language, file_size, project FROM docs WHERE language = 'php'
  AND project = 'src5' ORDER BY path, project LIMIT 100""")
def list_files(spark, sf):
    files, projects = b.document_files(spark, sf), b.projects(spark, sf)
    return lookup.list_files(files, language="php", project="src5", projects=projects)


@query(f"""WITH {o.IMPORTS} SELECT project, import_path, import_name, import_type FROM imports
  WHERE path = 'customer_7_0.js'""")
def get_imports(spark, sf):
    return lookup.get_imports(derive.extract_imports(b.code_files(spark, sf)), "customer_7_0.js")


@query(f"""WITH {o.IMPORTS} SELECT DISTINCT project, path, language, import_name FROM imports
  WHERE contains(lower(import_path), 'nation_2') ORDER BY path, project, import_name LIMIT 50""")
def get_dependents(spark, sf):
    return lookup.get_dependents(derive.extract_imports(b.code_files(spark, sf)), "nation_2")


@query(f"""WITH {o.WEB}, {o.LINKS}, targets AS (SELECT DISTINCT import_path AS target FROM links)
  SELECT DISTINCT target, project, path, language, import_name FROM links JOIN targets
  ON contains(lower(import_path), lower(target))""")
def bulk_dependents(spark, sf):
    links = b.links(spark, sf)
    return bulk.bulk_dependents(links, links.select(F.col("import_path").alias("target")), limit=None)


@query(f"""WITH {o.SYMBOLS}, needles AS (SELECT unnest(['order_' || n_nationkey, n_nationkey::VARCHAR]) AS needle
    FROM nation) SELECT needle, {FOUND} FROM symbols JOIN needles ON contains(lower(name), needle)
  QUALIFY row_number() OVER (PARTITION BY needle ORDER BY type, path, project, line, col, name) <= 50""")
def bulk_find_symbol(spark, sf):
    symbols = derive.extract_symbols(b.code_files(spark, sf))
    return bulk.bulk_find_symbol(symbols, b.needles(spark, sf)).withColumnRenamed("column", "col")


@query(f"""WITH {o.SYMBOLS_AND_IMPORTS} SELECT (SELECT count(*) FROM code) AS indexed_files,
  (SELECT count(*) FROM symbols) AS total_symbols, (SELECT count(*) FROM imports) AS total_imports,
  (SELECT round(sum(file_size) / 1048576, 2) FROM code) AS size_mb""")
def index_stats(spark, sf):
    return stats.index_stats(b.code_index(spark, sf))


BREAKDOWN = f"""WITH {o.ALL_SYMBOLS}
  SELECT language, count(*) AS file_count, coalesce(any_value(n), 0)::BIGINT AS symbol_count FROM every
  LEFT JOIN (SELECT language, count(*) AS n FROM symbols GROUP BY language) USING (language) GROUP BY language"""


def _breakdown_files(spark, sf):
    return b.code_files(spark, sf).unionByName(b.document_files(spark, sf)).unionByName(corpus.index_files(b.pages(spark, sf)))


@query(BREAKDOWN)
def language_breakdown(spark, sf):
    files = _breakdown_files(spark, sf)
    return stats.language_breakdown(files, derive.extract_symbols(files))


@query(BREAKDOWN + " ORDER BY file_count DESC, language LIMIT 2")
def language_breakdown_top(spark, sf):
    files = _breakdown_files(spark, sf)
    return stats.language_breakdown(files, derive.extract_symbols(files), limit=2)


@query(f"WITH {o.SYMBOLS} SELECT type, count(*) AS count FROM symbols GROUP BY type")
def symbols_by_type(spark, sf):
    return stats.symbols_by_type(derive.extract_symbols(b.code_files(spark, sf)))


@query(f"""WITH {o.DOCS} SELECT project, path, language, round(file_size / 1024, 2) AS size_kb,
  last_modified AS modified_at FROM docs WHERE language = 'php' ORDER BY last_modified DESC, path, project LIMIT 100""")
def recent_files(spark, sf):
    return stats.recent_files(b.document_files(spark, sf), language="php")


@query(f"""WITH {o.DOCS}, {o.PROJECTS} SELECT (SELECT max(last_indexed) FROM projects) AS last_indexed, project, path,
  language, last_modified AS modified_at FROM docs ORDER BY last_modified DESC, path, project LIMIT 10""")
def index_activity(spark, sf):
    return stats.index_activity(b.document_files(spark, sf), b.runs(spark, sf))


@query(f"""WITH {o.PROJECTS} SELECT name, folder_path AS folder, 'indexed' AS status, file_count AS files,
  0::BIGINT AS symbols, strftime(last_indexed, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS last_indexed FROM projects""")
def list_projects(spark, sf):
    return stats.list_projects(b.projects(spark, sf))


@query(f"""WITH {o.SYMBOLS}, s AS (SELECT project, count(*) AS n FROM symbols GROUP BY project)
  SELECT project, count(*) AS file_count, coalesce(any_value(n), 0)::BIGINT AS symbol_count
  FROM code LEFT JOIN s USING (project) GROUP BY project""")
def project_stats(spark, sf):
    index = b.code_index(spark, sf)
    return stats.project_stats(index.files, index.symbols)


# Maintenance


@query(f"WITH {o.SCAN} SELECT project, path, status FROM diff")
def diff_files(spark, sf):
    return maintain.diff_files(b.scan(spark, sf), b.document_files(spark, sf))


@query(f"""WITH {o.SCAN}, told AS (SELECT diff.*, scan.content, CASE WHEN scan.path IS NOT NULL
    AND TRY_CAST(regexp_extract(diff.path, 'doc_([0-9]+)', 1) AS BIGINT) % 50 = 7 THEN 'failed' ELSE status END AS told
  FROM diff LEFT JOIN scan ON scan.path = diff.path AND scan.project IS NOT DISTINCT FROM diff.project)
  SELECT count(*) FILTER (told IN ('new', 'changed')) AS indexed, count(*) FILTER (told = 'skipped') AS skipped,
  count(*) FILTER (told = 'failed') AS failed,
  sum(CASE WHEN told IN ('new', 'changed') THEN len(regexp_extract_all(content, 'href="')) ELSE 0 END)::BIGINT AS symbols,
  sum(CASE WHEN told IN ('new', 'changed') THEN len(regexp_extract_all(content, {o.LINK})) ELSE 0 END)::BIGINT AS imports
  FROM told""")
def run_summary(spark, sf):
    # Stand in for symbols and imports: marks and links of the files, which the pages of the scan have plenty of.
    scan = b.scan(spark, sf)
    files = corpus.index_files(scan)
    found = lambda pattern: files.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))))
    number = F.regexp_extract("path", "doc_([0-9]+)", 1).try_cast("bigint")
    failed = scan.filter(number % 50 == 7).select("project", "path")
    return maintain.run_summary(maintain.diff_files(scan, b.document_files(spark, sf)), found('href="'), found(b.LINK), failed)


def _contents(index):
    """What an index holds, per file."""
    words = index.postings.groupBy("file_id").agg(F.count("*").alias("words"))
    return index.files.join(words, "file_id", "left").select(
        *PLACE, "language", "last_modified", "content_length", "words"
    )


SQL_WORDS = r"""(len(regexp_extract_all(lower(content), '[\p{L}\p{N}\p{Co}]+')) +
  len(regexp_extract_all(lower(path), '[\p{L}\p{N}\p{Co}]+')))::BIGINT AS words"""
KEPT = f"SELECT project, path, language, last_modified, length(content)::BIGINT AS content_length, {SQL_WORDS}"


@query(f"""WITH {o.SCAN}, after AS (SELECT scan.* FROM scan JOIN diff ON scan.path = diff.path AND scan.project IS NOT
    DISTINCT FROM diff.project WHERE status IN ('new', 'changed')
  UNION ALL SELECT project, path, content, file_size, language, last_modified FROM docs SEMI JOIN
    (SELECT path FROM diff WHERE status IN ('skipped')) USING (path)) {KEPT} FROM after""")
def apply_changes(spark, sf):
    index = b.document_index(spark, sf)
    return _contents(maintain.refresh(index, b.scan(spark, sf), prune=True))


@query(f"""WITH {o.DOCS}, {o.FEED}, gone AS (SELECT project, path, arg_max(action, (ts, seq)) AS last FROM (
    SELECT 'src' || user_id % 20 AS project, 'src' || user_id % 20 || '/doc_' || user_id || e AS path, ts, event_id AS
      seq, CASE event_type WHEN 'error' THEN 'unlink' ELSE 'keep' END AS action
    FROM events, (VALUES ('.py'), ('.js'), ('.php'), ('.ts'), ('.md')) v(e)) GROUP BY ALL)
  {KEPT} FROM docs WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.project = docs.project AND gone.path = docs.path
    AND last = 'unlink')""")
def delete_files(spark, sf):
    key = F.col("user_id")
    unlinked = (
        b.table(spark, sf, "events")
        .withColumn("extension", F.explode(F.array(*[F.lit(e) for e in (".py", ".js", ".php", ".ts", ".md")])))
        .select(
            b.text("src", key % 20).alias("project"),
            b.text("src", key % 20, "/doc_", key, F.col("extension")).alias("path"),
            F.when(F.col("event_type") == "error", "unlink").otherwise("keep").alias("action"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            F.lit(None).cast("string").alias("content"),
        )
    )
    last = maintain.latest_changes(unlinked).filter(F.col("action") == "unlink")
    return _contents(maintain.apply_changes(b.document_index(spark, sf), last))


@query(f"""WITH {o.PROJECTS} SELECT name, folder_path, 'indexed' AS status, file_count FROM projects
  UNION ALL SELECT 'fresh', '/corpus/deep/fresh', 'pending', 0""")
def add_project(spark, sf):
    projects = maintain.add_project(b.projects(spark, sf), "/corpus/deep/fresh/")
    again = maintain.add_project(projects, "/corpus/src3", "other name")
    return again.select("name", "folder_path", "status", "file_count")


@query(f"WITH {o.DOCS} {KEPT} FROM docs WHERE project <> 'src3'")
def remove_project(spark, sf):
    return _contents(maintain.remove_project(b.document_index(spark, sf), "/corpus/src3"))


# Change feed

GAP = "30 minutes"


@query(f"""WITH {o.sessions("project", 30)} SELECT project, start, max(ts) AS last, count(*) AS events
  FROM sessions GROUP BY project, start""")
def debounce(spark, sf):
    return sessions.debounce(b.feed(spark, sf), GAP)


@query(f"""WITH {o.sessions("project", 30)} SELECT project, start, path, arg_max(action, (ts, seq)) AS action,
  max(ts) AS ts FROM sessions GROUP BY project, start, path""")
def last_action(spark, sf):
    return sessions.last_action(b.feed(spark, sf), GAP)


@query(f"""WITH {o.sessions("project", 30)} SELECT project, path, action, ts, seq, content FROM sessions
  QUALIFY row_number() OVER (PARTITION BY project, start, path ORDER BY ts DESC, seq DESC) = 1""")
def actions_in(spark, sf):
    changes = b.feed(spark, sf)
    return sessions.actions_in(sessions.debounce(changes, GAP), changes, GAP).drop("start")


@query(f"""WITH {o.sessions("project, path", 2880)} SELECT project, path, start, max(ts) AS ts,
  arg_max(action, (ts, seq)) AS action, max(ts) + INTERVAL 2880 MINUTE - INTERVAL 1 MICROSECOND AS settled
  FROM sessions GROUP BY project, path, start""")
def settle(spark, sf):
    return sessions.settle(b.feed(spark, sf), "2 days")


@query(f"""WITH {o.sessions("project, path", 720)}, settled AS (SELECT project,
    max(ts) + INTERVAL 720 MINUTE - INTERVAL 1 MICROSECOND AS t FROM sessions GROUP BY project, path, start),
  gaps AS (SELECT *, CASE WHEN t > lag(t) OVER (PARTITION BY project ORDER BY t) + INTERVAL 1 HOUR THEN 1 ELSE 0
    END AS opens FROM settled),
  runs AS (SELECT *, sum(opens) OVER (PARTITION BY project ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM gaps)
  SELECT project, min(t) AS start, max(t) AS last, count(*) AS paths FROM runs GROUP BY project, nr""")
def debounce_settled(spark, sf):
    return sessions.debounce_settled(b.feed(spark, sf), "12 hours", "1 hour")


@query(f"WITH {o.FEED} SELECT project, action, count(*) AS changes, max(ts) AS latest FROM feed GROUP BY ALL")
def change_stats(spark, sf):
    return feeds.change_stats(feeds.filter_feed(b.feed(spark, sf)))
