"""The breakdown by language counts every table of files that there is."""

import duckdb
import pytest

from checks.queries import ORACLE, QUERIES

TABLES = {
    "nation": "SELECT 1 AS n_nationkey, 'N1' AS n_name",
    "customer": "SELECT 5::BIGINT AS c_custkey, 1 AS c_nationkey",
    "orders": "SELECT 7::BIGINT AS o_orderkey, 5::BIGINT AS o_custkey",
    "supplier": "SELECT 0::BIGINT AS s_suppkey, 1 AS s_nationkey",
    "part": "SELECT 3::BIGINT AS p_partkey, 4 AS p_size",
    "pages": "SELECT 1::BIGINT AS page_id, 'http://a.example/x' AS url, '<p>' AS html",
    "documents": """SELECT * FROM (VALUES (0::BIGINT, 'def a():' || chr(10) || ' pass', 'en', 's0'), (1, 'LIMIT = 1', 'en', 's1'),
        (2, 'un texte', 'fr', 's0'), (3, NULL, 'de', 's0'), (4, 'x = 1', NULL, 's0'), (5, 'y = 1', 'en', NULL)) t(doc_id, text, lang, source)""",
}
#: One rendered file of each of three languages, a page, and the documents.
WANTED = [("javascript", 2, 14), ("markdown", 1, 0), ("php", 2, 3), ("python", 3, 5), ("unknown", 2, 0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, rows in TABLES.items():
        duckdb.execute(f"COPY ({rows}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def test_breakdown_counts_documents_of_every_language(spark, folder):
    found = QUERIES["language_breakdown"](spark, folder).collect()
    assert sorted(map(tuple, found)) == WANTED
    top = QUERIES["language_breakdown_top"](spark, folder).collect()
    assert [tuple(r) for r in top] == [("python", 3, 5), ("javascript", 2, 14)]


def test_the_sql_of_the_breakdown_counts_them_too(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert sorted(con.execute(ORACLE["language_breakdown"]).fetchall()) == WANTED
