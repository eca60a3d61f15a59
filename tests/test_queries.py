"""A part of the registered queries against their SQL, at the smallest scale; all of them
run with ``python -m checks.compare``."""

import os

import pytest

SF = "/root/testdata/sf0.001"

pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("no test tables here", allow_module_level=True)

from checks.compare import compare  # noqa: E402
from checks.queries import ORACLE, QUERIES  # noqa: E402

SOME = [
    "with_language",
    "relative_path",
    "php_constant",
    "py_import",
    "snippet_head",
    "match_phrase",
    "bulk_match_all",
    "bulk_dependents",
    "recent_files",
    "index_activity",
    "diff_files",
    "last_action",
    "settle",
]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    result = compare(spark, SF, name)
    assert result.startswith("OK"), result


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)
