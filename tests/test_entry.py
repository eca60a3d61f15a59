"""The entry file without its optional parts."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked}:
            raise ImportError(name + " is absent")
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from checks.queries import ORACLE, QUERIES
assert entry.queries() == QUERIES, set(entry.queries()) ^ set(QUERIES)
assert entry.oracle_sql() == ORACLE
"""


def test_queries_without_an_optional_package():
    for blocked in ({"xxhash"}, {"public_tokenizers"}):
        done = subprocess.run([sys.executable, "-c", WITHOUT.format(blocked=blocked)], cwd=REPO, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
