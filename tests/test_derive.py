"""One pass over the texts gives the same rows as a pass for each table."""

from lineloom.operators.derive import extract_all, extract_imports, extract_symbols
from lineloom.operators.tagged import untagged
from test_extract import PHP, PYTHON

SCRIPT = """import a, { b as c,
  d } from './mod';import 'side';
const fs = require('fs'), x = 1;
// import none from 'comment'
const { p, q } = require("pq");
export default class Shop extends Base { sell(x) { const no = require('no'); } static open() {} }
export function f() { let inner = g(1, 2); }
export const g = 2,
  h = require('late');
"""


def test_one_pass_equals_two(files):
    found = files(
        ("p", "a.py", PYTHON), ("p", "b.php", PHP), ("p", "c.js", SCRIPT), ("q", "d.ts", "import type { T } from 't';\nlet v = 1;\n"), (None, "e.py", "import os\n"),
        ("p", "f.js", ""), ("p", "g.go", "func x"), ("p", "h.js", "import 'only';"), ("p", "i.js", "{\nconst no = 1;\n}\nlet yes;"),
    )
    rows = extract_all(found)
    whole = lambda df: sorted(map(str, df.collect()))
    for table, want in (("symbols", extract_symbols(found)), ("imports", extract_imports(found))):
        got = untagged(rows, table)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert whole(got) == whole(want) and want.count() > 8
