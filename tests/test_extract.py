from lineloom.operators import extract
from lineloom.operators.derive import extract_imports, extract_symbols
from lineloom.operators.extract_js import FUNCTION, script_imports, script_rows, script_symbols

PYTHON = """# settings loader
import os.path
import numpy as np
from app.core import load, save
LIMIT = 10
ready == LIMIT
rate: int = 3
class Loader(Base):
    flag = True
    def run(self, x):
        import json
    async def poll(self):
        pass
def main ():
    return 1
"""
PHP = r"""<?php
# boot
use Acme\Http\Client;
use function Acme\helper;
require_once 'lib/db.php';
require('lib/no.php');
const RETRIES = 3;
abstract class Repo extends Base {
    public const TTL = 60;
    private function find($id) {
    public static function make() {
final class Sealed {
"""
SCRIPT = """import fs from 'fs';
import 'side';
const q = require('queue');
const { a } = require('parts');
function outer() {
  const inner = 1;
  if (q) {
    const hidden = 2;
  }
  function deep() {
    let z = 1;
  }
}
class K {
  constructor() {
    const no = 1;
  }
  run() {
  }
}
export const limit = 3;
export default function start() {
  const s = 1;
}
handler = () => {
};
"""


def symbols(files, path, text):
    rows = extract_symbols(files(("p", path, text))).orderBy("line", "column").collect()
    return [(r.name, r.type, r.line, r.column, r.scope) for r in rows]


def imports(files, path, text):
    rows = extract_imports(files(("p", path, text))).collect()
    return sorted(((r.import_path, r.import_name, r.import_type) for r in rows), key=str)


def test_python(files):
    assert symbols(files, "a.py", PYTHON) == [
        ("LIMIT", "variable", 5, 1, None),
        ("ready", "variable", 6, 1, None),
        ("Loader", "class", 8, 1, None),
        ("run", "function", 10, 5, None),
        ("main", "function", 14, 1, None),
    ]
    assert imports(files, "a.py", PYTHON) == [
        ("", "json", "import"),
        ("", "numpy as np", "import"),
        ("", "os", "import"),
        ("app.core", "load, save", "from_import"),
    ]


def test_python_lines(files):
    text = "  # no = 1\n\u00a0x = 1\ny = 2\r\nif = 3\n\tz = 4\nfrom a import (b)\nimport c as d  # e\n"
    assert symbols(files, "a.py", text) == [
        ("x", "variable", 2, 2, None),
        ("y", "variable", 3, 1, None),
    ]
    # A parenthesis is no name, so that import is not seen.
    assert imports(files, "a.py", text) == [("", "c as d", "import")]


def test_php(files):
    assert symbols(files, "a.php", PHP) == [
        ("RETRIES", "constant", 7, 7, None),
        ("Repo", "class", 8, 10, None),
        ("TTL", "constant", 9, 18, None),
        ("find", "function", 10, 13, None),
    ]
    assert imports(files, "a.php", PHP) == [
        ("Acme\\Http\\Client", "Client", "use"),
        ("function", "function", "use"),
        ("lib/db.php", None, "require"),
    ]


def test_script(files):
    expected = [
        ("q", "variable", 3, 6, None),
        ("outer", "function", 5, 0, None),
        ("inner", "variable", 6, 8, "outer"),
        ("deep", "function", 10, 2, "outer"),
        ("z", "variable", 11, 8, "deep"),
        ("K", "class", 14, 0, None),
        ("constructor", "constructor", 15, 2, "K"),
        ("run", "method", 18, 2, "K"),
        ("limit", "variable", 21, 13, "export"),
        ("start", "function", 22, 15, "export"),
        ("s", "variable", 23, 8, "export"),
        ("handler", "function", 25, 0, None),
    ]
    for path in ("a.js", "b.tsx"):
        assert symbols(files, path, SCRIPT) == expected
    assert imports(files, "a.js", SCRIPT) == [
        ("fs", "fs", "import"),
        ("parts", None, "require"),
        ("queue", "q", "require"),
        ("side", None, "import"),
    ]


def test_script_headers_over_several_lines(files):
    text = """export async function load(
  { a, b },
  c = [1, 2],
) {
  let first, second = 2;
}
export class Store
  extends Base
{
  static size = 3;
  name
  get value() { return 1; }
  async *each(x) {
    const hidden = { deep() {} };
  }
}
function plain()
{
  { const block = 1; }
  var after = 1;
}
declare function typed(x: number): void;
export default class Root {
  method() {}
}
"""
    assert symbols(files, "a.ts", text) == [
        ("load", "function", 1, 7, "export"),
        ("first", "variable", 5, 6, "load"),
        ("second", "variable", 5, 13, "load"),
        ("Store", "class", 7, 7, "export"),
        ("size", "method", 10, 2, "Store"),
        ("name", "method", 11, 2, "Store"),
        ("value", "method", 12, 2, "Store"),
        ("each", "method", 13, 2, "Store"),
        ("plain", "function", 17, 0, None),
        ("after", "variable", 20, 6, "plain"),
        ("Root", "class", 23, 15, "export"),
    ]


def test_script_text_that_looks_like_code(files):
    text = r"""// function no() {
/* const no = 1;
   class No { */
const a = "} function no() {"; const b = '\'{';
const re = /[/{]"/; const t = `{
  function no() {
`;
describe('x', () => {
  const hidden = 1;
});
for (let i = 0; i < 3; i++) {
  var loop = 1;
}
const enough = 1;
"""
    names = [(n, line) for n, _, line, _, _ in symbols(files, "a.js", text)]
    assert names == [("a", 4), ("b", 4), ("re", 5), ("t", 5), ("enough", 14)]


def test_script_statements_over_several_lines(files):
    text = """let total = 1 +
  extra;
const pick = x =>
  x.y;
i++
class A {
  sum = one +
    two;
  third = cond
    ? four
    : five;
  pair = <B c={1} />;
}
export default async (a) => {
  const kept = 1;
  [1].map(x => {
    const hidden = 2;
  });
}
"""
    assert [(n, k, at, scope) for n, k, at, _, scope in symbols(files, "a.js", text)] == [
        ("total", "variable", 1, None),
        ("pick", "variable", 3, None),
        ("A", "class", 6, None),
        ("sum", "method", 7, "A"),
        ("third", "method", 9, "A"),
        ("pair", "method", 12, "A"),
        ("kept", "variable", 15, "export"),
    ]


def test_script_imports(files):
    text = """import React, { useState as state, type Ref, type A as B } from "react";
import * as path from 'path'
import {
  one,
  two,
} from './[id]/parts';
import type { T } from './types';
export { x } from './not';
const lazy = import('./lazy');
const x = require('a').b, y = require("c");
function f() { const z = require('inner'); }
if (f) { const w = require('block'); }
const none = require();
// import no from 'no'
"""
    assert imports(files, "a.js", text) == sorted(
        [
            ("react", "React, state, Ref, B", "import"),
            ("path", "path", "import"),
            ("./[id]/parts", "one, two", "import"),
            ("./types", "T", "import"),
            ("c", "y", "require"),
            ("inner", "z", "require"),
        ],
        key=str,
    )


def test_other_languages_and_odd_files(files):
    odd = [("p", "a.md", PYTHON), ("p", "b.py", ""), ("p", "c.js", ""), ("p", "d.js", "}}}) {{ function"), (None, "e.php", "<?php")]
    assert extract_symbols(files(*odd)).isEmpty()
    assert extract_imports(files(*odd)).isEmpty()


def test_long_lines_do_not_break(files):
    text = "const a = [" + "'{x}'," * 50_000 + "];\n" + " " * 200_000 + "x\nconst b = 1;" + "f(/[a]/);" * 5_000
    assert [s[0] for s in symbols(files, "a.js", text)] == ["a", "b"]


def test_registered_rules(files):
    extract.register_rules(
        "go",
        [
            extract.SymbolRule("go_function", "function", r"^func\s+(\w+)\(", anchor="func"),
            extract.ImportRule("go_import", "import", r'^import\s+"([^"]+)"', 1, 1, last_of="/"),
        ],
    )
    try:
        text = 'package a\nimport "net/http"\nfunc main() {\n'
        assert symbols(files, "a.go", text) == [("main", "function", 3, 1, None)]
        assert imports(files, "a.go", text) == [("net/http", "http", "import")]
    finally:
        del extract.RULES["go"]


def test_script_shapes_without_bounds(files):
    """Deep nesting, wide gaps, regex after keywords, lists over lines, object types."""
    deep = "".join(f"{'  ' * i}function f{i}() {{\n" for i in range(13)) + "const inner = 1;\n" + "}\n" * 13
    cases = {
        "deep.js": (deep, [(f"f{i}", f"f{i - 1}" if i else None) for i in range(13)] + [("inner", "f12")]),
        "gap.js": ("const r =          /[{]/;\nfunction two() {}\n", [("r", None), ("two", None)]),
        "nest.js": ("const a = f(g(h(i(1))), q = 3), z = [1, [2, k = 3]];\n", [("a", None), ("z", None)]),
        "word.js": (
            "function one(s) { return /[{]/.test(s); }\nfunction two() { const v = 1; }\nconst d = a / b / c;\n",
            [("one", None), ("two", None), ("v", "two"), ("d", None)],
        ),
        "list.js": (
            "const a = require('a'),\n  b = require('b');\nlet x = { k: 1 },\n  y = 2;\nfoo(1,\n 2);\nvar m = 1, n = g(1,\n 2), o = 3;\n",
            [(n, None) for n in "abxymno"],
        ),
        "type.ts": (
            "function q(): { a: number } {\n  const inner = 1;\n}\nfunction r(o: { b: string }) { let w = 2; }\nexport const p = 1,\n  s = 2;\n",
            [("q", None), ("inner", "q"), ("r", None), ("w", "r"), ("p", "export"), ("s", "export")],
        ),
    }
    found = script_symbols(files(*[("p", path, content) for path, (content, _) in cases.items()]))
    rows = found.orderBy("path", "line", "column").collect()
    for path, (_, expected) in cases.items():
        assert [(r.name, r.scope) for r in rows if r.path == path] == expected, path
    imports = script_imports(files(("p", "list.js", cases["list.js"][0]))).collect()
    assert sorted((r.import_path, r.import_name) for r in imports) == [("a", "a"), ("b", "b")]


def test_statements_over_lines(files):
    """Keywords and calls that a line end cuts, with blank lines and comments between; places are those of the text."""
    text = (
        "const\n  a = 1;\nlet // why\n\n  b = 2, c = 3;\nfunction\nfoo() {\n  var\n    d = 1;\n}\n"
        "const late = require(\n  'late'\n), more = require('more');\nconst { x } = require(\n 'apart' );\n"
        "export\ndefault\nclass Shop {\n  sell() {}\n}\nexport\nconst e = 1; let\nf = 2; const g = 3;\nobj.default\nh = function () {};\n"
        "const i = mine(\n  'not'\n);\nfunction*\n  gen() {}\nclass\nBox extends\n Base { open() {} }\n"
    )
    found = files(("p", "a.js", text), ("p", "b.ts", text), ("p", "vt.js", "let\u000bq = 1;\nlet r = 2;\n"))
    symbols = sorted((r.path, r.line, r.column, r.name, r.type, r.scope) for r in script_symbols(found).collect())
    want = [
        (2, 2, "a", "variable", None),
        (5, 2, "b", "variable", None),
        (5, 9, "c", "variable", None),
        (6, 0, "foo", "function", None),
        (9, 4, "d", "variable", "foo"),
        (11, 6, "late", "variable", None),
        (13, 3, "more", "variable", None),

        (22, 6, "e", "variable", "export"),
        (23, 0, "f", "variable", None),
        (23, 13, "g", "variable", None),
        (25, 0, "h", "function", None),
        (26, 6, "i", "variable", None),
        (29, 0, "gen", "function", None),
        (31, 0, "Box", "class", None),
        (33, 8, "open", "method", "Box"),
    ]
    got = [s[1:] for s in symbols if s[0] == "a.js" and s[3] != "Shop"]
    assert got == want, got
    assert [s[1:] for s in symbols if s[0] == "b.ts" and s[3] != "Shop"] == want
    assert [s[1:4] for s in symbols if s[0] == "vt.js"] == [(1, 4, "q"), (2, 4, "r")]
    imports = sorted((r.import_path, r.import_name) for r in script_imports(found.filter("path = 'a.js'")).collect())
    assert imports == [("apart", None), ("late", "late"), ("more", "more")]


def test_scripts_are_read_where_their_text_is(files):
    """No shuffle, sort or window over the pieces: only the text's own row is needed."""
    one = files(("p", "a.js", SCRIPT))
    for rows in (script_symbols(one), script_imports(one), script_rows(one)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not [step for step in ("Exchange", "Window", "Sort") if step in plan]


def test_scripts_of_one_key_are_read_apart(files):
    once = sorted(map(str, script_symbols(files(("p", "a.js", SCRIPT))).collect()))
    twice = sorted(map(str, script_symbols(files(("p", "a.js", SCRIPT), ("p", "a.js", SCRIPT))).collect()))
    assert twice == sorted(once * 2)


def test_imports_mask_each_text_once(files):
    rows = script_imports(files(("p", "a.js", SCRIPT)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_heads_are_tried_once(spark, files):
    """What the walk was told of a head is not looked for again in each row that has it around."""
    shown = "spark.sql.debug.maxToStringFields"
    spark.conf.set(shown, "1000")
    try:
        plan = script_symbols(files(("p", "a.js", SCRIPT)))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(shown)
    after_walk = plan.split("ArrowEvalPython")[0]
    assert FUNCTION in plan and f", {FUNCTION})" not in after_walk and f"RLIKE {FUNCTION}" not in after_walk


def test_symbols_by_name_read_only_files_that_can_have_the_name(files):
    from lineloom.operators.derive import extract_symbols_named

    table = files(
        ("p", "a.py", "def Total():\n    pass"),
        ("p", "b.js", "const subtotal = 1;"),
        ("p", "c.js", "const \\u0041x = 1;"),  # an escape is masked: the name is not in the text
        ("p", "d.php", "function other() {"),
        ("p", "e.md", "total = 1"),
    )
    every = extract_symbols(table)
    for needle in ("total", "TOTAL", "__", "other", "to tal", ""):
        found = sorted(r["name"] for r in extract_symbols_named(table, needle).collect())
        assert found == sorted(r["name"] for r in every.collect() if needle.lower() in r["name"].lower()), needle
    assert "__" in "".join(r["name"] for r in every.collect())
