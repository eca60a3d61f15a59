"""What patterns say of a line or a piece is asked once, in generated code or over Arrow columns."""

from lineloom.operators.derive import extract_all, extract_symbols
from lineloom.operators.extract import line_rows, line_symbols
from lineloom.operators.extract_js import script_imports, script_rows, script_symbols


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_line_rules_need_no_lambda(files):
    one = files(("p", "a.py", "import os\ndef f(x):\n  y = 1\n"), ("p", "b.php", "class A extends B\nconst C = 1;"))
    for rows in (line_symbols(one), line_rows(one)):
        assert "lambda" not in plan(rows)


def test_pieces_are_told_apart_in_the_walk_and_walked_once(files):
    one = files(("p", "a.js", "export class A {\n  run() {\n  }\n}\nconst b = require('c');\n"))
    for rows in (script_symbols(one), script_imports(one), script_rows(one)):
        shown = plan(rows)
        assert shown.count("_walked(") == 1
        # Only whether a text has cut statements is asked before, and not if the array of a walk has rows.
        assert shown.split("ArrowEvalPython")[1].count("RLIKE") <= 2 and "size(pythonUDF" not in shown


def test_words_with_characters_beyond_ascii_are_no_keywords(files):
    text = "functioné(a) {\n}\nconst x = 1;\nclassé B {\n}\nlet y = 2 \nfunction $f() {\n}\nclass $C {\n  m() {\n  }\n}\n"
    table = files(("p", "a.js", text), ("p", "b.js", ""), ("p", "c.js", "\n\n\nvar z = 3"))
    found = sorted((r.path, r.name, r.type, r.line) for r in extract_symbols(table).collect())
    assert found == [
        ("a.js", "$C", "class", 9), ("a.js", "$f", "function", 7), ("a.js", "m", "method", 10),
        ("a.js", "x", "variable", 3), ("a.js", "y", "variable", 6), ("c.js", "z", "variable", 4),
    ]
    assert extract_all(table).filter("table = 'symbols'").count() == len(found)
