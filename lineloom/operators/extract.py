"""Symbols and imports of line-based languages, as one pass over the lines.

A rule is data: a pattern tried on the trimmed line, and which group feeds which
column. All rules of all registered languages become one array expression per line,
so a file is split and scanned once and the work never leaves generated code.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions import text
from lineloom.operators.corpus import lines
from lineloom.operators.tagged import TAGGED, tagged_import, tagged_symbol

# The line patterns that define what is a symbol or an import.
PATTERNS = {
    "py_import": r"^(?:from\s+([\w.]+)\s+)?import\s+([\w\s,*]+)",
    "py_function": r"^def\s+(\w+)\s*\(",
    "py_class": r"^class\s+(\w+)\s*[\(:]",
    "py_variable": r"^(\w+)\s*=",
    "py_not_variable": r"^(if|for|while|with|try|except|finally)$",
    "php_require": r"""^(?:require|include|require_once|include_once)\s+['"]([^'"]+)['"]""",
    "php_use": r"^use\s+([\w\\]+)",
    "php_function": r"^(?:public\s+|private\s+|protected\s+)?function\s+(\w+)\s*\(",
    "php_class": r"^(?:abstract\s+)?class\s+(\w+)\s*(?:extends|implements|\{)",
    "php_constant": r"^(?:const|public\s+const)\s+(\w+)\s*=",
}


@dataclass(frozen=True)
class SymbolRule:
    """``pattern`` names the symbol with group 1. The column is where ``anchor`` (default:
    the name) first stands in the line. ``top_level`` asks for an unindented line,
    ``reject`` drops names that match it."""

    name: str
    type: str
    pattern: str
    anchor: str | None = None
    top_level: bool = False
    reject: str | None = None


@dataclass(frozen=True)
class ImportRule:
    """Groups of ``pattern`` for the import path and name (0: none). ``type`` is used
    when the path is there, ``bare_type`` when its group stayed empty; ``last_of`` keeps
    the last part of the name after that separator."""

    name: str
    type: str
    pattern: str
    path_group: int
    name_group: int = 0
    bare_type: str | None = None
    last_of: str | None = None


Rule = SymbolRule | ImportRule

RULES: dict[str, list[Rule]] = {}


def register_rules(language: str, rules: list[Rule]) -> None:
    """Add or replace the rules of a language, for every later extraction."""
    RULES[language] = list(rules)


register_rules(
    "python",
    [
        ImportRule("py_import", "from_import", PATTERNS["py_import"], 1, 2, bare_type="import"),
        SymbolRule("py_function", "function", PATTERNS["py_function"], anchor="def"),
        SymbolRule("py_class", "class", PATTERNS["py_class"], anchor="class"),
        SymbolRule(
            "py_variable",
            "variable",
            PATTERNS["py_variable"],
            top_level=True,
            reject=PATTERNS["py_not_variable"],
        ),
    ],
)
register_rules(
    "php",
    [
        ImportRule("php_require", "require", PATTERNS["php_require"], 1),
        ImportRule("php_use", "use", PATTERNS["php_use"], 1, 1, last_of="\\"),
        SymbolRule("php_function", "function", PATTERNS["php_function"], anchor="function"),
        SymbolRule("php_class", "class", PATTERNS["php_class"], anchor="class"),
        SymbolRule("php_constant", "constant", PATTERNS["php_constant"]),
    ],
)


def _group(pattern: str, group: int) -> Column:
    """Group of a pattern on the trimmed line, with ``\\s`` meaning every Unicode blank."""
    return F.regexp_extract(
        F.col("trimmed"), pattern.replace(r"\s", f"[{text.BLANKS}]"), group
    )


def _tried(language: str, rule: Rule) -> Column:
    """What the rule's pattern finds in a line of its language: the name of a symbol, the whole import; else nothing."""
    of_language = F.col("language") == language
    if isinstance(rule, ImportRule):
        return F.when(of_language, _group(rule.pattern, 0))
    if rule.top_level:
        of_language &= ~F.col("text").startswith(" ") & ~F.col("text").startswith("\t")
    return F.when(of_language, _group(rule.pattern, 1))


def _symbol(found: Column, rule: SymbolRule) -> tuple[Column, Column]:
    """Whether a line has the symbol, and the symbol."""
    anchor = F.lit(rule.anchor) if rule.anchor else found
    hit = (found != "") & ~found.rlike(rule.reject) if rule.reject else found != ""
    return hit, F.struct(
        found.alias("name"),
        F.lit(rule.type).alias("type"),
        F.greatest(F.position(anchor, F.col("text")), F.lit(1)).alias("column"),
    )


def _import(found: Column, rule: ImportRule) -> tuple[Column, Column]:
    """Whether a line has the import, and the import."""
    path = _group(rule.pattern, rule.path_group)
    name = text.strip_blanks(_group(rule.pattern, rule.name_group)) if rule.name_group else F.lit("")
    if rule.last_of:
        name = F.substring_index(name, rule.last_of, -1)
    kind = F.lit(rule.type)
    if rule.bare_type:
        kind = F.when(path == "", rule.bare_type).otherwise(rule.type)
    return found != "", F.struct(
        path.alias("import_path"),
        F.nullif(name, F.lit("")).alias("import_name"),
        kind.alias("import_type"),
    )


def _select(rule_type: type, only: tuple[str, ...]) -> dict[str, list[Rule]]:
    chosen = {
        language: [r for r in rules if isinstance(r, rule_type) and (not only or r.name in only)]
        for language, rules in RULES.items()
    }
    return {language: rules for language, rules in chosen.items() if rules}


def _scan(files: DataFrame, chosen: dict[str, list[Rule]], row, rows: str, always: str, line: str = "line") -> DataFrame:
    """The rows, arrays of type ``rows``, that each line of the chosen languages gives; its number is in the column ``line``.

    Each pattern is tried once a line, in a step before what it found is read out. ``always`` is a field that no row leaves null.
    """
    kept = ["file_id", "project", "path", "language"]
    code = lines(files.filter(F.col("language").isin(*chosen)).select(*kept, "content"))
    every = [(language, rule) for language, rules in chosen.items() for rule in rules]
    tried = code.select(*kept, "line", "text", "trimmed", *[_tried(*of).alias(f"found_{at}") for at, of in enumerate(every)])
    made = [row(F.col(f"found_{at}"), rule) for at, (_, rule) in enumerate(every)]
    some = F.concat(*[F.when(hit, F.array(one)).otherwise(F.array().cast(rows)) for hit, one in made])
    found = tried.select(*kept, F.col("line").alias(line), some.alias("rows"))
    # An inner ``inline`` would have Spark make the rows twice, first to see if there are any.
    return found.select(*kept, line, F.inline_outer("rows")).filter(F.col(always).isNotNull())


def line_symbols(files: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Symbols by the registered line rules, all of them or those named in ``only``."""
    rows = "array<struct<name:string,type:string,column:int>>"
    return _scan(files, _select(SymbolRule, only), _symbol, rows, "name").select(
        "file_id",
        "project",
        "path",
        "language",
        "name",
        "type",
        "line",
        "column",
        F.lit(None).cast("string").alias("scope"),
    )


def line_imports(files: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Imports by the registered line rules, all of them or those named in ``only``."""
    rows = "array<struct<import_path:string,import_name:string,import_type:string>>"
    return _scan(files, _select(ImportRule, only), _import, rows, "import_type").select(
        "file_id", "project", "path", "language", "import_path", "import_name", "import_type"
    )


def line_rows(files: DataFrame) -> DataFrame:
    """Symbols and imports by the registered line rules in one pass over the lines, as rows of ``tagged``."""
    symbol = lambda found: F.struct(
        found["name"].alias("name"),
        found["type"].alias("type"),
        F.col("line").alias("line"),
        found["column"].alias("column"),
        F.lit(None).cast("string").alias("scope"),
    )

    def row(found: Column, rule: Rule) -> tuple[Column, Column]:
        hit, made = _symbol(found, rule) if isinstance(rule, SymbolRule) else _import(found, rule)
        return hit, tagged_symbol(symbol(made)) if isinstance(rule, SymbolRule) else tagged_import(made)

    chosen = {language: rules for language, rules in RULES.items() if rules}
    return _scan(files, chosen, row, TAGGED, "table", "at_line").drop("at_line")
