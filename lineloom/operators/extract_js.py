r"""Declarations of JavaScript and TypeScript files with their scope.

The text is read as a sequence of *pieces*: stretches that end at a brace, a semicolon
or a line end. Strings, comments, templates and regex literals are masked first, keeping
every character position. A walk over the pieces of a file then gives bracket depth, the statement a piece
belongs to and the block open at each depth. Columns mask and cut the texts and read the declarations out; in between, all pieces of a
batch are looked at together: a few patterns over an Arrow column say what may begin or go on, as bits, and the walk only
keeps count of them. It takes a file's pieces as one row, where the text already is, so nothing is shuffled or sorted.

What a block does to the declarations inside it is its *tag*:

* ``F:name``   body of a function declaration: read, scope is the name
* ``X:export`` body of a default-exported function or arrow: read, scope is ``export``
* ``C:name``   body of a class: only its direct members count
* ``B``        any other block (``if``, arrow body, method, object, ...): not read

Columns are 0-based for these languages, as in the reference.

A statement that goes on in the next line before its name is known (``const`` at the end of a line, a ``require`` call
over several) is put together first: its line ends become soft ones, which no line is cut at and which
only count for places.

Known differences to a full syntax tree: files with syntax errors are still read; what follows a template inside a
template is missed; JSX text with lone brackets or braces can hide what follows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions import text
from lineloom.operators.tagged import TAGGED, rows_of, tagged_import, tagged_symbol

LANGUAGES = ("javascript", "typescript")

NAME = r"[A-Za-z_$][\w$]*"
# What a regex literal may stand after; its slash is a division after anything else.
BEFORE_REGEX = (
    r"(?:\A|[=(,:\[!&|?{;+~^%<>*-]|(?<![\w$.])(?:return|typeof|instanceof|case|in|of|new|void|delete"
    r"|await|yield|throw|do|else)(?![\w$]))"
)
# One alternative per lexical element; what is left over is taken one character at a time.
ELEMENT = (
    r"//[^\n]*"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    # Tried only where the next quote or slash is a slash.
    rf"|(?=[^/\"'`]*+/)[^/\"'`]*?{BEFORE_REGEX}\s*+/(?![*/])(?:[^/\[\n]++|\[[^\]\n]*+\])++/[a-z]*"
    r'|"[^"\n]*"'
    r"|'[^'\n]*'"
    r"|`[^`]*(?:`|\z)"
    r"|[^/\"'`]+"
    r"|[\s\S]"
)
# Structure inside strings hides behind control characters until a value is read out.
STRUCTURE = "{}()[];,"
HIDDEN = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008"

# A piece with the line ends behind it.
PIECE = r"[^{};\n]++[{};]?+\n*+|[{};]\n*+|\n++"
EXPORT = r"^\s*(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
FUNCTION = rf"{EXPORT}(?:async\s+)?function\b\s*\*?\s*({NAME})?"
CLASS = rf"{EXPORT}(?:abstract\s+)?class\b\s*((?!extends\b|implements\b){NAME})?"
VARIABLE = rf"{EXPORT}(?:const(?!\s+enum\b)|let|var)\s+"
ASSIGNED = (
    rf"^\s*({NAME})\s*=\s*(?:async\b\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]*)?=>|{NAME}\s*=>)"
)
MEMBER = (
    r"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get"
    rf"|set|accessor)\s+)*\*?\s*({NAME})\s*[?!]?\s*(?:[(<=:;}}]|$)"
)
REQUIRE = r"""=\s*require\(\s*(["'])([^"'\n]+)\1\s*\)\s*[,;]?\s*$"""
IMPORT = r"""(?m)(?:^|;)[ \t\r]*+import\b[\w$*{},\s]*?(?:\bfrom\s*)?(["'])[^"'\n]*\1"""
# A line end inside a statement that is put together: a blank for every pattern.
SOFT = "\u000b"
OPEN_WORD = r"(?<![\w$.])(?:const|let|var|function\s*\*?|class|export|default)"
OPEN_CALL = r"(?<![\w$.])require\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*\)"
# Words that cut nothing, and what is between.
OTHER = r"[^\w$]++|(?!(?=[cdeflrv])(?:const|let|var|function|class|export|default|require))[\w$]++"
# Cut words and calls, and the other words that begin where one ends, or the text.
CUT = rf"(?=[cdeflrv])(?:{OPEN_WORD}\s*\n\s*(?=[\w$*])|{OPEN_CALL})|\G(?=[\w$])(?:{OTHER}){{1,64}}+"
MAY_BE_CUT = rf"(?=[cdeflrv])(?:{OPEN_WORD}\s*\n|(?<![\w$.])require\s*\((?:\s*\n|[^()\n]*\n\s*\)))"


def masked(content: Column) -> Column:
    """Same text, same positions, without anything that only looks like code."""
    plain = F.when(F.contains(content, F.lit("\\")), F.regexp_replace(content, r"\\[^\n]", "__")).otherwise(content)
    blank = lambda part: F.regexp_replace(part, r"[^\n]", " ")
    return F.array_join(
        F.transform(
            F.regexp_extract_all(plain, F.lit(ELEMENT), F.lit(0)),
            lambda part: F.when(part.startswith("`"), blank(part))
            .when(part.startswith("'") | part.startswith('"'), F.when(F.length(part) > 1, F.translate(part, STRUCTURE, HIDDEN)).otherwise(part))
            .when(  # a comment, or code up to a regex literal and the literal
                F.contains(part, F.lit("/")) & (F.length(part) > 1),
                F.concat(F.substring_index(part, "/", 1), blank(F.substr(part, F.locate("/", part)))),
            )
            .otherwise(part),
        ),
        "",
    )


def put_together(masked: Column) -> Column:
    """Masked text in which no statement is cut before its name, or inside a ``require`` call, by a line end."""
    plain = F.when(F.contains(masked, F.lit(SOFT)), F.translate(masked, SOFT, " ")).otherwise(masked)
    # Every other part is a cut one; nothing else has soft line ends yet.
    parts = F.split(F.regexp_replace(plain, CUT, f"{SOFT}$0{SOFT}"), SOFT)
    whole = F.transform(parts, lambda part, at: F.when((at % 2 == 1) & part.rlike(r"\A[a-z]"), F.translate(part, "\n", SOFT)).otherwise(part))
    return F.when(plain.rlike(MAY_BE_CUT), F.array_join(whole, "")).otherwise(plain)


def _count(piece: Column, characters: str) -> Column:
    return F.length(piece) - F.length(F.translate(piece, characters, ""))


#: What patterns tell the walk about a piece, as bits of one number.
BITS = {
    name: 1 << at
    for at, name in enumerate("goes_on carried after_comma function class named by_default variable typed arrow exported".split())
}
# The same patterns as tests, in the words of Arrow's: blanks, the end of a word, and the end of a piece.
_S, _E, _Z = r"[\s\v]", r"(?:[^\pL\p{Nd}\p{Mn}_]|\z)", r"[\s\v]*[\x{85}\x{2028}\x{2029}]?\z"
_EXPORT = rf"^{_S}*(?:export{_S}+(?:default{_S}+)?)?(?:declare{_S}+)?"
_FUNCTION, _CLASS = rf"{_EXPORT}(?:async{_S}+)?function", rf"{_EXPORT}(?:abstract{_S}+)?class"
# Only a piece that begins like this can be the head of a function, a class, a list of variables or an export.
_HEAD = rf"^{_S}*(?:export|declare|async|function|abstract|class|const|let|var){_E}"
# A line that ends like this is carried on by the next one.
_CARRIED_ON = (
    rf"(?:[=*/%&|^?:,.~]|=>|(?:^|[^+])\+|(?:^|[^-])-|(?:^|[^\w$.])(?:extends|implements|instanceof|typeof|new|in)){_Z}"
)
_WORTH_KEEPING = (
    rf"[(){{}}\[\];=:]|^{_S}*(?:export|function|class|const|let|var|async|abstract|static){_E}|^{_S}*[A-Za-z_$][\w$]*{_Z}"
)


def _matching(pieces: pa.Array, some: np.ndarray, pattern: str) -> np.ndarray:
    """Those of the places ``some`` whose piece has the pattern."""
    return some[pc.match_substring_regex(pieces.take(pa.array(some)), pattern).to_numpy(zero_copy_only=False)]


def _flags(pieces: pa.Array) -> np.ndarray:
    """The bits of each piece; a pattern is only tried on the pieces that can match it."""
    flags = np.zeros(len(pieces), np.int32)

    def tell(name, places):
        flags[places] |= BITS[name]
        return places

    has = lambda some, pattern: _matching(pieces, some, pattern)
    but = lambda places, others: np.setdiff1d(places, others, assume_unique=True)
    opens, closes, ended = (pc.ends_with(pieces, end).to_numpy(zero_copy_only=False) for end in "{};")
    opening, others = np.flatnonzero(opens), np.flatnonzero(~(opens | closes | ended))
    tell("typed", has(opening, rf":{_S}*\{{\z"))
    tell("arrow", has(opening, rf"=>{_S}*\{{\z"))
    tell("carried", has(others, _CARRIED_ON))
    tell("after_comma", has(others, f",{_Z}"))

    told = has(np.arange(len(pieces)), rf"{_HEAD}|^{_S}*(?:extends|implements){_E}")
    heads = has(told, _HEAD)
    tell("goes_on", but(told, heads))
    functions = tell("function", has(heads, _FUNCTION + _E))
    tell("named", has(functions, rf"{_FUNCTION}(?:(?:{_S}+\*?|\*){_S}*[A-Za-z_$]|\$)"))
    classes = tell("class", has(heads, _CLASS + _E))
    named = has(classes, rf"{_CLASS}(?:{_S}+[A-Za-z_$]|\$)")
    tell("named", but(named, has(named, rf"{_CLASS}{_S}*(?:extends|implements){_E}")))
    variables = has(heads, rf"{_EXPORT}(?:const|let|var){_S}")
    tell("variable", but(variables, has(variables, rf"{_EXPORT}const{_S}+enum{_E}")))
    exported = tell("exported", has(heads, rf"^{_S}*export{_E}"))
    tell("by_default", has(exported, rf"^{_S}*export{_S}+default{_E}"))
    return flags


PLACED = dict.fromkeys("at head list block soft offset head_soft head_offset inside brackets".split(), "int") | dict.fromkeys(
    "starts comma after_block visible in_class".split(), "boolean"
)
EXPORTED, UNREAD = -1, -2


def _last(marked: np.ndarray, group: np.ndarray, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each place ``at`` the last of the ``marked`` places up to it whose ``group`` is that in ``groups``, or -1."""
    size = len(at) + 1
    keys = np.sort(group * size + marked)
    if not len(keys):
        return np.full(len(at), -1)
    found = keys[np.maximum(np.searchsorted(keys, groups * size + at, "right") - 1, 0)]
    return np.where((found // size == groups) & (found % size <= at), found % size, -1)


def _walked(pieces: pa.Array) -> pa.Array:
    """The places, as ``PLACED``, of the pieces of each file that may declare something, counted from 1 in their file.

    ``head`` is the piece that begins the statement, ``list`` the one that begins its list of declarators, and ``block``
    the head of the block around, or ``EXPORTED`` or ``UNREAD``, 0 without one. Depths keep what they saw last.
    All pieces of a batch are looked at together: counts run over each file, and what a depth saw last is looked up.
    """
    ends = pieces.offsets.to_numpy()
    low, high = ends[0], ends[-1]
    line, f = (pieces.values.field(name).to_numpy(zero_copy_only=False)[low:high] for name in ("line", "flags"))
    piece = pieces.values.field("piece")[low:high]
    at, file, first = np.arange(high - low), np.repeat(np.arange(len(pieces)), np.diff(ends)), np.repeat(ends[:-1] - low, np.diff(ends))
    count = lambda sign: pc.count_substring(piece, sign).to_numpy(zero_copy_only=False)
    bit = lambda flags, name: (flags & BITS[name]) != 0
    until = lambda steps: (sums := np.cumsum(steps, dtype=np.int64) - steps) - sums[first]
    before = lambda values, default: np.where(at == first, default, np.roll(values, 1))

    opens, closes, ended = (pc.ends_with(piece, end).to_numpy(zero_copy_only=False) for end in "{};")
    blank = pc.binary_length(pc.utf8_trim(piece, " \t\r{};")).to_numpy(zero_copy_only=False) == 0
    brackets = count("(") + count("[") - count(")") - count("]")
    inside, depth = until(brackets), until(opens.astype(np.int64) - closes)
    after_block, after_end = before(closes, False), before(opens | closes | ended, True)
    last = before(f, 0)
    # A lone opening brace after a closing one is the body after an object type.
    goes_on = blank | bit(f, "goes_on") | bit(last, "carried")
    starts = (inside == 0) & (~goes_on | (after_end & ~(blank & opens & after_block)))
    # A list of declarators goes on after a comma, also after a block.
    leads = pc.starts_with(pc.utf8_ltrim(piece, " \t\n\v\f\r"), ",").to_numpy(zero_copy_only=False)
    comma = (inside == 0) & (bit(last, "after_comma") | leads)

    # The column of a piece counts from the line's begin, or from the last soft line end in it.
    cuts, lengths = count(SOFT), pc.utf8_length(piece).to_numpy(zero_copy_only=False)
    tails = np.zeros(len(at), np.int64)
    cut = np.flatnonzero(cuts)
    tails[cut] = [len(text) - 1 - text.rindex(SOFT) for text in piece.take(pa.array(cut)).to_pylist()]
    opened = before(line, -1) != line
    counted = np.maximum.accumulate(np.where(opened | before(cuts > 0, False), at, 0))
    run = until(lengths)
    offset = np.where(opened, 0, before(tails, 0))[counted] + run - run[counted]
    soft = until(cuts)

    # What a depth of a file saw last; a block opens the depth below its brace.
    here = file * (np.ptp(depth) + 2 if len(at) else 1) + (depth - depth.min(initial=0))
    head = _last(at[starts], here[starts], at, here)
    listed = _last(at[starts & ~comma], here[starts & ~comma], at, here)
    own = np.where((head >= 0) & (inside + brackets == 0), f[head], 0)
    function, named, by_default = (bit(own, name) for name in ("function", "named", "by_default"))
    typed = function & bit(f, "typed")
    exported = ~typed & by_default & (function | bit(f, "arrow"))
    read = ~typed & ~exported & named & function
    classes = ~typed & ~exported & ~read & named & bit(own, "class") & ~by_default
    block = np.where(exported, EXPORTED, np.where(read | classes, head - first + 1, UNREAD))
    around = _last(at[opens], here[opens] + 1, at, here)
    within = around >= 0
    in_block = within & ~(exported | read)[around]
    hidden = until((opens & ~(exported | read)).astype(np.int64) - (closes & in_block))
    visible, in_class = (depth >= 0) & (hidden == 0), (depth >= 0) & (hidden == 1) & within & classes[around]

    kept = (visible | in_class) & (starts | opens | ((listed >= 0) & bit(f[listed], "variable")))
    place = lambda found: np.where(found >= 0, found - first + 1, 0)
    of_head = lambda values: np.where(head >= 0, values[head], 0)
    numbers = (at - first + 1, place(head), place(listed), np.where(within & (depth > 0), block[around], 0))
    numbers += (soft, offset, of_head(soft), of_head(offset), inside, brackets)
    made = [pa.array(column[kept].astype(np.int32)) for column in numbers]
    made += [pa.array(column[kept]) for column in (starts, comma, after_block, visible, in_class)]
    found = np.concatenate(([0], np.cumsum(kept)))[ends - low]
    return pa.ListArray.from_arrays(pa.array(found.astype(np.int32)), pa.StructArray.from_arrays(made, names=list(PLACED)))


#: A piece that may declare something: its place, its text, that of its statement's head where a block of that opens, and of the head around.
ROW = {
    **{name: kind for name, kind in PLACED.items() if name not in ("at", "head", "list", "soft", "head_soft")},
    **dict.fromkeys("row head_row flags head_flags list_flags around_flags".split(), "int"),
    **dict.fromkeys("piece head_piece around_piece statement".split(), "string"),
}
SYMBOLS = "array<struct<name:string,type:string,line:int,column:int,scope:string>>"
ROWS = f"array<struct<{','.join(f'{name}:{kind}' for name, kind in ROW.items())}>>"


def _cut_and_walked(texts: pa.Array, statements: pa.Array) -> pa.Array:
    """The pieces of each file that may declare something, as ``ROW``; a text is given as its pieces with the line ends behind them.

    Its ``statements`` are rows of their own after them.
    """
    ends = texts.offsets.to_numpy()
    cut = texts.values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    first = np.zeros(len(cut) + 1, bool)
    first[ends] = True
    piece = pc.utf8_rtrim(cut, "\n")
    lines = (pc.binary_length(cut).to_numpy() - pc.binary_length(piece).to_numpy()).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(lines)))
    line = 1 + sums[:-1] - np.repeat(sums[ends[:-1]], np.diff(ends))

    # Lines that cannot matter are left out: those of a single piece with nothing in it.
    last = (lines > 0) | first[1:]
    alone = last & np.concatenate(([True], last[:-1]))
    kept = ~alone
    kept[_matching(piece, np.flatnonzero(alone), _WORTH_KEEPING)] = True
    piece, line = piece.filter(pa.array(kept)), line[kept].astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(kept)))[ends].astype(np.int32)
    flags = _flags(piece)
    of_piece = pa.StructArray.from_arrays([pa.array(line), piece, pa.array(flags)], names=["line", "piece", "flags"])
    found = _walked(pa.ListArray.from_arrays(pa.array(ends), of_piece))

    rows = found.values
    number = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
    begin = np.repeat(ends[:-1], np.diff(found.offsets.to_numpy())) - 1
    at, head, listed, block = (begin + number(name) for name in ("at", "head", "list", "block"))
    # Only the head of a function or class that opens its block here is read again.
    opens = number("visible") & (number("inside") + number("brackets") == 0) & pc.ends_with(piece, "{").to_numpy(zero_copy_only=False)[at]
    opens &= (number("head") > 0) & ((flags[head] & BITS["named"]) != 0)
    some = lambda places, where: pa.array(flags[places], mask=~where)
    text = lambda places, where: piece.take(pa.array(np.where(where, places, 0), mask=~where))
    made = {
        "row": pa.array((line[at] + number("soft")).astype(np.int32)),
        "head_row": pa.array((line[head] + number("head_soft")).astype(np.int32)),
        "flags": pa.array(flags[at]),
        "head_flags": some(head, number("head") > 0),
        "list_flags": some(listed, number("list") > 0),
        "around_flags": some(block, number("block") > 0),
        "piece": piece.take(pa.array(at)),
        "head_piece": text(head, opens),
        "around_piece": text(block, number("block") > 0),
        "statement": pa.nulls(len(at), pa.string()),
    }
    fields = [made[name] if name in made else rows.field(name) for name in ROW]
    counts, places = np.diff(found.offsets.to_numpy()), statements.offsets.to_numpy()
    if said := places[-1] - places[0]:
        file = np.arange(len(texts))
        order = pa.array(np.argsort(np.concatenate((np.repeat(file, counts), np.repeat(file, np.diff(places)))), kind="stable"))
        more = {"statement": statements.values.slice(places[0], said)}
        fields = [pa.concat_arrays([has, more.get(name, pa.nulls(said, has.type))]).take(order) for name, has in zip(ROW, fields)]
        counts = counts + np.diff(places)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=list(ROW)))


def _placed(files: DataFrame, imports: bool = False, word: str | None = None) -> DataFrame:
    """Pieces that may declare something, with their place, the head of their statement and the blocks around.

    A file is walked where its text is, its pieces in one row, so that nothing is shuffled or sorted. With ``imports``, ``import`` statements, which often span lines, are rows
    of their own with the text in ``statement``. With a ``word``, only texts and pieces that have it give pieces.
    """
    kept = ["file_id", "project", "path", "language"]
    scripts = files.filter(F.col("language").isin(*LANGUAGES)).select(*kept, masked(F.col("content")).alias("masked"))
    statements = F.when(F.contains("masked", F.lit("import")), F.regexp_extract_all("masked", F.lit(IMPORT), F.lit(0)))
    statements = F.coalesce(statements, F.array().cast("array<string>")) if imports else F.array().cast("array<string>")
    pieces = F.regexp_extract_all(put_together(F.col("masked")), F.lit(PIECE), F.lit(0))
    pieces = pieces if word is None else F.when(F.contains("masked", F.lit(word)), pieces)
    cut = scripts.select(*kept, F.coalesce(pieces, F.array().cast("array<string>")).alias("pieces"), statements.alias("statements"))
    walk = F.arrow_udf(_cut_and_walked, ROWS)(F.col("pieces"), F.col("statements"))
    some = F.col("row").isNotNull() if word is None else F.contains("piece", F.lit(word))
    # Not ``inline``, for which Spark would ask before if there are rows, and walk twice for that.
    rows = cut.select(*kept, walk.alias("found")).select(*kept, F.inline_outer("found")).filter(some | F.col("statement").isNotNull())
    end = F.substring("piece", -1, 1)
    around = F.struct(F.col("around_piece").alias("piece"), F.col("around_flags").alias("flags"))
    around = F.when(F.col("block") == EXPORTED, "export").when(F.col("block") == UNREAD, "B").otherwise(_name(around))
    listed = F.struct(*[_has(F.col("list_flags"), bit).alias(bit) for bit in ("variable", "exported")])
    listing = F.when(F.col("visible"), _listing())
    rows = rows.withColumns({"end": F.when(end.isin("{", "}", ";"), end).otherwise(""), "around": around, "list": listed})
    return rows.withColumn("listing", listing).withColumn("parts", _declarators())


def _has(flags: Column, bit: str) -> Column:
    return flags.bitwiseAND(F.lit(BITS[bit])) != 0


def _name(head: Column) -> Column:
    """The name that the head of a function or class gives."""
    of = lambda pattern: F.regexp_extract(head["piece"], pattern, 1)
    return F.when(_has(head["flags"], "named"), F.when(_has(head["flags"], "function"), of(FUNCTION)).otherwise(of(CLASS)))


def _row_at(chars: Column) -> Column:
    """The line of a place so many characters into the piece."""
    return F.col("row") + _count(F.substring(F.col("piece"), F.lit(1), chars), SOFT)


def _column_at(chars: Column) -> Column:
    """The column of a place so many characters into the piece."""
    before = F.substring(F.col("piece"), F.lit(1), chars)
    return F.when(before.contains(SOFT), F.length(F.substring_index(before, SOFT, -1))).otherwise(F.col("offset") + chars)


def _listing() -> Column:
    """What a piece holds of a list of declarators; else null.

    What goes on with a declarator of an earlier line is none: a digit in front makes it no name.
    """
    return F.when(F.col("starts") & _has(F.col("flags"), "variable"), F.regexp_replace("piece", VARIABLE, "")).when(
        F.col("list.variable"),
        F.when(F.col("comma"), F.regexp_replace("piece", r"^\s*,", "")).when(~F.col("starts"), F.concat(F.lit("0"), "piece")),
    )


def _declarators() -> Column:
    """Parts of a list of declarators that a piece has: cut at commas outside of brackets; else null."""
    depth = F.when(F.col("starts"), 0).otherwise(F.col("inside")).cast("int")
    nothing = F.struct(depth.alias("depth"), F.array().cast("array<string>").alias("kept"))
    parts = F.split("listing", ",")
    # Without brackets no part is inside of any.
    plain = (depth == 0) & (F.col("listing") == F.translate("listing", "()[]", ""))
    return F.when(plain, parts).when(
        F.col("listing").isNotNull(),
        F.aggregate(
            parts,
            nothing,
            lambda so_far, part: F.struct(
                (so_far["depth"] + _count(part, "([") - _count(part, ")]")).alias("depth"),
                F.when(so_far["depth"] == 0, F.concat(so_far["kept"], F.array(part))).otherwise(so_far["kept"]).alias("kept"),
            ),
            lambda so_far: so_far["kept"],
        ),
    )


def _with_declarations(placed: DataFrame, kind: str = SYMBOLS, shaped=lambda row: row) -> DataFrame:
    """Placed pieces with ``declared``: the symbol rows of each, mostly none, as ``shaped`` gives them, in an array of type ``kind``.

    What patterns find is a column of its own before it is used, so that each is tried once and only where it can match.
    """
    piece, visible, starts, scope = F.col("piece"), F.col("visible"), F.col("starts"), F.col("around")
    head, opens = F.struct(F.col("head_piece").alias("piece"), F.col("head_flags").alias("flags")), F.col("head_piece").isNotNull()
    typed = _has(F.col("head_flags"), "function") & _has(F.col("flags"), "typed")
    found = F.filter(
        F.transform("parts", lambda part: F.regexp_extract(part, rf"^\s*({NAME})\s*(?:[?!]?:|=(?!>)|[;{{}}]|$)", 1)),
        lambda name: name != "",
    )
    at = lambda name: F.regexp_instr(piece, F.concat(F.lit(r"(?<![\w$.])\Q"), name, F.lit(r"\E(?![\w$])"))) - 1
    tried = placed.withColumns(
        {
            "head_name": F.when(opens & ~typed, _name(head)),
            "before_head": F.when(opens, F.regexp_extract("head_piece", r"^\s*(?:export\s+(?:default\s+)?)?", 0)),
            "assigned": F.when(starts & visible & F.contains(piece, F.lit("=")), F.regexp_extract("piece", ASSIGNED, 1)),
            "member": F.when(starts & F.col("in_class"), F.regexp_extract("piece", MEMBER, 1)),
            "names": F.when(F.col("parts").isNotNull(), found),
            "indent": F.when(starts, F.length(F.regexp_extract("piece", r"^\s*", 0))),
        }
    )
    # The place of a name is looked for once.
    names = F.transform("names", lambda name: F.struct(name.alias("name"), at(name).alias("at")))
    tried = tried.withColumn("names", F.when(F.size("names") > 0, names))

    def row(name, kind, line, column, within):
        made = F.struct(
            name.alias("name"),
            kind.alias("type"),
            line.cast("int").alias("line"),
            column.cast("int").alias("column"),
            within.alias("scope"),
        )
        return shaped(made)

    nothing = F.array().cast(kind)
    one = lambda test, made: F.when(test, F.array(made)).otherwise(nothing)
    export_scope = lambda flag: F.when(flag, F.lit("export")).otherwise(scope)
    before, indent = F.col("before_head"), F.col("indent")
    block = row(
        F.col("head_name"),
        F.when(_has(F.col("head_flags"), "function"), "function").otherwise("class"),
        F.col("head_row") + _count(before, SOFT),
        F.when(before.contains(SOFT), F.length(F.substring_index(before, SOFT, -1))).otherwise(F.col("head_offset") + F.length(before)),
        export_scope(_has(F.col("head_flags"), "exported")),
    )
    function = row(F.col("assigned"), F.lit("function"), _row_at(indent), _column_at(indent), scope)
    method = F.when(F.col("member") == "constructor", "constructor").otherwise("method")
    member = row(F.col("member"), method, _row_at(indent), _column_at(indent), scope)
    exported = F.coalesce(F.when(~starts | F.col("comma"), F.col("list.exported")), _has(F.col("flags"), "exported"))
    variables = F.transform(
        "names", lambda found: row(found["name"], F.lit("variable"), _row_at(found["at"]), _column_at(found["at"]), export_scope(exported))
    )
    made = F.concat(
        one(F.col("head_name").isNotNull(), block),
        one(F.col("assigned") != "", function),
        one(F.col("member") != "", member),
        F.when(F.col("names").isNotNull(), variables).otherwise(nothing),
    )
    return tried.withColumn("declared", made)


def script_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes, members and variables of script files, with scope."""
    rows = _with_declarations(_placed(files).filter(_may_declare()))
    return rows_of(rows, "declared", "name")


def _may_declare() -> Column:
    return (F.col("visible") | F.col("in_class")) & (F.col("starts") | F.col("list.variable") | (F.col("end") == "{"))


def shown(value: Column) -> Column:
    """A string value with its hidden structure back in place."""
    return F.translate(value, HIDDEN, STRUCTURE)


def _import(path: Column, name: Column, kind: str) -> Column:
    return F.struct(path.alias("import_path"), name.alias("import_name"), F.lit(kind).alias("import_type"))


def _required() -> Column:
    """Import rows of the ``require`` calls that a piece has."""
    piece = F.col("piece")
    plain = F.filter(
        F.transform(
            "parts",
            lambda part: _import(
                shown(F.regexp_extract(part, REQUIRE, 2)), F.nullif(F.regexp_extract(part, rf"^\s*({NAME})\s*[:=]", 1), F.lit("")), "require"
            ),
        ),
        lambda found: found["import_path"] != "",
    )
    taken_apart = F.when(
        piece.rlike(r"^\s*" + REQUIRE) & F.col("after_block"),
        F.array(_import(shown(F.regexp_extract("piece", REQUIRE, 2)), F.lit(None).cast("string"), "require")),
    )
    may = (F.col("starts") | F.col("list.variable")) & F.col("visible") & F.contains(piece, F.lit("require"))
    calls = may & piece.rlike(r"=\s*require\(")
    return F.when(calls, F.when(F.size(plain) > 0, plain).otherwise(taken_apart))


def _imported(statement: Column) -> Column:
    """Import row of an ``import`` statement."""
    clause = F.regexp_extract(statement, r"(?s)\bimport\b(.*?)(?:\bfrom\s*)?[\"']", 1)
    names = F.filter(
        F.transform(
            F.split(F.translate(clause, "{}", ",,"), ","),
            lambda n: F.regexp_replace(text.strip_blanks(n), r"(?s)^.*\bas\s+|^type\s+(?=[\w$*])", ""),
        ),
        lambda n: ~n.isin("", "type"),
    )
    path = shown(F.regexp_extract(statement, r"""(["'])([^"'\n]*)\1$""", 2))
    return _import(path, F.nullif(F.array_join(names, ", "), F.lit("")), "import")


def script_imports(files: DataFrame) -> DataFrame:
    """``import`` statements and ``require`` calls of script files; each text is masked once."""
    content = F.col("content")
    some = files.filter(F.contains(content, F.lit("import")) | F.contains(content, F.lit("require")))
    rows = F.coalesce(_statement(), _required())
    return rows_of(_placed(some, imports=True, word="require").withColumn("made", rows), "made", "import_type")


def _statement() -> Column:
    """Import row of a row that is an ``import`` statement; else null."""
    return F.when(F.col("statement").isNotNull(), F.array(_imported(F.col("statement"))))


def script_rows(files: DataFrame) -> DataFrame:
    """Symbols and imports of script files in one pass, as rows of ``tagged``: each text is masked once."""
    placed = _with_declarations(_placed(files, imports=True), TAGGED, tagged_symbol)
    rows = placed.withColumn("imported", F.coalesce(_statement(), _required()))
    some = lambda test, made: F.when(test, made).otherwise(F.array().cast(TAGGED))
    imports = some(F.size("imported") > 0, F.transform("imported", tagged_import))
    return rows_of(rows.withColumn("made", F.concat(some(_may_declare(), F.col("declared")), imports)), "made", "table")
