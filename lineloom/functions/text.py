"""Text expressions. Everything here is a Catalyst column expression, no UDFs."""

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks of the reference's script language (space, controls, no-break
# spaces, line separators, byte order mark), as the inside of a character class.
BLANKS = "\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK_CHARACTERS = regex.sub(
    "(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), BLANKS
)
# Letters, digits and private-use characters make up a search token.
WORD_CHARACTER = r"[\p{L}\p{N}\p{Co}]"
WORD = WORD_CHARACTER + "+"

MARKS = "[\u0300-\u036f]"


def _accent_table() -> tuple[str, str]:
    """Latin letters with an accent and their base letter, from Unicode decomposition."""
    plain = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accent_table()


def normalized(text: Column, fold_accents: bool = True) -> Column:
    """Case-folded text, by default without accents."""
    text = F.lower(text)
    if fold_accents:
        text = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), MARKS, "")
    return text


def tokens(text: Column, fold_accents: bool = True) -> Column:
    """Search tokens in order of appearance."""
    return F.regexp_extract_all(normalized(text, fold_accents), F.lit(WORD), F.lit(0))


def phrase_terms(text: str, fold_accents: bool = True) -> list[str]:
    """Search tokens of a short query string, in order, cut like the corpus."""
    text = text.lower()
    if fold_accents:
        text = regex.sub(MARKS, "", text.translate(str.maketrans(ACCENTED, PLAIN)))
    return regex.findall(WORD, text)


def query_terms(text: str, fold_accents: bool = True) -> list[str]:
    """Distinct search tokens of a short query string."""
    return list(dict.fromkeys(phrase_terms(text, fold_accents)))


def strip_blanks(text: Column) -> Column:
    """Trim every Unicode blank; Spark's own default only trims the space."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def file_lines(content: Column) -> Column:
    """Lines of a file; only the newline separates, trailing empty lines count."""
    return F.split(content, "\n", -1)


def clip(text: Column, chars: int) -> Column:
    """First ``chars`` characters, with an ellipsis when something was cut off."""
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def snippet(content: Column, line: Column | int, context: int = 2) -> Column:
    """The lines around a 1-based ``line``, ``context`` before and one more after it."""
    line = F.lit(line) if isinstance(line, int) else line
    rows = file_lines(content)
    start = F.greatest(F.lit(0), line - context - 1)
    end = F.least(F.size(rows), line + context + 1)
    return F.array_join(
        F.slice(rows, start + 1, F.greatest(end - start, F.lit(0))), "\n"
    )


def snippet_head(content: Column, lines: int = 5, chars: int = 500) -> Column:
    """Head of a file: the first ``lines`` lines, clipped to ``chars`` characters."""
    return clip(F.substring_index(content, "\n", lines), chars)


def line_column(content: Column, position: Column | int) -> Column:
    """``struct(line, column)``, both 1-based, of a 0-based character offset."""
    position = F.lit(position) if isinstance(position, int) else position
    before = F.substring(content, F.lit(1), position)
    return F.struct(
        F.size(file_lines(before)).alias("line"),
        (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"),
    )


def name_contains(text: Column, needle: str | Column, wildcards: bool = False) -> Column:
    """Case-insensitive substring test; ``wildcards`` lets ``%`` and ``_`` match freely."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    if wildcards:
        # A character that no name has as the escape, so that a backslash stands for itself.
        pattern = F.concat(F.lit("%"), F.lower(needle), F.lit("%"))
        return F.like(F.lower(text), pattern, F.lit("\u0000"))
    return F.contains(F.lower(text), F.lower(needle))


def name_starts_with(text: Column, needle: str | Column) -> Column:
    """Case-insensitive prefix test."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.startswith(F.lower(text), F.lower(needle))
