"""Text cleaning as column expressions; only NFC leaves the JVM."""

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters removed as zero-width.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"

# A byline starts with one of these letters (any case) and may end with one of
# these source words in brackets.
BYLINE_LETTERS = (
    "A-Z"
    "ÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ"
)
BYLINE_SOURCES = "theo|tổng hợp|ghi|báo"

# What counts as white space: everything Python's str.strip removes.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def letter_class(letters: str) -> str:
    """A regular-expression class of these letters in both cases, as code point ranges. Case is
    written out because Java's case-insensitive classes are slow on long texts."""
    cases = {x for c in letters for x in (c, c.lower(), c.upper())}
    points = sorted(ord(x) for x in cases if len(x) == 1)
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def remove(c: Column, characters: str) -> Column:
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def is_blank(c: Column) -> Column:
    """True for NULL, empty or white-space-only text."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1C-\x1F]")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC. Text whose characters all lie below U+0300 is in NFC already, so such rows
    go to Python as NULL and keep their value."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x{0}-\x{2FF}]"), c)), c)


def drop_zero_width(c: Column) -> Column:
    return remove(c, ZERO_WIDTH)


def flatten_tables(c: Column) -> Column:
    """Lines of the form ``|...|`` become their non-empty cells joined by `` | ``."""

    def flat(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, r"\|", -1), strip), lambda x: x != "")
        is_row = line.startswith("|") & line.endswith("|") & (F.length(line) >= 3)
        return F.when(is_row, F.array_join(cells, " | ")).otherwise(line)

    def flat_lines(c: Column) -> Column:
        lines = F.transform(F.split(c, "\n", -1), flat)
        return F.when(c.contains("|"), F.array_join(lines, "\n")).otherwise(c)

    return once(c, flat_lines)


def normalize_spaces(c: Column) -> Column:
    """Three or more newlines become two, then tab and CR become a space, then strip."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    for x in "\t\r":
        c = F.replace(c, F.lit(x), F.lit(" "))
    return strip(c)


def strip_byline(c: Column) -> Column:
    """Drop a short last line that looks like an author's name."""
    pattern = (
        rf"(?iuUd)\n[{BYLINE_LETTERS}][^\n]{{0,80}}"
        rf"(?:\s*\((?:{BYLINE_SOURCES})[^\)]{{0,60}}\))?\.?\s*$"
    )
    return F.regexp_replace(c, pattern, "")


def clean(c: Column, *, unicode_nfc: bool = True, byline: bool = True) -> Column:
    """The whole cleaning chain, in the order that defines its result."""
    if unicode_nfc:
        c = nfc(c)
    c = normalize_spaces(flatten_tables(drop_zero_width(c)))
    return strip_byline(c) if byline else c
