"""Column functions that clean sheet cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark a cell as unusable.
PLACEHOLDERS = ("-", "NA", "N/A")
ERROR_TEXTS = ("#ref!", "#n/a", "#value!", "#name?", "#null!", "#div/0!")
BLANK_AT_QUERY = ("", "-", "n/a")

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def column_index(label: str | int) -> int:
    """1-based position of a sheet column given as letters ("B") or as a number."""
    if isinstance(label, bool) or not isinstance(label, (str, int)):
        raise ValueError(f"not a sheet column: {label!r}")
    if isinstance(label, int):
        if label < 1:
            raise ValueError(f"sheet columns count from 1, got {label}")
        return label
    if not (label.isascii() and label.isalpha()):
        raise ValueError(f"not a sheet column: {label!r}")
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(label.upper())))


def column_index_of(label: Column) -> Column:
    """`column_index` over a column of labels; NULL for anything but letters."""
    digits = F.split(F.upper(label), "")
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(label.rlike("^[A-Za-z]+$"), value)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends (F.trim alone drops blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalise_cell(cell: Column) -> Column:
    return F.coalesce(strip(cell), F.lit(""))


def cell_at(cells: Column, index: int) -> Column:
    return F.get(cells, F.lit(index - 1))


def is_blank(text: Column) -> Column:
    return text == ""


def is_placeholder(text: Column) -> Column:
    return text.isin(*PLACEHOLDERS)


def has_error_text(text: Column) -> Column:
    found = F.lit(False)
    for error in ERROR_TEXTS:
        found = found | F.lower(text).contains(error)
    return text.contains("#") & found  # few texts go on to the other tests


def is_valid_expression(text: Column) -> Column:
    """The second, query-time check: stricter on `n/a`, which ingest lets through in lower case."""
    return ~F.lower(strip(text)).isin(*BLANK_AT_QUERY) & ~has_error_text(text)


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?s)(?<=.)\.[^.]*$", "")
