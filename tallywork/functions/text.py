"""Text primitives shared by the other column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Every character Unicode counts as white space, for trimming and as a regex class.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a" \
    "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Texts that no cast reads as a decimal number, or as any number. Asked before the cast, as a failed one costs an exception a row.
NO_DECIMAL = "[0-9][-/]|[A-DF-Za-df-z]"
NO_NUMBER = "[0-9][-/]"


def strip(value) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_col(value), F.lit(WHITE))


def squeeze(value) -> Column:
    """Trim and turn each run of white space into one blank."""
    return F.regexp_replace(strip(value), SPACE + "+", " ")


def is_blank(value) -> Column:
    value = as_col(value).cast("string")
    return value.isNull() | (strip(value) == "")


def nonblank(value) -> Column:
    """The trimmed text, or null when there is none."""
    text = strip(as_col(value).cast("string"))
    return F.when(text != "", text)


def formula_safe(value) -> Column:
    """Text a spreadsheet will not run as a formula: a leading = + - @ gets an apostrophe in front."""
    value = as_col(value)
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_safe(value) -> Column:
    """Like `formula_safe`, for a CSV log: leading white space does not hide the formula sign; null is empty text."""
    value = F.coalesce(as_col(value), F.lit(""))
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def joined_ids(ids, total, limit: int) -> Column:
    """`a; b; ... (n more)`: the first `limit` ids of a list plus how many were left out."""
    ids, total = as_col(ids), as_col(total)
    shown = F.concat_ws("; ", F.slice(ids, 1, limit))
    return F.when(
        total > limit, F.concat(shown, F.lit("; ... ("), (total - F.lit(limit)).cast("string"), F.lit(" more)"))
    ).otherwise(shown)
