"""Identifiers: text as written, comparison keys, how strong a reference is, words of a reference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SPACE, as_col, strip

# Words people type where a reference belongs. Sharing one proves nothing.
PLACEHOLDER_WORDS = (
    "NA", "NONE", "NIL", "NULL", "TBD", "TBA", "TEST", "CASH", "STOCK", "SAME", "VARIOUS", "UNKNOWN", "NOPO", "MISC",
    "VERBAL", "PHONE", "EMAIL", "PICKUP", "WALKIN", "DEFAULT", "PENDING", "SEEPO", "SEENOTES", "SEEATTACHED",
    "ATTACHED", "NOPONUMBER", "NOREFERENCE",
)
# Words a text reference may carry without naming anyone.
STOP_WORDS = (
    "INC", "LLC", "LTD", "THE", "AND", "CORP", "COMPANY", "CO", "MISC", "VOID", "NONE", "TBD", "NULL", "N/A",
)
# Patterns of the identifier rules.
INVISIBLE = "[​‌‍⁠﻿]"
CLEAN = r"\A(?![='])[!-~](?:[ -~]*[!-~])?\z"  # printable ASCII, no blank at the ends, no wrapper: as written already
PO_PREFIX = r"^P\.?\s*O\.?(?:\s*[#:\-]\s*|\s+|(?=\d))"
TRAILING_ZEROS = r"^([0-9]+)\.0+$"
SCIENTIFIC = r"^[+-]?\d(?:\.\d+)?E[+-]?\d+$"

MIN_WORD = 3


def identifier_text(value) -> Column:
    """The identifier as written: invisible characters, `="…"` wrappers and a text apostrophe removed.

    Leading zeros and punctuation stay. The input must be text; numeric columns go through `number_identifier`.
    """
    raw = F.coalesce(as_col(value).cast("string"), F.lit(""))
    text = strip(F.regexp_replace(raw, INVISIBLE, ""))
    unwrapped = F.regexp_replace(text, r'^="\s*(.*?)\s*"$', "$1")
    return F.when(raw.rlike(CLEAN), raw).otherwise(F.regexp_replace(unwrapped, r"^'(?=\S)", ""))


def number_identifier(value) -> Column:
    """A numeric identifier column as plain digits, without float notation."""
    exact = as_col(value).try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(""))


def identifier_flags(value) -> Column:
    raw, text = F.coalesce(as_col(value), F.lit("")), identifier_text(value)
    upper = F.upper(text)
    return F.array_compact(
        F.array(
            F.when(upper.rlike(SCIENTIFIC), F.lit("EXCEL_SCIENTIFIC_NOTATION")),
            F.when((text != raw) & (text != ""), F.lit("SOURCE_TEXT_ADJUSTED")),
            F.when(F.regexp_replace(upper, " ", "").rlike("[^A-Z0-9]"), F.lit("PUNCTUATION_IGNORED")),
        )
    )


def fold(value) -> Column:
    """Case and white space folded, punctuation kept."""
    return F.regexp_replace(F.upper(identifier_text(value)), SPACE + "+", "")


def alnum_key(value) -> Column:
    """Normalized key: upper case letters and digits, a trailing `.0` dropped."""
    upper = F.regexp_replace(F.upper(identifier_text(value)), TRAILING_ZEROS, "$1")
    return F.regexp_replace(upper, "[^A-Z0-9]", "")


def po_key(value) -> Column:
    """Like `alnum_key`, with a leading `PO` / `P.O. #` marker removed."""
    upper = F.regexp_replace(F.upper(identifier_text(value)), TRAILING_ZEROS, "$1")
    return F.regexp_replace(F.regexp_replace(upper, PO_PREFIX, ""), "[^A-Z0-9]", "")


def folded_source(value, is_po: bool) -> Column:
    """Source text with only the documented equivalences applied; punctuation stays for comparison."""
    text = F.regexp_replace(F.upper(strip(value)), TRAILING_ZEROS, "$1")
    if is_po:
        text = F.regexp_replace(text, PO_PREFIX, "")
    return F.regexp_replace(text, SPACE + "+", "")


def reference_strength(key) -> Column:
    """SPECIFIC, WEAK or NONE for a normalized reference."""
    key = as_col(key)
    weak = key.isin(*PLACEHOLDER_WORDS) | key.rlike("^0+$") | key.rlike(r"^(.)\1{3,}$")
    return F.when(key == "", "NONE").when(weak, "WEAK").otherwise("SPECIFIC")


def specific_key(key) -> Column:
    """The normalized value where it is specific evidence, else ''."""
    return F.when(reference_strength(key) == "SPECIFIC", as_col(key)).otherwise(F.lit(""))


def reference_from_text(value, is_po: bool) -> Column:
    """(value, how): the one token of a free-text cell that looks like an identifier, else ('', why not)."""
    raw = identifier_text(value)
    single = po_key(value) if is_po else alnum_key(value)

    def looks_right(token: Column) -> Column:
        return (F.length(token) >= 4) & token.rlike("[0-9]")

    tokens = F.array_distinct(
        F.filter(F.transform(F.split(raw, SPACE + "+"), lambda x: alnum_key(x)), looks_right)
    )
    has_space = raw.rlike(SPACE)
    found = (
        F.when(~has_space & looks_right(single), single)
        .when(has_space & (F.size(tokens) == 1), F.try_element_at(tokens, F.lit(1)))
        .otherwise(F.lit(""))
    )
    how = (
        F.when(found == "", F.when(has_space & (F.size(tokens) > 1), "ambiguous").otherwise(""))
        .when(has_space, "description")
        .otherwise("column")
    )
    return F.struct(found.alias("value"), how.alias("how"))


def reference_words(value) -> Column:
    """Sorted distinct words of a reference: letters split from digits, numbers, stop words and short words dropped."""
    words = F.regexp_extract_all(F.upper(F.coalesce(as_col(value), F.lit(""))), F.lit(f"([A-Z]{{{MIN_WORD},}})"), 1)
    return F.sort_array(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))))


def name_words(value) -> Column:
    """Upper-case words of at least three letters in a name."""
    return F.array_distinct(F.regexp_extract_all(F.upper(as_col(value)), F.lit("([A-Z]{3,})"), 1))


def vendor_key(value) -> Column:
    """A vendor or account id: every blank and surrounding quote removed, `.0` dropped, upper case."""
    text = F.regexp_replace(strip(F.coalesce(as_col(value).cast("string"), F.lit(""))), "[  ]", "")
    text = F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", "")
    return F.upper(F.regexp_replace(text, r"^(\d+)\.0+$", "$1"))


def name_key(value) -> Column:
    """A vendor name: ends trimmed, inner white space collapsed (never removed), upper case."""
    text = strip(F.coalesce(as_col(value).cast("string"), F.lit("")))
    return F.upper(F.regexp_replace(text, SPACE + "+", " "))


def padded_segment(value, width: int, side: str = "right") -> Column:
    """A whole number padded with zeros to `width`; null when blank, not whole, or too long."""
    number = strip(as_col(value).cast("string")).try_cast("decimal(38,6)").cast("string")
    whole = F.regexp_extract(number, r"^(\d+)\.0+$", 1)
    fits = (whole != "") & (F.length(whole) <= width)
    return F.when(fits, F.rpad(whole, width, "0") if side == "right" else F.lpad(whole, width, "0"))


def gl_account(cost_centre, account, side: str = "right") -> Column:
    """`001-CCCCC-AAAAAA-000`, or null when either segment is invalid."""
    return F.concat(
        F.lit("001-"), padded_segment(cost_centre, 5, side), F.lit("-"), padded_segment(account, 6, side), F.lit("-000")
    )
