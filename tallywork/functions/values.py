"""Comparable forms of cells: alignment modes and fingerprint values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import flexible_date, typed_date
from .money import cents
from .text import NO_DECIMAL, as_col, squeeze, strip

# How two columns may be compared.
ALIGN_MODES = ("text", "alnum", "digits", "number", "date")


def aligned(value, mode: str) -> Column:
    """The comparable form of a cell under one alignment mode; null when blank or unreadable."""
    text = strip(as_col(value).cast("string"))
    if mode == "number":
        return cents(value).cast("string")
    if mode == "date":
        return typed_date(value).cast("string")
    if mode == "alnum":
        out = F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    elif mode == "digits":
        out = F.regexp_replace(text, r"\D", "")
    elif mode == "text":
        out = F.lower(squeeze(text))
    else:
        raise ValueError(f"unknown alignment mode {mode!r}; use one of {ALIGN_MODES}")
    return F.when(out != "", out)


def fingerprint_value(value) -> Column:
    """A tagged form that ignores formatting: `1` = `1.0`, `1/5/2026` = `2026-01-05`, case and spacing."""
    text = squeeze(as_col(value).cast("string"))
    bare = F.regexp_replace(text, ",", "")
    number = F.when(~bare.rlike(NO_DECIMAL), bare.try_cast("decimal(38,10)"))
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(
        F.concat(F.lit("date:"), typed_date(text).cast("string")),
        F.concat(F.lit("num:"), plain),
        F.concat(F.lit("text:"), F.upper(F.nullif(text, F.lit("")))),
        F.lit("<NULL>"),
    )


__all__ = ["ALIGN_MODES", "aligned", "fingerprint_value", "flexible_date"]
