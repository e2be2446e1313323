"""Amounts: text to exact signed cents, and accounting numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col, strip

# An amount with exactly two places.
TWO_PLACES = r"\A-?[0-9]{1,15}\.[0-9]{2}\z"


def _plain_number(value) -> Column:
    signed = F.regexp_replace(strip(as_col(value).cast("string")), r"^\((.*)\)$", "-$1")
    return F.regexp_replace(signed, "[$, ]", "")


def cents(value) -> Column:
    """Exact signed cents, half up; null when the text is not a number. `(12.00)` is negative."""
    plain = _plain_number(value)
    rounded = (F.round(plain.try_cast("decimal(38,18)"), 2) * 100).try_cast("bigint")
    # Two places need no rounding: the digits are the cents.
    return F.when(plain.rlike(TWO_PLACES), F.translate(plain, ".", "").cast("bigint")).otherwise(rounded)


def dollars_to_cents(value) -> Column:
    """Whole cents of a numeric dollar column."""
    return F.round(as_col(value) * 100).cast("bigint")


def accounting_number(value) -> Column:
    """A finite number from accounting text, or null."""
    number = _plain_number(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
