"""Dates as people type them, fiscal periods, and layer labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import NO_NUMBER, as_col, strip

# Patterns for period labels.
FISCAL_PERIOD = r"^(?:PD|P|PERIOD)?\s*(\d{1,2})(?:\.0+)?(?:\s*[-/]\s*(\d{4}|\d{2}))?$"
PERIOD_WORD = r"\bP(?:ERIOD)?\.?\s*D?\.?\s*0?(1[0-3]|[1-9])\b"
PERIOD_PD = r"\bPD\s*0?(1[0-3]|[1-9])\b"
PERIOD_BARE = r"\b(1[0-3]|[1-9])\b"
LAYER_PERIOD = r"(?i)^\s*(P\.?D?\.?\s*0?\d{1,2}(?:[-.]\d{2,4})?)\s*:?"
DATE_TOKEN = r"(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{1,2}-\d{1,2})"
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
EXCEL_DAY_ZERO = "1899-12-30"
# Month names.
MONTHS = (
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def typed_date(value) -> Column:
    """`2026-01-05`, `1/5/2026` or `1/5/26` (month first), with or without a time; null otherwise."""
    given = text = strip(as_col(value).cast("string"))
    for pattern, iso in (
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\s.*)?$", "$3-$1-$2"),
        (r"^(\d{1,2})/(\d{1,2})/(\d{2})(?:\s.*)?$", "20$3-$1-$2"),
    ):
        text = F.regexp_replace(text, pattern, iso)
    read = F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T].*)?$", 1)
    return F.when(given.rlike(ISO_DATE), given).otherwise(read).try_cast("date")


def _day(year: Column, month: Column, day: Column) -> Column:
    year = F.when(F.length(year) <= 2, F.lpad(year, 2, "0").try_cast("int") + 2000).otherwise(year.try_cast("int"))
    dash = F.lit("-")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), dash, month.cast("string"), dash, day.cast("string")).try_cast("date")


def date_tokens(value) -> Column:
    """The numbers and words of a date text in capitals, without a time, a weekday or the endings of counted days; null where
    anything but spaces and `, . / - '` stands between them. To be kept as a column and read by `read_date`."""
    text = F.upper(strip(as_col(value).cast("string")))
    text = F.regexp_replace(text, r"(?:T|\s+)\d{1,2}:\d{2}.*$", "")
    text = F.regexp_replace(text, r"^(?:MON|TUE|TUES|WED|THU|THUR|THURS|FRI|SAT|SUN)(?:DAY|NESDAY|SDAY|RSDAY|URDAY)?\b[\s,.]*", "")
    text = F.regexp_replace(text, r"(\d)(?:ST|ND|RD|TH)\b", "$1")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    clean = text.rlike(r"^(?:[A-Z]+|\d+)(?:[\s,./'-]*(?:[A-Z]+|\d+))*[\s.,]*$")
    return F.when(clean, F.regexp_extract_all(text, F.lit(r"([A-Z]+|\d+)"), 1))


def read_date(tokens) -> Column:
    """(day, other, reading) from `date_tokens`; all null when unreadable.

    A month is a name, in full or cut to three letters and more. A year is the number of four digits, else the last one
    (20nn). Of two other numbers the one above twelve is the day. Where both may be the month, `day` is the month-first
    reading and `other` the day-first one, so that a caller can tell a reading from a guess.
    """
    t = as_col(tokens)
    three = F.size(t) == 3
    first, second, third = (F.try_element_at(t, F.lit(k)) for k in (1, 2, 3))
    words = F.filter(t, lambda x: x.rlike("^[A-Z]"))
    word, names = F.try_element_at(words, F.lit(1)), F.array(*map(F.lit, MONTHS))
    # The place of the first month that starts with the word.
    named = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda k: F.element_at(names, k).startswith(F.regexp_replace(word, "^SEPT$", "SEP")))
    month = F.when(F.length(word) >= 3, F.try_element_at(named, F.lit(1)))
    numbers = F.filter(t, lambda x: x.rlike("^[0-9]"))
    one, two = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    leads = F.length(one) == 4
    by_name = F.when(leads, _day(one, month, two)).otherwise(_day(two, month, one))
    is_named, plain = three & (F.size(words) == 1) & (F.size(numbers) == 2), three & (F.size(words) == 0)
    iso = _day(first, second, third)
    short = (F.length(first) <= 2) & (F.length(second) <= 2) & F.length(third).isin(2, 4)
    month_first, day_first = _day(third, first, second), _day(third, second, first)
    open_order = short & month_first.isNotNull() & day_first.isNotNull() & (month_first != day_first)
    day = F.when(is_named, by_name).when(plain & (F.length(first) == 4), iso).when(plain & short, F.coalesce(month_first, day_first))
    reading = (
        F.when(is_named, "month name").when(F.length(first) == 4, "year first").when(open_order, "either order")
        .when(month_first.isNotNull(), "month first").otherwise("day first")
    )
    return F.struct(day.alias("day"), F.when(plain & open_order, day_first).alias("other"), F.when(day.isNotNull(), reading).alias("reading"))


def flexible_date(value) -> Column:
    """`typed_date`, spreadsheet day numbers from 20000 to 80000, and every other text that `read_date` reads."""
    text = strip(as_col(value).cast("string"))
    serial = F.when(~text.rlike(NO_NUMBER), text.try_cast("double"))
    return F.when(
        serial.between(20000, 80000), F.date_add(F.lit(EXCEL_DAY_ZERO).cast("date"), F.floor(serial).cast("int"))
    ).otherwise(F.coalesce(typed_date(text), read_date(date_tokens(text)).getField("day")))


def period_parts(value) -> Column:
    """`period<US>year` of a readable period text: one regular expression, to be kept as a column and read twice."""
    return F.regexp_replace(F.upper(strip(as_col(value).cast("string"))), FISCAL_PERIOD, "$1\x1f$2")


def read_period(parts, default_year: int) -> Column:
    """(period 1-13, year) from `period_parts`; both null when unreadable."""
    parts = as_col(parts)
    period = F.substring_index(parts, "\x1f", 1).try_cast("int")
    tail = F.substring_index(parts, "\x1f", -1)
    year = (
        F.when(tail == "", F.lit(default_year))
        .when(F.length(tail) == 2, tail.try_cast("int") + 2000)
        .otherwise(tail.try_cast("int"))
    )
    good = parts.contains("\x1f") & period.between(1, 13) & year.between(1900, 2199)
    return F.struct(F.when(good, period).alias("period"), F.when(good, year).alias("year"))


def fiscal_period(value, default_year: int) -> Column:
    """(period 1-13, year) from `P03-2026`, `PD 3`, `3/26`; both null when unreadable."""
    return read_period(period_parts(value), default_year)


def period_label(parsed) -> Column:
    parsed = as_col(parsed)
    return F.when(
        parsed.getField("period").isNotNull(),
        F.concat(
            F.lit("P"), F.lpad(parsed.getField("period").cast("string"), 2, "0"), F.lit("-"), parsed.getField("year").cast("string")
        ),
    ).otherwise("Unspecified")


def fiscal_label(value, default_year: int) -> Column:
    return period_label(fiscal_period(value, default_year))


def period_number(value) -> Column:
    """The first period number named in a text, or null."""
    text = F.upper(strip(as_col(value).cast("string")))
    found = [F.nullif(_part(text, p, 1), F.lit("")) for p in (PERIOD_WORD, PERIOD_PD, PERIOD_BARE)]
    return F.coalesce(*found).try_cast("int")


def label_year(value) -> Column:
    """The fiscal year a heading names: the last `20nn`, else the last `/nn` of an `FYE` heading."""
    text = as_col(value)
    four = F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), 1)
    two = F.regexp_extract_all(text, F.lit(r"/(\d{2})(?!\d)"), 1)
    return F.when(F.size(four) > 0, F.try_element_at(four, F.lit(-1)).cast("int")).when(
        (F.size(two) > 0) & F.upper(text).contains("FYE"), F.try_element_at(two, F.lit(-1)).cast("int") + 2000
    )


def layer_date(value) -> Column:
    """The date of a layer label: the whole text when it is a date, else the first date in it."""
    return F.coalesce(typed_date(value), typed_date(_part(as_col(value), DATE_TOKEN, 1)))


def layer_label(value) -> Column:
    """(source period, start, end) of a layer label such as `PD11-26: 07/03/26-07/30/26`."""
    text = strip(as_col(value).cast("string"))
    prefix = _part(text, LAYER_PERIOD, 1)
    rest = F.regexp_replace(text, LAYER_PERIOD, "")
    in_rest = F.regexp_extract_all(rest, F.lit(DATE_TOKEN), 1)
    tokens = F.when(F.size(in_rest) > 0, in_rest).otherwise(F.regexp_extract_all(text, F.lit(DATE_TOKEN), 1))
    start = typed_date(F.try_element_at(tokens, F.lit(1)))
    end = F.when(F.size(tokens) > 1, typed_date(F.try_element_at(tokens, F.lit(2)))).otherwise(start)
    year = _part(text, r"\b((?:19|20)\d{2})\b", 1)
    period = (
        F.when(prefix != "", F.regexp_replace(F.upper(prefix), " ", ""))
        .when(start.isNotNull(), "")
        .when(year != "", year)
        .when(F.lower(text).rlike("legacy|carryover|unknown"), "Legacy")
        .otherwise("")
    )
    return F.struct(period.alias("source_period"), start.alias("start"), end.alias("end"))
