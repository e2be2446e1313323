"""Delimited reports as text, cleaned of what a report adds: blank rows, time stamps, repeated headers, subtotals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import is_blank, strip
from ..runtime import last_known

# Fixed value: a report's own time stamp, alone in a row.
REPORT_STAMP = (
    r"(?i)^(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY)\s*,\s*"
    r"(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\s+"
    r"\d{1,2}\s*,\s*\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?\s+(?:AM|PM)\s+(?:GMT|UTC)(?:[+-]\d{2}:?\d{2})?$"
)


def read_text_table(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A delimited file without a header, every cell text (`c1` …). Identifiers never pass through a number."""
    schema = StructType([StructField(f"c{n}", StringType()) for n in range(1, columns + 1)])
    return spark.read.option("header", False).option("multiLine", False).schema(schema).csv(path)


def classify_rows(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Adds `row_class`: blank, stamp, header or data. `headers` maps the text columns to their header texts."""
    cells = F.array(*[strip(F.coalesce(c, F.lit(""))) for c in headers])
    filled = F.filter("_cells", lambda x: x != "")
    tokens = F.transform("_cells", lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))
    wanted = F.array(*[F.lit("".join(ch for ch in h.upper() if ch.isalnum())) for h in headers.values()])
    same = F.size(F.filter(F.zip_with(tokens, wanted, lambda a, b: (a == b) & (b != "")), lambda x: x))
    known = F.size(F.filter(tokens, lambda x: x != ""))
    staged = rows.withColumn("_cells", cells).withColumns({"_filled": filled, "_same": same, "_known": known})
    kind = (
        F.when(F.size("_filled") == 0, "blank")
        .when((F.size("_filled") == 1) & F.get("_filled", F.lit(0)).rlike(REPORT_STAMP), "stamp")
        .when((F.size("_filled") >= 2) & (F.col("_same") >= 2) & (F.col("_same") / F.col("_known") >= 0.6), "header")
        .otherwise("data")
    )
    return staged.withColumn("row_class", kind).drop("_cells", "_filled", "_same", "_known")


def removal_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("row_class").agg(F.count("*").alias("n_rows"))


def blank_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a single value (one aggregate row on the driver)."""
    counts = rows.agg(*[F.count_if(~is_blank(c)).alias(c) for c in columns]).first()
    return [c for c in columns if not counts[c]]


def mark_subtotals(rows: DataFrame, first: str, amount_columns: list[str], other_columns: list[str]) -> DataFrame:
    """Adds `subtotal`: a labelled total, or a row with a blank in a column that is neither amount nor quantity."""
    label = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(first, F.lit(""))), r"\s+", " "), r"^[ .:-]+|[ .:-]+$", "")
    labelled = label.rlike(r"\bTOTAL\s+FOR\b") | label.rlike("^SERVICES?$") | label.rlike(r"\bCASE\s*$")
    incomplete = F.exists(F.array(*[is_blank(c) for c in other_columns if c not in amount_columns]), lambda x: x)
    return rows.withColumn("subtotal", F.when(labelled, "labelled").when(incomplete, "incomplete"))


def fill_headings(rows: DataFrame, heading: Column, scope: list[str], position: str) -> DataFrame:
    """Label each row with the last heading row above it inside one file or section; heading rows are left out."""
    marked = last_known(rows.withColumn("_heading", heading), scope, position, F.col("_heading"), "section")
    return marked.filter("_heading IS NULL").drop("_heading")


def first_table(rows: DataFrame, cells: list[str], scope: list[str], position: str) -> DataFrame:
    """Rows from the first filled one up to the first blank row after it, per file."""
    blank = F.lit(True)
    for c in cells:
        blank = blank & is_blank(c)
    marked = rows.withColumn("_blank", blank)
    start = marked.filter("NOT _blank").groupBy(*scope).agg(F.min(position).alias("_start"))
    stop = (
        marked.filter("_blank").join(start, scope).filter(F.col(position) > F.col("_start")).groupBy(*scope).agg(F.min(position).alias("_stop"))
    )
    kept = marked.join(start, scope).join(stop, scope, "left")
    return kept.filter((F.col(position) >= F.col("_start")) & (F.col("_stop").isNull() | (F.col(position) < F.col("_stop")))).drop("_blank", "_start", "_stop")
