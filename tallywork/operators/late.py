"""Fiscal calendar, late entries, and two pulls of one period compared."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import BLOCK_ROWS, beside, running_before

PERIOD_COUNT, PERIOD_DAYS = 13, 28


def default_ends(start: date, last_days: int = PERIOD_DAYS) -> list[date]:
    """Twelve four-week periods, then Period 13 of `last_days`."""
    twelve = [start + timedelta(days=PERIOD_DAYS * n - 1) for n in range(1, PERIOD_COUNT)]
    return [*twelve, twelve[-1] + timedelta(days=last_days)]


def calendar(spark: SparkSession, year: int, start: date, ends: list[date] | None = None) -> DataFrame:
    """(fiscal_year, period, start, end): thirteen rows."""
    ends = ends or default_ends(start)
    starts = [start, *[e + timedelta(days=1) for e in ends[:-1]]]
    rows = [(year, n, s, e) for n, (s, e) in enumerate(zip(starts, ends), 1)]
    return spark.createDataFrame(rows, "fiscal_year int, period int, start date, end date")


def calendar_problems(periods: DataFrame) -> DataFrame:
    """Periods whose end does not come after the one before (the first: not before its start), per fiscal year."""
    window = Window.partitionBy("fiscal_year").orderBy("period")
    linked = periods.withColumns(
        {"previous": F.lag("end").over(window), "periods": F.count("*").over(Window.partitionBy("fiscal_year"))}
    )
    bad = F.col("end").isNull() | (F.col("end") <= F.col("previous")) | (F.col("previous").isNull() & (F.col("end") < F.col("start")))
    return linked.filter(bad | (F.col("periods") != PERIOD_COUNT)).drop("previous")


def with_period(rows: DataFrame, periods: DataFrame, day: str) -> DataFrame:
    """Adds fiscal_year, period, period_end: every day of the calendar is a row, and rows look up their day, so any number
    of years is one equality join. A period whose end lies before its start has no day."""
    days = periods.filter(F.col("start") <= F.col("end")).select(
        "fiscal_year", "period", F.col("end").alias("period_end"), F.explode(F.sequence("start", "end")).alias("_day")
    )
    return rows.join(days, F.col(day) == F.col("_day"), "left").drop("_day")


def late_entries(rows: DataFrame, periods: DataFrame, close_days: int = 0, selected_period: int | None = None) -> DataFrame:
    """Rows created after the close of the period their transaction date belongs to, plus grace days.

    A day before the calendar belongs to the prior year, whose end is the day before the calendar starts. A day after
    the last period has no period and is not checked. `rows` need txn_date and created.
    """
    first = periods.agg(F.min("start").alias("first_day"))
    located = with_period(rows, periods, "txn_date").transform(beside, first)
    prior = F.col("txn_date") < F.col("first_day")
    located = located.withColumns(
        {
            "period_end": F.when(prior, F.date_sub("first_day", 1)).otherwise(F.col("period_end")),
            "period_no": F.when(prior, F.lit(0)).otherwise(F.col("period")),
            "period_label": F.when(prior, "Prior year").otherwise(F.format_string("P%02d", "period")),
        }
    )
    checked = located.filter("period_end IS NOT NULL AND created IS NOT NULL")
    if selected_period is not None:
        checked = checked.filter(F.col("period_no") < selected_period)
    return checked.filter(F.col("created") > F.date_add("period_end", close_days)).withColumn(
        "days_after", F.datediff("created", "period_end")
    ).drop("first_day", "period", "fiscal_year")


def late_summary(rows: DataFrame, late: DataFrame) -> DataFrame:
    """One row: checked, unreadable, late rows and cents."""
    left = rows.agg(
        F.count_if(F.col("txn_date").isNotNull() & F.col("created").isNotNull()).alias("checked"),
        F.count_if(F.col("txn_date").isNull()).alias("unreadable_dates"),
        F.count_if(F.col("created").isNull()).alias("unreadable_created"),
    )
    return left.transform(beside, late.agg(F.count("*").alias("late_rows"), F.coalesce(F.sum("cents"), F.lit(0)).alias("late_cents")))


def compare_pulls(earlier: DataFrame, current: DataFrame) -> DataFrame:
    """Multiset difference of two pulls: changes as (change, key, earlier and current amount and date).

    Both need po, inv (normalized), amount (text form of the cents), day, source_pos. Equal (po, inv, amount) rows pair
    off up to the smaller count, in file order. A lone pair with another date is a date change; what is left is
    regrouped by (po, inv): one row on each side is an amount change, the rest was added or removed.
    """
    both = earlier.select("po", "inv", "amount", "day", "source_pos", F.lit(0).alias("pull")).unionByName(
        current.select("po", "inv", "amount", "day", "source_pos", F.lit(1).alias("pull"))
    )
    old, new = F.col("pull") == 0, F.col("pull") == 1
    key = ["po", "inv", "amount"]
    counts = both.groupBy(*key).agg(
        F.count_if(old).alias("n_old"), F.count_if(new).alias("n_new"),
        F.min_by(F.when(old, F.struct("day")), F.when(old, F.col("source_pos"))).alias("old_first"),
        F.min_by(F.when(new, F.struct("day")), F.when(new, F.col("source_pos"))).alias("new_first"),
    ).withColumn("paired", F.least("n_old", "n_new"))
    moved = counts.filter("paired = 1").select(
        F.lit("Date changed").alias("change"), "po", "inv", F.col("amount").alias("old_amount"), F.col("amount").alias("new_amount"),
        F.col("old_first.day").alias("old_day"), F.col("new_first.day").alias("new_day"),
    ).filter(~F.col("old_day").eqNullSafe(F.col("new_day")))
    surplus = both.join(counts.filter("n_old <> n_new").select(*key, "paired"), key)
    placed = running_before(
        surplus.withColumn("_chunk", F.floor(F.col("source_pos") / BLOCK_ROWS)), [*key, "pull"], "_chunk", "source_pos",
        {"earlier_rows": F.lit(1)},
    )
    left = placed.filter("earlier_rows >= paired").select("po", "inv", "amount", "day", "source_pos", "pull")
    lone = left.groupBy("po", "inv").agg(
        F.count_if(old).alias("n_old"), F.count_if(new).alias("n_new"),
        F.max(F.when(old, F.struct("amount", "day"))).alias("o"), F.max(F.when(new, F.struct("amount", "day"))).alias("n"),
    )
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    repriced = lone.filter(single).select(
        F.lit("Amount changed").alias("change"), "po", "inv", F.col("o.amount").alias("old_amount"),
        F.col("n.amount").alias("new_amount"), F.col("o.day").alias("old_day"), F.col("n.day").alias("new_day"),
    )
    rest = left.join(lone.filter(~single).select("po", "inv"), ["po", "inv"], "left_semi")
    text, none_day = F.lit(None).cast("string"), F.lit(None).cast("date")
    others = rest.select(
        F.when(new, "Added").otherwise("Removed").alias("change"), "po", "inv",
        F.when(old, F.col("amount")).otherwise(text).alias("old_amount"), F.when(new, F.col("amount")).otherwise(text).alias("new_amount"),
        F.when(old, F.col("day")).otherwise(none_day).alias("old_day"), F.when(new, F.col("day")).otherwise(none_day).alias("new_day"),
    )
    return moved.unionByName(repriced).unionByName(others)


def pull_drift(earlier: DataFrame, current: DataFrame) -> DataFrame:
    """Signed cents of both pulls and how far the total moved."""
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum("cents"), F.lit(0)).alias(name))

    return total(earlier, "earlier_cents").transform(beside, total(current, "current_cents")).withColumn(
        "drift_cents", F.col("current_cents") - F.col("earlier_cents")
    )


def calendar_findings(listed: DataFrame, periods: DataFrame) -> DataFrame:
    """Period dates written in a workbook against the calendar; a gap of one year is named a typing error. Where both name
    the fiscal year, periods meet by year and number, otherwise by number alone."""
    keys = [k for k in ("fiscal_year", "period") if k in listed.columns]
    joined = listed.join(periods.select(*keys, "start", "end"), keys)
    gap = F.datediff(F.col("listed_end"), F.col("end"))
    return joined.withColumn("gap_days", gap).filter("gap_days <> 0").withColumn(
        "finding", F.when(F.abs("gap_days").isin(365, 366), "year looks mistyped").otherwise("differs from the calendar")
    )


def pasted_ends(text: str) -> list[date]:
    """The thirteen period ends of pasted text: `2025-10-25`, `10/25/2025` or `10/25/25`, in any common separation."""
    found = []
    for place, piece in enumerate([p.strip() for p in re.split(r"[\n\r\t,;]+", text or "") if p.strip()], 1):
        for pattern in ("%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y"):
            try:
                found.append(datetime.strptime(piece, pattern).date())
                break
            except ValueError:
                continue
        else:
            raise ValueError(f"Entry {place} ('{piece}') is not a date. Use 2025-10-25 or 10/25/2025.")
    if len(found) != PERIOD_COUNT:
        raise ValueError(f"Found {len(found)} dates; paste exactly {PERIOD_COUNT}, one per period.")
    return found
