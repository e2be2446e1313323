"""What keeps inputs from being used: headers, blank tables, unreadable cells, repeated or missing keys, rows that went astray.

Every check of a job is a line (dataset, check, status, n_rows, examples). Rows that break a check are stacked with the check's name; one
aggregate counts them and a top-k per check, kept small in every task, names the first ten, so a check that
half of all rows break costs no more than one that none does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import cents
from ..functions.text import is_blank
from ..runtime import first_per_group
from ..operators.reports import stack

SHOWN = 10
QTY_TOLERANCE = 0.0001
LINE = "dataset string, check string, status string, n_rows bigint, examples array<string>"
PASS, WARNING, FAIL = "PASS", "WARNING", "FAIL"

# Fixed values: (place from 1, word its header should hold, what the column is read as).
SOURCE_HINTS = ((1, "vendor", "Vendor"), (3, "transaction", "Transaction ID"), (5, "account", "Account #"), (6, "cost", "Cost Center"), (7, "amount", "Amount"), (10, "code", "Code"))
MAPPING_HINTS = ((1, "name", "Vendor Name"), (4, "taxab", "Taxability"), (5, "group", "Grouping"))
SOURCE_WIDTH, MAPPING_WIDTH, ACCOUNTS_WIDTH = 11, 5, 3


def header_lines(dataset: str, headers: list[str], width: int, exact: bool = False, hints: tuple = ()) -> list[tuple]:
    """Lines about the header alone: its width, blank and repeated names, and columns that seem to stand elsewhere (a warning only)."""
    shapes = [x.strip().lower() for x in headers]
    blank = [str(n) for n, x in enumerate(shapes, 1) if not x or x.startswith("unnamed")]
    repeated = sorted({x for x in headers if headers.count(x) > 1})
    moved = []
    for place, word, label in hints:
        if place <= len(shapes) and word not in shapes[place - 1]:
            there = next((n for n, x in enumerate(shapes, 1) if word in x), None)
            if there is not None:
                moved.append(f"{label}: read from column {place}, looks like column {there}")
    fits = len(headers) == width if exact else len(headers) >= width
    return [
        (dataset, "Columns", PASS if fits else FAIL, len(headers), [] if fits else [f"{'exactly' if exact else 'at least'} {width} are required"]),
        (dataset, "Blank headers", FAIL if blank else PASS, len(blank), blank), (dataset, "Repeated headers", FAIL if repeated else PASS, len(repeated), repeated),
        (dataset, "Columns in their place", WARNING if moved else PASS, len(moved), moved),
    ]


@dataclass(frozen=True)
class Check:
    """One check over rows: `broken` holds a row (`item`, and `at` to order by) for each row that breaks it."""

    dataset: str
    name: str
    broken: DataFrame
    at_fault: str = FAIL

    def rows(self) -> DataFrame:
        at = F.col("at") if "at" in self.broken.columns else F.lit(0)
        return self.broken.select(F.lit(self.dataset).alias("dataset"), F.lit(self.name).alias("check"), at.cast("bigint").alias("at"), F.col("item").cast("string").alias("item"))


def lines_of(checks: list[Check]) -> DataFrame:
    """A line for every check, also for those that nothing breaks; examples by `at`, then by text."""
    spark = checks[0].broken.sparkSession
    names = spark.createDataFrame([(c.dataset, c.name, c.at_fault) for c in checks], "dataset string, check string, at_fault string")
    broken = stack([c.rows() for c in checks])
    counts = broken.groupBy("dataset", "check").agg(F.count("*").alias("n"))
    first = first_per_group(broken, ["dataset", "check"], [F.col("at"), F.col("item")], SHOWN)
    shown = first.groupBy("dataset", "check").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "item"))), lambda x: x["item"]).alias("items"))
    found = names.join(counts, ["dataset", "check"], "left").join(shown, ["dataset", "check"], "left")
    return found.select(
        "dataset", "check", F.when(F.col("n") > 0, F.col("at_fault")).otherwise(PASS).alias("status"), F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.coalesce("items", F.array().cast("array<string>")).alias("examples"),
    )


def _blank_table(dataset: str, rows: DataFrame) -> Check:
    return Check(dataset, "Rows", rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("the table is blank").alias("item")))


def cleanup_checks(source: DataFrame, mapping: DataFrame, accounts: DataFrame, position: str = "source_pos") -> DataFrame:
    """Every line about the three inputs of transaction clean-up: nothing stops at the first fault. `position` is no column of the file."""
    spark = source.sparkSession
    own = {name: [c for c in df.columns if c != position] for name, df in (("source", source), ("mapping", mapping), ("accounts", accounts))}
    header = [
        *header_lines("Source Transactions", own["source"], SOURCE_WIDTH, True, SOURCE_HINTS), *header_lines("Vendor Mapping", own["mapping"], MAPPING_WIDTH, False, MAPPING_HINTS),
        *header_lines("Trial Balance", own["accounts"], ACCOUNTS_WIDTH),
    ]
    checks = [_blank_table(name, df) for name, df in (("Source Transactions", source), ("Vendor Mapping", mapping), ("Trial Balance", accounts))]
    if len(own["source"]) >= SOURCE_HINTS[4][0]:
        amount = F.col(f"`{own['source'][SOURCE_HINTS[4][0] - 1]}`").cast("string")
        read = source.select(F.col(position).alias("at"), F.col(position).alias("item"), is_blank(amount).alias("blank"), amount.try_cast("double").isNull().alias("unread"))
        checks.append(Check("Source Transactions", "Blank amounts", read.filter("blank")))
        checks.append(Check("Source Transactions", "Amounts that are no number", read.filter("unread AND NOT blank")))
    return spark.createDataFrame(header, LINE).unionByName(lines_of(checks))


def listing_checks(old: DataFrame, new: DataFrame, old_roles: dict[str, str], new_roles: dict[str, str]) -> DataFrame:
    """Lines about two vendor listings: blank tables, and roles (`id`, `name`, and for the old one `tax`, `group`) that share a column."""
    lines = []
    for dataset, roles in (("Previous Vendor Listing", old_roles), ("Updated Vendor Listing", new_roles)):
        for one, two in (("id", "name"), ("tax", "group")):
            if roles.get(one) is not None and roles.get(two) is not None:
                same = roles[one] == roles[two]
                lines.append((dataset, f"Columns of {one} and {two} differ", FAIL if same else PASS, int(same), [roles[one]] if same else []))
    rows = lines_of([_blank_table("Previous Vendor Listing", old), _blank_table("Updated Vendor Listing", new)])
    return rows if not lines else old.sparkSession.createDataFrame(lines, LINE).unionByName(rows)


def grid_checks(grid: DataFrame, products: DataFrame, key: str, period: int) -> DataFrame:
    """Lines about a wide grid before a period is costed: the period's columns, repeated and missing products (`products` has `key`),
    and cells of the period's first and last column that are blank, no number, or below zero."""
    name, last, first = "Master Grid", f"{period:02d}", "13" if period == 1 else f"{period - 1:02d}"
    if key not in grid.columns:
        return grid.sparkSession.createDataFrame([(name, "Product column", FAIL, 1, [key])], LINE)
    there = [c for c in (first, last) if c in grid.columns]
    header = [(name, f"Column of period {c}", PASS if c in there else FAIL, int(c not in there), [] if c in there else [c]) for c in (first, last)]
    alias = F.col(key).try_cast("bigint")
    keyed = grid.withColumn("_alias", alias).filter("_alias IS NOT NULL")
    twice = keyed.groupBy("_alias").agg(F.count("*").alias("n")).filter("n > 1")
    missing = products.select(F.col(key).try_cast("bigint").alias("_alias")).filter("_alias IS NOT NULL").distinct().join(keyed.select("_alias"), "_alias", "left_anti")
    item = F.col("_alias")
    checks = [
        Check(name, "Repeated products", twice.select(item.alias("at"), item.alias("item"))), Check(name, "Missing products", missing.select(item.alias("at"), item.alias("item"))),
    ]
    for c in there:
        value = F.col(f"`{c}`").cast("string").try_cast("double")
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        cells = grid.select(alias.alias("at"), alias.alias("item"), bad.alias("bad"), (value < -QTY_TOLERANCE).alias("below"))
        checks.append(Check(name, f"Quantities of period {c} that are blank or no number", cells.filter("bad")))
        checks.append(Check(name, f"Quantities of period {c} below zero", cells.filter("below AND NOT bad")))
    return grid.sparkSession.createDataFrame(header, LINE).unionByName(lines_of(checks))


def arrival_checks(dataset: str, classified: DataFrame, used: Column, amount: str) -> DataFrame:
    """Did every row and every amount of a file arrive? `classified` has every row below the header with `row_class` ('data', or why
    it was removed); `used` says which data rows are read. Lines (dataset, check, status, n_rows, cents); all from one scan.

    A row without a class is unaccounted for. Amounts in rows left out are a warning unless they sum to nothing; blank and
    unreadable amounts of used rows are a warning; credits are only counted.
    """
    read = classified.select(F.col("row_class"), F.coalesce(used, F.lit(False)).alias("used"), is_blank(amount).alias("blank"), cents(amount).alias("c"))
    data, zero = F.col("row_class") == "data", F.lit(0)
    taken, left = data & F.col("used"), data & ~F.col("used")

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("c"))), zero)

    one = read.agg(
        F.count_if(F.col("row_class").isNull()).alias("lost"), F.count_if(taken).alias("taken"), total(taken).alias("taken_cents"),
        F.count_if(left).alias("left"), total(left).alias("left_cents"), F.count_if(taken & F.col("blank")).alias("blank"),
        F.count_if(taken & ~F.col("blank") & F.col("c").isNull()).alias("unread"), F.count_if(taken & (F.col("c") == 0)).alias("zeros"),
        F.count_if(taken & (F.col("c") < 0)).alias("credits"), total(taken & (F.col("c") < 0)).alias("credit_cents"), F.count_if(F.col("row_class") != "data").alias("removed"),
    )

    def if_any(condition: Column, status: str) -> Column:
        return F.when(condition, status).otherwise(PASS)

    lines = (
        ("Rows that are not accounted for", if_any(F.col("lost") > 0, FAIL), F.col("lost"), zero), ("Rows used", if_any(F.col("taken") == 0, FAIL), F.col("taken"), F.col("taken_cents")),
        ("Rows removed by clean-up", F.lit(PASS), F.col("removed"), zero), ("Amount in rows left out", if_any(F.col("left_cents") != 0, WARNING), F.col("left"), F.col("left_cents")),
        ("Blank amounts", if_any(F.col("blank") > 0, WARNING), F.col("blank"), zero), ("Unreadable amounts", if_any(F.col("unread") > 0, WARNING), F.col("unread"), zero),
        ("Zero amounts", F.lit(PASS), F.col("zeros"), zero), ("Credits and negative amounts", F.lit(PASS), F.col("credits"), F.col("credit_cents")),
    )
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(dataset).alias("dataset"), F.lit(n).alias("check"), s.alias("status"), k.cast("bigint").alias("n_rows"), v.cast("bigint").alias("cents")) for n, s, k, v in lines
    ])))
