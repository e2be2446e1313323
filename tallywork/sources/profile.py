"""What a source holds before anything runs: profile, fingerprint, validation report, files seen before."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identifiers as ids
from ..functions.dates import flexible_date
from ..functions.money import cents
from ..functions.text import is_blank


def profile(rows: DataFrame, amount: str, date: str, period: str | None = None) -> DataFrame:
    """Rows, signed total, readable amounts, date range and period range in one pass."""
    p = F.col(period).try_cast("int") if period else F.lit(None).cast("int")
    read = rows.select(cents(amount).alias("c"), flexible_date(date).alias("d"), p.alias("p"))
    return read.agg(
        F.count("*").alias("n_rows"), F.count("c").alias("readable_amounts"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_cents"),
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.min("p").alias("first_period"), F.max("p").alias("last_period"),
    )


def fingerprint(rows: DataFrame, options: dict | None = None) -> DataFrame:
    """Content hash of column names and cells, in any order of rows and columns, plus the digest of the options: (n_rows, content, options)."""
    cells = [x for c in sorted(rows.columns) for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("\x00")))]
    h = F.xxhash64(*cells)
    text = json.dumps(options or {}, sort_keys=True)
    return rows.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"),
        F.sha2(F.lit(text), 256).alias("options"),
    )


def period_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, populated, valid, strict): is every filled cell a whole number from 1 to 13, and every row filled?"""
    def stats(c: str) -> Column:
        number = F.col(c).cast("string").try_cast("double")
        valid = number.between(1, 13) & (number == F.floor(number))
        return F.struct(F.lit(c).alias("column"), F.count_if(~is_blank(c)).alias("populated"), F.count_if(valid).alias("valid"), F.count("*").alias("n_rows"))

    one = rows.agg(F.array(*[stats(c) for c in columns]).alias("s"))
    out = one.select(F.inline("s"))
    return out.withColumn("strict", (F.col("populated") == F.col("n_rows")) & (F.col("valid") == F.col("n_rows")) & (F.col("n_rows") > 0))


def infer_period_column(rows: DataFrame, columns: list[str]) -> str | None:
    """The first column every row of which is a period number."""
    strict = {r["column"] for r in period_profile(rows, columns).filter("strict").collect()}
    return next((c for c in columns if c in strict), None)


def validation_report(rows: DataFrame, roles) -> DataFrame:
    """(check, status, details) before matching: usable rows, distinct roles, readable amounts, references, periods."""
    named = [roles.po, roles.invoice, roles.amount]
    facts = rows.agg(
        F.count("*").alias("n"), F.count(cents(roles.amount)).alias("amounts"),
        F.count_if((ids.po_key(roles.po) != "") | (ids.alnum_key(roles.invoice) != "")).alias("refs"),
    )
    rate, ref = F.col("amounts") / F.col("n"), F.col("refs") / F.col("n")
    distinct = F.lit("PASS" if len(set(named)) == len(named) else "FAIL")
    lines = [
        ("Usable data rows", F.when(F.col("n") > 0, "PASS").otherwise("FAIL"), F.col("n")),
        ("Distinct mapping fields", distinct, F.lit(len(set(named)))),
        ("Amount field parseability", F.when((F.col("amounts") == 0) | (rate < 0.5), "FAIL").when(rate < 0.9, "WARNING").otherwise("PASS"), F.col("amounts")),
        ("Reference availability", F.when(F.col("refs") == 0, "FAIL").when(ref < 0.5, "WARNING").otherwise("PASS"), F.col("refs")),
    ]
    out = facts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), s.alias("status"), d.cast("bigint").alias("details")) for c, s, d in lines])))
    if roles.period:
        period = period_profile(rows, [roles.period]).select(
            F.lit("Fiscal period values").alias("check"), F.when(F.col("strict"), "PASS").otherwise("FAIL").alias("status"), F.col("valid").cast("bigint").alias("details")
        )
        out = out.unionByName(period)
    return out


def rows_accounted(counts: dict[str, int], file_rows: int) -> str:
    """PASS when used and removed rows add up to the rows of the file."""
    return "PASS" if sum(counts.values()) == file_rows else "FAIL"


def known_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files seen before (`runs`: sha256, run_ref), and files given for more than one side of this run."""
    seen = files.join(runs.groupBy("sha256").agg(F.max("run_ref").alias("run_ref")), "sha256").select("sha256", F.lit("used before").alias("finding"), "run_ref")
    twice = files.groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1").select("sha256", F.lit("same file on two sides").alias("finding"), F.lit(None).cast("string").alias("run_ref"))
    return seen.unionByName(twice)


def version_log(log: DataFrame, keep: int = 3) -> DataFrame:
    """Current and backup files from an append-only log of (scope, version, kind 'save' or 'clear')."""
    from ..runtime import first_per_group

    last_clear = log.filter("kind = 'clear'").groupBy("scope").agg(F.max("version").alias("cleared"))
    live = log.filter("kind = 'save'").join(last_clear, "scope", "left").filter("cleared IS NULL OR version > cleared").drop("cleared")
    ranked = first_per_group(live, ["scope"], [F.col("version").desc()], keep)
    return ranked.withColumn("standing", F.when(F.col("_rank") == 1, "current").otherwise(F.concat(F.lit("backup "), (F.col("_rank") - 1).cast("string")))).drop("_rank")
