"""Inventory reports over layers and closed periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import beside

# Age buckets by days, and the period length used before a first close is known.
BUCKETS = (("d0_30", "0-30 days", 30), ("d31_60", "31-60 days", 60), ("d61_90", "61-90 days", 90))
OVER, UNKNOWN = ("d90_up", "90+ days"), ("unknown", "Unknown / unparsed date")
DEFAULT_PERIOD_DAYS = 28
PERIODS = range(1, 14)


def _bucket(age: Column, which: int) -> Column:
    out = F.when(age.isNull(), (UNKNOWN[0], UNKNOWN[1])[which])
    for column, label, limit in BUCKETS:
        out = out.when(age <= limit, (column, label)[which])
    return out.otherwise((OVER[0], OVER[1])[which])


def _aged(on_hand: DataFrame, as_of: str) -> DataFrame:
    return on_hand.filter("qty > 0").withColumn("age", F.datediff(F.lit(as_of).cast("date"), "start_day"))


def aging_pivot(on_hand: DataFrame, as_of: str) -> DataFrame:
    """Value on hand per product and age bucket, with a total column and a total row (product is null)."""
    names = [b[0] for b in BUCKETS] + [OVER[0], UNKNOWN[0]]
    aged = _aged(on_hand, as_of).withColumn("bucket", _bucket(F.col("age"), 0))
    sums = [F.coalesce(F.sum(F.when(F.col("bucket") == n, F.col("total_value"))), F.lit(0.0)).alias(n) for n in names]
    return aged.rollup("product").agg(*sums, F.sum("total_value").alias("total"))


def aging_shares(on_hand: DataFrame, as_of: str) -> DataFrame:
    """Value per bucket and its share of all value on hand (null if nothing on hand has a value)."""
    by_bucket = _aged(on_hand, as_of).groupBy(_bucket(F.col("age"), 1).alias("bucket")).agg(F.sum("total_value").alias("value"))
    total = by_bucket.agg(F.sum("value").alias("all_value"))
    return by_bucket.transform(beside, total).select("bucket", "value", (F.col("value") / F.nullif("all_value", F.lit(0.0)) * 100).alias("share"))


def period_pivot(figures: DataFrame, measure: str) -> DataFrame:
    """product x 13 periods with category subtotals and a grand total, in one rollup."""
    columns = [F.sum(F.when(F.col("period") == p, F.col(measure))).alias(f"p{p:02d}") for p in PERIODS]
    return figures.rollup("category", "product").agg(*columns)


def unit_cost_pivot(figures: DataFrame) -> DataFrame:
    """Ending value / ending quantity per product and period."""
    cost = [
        (F.sum(F.when(F.col("period") == p, F.col("end_val"))) / F.nullif(F.sum(F.when(F.col("period") == p, F.col("end_qty"))), F.lit(0.0))).alias(f"p{p:02d}")
        for p in PERIODS
    ]
    return figures.groupBy("category", "product").agg(*cost)


def turnover(closed: DataFrame) -> DataFrame:
    """Turnover ratio and days of supply per product and period. A window holds the closed periods of one product."""
    window = Window.partitionBy("product").orderBy("fiscal_year", "period")
    days = F.coalesce(F.datediff("as_of", F.lag("as_of").over(window)), F.lit(DEFAULT_PERIOD_DAYS))
    average = (F.col("beg_val") + F.col("end_val")) / 2
    return closed.withColumn("days", days).withColumns(
        {
            "turnover": F.when(average > 0, F.col("usage_val") / average),
            "days_of_supply": F.when(
                (F.col("usage_qty") > 0) & (F.col("days") > 0), F.col("end_qty") / (F.col("usage_qty") / F.col("days"))
            ),
        }
    )


def portfolio_turnover(closed: DataFrame) -> DataFrame:
    sums = closed.groupBy("fiscal_year", "period").agg(*[F.sum(c).alias(c) for c in ("usage_val", "beg_val", "end_val")])
    average = (F.col("beg_val") + F.col("end_val")) / 2
    return sums.withColumn("turnover", F.when(average > 0, F.col("usage_val") / average))


def check_rows(statuses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Portfolio checks of a costing run as (check, amount, status); `outcomes` are the recognized receipt log rows."""
    c, s = F.col, F.col("overall_status")
    run = statuses.agg(
        F.count("*").alias("n"), F.count_if(s == "FAIL").alias("fail"), F.count_if(s == "REVIEW").alias("review"),
        F.count_if("carried_forward").alias("carried"), F.round(F.sum(c("beg_val") + c("purch_val") - c("usage_val") - c("end_val")), 2).alias("gap"),
        F.sum("purch_val").alias("purchases"),
    )
    took = c("outcome").isin("in period", "late")
    log = outcomes.agg(
        F.count_if(took).alias("recognized"), F.count_if(c("outcome") == "late").alias("late"), F.count_if(c("outcome") == "rejected").alias("rejected"),
        F.count_if(c("outcome") == "presumed in opening").alias("presumed"), F.count_if(took & (F.abs("total") < 0.005) & (c("qty") > 0)).alias("zero"),
        F.coalesce(F.sum(F.when(took, c("total"))), F.lit(0.0)).alias("receipt_cost"),
    )
    one = run.transform(beside, log)
    receipt_gap = F.round(c("receipt_cost") - c("purchases"), 2)

    def if_any(column: str, word: str) -> Column:
        return F.when(c(column) > 0, word).otherwise("PASS")

    lines = (
        ("Materials calculated", c("n"), F.when(c("n") > 0, "PASS").otherwise("FAIL")), ("Materials failing controls", c("fail"), if_any("fail", "FAIL")),
        ("Materials to review", c("review"), if_any("review", "REVIEW")), ("Materials carried forward (no count)", c("carried"), F.lit("INFO")),
        ("Receipt rows rejected", c("rejected"), if_any("rejected", "FAIL")), ("Receipts recognized this period", c("recognized"), F.lit("INFO")),
        ("Late receipts picked up", c("late"), F.lit("INFO")), ("Receipts presumed in the opening layers", c("presumed"), F.lit("INFO")),
        ("Receipts recorded at $0.00", c("zero"), if_any("zero", "REVIEW")),
        ("Roll-forward ties", c("gap"), F.when(F.abs("gap") <= 0.01, "PASS").otherwise("FAIL")),
        ("Receipts tie to purchases", receipt_gap, F.when(F.abs(receipt_gap) <= 0.01, "PASS").otherwise("FAIL")),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("amount"), k.alias("status")) for n, v, k in lines])))
