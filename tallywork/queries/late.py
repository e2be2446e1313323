"""Calendar, late-entry and pull-comparison queries over `orders`."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import late as l
from . import query

_CAL = """cal AS (SELECT 1998 AS fiscal_year, n AS period, CAST(DATE '1998-01-01' + CAST((n - 1) * 28 AS INT) AS DATE) AS s, CAST(DATE '1998-01-01' + CAST(n * 28 - 1 AS INT) AS DATE) AS e FROM (SELECT unnest(range(1, 14)) AS n))"""


def _calendar(t):
    return l.calendar(t.spark, 1998, date(1998, 1, 1))


@query(
    "date_to_fiscal_period",
    f"WITH {_CAL} SELECT o_orderkey, CAST(period AS INT) AS period FROM orders LEFT JOIN cal ON CAST(o_orderdate AS DATE) BETWEEN s AND e",
)
def located(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return l.with_period(rows, _calendar(t), "day").select("o_orderkey", "period")


def _entries(t):
    return t.orders.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(F.col("o_orderkey") % 31 == 0, None).otherwise(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 50).cast("int"))).alias("created"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


_LATE = f"""{_CAL}, r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT) END AS created,
  CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
p AS (SELECT r.*, CASE WHEN d < DATE '1998-01-01' THEN DATE '1997-12-31' ELSE e END AS pe, CASE WHEN d < DATE '1998-01-01' THEN 'Prior year' ELSE 'P' || lpad(CAST(period AS VARCHAR), 2, '0') END AS period_label
  FROM r LEFT JOIN cal ON d BETWEEN s AND e),
late AS (SELECT *, CAST(date_diff('day', pe, created) AS INT) AS days_after FROM p WHERE created > pe + 5)"""


@query("late_entries", f"WITH {_LATE} SELECT o_orderkey, period_label, days_after FROM late ORDER BY days_after DESC")
def late(t):
    found = l.late_entries(_entries(t), _calendar(t), close_days=5)
    return found.select("o_orderkey", "period_label", "days_after").orderBy(F.desc("days_after"))


@query(
    "late_entry_summary",
    f"""WITH {_LATE} SELECT (SELECT count(*) FROM r WHERE created IS NOT NULL) AS checked, CAST(0 AS BIGINT) AS unreadable_dates, (SELECT count(*) FROM r WHERE created IS NULL) AS unreadable_created,
    count(*) AS late_rows, CAST(sum(cents) AS BIGINT) AS late_cents FROM late""",
)
def summary(t):
    rows = _entries(t)
    return l.late_summary(rows, l.late_entries(rows, _calendar(t), close_days=5))


_OLD = """SELECT CAST(o_custkey % 40 AS STRING) AS po, CAST(o_custkey AS STRING) AS inv, CAST(CAST(ROUND(o_totalprice) AS BIGINT) % 7 AS STRING) AS amount, CAST(o_orderdate AS DATE) AS day,
  o_orderkey AS source_pos, CAST(ROUND(o_totalprice) AS BIGINT) % 7 AS cents FROM orders WHERE o_orderkey % 9 <> 0"""
_NEW = """SELECT CAST(o_custkey % 40 AS STRING) AS po, CAST(o_custkey AS STRING) AS inv, CAST(CAST(ROUND(o_totalprice) AS BIGINT) % 7 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS STRING) AS amount,
  CASE WHEN o_orderkey % 15 = 0 THEN DATE '2001-01-01' ELSE CAST(o_orderdate AS DATE) END AS day, o_orderkey AS source_pos, CAST(ROUND(o_totalprice) AS BIGINT) % 7 AS cents FROM orders WHERE o_orderkey % 11 <> 0"""


@query(
    "pull_comparison",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY po, inv, amount ORDER BY source_pos) AS k, count(*) OVER (PARTITION BY po, inv, amount) AS c FROM ({_OLD})),
    n AS (SELECT *, row_number() OVER (PARTITION BY po, inv, amount ORDER BY source_pos) AS k, count(*) OVER (PARTITION BY po, inv, amount) AS c FROM ({_NEW})),
    oc AS (SELECT po, inv, amount, count(*) AS c FROM o GROUP BY ALL), nc AS (SELECT po, inv, amount, count(*) AS c FROM n GROUP BY ALL),
    lo AS (SELECT o.* FROM o LEFT JOIN nc USING (po, inv, amount) WHERE o.k > coalesce(nc.c, 0)), ln AS (SELECT n.* FROM n LEFT JOIN oc USING (po, inv, amount) WHERE n.k > coalesce(oc.c, 0)),
    po_ AS (SELECT po, inv, count(*) AS c FROM lo GROUP BY ALL), pn AS (SELECT po, inv, count(*) AS c FROM ln GROUP BY ALL),
    single AS (SELECT po, inv FROM po_ JOIN pn USING (po, inv) WHERE po_.c = 1 AND pn.c = 1)
    SELECT 'Date changed' AS change, po, inv, o.amount AS old_amount, o.amount AS new_amount, CAST(o.day AS VARCHAR) AS old_day, CAST(n.day AS VARCHAR) AS new_day FROM o JOIN n USING (po, inv, amount)
      WHERE o.k = 1 AND n.k = 1 AND least(o.c, n.c) = 1 AND o.day <> n.day
    UNION ALL SELECT 'Amount changed', po, inv, lo.amount, ln.amount, CAST(lo.day AS VARCHAR), CAST(ln.day AS VARCHAR) FROM single JOIN lo USING (po, inv) JOIN ln USING (po, inv)
    UNION ALL SELECT 'Removed', po, inv, amount, NULL, CAST(day AS VARCHAR), NULL FROM lo WHERE (po, inv) NOT IN (SELECT (po, inv) FROM single)
    UNION ALL SELECT 'Added', po, inv, NULL, amount, NULL, CAST(day AS VARCHAR) FROM ln WHERE (po, inv) NOT IN (SELECT (po, inv) FROM single)""",
)
def pulls(t):
    t.orders.createOrReplaceTempView("orders")
    out = l.compare_pulls(t.spark.sql(_OLD), t.spark.sql(_NEW))
    return out.withColumns({"old_day": F.col("old_day").cast("string"), "new_day": F.col("new_day").cast("string")})


@query(
    "pull_drift",
    f"SELECT a AS earlier_cents, b AS current_cents, b - a AS drift_cents FROM (SELECT CAST(sum(cents) AS BIGINT) AS a FROM ({_OLD})), (SELECT CAST(sum(cents) AS BIGINT) AS b FROM ({_NEW}))",
)
def drift(t):
    t.orders.createOrReplaceTempView("orders")
    return l.pull_drift(t.spark.sql(_OLD), t.spark.sql(_NEW))


_YEARS = """SELECT year(o_orderdate) AS fiscal_year, CAST(month(o_orderdate) AS INT) AS period, CAST(min(o_orderdate) AS DATE) AS start, CAST(CASE WHEN month(o_orderdate) = 5 THEN min(o_orderdate) ELSE max(o_orderdate) END AS DATE) AS finish FROM orders GROUP BY year(o_orderdate), month(o_orderdate)"""


@query(
    "calendar_problems",
    f"SELECT fiscal_year, period FROM ({_YEARS})",
)
def problems(t):
    """Months of the orders as fiscal years: twelve periods are never thirteen, so every row is named."""
    t.orders.createOrReplaceTempView("orders")
    return l.calendar_problems(t.spark.sql(_YEARS).withColumnRenamed("finish", "end")).select("fiscal_year", "period")


_LISTED = """SELECT CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(month(o_orderdate) AS INT) AS period, count(*) AS n FROM orders GROUP BY 1, 2"""


@query(
    "calendar_findings",
    f"""WITH w AS ({_LISTED}), c AS (SELECT *, CAST(make_date(fiscal_year, 1, 1) + CAST(28 * period - 1 AS INT) AS DATE) AS e FROM w),
    g AS (SELECT fiscal_year, period, CAST(CASE WHEN period = 3 THEN 365 WHEN n % 2 = 0 THEN 0 ELSE 1 + n % 5 END AS INT) AS gap_days FROM c)
    SELECT fiscal_year, period, gap_days, CASE WHEN gap_days IN (365, 366) THEN 'year looks mistyped' ELSE 'differs from the calendar' END AS finding FROM g WHERE gap_days <> 0""",
)
def findings(t):
    """Period ends as written for every year of the orders, some off by days that depend on their orders, against the calendars of all years."""
    t.orders.createOrReplaceTempView("orders")
    off = F.when(F.col("period") == 3, 365).when(F.col("n") % 2 == 0, 0).otherwise(1 + F.col("n") % 5).cast("int")
    listed = t.spark.sql(_LISTED).withColumn("listed_end", F.date_add(F.make_date("fiscal_year", F.lit(1), F.lit(1)), F.col("period") * 28 - 1 + off))
    span = t.orders.agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last")).first()
    years = range(span["first"], span["last"] + 1) if span["first"] is not None else [2000]
    calendars = reduce(DataFrame.unionByName, [l.calendar(t.spark, y, date(y, 1, 1)) for y in years])
    return l.calendar_findings(listed, calendars).select("fiscal_year", "period", "gap_days", "finding")
