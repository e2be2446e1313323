"""FIFO costing over `lineitem`: every line is a receipt of its part; history before 1997 is the opening stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fifo, insights, periods
from ..runtime import cut
from . import query

_RECEIPT = """SELECT l_partkey AS product, CAST(l_shipdate AS DATE) AS delivered, l_orderkey * 8 + l_linenumber AS source_pos,
  l_quantity AS qty, CASE WHEN l_partkey % 5 = 0 THEN l_quantity * 7.5 ELSE l_extendedprice END AS total, l_returnflag AS uom FROM lineitem"""
_OPEN = """SELECT l_partkey AS product, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS seq,
  CAST(l_shipdate AS DATE) AS start_day, l_quantity AS qty, l_extendedprice AS total_value FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'"""
# Count rule shared by both engines: three in ten products get no count, one in ten a count of zero.
_COUNT = """CASE WHEN product % 10 < 3 THEN NULL WHEN product % 10 = 3 THEN 0.0 WHEN product % 10 = 4 THEN held + 100.0
  ELSE floor(held * 0.4) END"""

SQL_RUNS = f"""r AS (SELECT *, total / qty AS unit_cost FROM ({_RECEIPT})),
lagged AS (SELECT *, CASE WHEN lag(unit_cost) OVER w = unit_cost AND lag(uom) OVER w = uom THEN 0 ELSE 1 END AS starts FROM r
  WINDOW w AS (PARTITION BY product ORDER BY delivered, source_pos)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY product ORDER BY delivered, source_pos) AS run FROM lagged)"""

SQL_BATCH = f"""opening AS (SELECT product, 0 AS kind, seq, start_day, qty, total_value FROM ({_OPEN})),
r AS (SELECT *, total / qty AS unit_cost FROM ({_RECEIPT}) WHERE delivered >= DATE '1997-01-01'),
lagged AS (SELECT *, CASE WHEN lag(unit_cost) OVER w = unit_cost AND lag(uom) OVER w = uom THEN 0 ELSE 1 END AS starts FROM r
  WINDOW w AS (PARTITION BY product ORDER BY delivered, source_pos)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY product ORDER BY delivered, source_pos) AS run FROM lagged),
received AS (SELECT product, 1 AS kind, CAST(run AS BIGINT) AS seq, min(delivered) AS start_day, sum(qty) AS qty, sum(total) AS total_value FROM runs GROUP BY 1, 3),
layers AS (SELECT * FROM opening UNION ALL SELECT * FROM received),
held AS (SELECT p_partkey AS product, coalesce(sum(qty), 0) AS held, coalesce(sum(qty) FILTER (WHERE kind = 0), 0) AS held0 FROM part LEFT JOIN layers ON product = p_partkey GROUP BY 1),
usage AS (SELECT product, coalesce({_COUNT}, held) AS ending_qty, held - coalesce({_COUNT}, held) AS usage_qty, ({_COUNT}) IS NULL AS carried_forward FROM held),
cum AS (SELECT l.*, coalesce(sum(qty) OVER (PARTITION BY product ORDER BY kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM layers l),
taken AS (SELECT c.*, usage_qty, greatest(0, least(qty, greatest(usage_qty, 0) - before)) AS consumed FROM cum c JOIN usage USING (product)),
consumed AS MATERIALIZED (SELECT *, qty - consumed AS remaining, CASE WHEN consumed <= 0.0001 THEN 0 WHEN qty - consumed <= 0.0001 THEN total_value
  ELSE total_value * (consumed / qty) END AS consumed_value FROM taken)"""


def _receipts(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql(_RECEIPT)


def _batch(t):
    receipts = _receipts(t)
    early = t.lineitem.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"))
    placed = fifo.running_before(
        early.select(
            F.col("l_partkey").alias("product"), F.col("l_shipdate").cast("date").alias("start_day"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_pos"), F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("total_value"),
        ),
        ["product"], "start_day", "source_pos", {"earlier": F.lit(1)},
    )
    opening = placed.select(
        "product", (F.col("earlier") + 1).cast("bigint").alias("seq"), F.col("start_day").cast("string").alias("date_text"),
        "start_day", "qty", "total_value", (F.col("total_value") / F.col("qty")).alias("unit_cost"),
    )
    opening = cut(opening, "opening", compression="zstd")
    fresh = receipts.filter("delivered >= DATE '1997-01-01'")
    products = t.part.select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"))
    stock = opening.select("product", "qty").unionByName(fresh.select("product", "qty")).groupBy("product").agg(F.sum("qty").alias("held"))
    grid = products.join(stock, "product", "left").fillna(0.0, ["held"]).select(
        "product", F.lit(None).cast("double").alias("expected_qty"), F.expr(_COUNT).cast("double").alias("ending_qty")
    )
    return fifo.stage_batch(products, grid, fresh, opening, "FY2026-P01")


@query(
    "receipt_run_layers",
    f"""WITH {SQL_RUNS} SELECT product, CAST(run AS BIGINT) AS seq, sum(qty) AS qty, round(sum(total), 2) AS total_value, CAST(min(delivered) AS VARCHAR) AS first_day,
    CAST(max(delivered) AS VARCHAR) AS last_day, count(*) AS receipt_count FROM runs GROUP BY product, run""",
)
def run_layers(t):
    layers = fifo.consolidate_receipts(_receipts(t), "FY2026-P01")
    return layers.select(
        "product", "seq", "qty", F.round("total_value", 2).alias("total_value"), F.col("start_day").cast("string").alias("first_day"),
        F.col("end_day").cast("string").alias("last_day"), "receipt_count",
    )


@query(
    "receipt_lineage",
    f"""WITH {SQL_RUNS} SELECT product, source_pos, CAST(run AS BIGINT) AS run FROM runs""",
)
def lineage(t):
    return fifo.receipt_runs(_receipts(t)).select("product", "source_pos", "run")


@query(
    "fifo_consumption",
    f"""WITH {SQL_BATCH} SELECT product, kind, seq, qty, consumed, remaining, round(consumed_value, 8) AS consumed_value,
    round(total_value - consumed_value, 8) AS remaining_value FROM consumed""",
)
def consumption(t):
    _, used = _batch(t)
    return used.select(
        "product", "kind", "seq", "qty", "consumed", "remaining", F.round("consumed_value", 8).alias("consumed_value"),
        F.round("remaining_value", 8).alias("remaining_value"),
    )


@query(
    "fifo_roll_forward",
    f"""WITH {SQL_BATCH} SELECT u.product, coalesce(sum(qty) FILTER (WHERE kind = 0), 0) AS beg_qty, round(coalesce(sum(total_value) FILTER (WHERE kind = 0), 0), 2) AS beg_val,
    coalesce(sum(qty) FILTER (WHERE kind = 1), 0) AS purch_qty, round(coalesce(sum(total_value) FILTER (WHERE kind = 1), 0), 2) AS purch_val,
    any_value(u.usage_qty) AS usage_qty, any_value(u.ending_qty) AS end_qty, any_value(u.carried_forward) AS carried_forward,
    CASE WHEN any_value(u.usage_qty) < 0 THEN -any_value(u.usage_qty) ELSE 0 END AS variance_qty
    FROM usage u LEFT JOIN consumed c ON u.product = c.product GROUP BY u.product""",
)
def roll(t):
    results, _ = _batch(t)
    return results.select(
        "product", "beg_qty", F.round("beg_val", 2).alias("beg_val"), "purch_qty", F.round("purch_val", 2).alias("purch_val"),
        "usage_qty", F.col("ending_qty").alias("end_qty"), "carried_forward", "variance_qty",
    )


@query(
    "fifo_on_hand_layers",
    f"""WITH {SQL_BATCH} SELECT product, row_number() OVER (PARTITION BY product ORDER BY kind, seq) AS seq, remaining AS qty,
    round(total_value - consumed_value, 4) AS total_value FROM consumed WHERE remaining > 0.0001""",
)
def hand(t):
    _, used = _batch(t)
    return fifo.on_hand(used).select("product", "seq", "qty", F.round("total_value", 4).alias("total_value"))


@query(
    "fifo_depleted_layers",
    f"""WITH {SQL_BATCH} SELECT product, kind, seq, consumed, CASE WHEN remaining <= 0.0001 THEN 'Fully Depleted' ELSE 'Partially Depleted' END AS status
    FROM consumed WHERE consumed > 0.0001""",
)
def gone(t):
    _, used = _batch(t)
    return fifo.depleted(used).select("product", "kind", "seq", "consumed", "status")


_STATUS = f"""{SQL_BATCH}, fig AS (SELECT u.product, any_value(u.usage_qty) AS usage_qty, any_value(u.ending_qty) AS end_qty,
  coalesce(sum(qty) FILTER (WHERE kind = 0), 0) AS beg_qty, coalesce(sum(qty) FILTER (WHERE kind = 1), 0) AS purch_qty,
  coalesce(sum(remaining) FILTER (WHERE remaining > 0.0001), 0) AS open_qty,
  coalesce(sum(total_value - consumed_value) FILTER (WHERE remaining > 0.0001), 0) AS end_val
  FROM usage u LEFT JOIN consumed c ON u.product = c.product GROUP BY 1),
st AS (SELECT product, CASE WHEN usage_qty < 0 OR abs(open_qty - end_qty) > 0.0001 THEN 'FAIL'
  WHEN purch_qty = 0 AND usage_qty = 0 AND beg_qty = end_qty THEN 'PASS - No Activity' WHEN end_qty = 0 AND round(end_val, 2) <= 0.01 THEN 'PASS - Zero Balance' ELSE 'PASS' END AS overall_status FROM fig)"""


@query("fifo_status", f"WITH {_STATUS} SELECT product, overall_status FROM st")
def status(t):
    return fifo.summary_status(_batch(t)[0]).select("product", "overall_status")


@query(
    "fifo_control_counts",
    f"""WITH {_STATUS} SELECT count(*) FILTER (WHERE overall_status LIKE 'PASS%') AS pass_count, CAST(0 AS BIGINT) AS review_count,
    count(*) FILTER (WHERE overall_status = 'FAIL') AS fail_count FROM st""",
)
def control_counts(t):
    return fifo.control_counts(fifo.summary_status(_batch(t)[0]))


@query("fifo_product_checks")
def checks(t):
    """Eleven checks per product."""
    return fifo.product_checks(_batch(t)[0])


@query("fifo_executive_summary")
def executive(t):
    return fifo.executive_summary(fifo.summary_status(_batch(t)[0]))


@query(
    "fifo_chronology",
    """WITH l AS (SELECT l_partkey AS product, l_orderkey * 8 + l_linenumber AS p, CAST(l_shipdate AS DATE) AS d, l_suppkey FROM lineitem),
    m AS (SELECT product, d, lag(d) OVER (PARTITION BY product ORDER BY l_suppkey, p, d) AS prev FROM l)
    SELECT DISTINCT product FROM m WHERE d < prev""",
)
def chronology(t):
    """Parts whose lines, in supplier and order sequence, go back in time."""
    rows = t.lineitem.select(
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("kind"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16384 + F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))).alias("seq"),
        F.col("l_shipdate").cast("date").alias("start_day"),
    )
    return fifo.chronology_breaks(rows)


_USAGE = """SELECT l_partkey AS product, year(l_shipdate) - 1994 AS period_no, floor(sum(l_quantity) * 0.7) AS usage_qty FROM lineitem GROUP BY 1, 2"""


@query(
    "fifo_period_allocation",
    f"""WITH {SQL_RUNS}, lay AS (SELECT product, CAST(run AS BIGINT) AS seq, sum(qty) AS qty FROM runs GROUP BY product, run),
    i AS (SELECT *, sum(qty) OVER (PARTITION BY product ORDER BY seq) - qty AS lo, sum(qty) OVER (PARTITION BY product ORDER BY seq) AS hi FROM lay),
    u AS ({_USAGE}), o AS (SELECT *, sum(usage_qty) OVER (PARTITION BY product ORDER BY period_no) - usage_qty AS lo2, sum(usage_qty) OVER (PARTITION BY product ORDER BY period_no) AS hi2 FROM u)
    SELECT product, seq, CAST(period_no AS BIGINT) AS period_no, least(hi, hi2) - greatest(lo, lo2) AS qty FROM i JOIN o USING (product) WHERE lo < hi2 AND lo2 < hi AND usage_qty > 0""",
)
def allocation(t):
    layers = fifo.consolidate_receipts(_receipts(t), "P01")
    usage = t.spark.sql(_USAGE).withColumn("usage_qty", F.col("usage_qty").cast("double"))
    out = fifo.allocate_periods(layers, usage)
    return out.select("product", "seq", F.col("period_no").cast("bigint").alias("period_no"), "qty")


@query(
    "inventory_aging",
    f"""WITH {SQL_BATCH}, oh AS (SELECT product, total_value - consumed_value AS v, date_diff('day', start_day, DATE '1999-12-31') AS age FROM consumed WHERE remaining > 0.0001),
    b AS (SELECT product, CASE WHEN age <= 30 THEN 'a' WHEN age <= 60 THEN 'b' WHEN age <= 90 THEN 'c' ELSE 'd' END AS bk, v FROM oh)
    SELECT product, round(coalesce(sum(v) FILTER (WHERE bk = 'a'), 0) + 0.000001, 2) AS d0_30, round(coalesce(sum(v) FILTER (WHERE bk = 'b'), 0) + 0.000001, 2) AS d31_60,
    round(coalesce(sum(v) FILTER (WHERE bk = 'c'), 0) + 0.000001, 2) AS d61_90, round(coalesce(sum(v) FILTER (WHERE bk = 'd'), 0) + 0.000001, 2) AS d90_up,
    round(0.000001, 2) AS unknown, round(sum(v) + 0.000001, 2) AS total FROM b GROUP BY product""",
)
def aging(t):
    _, used = _batch(t)
    table = insights.aging_pivot(fifo.on_hand(used), "1999-12-31").filter("product IS NOT NULL")
    return table.select("product", *[F.round(F.col(c) + 0.000001, 2).alias(c) for c in table.columns if c != "product"])


@query(
    "inventory_aging_shares",
    f"""WITH {SQL_BATCH}, oh AS (SELECT total_value - consumed_value AS v, date_diff('day', start_day, DATE '1999-12-31') AS age FROM consumed WHERE remaining > 0.0001),
    b AS (SELECT CASE WHEN age <= 30 THEN '0-30 days' WHEN age <= 60 THEN '31-60 days' WHEN age <= 90 THEN '61-90 days' ELSE '90+ days' END AS bucket, v FROM oh)
    SELECT bucket, round(sum(v), 1) AS value, round(100 * sum(v) / (SELECT sum(v) FROM b), 3) AS share FROM b GROUP BY bucket""",
)
def shares(t):
    _, used = _batch(t)
    return insights.aging_shares(fifo.on_hand(used), "1999-12-31").select(
        "bucket", F.round("value", 1).alias("value"), F.round("share", 3).alias("share")
    )


_PERIODIC = """SELECT l_partkey AS product, l_returnflag AS category, CAST(month(l_shipdate) AS INT) AS period, l_quantity AS qty, l_extendedprice AS value FROM lineitem"""


@query(
    "period_end_pivot",
    "SELECT category, product, "
    + ", ".join(f"round(sum(value) FILTER (WHERE period = {p}), 2) AS p{p:02d}" for p in range(1, 14))
    + f" FROM ({_PERIODIC}) GROUP BY GROUPING SETS ((category, product), (category), ())",
)
def pivot(t):
    """Value per part and period with category subtotals and a grand total."""
    t.lineitem.createOrReplaceTempView("lineitem")
    table = insights.period_pivot(t.spark.sql(_PERIODIC), "value")
    return table.select("category", "product", *[F.round(c, 2).alias(c) for c in table.columns if c.startswith("p") and c != "product"])


_CLOSED = """SELECT l_returnflag AS product, year(l_shipdate) AS fiscal_year, CAST(month(l_shipdate) AS INT) AS period, CAST(max(l_shipdate) AS DATE) AS as_of,
  sum(l_quantity) AS usage_qty, sum(l_extendedprice) AS usage_val, sum(l_quantity * 2) AS end_qty, sum(l_extendedprice * 2) AS beg_val, sum(l_extendedprice * 3) AS end_val FROM lineitem GROUP BY 1, 2, 3"""


@query(
    "inventory_turnover",
    f"""WITH c AS ({_CLOSED}), w AS (SELECT *, coalesce(date_diff('day', lag(as_of) OVER (PARTITION BY product ORDER BY fiscal_year, period), as_of), 28) AS days FROM c)
    SELECT product, fiscal_year, period, CAST(days AS INT) AS days, round(usage_val / ((beg_val + end_val) / 2), 6) AS turnover,
    round(CASE WHEN usage_qty > 0 AND days > 0 THEN end_qty / (usage_qty / days) END, 6) AS days_of_supply FROM w""",
)
def turnover(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    table = insights.turnover(t.spark.sql(_CLOSED))
    return table.select(
        "product", "fiscal_year", "period", "days", F.round("turnover", 6).alias("turnover"), F.round("days_of_supply", 6).alias("days_of_supply")
    )


_CLOSURES = """SELECT year(o_orderdate) AS fiscal_year, CAST(month(o_orderdate) AS INT) AS period, o_orderpriority AS org, 'closed' AS status,
  sum(o_totalprice) AS ending_value, CAST(count(*) AS DOUBLE) AS ending_qty FROM orders WHERE o_orderkey % 97 <> 0 OR month(o_orderdate) <> 3 GROUP BY 1, 2, 3"""


@query(
    "period_sequence_breaks",
    f"""WITH c AS (SELECT org, fiscal_year * 13 + period AS ordinal FROM ({_CLOSURES})), l AS (SELECT *, lag(ordinal) OVER (PARTITION BY org ORDER BY ordinal) AS previous FROM c)
    SELECT org, CAST(ordinal AS INT) AS ordinal, CAST(previous AS INT) AS previous FROM l WHERE ordinal <> previous + 1""",
)
def sequence(t):
    """Calendar months closed as 13-period years: the missing thirteenth period is the break."""
    t.orders.createOrReplaceTempView("orders")
    return periods.sequence_breaks(t.spark.sql(_CLOSURES), ["org"]).select("org", "ordinal", "previous")


_LAYERS = """SELECT year(l_shipdate) AS fiscal_year, 1 AS period, 'ending' AS layer_kind, l_partkey AS product, l_orderkey * 8 + l_linenumber AS seq, l_quantity AS qty, l_extendedprice AS total_value FROM lineitem
  UNION ALL SELECT year(l_shipdate), 2, 'beginning', l_partkey, l_orderkey * 8 + l_linenumber, CASE WHEN l_suppkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END, l_extendedprice FROM lineitem"""


@query(
    "roll_forward_breaks",
    f"""WITH l AS (SELECT * FROM ({_LAYERS})), e AS (SELECT fiscal_year * 13 + 2 AS ordinal, product, seq, qty, total_value FROM l WHERE layer_kind = 'ending'),
    b AS (SELECT fiscal_year * 13 + 2 AS ordinal, product, seq, qty, total_value FROM l WHERE layer_kind = 'beginning')
    SELECT *, 'ending only' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'beginning only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM e)""",
)
def breaks(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return periods.roll_forward_breaks(t.spark.sql(_LAYERS))


@query(
    "layer_total_breaks",
    f"""WITH l AS (SELECT fiscal_year, sum(qty) AS q, sum(total_value) AS v FROM ({_LAYERS}) WHERE layer_kind = 'ending' GROUP BY 1),
    c AS (SELECT year(l_shipdate) AS fiscal_year, 1 AS period, sum(l_quantity) + CASE WHEN year(l_shipdate) % 2 = 0 THEN 5 ELSE 0 END AS ending_qty, sum(l_extendedprice) AS ending_value FROM lineitem GROUP BY 1)
    SELECT c.fiscal_year, q AS layer_qty, ending_qty FROM c JOIN l USING (fiscal_year) WHERE abs(q - ending_qty) > 0.0001""",
)
def totals(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    closed = t.spark.sql("""SELECT year(l_shipdate) AS fiscal_year, 1 AS period, sum(l_quantity) + CASE WHEN year(l_shipdate) % 2 = 0 THEN 5 ELSE 0 END AS ending_qty,
      sum(l_extendedprice) AS ending_value FROM lineitem GROUP BY year(l_shipdate)""")
    return periods.total_breaks(t.spark.sql(_LAYERS), closed).select("fiscal_year", "layer_qty", "ending_qty")


@query(
    "current_layers",
    f"""WITH l AS (SELECT * FROM ({_LAYERS})) SELECT fiscal_year, product, seq, qty FROM l WHERE layer_kind = 'ending' AND fiscal_year = (SELECT max(fiscal_year) FROM l)""",
)
def current(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    layers = t.spark.sql(_LAYERS)
    closed = layers.filter("layer_kind = 'ending'").select("fiscal_year", "period").distinct().withColumn("status", F.lit("closed"))
    return periods.current_layers(layers, closed).select("fiscal_year", "product", "seq", "qty")


@query(
    "latest_version",
    "SELECT o_custkey AS template_id, max(o_orderkey) AS version FROM orders GROUP BY 1",
)
def latest(t):
    versions = t.orders.select(F.col("o_custkey").alias("template_id"), F.col("o_orderkey").alias("version"))
    return periods.latest_per(versions, ["template_id"], "version")


@query(
    "layer_canonical_form",
    """SELECT l_partkey AS product, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN abs(l_quantity - 25) <= 0.0001 THEN 0 ELSE l_quantity - 25 END AS qty,
    CASE WHEN l_quantity - 25 > 0.0001 THEN round(l_extendedprice / (l_quantity - 25), 6) ELSE 0 END AS unit_cost,
    CASE WHEN l_quantity - 25 < -0.0001 THEN 'FIFO layer quantity cannot be negative.' END AS layer_error FROM lineitem""",
)
def canonical(t):
    rows = t.lineitem.select(
        F.col("l_partkey").alias("product"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_quantity") - 25).alias("qty"), F.col("l_extendedprice").alias("total_value"), F.lit(0.0).alias("unit_cost"),
    )
    return fifo.canonical_layers(rows).select("product", "seq", "qty", F.round("unit_cost", 6).alias("unit_cost"), "layer_error")


@query(
    "portfolio_turnover",
    f"""WITH c AS ({_CLOSED}) SELECT fiscal_year, period, round(sum(usage_val) / ((sum(beg_val) + sum(end_val)) / 2), 6) AS turnover FROM c GROUP BY 1, 2""",
)
def portfolio(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return insights.portfolio_turnover(t.spark.sql(_CLOSED)).select("fiscal_year", "period", F.round("turnover", 6).alias("turnover"))


@query(
    "unit_cost_pivot",
    "SELECT category, product, "
    + ", ".join(f"round(sum(value) FILTER (WHERE period = {p}) / nullif(sum(qty) FILTER (WHERE period = {p}), 0), 8) AS p{p:02d}" for p in range(1, 14))
    + f" FROM ({_PERIODIC}) GROUP BY 1, 2",
)
def unit_costs(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    figures = t.spark.sql(_PERIODIC).select("category", "product", "period", F.col("value").alias("end_val"), F.col("qty").alias("end_qty"))
    table = insights.unit_cost_pivot(figures)
    return table.select("category", "product", *[F.round(c, 8).alias(c) for c in table.columns if c not in ("category", "product")])


@query("fifo_check_rows")
def check_rows(t):
    """Portfolio checks of a costing against the whole receipt log, recognized as it would be: late, rejected, presumed and pending rows included."""
    from .receipts import _recognized

    results, _ = _batch(t)
    return insights.check_rows(fifo.summary_status(results), _recognized(t)[0])


@query("fifo_product_exceptions")
def exceptions(t):
    from ..operators.receipts import product_exceptions

    return product_exceptions(fifo.summary_status(_batch(t)[0]))


@query(
    "sequence_ids",
    "SELECT o_orderkey, 'VAR-' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0') AS variance_id FROM orders",
)
def sequence_ids(t):
    from ..operators.ledger import sequence_ids as number

    return number(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "VAR", "variance_id").select("o_orderkey", "variance_id")
