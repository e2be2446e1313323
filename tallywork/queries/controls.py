"""Proofs over a finished reconciliation, and set checks on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as c, reports as r
from ..plans.reconciliation import explained_rows, match_assessments, metric_facts, sectioned_rows
from . import query
from .evidence import run


@query("balance_controls")
def controls(t):
    """Every control of a full reconciliation."""
    return c.balance_controls(run(t))


@query("report_identities")
def identities(t):
    """Every identity between the reports and the ledger of a full reconciliation."""
    return c.identity_controls(run(t))


@query("run_metrics")
def metrics(t):
    """Every measure of a full reconciliation, with its controls."""
    done = run(t)
    return r.run_metrics(metric_facts(done, c.balance_controls(done)))


@query("outcome_sections")
def sections(t):
    return r.outcome_sections(run(t).ledger)


@query("fuzzy_hold_report")
def fuzzy(t):
    done = run(t)
    return r.fuzzy_report(done.tables["fuzzy"], done.a.unionByName(done.b)).select("match_key", "classification", "a_rows", "b_rows", "a_cents", "b_cents", "shared_words")


@query(
    "consumed_twice",
    "SELECT 'B' AS side, l_orderkey AS row_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_suppkey) > 1",
)
def twice(t):
    """Orders served by several suppliers, as records claimed by several matches."""
    return c.consumed_twice(t.lineitem.select(F.lit("B").alias("side"), F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("match_key")))


@query(
    "illegal_matches",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS b, CAST(sum(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS b_cents FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS a_cents FROM orders)
    SELECT coalesce(o.k, l.k) AS match_key, CASE WHEN o.k IS NULL THEN 0 ELSE 1 END AS a, coalesce(b, 0) AS b FROM o FULL JOIN l USING (k)
    WHERE o.k IS NULL OR l.k IS NULL OR b > 8 OR a_cents <> b_cents""",
)
def illegal(t):
    """Each order against its lines as one match: which do not tie or have too many rows."""
    orders = t.orders.select(F.lit("A").alias("side"), F.col("o_orderkey").alias("match_key"), F.col("o_orderkey").alias("row_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    lines = t.lineitem.select(
        F.lit("B").alias("side"), F.col("l_orderkey").alias("match_key"),
        F.expr("((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey % 32768) * 4096 + (year(l_shipdate) * 366 + dayofyear(l_shipdate)) % 4096").alias("row_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    both = orders.unionByName(lines)
    return c.illegal_matches(both.select("side", "match_key", "row_id"), both.select("side", "row_id", "cents")).select("match_key", F.col("a").cast("int").alias("a"), "b")


@query(
    "population_cover",
    "SELECT coalesce(o_orderkey, k) AS row_id, n FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON k = o_orderkey WHERE n IS NULL OR n <> 1",
)
def cover(t):
    """Orders that first lines cover not at all or several times."""
    lines = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("row_id"))
    return c.multiple_populations(lines, t.orders.select(F.col("o_orderkey").alias("row_id")))


@query(
    "report_identity",
    "SELECT row_id FROM (SELECT o_orderkey AS row_id FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT row_id FROM (SELECT l_orderkey AS row_id FROM lineitem WHERE l_linenumber = 2 EXCEPT ALL SELECT o_orderkey FROM orders)",
)
def identity(t):
    return c.same_ids(t.orders.select(F.col("o_orderkey").alias("row_id")), t.lineitem.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("row_id")))


@query("tampered_records", "SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0")
def tampered(t):
    """Every order sealed with a digest, then one in fifty changed."""
    fields = ["o_orderkey", "o_custkey", "o_orderstatus"]
    sealed = t.orders.select(*fields).withColumn("digest", c.record_digest(fields))
    changed = sealed.withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return c.tampered(changed, fields).select("o_orderkey")


@query(
    "stacked_reports",
    "SELECT kind, count(*) AS n_rows, count(region) AS with_region FROM (SELECT 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT 'region', NULL FROM region) GROUP BY 1",
)
def stacked(t):
    left = t.nation.select(F.lit("nation").alias("kind"), F.col("n_regionkey").alias("region"))
    return r.stack([left, t.region.select(F.lit("region").alias("kind"))]).groupBy("kind").agg(F.count("*").alias("n_rows"), F.count("region").alias("with_region"))


@query("paired_row_sections")
def paired_sections(t):
    """The paired-rows table of a full reconciliation: every row of both ledgers once."""
    return sectioned_rows(run(t))


@query("run_assessments")
def assessed_run(t):
    """The assessment of every match and every open or held row of a full reconciliation."""
    return match_assessments(run(t))


@query("explained_rows")
def explained(t):
    """The paired rows of a full reconciliation with the cause of every exception."""
    return explained_rows(run(t))


# Orders as facts: each status an outcome, lines as the other ledger, so that each population and side occurs.
_FACTS = """SELECT 'source' AS population, 'A' AS side, CAST(1 AS BIGINT) AS n, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS cents FROM orders
UNION ALL SELECT 'source', 'B', CAST(1 AS BIGINT), CAST(ROUND(l_extendedprice * 100) AS BIGINT) FROM lineitem
UNION ALL SELECT CASE o_orderkey % 7 WHEN 0 THEN 'matched' WHEN 1 THEN 'cleared' WHEN 2 THEN 'unmatched' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'variance' WHEN 5 THEN 'ambiguous' ELSE 'reference_hold' END, 'A', CAST(1 AS BIGINT), CAST(ROUND(o_totalprice * 100) AS BIGINT) FROM orders
UNION ALL SELECT CASE l_partkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'duplicate_hold' ELSE 'unmatched' END, 'B', CAST(1 AS BIGINT), 0 - CAST(ROUND(l_extendedprice * 100) AS BIGINT) FROM lineitem
UNION ALL SELECT CASE o_orderstatus WHEN 'O' THEN 'disposition TRUE_UNMATCHED' WHEN 'F' THEN 'disposition REVIEW_HOLD' ELSE 'disposition MATCHED' END, 'A', CAST(1 AS BIGINT), CAST(ROUND(o_totalprice * 100) AS BIGINT) FROM orders
UNION ALL SELECT 'po reuse', 'A', count(*), CAST(sum(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders GROUP BY o_custkey
UNION ALL SELECT 'history', 'B', CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM customer UNION ALL SELECT 'history used', 'B', CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM customer WHERE c_custkey % 3 = 0"""


def _sql_metrics() -> str:
    """The measures as plain filtered sums, one by one."""
    def where(population, side):
        names = (population,) if isinstance(population, str) else population
        return f"population IN ({', '.join(repr(x) for x in names)})" + (f" AND side = '{side}'" if side else "")

    what_sql = {"n": "sum(n)", "cents": "sum(cents)", "gross": "sum(abs(cents))", "facts": "count(*)", "unreadable": "sum(CASE WHEN cents IS NULL THEN n END)"}
    sums = ", ".join(f"CAST(coalesce({what_sql[what]} FILTER (WHERE {where(p, s)}), 0) AS BIGINT) AS {name}" for name, p, s, what in r.MEASURES)
    blocked = [f"CASE WHEN {m} > 0 THEN '{reason}' END" for m, reason in r.BLOCKERS] + [f"CASE WHEN {' + '.join(r.EXCLUSIONS)} > 0 THEN '{r.GRAIN_BLOCKER}' END"]
    return f"""WITH f AS ({_FACTS}), m AS (SELECT {sums} FROM f), b AS (SELECT *, concat_ws('; ', {', '.join(blocked)}) AS why FROM m)
    SELECT * EXCLUDE (why, matched_only_a_cents, matched_only_b_cents), a_total - b_total AS source_difference, matched_only_a_cents - matched_only_b_cents AS matched_difference,
    history_a_rows - history_a_used AS history_a_ignored, history_b_rows - history_b_used AS history_b_ignored, disposition_true_unmatched_cents AS proposed_entry_cents,
    round(matched_a_rows / a_rows, 9) AS a_match_rate, round(matched_a_gross / a_gross, 9) AS a_match_rate_by_gross, round(matched_b_rows / b_rows, 9) AS b_match_rate,
    CASE WHEN why = '' THEN 'None' ELSE why END AS posting_blockers, CASE WHEN why = '' THEN 'READY TO POST' ELSE 'REVIEW REQUIRED' END AS posting_status,
    CASE WHEN why = '' THEN 'AUTHORIZED BY AUTOMATED CONTROLS' ELSE 'DO NOT POST' END AS posting_authorization, CASE WHEN failed_controls = 0 THEN 'PASS' ELSE 'FAIL' END AS control_status FROM b"""


@query("run_metrics_of_orders", _sql_metrics())
def metrics_of_orders(t):
    """The measures over orders and lines as two ledgers."""
    for name in ("orders", "lineitem", "customer"):
        getattr(t, name).createOrReplaceTempView(name)
    rates = ("a_match_rate", "a_match_rate_by_gross", "b_match_rate")
    return r.run_metrics(t.spark.sql(_FACTS)).withColumns({x: F.round(x, 9) for x in rates})
