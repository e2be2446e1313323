"""The full reconciliation and its outcome tables on the derived ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev, ledger
from ..plans.reconciliation import clear_with_history, reconcile
from ..runtime import cut
from . import query
from .ledgers import FISCAL_YEAR, ROLES, SQL_BOTH, SQL_FLAGS, raw_ledgers, sql_tiers
from .matching import both_sides, tier_rows


def run(t):
    a, b = raw_ledgers(t)
    return reconcile(a, b, ROLES, ROLES, FISCAL_YEAR)


@query("reconciliation_totals")
def totals(t):
    return ledger.disposition_totals(run(t).ledger)


@query("reconciliation_ledger")
def book(t):
    return run(t).ledger.drop("key_po")


def _sides(t):
    both = both_sides(t)
    return cut(both.filter("side = 'A'"), "a"), cut(both.filter("side = 'B'"), "b")


_COUNTS = f"""{SQL_BOTH}, a AS (SELECT * FROM both_sides WHERE side = 'A'), b AS (SELECT * FROM both_sides WHERE side = 'B'),
links AS (SELECT a.row_id, b.row_id AS b_id, b.cents AS b_cents FROM a JOIN b ON a.key_po = b.key_po AND a.key_po <> ''
  UNION SELECT a.row_id, b.row_id, b.cents FROM a JOIN b ON a.key_inv = b.key_inv AND a.key_inv <> ''),
cand AS (SELECT a.*, count(b_id) AS candidates, CASE WHEN count(b_id) = 1 THEN max(b_id) END AS only_id,
  CASE WHEN count(b_id) = 1 THEN max(b_cents) END AS only_cents
  FROM a LEFT JOIN links USING (row_id) GROUP BY ALL)"""


@query(
    "candidate_counts",
    f"WITH {_COUNTS} SELECT row_id, candidates, only_id, abs(cents - only_cents) AS difference FROM cand",
)
def counts(t):
    a, b = _sides(t)
    return ev.candidate_counts(a, b, b).select("row_id", "candidates", "only_id", "difference")


_KNOWN_TYPO = "row_id % 97 = 3"


@query(
    "evidence_findings",
    f"""WITH {SQL_FLAGS}, {sql_tiers()}, b AS MATERIALIZED (SELECT f.*, f.row_id NOT IN (SELECT b_id FROM t_pairs) AS open FROM flagged f WHERE side = 'B'),
    a AS MATERIALIZED (SELECT f.*, f.row_id IN (SELECT a_id FROM t_proposals WHERE link = 'CONFLICT') AS refused FROM flagged f WHERE side = 'A' AND f.row_id NOT IN (SELECT a_id FROM t_pairs)),
    links AS (SELECT a.row_id, b.row_id AS b_id, b.cents AS b_cents, b.open FROM a JOIN b ON a.key_po = b.key_po AND a.key_po <> ''
      UNION SELECT a.row_id, b.row_id, b.cents, b.open FROM a JOIN b ON a.key_inv = b.key_inv AND a.key_inv <> ''),
    n AS (SELECT row_id, count(*) AS candidates, count(*) FILTER (WHERE open) AS available, max(b_cents) FILTER (WHERE open) AS open_cents FROM links GROUP BY 1),
    wp AS (SELECT DISTINCT norm_po FROM b WHERE key_po = '' AND norm_po <> ''), wi AS (SELECT DISTINCT norm_inv FROM b WHERE key_inv = '' AND norm_inv <> ''),
    ep AS (SELECT DISTINCT norm_po, cents FROM b WHERE key_po = '' AND open), ei AS (SELECT DISTINCT norm_inv, cents FROM b WHERE key_inv = '' AND open)
    SELECT row_id, CASE WHEN a.cents IS NULL THEN 'EVIDENCE_INVALID_AMOUNT' WHEN refused THEN 'EVIDENCE_CONFLICTING_LINKS' WHEN {_KNOWN_TYPO} THEN 'EVIDENCE_TYPO_CANDIDATES' WHEN available > 1 THEN 'EVIDENCE_MULTIPLE_CANDIDATES'
      WHEN available = 1 AND a.cents = open_cents THEN 'EVIDENCE_EXACT_AMOUNT_NOT_UNIQUE' WHEN available = 1 AND open_cents IS NOT NULL THEN 'EVIDENCE_FOUND_AMOUNT_DIFFERS'
      WHEN available = 1 THEN 'EVIDENCE_INVALID_AMOUNT' WHEN candidates > 0 THEN 'EVIDENCE_ALREADY_CONSUMED'
      WHEN (key_po = '' AND EXISTS (SELECT 1 FROM ep WHERE ep.norm_po = a.norm_po AND ep.cents = a.cents AND a.norm_po <> '')) OR (key_inv = '' AND EXISTS (SELECT 1 FROM ei WHERE ei.norm_inv = a.norm_inv AND ei.cents = a.cents AND a.norm_inv <> ''))
        THEN 'EVIDENCE_INSUFFICIENT_WEAK_REFERENCE_EXACT_AMOUNT'
      WHEN (key_po = '' AND EXISTS (SELECT 1 FROM wp WHERE wp.norm_po = a.norm_po)) OR (key_inv = '' AND EXISTS (SELECT 1 FROM wi WHERE wi.norm_inv = a.norm_inv)) THEN 'EVIDENCE_INSUFFICIENT_WEAK_REFERENCE'
      ELSE 'NO_EVIDENCE' END AS finding FROM a LEFT JOIN n USING (row_id)""",
)
def findings(t):
    """The finding of every A row that the one-to-one tiers leave open, with the pairs they refused and the rows they consumed; rows with a
    known typo are given by their number."""
    from ..operators import matching as m

    both = tier_rows(t, "norm_po", "norm_inv")
    _, refused, still = m.match_one_to_one(both)
    open_a = still.filter("side = 'A'")
    review = open_a.filter(_KNOWN_TYPO).select("row_id", F.lit(2).cast("bigint").alias("typo_candidates"))
    return ev.candidate_table(open_a, both.filter("side = 'B'"), still.filter("side = 'B'"), refused, review).select("row_id", "finding")


@query(
    "candidate_list_first25",
    f"""WITH {SQL_BOTH}, a AS (SELECT * FROM both_sides WHERE side = 'A'), b AS (SELECT * FROM both_sides WHERE side = 'B'),
    l AS (SELECT a.row_id, b.row_id AS b_id, 0 AS strength FROM a JOIN b ON a.key_po = b.key_po AND a.key_po <> ''
      UNION ALL SELECT a.row_id, b.row_id, 0 FROM a JOIN b ON a.key_inv = b.key_inv AND a.key_inv <> ''
      UNION ALL SELECT a.row_id, b.row_id, 1 FROM a JOIN b ON a.norm_po = b.norm_po AND a.norm_po <> '' AND a.key_po = '' AND b.key_po = ''
      UNION ALL SELECT a.row_id, b.row_id, 1 FROM a JOIN b ON a.norm_inv = b.norm_inv AND a.norm_inv <> '' AND a.key_inv = '' AND b.key_inv = ''),
    g AS (SELECT row_id, b_id, min(strength) AS strength FROM l GROUP BY 1, 2)
    SELECT row_id, b_id, strength FROM g QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY strength, b_id) <= 25""",
)
def listing(t):
    a, b = _sides(t)
    return ev.candidate_list(a, b).select("row_id", "b_id", "strength")


def _unique(keys: str) -> str:
    cond = " AND ".join(f"{k} <> ''" for k in keys.split(", "))
    gone = "NOT EXISTS (SELECT 1 FROM {0} WHERE {0}.a_id = w.row_id AND w.side = 'A') AND NOT EXISTS (SELECT 1 FROM {0} WHERE {0}.b_id = w.row_id AND w.side = 'B')"
    return cond, gone


def _variance_sql() -> str:
    out, before = [], []
    for n, (tier, keys) in enumerate(
        (("PO_AND_INVOICE", "key_po, key_inv"), ("INVOICE_ONLY", "key_inv"), ("PO_ONLY", "key_po")), 1
    ):
        cond, gone = _unique(keys)
        rest = " AND ".join([cond, "cents IS NOT NULL"] + [gone.format(x) for x in before])
        out.append(f"""v{n} AS MATERIALIZED (WITH w2 AS (SELECT * FROM both_sides w WHERE {rest}),
          ua AS (SELECT {keys}, max(row_id) a_id, max(cents) a_cents FROM w2 WHERE side = 'A' GROUP BY ALL HAVING count(*) = 1),
          ub AS (SELECT {keys}, max(row_id) b_id, max(cents) b_cents FROM w2 WHERE side = 'B' GROUP BY ALL HAVING count(*) = 1)
          SELECT a_id, b_id, a_cents, b_cents, '{tier}' AS evidence FROM ua JOIN ub USING ({keys}) WHERE a_cents <> b_cents)""")
        before.append(f"v{n}")
    return ", ".join(out)


@query(
    "amount_variances",
    f"""WITH {SQL_BOTH}, {_variance_sql()} SELECT *, a_cents - b_cents AS difference,
      a_cents = -b_cents AND a_cents <> 0 AS sign_reversal,
      CASE WHEN a_cents = -b_cents AND a_cents <> 0 THEN 'Critical possible sign reversal'
        WHEN evidence = 'PO_AND_INVOICE' THEN 'High-likelihood amount variance'
        WHEN evidence = 'INVOICE_ONLY' THEN 'Strong invoice-linked amount variance' ELSE 'PO-linked amount variance' END AS classification
    FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3)""",
)
def variances(t):
    return ev.amount_variances(*_sides(t))


@query(
    "ambiguous_candidates",
    f"WITH {_COUNTS} SELECT row_id, candidates FROM cand WHERE candidates >= 2",
)
def ambiguous(t):
    return ev.ambiguous_candidates(*_sides(t)).select("row_id", "candidates")


@query(
    "po_reuse_groups",
    f"""WITH {SQL_BOTH}, a AS (SELECT key_po, count(*) AS a_rows, CAST(sum(cents) AS BIGINT) AS a_total FROM both_sides WHERE side = 'A' AND key_po <> ''
      GROUP BY 1 HAVING count(*) >= 2 AND count(*) = count(cents)),
    b AS (SELECT key_po, count(*) AS b_rows, CAST(sum(cents) AS BIGINT) AS b_total FROM both_sides WHERE side = 'B' AND key_po <> '' AND cents IS NOT NULL GROUP BY 1)
    SELECT key_po, a_rows, a_total, coalesce(b_rows, 0) AS b_rows, coalesce(b_total, 0) AS b_total,
      a_total - coalesce(b_total, 0) AS difference FROM a LEFT JOIN b USING (key_po) WHERE a_total <> coalesce(b_total, 0)""",
)
def reuse(t):
    return ev.po_reuse(*_sides(t))


@query(
    "historical_evidence_hits",
    f"""WITH {SQL_BOTH}, a AS (SELECT * FROM both_sides WHERE side = 'A'), b AS (SELECT * FROM both_sides WHERE side = 'B')
    SELECT DISTINCT a.row_id FROM a JOIN b ON a.cents = b.cents AND ((a.norm_po = b.norm_po AND a.norm_po <> '')
      OR (a.norm_inv = b.norm_inv AND a.norm_inv <> ''))""",
)
def hits(t):
    return ev.historical_hits(*_sides(t)).select("row_id")


@query(
    "heavy_reference_reuse",
    f"""WITH {SQL_BOTH} SELECT side, key_po AS value, count(*) AS rows, 'PO' AS kind FROM both_sides WHERE key_po <> '' GROUP BY 1, 2 HAVING count(*) >= 6
    UNION ALL SELECT side, customer, count(*), 'Invoice' FROM both_sides WHERE customer <> '' GROUP BY 1, 2 HAVING count(*) >= 6""",
)
def heavy(t):
    """Heavily reused references; the customer stands in for the invoice so that reuse occurs in the given data."""
    return ev.heavy_reuse(both_sides(t).withColumn("key_inv", F.col("customer")))


@query("historical_clearance")
def clearance(t):
    """Open rows of an early-year ledger cleared against a later-year ledger, both directions."""
    a, b = _sides(t)
    found, _, _ = clear_with_history(a, b, None, b.withColumn("txn_date", F.add_months("txn_date", -1)))
    return found
