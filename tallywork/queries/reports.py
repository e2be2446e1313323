"""Summary reports over the derived ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, matching as m, reports as r
from ..runtime import cut
from . import query
from .ledgers import A_SQL, SQL_BOTH, SQL_FLAGS, sql_tiers
from .matching import both_sides, tier_rows

_SRC = f"{SQL_BOTH}, a AS (SELECT w.*, s.quantity, s.period, 'P' || lpad(s.period, 2, '0') || '-2026' AS fiscal_label FROM both_sides w JOIN ({A_SQL}) s ON s.source_pos = w.row_id WHERE side = 'A'), b AS (SELECT * FROM both_sides WHERE side = 'B')"


def _a(t):
    return both_sides(t).filter("side = 'A'")


def _labelled(t):
    """Ledger A with a product label per line: a pack size by priority, or a review label."""
    return _a(t).withColumn(
        "label",
        F.when(F.col("product").startswith("1"), "Urgent 24 Case").when(F.col("product").startswith("2"), "High 40 Case").when(F.col("product").startswith("3"), "Unrecognized product").otherwise("Other"),
    )


_LABEL = "CASE WHEN o_orderpriority LIKE '1%' THEN 'Urgent 24 Case' WHEN o_orderpriority LIKE '2%' THEN 'High 40 Case' WHEN o_orderpriority LIKE '3%' THEN 'Unrecognized product' ELSE 'Other' END"
_LAB = f"{_SRC}, lab AS (SELECT a.*, {_LABEL.replace('o_orderpriority', 'product')} AS label, CASE WHEN product LIKE '1%' THEN 24 WHEN product LIKE '2%' THEN 40 END AS size FROM a JOIN (SELECT source_pos, product FROM ({A_SQL})) p ON p.source_pos = a.row_id)"


@query(
    "ledger_totals",
    f"WITH {SQL_BOTH} SELECT side, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS signed_cents, CAST(sum(abs(cents)) AS BIGINT) AS gross_cents FROM both_sides GROUP BY 1",
)
def totals(t):
    return r.totals(both_sides(t))


@query(
    "method_summary",
    f"""WITH {SQL_FLAGS}, {sql_tiers()} SELECT method, count(*) AS a_rows, count(*) AS b_rows, CAST(sum(a.cents) AS BIGINT) AS a_cents, CAST(sum(b.cents) AS BIGINT) AS b_cents,
    CAST(sum(a.cents) - sum(b.cents) AS BIGINT) AS difference, round(sum(a.cents) / (SELECT sum(cents) FROM flagged WHERE side = 'A'), 9) AS share FROM t_pairs
    JOIN flagged a ON a.side = 'A' AND a.row_id = a_id JOIN flagged b ON b.side = 'B' AND b.row_id = b_id GROUP BY 1""",
)
def methods(t):
    both = tier_rows(t)
    bridge, _, _ = m.match_one_to_one(both)
    return r.method_summary(bridge, both).withColumn("share", F.round("share", 9))


@query(
    "match_register_refs",
    f"""WITH {SQL_FLAGS}, {sql_tiers()}, n AS (SELECT a_id, row_number() OVER (ORDER BY a_id, b_id) AS k, count(*) OVER () AS c FROM t_pairs)
    SELECT a_id AS match_key, 'M-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(c AS VARCHAR))) AS INT), '0') AS match_ref FROM n""",
)
def register(t):
    both = tier_rows(t)
    bridge, _, _ = m.match_one_to_one(both)
    return ledger.match_register(bridge, both).select("match_key", "match_ref")


@query(
    "paired_rows",
    f"""WITH {SQL_FLAGS}, {sql_tiers()} SELECT t_pairs.a_id AS match_key, CAST(1 AS INT) AS seq, a_id, b_id, a.cents AS a_cents, b.cents AS b_cents FROM t_pairs
    JOIN flagged a ON a.side = 'A' AND a.row_id = a_id JOIN flagged b ON b.side = 'B' AND b.row_id = b_id""",
)
def paired(t):
    both = tier_rows(t)
    bridge, _, _ = m.match_one_to_one(both)
    return ledger.paired(bridge, both).select("match_key", "seq", "a_id", "b_id", "a_cents", "b_cents")


@query(
    "product_summary",
    f"WITH {_LAB} SELECT label, CAST(any_value(size) AS INT) AS bottles_per_case, sum(CAST(quantity AS DOUBLE)) AS cases, any_value(size) * sum(CAST(quantity AS DOUBLE)) AS bottles, CAST(sum(cents) AS BIGINT) AS cents FROM lab GROUP BY 1",
)
def products(t):
    return r.product_summary(_labelled(t))


@query("product_review_lines", f"WITH {_LAB} SELECT row_id, CAST(quantity AS DOUBLE) AS cases, cents FROM lab WHERE label = 'Unrecognized product'")
def review(t):
    return r.product_review(_labelled(t)).select("row_id", "cases", "cents")


@query(
    "customer_summary",
    f"WITH {_LAB} SELECT upper(customer) AS customer, sum(CAST(quantity AS DOUBLE)) AS cases, sum(size * CAST(quantity AS DOUBLE)) AS bottles, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, coalesce(sum(CAST(quantity AS DOUBLE)) FILTER (WHERE size IS NULL), 0) AS cases_without_bottles FROM lab GROUP BY 1",
)
def customers(t):
    return r.customer_summary(_labelled(t))


@query(
    "exception_analysis",
    f"WITH {_SRC} SELECT fiscal_label AS dimension, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents, 'by period' AS analysis FROM a GROUP BY 1 UNION ALL SELECT side, count(*), CAST(sum(cents) AS BIGINT), 'other side' FROM b GROUP BY 1",
)
def analysis(t):
    both = both_sides(t)
    return r.exception_analysis({"by period": (both.filter("side = 'A'"), "fiscal_label"), "other side": (both.filter("side = 'B'"), "side")})


@query(
    "fiscal_exceptions",
    f"""WITH {_SRC} SELECT fiscal_label, CASE WHEN 6 - CAST(period AS INT) = 0 THEN 'Current Period' WHEN CAST(period AS INT) > 6 THEN 'Future Period - Review' WHEN 6 - CAST(period AS INT) <= 2 THEN 'Prior Period' ELSE 'Urgent Prior Period' END AS kind,
    count(*) AS n_rows, sum(CAST(quantity AS DOUBLE)) AS quantity, CAST(sum(cents) AS BIGINT) AS cents FROM a GROUP BY 1, 2""",
)
def fiscal(t):
    return r.fiscal_exceptions(_a(t), 6, 2026)


@query(
    "open_item_ages",
    f"""WITH {_SRC}, x AS (SELECT CASE WHEN CAST(period AS INT) > 6 THEN 'After the selected period' WHEN CAST(period AS INT) = 6 THEN 'Current period' WHEN CAST(period AS INT) = 5 THEN '1 period old' WHEN CAST(period AS INT) = 4 THEN '2 periods old' ELSE '3 or more periods old' END AS item, cents FROM a)
    SELECT item, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents, round(sum(abs(cents)) / (SELECT sum(abs(cents)) FROM x), 9) AS share FROM x GROUP BY 1""",
)
def ages(t):
    return r.age_buckets(_a(t), 6, 2026).withColumn("share", F.round("share", 9))


@query(
    "open_item_same_amount",
    f"""WITH {_SRC} SELECT 'A' AS side, cents IN (SELECT cents FROM b WHERE cents <> 0) AS same_amount, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents FROM a WHERE cents <> 0 GROUP BY 2
    UNION ALL SELECT 'B', cents IN (SELECT cents FROM a WHERE cents <> 0), count(*), CAST(sum(cents) AS BIGINT) FROM b WHERE cents <> 0 GROUP BY 2""",
)
def same(t):
    both = both_sides(t)
    return r.same_amount(both.filter("side = 'A'"), both.filter("side = 'B'"))


@query(
    "open_item_concentration",
    f"""WITH {_SRC}, c AS (SELECT customer AS item, count(*) AS n, sum(cents) AS c, coalesce(sum(abs(cents)), 0) AS g FROM a GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY g DESC, item) AS r FROM c)
    SELECT CASE WHEN r <= 10 THEN item ELSE 'All other (' || (SELECT count(*) FROM k WHERE r > 10) || ')' END AS item, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(c) AS BIGINT) AS cents, round(sum(g) / (SELECT sum(g) FROM k), 9) AS share FROM k GROUP BY 1""",
)
def concentration(t):
    return r.top_with_rest(_a(t), "customer").withColumn("share", F.round("share", 9))


@query(
    "repeated_invoice_cause",
    f"""WITH {_SRC}, g AS (SELECT key_inv, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents FROM a WHERE key_inv <> '' AND cents IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key_inv = g.key_inv AND b.cents = g.cents)""",
)
def repeated(t):
    both = both_sides(t)
    return r.repeated_invoice_cause(both.filter("side = 'A'"), both.filter("side = 'B'"))


@query(
    "amount_quality",
    f"""WITH x AS (SELECT amount_text AS t FROM ({A_SQL})) SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(t) = '') AS blank, count(*) FILTER (WHERE t = 'n/a') AS unreadable, count(*) FILTER (WHERE t = '$0.00') AS zero,
    count(*) FILTER (WHERE t LIKE '(%') AS negative, CAST(0 AS BIGINT) AS negative_cents FROM x""",
)
def quality(t):
    from .ledgers import raw_ledgers

    return r.amount_quality(raw_ledgers(t)[0], "amount_text")


@query(
    "period_mismatch",
    f"""WITH {_SRC}, c AS (SELECT CAST(period AS INT) AS p, count(*) AS n FROM a GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS readable, CAST(sum(n) FILTER (WHERE p = 6) AS BIGINT) AS selected,
    CAST((SELECT p FROM c ORDER BY n DESC, p LIMIT 1) AS INT) AS common_period, max(n) AS common_rows FROM c""",
)
def mismatch(t):
    return r.period_mismatch(_a(t), 6)


@query(
    "order_rank_within_customer",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
)
def ranks(t):
    return r.ranked_within(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


_BOOK = """SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'O' THEN 'TRUE_UNMATCHED' WHEN 'F' THEN 'REVIEW_HOLD' ELSE 'MATCHED' END AS disposition, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders"""
_DEC = """SELECT o_orderkey AS row_id, CASE o_orderkey % 5 WHEN 0 THEN 'RELEASE_TO_JE' WHEN 1 THEN 'EXCLUDE' WHEN 2 THEN 'CONFIRM_MATCH' WHEN 3 THEN 'CARRY_FORWARD' ELSE 'EXCLUDE' END AS action,
  CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS decided_on, CASE WHEN o_orderkey % 55 = 0 THEN ' ' ELSE 'why' END AS reason, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'doc' END AS support,
  o_orderkey AS b_id, o_orderkey % 15 <> 7 AS has_b FROM orders WHERE o_custkey % 3 = 0"""


def _decisions(t):
    t.orders.createOrReplaceTempView("orders")
    d = t.spark.sql(_DEC).withColumn("b_ids", F.when(F.col("has_b"), F.array("b_id")).otherwise(F.array().cast("array<bigint>"))).drop("b_id", "has_b")
    book = t.spark.sql(_BOOK)
    return d, book, book.select("row_id", (F.col("cents") - F.when(F.col("row_id") % 2 == 0, 100).otherwise(0)).alias("cents"))


@query(
    "review_decision_problems",
    f"""WITH d AS (SELECT x.*, disposition FROM ({_DEC}) x JOIN ({_BOOK}) b USING (row_id)) SELECT row_id, 'a valid decision date is required' AS problem FROM d WHERE decided_on IS NULL
    UNION ALL SELECT row_id, 'a reason is required' FROM d WHERE trim(reason) = '' UNION ALL SELECT row_id, 'applies only to review holds' FROM d WHERE action IN ('RELEASE_TO_JE','CONFIRM_MATCH','CARRY_FORWARD') AND disposition <> 'REVIEW_HOLD'
    UNION ALL SELECT row_id, 'applies only to open or held rows' FROM d WHERE action = 'EXCLUDE' AND disposition = 'MATCHED' UNION ALL SELECT row_id, 'a supporting reference is required' FROM d WHERE action = 'EXCLUDE' AND support = ''
    UNION ALL SELECT row_id, 'must name the rows it matches' FROM d WHERE action = 'CONFIRM_MATCH' AND NOT has_b UNION ALL SELECT row_id, 'names a row that is already consumed' FROM d WHERE action = 'CONFIRM_MATCH' AND has_b AND row_id % 12 = 0""",
)
def problems(t):
    d, book, b = _decisions(t)
    return r.decision_problems(d, book, b, b.filter("row_id % 12 = 0"))


@query(
    "adjustment_bridge",
    f"""WITH b AS ({_BOOK}), d AS (SELECT x.*, disposition, cents, cents - CASE WHEN has_b THEN cents - CASE WHEN row_id % 2 = 0 THEN 100 ELSE 0 END ELSE 0 END AS gap FROM ({_DEC}) x JOIN b USING (row_id)),
    s AS (SELECT (SELECT count(*) FROM b WHERE disposition = 'TRUE_UNMATCHED') AS en, (SELECT sum(cents) FROM b WHERE disposition = 'TRUE_UNMATCHED') AS e, count(*) FILTER (WHERE action = 'RELEASE_TO_JE') AS rn, coalesce(sum(cents) FILTER (WHERE action = 'RELEASE_TO_JE'), 0) AS r,
      count(*) FILTER (WHERE action = 'EXCLUDE') AS xn, -coalesce(sum(cents) FILTER (WHERE action = 'EXCLUDE' AND disposition = 'TRUE_UNMATCHED'), 0) AS x, count(*) FILTER (WHERE action = 'CONFIRM_MATCH') AS cn, coalesce(sum(cents) FILTER (WHERE action = 'CONFIRM_MATCH'), 0) AS c,
      count(*) FILTER (WHERE action = 'CONFIRM_MATCH' AND gap <> 0) AS gn, coalesce(sum(gap) FILTER (WHERE action = 'CONFIRM_MATCH'), 0) AS g, count(*) FILTER (WHERE action = 'CARRY_FORWARD') AS fn, coalesce(sum(cents) FILTER (WHERE action = 'CARRY_FORWARD'), 0) AS f FROM d),
    u AS (SELECT count(*) AS un, coalesce(sum(cents), 0) AS u FROM b WHERE disposition = 'REVIEW_HOLD' AND row_id NOT IN (SELECT row_id FROM d))
    SELECT 'Engine proposed entry' AS line, en AS n_rows, CAST(e AS BIGINT) AS cents FROM s UNION ALL SELECT 'Plus: review holds released', rn, CAST(r AS BIGINT) FROM s UNION ALL SELECT 'Less: excluded with documentation', xn, CAST(x AS BIGINT) FROM s
    UNION ALL SELECT 'Adjusted entry', NULL, CAST(e + r + x AS BIGINT) FROM s UNION ALL SELECT 'Memo: holds confirmed as matched', cn, CAST(c AS BIGINT) FROM s UNION ALL SELECT 'Memo: confirmed with a difference', gn, CAST(g AS BIGINT) FROM s
    UNION ALL SELECT 'Open: holds undecided or carried forward', un + fn, CAST(u + f AS BIGINT) FROM s, u""",
)
def bridge(t):
    return r.adjustment_bridge(*_decisions(t))


def _sql_assessments() -> str:
    """Pairs of the one-to-one tiers, variances among what is left, then ambiguity, then open rows: each with its criteria as plain CASEs."""
    from ..operators import assessments as s
    from .evidence import _variance_sql

    texts = {rule[0]: (rule[5], rule[6].replace("'", "''")) for rule in s.RULES}

    def case(column: str, place: int) -> str:
        return "CASE rule " + " ".join(f"WHEN '{name}' THEN '{v[place]}'" for name, v in texts.items()) + f" END AS {column}"

    confidence = "CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in s.METHOD_CONFIDENCE.items()) + " ELSE 'Review' END"
    variances = _variance_sql().replace("FROM both_sides", "FROM still")
    agree = "CASE WHEN {0} THEN 'Agree' ELSE 'Not used / differs' END"
    searched = "CASE WHEN coalesce({0}, '') = '' THEN 'Missing' ELSE 'Candidate search performed' END"
    po, inv = "a.norm_po <> '' AND a.norm_po = b.norm_po", "a.norm_inv <> '' AND a.norm_inv = b.norm_inv"
    return f"""WITH {SQL_FLAGS}, {sql_tiers()},
    still AS MATERIALIZED (SELECT w.* FROM flagged w WHERE NOT EXISTS (SELECT 1 FROM t_pairs p WHERE (w.side = 'A' AND p.a_id = w.row_id) OR (w.side = 'B' AND p.b_id = w.row_id))),
    {variances}, vary AS MATERIALIZED (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3),
    la AS MATERIALIZED (SELECT * FROM still WHERE side = 'A' AND row_id NOT IN (SELECT a_id FROM vary)), lb AS MATERIALIZED (SELECT * FROM still WHERE side = 'B' AND row_id NOT IN (SELECT b_id FROM vary)),
    links AS (SELECT la.row_id, lb.row_id AS b_id FROM la JOIN lb ON la.key_po = lb.key_po AND la.key_po <> '' UNION SELECT la.row_id, lb.row_id FROM la JOIN lb ON la.key_inv = lb.key_inv AND la.key_inv <> ''),
    amb AS MATERIALIZED (SELECT row_id, count(*) AS n FROM links GROUP BY 1 HAVING count(*) >= 2),
    x AS (
      SELECT 'match' AS kind, p.a_id AS subject, method, {confidence} AS confidence, 1 AS a_rows, 1 AS b_rows, [p.a_id] AS a_ids, [p.b_id] AS b_ids, a.cents AS a_cents, b.cents AS b_cents, a.cents - b.cents AS difference,
        {agree.format(po)} AS po_criterion, {agree.format(inv)} AS invoice_criterion, CASE WHEN {po} AND {inv} THEN 'M1' WHEN {po} THEN 'M2' WHEN {inv} THEN 'M3' ELSE 'M4' END AS rule
      FROM t_pairs p JOIN flagged a ON a.side = 'A' AND a.row_id = p.a_id JOIN flagged b ON b.side = 'B' AND b.row_id = p.b_id
      UNION ALL SELECT 'variance', a_id, evidence, 'Review', 1, 1, [a_id], [b_id], a_cents, b_cents, a_cents - b_cents, {agree.format("evidence <> 'INVOICE_ONLY'")}, {agree.format("evidence <> 'PO_ONLY'")},
        CASE evidence WHEN 'PO_AND_INVOICE' THEN 'V1' WHEN 'INVOICE_ONLY' THEN 'V2' ELSE 'V3' END FROM vary
      UNION ALL SELECT 'ambiguous', row_id, 'Multiple candidates', 'Review', 1, n, [row_id], [], cents, NULL, NULL, {agree.format("norm_po <> ''")}, {agree.format("norm_inv <> ''")}, 'A1' FROM la JOIN amb USING (row_id)
      UNION ALL SELECT 'open', row_id, 'NO_EVIDENCE', 'Review', 1, 0, [row_id], [], cents, NULL, NULL, {searched.format('norm_po')}, {searched.format('norm_inv')},
        CASE WHEN cents IS NULL THEN 'U1' WHEN norm_po = '' AND norm_inv = '' THEN 'U2' ELSE 'U3' END FROM la ANTI JOIN amb USING (row_id))
    SELECT *, false AS grouped, CASE kind WHEN 'match' THEN 'Matched' WHEN 'variance' THEN '{s.DECISIONS["variance"]}' WHEN 'ambiguous' THEN '{s.DECISIONS["ambiguous"]}' ELSE 'Unresolved' END AS decision,
    {case('amount_criterion', 0)}, {case('explanation', 1)} FROM x"""


@query("match_assessments", _sql_assessments())
def assessed(t):
    """Assessments over the one-to-one tiers: pairs, then variances, ambiguity and open rows among what they leave."""
    from ..operators import assessments as s, evidence as ev

    both = tier_rows(t, "norm_po", "norm_inv")
    bridge, _, _ = m.match_one_to_one(both.select(*m.TIER_COLUMNS))
    # No step here reads link flags or source spellings.
    left = both.drop("exact_po", "exact_inv").join(bridge.select("side", "row_id"), ["side", "row_id"], "left_anti")
    still = cut(left, "still", compression="zstd")
    a, b = still.filter("side = 'A'"), still.filter("side = 'B'")
    varied = cut(ev.amount_variances(a, b), "variances")
    a = cut(a.join(varied.select(F.col("a_id").alias("row_id")), "row_id", "left_anti"), "left-a")
    b = b.join(varied.select(F.col("b_id").alias("row_id")), "row_id", "left_anti")
    several = cut(ev.ambiguous_candidates(a, b), "ambiguous")
    open_a = a.join(several.select("row_id"), "row_id", "left_anti")
    return s.assess(m.union_all([
        s.match_facts(bridge, both), s.variance_facts(both.filter("side = 'A'"), varied), s.ambiguous_facts(a, several), s.open_facts(open_a),
    ]))
