"""Two ledgers derived from `orders`, with faults by modulus of the order key; the same text runs in both engines.

Ledger A holds every order. Ledger B is the other system's view: orders missing, amounts off, punctuation in the PO,
doubled and split rows, another order's invoice, placeholders, names in the PO field, one-letter typos, sign reversals.
`source_pos` is unique inside a ledger and gives the file order.
"""

from __future__ import annotations

from ..operators.working import Roles

_K = "o_orderkey"
_C = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"
_LETTERS = f"translate(CAST({_K} AS STRING), '0123456789', 'ABCDEFGHIJ')"


def _money(cents: str) -> str:
    size = f"abs({cents})"
    text = f"CAST(CAST(FLOOR({size} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({size} % 100 AS STRING), 2, '0')"
    return f"CASE WHEN {cents} < 0 THEN '(' || {text} || ')' ELSE '$' || {text} END"


_NO_INVOICE = f"{_K} % 29 = 0 OR {_K} % 31 = 0 OR {_K} % 53 = 0 OR {_K} % 61 = 0"
_COMMON = f"""'CUST ' || CAST(o_custkey AS STRING) AS customer,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS txn_date,
    o_orderpriority AS product, CAST(o_custkey % 9 + 1 AS STRING) AS quantity,
    CAST(o_orderkey % 100 AS STRING) AS rate, CAST(CAST(month(o_orderdate) AS INT) AS STRING) AS period"""

A_SQL = f"""
WITH base AS (
  SELECT {_K}, o_custkey, o_orderdate, o_orderpriority, {_C} AS c,
    CASE WHEN {_K} % 29 = 0 THEN 'NA' WHEN {_K} % 31 = 0 THEN 'DOCK' || {_LETTERS}
         WHEN {_K} % 53 = 0 THEN 'TRADE' || {_LETTERS} WHEN {_K} % 7 = 0 THEN 'PO ' || CAST({_K} AS STRING)
         ELSE 'PO-' || CAST({_K} AS STRING) END AS po_text,
    CASE WHEN {_NO_INVOICE} THEN '' ELSE 'INV' || CAST({_K} * 7 AS STRING) END AS inv_text
  FROM orders)
SELECT {_K} * 4 AS source_pos, po_text, inv_text,
    CASE WHEN {_K} % 43 = 0 THEN 'n/a' ELSE {_money('c')} END AS amount_text, {_COMMON} FROM base
UNION ALL
SELECT {_K} * 4 + 1 AS source_pos, po_text, inv_text, {_money('c')} AS amount_text, {_COMMON} FROM base
  WHERE {_K} % 37 = 0
UNION ALL
SELECT {_K} * 4 + 2 AS source_pos, po_text, inv_text, {_money('c')} AS amount_text,
    'OTHER ' || CAST(o_custkey AS STRING) AS customer, CAST(CAST(o_orderdate AS DATE) AS STRING) AS txn_date,
    o_orderpriority AS product, '1' AS quantity, CAST(o_orderkey % 100 AS STRING) AS rate, '1' AS period
  FROM base WHERE {_K} % 41 = 0
"""

B_SQL = f"""
WITH base AS (
  SELECT {_K}, o_custkey, o_orderdate, o_orderpriority,
    CASE WHEN {_K} % 40 = 0 THEN {_C} + 2700 WHEN {_K} % 59 = 0 THEN 0 - {_C} ELSE {_C} END AS c,
    CASE WHEN {_K} % 29 = 0 THEN 'NA' WHEN {_K} % 31 = 0 THEN 'DOCK' || {_LETTERS} || ' YARD'
         WHEN {_K} % 53 = 0 THEN 'TRAE' || {_LETTERS} WHEN {_K} % 11 = 0 THEN 'PO-' || CAST({_K} AS STRING) || '.'
         WHEN {_K} % 47 = 0 THEN 'X-' || CAST({_K} AS STRING)
         ELSE 'PO-' || CAST({_K} AS STRING) END AS po_text,
    CASE WHEN {_NO_INVOICE} THEN '' WHEN {_K} % 23 = 0 THEN 'INV' || CAST(({_K} + 1) * 7 AS STRING)
         ELSE 'INV' || CAST({_K} * 7 AS STRING) END AS inv_text
  FROM orders WHERE {_K} % 13 <> 0)
SELECT {_K} * 4 AS source_pos, po_text, inv_text,
    CASE WHEN {_K} % 67 = 0 THEN '' WHEN {_K} % 19 = 0 THEN {_money('(c - 1000)')} ELSE {_money('c')} END AS amount_text,
    {_COMMON} FROM base
UNION ALL
SELECT {_K} * 4 + 1 AS source_pos, po_text, inv_text, '10.00' AS amount_text, {_COMMON} FROM base WHERE {_K} % 19 = 0
UNION ALL
SELECT {_K} * 4 + 2 AS source_pos, po_text, inv_text, {_money('c')} AS amount_text, {_COMMON} FROM base
  WHERE {_K} % 17 = 0
"""

ROLES = Roles(
    po="po_text", invoice="inv_text", amount="amount_text", customer="customer", date="txn_date", product="product",
    quantity="quantity", rate="rate", period="period",
)
FISCAL_YEAR = 2026


def raw_ledgers(t):
    """(ledger A, ledger B) as source rows of text."""
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(A_SQL), t.spark.sql(B_SQL)


# --- the working frame in SQL, for the checks -----------------------------------------------------------------

WEAK = (
    "('NA','NONE','NIL','NULL','TBD','TBA','TEST','CASH','STOCK','SAME','VARIOUS','UNKNOWN','NOPO','MISC','VERBAL',"
    "'PHONE','EMAIL','PICKUP','WALKIN','DEFAULT','PENDING','SEEPO','SEENOTES','SEEATTACHED','ATTACHED','NOPONUMBER',"
    "'NOREFERENCE')"
)


def sql_no_prefix(x: str) -> str:
    long = r"'^P\.?\s*O\.?(\s*[#:\-]\s*|\s+)'"
    return (
        f"CASE WHEN regexp_matches({x}, {long}) THEN regexp_replace({x}, {long}, '') "
        rf"WHEN regexp_matches({x}, '^P\.?\s*O\.?[0-9]') THEN regexp_replace({x}, '^P\.?\s*O\.?', '') ELSE {x} END"
    )


def sql_cents(x: str) -> str:
    bare = f"regexp_replace({x}, '[$, ()]', '', 'g')"
    return (
        f"CASE WHEN {x} LIKE '(%)' THEN -1 ELSE 1 END * "
        f"CAST(ROUND(TRY_CAST({bare} AS DECIMAL(28,6)), 2) * 100 AS BIGINT)"
    )


def _specific(x: str) -> str:
    repeated = " OR ".join(
        f"(length({x}) >= 4 AND {x} = repeat(substr({x}, 1, 1), length({x})))" for _ in (1,)
    )
    return f"CASE WHEN {x} IN {WEAK} OR regexp_matches({x}, '^0+$') OR {repeated} THEN '' ELSE {x} END"


def sql_work(side: str) -> str:
    raw = A_SQL if side == "A" else B_SQL
    return f"""
SELECT '{side}' AS side, source_pos AS row_id, norm_po, norm_inv, key_po, key_inv, cents, words, customer, txn_date,
  CASE WHEN key_po <> '' THEN regexp_replace({sql_no_prefix('upper(po_text)')}, '\\s+', '', 'g') ELSE '' END AS exact_po,
  CASE WHEN key_inv <> '' THEN regexp_replace(upper(inv_text), '\\s+', '', 'g') ELSE '' END AS exact_inv
FROM (
  SELECT *, {_specific('norm_po')} AS key_po, {_specific('norm_inv')} AS key_inv,
    list_sort(list_distinct(list_filter(regexp_extract_all(upper(po_text), '[A-Z]+'), lambda x: length(x) >= 3
      AND x NOT IN ('INC','LLC','LTD','THE','AND','CORP','COMPANY','CO','MISC','VOID','NONE','TBD','NULL')))) AS words
  FROM (
    SELECT source_pos, po_text, inv_text, customer, txn_date,
      regexp_replace({sql_no_prefix('upper(po_text)')}, '[^A-Z0-9]', '', 'g') AS norm_po,
      regexp_replace(upper(inv_text), '[^A-Z0-9]', '', 'g') AS norm_inv,
      {sql_cents('amount_text')} AS cents
    FROM ({raw})))
"""


SQL_BOTH = f"both_sides AS MATERIALIZED ({sql_work('A')} UNION ALL {sql_work('B')})"
SQL_FLAGS = f"""{SQL_BOTH},
shared_po AS (SELECT key_po FROM both_sides WHERE key_po <> '' GROUP BY key_po HAVING count(DISTINCT side) = 2),
shared_inv AS (SELECT key_inv FROM both_sides WHERE key_inv <> '' GROUP BY key_inv HAVING count(DISTINCT side) = 2),
flagged AS MATERIALIZED (
  SELECT w.*, p.key_po IS NOT NULL AS po_shared, i.key_inv IS NOT NULL AS inv_shared
  FROM both_sides w LEFT JOIN shared_po p USING (key_po) LEFT JOIN shared_inv i USING (key_inv))"""


def sql_tiers(source: str = "flagged", prefix: str = "t") -> str:
    """CTEs `{prefix}1` … `{prefix}6` (pairs per tier) and `{prefix}_pairs` (all accepted pairs)."""
    from ..operators.matching import ONE_TO_ONE_TIERS

    out, taken = [], []
    for n, (method, form, kinds) in enumerate(ONE_TO_ONE_TIERS, 1):
        keys = [f"{form}_{k}" for k in kinds] + ["cents"]
        nonblank = " AND ".join([f"{k} <> ''" for k in keys[:-1]] + ["cents IS NOT NULL"])
        gone = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM {x} WHERE {x}.a_id = w.row_id AND w.side = 'A' AND {x}.link <> 'CONFLICT')"
            f" AND NOT EXISTS (SELECT 1 FROM {x} WHERE {x}.b_id = w.row_id AND w.side = 'B' AND {x}.link <> 'CONFLICT')"
            for x in taken
        )
        other = {("po",): "inv", ("inv",): "po"}.get(kinds)
        link = "'CLEAN'"
        if other:
            differs = f"a.key_{other} <> '' AND b.key_{other} <> '' AND a.key_{other} <> b.key_{other}"
            link = (
                f"CASE WHEN {differs} AND (a.{other}_shared OR b.{other}_shared) THEN 'CONFLICT' "
                f"WHEN {differs} THEN 'DISCREPANCY' ELSE 'CLEAN' END"
            )
        cols = ", ".join(keys)
        out.append(
            f"{prefix}{n} AS MATERIALIZED (WITH rest AS (SELECT * FROM {source} w WHERE {nonblank}{gone}), "
            f"ua AS (SELECT {cols}, max(row_id) AS row_id FROM rest WHERE side = 'A' GROUP BY {cols} HAVING count(*) = 1), "
            f"ub AS (SELECT {cols}, max(row_id) AS row_id FROM rest WHERE side = 'B' GROUP BY {cols} HAVING count(*) = 1) "
            f"SELECT ua.row_id AS a_id, ub.row_id AS b_id, '{method}' AS method, {link} AS link FROM ua JOIN ub USING ({cols}) "
            f"JOIN {source} a ON a.side = 'A' AND a.row_id = ua.row_id "
            f"JOIN {source} b ON b.side = 'B' AND b.row_id = ub.row_id)"
        )
        taken.append(f"{prefix}{n}")
    union = " UNION ALL ".join(f"SELECT * FROM {x}" for x in taken)
    out.append(f"{prefix}_proposals AS MATERIALIZED ({union})")
    out.append(f"{prefix}_pairs AS MATERIALIZED (SELECT * FROM {prefix}_proposals WHERE link <> 'CONFLICT')")
    return ",\n".join(out)
