"""Working frame, unique joins, the tier cascade, grouped sums and word joins on the derived ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import evidence as ev, matching as m, words
from ..operators.working import working_frame
from ..runtime import cut
from . import query
from .ledgers import FISCAL_YEAR, ROLES, SQL_BOTH, SQL_FLAGS, raw_ledgers, sql_tiers


def both_sides(t):
    a, b = raw_ledgers(t)
    return working_frame(a, ROLES, "A", FISCAL_YEAR).unionByName(working_frame(b, ROLES, "B", FISCAL_YEAR))


def tier_rows(t, *more: str):
    """Both sides with what the tiers read of a row, and `more` of its columns, written once."""
    return cut(both_sides(t).select(*m.TIER_COLUMNS, *more), "both", compression="zstd")


@query(
    "working_frame",
    f"""WITH {SQL_BOTH} SELECT side, row_id, norm_po, norm_inv, key_po, key_inv, exact_po, exact_inv, cents,
    array_to_string(words, ' ') AS words FROM both_sides""",
)
def working(t):
    return both_sides(t).select(
        "side", "row_id", "norm_po", "norm_inv", "key_po", "key_inv", "exact_po", "exact_inv", "cents",
        F.concat_ws(" ", "words").alias("words"),
    )


@query(
    "unique_join_po_cents",
    f"""WITH {SQL_BOTH}, ua AS (SELECT key_po, cents, max(row_id) a_id FROM both_sides WHERE side='A' AND key_po<>''
      AND cents IS NOT NULL GROUP BY 1,2 HAVING count(*)=1),
    ub AS (SELECT key_po, cents, max(row_id) b_id FROM both_sides WHERE side='B' AND key_po<>'' AND cents IS NOT NULL
      GROUP BY 1,2 HAVING count(*)=1)
    SELECT key_po, cents, a_id, b_id FROM ua JOIN ub USING (key_po, cents)""",
)
def unique_join(t):
    return m.unique_pairs(both_sides(t), ["key_po", "cents"])


@query(
    "tiered_matches",
    f"WITH {SQL_FLAGS}, {sql_tiers()} SELECT a_id, b_id, method, link FROM t_proposals",
)
def tiered(t):
    flagged = cut(m.with_link_flags(tier_rows(t)), "flagged")
    open_rows, frames = flagged, []
    for number, (method, form, kinds) in enumerate(m.ONE_TO_ONE_TIERS, 1):
        pairs = m.tier_pairs(open_rows, form, kinds)
        frames.append(pairs.withColumn("method", F.lit(method)))
        _, _, open_rows = m.consume_pairs(open_rows, pairs, method, f"t{number}")
    return m.union_all(frames).select("a_id", "b_id", "method", "link")


_SQL_SETS = f"""{SQL_BOTH},
sets AS MATERIALIZED (SELECT side, array_to_string(words,' ') AS set_key, any_value(words) AS words, count(*) AS n,
  sum(cents) AS total FROM both_sides WHERE cents IS NOT NULL AND len(words) > 0 GROUP BY 1, 2)"""


@query(
    "word_containment_pairs",
    f"""WITH {_SQL_SETS}, toks AS (SELECT side, set_key, unnest(words) AS w FROM sets),
    cand AS (SELECT DISTINCT a.set_key AS a_set, b.set_key AS b_set FROM toks a JOIN toks b
      ON a.w = b.w AND a.side = 'A' AND b.side = 'B')
    SELECT a_set, b_set FROM (SELECT c.*, x.words AS aw, y.words AS bw,
      len(list_intersect(x.words, y.words)) AS shared FROM cand c
      JOIN sets x ON x.side = 'A' AND x.set_key = a_set JOIN sets y ON y.side = 'B' AND y.set_key = b_set)
    WHERE shared = least(len(aw), len(bw)) AND (shared > 1 OR length(list_intersect(aw, bw)[1]) >= 6)""",
)
def containment_pairs(t):
    """Set pairs of the word-containment rule over all rows of both ledgers."""
    return words.set_pairs(words.word_sets(words.worded(both_sides(t)))).select("a_set", "b_set")


_SQL_STARS = """
deg_a AS (SELECT a_set, sum(b_n) AS d FROM linked GROUP BY 1), deg_b AS (SELECT b_set, sum(a_n) AS d FROM linked GROUP BY 1),
full_links AS MATERIALIZED (SELECT linked.*, x.d AS a_d, y.d AS b_d FROM linked JOIN deg_a x USING (a_set) JOIN deg_b y USING (b_set)),
stars AS (SELECT 'A' AS side, a_set AS centre FROM full_links GROUP BY a_set HAVING max(a_n) = 1 AND max(b_d) = 1 AND max(a_d) BETWEEN 1 AND 8
  UNION ALL SELECT 'B', b_set FROM full_links GROUP BY b_set HAVING max(b_n) = 1 AND max(a_d) = 1 AND max(b_d) BETWEEN 2 AND 8),
spokes AS (SELECT side, centre, CASE WHEN side = 'A' THEN b_set ELSE a_set END AS leaf FROM stars JOIN full_links ON centre = CASE WHEN side = 'A' THEN a_set ELSE b_set END),
tied AS (SELECT s.side, h.row_id AS hub, h.cents AS hub_cents, l.side AS leaf_side, l.row_id AS leaf_id, l.cents AS leaf_cents FROM spokes s
  JOIN member h ON h.side = s.side AND h.set_key = s.centre JOIN member l ON l.side <> s.side AND l.set_key = s.leaf),
judged AS (SELECT *, sum(leaf_cents) OVER w = hub_cents AS whole, count(*) FILTER (WHERE leaf_cents = hub_cents) OVER w AS same FROM tied WINDOW w AS (PARTITION BY side, hub)),
taken AS (SELECT * FROM judged WHERE whole OR (same = 1 AND leaf_cents = hub_cents)),
keyed AS (SELECT *, CASE WHEN side = 'A' THEN hub ELSE min(leaf_id) OVER (PARTITION BY side, hub) END AS match_key FROM taken)"""


def _sql_star_rows(method: str) -> str:
    return f"""SELECT DISTINCT match_key, '{method}' AS method, side, hub AS row_id FROM keyed
    UNION ALL SELECT match_key, '{method}', leaf_side, leaf_id FROM keyed"""


@query(
    "word_containment_groups",
    f"""WITH {_SQL_SETS}, toks AS (SELECT side, set_key, unnest(words) AS w FROM sets),
    cand AS (SELECT DISTINCT a.set_key AS a_set, b.set_key AS b_set FROM toks a JOIN toks b ON a.w = b.w AND a.side = 'A' AND b.side = 'B'),
    linked AS MATERIALIZED (SELECT a_set, b_set, a_n, b_n FROM (SELECT c.*, x.words AS aw, y.words AS bw, x.n AS a_n, y.n AS b_n, len(list_intersect(x.words, y.words)) AS shared
      FROM cand c JOIN sets x ON x.side = 'A' AND x.set_key = a_set JOIN sets y ON y.side = 'B' AND y.set_key = b_set)
      WHERE shared = least(len(aw), len(bw)) AND (shared > 1 OR length(list_intersect(aw, bw)[1]) >= 6)),
    member AS (SELECT side, row_id, cents, array_to_string(words, ' ') AS set_key FROM both_sides WHERE cents IS NOT NULL AND len(words) > 0),
    {_SQL_STARS} {_sql_star_rows(words.FUZZY_METHOD)}""",
)
def containment_groups(t):
    """Groups the containment rule would hold for review, over all rows of both ledgers."""
    return words.match_contained(cut(both_sides(t), "both"))


@query(
    "controlled_typo_pairs",
    f"""WITH {SQL_BOTH},
    s AS (SELECT side, row_id, cents, words FROM both_sides WHERE cents IS NOT NULL AND len(words) > 0),
    p AS (SELECT a.row_id AS a_id, b.row_id AS b_id, a.words AS aw, b.words AS bw FROM s a JOIN s b
      ON a.cents = b.cents AND a.side = 'A' AND b.side = 'B'),
    q AS (SELECT *, CASE WHEN len(aw) <= len(bw) THEN aw ELSE bw END AS sw, CASE WHEN len(aw) <= len(bw) THEN bw ELSE aw END AS lw FROM p),
    r AS (SELECT *, list_filter(sw, lambda x: NOT list_contains(lw, x)) AS un, list_filter(lw, lambda x: NOT list_contains(sw, x)) AS ln,
      len(list_intersect(sw, lw)) AS exact FROM q),
    u AS (SELECT *, un[1] AS shw, list_filter(ln, lambda x: length(x) >= 5 AND length(un[1]) >= 5 AND x[1] = un[1][1]
      AND levenshtein(x, un[1]) = 1) AS rd FROM r WHERE len(un) = 1),
    v AS (SELECT *, rd[1] AS low FROM u WHERE len(rd) = 1),
    e AS (SELECT a_id, b_id, CASE WHEN len(aw) <= len(bw) THEN shw ELSE low END AS a_word,
      CASE WHEN len(aw) <= len(bw) THEN low ELSE shw END AS b_word FROM v
      WHERE NOT (exact = 0 AND (length(shw) = length(low) OR greatest(length(shw), length(low)) < 6)))
    SELECT a_id, b_id, a_word, b_word FROM e
    WHERE (SELECT count(*) FROM e x WHERE x.a_id = e.a_id) = 1 AND (SELECT count(*) FROM e x WHERE x.b_id = e.b_id) = 1""",
)
def typo_pairs(t):
    """One-letter-typo pairs with a single candidate on each side, over all rows of both ledgers."""
    return words.match_typos(cut(both_sides(t), "both"))[0]


@query("grouped_sum_matches")
def grouped_sums(t):
    """Exact 1:n and n:1 groups over all rows of both ledgers, PO and invoice first (tested against brute force)."""
    flagged = cut(m.with_link_flags(tier_rows(t)), "flagged")
    return m.match_grouped_tiers(flagged)[0]


def _open_after_pairs(t):
    return m.match_one_to_one(tier_rows(t))[2]


def _sql_unsearched(pool: int) -> str:
    """CTE `left_out` over the rows that the one-to-one tiers leave open."""
    parts = []
    for method, kinds in m.GROUPED_TIERS:
        keys = ", ".join(f"key_{k}" for k in kinds)
        filled = " AND ".join(f"key_{k} <> ''" for k in kinds)
        parts.append(
            f"SELECT '{method}' AS method, side, row_id, pool FROM (SELECT side, row_id, count(*) OVER (PARTITION BY {keys}, side) AS pool, "
            f"count(*) OVER (PARTITION BY {keys}) AS every FROM still WHERE {filled} AND cents IS NOT NULL) WHERE pool > {pool} AND every > pool"
        )
    return f"""{SQL_FLAGS}, {sql_tiers()}, gone AS (SELECT 'A' AS side, a_id AS row_id FROM t_pairs UNION ALL SELECT 'B', b_id FROM t_pairs),
    still AS MATERIALIZED (SELECT f.* FROM flagged f ANTI JOIN gone USING (side, row_id)), left_out AS ({" UNION ALL ".join(parts)})"""


@query(
    "grouped_sum_unsearched",
    f"WITH {_sql_unsearched(2)} SELECT method, side, row_id, pool, '{m.OVER_POOL}' AS reason FROM left_out",
)
def grouped_unsearched(t):
    """Rows that a search with pools of two rows leaves out (with the rule's own pools no key of these ledgers is too large)."""
    return m.unsearched_rows(_open_after_pairs(t), 2)


@query(
    "grouped_sum_search_control",
    f"""WITH {_sql_unsearched(2)}, names AS (SELECT method, side FROM (VALUES {", ".join(f"('{x}')" for x, _ in m.GROUPED_TIERS)}) x(method), (VALUES ('A'), ('B')) y(side)),
    c AS (SELECT method, side, count(*) AS n FROM left_out GROUP BY ALL)
    SELECT 'Sums of ' || side || ' rows searched: ' || method AS check, CASE WHEN n IS NULL THEN 'PASS' ELSE 'REVIEW' END AS status, coalesce(n, 0) AS n FROM names LEFT JOIN c USING (method, side)""",
)
def grouped_control(t):
    return m.search_control(_open_after_pairs(t), 2)


def _aliases(t):
    """Confirmed aliases: each market segment with a customer is known under a dock name."""
    return t.customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k")).select(
        F.format_string("ALIAS-%04d", F.col("k").cast("int")).alias("alias_id"),
        F.array(F.upper("c_mktsegment"), F.concat(F.lit("DOCK"), F.upper("c_mktsegment"))).alias("terms"),
        F.lit(True).alias("active"),
    )


_ALIAS_ROWS = """SELECT 'A' AS side, o_orderkey AS row_id, upper(c_mktsegment) || ' ' || CAST(o_orderkey AS STRING) AS ref,
    CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 'B', o_orderkey, 'DOCK' || upper(c_mktsegment), CAST(ROUND(o_totalprice * 100) AS BIGINT), o_custkey
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '1-URGENT'"""


@query(
    "alias_group_sizes",
    f"""WITH r AS ({_ALIAS_ROWS}), al AS (SELECT DISTINCT upper(c_mktsegment) AS seg FROM customer)
    SELECT seg, CAST(count(*) FILTER (WHERE side = 'A') AS BIGINT) AS a_rows, CAST(count(*) FILTER (WHERE side = 'B') AS BIGINT) AS b_rows
    FROM r JOIN al ON regexp_extract(ref, '[A-Z]+') IN (seg, 'DOCK' || seg) GROUP BY seg""",
)
def alias_sizes(t):
    """Rows per side that touch each confirmed alias (the degrees the alias join is settled from)."""
    t.orders.createOrReplaceTempView("orders")
    t.customer.createOrReplaceTempView("customer")
    rows = t.spark.sql(_ALIAS_ROWS).withColumn("words", ids.reference_words("ref"))
    terms = words.alias_terms(_aliases(t)).join(
        _aliases(t).select("alias_id", F.col("terms")[0].alias("seg")), "alias_id"
    )
    named = words.worded(rows).select("side", "row_id", F.explode("words").alias("word")).join(terms, "word")
    return named.groupBy("seg").agg(m.counted("A").alias("a_rows"), m.counted("B").alias("b_rows"))


_NAME = "translate(CAST(o_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')"
_PARTY_ROWS = f"""SELECT 'A' AS side, o_orderkey AS row_id, 'CUST' || {_NAME} || ' ' || CAST(o_orderkey AS STRING) AS ref, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents, o_custkey
    FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 'B', o_orderkey, 'DOCK' || {_NAME}, CAST(ROUND(o_totalprice * 100) AS BIGINT), o_custkey FROM orders WHERE o_orderkey % 3 <> 0"""


@query(
    "alias_matches",
    f"""WITH member AS MATERIALIZED (SELECT side, row_id, cents, CAST(o_custkey AS VARCHAR) AS set_key FROM ({_PARTY_ROWS})),
    n AS (SELECT set_key, count(*) FILTER (WHERE side = 'A') AS a_n, count(*) FILTER (WHERE side = 'B') AS b_n FROM member GROUP BY 1),
    linked AS MATERIALIZED (SELECT set_key AS a_set, set_key AS b_set, a_n, b_n FROM n WHERE a_n > 0 AND b_n > 0), {_SQL_STARS} {_sql_star_rows(words.ALIAS_METHOD)}""",
)
def alias_matches(t):
    """Groups joined by a confirmed alias and equal cents: every customer is known under a name and a dock."""
    t.orders.createOrReplaceTempView("orders")
    rows = t.spark.sql(_PARTY_ROWS).withColumn("words", ids.reference_words("ref"))
    letters = F.translate(F.col("o_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    aliases = t.orders.select("o_custkey").distinct().select(
        F.format_string("ALIAS-%04d", "o_custkey").alias("alias_id"),
        F.array(F.concat(F.lit("CUST"), letters), F.concat(F.lit("DOCK"), letters)).alias("terms"), F.lit(True).alias("active"),
    )
    return words.match_aliases(rows, aliases)


@query(
    "link_flags",
    f"WITH {SQL_FLAGS} SELECT side, row_id, po_shared, inv_shared FROM flagged",
)
def link_flags(t):
    return m.with_link_flags(cut(both_sides(t), "both")).select("side", "row_id", "po_shared", "inv_shared")


@query(
    "punctuation_discrepancies",
    f"""WITH {SQL_FLAGS}, {sql_tiers()}
    SELECT a_id AS match_key, 'po' AS kind, a.exact_po AS a_value, b.exact_po AS b_value FROM t_pairs
      JOIN flagged a ON a.side = 'A' AND a.row_id = a_id JOIN flagged b ON b.side = 'B' AND b.row_id = b_id
      WHERE a.key_po <> '' AND a.key_po = b.key_po AND a.exact_po <> b.exact_po
    UNION ALL
    SELECT a_id, 'inv', a.exact_inv, b.exact_inv FROM t_pairs
      JOIN flagged a ON a.side = 'A' AND a.row_id = a_id JOIN flagged b ON b.side = 'B' AND b.row_id = b_id
      WHERE a.key_inv <> '' AND a.key_inv = b.key_inv AND a.exact_inv <> b.exact_inv""",
)
def punctuation(t):
    both = tier_rows(t)
    bridge, _, _ = m.match_one_to_one(both)
    notes = ev.punctuation_notes(bridge, both)
    return notes.select(
        "match_key", "kind", F.col("a_values")[0].alias("a_value"), F.col("b_values")[0].alias("b_value")
    )


@query(
    "corroboration_notes",
    f"""WITH {SQL_FLAGS}, {sql_tiers()}
    SELECT a_id AS match_key,
      CASE WHEN len(list_intersect(regexp_extract_all(a.customer, '[A-Z]{{3,}}'), regexp_extract_all(b.customer, '[A-Z]{{3,}}'))) > 0
        OR a.customer = b.customer THEN 'customer: agrees' ELSE 'customer: not comparable (different naming between systems)' END AS customer_note,
      CASE WHEN abs(date_diff('day', CAST(a.txn_date AS DATE), CAST(b.txn_date AS DATE))) <= 31
        THEN 'date: within 31 days (' || abs(date_diff('day', CAST(a.txn_date AS DATE), CAST(b.txn_date AS DATE))) || 'd)'
        ELSE 'date: ' || abs(date_diff('day', CAST(a.txn_date AS DATE), CAST(b.txn_date AS DATE))) || ' days apart (accounting-period difference, not identity evidence)' END AS date_note
    FROM t_pairs JOIN flagged a ON a.side = 'A' AND a.row_id = a_id JOIN flagged b ON b.side = 'B' AND b.row_id = b_id""",
)
def corroboration(t):
    both = tier_rows(t, "customer", "txn_date")
    bridge, _, _ = m.match_one_to_one(both)
    return ev.corroboration(bridge, both)


@query(
    "evidence_sentences",
    f"""WITH {SQL_FLAGS}, {sql_tiers()} SELECT a_id AS match_key, 'Matched on ' || CASE method WHEN 'PO + Invoice + Amount' THEN 'PO (A po_text; B po_text) + Invoice (A inv_text; B inv_text)' WHEN 'PO + Amount' THEN 'PO (A po_text; B po_text)'
    ELSE 'Invoice (A inv_text; B inv_text)' END || ' and exact signed amount' AS evidence FROM t_pairs""",
)
def sentences(t):
    both = tier_rows(t, "po_field", "inv_field")
    return ev.evidence_sentences(m.match_one_to_one(both)[0], both)


@query(
    "already_matched_wording",
    f"""WITH {SQL_FLAGS}, {sql_tiers()}, n AS (SELECT a_id, b_id, 'M-' || lpad(CAST(row_number() OVER (ORDER BY a_id, b_id) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INT), '0') AS ref FROM t_pairs),
    tk AS (SELECT key_po, key_inv, ref FROM n JOIN flagged b ON b.side = 'B' AND b.row_id = n.b_id), p AS (SELECT key_po, list_sort(list(DISTINCT ref)) AS refs FROM tk WHERE key_po <> '' GROUP BY 1), i AS (SELECT key_inv, list_sort(list(DISTINCT ref)) AS refs FROM tk WHERE key_inv <> '' GROUP BY 1),
    x AS (SELECT a.row_id, p.refs AS pr, coalesce(p.refs, i.refs) AS refs FROM flagged a LEFT JOIN p USING (key_po) LEFT JOIN i USING (key_inv) WHERE a.side = 'A')
    SELECT row_id, CASE WHEN pr IS NOT NULL THEN 'PO' ELSE 'Invoice' END AS basis, CASE WHEN pr IS NOT NULL THEN 'PO' ELSE 'Invoice' END || ' already represented by ' || array_to_string(refs[1:3], ', ') ||
      CASE WHEN len(refs) > 3 THEN ' and ' || (len(refs) - 3) || ' more' ELSE '' END AS wording FROM x WHERE refs IS NOT NULL""",
)
def wording(t):
    """How every A row with a taken candidate would cite the match that took it."""
    from ..operators.ledger import match_register

    both = tier_rows(t)
    bridge = m.match_one_to_one(both)[0]
    as_if = both.filter("side = 'A'").withColumn("finding", F.lit(ev.CONSUMED))
    out = ev.already_matched(as_if, both.filter("side = 'B'"), bridge, match_register(bridge, both))
    return out.filter("wording IS NOT NULL AND wording NOT LIKE '%represented by '")
