"""Specification-driven reconciliation queries: orders against their line totals, and pairs of lines against one total."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import specrecon as s
from . import query

_SPEC = s.Spec("lines", s.Pair("amount", "amount", "number"), (s.Pair("sup", "sup", "digits"), s.Pair("day", "day", "date")), max_a_per_b=3, max_b_per_a=2)
_LINES_A = """SELECT 'S-' || CAST(l_suppkey AS STRING) AS sup, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, CAST(CAST(l_quantity AS INT) AS STRING) AS amount,
  (((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey % 32768) * 4096 + (year(l_shipdate) * 366 + dayofyear(l_shipdate)) % 4096) AS source_pos FROM lineitem WHERE l_returnflag <> 'N'"""
_LINES_B = """SELECT CAST(l_suppkey AS STRING) || '/' AS sup, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, CASE WHEN l_partkey % 90 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS amount,
  (((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey % 32768) * 4096 + (year(l_shipdate) * 366 + dayofyear(l_shipdate)) % 4096) AS source_pos FROM lineitem WHERE l_returnflag = 'N'"""
_ROWS = f"""rows AS MATERIALIZED (SELECT 'A' AS side, source_pos AS row_id, regexp_replace(sup, '[^0-9]', '', 'g') || '|' || day AS k, TRY_CAST(amount AS BIGINT) * 100 AS cents FROM ({_LINES_A})
  UNION ALL SELECT 'B', source_pos, regexp_replace(sup, '[^0-9]', '', 'g') || '|' || day, TRY_CAST(amount AS BIGINT) * 100 FROM ({_LINES_B})),
eq AS (SELECT k, cents, count(*) FILTER (WHERE side = 'A') AS na, count(*) FILTER (WHERE side = 'B') AS nb FROM rows WHERE cents IS NOT NULL GROUP BY 1, 2),
p1 AS MATERIALIZED (SELECT r.*, na, nb FROM rows r LEFT JOIN eq USING (k, cents))"""


_NAMED = "'Row ' || CAST(row_id AS VARCHAR)"


def _sql_pass(n: int, k: int, many: str) -> str:
    """CTEs of one pass over the open rows `o{n}`: its outcome `d{n}`, and the rows still open, `o{n + 1}`."""
    one = "B" if many == "A" else "A"
    rows = [f"x{j}" for j in range(1, k + 1)]
    joins = " ".join(f"JOIN o{n} {y} ON {y}.k = x1.k AND {y}.side = '{many}' AND {y}.cents <> 0 AND {x}.row_id < {y}.row_id" for x, y in zip(rows, rows[1:]))
    key = "r[1]" if many == "A" else "target"
    return f"""c{n} AS MATERIALIZED (SELECT z.row_id AS target, [{", ".join(x + ".row_id" for x in rows)}] AS r FROM o{n} x1 {joins}
      JOIN o{n} z ON z.k = x1.k AND z.side = '{one}' AND z.cents = {" + ".join(x + ".cents" for x in rows)} WHERE x1.side = '{many}' AND x1.cents <> 0
      QUALIFY row_number() OVER (PARTITION BY z.row_id ORDER BY [{", ".join(x + ".row_id" for x in rows)}]) <= 2),
    m{n} AS (SELECT DISTINCT target, unnest(r) AS row_id FROM c{n}), u{n} AS (SELECT row_id, count(*) AS c FROM m{n} GROUP BY 1),
    w{n} AS (SELECT m{n}.target, max(c) = 1 AND (SELECT count(*) FROM c{n} y WHERE y.target = m{n}.target) = 1 AS sure FROM m{n} JOIN u{n} USING (row_id) GROUP BY m{n}.target),
    v{n} AS (SELECT c{n}.*, sure FROM c{n} JOIN w{n} USING (target)),
    d{n} AS MATERIALIZED (SELECT side, row_id, CASE WHEN sure THEN 'Matched' ELSE 'Ambiguous' END AS status, CASE WHEN sure THEN '{k} {many} to 1 {one}' ELSE '{s.MANY_SUMS}' END AS reason, key AS match_key
      FROM (SELECT side, row_id, bool_or(sure) AS sure, max(CASE WHEN sure THEN {key} END) AS key FROM (SELECT '{many}' AS side, unnest(r) AS row_id, sure, r, target FROM v{n} UNION ALL SELECT '{one}', target, sure, r, target FROM v{n}) GROUP BY 1, 2)),
    o{n + 1} AS MATERIALIZED (SELECT o{n}.* FROM o{n} ANTI JOIN d{n} USING (side, row_id))"""


_FULL_PASSES = s._passes(_SPEC)
_OUTCOME = f"""{_ROWS}, kk AS (SELECT k, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'B') AS b FROM rows WHERE cents IS NOT NULL GROUP BY 1),
    o0 AS MATERIALIZED (SELECT side, row_id, k, cents FROM p1 WHERE cents IS NOT NULL AND (na = 0 OR nb = 0)),
    {", ".join(_sql_pass(n, *x) for n, x in enumerate(_FULL_PASSES))},
    pairs1 AS (SELECT p1.*, max(CASE WHEN side = 'A' THEN row_id END) OVER (PARTITION BY k, cents) AS a_id FROM p1 WHERE na > 0 AND nb > 0),
    outcome AS MATERIALIZED (SELECT side, row_id, {_NAMED} AS label, cents, status, reason, match_key FROM rows JOIN (
      SELECT side, row_id, CASE WHEN na = 1 AND nb = 1 THEN 'Matched' ELSE 'Ambiguous' END AS status, CASE WHEN na = 1 AND nb = 1 THEN '1 to 1' ELSE '{s.SAME_AMOUNT}' END AS reason, CASE WHEN na = 1 AND nb = 1 THEN a_id END AS match_key FROM pairs1
      {" ".join(f"UNION ALL SELECT * FROM d{n}" for n in range(len(_FULL_PASSES)))}
      UNION ALL SELECT side, row_id, 'Unmatched', CASE WHEN CASE WHEN side = 'A' THEN b ELSE a END = 0 THEN '{s.NO_OTHER}' ELSE '{s.NO_SUM}' END, NULL FROM o{len(_FULL_PASSES)} JOIN kk USING (k)
      UNION ALL SELECT side, row_id, 'Excluded', '{s.NO_AMOUNT}', NULL FROM rows WHERE cents IS NULL) USING (side, row_id))"""


def _outcome(t, spec):
    t.lineitem.createOrReplaceTempView("lineitem")
    return s.reconcile(t.spark.sql(_LINES_A), t.spark.sql(_LINES_B), spec)


@query(
    "spec_one_to_one",
    f"""WITH {_ROWS}, kk AS (SELECT k, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'B') AS b FROM rows WHERE cents IS NOT NULL GROUP BY 1)
    SELECT side, row_id, CASE WHEN cents IS NULL THEN 'Excluded' WHEN na = 1 AND nb = 1 THEN 'Matched' WHEN na > 0 AND nb > 0 THEN 'Ambiguous' ELSE 'Unmatched' END AS status,
    cents IS NOT NULL AND (na = 0 OR nb = 0) AND CASE WHEN side = 'A' THEN kk.b ELSE kk.a END = 0 AS alone FROM p1 LEFT JOIN kk USING (k)""",
)
def one_to_one(t):
    spec = s.Spec("lines", _SPEC.amount, _SPEC.align)
    return _outcome(t, spec).select("side", "row_id", "status", (F.col("reason") == s.NO_OTHER).alias("alone"))


@query(
    "spec_pair_sums",
    f"""WITH {_ROWS}, o AS MATERIALIZED (SELECT side, row_id, k, cents FROM p1 WHERE cents IS NOT NULL AND (na = 0 OR nb = 0)),
    sums AS MATERIALIZED (SELECT x.k, x.row_id AS r1, y.row_id AS r2, z.row_id AS target FROM o x JOIN o y ON x.k = y.k AND x.side = 'A' AND y.side = 'A' AND x.row_id < y.row_id AND x.cents <> 0 AND y.cents <> 0
      JOIN o z ON z.k = x.k AND z.side = 'B' AND z.cents = x.cents + y.cents),
    first2 AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY target ORDER BY r1, r2) <= 2),
    n AS (SELECT target, count(*) AS c FROM first2 GROUP BY 1), claim AS (SELECT r, count(DISTINCT target) AS c FROM (SELECT r1 AS r, target FROM first2 UNION ALL SELECT r2, target FROM first2) GROUP BY 1),
    ok AS (SELECT f.* FROM first2 f JOIN n USING (target) JOIN claim c1 ON c1.r = r1 JOIN claim c2 ON c2.r = r2 WHERE n.c = 1 AND c1.c = 1 AND c2.c = 1)
    SELECT 'A' AS side, r1 AS row_id, r1 AS match_key FROM ok UNION ALL SELECT 'A', r2, r1 FROM ok UNION ALL SELECT 'B', target, r1 FROM ok""",
)
def pair_sums(t):
    """Two A lines that add up to one B line of the same supplier and day."""
    spec = s.Spec("lines", _SPEC.amount, _SPEC.align, max_a_per_b=2)
    out = _outcome(t, spec)
    return out.filter(F.col("reason") == "2 A to 1 B").select("side", "row_id", "match_key")


@query("spec_full", f"WITH {_OUTCOME} SELECT * FROM outcome")
def full(t):
    """Sums of up to three A rows and two B rows, over whole keys."""
    return _outcome(t, _SPEC)


@query(
    "spec_matches",
    f"""WITH {_OUTCOME}, g AS (SELECT match_key, reason AS match_type, count(*) FILTER (WHERE side = 'A') AS a_rows, count(*) FILTER (WHERE side = 'B') AS b_rows,
      CAST(sum(cents) FILTER (WHERE side = 'A') AS BIGINT) AS a_cents, CAST(sum(cents) FILTER (WHERE side = 'B') AS BIGINT) AS b_cents, min(row_id) FILTER (WHERE side = 'B') AS b FROM outcome WHERE status = 'Matched' GROUP BY 1, 2),
    n AS (SELECT *, CAST(row_number() OVER (ORDER BY match_key, b) AS VARCHAR) AS x FROM g)
    SELECT 'M-' || lpad(x, CAST(greatest(4, length(x)) AS INT), '0') AS match_id, match_type, a_rows, b_rows, a_cents, b_cents FROM n""",
)
def match_rows(t):
    return s.matches(_outcome(t, _SPEC)).select("match_id", "match_type", "a_rows", "b_rows", "a_cents", "b_cents")


@query(
    "spec_bridge",
    f"""WITH {_ROWS}, st AS (SELECT side, coalesce(cents, 0) AS cents, CASE WHEN cents IS NULL THEN 'E' WHEN na = 1 AND nb = 1 THEN 'M' WHEN na > 0 AND nb > 0 THEN 'A' ELSE 'U' END AS s FROM p1)
    SELECT side, count(*) AS all_rows, CAST(sum(cents) AS BIGINT) AS all_cents, """
    + ", ".join(
        f"count(*) FILTER (WHERE s = '{x[0]}') AS {x.lower()}_rows, CAST(coalesce(sum(cents) FILTER (WHERE s = '{x[0]}'), 0) AS BIGINT) AS {x.lower()}_cents"
        for x in ("Matched", "Ambiguous", "Unmatched", "Excluded")
    )
    + " FROM st GROUP BY side",
)
def bridge(t):
    return s.bridge(_outcome(t, s.Spec("lines", _SPEC.amount, _SPEC.align)))


@query(
    "spec_controls",
    f"""WITH {_OUTCOME}, z AS (SELECT side, count(*) AS n FROM rows GROUP BY 1), y AS (SELECT side, count(*) AS n, count(DISTINCT row_id) AS ids FROM outcome GROUP BY 1),
    gaps AS (SELECT match_key FROM outcome WHERE status = 'Matched' GROUP BY 1 HAVING sum(CASE WHEN side = 'A' THEN cents ELSE -cents END) <> 0),
    twice AS (SELECT side, label FROM outcome GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT 'Every row of ' || side || ' is accounted for' AS check, CASE WHEN y.n = z.n AND y.ids = z.n THEN 'PASS' ELSE 'FAIL' END AS status, y.n AS n FROM z JOIN y USING (side)
    UNION ALL SELECT 'Every match agrees to the cent', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM gaps
    UNION ALL SELECT 'Row IDs are unique', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'REVIEW' END, count(*) FROM twice
    UNION ALL SELECT 'No ambiguous rows left for review', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'REVIEW' END, count(*) FROM outcome WHERE status = 'Ambiguous'
    UNION ALL SELECT 'No excluded rows', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'REVIEW' END, count(*) FROM outcome WHERE status = 'Excluded'
    UNION ALL SELECT 'Combination search completed', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'REVIEW' END, count(*) FROM outcome WHERE reason = '{s.CUT_SHORT}'""",
)
def controls(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    sizes = t.spark.sql(f"SELECT 'A' AS side, count(*) AS n_rows FROM ({_LINES_A}) UNION ALL SELECT 'B', count(*) FROM ({_LINES_B})")
    return s.controls(_outcome(t, _SPEC), sizes)
