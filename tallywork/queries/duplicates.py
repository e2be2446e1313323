"""Duplicate screening on the derived ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates as d
from ..runtime import cut
from . import query
from .ledgers import A_SQL, B_SQL, SQL_BOTH
from .matching import both_sides

_BASIS = """CASE WHEN cents IS NULL THEN NULL WHEN norm_po <> '' AND norm_inv <> '' THEN 'PO + Invoice + Amount'
  WHEN norm_po <> '' THEN 'PO + Amount (invoice blank on both rows)'
  WHEN norm_inv <> '' THEN 'Invoice + Amount (PO blank on both rows)' END"""
_KEYED = f"""{SQL_BOTH}, src AS (SELECT 'A' AS side, source_pos AS row_id, product, quantity, rate FROM ({A_SQL})
    UNION ALL SELECT 'B', source_pos, product, quantity, rate FROM ({B_SQL})),
keyed AS MATERIALIZED (SELECT w.*, upper(customer) || '|' || txn_date || '|' || product || '|' || quantity || '|' || rate AS print,
    {_BASIS} AS basis FROM both_sides w JOIN src USING (side, row_id)),
grp AS (SELECT side, basis, norm_po, norm_inv, cents, count(*) AS group_size FROM keyed WHERE basis IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
sets AS (SELECT side, basis, norm_po, norm_inv, cents, print, count(*) AS copy_set_size, min(row_id) AS first_row FROM keyed WHERE basis IS NOT NULL GROUP BY ALL),
dec AS (SELECT k.side, k.row_id, k.basis, k.norm_po, k.norm_inv, k.cents, k.print, group_size, copy_set_size, first_row,
    k.basis = 'PO + Invoice + Amount' AND copy_set_size > 1 AS confirmed
  FROM keyed k JOIN grp USING (side, basis, norm_po, norm_inv, cents) JOIN sets USING (side, basis, norm_po, norm_inv, cents, print)),
decisions AS MATERIALIZED (SELECT *, CASE WHEN confirmed AND row_id = first_row THEN 'Retained canonical row' WHEN confirmed THEN 'Excluded excess copy'
    ELSE 'Review required - retained for matching' END AS disposition FROM dec)"""


def _decisions(t):
    both = cut(both_sides(t), "both")
    a, b = (d.same_file_decisions(both.filter(F.col("side") == side)) for side in "AB")
    return a.unionByName(b)


@query(
    "duplicate_decisions",
    f"""WITH {_KEYED} SELECT side, row_id, basis, group_size, copy_set_size, confirmed AS payload_confirmed,
    CASE WHEN confirmed THEN first_row END AS canonical_row_id, disposition FROM decisions""",
)
def decisions(t):
    return _decisions(t).select(
        "side", "row_id", "basis", "group_size", "copy_set_size", "payload_confirmed", "canonical_row_id", "disposition"
    )


@query(
    "duplicate_group_ids",
    f"""WITH {_KEYED} SELECT DISTINCT side, 'DUP-' || upper(substr(sha256(basis || chr(31) || norm_po || chr(31) || norm_inv || chr(31) || CAST(cents AS VARCHAR)), 1, 12)) AS group_id
    FROM decisions""",
)
def group_ids(t):
    return _decisions(t).select("side", "group_id").distinct()


@query(
    "duplicate_screen_totals",
    f"""WITH {_KEYED} SELECT side, disposition, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents FROM decisions GROUP BY 1, 2""",
)
def totals(t):
    return _decisions(t).groupBy("side", "disposition").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"))


@query(
    "duplicate_suspect_accounting",
    f"""WITH {_KEYED}, sus AS (SELECT *, norm_po || '|' || norm_inv || '|' || cents AS g, row_id % 3 = 0 AS open FROM decisions WHERE disposition LIKE 'Review%'),
    f AS (SELECT *, min(CASE WHEN NOT open THEN row_id END) OVER w AS fm, min(CASE WHEN open THEN row_id END) OVER w AS fo FROM sus WINDOW w AS (PARTITION BY side, basis, g))
    SELECT side, row_id, CASE WHEN NOT open THEN 'Resolved via match - no exclusion applied' WHEN fm IS NULL AND row_id = fo THEN 'Retained canonical row'
      ELSE 'Held for review - excluded from proposed JE pending disposition' END AS outcome,
      CASE WHEN NOT open THEN NULL WHEN fm IS NULL AND row_id = fo THEN NULL ELSE coalesce(fm, fo) END AS held_for_row_id FROM f""",
)
def suspects(t):
    """Suspect accounting, with every row whose position divides by three still open."""
    decided = cut(_decisions(t), "decisions")
    review = d.suspected(decided)
    return d.account_suspects(review, review.filter("row_id % 3 = 0")).select("side", "row_id", "outcome", "held_for_row_id")


@query(
    "duplicate_final_dispositions",
    f"""WITH {_KEYED}, sus AS (SELECT *, norm_po || '|' || norm_inv || '|' || cents AS g, row_id % 3 = 0 AS open FROM decisions WHERE disposition LIKE 'Review%'),
    f AS (SELECT *, min(CASE WHEN NOT open THEN row_id END) OVER w AS fm, min(CASE WHEN open THEN row_id END) OVER w AS fo FROM sus WINDOW w AS (PARTITION BY side, basis, g)),
    o AS (SELECT side, row_id, CASE WHEN NOT open THEN 'Resolved via match - no exclusion applied' WHEN fm IS NULL AND row_id = fo THEN 'Retained canonical row'
      ELSE 'Held for review - excluded from proposed JE pending disposition' END AS outcome FROM f),
    x AS (SELECT side, row_id, coalesce(outcome, disposition) AS disposition FROM decisions LEFT JOIN o USING (side, row_id))
    SELECT side, row_id, disposition, disposition = 'Excluded excess copy' OR disposition LIKE 'Held%' AS automatically_excluded,
      CASE WHEN disposition LIKE 'Resolved%' THEN 'Resolved' WHEN disposition LIKE 'Held%' THEN '{d.CONFIDENCE[d.HOLD]}' ELSE 'High' END AS confidence FROM x""",
)
def final(t):
    """Final dispositions where a third of the suspects is still open after matching, so that rows are held, too."""
    decided = cut(_decisions(t), "decisions")
    review = d.suspected(decided)
    outcomes = d.account_suspects(review, review.filter("row_id % 3 = 0"))
    return d.finalize(decided, outcomes).select("side", "row_id", "disposition", "automatically_excluded", "confidence")


@query(
    "duplicate_report",
    f"""WITH {_KEYED}, m AS (SELECT side, basis, norm_po, norm_inv, cents, list(row_id ORDER BY row_id) AS members, count(DISTINCT print) > 1 AS d FROM decisions GROUP BY ALL)
    SELECT d.side, d.row_id, array_to_string(list_transform(list_filter(members, lambda x: x <> d.row_id), lambda x: CAST(x AS VARCHAR)), '; ') AS other_row_ids,
      NOT confirmed AND m.d AS differs FROM decisions d JOIN m USING (side, basis, norm_po, norm_inv, cents)""",
)
def report(t):
    return d.report(cut(_decisions(t), "decisions")).select(
        "side", "row_id", "other_row_ids", (F.col("differing_fields") != "").alias("differs")
    )


@query(
    "cross_scope_overlap",
    f"""WITH {_KEYED}, p AS (SELECT basis, norm_po, norm_inv, cents, count(*) AS n FROM keyed WHERE side = 'A' AND basis IS NOT NULL GROUP BY ALL),
    pp AS (SELECT basis, norm_po, norm_inv, cents, print, min(row_id) AS r FROM keyed WHERE side = 'A' AND basis IS NOT NULL GROUP BY ALL)
    SELECT k.row_id, r AS canonical_row_id, CASE WHEN r IS NOT NULL THEN 'Excluded historical overlap' ELSE 'Review required - retained for matching' END AS disposition
    FROM keyed k JOIN p USING (basis, norm_po, norm_inv, cents) LEFT JOIN pp USING (basis, norm_po, norm_inv, cents, print) WHERE side = 'B'""",
)
def cross_scope(t):
    """Ledger B screened as if it were history of ledger A."""
    both = cut(both_sides(t), "both")
    out = d.cross_scope_decisions(both.filter("side = 'B'"), both.filter("side = 'A'"))
    return out.select("row_id", "canonical_row_id", "disposition")


@query(
    "duplicate_input_contract",
    f"""WITH {SQL_BOTH} SELECT CAST(0 AS BIGINT) AS blank_row_ids, CAST(0 AS BIGINT) AS untrimmed_po, CAST(0 AS BIGINT) AS untrimmed_invoice,
    count(*) - count(cents) AS missing_amounts, CAST(0 AS BIGINT) AS repeated_row_ids FROM both_sides WHERE side = 'A'""",
)
def contract(t):
    return d.input_violations(both_sides(t).filter("side = 'A'"))
