"""Receipt recognition, material names and counts over `lineitem` and `part`."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import materials as m, receipts as r
from ..runtime import cut
from . import query

_LOG = """SELECT (((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey % 32768) * 4096 + (year(l_shipdate) * 366 + dayofyear(l_shipdate)) % 4096) AS source_row, CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_partkey END AS alias,
  CASE WHEN l_suppkey % 43 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS delivered, CASE WHEN l_orderkey % 47 = 0 THEN 0.0 ELSE l_quantity END AS qty, l_extendedprice AS total,
  'PO ' || CAST(l_suppkey AS STRING) AS po, 'inv-' || CAST(l_orderkey % 500 AS STRING) AS invoice,
  CASE WHEN l_linenumber = 1 THEN 'P' || CAST(month(l_shipdate) AS STRING) || ' FYE 2026' WHEN l_linenumber = 2 THEN 'P' || CAST(month(l_shipdate) % 12 + 1 AS STRING) || ' FYE 2026' ELSE '' END AS label,
  '' AS section_label FROM lineitem"""
_REG = """SELECT l_partkey AS alias, CAST(l_shipdate AS DATE) AS delivered, l_quantity AS qty, l_extendedprice AS total, 'po' || CAST(l_suppkey AS STRING) AS po, 'INV' || CAST(l_orderkey % 500 AS STRING) AS invoice
  FROM lineitem WHERE l_orderkey % 3 = 0"""
_W = r.Window(2026, 6, date(1998, 6, 1), date(1998, 6, 30), date(1998, 1, 1), date(1998, 12, 31), date(1998, 3, 31), 3)
_PLACED = f"""lg AS (SELECT * FROM ({_LOG})), rg AS (SELECT alias, delivered, qty, total, upper(po) AS po, upper(invoice) AS invoice, count(*) AS n FROM ({_REG}) GROUP BY ALL),
k AS (SELECT lg.*, row_number() OVER (PARTITION BY lg.alias, lg.delivered, lg.qty, lg.total, lg.po, lg.invoice ORDER BY source_row) AS rn, coalesce(rg.n, 0) AS n,
  TRY_CAST(regexp_extract(label, '^P(\\d+) ', 1) AS INT) AS lp FROM lg LEFT JOIN rg ON lg.alias = rg.alias AND lg.delivered = rg.delivered AND lg.qty = rg.qty AND lg.total = rg.total
  AND replace(lg.po, ' ', '') = rg.po AND upper(replace(lg.invoice, '-', '')) = rg.invoice),
f AS (SELECT *, coalesce(lp > 3 AND lp <= 6, false) AND (lp IS NOT NULL) AS later, coalesce(lp = 6, false) AS here FROM k),
placed AS (SELECT *, CASE WHEN rn <= n THEN 'registered' WHEN delivered IS NULL THEN CASE WHEN here THEN 'rejected' ELSE 'unplaced' END
  WHEN delivered < DATE '1998-06-01' AND delivered <= DATE '1998-03-31' THEN CASE WHEN later THEN 'crossing' ELSE 'presumed in opening' END
  WHEN delivered < DATE '1998-06-01' THEN 'late' WHEN delivered > DATE '1998-06-30' THEN CASE WHEN here THEN 'mislabelled' ELSE 'pending' END ELSE 'in period' END AS placement FROM f)"""


def _inputs(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql(_LOG), t.spark.sql(_REG)


@query("receipt_placement", f"WITH {_PLACED} SELECT source_row, placement FROM placed")
def placement(t):
    return r.classify(*_inputs(t), _W).select("source_row", "placement")


@query(
    "receipt_register_antijoin",
    f"WITH {_PLACED} SELECT source_row, rn <= n AS processed FROM k",
)
def registered(t):
    return r.mark_registered(*_inputs(t)).select("source_row", "processed")


def _recognized(t):
    log, register = _inputs(t)
    lines = t.lineitem.filter("l_orderkey % 4 = 1")
    day = F.col("l_shipdate").cast("date")
    lineage = lines.select(
        F.col("l_partkey").alias("alias"), day.alias("delivered"), F.col("l_quantity").alias("qty"),
        F.concat(F.lit("po"), F.col("l_suppkey").cast("string")).alias("po"), F.lit("").alias("invoice"),
    )
    layers = t.lineitem.filter("l_partkey % 2 = 0").groupBy(F.col("l_partkey").alias("alias")).agg(F.min(day).alias("start_day"), F.min(day).alias("end_day"))
    layers = cut(layers, "spans", compression="zstd")
    return r.recognize(log, register, _W, layers, lineage), layers


@query(
    "receipt_recognition",
    f"""WITH {_PLACED}, ln AS (SELECT DISTINCT l_partkey AS alias, CAST(l_shipdate AS DATE) AS delivered, l_quantity AS q, l_suppkey AS s FROM lineitem WHERE l_orderkey % 4 = 1),
    ly AS (SELECT l_partkey AS alias, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
    SELECT source_row, CASE WHEN placement IN ('in period', 'late', 'crossing', 'rejected') AND (p.alias IS NULL OR qty <= 0.0001 OR delivered IS NULL) THEN 'rejected'
      WHEN placement = 'crossing' AND EXISTS (SELECT 1 FROM ln WHERE ln.alias = p.alias AND ln.delivered = p.delivered AND abs(ln.q - p.qty) <= 0.5 AND 'PO ' || ln.s = p.po) THEN 'in opening'
      WHEN placement = 'crossing' AND EXISTS (SELECT 1 FROM ly WHERE ly.alias = p.alias AND ly.d = p.delivered) THEN 'review' WHEN placement = 'crossing' THEN 'late' ELSE placement END AS outcome FROM placed p""",
)
def recognition(t):
    return _recognized(t)[0].select("source_row", "outcome")


@query(
    "repeated_receipts",
    """SELECT 'same invoice' AS kind, l_partkey || '|INV' || l_orderkey % 500 AS subject, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'all fields equal', 'x', count(*) FROM lineitem GROUP BY l_partkey, l_shipdate, l_quantity, l_extendedprice, l_suppkey, l_orderkey % 500 HAVING count(*) > 1""",
)
def repeated(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return r.repeated_receipts(t.spark.sql(_REG.replace("WHERE l_orderkey % 3 = 0", "")))


# The register as it would hold a receipt that was entered again a day later: real quantity, cost, PO and invoice.
_REDATED = """SELECT alias, CASE WHEN CAST(qty AS BIGINT) % 2 = 0 THEN date_add(delivered, 1) ELSE delivered END AS delivered, qty, total, po, invoice FROM ({}) r"""


def _sql_alike(ref: str, mine: str, known: str) -> str:
    same = f"g.alias = lg.alias AND g.qty = lg.qty AND g.total = lg.total AND {known} = {mine}"
    return f"(EXISTS (SELECT 1 FROM rg g WHERE {same}) AND NOT EXISTS (SELECT 1 FROM rg g WHERE {same} AND g.delivered = lg.delivered))"


@query(
    "receipt_look_alikes",
    f"""WITH lg AS (SELECT * FROM ({_LOG})), rg AS ({_REDATED.format(_REG).replace("date_add(delivered, 1)", "delivered + 1")})
    SELECT source_row FROM lg WHERE {_sql_alike("po", "replace(lg.po, ' ', '')", "upper(g.po)")} OR {_sql_alike("invoice", "upper(replace(lg.invoice, '-', ''))", "g.invoice")}""",
)
def alikes(t):
    """Lines equal to a registered one in part, quantity, cost and PO or invoice, on another date: half of the register is dated a day later."""
    log, register = _inputs(t)
    return r.look_alikes(log, t.spark.sql(_REDATED.format(_REG)))


@query("receipts_report")
def report(t):
    done, layers = _recognized(t)
    return r.receipts_report(r.clamp_late(done.filter("outcome IN ('late', 'in period')"), layers))


_PRODUCTS = "SELECT CAST(p_size AS INT) AS alias, min(p_brand) || ' - ' || min(p_name) || ' Case ' || CAST(p_size AS STRING) AS name FROM part GROUP BY p_size"
_KNOWN = "SELECT p_type || ' ' || CAST(p_size % 3 AS STRING) AS spelling, CAST(p_size AS INT) AS alias FROM part WHERE p_partkey % 7 = 0"
_CELLS = """SELECT p_partkey AS row_no, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS STRING) ELSE '' END AS cell1, CASE WHEN p_partkey % 11 = 0 THEN 'Pallet Wrap' ELSE p_type || ' ' || CAST(p_size % 3 AS STRING) END AS cell2 FROM part"""


def _resolved(t):
    t.part.createOrReplaceTempView("part")
    products = t.spark.sql(_PRODUCTS)
    rows = t.spark.sql(_CELLS)
    return rows, products, m.resolve_cells(rows, ["cell1", "cell2"], m.spelling_table(products, known=t.spark.sql(_KNOWN)), "row_no")


@query(
    "material_matching",
    f"""WITH k AS (SELECT spelling, count(DISTINCT alias) AS n, min(alias) AS a FROM ({_KNOWN}) GROUP BY 1), c AS (SELECT *, TRY_CAST(cell1 AS INT) AS a1 FROM ({_CELLS})),
    j AS (SELECT c.row_no, a1, n, CASE WHEN n = 1 THEN a END AS a2 FROM c LEFT JOIN k ON k.spelling = cell2)
    SELECT row_no, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a1 <> a2 THEN NULL ELSE coalesce(a1, a2) END AS alias,
      CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a1 <> a2 THEN 'AMBIGUOUS' WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN 'OK' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNMAPPED' END AS status FROM j""",
)
def matching(t):
    return _resolved(t)[2]


@query("ending_counts")
def counts(t):
    rows, _, resolved = _resolved(t)
    lines = rows.withColumns({"name": F.col("cell2"), "qty": F.when(F.col("row_no") % 6 == 0, "").otherwise(F.col("row_no").cast("string"))})
    return m.ending_counts(lines, resolved, "row_no", "name", "qty").select("row_no", "alias", "outcome", "counted")


@query("name_suggestions")
def suggestions(t):
    """Likely products for every distinct part name."""
    t.part.createOrReplaceTempView("part")
    return m.suggest_names(t.part, "p_name", t.spark.sql(_PRODUCTS))


_LEXICON = """SELECT DISTINCT initcap(p_name) || CASE WHEN length(p_name) % 2 = 0 THEN ' 24 Case' ELSE ' 40 Case' END AS standard_name, p_name AS spelling, 0 AS place FROM part
  UNION ALL SELECT DISTINCT initcap(p_name) || ' 32 Case', p_name || ' 32', 1 FROM part WHERE p_name LIKE 's%'"""


@query("product_classification")
def classified(t):
    """Every part described as its name, a size and a packaging word, classified against a lexicon of the part names."""
    t.part.createOrReplaceTempView("part")
    lines = t.part.select(F.concat_ws("", F.col("p_name"), F.lit(" "), F.when(F.col("p_size") % 4 == 0, "24PK").when(F.col("p_size") % 4 == 1, "32 ct").when(F.col("p_size") % 4 == 2, "").otherwise("40 cse")).alias("d"))
    return m.classify_products(lines, "d", t.spark.sql(_LEXICON))


@query("receipt_exceptions")
def receipt_exceptions(t):
    """What a person has to look at: count lines and receipt rows."""
    rows, _, resolved = _resolved(t)
    lines = rows.withColumns({"name": F.col("cell2"), "qty": F.when(F.col("row_no") % 6 == 0, "").otherwise(F.col("row_no").cast("string"))})
    counted = m.ending_counts(lines, resolved, "row_no", "name", "qty")
    return r.input_exceptions(counted, _recognized(t)[0])
