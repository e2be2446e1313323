"""Source reading, profiling and clean-up over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls, specrecon
from ..runtime import beside, cut, scratch_path
from ..functions.text import csv_safe, formula_safe
from ..sources import checks, delimited as d, grid as g, messages as ms, profile as p, sinks as s
from . import query
from .ledgers import A_SQL, B_SQL, ROLES, raw_ledgers

_REPORT = """SELECT o_orderkey AS pos, o_custkey % 5 AS f, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN ' Name' WHEN o_orderkey % 10 = 2 THEN 'Monday, January 5, 2026 10:30 AM GMT-06:00' WHEN o_orderkey % 10 = 3 THEN 'Total for x'
  ELSE 'row' END AS c1, CASE WHEN o_orderkey % 10 IN (0, 2) THEN '' WHEN o_orderkey % 10 = 1 THEN 'amount ' ELSE o_orderpriority END AS c2, CASE WHEN o_orderkey % 10 IN (0, 2) OR o_orderkey % 77 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'Po#' ELSE 'x' END AS c3 FROM orders"""
_HEAD = {"c1": "Name", "c2": "Amount", "c3": "PO #"}


def _report(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(_REPORT)


@query(
    "report_row_classes",
    """SELECT CASE o_orderkey % 10 WHEN 0 THEN 'blank' WHEN 1 THEN 'header' WHEN 2 THEN 'stamp' ELSE 'data' END AS row_class, count(*) AS n_rows FROM orders GROUP BY 1""",
)
def classes(t):
    return d.removal_counts(d.classify_rows(_report(t), _HEAD))


@query(
    "subtotal_rows",
    f"SELECT pos, CASE WHEN c1 LIKE 'Total for%' THEN 'labelled' WHEN c1 = '' OR coalesce(c3, '') = '' THEN 'incomplete' END AS subtotal FROM ({_REPORT})",
)
def subtotals(t):
    return d.mark_subtotals(_report(t), "c1", ["c2"], ["c1", "c2", "c3"]).select("pos", "subtotal")


@query(
    "section_headings",
    f"""WITH r AS (SELECT pos, f, CASE WHEN pos % 10 = 3 THEN 'S' || pos END AS h FROM ({_REPORT})), x AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY f ORDER BY pos) AS section FROM r)
    SELECT pos, section FROM x WHERE h IS NULL""",
)
def headings(t):
    rows = _report(t)
    heading = F.when(F.col("pos") % 10 == 3, F.concat(F.lit("S"), F.col("pos").cast("string")))
    return d.fill_headings(rows, heading, ["f"], "pos").select("pos", "section")


@query(
    "first_table",
    f"""WITH r AS (SELECT pos, f, c1 = '' AND c2 = '' AND coalesce(c3, '') = '' AS b FROM ({_REPORT})), s AS (SELECT f, min(pos) AS st FROM r WHERE NOT b GROUP BY 1),
    e AS (SELECT r.f, min(pos) AS en FROM r JOIN s USING (f) WHERE b AND pos > st GROUP BY 1) SELECT pos FROM r JOIN s USING (f) LEFT JOIN e USING (f) WHERE pos >= st AND (en IS NULL OR pos < en)""",
)
def first(t):
    return d.first_table(_report(t), ["c1", "c2", "c3"], ["f"], "pos").select("pos")


_WIDE = "SELECT l_partkey AS product, " + ", ".join(
    f"CAST(sum(CASE WHEN month(l_shipdate) = {n} THEN l_quantity END) AS STRING) AS `P{n:02d}`, CAST(sum(CASE WHEN month(l_shipdate) = {n} THEN l_extendedprice END) AS STRING) AS `{n:02d}V`" for n in range(1, 13)
) + " FROM lineitem GROUP BY l_partkey"


@query(
    "master_grid_long",
    """SELECT product, period, kind, round(value, 2) AS value FROM (SELECT l_partkey AS product, CAST(month(l_shipdate) AS INT) AS period, 'qty' AS kind, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT l_partkey, CAST(month(l_shipdate) AS INT), 'value', sum(l_extendedprice) FROM lineitem GROUP BY 1, 2)""",
)
def melted(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return g.melt_grid(t.spark.sql(_WIDE), ["product"]).filter("value IS NOT NULL").withColumn("value", F.round("value", 2))


_CELLS = "SELECT o_custkey AS product, CAST(month(o_orderdate) AS INT) AS period, 'qty' AS kind, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE {} GROUP BY o_custkey, month(o_orderdate)"


@query(
    "grid_upsert",
    f"""WITH o AS ({_CELLS.format('o_custkey % 4 <> 0')}), n AS ({_CELLS.format("o_orderstatus = 'O'")}) SELECT product, period, kind, coalesce(n.value, o.value) AS value FROM o FULL JOIN (SELECT * FROM n WHERE product IN (SELECT product FROM o)) n USING (product, period, kind)""",
)
def upsert(t):
    t.orders.createOrReplaceTempView("orders")
    return g.upsert_grid(t.spark.sql(_CELLS.format("o_custkey % 4 <> 0")), t.spark.sql(_CELLS.format("o_orderstatus = 'O'")), "product")


@query(
    "source_profile",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE amount_text <> 'n/a') AS readable_amounts, min(txn_date) AS first_day, max(txn_date) AS last_day, CAST(min(CAST(period AS INT)) AS INT) AS first_period, CAST(max(CAST(period AS INT)) AS INT) AS last_period FROM ({A_SQL})""",
)
def profiled(t):
    out = p.profile(raw_ledgers(t)[0], "amount_text", "txn_date", "period").drop("total_cents")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("source_fingerprint", "SELECT true AS order_free, true AS content_bound")
def fingerprints(t):
    """The fingerprint ignores row order and notices one changed cell, over the whole table."""
    one = p.fingerprint(t.orders).select(F.col("content").alias("c1"))
    two = p.fingerprint(t.orders.orderBy(F.desc("o_totalprice"))).select(F.col("content").alias("c2"))
    three = p.fingerprint(t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == 0, -1).otherwise(F.col("o_custkey")))).select(F.col("content").alias("c3"))
    return one.transform(beside, two).transform(beside, three).select((F.col("c1") == F.col("c2")).alias("order_free"), (F.col("c1") != F.col("c3")).alias("content_bound"))


@query(
    "period_column_profile",
    "SELECT 'l_linenumber' AS \"column\", count(*) AS populated, count(*) AS valid, count(*) AS n_rows, true AS strict FROM lineitem UNION ALL SELECT 'l_quantity', count(*), count(*) FILTER (WHERE l_quantity BETWEEN 1 AND 13), count(*), false FROM lineitem",
)
def periods(t):
    return p.period_profile(t.lineitem, ["l_linenumber", "l_quantity"])


@query(
    "validation_report",
    f"""WITH x AS (SELECT count(*) AS n, count(*) FILTER (WHERE amount_text <> 'n/a') AS a FROM ({A_SQL})) SELECT 'Usable data rows' AS "check", 'PASS' AS status, n AS details FROM x UNION ALL SELECT 'Distinct mapping fields', 'PASS', 3 FROM x
    UNION ALL SELECT 'Amount field parseability', 'PASS', a FROM x UNION ALL SELECT 'Reference availability', 'PASS', n FROM x UNION ALL SELECT 'Fiscal period values', 'PASS', n FROM x""",
)
def validation(t):
    return p.validation_report(raw_ledgers(t)[0], ROLES)


@query(
    "known_files",
    "SELECT sha256(CAST(o_custkey AS VARCHAR)) AS sha256, 'same file on two sides' AS finding, NULL AS run_ref FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT sha256(CAST(o_custkey AS VARCHAR)), 'used before', 'RUN-' || (o_custkey % 7) FROM orders WHERE o_custkey % 10 = 0",
)
def known(t):
    files = t.orders.select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"))
    runs = t.customer.filter("c_custkey % 10 = 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"), F.concat(F.lit("RUN-"), (F.col("c_custkey") % 7).cast("string")).alias("run_ref"))
    return p.known_files(files, runs)


@query(
    "version_log",
    """WITH l AS (SELECT o_custkey AS scope, o_orderkey AS version, CASE WHEN o_orderkey % 9 = 0 THEN 'clear' ELSE 'save' END AS kind FROM orders), c AS (SELECT scope, max(version) AS cl FROM l WHERE kind = 'clear' GROUP BY 1),
    r AS (SELECT l.*, row_number() OVER (PARTITION BY scope ORDER BY version DESC) AS k FROM l LEFT JOIN c USING (scope) WHERE kind = 'save' AND (cl IS NULL OR version > cl))
    SELECT scope, version, CASE WHEN k = 1 THEN 'current' ELSE 'backup ' || (k - 1) END AS standing FROM r WHERE k <= 3""",
)
def versions(t):
    log = t.orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 9 == 0, "clear").otherwise("save").alias("kind"))
    return p.version_log(log).select("scope", "version", "standing")


@query(
    "formula_safe_text",
    """SELECT doc_id, k, CASE WHEN regexp_matches(x, '^[=+\\-@]') THEN '''' || x ELSE x END AS safe FROM (SELECT doc_id, 1 AS k, text AS x FROM documents UNION ALL SELECT doc_id, 2, '=' || lang FROM documents)""",
)
def safe(t):
    head = t.documents.select("doc_id", F.lit(1).alias("k"), F.col("text").alias("x"))
    both = head.unionByName(t.documents.select("doc_id", F.lit(2).alias("k"), F.concat(F.lit("="), "lang").alias("x")))
    return both.select("doc_id", "k", formula_safe("x").alias("safe"))


@query(
    "csv_safe_log",
    """SELECT doc_id, CASE WHEN regexp_matches(x, '^\\s*[=+\\-@]') THEN '''' || x ELSE x END AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  -' || lang ELSE source END AS x FROM documents)""",
)
def csv(t):
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  -"), "lang")).otherwise(F.col("source"))
    return t.documents.select("doc_id", csv_safe(x).alias("safe"))


@query(
    "output_groups",
    "SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'New Vendors' WHEN o_orderkey % 7 = 0 THEN 'Unclassified' ELSE o_orderstatus END AS output_group, count(*) AS n_rows FROM orders GROUP BY 1",
)
def groups(t):
    rows = t.orders.select((F.col("o_orderkey") % 6 == 0).alias("new_vendor"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderstatus")).alias("taxability"))
    return s.with_output_group(rows).groupBy("output_group").agg(F.count("*").alias("n_rows"))


@query(
    "normalized_messages",
    """SELECT conv_id || '-' || turn AS id, lower(role) AS mailbox, CASE WHEN turn % 2 = 0 THEN 'https://x.org/' || turn ELSE '' END AS web_link, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS n_attachments FROM conversations WHERE turn % 4 <> 3""",
)
def normalized(t):
    name = F.when(F.col("turn") % 3 != 0, F.col("role"))
    raw = t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.upper("role").alias("mailbox"), F.when(F.col("turn") % 4 == 3, "not a date").otherwise("2026-01-05 10:00:00").alias("received_on"),
        F.lit(None).cast("string").alias("folder"), F.col("role").alias("from_addr"), F.col("role").alias("to_addr"), F.col("text").alias("subject"), F.col("text").alias("preview"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://x.org/"), F.col("turn").cast("string"))).otherwise("http://x.org").alias("web_link"),
        F.array(F.struct(name.alias("name"), F.col("text").alias("text"))).alias("attachments"),
    )
    return ms.normalize_messages(raw)[0].select("id", "mailbox", "web_link", F.size("attachments").alias("n_attachments"))


@query(
    "messages_skipped",
    "SELECT count(*) AS skipped FROM conversations WHERE turn % 4 = 3",
)
def skipped(t):
    raw = t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("mailbox"), F.when(F.col("turn") % 4 == 3, "soon").otherwise("2026-01-05").alias("received_on"),
        *[F.lit("").alias(x) for x in ("folder", "from_addr", "to_addr", "subject", "preview", "web_link")], F.array(F.struct(F.col("role").alias("name"), F.col("text").alias("text"))).alias("attachments"),
    )
    return ms.normalize_messages(raw)[1].agg(F.count("*").alias("skipped"))


def _sql_digest(name: str, table: str, columns: list[str]) -> str:
    """The digest of a table of numbers and texts, as one row."""
    names = sorted(columns)
    cells = [f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in names]
    words = [f"CAST(coalesce(sum(CAST(('0x' || substr(h, {8 * k + 1}, 8)) AS BIGINT)), 0) AS VARCHAR)" for k in range(4)]
    parts = [f"'{','.join(names)}'", "CAST(count(*) AS VARCHAR)", *words]
    return (
        f"SELECT '{name}' AS table_name, '{','.join(names)}' AS columns, count(*) AS n_rows, sha256({' || chr(124) || '.join(parts)}) AS digest "
        f"FROM (SELECT md5({' || chr(124) || '.join(cells)}) AS h FROM {table})"
    )


_PROVED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "documents": ["doc_id", "lang", "source", "n_chars"],
}


@query("table_digests", " UNION ALL ".join(_sql_digest(k, k, v) for k, v in _PROVED.items()))
def digests(t):
    """What a run record proves of whole tables, whatever the order of their rows."""
    parts = [controls.table_digest(getattr(t, name), name, columns) for name, columns in _PROVED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FACTS = "SELECT count(*) AS n_orders, CAST(sum(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders"
_RUNS = (("RUN-1", "2026-01-05T10:00:00", "", "PASS"), ("RUN-2", "2026-02-02T09:30:00", "=J", "FAIL"))


@query(
    "run_log",
    f"""WITH facts AS ({_FACTS}), tables AS ({" UNION ALL ".join(_sql_digest(k, k, v) for k, v in _PROVED.items())}),
    listed AS (SELECT table_name AS role, digest AS sha256 FROM tables), files AS ({_sql_digest("inputs", "listed", ["role", "sha256"])}),
    runs AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _RUNS)}) r(run_ref, ran_at, who, control_status)),
    rec AS (SELECT run_ref, ran_at, CASE WHEN who = '' THEN 'Unverified' ELSE who END AS ran_by, control_status, '{{"n_orders":' || n_orders || ',"cents":' || cents || '}}' AS measures,
      '{{"n":' || n_rows || ',"digest":"' || digest || '"}}' AS inputs FROM runs, facts, files),
    whole AS (SELECT *, '{{"run_ref":"' || run_ref || '","ran_at":"' || ran_at || '","ran_by":"' || ran_by || '","fiscal_year":2026,"fiscal_period":1,"control_status":"' || control_status || '","measures":"' || replace(measures, '"', '\\"')
      || '","mapping":"{{}}","inputs":"' || replace(inputs, '"', '\\"') || '"}}' AS j FROM rec)
    SELECT run_ref, ran_at, CASE WHEN starts_with(ran_by, '=') THEN chr(39) || ran_by ELSE ran_by END AS ran_by, '2026' AS fiscal_year, '1' AS fiscal_period, control_status, measures, '{{}}' AS mapping, inputs, sha256(j) AS digest FROM whole""",
)
def run_log(t):
    """Two run records over whole tables, appended one after the other, read back and made safe for a spreadsheet."""
    t.orders.createOrReplaceTempView("orders")
    path = scratch_path(t.spark, "run-log")
    inputs = cut(s.proved({name: getattr(t, name).select(*columns) for name, columns in _PROVED.items()}), "inputs")
    for ref, at, who, status in _RUNS:
        s.append_run(s.run_record(t.spark.sql(_FACTS), ref, at, who, 2026, 1, status, "{}", inputs), path)
    return s.log_csv(t.spark.read.parquet(path))


@query(
    "template_versions",
    """WITH one AS (SELECT c_name AS template_id, c_mktsegment || ' by ' || c_nationkey AS spec, c_custkey AS k FROM customer),
    two AS (SELECT template_id, k, CASE WHEN k % 3 = 0 THEN spec || ' again' ELSE spec END AS spec2, spec FROM one),
    three AS (SELECT *, 1 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS v FROM two),
    done AS (SELECT template_id, k, CASE WHEN k % 2 = 0 THEN v + CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 1 ELSE 0 END ELSE v END AS version, CASE WHEN k % 2 = 0 THEN spec2 ELSE spec END AS spec,
      k % 5 = 0 AND k % 2 <> 0 AS archived FROM three)
    SELECT template_id, CAST(version AS INT) AS version, spec, sha256(spec) AS digest FROM done WHERE NOT archived""",
)
def versions(t):
    """Every customer's template saved, each fifth archived, each second saved again: what is current then."""
    key = F.col("c_custkey")
    spec = F.concat("c_mktsegment", F.lit(" by "), F.col("c_nationkey").cast("string"))
    first = t.customer.select(F.col("c_name").alias("template_id"), spec.alias("spec"), key.alias("k"))
    store = cut(specrecon.save_all(t.spark.createDataFrame([], specrecon.STORE), first), "store")
    store = cut(specrecon.archive(store, first.filter("k % 5 = 0")), "store")
    again = first.filter("k % 2 = 0").withColumn("spec", F.when(F.col("k") % 3 == 0, F.concat("spec", F.lit(" again"))).otherwise(F.col("spec")))
    return specrecon.current(specrecon.save_all(store, again))


_SHOWN = "CAST(coalesce(to_json(list_transform(list(x.item ORDER BY x.spot, x.item)[1:10], lambda y: CAST(y AS VARCHAR))), '[]') AS VARCHAR)"
_FILE = """SELECT 'S' || l_suppkey AS vendor, CAST(l_shipdate AS STRING) AS invoice_date, CAST(l_orderkey AS STRING) AS transaction_no, l_returnflag AS description, CAST(l_partkey AS STRING) AS account,
  '' AS centre, CASE WHEN l_partkey % 19 = 0 THEN 'see note' WHEN l_partkey % 23 = 0 THEN ' ' ELSE CAST(l_extendedprice AS STRING) END AS amount, '' AS tax, '' AS reference, CAST(l_linenumber AS STRING) AS cost_code, '1' AS period,
  l_orderkey * 8 + l_linenumber AS source_pos FROM lineitem"""


def _as_text(lines):
    return lines.withColumn("examples", F.to_json("examples"))


@query(
    "cleanup_input_checks",
    f"""WITH src AS (SELECT *, source_pos AS spot, CAST(source_pos AS VARCHAR) AS item FROM ({_FILE})),
    r AS (SELECT 'Blank amounts' AS "check", spot, item FROM src WHERE trim(amount) = '' UNION ALL SELECT 'Amounts that are no number', spot, item FROM src WHERE amount = 'see note'),
    n AS (SELECT unnest(['Blank amounts', 'Amounts that are no number']) AS "check")
    SELECT 'Source Transactions' AS dataset, n."check", CASE WHEN count(x.spot) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(x.spot) AS n_rows, CASE WHEN count(x.spot) = 0 THEN '[]' ELSE {_SHOWN} END AS examples FROM n LEFT JOIN r x USING ("check") GROUP BY 2
    UNION ALL SELECT d, 'Rows', 'PASS', 0, '[]' FROM (SELECT unnest(['Source Transactions', 'Vendor Mapping', 'Trial Balance']) AS d)
    UNION ALL SELECT * FROM (VALUES ('Source Transactions', 'Columns', 'PASS', 11, '[]'), ('Source Transactions', 'Blank headers', 'PASS', 0, '[]'), ('Source Transactions', 'Repeated headers', 'PASS', 0, '[]'),
      ('Source Transactions', 'Columns in their place', 'WARNING', 1, '["Cost Center: read from column 6, looks like column 10"]'),
      ('Vendor Mapping', 'Columns', 'FAIL', 4, '["at least 5 are required"]'), ('Vendor Mapping', 'Blank headers', 'PASS', 0, '[]'), ('Vendor Mapping', 'Repeated headers', 'PASS', 0, '[]'), ('Vendor Mapping', 'Columns in their place', 'PASS', 0, '[]'),
      ('Trial Balance', 'Columns', 'PASS', 3, '[]'), ('Trial Balance', 'Blank headers', 'PASS', 0, '[]'), ('Trial Balance', 'Repeated headers', 'PASS', 0, '[]'), ('Trial Balance', 'Columns in their place', 'PASS', 0, '[]'))""",
)
def cleanup_inputs(t):
    """Order lines as a transaction file with unreadable and blank amounts and a column that seems misplaced."""
    t.lineitem.createOrReplaceTempView("lineitem")
    mapping = t.supplier.select(F.col("s_name").alias("name"), "s_suppkey", "s_nationkey", F.lit("T").alias("taxability"))
    accounts = t.part.select("p_partkey", "p_name", "p_size")
    return _as_text(checks.cleanup_checks(t.spark.sql(_FILE), mapping, accounts))


_GRID = """SELECT CASE WHEN l_partkey % 29 = 0 THEN l_partkey + 1 ELSE l_partkey END AS product, CASE WHEN l_partkey % 13 = 0 THEN 'n/a' ELSE CAST(sum(CASE WHEN month(l_shipdate) = 5 THEN l_quantity END) AS STRING) END AS `05`,
  CAST(sum(CASE WHEN month(l_shipdate) = 6 THEN l_quantity ELSE 0 END) - CASE WHEN l_partkey % 11 = 0 THEN 1000 ELSE 0 END AS STRING) AS `06` FROM lineitem WHERE l_partkey % 31 <> 0 GROUP BY l_partkey"""


@query(
    "grid_input_checks",
    f"""WITH g AS ({_GRID.replace('`', '"')}), r AS (
      SELECT 'Repeated products' AS "check", product AS spot FROM g GROUP BY product HAVING count(*) > 1 UNION ALL SELECT 'Missing products', p_partkey FROM part WHERE p_partkey NOT IN (SELECT product FROM g)
      UNION ALL SELECT 'Quantities of period 05 that are blank or no number', product FROM g WHERE TRY_CAST("05" AS DOUBLE) IS NULL UNION ALL SELECT 'Quantities of period 05 below zero', product FROM g WHERE TRY_CAST("05" AS DOUBLE) < 0
      UNION ALL SELECT 'Quantities of period 06 that are blank or no number', product FROM g WHERE TRY_CAST("06" AS DOUBLE) IS NULL UNION ALL SELECT 'Quantities of period 06 below zero', product FROM g WHERE TRY_CAST("06" AS DOUBLE) < 0),
    q AS (SELECT "check", spot, CAST(spot AS VARCHAR) AS item FROM r),
    n AS (SELECT unnest(['Repeated products', 'Missing products', 'Quantities of period 05 that are blank or no number', 'Quantities of period 05 below zero', 'Quantities of period 06 that are blank or no number', 'Quantities of period 06 below zero']) AS "check")
    SELECT 'Master Grid' AS dataset, n."check", CASE WHEN count(x.spot) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(x.spot) AS n_rows, CASE WHEN count(x.spot) = 0 THEN '[]' ELSE {_SHOWN} END AS examples FROM n LEFT JOIN q x USING ("check") GROUP BY 2
    UNION ALL SELECT 'Master Grid', 'Column of period 05', 'PASS', 0, '[]' UNION ALL SELECT 'Master Grid', 'Column of period 06', 'PASS', 0, '[]'""",
)
def grid_inputs(t):
    """Shipped quantities as a master grid with repeated, missing, unreadable and negative products."""
    t.lineitem.createOrReplaceTempView("lineitem")
    return _as_text(checks.grid_checks(t.spark.sql(_GRID), t.part.select(F.col("p_partkey").alias("product")), "product", 6))


@query(
    "arrival_checks",
    f"""WITH x AS (SELECT CASE WHEN source_pos % 97 = 0 THEN NULL WHEN source_pos % 89 = 0 THEN 'blank' ELSE 'data' END AS k, txn_date <> '1998-01-01' AND source_pos % 5 <> 0 AS u, amount_text AS t,
      CASE WHEN starts_with(amount_text, '(') THEN -1 ELSE 1 END * CAST(ROUND(TRY_CAST(regexp_replace(amount_text, '[$, ()]', '', 'g') AS DECIMAL(28,6)), 2) * 100 AS BIGINT) AS c FROM ({B_SQL})),
    s AS (SELECT count(*) FILTER (WHERE k IS NULL) AS lost, count(*) FILTER (WHERE k = 'data' AND u) AS taken, coalesce(sum(c) FILTER (WHERE k = 'data' AND u), 0) AS tc, count(*) FILTER (WHERE k = 'blank') AS rem,
      count(*) FILTER (WHERE k = 'data' AND NOT u) AS lft, coalesce(sum(c) FILTER (WHERE k = 'data' AND NOT u), 0) AS lc, count(*) FILTER (WHERE k = 'data' AND u AND trim(t) = '') AS b, count(*) FILTER (WHERE k = 'data' AND u AND trim(t) <> '' AND c IS NULL) AS un,
      count(*) FILTER (WHERE k = 'data' AND u AND c = 0) AS z, count(*) FILTER (WHERE k = 'data' AND u AND c < 0) AS cr, coalesce(sum(c) FILTER (WHERE k = 'data' AND u AND c < 0), 0) AS cc FROM x)
    SELECT 'Ledger B' AS dataset, 'Rows that are not accounted for' AS "check", CASE WHEN lost > 0 THEN 'FAIL' ELSE 'PASS' END AS status, lost AS n_rows, CAST(0 AS BIGINT) AS cents FROM s
    UNION ALL SELECT 'Ledger B', 'Rows used', CASE WHEN taken = 0 THEN 'FAIL' ELSE 'PASS' END, taken, CAST(tc AS BIGINT) FROM s UNION ALL SELECT 'Ledger B', 'Rows removed by clean-up', 'PASS', rem, 0 FROM s
    UNION ALL SELECT 'Ledger B', 'Amount in rows left out', CASE WHEN lc <> 0 THEN 'WARNING' ELSE 'PASS' END, lft, CAST(lc AS BIGINT) FROM s UNION ALL SELECT 'Ledger B', 'Blank amounts', CASE WHEN b > 0 THEN 'WARNING' ELSE 'PASS' END, b, 0 FROM s
    UNION ALL SELECT 'Ledger B', 'Unreadable amounts', CASE WHEN un > 0 THEN 'WARNING' ELSE 'PASS' END, un, 0 FROM s UNION ALL SELECT 'Ledger B', 'Zero amounts', 'PASS', z, 0 FROM s
    UNION ALL SELECT 'Ledger B', 'Credits and negative amounts', 'PASS', cr, CAST(cc AS BIGINT) FROM s""",
)
def arrival(t):
    """The second ledger with rows that lost their class and rows that are left out."""
    rows = raw_ledgers(t)[1].withColumn("row_class", F.when(F.col("source_pos") % 97 == 0, None).when(F.col("source_pos") % 89 == 0, "blank").otherwise("data"))
    return checks.arrival_checks("Ledger B", rows, (F.col("txn_date") != "1998-01-01") & (F.col("source_pos") % 5 != 0), "amount_text")
