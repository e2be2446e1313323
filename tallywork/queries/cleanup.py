"""Transaction clean-up, mapping and vendor-list queries: order lines as transactions, suppliers as vendors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleanup as c, tax
from ..runtime import cut
from . import query

_SOURCE = """SELECT ' Supplier#' || CAST(l_suppkey AS STRING) || ' ' AS vendor, CAST(CAST(l_shipdate AS DATE) AS STRING) AS invoice_date,
  CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS STRING) || '.0' ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS transaction_id,
  l_returnflag AS description, CAST(l_partkey % 400 AS STRING) AS account, CASE WHEN l_partkey % 50 = 0 THEN 'bad' ELSE CAST(l_suppkey % 90 + 10 AS STRING) END AS cost_center,
  CAST(l_extendedprice AS STRING) AS amount, '' AS tax_code, '' AS reference,
  CASE WHEN l_partkey % 17 = 0 THEN 'x' ELSE '' END || CAST(l_partkey % 100 AS STRING) AS code, CAST(month(l_shipdate) AS INT) AS period,
  (((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey % 32768) * 4096 + (year(l_shipdate) * 366 + dayofyear(l_shipdate)) % 4096) AS source_pos FROM lineitem"""
_MAPPING = """SELECT 'Supplier#' || CAST(s_suppkey AS STRING) AS vendor_name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'T' || CAST(s_nationkey % 3 AS STRING) END AS taxability,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'G' || CAST(s_nationkey % 5 AS STRING) END AS grouping, s_suppkey * 2 AS source_pos FROM supplier WHERE s_suppkey % 7 <> 0
  UNION ALL SELECT 'SUPPLIER#' || CAST(s_suppkey AS STRING), 'T9', 'G9', s_suppkey * 2 + 1 FROM supplier WHERE s_suppkey % 5 = 0"""
_ACCOUNTS = """SELECT '001-' || rpad(CAST(c AS STRING), 5, '0') || '-' || rpad(CAST(a AS STRING), 6, '0') || '-000' AS gl_account, 'Account ' || CAST(a AS STRING) AS account_name, c * 1000 + a AS source_pos
  FROM (SELECT DISTINCT l_suppkey % 90 + 10 AS c, l_partkey % 400 AS a FROM lineitem WHERE l_partkey % 3 <> 0)"""
_EXCLUDED = """SELECT 'Supplier#3, supplier#9; Supplier#27' AS pasted FROM region WHERE r_regionkey = 0"""

_VK = r"upper(regexp_replace(replace(trim({}), ' ', ''), '^(\d+)\.0+$', '\1'))"
_MARKED = f"""src AS MATERIALIZED (SELECT *, {_VK.format('vendor')} AS vendor_key, {_VK.format('transaction_id')} AS txn_key,
  regexp_matches(upper(code), '^[A-Z]') AS letter, {_VK.format('vendor')} IN ('SUPPLIER#3','SUPPLIER#9','SUPPLIER#27') AS excl FROM ({_SOURCE})),
firsts AS (SELECT txn_key, min(source_pos) AS first_pos FROM src WHERE NOT letter AND NOT excl GROUP BY 1),
marked AS MATERIALIZED (SELECT s.*, CASE WHEN letter THEN 'letter' WHEN excl THEN 'excluded' WHEN source_pos > first_pos THEN 'duplicate' ELSE 'keep' END AS drop_reason, first_pos
  FROM src s LEFT JOIN firsts USING (txn_key)),
mp AS (SELECT upper(vendor_name) AS vendor_key, arg_max(taxability, (CASE WHEN taxability <> '' THEN 1 ELSE 0 END) * 1000000000 + source_pos) AS taxability,
  arg_max(grouping, (CASE WHEN taxability <> '' THEN 1 ELSE 0 END) * 1000000000 + source_pos) AS grouping FROM ({_MAPPING}) GROUP BY 1),
kept AS MATERIALIZED (SELECT m.*, coalesce(taxability, '') AS taxability, coalesce(grouping, '') AS grouping, mp.vendor_key IS NOT NULL AS vendor_matched,
  CASE WHEN cost_center = 'bad' THEN '' ELSE '001-' || rpad(cost_center, 5, '0') || '-' || rpad(account, 6, '0') || '-000' END AS gl_account
  FROM marked m LEFT JOIN mp ON m.vendor_key = mp.vendor_key WHERE drop_reason = 'keep'),
enriched AS MATERIALIZED (SELECT k.*, coalesce(account_name, '') AS account_name, account_name IS NOT NULL AS gl_matched FROM kept k
  LEFT JOIN (SELECT gl_account, arg_max(account_name, source_pos) AS account_name FROM ({_ACCOUNTS}) GROUP BY 1) a ON a.gl_account = k.gl_account)"""


def _views(t):
    for name in ("lineitem", "supplier", "region", "orders", "customer", "part"):
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql


def _marked(t):
    sql = _views(t)
    return cut(c.mark_removals(sql(_SOURCE), c.membership(sql(_EXCLUDED), "pasted", "[,;]+")), "marked")


@query(
    "transaction_removals",
    f"WITH {_MARKED} SELECT source_pos, drop_reason, CASE WHEN drop_reason = 'duplicate' THEN first_pos END AS retained_pos FROM marked",
)
def removals(t):
    return _marked(t).select("source_pos", "drop_reason", "retained_pos")


@query(
    "transaction_removed_audit",
    f"""WITH {_MARKED} SELECT source_pos, CASE drop_reason WHEN 'letter' THEN 'Code begins with a letter' WHEN 'excluded' THEN 'Excluded vendor ID' ELSE 'Duplicate transaction ID' END AS removal_reason
    FROM marked WHERE drop_reason <> 'keep'""",
)
def audit(t):
    return c.removed_rows(_marked(t)).select("source_pos", "removal_reason")


def _enriched(t, marked):
    sql = _views(t)
    return c.enrich(marked, sql(_MAPPING), sql(_ACCOUNTS))


@query(
    "transaction_cleanup",
    f"WITH {_MARKED} SELECT source_pos, taxability, grouping, gl_account, account_name, NOT vendor_matched AS new_vendor FROM enriched",
)
def enriched(t):
    return _enriched(t, _marked(t)).select("source_pos", "taxability", "grouping", "gl_account", "account_name", "new_vendor")


@query(
    "transaction_statistics",
    f"""WITH {_MARKED}, l AS (SELECT count(*) FILTER (WHERE drop_reason = 'letter') AS letter_rows, count(*) FILTER (WHERE drop_reason = 'excluded') AS excluded_rows,
    count(*) FILTER (WHERE drop_reason = 'duplicate') AS duplicate_rows FROM marked)
    SELECT l.*, count(*) FILTER (WHERE vendor_matched) AS matched_vendor_rows, count(*) FILTER (WHERE NOT vendor_matched) AS new_vendor_rows,
    count(*) FILTER (WHERE gl_matched) AS matched_gl_rows, CAST(0 AS BIGINT) AS control_cents FROM enriched, l GROUP BY ALL""",
)
def statistics(t):
    marked = _marked(t)
    return c.cleanup_statistics(marked, _enriched(t, marked)).select(
        "letter_rows", "excluded_rows", "duplicate_rows", "matched_vendor_rows", "new_vendor_rows", "matched_gl_rows",
        (F.col("control_difference") * 100).cast("bigint").alias("control_cents"),
    )


@query(
    "kept_by_code",
    f"WITH {_MARKED} SELECT upper(code) AS code, count(*) AS n_rows FROM marked WHERE drop_reason = 'keep' GROUP BY 1 ORDER BY 1",
)
def by_code(t):
    return _marked(t).filter("drop_reason = 'keep'").groupBy(F.upper("code").alias("code")).agg(F.count("*").alias("n_rows")).orderBy("code")


@query(
    "mapping_lookup",
    f"WITH {_MARKED} SELECT vendor_key AS key, taxability, grouping FROM mp",
)
def lookup(t):
    from ..functions.identifiers import vendor_key

    return c.last_filled(_views(t)(_MAPPING), vendor_key("vendor_name"), ["taxability", "grouping"], "source_pos")


@query(
    "mapping_conflicts",
    f"""SELECT upper(vendor_name) AS key, count(DISTINCT taxability || '/' || grouping) AS combinations FROM ({_MAPPING}) WHERE taxability <> '' OR grouping <> ''
    GROUP BY 1 HAVING count(DISTINCT taxability || '/' || grouping) > 1""",
)
def conflicts(t):
    from ..functions.identifiers import vendor_key

    return c.value_conflicts(_views(t)(_MAPPING), vendor_key("vendor_name"), ["taxability", "grouping"]).select("key", "combinations")


@query(
    "account_name_conflicts",
    "SELECT upper(p_brand) AS key, count(DISTINCT upper(p_name)) AS names FROM part GROUP BY 1 HAVING count(DISTINCT upper(p_name)) > 1",
)
def account_conflicts(t):
    from ..functions.identifiers import vendor_key

    return c.name_conflicts(t.part, vendor_key("p_brand"), "p_name")


@query(
    "classification_problems",
    """WITH n AS (SELECT 'Supplier#' || CAST(s_suppkey % 60 AS VARCHAR) AS vendor, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'T' END AS taxability, CASE WHEN s_suppkey % 8 = 0 THEN ' ' ELSE 'G' END AS grouping FROM supplier),
    m AS (SELECT DISTINCT upper(vendor_name) AS k FROM (SELECT 'Supplier#' || CAST(s_suppkey AS VARCHAR) AS vendor_name FROM supplier WHERE s_suppkey % 9 = 0))
    SELECT upper(vendor) AS key, 'Missing Taxability' AS problem FROM n WHERE trim(taxability) = '' UNION ALL SELECT upper(vendor), 'Missing Grouping' FROM n WHERE trim(grouping) = ''
    UNION ALL SELECT upper(vendor), 'Duplicate vendor within the classification table' FROM n GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT upper(vendor), 'Already present in the mapping file' FROM n WHERE upper(vendor) IN (SELECT k FROM m)""",
)
def problems(t):
    sup = t.supplier
    fresh = sup.select(
        F.concat(F.lit("Supplier#"), (F.col("s_suppkey") % 60).cast("string")).alias("vendor"),
        F.when(F.col("s_suppkey") % 6 == 0, "").otherwise("T").alias("taxability"),
        F.when(F.col("s_suppkey") % 8 == 0, " ").otherwise("G").alias("grouping"),
    )
    known = sup.filter("s_suppkey % 9 = 0").select(F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("vendor_name"))
    return c.classification_problems(fresh, known)


@query("controlled_vocabulary", "SELECT DISTINCT trim(c_mktsegment) AS value FROM customer WHERE trim(c_mktsegment) <> '' ORDER BY 1")
def vocabulary(t):
    return c.vocabulary(t.customer, "c_mktsegment")


_OLD = "SELECT CAST(c_custkey AS STRING) AS vendor_id, c_name AS vendor_name, c_mktsegment AS taxability, '' AS grouping, c_custkey AS source_pos FROM customer WHERE c_custkey % 10 <> 0"
_NEW = """SELECT CAST(c_custkey AS STRING) || '.0' AS vendor_id, CASE WHEN c_custkey % 8 = 0 THEN c_name || ' LLC' WHEN c_custkey % 3 = 0 THEN lower(c_name) || ' ' ELSE c_name END AS vendor_name,
  c_custkey AS source_pos FROM customer WHERE c_custkey % 11 <> 0"""
_DIFF = f"""d AS (SELECT coalesce(o.vendor_id, replace(n.vendor_id, '.0', '')) AS key, CASE WHEN o.vendor_id IS NULL THEN 'added' WHEN n.vendor_id IS NULL THEN 'removed'
  WHEN upper(trim(o.vendor_name)) <> upper(trim(n.vendor_name)) THEN 'renamed' ELSE 'unchanged' END AS change, coalesce(n.vendor_name, o.vendor_name) AS nm, coalesce(taxability, '') AS taxability
  FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.vendor_id = replace(n.vendor_id, '.0', ''))"""


@query("vendor_list_diff", f"WITH {_DIFF} SELECT key, change FROM d")
def diff(t):
    sql = _views(t)
    return c.diff_vendors(sql(_OLD), sql(_NEW)).select("key", "change")


@query(
    "rebuilt_mapping",
    f"WITH {_DIFF} SELECT nm AS vendor_name, taxability, CASE WHEN change = 'removed' THEN 'Inactive' ELSE 'Active' END AS status FROM d",
)
def rebuilt(t):
    sql = _views(t)
    return c.rebuilt_mapping(c.diff_vendors(sql(_OLD), sql(_NEW)), include_inactive=True).select("vendor_name", "taxability", "status")


@query(
    "appended_mapping",
    f"SELECT status, count(*) AS n_rows FROM (SELECT vendor_name, NULL AS status FROM ({_MAPPING}) UNION ALL SELECT s_name, 'Active' FROM supplier) GROUP BY 1",
)
def appended(t):
    sql = _views(t)
    fresh = t.supplier.select(F.col("s_name").alias("vendor"), F.lit("T").alias("taxability"), F.lit("G").alias("grouping"))
    return c.appended_mapping(sql(_MAPPING), fresh).groupBy("status").agg(F.count("*").alias("n_rows"))


_RATES = """SELECT CAST(n_nationkey AS STRING) AS location, CAST(n_nationkey % 3 * 0.5 AS DECIMAL(9,4)) AS city_rate, CAST(n_regionkey * 0.25 AS DECIMAL(9,4)) AS county_rate,
  CAST(0 AS DECIMAL(9,4)) AS district_rate, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 0 END AS DECIMAL(9,4)) AS combined_rate FROM nation"""
_SALES = """SELECT o_orderkey AS sale, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(c_nationkey AS STRING) AS location, o_orderkey % 3 = 0 AS saas FROM orders JOIN customer ON o_custkey = c_custkey"""
_TAXED = f"""t AS (SELECT *, CAST(ROUND(price * CASE WHEN saas THEN 0.80 ELSE 1.00 END, 2) AS DECIMAL(18,2)) AS taxable FROM ({_SALES}) JOIN ({_RATES}) USING (location)),
x AS (SELECT *, ROUND(taxable * 6.25 / CAST(100 AS DECIMAL(3,0)), 2) AS state0 FROM t)"""


def _cents_of(rate: str) -> str:
    # Exact half-up cents of taxable * rate percent, in whole units of 1e-6 dollars.
    return f"CAST(FLOOR((CAST(taxable * 100 AS HUGEINT) * CAST({rate} * 10000 AS HUGEINT) + 500000) / 1000000) AS BIGINT)"


_LINES = f"""{_TAXED}, y AS (SELECT sale, CAST(taxable * 100 AS BIGINT) AS taxable_cents, {_cents_of('CAST(6.25 AS DECIMAL(9,4))').replace('/ 1000000', '// 1000000')} AS state_cents,
  {_cents_of('combined_rate').replace('/ 1000000', '// 1000000')} + {_cents_of('city_rate').replace('/ 1000000', '// 1000000')} + {_cents_of('county_rate').replace('/ 1000000', '// 1000000')} + {_cents_of('district_rate').replace('/ 1000000', '// 1000000')} AS local_cents,
  city_rate + county_rate + district_rate + combined_rate > 2 AS over_cap FROM t)"""


@query(
    "sales_tax",
    f"WITH {_LINES} SELECT sale, taxable_cents, state_cents, local_cents, state_cents + local_cents AS total_cents, over_cap FROM y",
)
def taxed(t):
    sql = _views(t)
    t.nation.createOrReplaceTempView("nation")
    out = tax.sales_tax(sql(_SALES), sql(_RATES))

    def whole(name):
        return (F.col(name) * 100).cast("bigint")

    return out.select(
        "sale", whole("taxable").alias("taxable_cents"), whole("state_tax").alias("state_cents"), whole("local_tax").alias("local_cents"),
        whole("total_tax").alias("total_cents"), "over_cap",
    )


@query(
    "sales_tax_by_location",
    f"""WITH t AS (SELECT r.*, saas, CAST(ROUND(p.price * CASE WHEN saas THEN 0.80 ELSE 1.00 END, 2) AS DECIMAL(18,2)) AS taxable FROM (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) p
    CROSS JOIN ({_RATES}) r CROSS JOIN (SELECT unnest([true, false]) AS saas)), y AS (SELECT location, saas, {_cents_of('CAST(6.25 AS DECIMAL(9,4))').replace('/ 1000000', '// 1000000')} AS s FROM t)
    SELECT location, saas, count(*) AS n_rows, CAST(sum(s) AS BIGINT) AS state_cents FROM y GROUP BY 1, 2""",
)
def by_location(t):
    sql = _views(t)
    t.nation.createOrReplaceTempView("nation")
    prices = t.orders.select(F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    out = tax.compare_locations(prices, sql(_RATES))
    return out.groupBy("location", "saas").agg(F.count("*").alias("n_rows"), F.sum((F.col("state_tax") * 100).cast("bigint")).alias("state_cents"))


@query(
    "section_search",
    """WITH d AS (SELECT doc_id, source AS title, text AS summary, string_split(text, chr(10)) AS sections FROM documents),
    f AS (SELECT *, list_filter(sections, lambda s: contains(lower(title) || ' ' || lower(s), 'the') AND contains(lower(title) || ' ' || lower(s), 'and')) AS own,
      contains(lower(title || ' ' || summary), 'the') AND contains(lower(title || ' ' || summary), 'and') AS whole FROM d),
    g AS (SELECT doc_id, CASE WHEN len(own) = 0 AND whole THEN len(sections) ELSE len(own) END AS found, len(sections) AS total_sections FROM f)
    SELECT doc_id, CAST(found AS INT) AS found, CAST(total_sections AS INT) AS total_sections FROM g WHERE found > 0""",
)
def sections(t):
    """Lines of every document as its sections; lines with both words stay, or all of them if only the text as a whole has both."""
    docs = t.documents.select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("summary"), F.split("text", "\n").alias("sections")
    )
    return tax.search_sections(docs, "the and").select("doc_id", F.size("found").alias("found"), "total_sections")


@query(
    "provision_labels",
    r"""WITH c AS (SELECT l_partkey AS k, 'Tax Code 151.' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || '; 34 TAC 3.' || CAST(l_linenumber AS VARCHAR) || '; Pub. 94-' || CAST(l_linenumber AS VARCHAR) AS txt FROM lineitem)
    SELECT DISTINCT unnest(['Tax Code §151.' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0'), '34 TAC §3.' || CAST(l_linenumber AS VARCHAR), 'Comptroller Pub. 94-' || CAST(l_linenumber AS VARCHAR)]) AS label FROM lineitem""",
)
def provisions(t):
    cited = t.lineitem.select(
        F.concat(
            F.lit("Tax Code 151."), F.lpad(F.col("l_suppkey").cast("string"), 4, "0"), F.lit("; 34 TAC 3."),
            F.col("l_linenumber").cast("string"), F.lit("; Pub. 94-"), F.col("l_linenumber").cast("string"),
        ).alias("txt")
    )
    return cited.select(F.explode(tax.provision_labels("txt")).alias("label")).distinct()


@query(
    "mapping_gaps",
    "SELECT s_name AS vendor_name, 'Missing taxability' AS problem FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 UNION ALL SELECT s_name, 'Missing grouping' FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0",
)
def gaps(t):
    k = F.col("s_suppkey")
    return c.mapping_gaps(t.supplier.select(
        F.col("s_name").alias("vendor_name"), F.when(k % 4 == 0, " ").otherwise("T").alias("taxability"), F.when(k % 5 == 0, None).otherwise("G").alias("grouping"),
        F.when(k % 3 == 0, "Inactive").otherwise("Active").alias("status"),
    ))
