"""Scalar normalizers over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identifiers as ids, money, values
from . import query
from .ledgers import sql_no_prefix

_REFS = """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'PO ' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'P.O. # ' || CAST(o_orderkey AS STRING) || '-A' WHEN 2 THEN CAST(o_orderkey AS STRING) || '.0' WHEN 3 THEN '''00' || CAST(o_orderkey AS STRING)
  WHEN 4 THEN 'N/A' WHEN 5 THEN 'xxxx' WHEN 6 THEN '0000' WHEN 7 THEN 'po' || CAST(o_custkey AS STRING) ELSE '  ab ' || CAST(o_custkey AS STRING) || ' ' END AS ref FROM orders"""
_TEXT = "regexp_replace(trim(ref), '^''', '')"
_UP = rf"regexp_replace(upper({_TEXT}), '^([0-9]+)\.0+$', '\1')"


def _refs(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(_REFS.replace("'''00'", "\"'00\""))


@query("identifier_text", f"SELECT k, {_TEXT} AS text FROM ({_REFS})")
def text(t):
    return _refs(t).select("k", ids.identifier_text("ref").alias("text"))


@query(
    "identifier_flags",
    f"""SELECT k, CASE WHEN ref <> {_TEXT} AND {_TEXT} <> '' THEN 'SOURCE_TEXT_ADJUSTED' ELSE '' END AS adjusted, regexp_matches(replace(upper({_TEXT}), ' ', ''), '[^A-Z0-9]') AS punctuation FROM ({_REFS})""",
)
def flags(t):
    f = ids.identifier_flags("ref")
    return _refs(t).select("k", F.when(F.array_contains(f, "SOURCE_TEXT_ADJUSTED"), "SOURCE_TEXT_ADJUSTED").otherwise("").alias("adjusted"), F.array_contains(f, "PUNCTUATION_IGNORED").alias("punctuation"))


@query(
    "reference_keys",
    f"""WITH x AS (SELECT k, regexp_replace({sql_no_prefix(_UP)}, '[^A-Z0-9]', '', 'g') AS po, regexp_replace({_UP}, '[^A-Z0-9]', '', 'g') AS inv FROM ({_REFS}))
    SELECT k, po, inv, CASE WHEN po = '' THEN 'NONE' WHEN po IN ('NA') OR regexp_matches(po, '^0+$') OR (length(po) >= 4 AND po = repeat(po[1], length(po))) THEN 'WEAK' ELSE 'SPECIFIC' END AS strength FROM x""",
)
def keys(t):
    out = _refs(t).select("k", ids.po_key("ref").alias("po"), ids.alnum_key("ref").alias("inv"))
    return out.withColumn("strength", ids.reference_strength("po"))


@query(
    "reference_from_text",
    """WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'thanks' WHEN 1 THEN 'load for order ' || o_orderkey + 10000 WHEN 2 THEN 'PO' || o_orderkey + 10000 ELSE o_orderkey + 10000 || ' and ' || o_orderkey + 20000 END AS x FROM orders)
    SELECT k, CASE k % 4 WHEN 1 THEN CAST(k + 10000 AS VARCHAR) WHEN 2 THEN CAST(k + 10000 AS VARCHAR) ELSE '' END AS value, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'description' WHEN 2 THEN 'column' ELSE 'ambiguous' END AS how FROM d""",
)
def fallback(t):
    k = F.col("o_orderkey")
    a, b = (k + 10000).cast("string"), (k + 20000).cast("string")
    x = F.when(k % 4 == 0, "thanks").when(k % 4 == 1, F.concat(F.lit("load for order "), a)).when(k % 4 == 2, F.concat(F.lit("PO"), a)).otherwise(F.concat(a, F.lit(" and "), b))
    out = t.orders.select(k.alias("k"), x.alias("x")).withColumn("r", ids.reference_from_text("x", True))
    return out.select("k", "r.value", "r.how")


@query(
    "signed_cents",
    """SELECT k, CASE k % 4 WHEN 0 THEN c WHEN 1 THEN -c WHEN 2 THEN NULL ELSE c END AS cents FROM (SELECT o_orderkey AS k, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c FROM orders)""",
)
def cents(t):
    k, plain = F.col("o_orderkey"), F.format_number(F.col("o_totalprice"), 2)
    x = F.when(k % 4 == 0, F.concat(F.lit("$ "), plain)).when(k % 4 == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k % 4 == 2, F.concat(plain, F.lit(" USD"))).otherwise(F.concat(plain, F.lit("4")))
    return t.orders.select(k.alias("k"), money.cents(x).alias("cents"))


@query("accounting_numbers", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS number FROM orders")
def numbers(t):
    k, plain = F.col("o_orderkey"), F.format_number(F.col("o_totalprice"), 2)
    x = F.when(k % 3 == 0, F.concat(F.lit("($"), plain, F.lit(")"))).when(k % 3 == 1, plain).otherwise("NaN")
    return t.orders.select(k.alias("k"), money.accounting_number(x).alias("number"))


@query(
    "fiscal_labels",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 15 IN (0, 14) THEN 'Unspecified' ELSE 'P' || lpad(CAST(o_orderkey % 15 AS VARCHAR), 2, '0') || '-' || CASE o_orderkey % 2 WHEN 0 THEN '2026' ELSE '2031' END END AS label FROM orders",
)
def labels(t):
    p = (F.col("o_orderkey") % 15).cast("string")
    x = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("pd "), p)).otherwise(F.concat(p, F.lit("/31")))
    return t.orders.select(F.col("o_orderkey").alias("k"), dates.fiscal_label(x, 2026).alias("label"))


@query(
    "flexible_dates",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 IN (3, 9) OR o_orderkey % 11 = 6 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
)
def days(t):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    forms = {
        0: d.cast("string"), 1: F.date_format(d, "M/d/yyyy"), 2: serial, 3: F.lit("13/45/2020"), 4: F.date_format(d, "MMM d, yyyy"),
        5: F.date_format(d, "EEEE d MMMM yyyy"), 6: F.date_format(d, "dd/MM/yyyy"), 7: F.date_format(d, "yyyyMMdd"),
        8: F.concat(F.date_format(d, "d-MMM-yyyy"), F.lit(" 08:30:00")), 9: F.lit("Jan the 5th of 2026"), 10: F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy")),
    }
    x = F.coalesce(*[F.when(k % 11 == n, form) for n, form in forms.items()])
    # Day-first texts whose day may be a month as well are read month first: shown as null here, and by `date_readings` as open.
    read = dates.flexible_date(x)
    open_order = (k % 11 == 6) & (F.dayofmonth(d) <= 12) & (F.dayofmonth(d) != F.month(d))
    return t.orders.select(k.alias("k"), F.when(~open_order, read).cast("string").alias("day"))


@query(
    "date_readings",
    """SELECT o_orderkey AS k, strftime(CASE WHEN r = 'either order' THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate END, '%Y-%m-%d') AS day,
      CASE WHEN r = 'either order' THEN strftime(o_orderdate, '%Y-%m-%d') END AS other, r AS reading
    FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'month name' WHEN o_orderkey % 3 = 1 THEN 'year first' WHEN day(o_orderdate) = month(o_orderdate) THEN 'month first' WHEN day(o_orderdate) > 12 THEN 'day first' ELSE 'either order' END AS r FROM orders)""",
)
def readings(t):
    """Every order date as a text with a month name, the year in front, or the day in front: what it reads as, and what else it could be."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    x = F.when(k % 3 == 0, F.date_format(d, "d MMM yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy/M/d")).otherwise(F.date_format(d, "d.M.yyyy"))
    out = t.orders.select(k.alias("k"), dates.date_tokens(x).alias("tokens")).select("k", dates.read_date("tokens").alias("r"))
    return out.select("k", F.col("r.day").cast("string").alias("day"), F.col("r.other").cast("string").alias("other"), "r.reading")


@query(
    "layer_labels",
    "SELECT o_orderkey AS k, 'PD' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-26' AS source_period, strftime(o_orderdate, '%Y-%m-%d') AS first_day, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') AS last_day FROM orders",
)
def layers(t):
    d = F.col("o_orderdate").cast("date")
    x = F.concat(F.lit("PD"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lit("-26: "), F.date_format(d, "MM/dd/yyyy"), F.lit("-"), F.date_format(F.date_add(d, 9), "MM/dd/yyyy"))
    out = t.orders.select(F.col("o_orderkey").alias("k"), dates.layer_label(x).alias("l"))
    return out.select("k", "l.source_period", F.col("l.start").cast("string").alias("first_day"), F.col("l.end").cast("string").alias("last_day"))


@query(
    "alignment_modes",
    r"""SELECT doc_id, nullif(lower(regexp_replace(substr(source || ' #' || lang || '  ' || doc_id, 1, 40), '[^0-9A-Za-z]', '', 'g')), '') AS alnum, regexp_replace(source || doc_id, '[^0-9]', '', 'g') AS digits,
    lower(regexp_replace(trim(source || ' #' || lang || '  ' || doc_id), '\s+', ' ', 'g')) AS text FROM documents""",
)
def modes(t):
    x = F.concat(F.col("source"), F.lit(" #"), F.col("lang"), F.lit("  "), F.col("doc_id").cast("string"))
    rows = t.documents.select("doc_id", x.alias("x"))
    return rows.select("doc_id", values.aligned("x", "alnum").alias("alnum"), values.aligned("x", "digits").alias("digits"), values.aligned("x", "text").alias("text"))


@query(
    "fingerprint_values",
    "SELECT l_partkey AS part, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS d, upper(l_returnflag) AS f FROM lineitem) GROUP BY 1",
)
def prints(t):
    """Quantities, dates and flags written two ways fingerprint alike: the distinct prints are the distinct values."""
    odd = F.col("l_suppkey") % 2 == 1
    rows = t.lineitem.select(
        F.col("l_partkey").alias("part"), F.when(odd, F.col("l_quantity").cast("string")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("q"),
        F.when(odd, F.date_format("l_shipdate", "M/d/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"),
        F.when(odd, F.lower("l_returnflag")).otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("f"),
    )
    return rows.select("part", *[values.fingerprint_value(c).alias(c) for c in "qdf"]).distinct().groupBy("part").agg(F.count("*").alias("n"))


@query(
    "reference_words",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z]+'), lambda x: length(x) >= 3
    AND x NOT IN ('INC','LLC','LTD','THE','AND','CORP','COMPANY','CO','MISC','VOID','NONE','TBD','NULL')))), ' ') AS words FROM documents""",
)
def words(t):
    return t.documents.select("doc_id", F.concat_ws(" ", ids.reference_words("text")).alias("words"))


@query(
    "vendor_and_name_keys",
    "SELECT s_suppkey AS k, 'SUPPLIER#' || s_suppkey AS vendor, 'SUPPLIER #' || s_suppkey AS name FROM supplier",
)
def vendor(t):
    k = F.col("s_suppkey").cast("string")
    rows = t.supplier.select(F.col("s_suppkey").alias("k"), F.concat(F.lit(" \"Supplier #"), k, F.lit("\" ")).alias("v"), F.concat(F.lit("supplier   #"), k, F.lit("\t")).alias("n"))
    return rows.select("k", ids.vendor_key("v").alias("vendor"), ids.name_key("n").alias("name"))


@query(
    "gl_accounts",
    "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 OR length(CAST(p_partkey AS VARCHAR)) > 5 THEN NULL ELSE '001-' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(p_size AS VARCHAR), 6, '0') || '-000' END AS account FROM part",
)
def accounts(t):
    centre = F.when(F.col("p_partkey") % 7 == 0, "x1").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".0")))
    return t.part.select(F.col("p_partkey").alias("k"), ids.gl_account(centre, F.col("p_size"), "left").alias("account"))


@query("label_years", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 2020 + o_orderkey % 9 WHEN o_orderkey % 3 = 1 THEN 2026 END AS year FROM orders")
def years(t):
    k = F.col("o_orderkey")
    x = F.when(k % 3 == 0, F.concat(F.lit("P.12 FYE 202"), (k % 9).cast("string"))).when(k % 3 == 1, "PERIOD 13 FYE 8/29/26").otherwise("P.13")
    return t.orders.select(k.alias("k"), dates.label_year(x).alias("year"))
