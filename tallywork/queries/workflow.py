"""Workflow queries: `events` as stage changes, `conversations` as messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflow as w
from . import query



def _events(t):
    return t.events.select(F.col("user_id").alias("document"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.col("event_id").alias("event_no"))


@query(
    "current_stage",
    "SELECT user_id AS document, arg_max(event_type, ts) AS stage, CAST(max(ts) AS VARCHAR) AS since, count(*) AS n_events FROM events GROUP BY 1",
)
def stage(t):
    return w.current_state(_events(t)).withColumn("since", F.rtrim(F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")))


@query(
    "stage_history",
    "SELECT event_id AS event_no, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage, event_type AS stage FROM events",
)
def history(t):
    return w.history(_events(t)).select("event_no", "from_stage", "stage")


@query(
    "legal_actions",
    """WITH RECURSIVE e AS (SELECT user_id AS document, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view', 'error')),
    f AS (SELECT DISTINCT user_id AS document, 0 AS k, 'new' AS stage, 0 AS applied FROM events
      UNION ALL SELECT f.document, f.k + 1, CASE WHEN f.stage = x.need THEN x.lead ELSE f.stage END, f.applied + CASE WHEN f.stage = x.need THEN 1 ELSE 0 END FROM f JOIN e ON e.document = f.document AND e.k = f.k + 1
      JOIN (VALUES ('click', 'new', 'seen'), ('view', 'seen', 'done'), ('error', 'done', 'new')) x(action, need, lead) ON x.action = e.action)
    SELECT document, arg_max(stage, k) AS stage, CAST(max(applied) AS BIGINT) AS applied, (SELECT count(*) FROM events WHERE user_id = f.document) - CAST(max(applied) AS BIGINT) AS refused FROM f GROUP BY document""",
)
def legal(t):
    actions = _events(t).withColumnRenamed("stage", "action")
    return w.replay(actions, {"click": ("new", "seen"), "view": ("seen", "done"), "error": ("done", "new")}, "new")


_INVOICES = """SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_custkey % 3 = 0 THEN 'AR' ELSE 'AP' END AS type, 'Customer#' || CAST(o_custkey AS STRING) AS party, o_orderpriority || '.pdf' AS document,
  o_orderstatus AS stage, CAST(o_orderdate AS DATE) AS received_on, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS stage_since, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents, o_totalprice AS amount FROM orders"""
_AGED = f"q AS (SELECT *, date_diff('day', received_on, DATE '2001-08-20') AS age_days, date_diff('day', stage_since, DATE '2001-08-20') AS stage_days FROM ({_INVOICES.replace('AS STRING', 'AS VARCHAR')}))"


def _queue(t):
    t.orders.createOrReplaceTempView("orders")
    sql = _INVOICES.replace("CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT)", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 40 AS INT))")
    return w.with_ages(t.spark.sql(sql), "2001-08-20")


@query(
    "queue_filter",
    f"WITH {_AGED} SELECT id, age_days, stage_days FROM q WHERE contains(lower(id || ' ' || party || ' ' || document), 'customer#1') AND stage = 'P' AND stage_days > 5",
)
def queue(t):
    return w.queue_filter(_queue(t), "Customer#1", "P", "held").select("id", F.col("age_days").cast("bigint").alias("age_days"), F.col("stage_days").cast("bigint").alias("stage_days"))


@query("queue_page", f"WITH {_AGED} SELECT id, amount FROM q ORDER BY amount DESC, id LIMIT 10 OFFSET 10")
def page(t):
    return w.queue_page(_queue(t), "amount-desc", 2).select("id", "amount")


@query(
    "role_measures",
    f"""WITH {_AGED} SELECT type, count(*) AS open_items, count(*) FILTER (WHERE stage = 'P') AS awaiting, count(*) FILTER (WHERE age_days > 30) AS aged, count(*) FILTER (WHERE stage = 'P' AND stage_days > 5) AS held,
    CAST(round(avg(age_days)) AS BIGINT) AS average_age, CAST(coalesce(sum(cents) FILTER (WHERE stage = 'P'), 0) AS BIGINT) AS waiting_cents FROM q GROUP BY 1""",
)
def measures(t):
    return w.role_measures(_queue(t), "P")


_MSG = """SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, 'box' || CAST(conv_id % 3 AS STRING) || '@x.org' AS mailbox, CASE WHEN turn % 5 = 4 THEN 'Junk' ELSE 'Inbox' END AS folder,
  role || '@y.org' AS from_addr, 'box' || CAST(conv_id % 3 AS STRING) || '@x.org' AS to_addr, text AS subject, conv_id * 100 + turn AS received_on, text,
  lower('File  ' || CAST(conv_id % 50 AS STRING) || '.PDF') AS file_name FROM conversations"""
_RULE_ROWS = """SELECT 'BOX' || CAST(r_regionkey AS STRING) || '@x.org' AS mailbox, CASE WHEN r_regionkey = 1 THEN 'Inbox' ELSE '' END AS folder, CASE WHEN r_regionkey = 2 THEN 'user, assistant' ELSE '' END AS sender, '' AS recipient,
  CASE WHEN r_regionkey = 0 THEN 'the,an' ELSE 'e' END AS subject, CASE WHEN r_regionkey = 0 THEN 'received' WHEN r_regionkey = 1 THEN 'approved' ELSE 'sent' END AS rule_stage, r_regionkey AS rule_order FROM region WHERE r_regionkey < 3
  UNION ALL SELECT 'BOX' || CAST(r_regionkey AS STRING) || '@x.org', '', 'user', '', '', 'approved', r_regionkey + 10 FROM region WHERE r_regionkey < 3"""
_EXPANDED = f"""m AS (SELECT * FROM ({_MSG})), s0 AS (SELECT * FROM ({_RULE_ROWS})),
s AS (SELECT lower(mailbox) AS mailbox, folder, trim(a) AS sender, recipient, trim(b) AS subject, rule_stage, rule_order FROM s0, unnest(string_split(sender, ',')) x(a), unnest(string_split(subject, ',')) y(b)),
hit AS (SELECT m.id, m.received_on, file_name, rule_order, rule_stage FROM m JOIN s ON m.mailbox = s.mailbox AND (CASE WHEN s.folder <> '' THEN lower(m.folder) = lower(s.folder) ELSE m.folder <> 'Junk' END)
  AND contains(lower(from_addr), lower(sender)) AND contains(lower(m.subject), lower(s.subject))),
best AS (SELECT id, any_value(received_on) AS received_on, any_value(file_name) AS file_name, min(rule_order) AS rule_order, arg_min(rule_stage, rule_order) AS stage FROM hit GROUP BY id)"""


def _messages(t):
    t.conversations.createOrReplaceTempView("conversations")
    t.region.createOrReplaceTempView("region")
    return t.spark.sql(_MSG), w.expand_rules(t.spark.sql(_RULE_ROWS))


@query("mailbox_rules", f"WITH {_EXPANDED} SELECT id, rule_order, stage FROM best")
def rules(t):
    return w.match_rules(*_messages(t)).select("id", "rule_order", "stage")


@query(
    "bill_lifecycle",
    f"""WITH {_EXPANDED}, g AS (SELECT regexp_replace(file_name, ' +', ' ', 'g') AS file_key, min(received_on) FILTER (WHERE stage = 'received') AS received_on, min(received_on) FILTER (WHERE stage = 'approved') AS approved_on,
    min(received_on) FILTER (WHERE stage = 'sent') AS sent_on, count(*) AS messages FROM best GROUP BY 1)
    SELECT *, CASE WHEN sent_on IS NOT NULL THEN 'sent' WHEN approved_on IS NOT NULL THEN 'approved' ELSE 'received' END AS status FROM g""",
)
def lifecycle(t):
    messages, rules_ = _messages(t)
    matched = w.match_rules(messages, rules_)
    files = matched.join(messages.select("id", w.document_key(F.col("file_name")).alias("file_key")), "id")
    return w.lifecycle(files)


@query(
    "attachment_lineage",
    f"SELECT DISTINCT regexp_replace(file_name, ' +', ' ', 'g') AS file_key, id, received_on FROM ({_MSG})",
)
def lineage(t):
    messages, _ = _messages(t)
    held = messages.withColumn("attachments", F.array(F.struct(F.col("file_name").alias("name")), F.struct(F.upper("file_name").alias("name"))))
    return w.attachment_lineage(held)


@query(
    "term_search",
    r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])the') AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])on')""",
)
def terms(t):
    return w.search_text(t.documents.select("doc_id", "text"), "text", "The on").select("doc_id")


@query("term_search_excerpts")
def excerpts(t):
    """The excerpt around the first hit in every conversation turn that has one."""
    return w.search_text(t.conversations.select("conv_id", "turn", "text"), "text", "the").select("conv_id", "turn", "excerpt")


@query(
    "file_name_fields",
    r"""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'scan ' || o_orderpriority ELSE 'Customer ' || CAST(o_custkey AS VARCHAR) || '  INV-' || CAST(o_orderkey AS VARCHAR) || ' -  BOL B' || CAST(o_custkey AS VARCHAR) || '.PDF' END AS n FROM orders)
    SELECT k, NOT k % 4 = 0 AS recognized, CASE WHEN k % 4 = 0 THEN n ELSE 'Customer ' || regexp_extract(n, 'Customer (\d+)', 1) END AS vendor, CASE WHEN k % 4 = 0 THEN '' ELSE 'INV-' || k END AS invoice,
    CASE WHEN k % 4 = 0 THEN '' ELSE regexp_extract(n, 'BOL (\w+)', 1) END AS bol FROM f""",
)
def names(t):
    files = t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("scan "), F.col("o_orderpriority"))).otherwise(
            F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit("  INV-"), F.col("o_orderkey").cast("string"), F.lit(" -  BOL B"), F.col("o_custkey").cast("string"), F.lit(".PDF"))
        ).alias("n"),
    )
    return w.parse_file_names(files, "n", "{vendor} {invoice} - BOL {bol}").select("k", "recognized", "vendor", "invoice", "bol")


@query(
    "decided_by_person",
    "SELECT user_id % 20 AS actor, count(DISTINCT user_id) AS decided FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1",
)
def decided(t):
    events = t.events.select((F.col("user_id") % 20).alias("actor"), F.col("user_id").alias("document"), F.col("event_type").alias("action"))
    return w.decided_by(events, ["purchase", "error"])
