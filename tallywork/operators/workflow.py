"""Documents moving through stages: event replay, legal actions, mailbox rules, lifecycle, queues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import previous_values

# Alert thresholds, page size and the junk folders "any folder" passes over.
HELD_DAYS, AGED_DAYS, PAGE = 5, 30, 10
SKIPPED_FOLDERS = r"(?i)^(junk|junk email|spam|deleted|deleted items|trash)$"
SNIPPET_RADIUS = 60
STAGES = ("received", "approved", "sent")


def current_state(events: DataFrame) -> DataFrame:
    """Stage, since-date and number of events per document: the last event in time order decides.

    `events` need document, stage, at, event_no (a unique tie-breaker). Only aggregates, so a hot document is cheap.
    """
    latest = F.struct("at", "event_no")
    return events.groupBy("document").agg(
        F.max_by("stage", latest).alias("stage"), F.max("at").alias("since"), F.count("*").alias("n_events")
    )


def _placed(events: DataFrame) -> DataFrame:
    """Day, place inside the day and minute block of each event; ties in time fall back to the event number."""
    moment = (F.unix_micros(F.col("at").cast("timestamp")) % F.lit(86_400_000_000)).cast("bigint")
    return events.withColumns(
        {
            "_day": F.to_date("at"), "_block": F.floor(moment / F.lit(60_000_000)).cast("bigint"),
            "_place": F.struct(moment.alias("moment"), F.col("event_no")),
        }
    )


def history(events: DataFrame) -> DataFrame:
    """Every event with the stage it came from, in time order inside its document (one row per event)."""
    linked = previous_values(_placed(events), ["document"], "_day", "_place", ["stage"])
    return linked.withColumn("from_stage", F.col("previous.stage")).drop("_day", "_place", "_block", "previous")


def replay(actions: DataFrame, rules: dict[str, tuple[str, str]], start: str) -> DataFrame:
    """Fold actions over time, refusing those whose expected stage is not the current one.

    A refused action does not move the stage, so this is a true fold. It is still computed in parallel: the actions of
    one minute become a table "from each stage, where do you end and how many were applied"; such tables compose, so
    minutes fold into days and days into documents, and no array is longer than a minute's, a day's or a document's.
    """
    stages = sorted({start, *(s for pair in rules.values() for s in pair)})
    place = {s: n for n, s in enumerate(stages)}
    needs = F.create_map(*[F.lit(x) for k, (a, _) in rules.items() for x in (k, place[a])])
    leads = F.create_map(*[F.lit(x) for k, (_, b) in rules.items() for x in (k, place[b])])
    stay = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(0).cast("bigint").alias("applied")) for n in range(len(stages))])

    def act(table: Column, e: Column) -> Column:
        def one(x: Column) -> Column:
            legal = e["needs"] == x["stage"]
            return F.struct(
                F.when(legal, e["leads"]).otherwise(x["stage"]).alias("stage"),
                (x["applied"] + legal.cast("bigint")).alias("applied"),
            )

        return F.transform(table, one)

    def compose(table: Column, later: Column) -> Column:
        return F.transform(
            table,
            lambda x: F.struct(
                F.get(later["table"], x["stage"])["stage"].alias("stage"),
                (x["applied"] + F.get(later["table"], x["stage"])["applied"]).alias("applied"),
            ),
        )

    known = _placed(actions.filter(F.col("action").isin(*rules))).withColumns(
        {"needs": needs[F.col("action")], "leads": leads[F.col("action")]}
    )
    minutes = known.groupBy("document", "_day", "_block").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("_place", "needs", "leads"))), stay, act).alias("table")
    )
    days = minutes.groupBy("document", "_day").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("_block", "table"))), stay, compose).alias("table")
    )
    folded = days.groupBy("document").agg(
        F.get(F.aggregate(F.array_sort(F.collect_list(F.struct("_day", "table"))), stay, compose), F.lit(place[start])).alias("end")
    )
    names = F.array(*[F.lit(s) for s in stages])
    totals = actions.groupBy("document").agg(F.count("*").alias("n_actions"))
    out = totals.join(folded, "document", "left")
    applied = F.coalesce("end.applied", F.lit(0))
    return out.select(
        "document", F.coalesce(F.get(names, F.col("end.stage")), F.lit(start)).alias("stage"), applied.alias("applied"),
        (F.col("n_actions") - applied).alias("refused"),
    )


def note_problem(note, required: Column, least: int = 5, most: int = 300) -> Column:
    text = F.trim(F.coalesce(note, F.lit("")))
    return F.when(required & (F.length(text) < least), f"Add a reason of at least {least} characters.").when(
        F.length(text) > most, f"Keep the comment to {most} characters or fewer."
    )


def with_ages(invoices: DataFrame, as_of) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return invoices.withColumns(
        {"age_days": F.datediff(day, F.to_date("received_on")), "stage_days": F.datediff(day, F.to_date("stage_since"))}
    )


def queue_filter(queue: DataFrame, text: str = "", stage: str = "", aging: str = "", columns=("id", "party", "document")) -> DataFrame:
    out = queue
    if text:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))
    if stage:
        out = out.filter(F.col("stage") == stage)
    if aging == "held":
        out = out.filter(F.col("stage_days") > HELD_DAYS)
    if aging == "old":
        out = out.filter(F.col("age_days") > AGED_DAYS)
    return out


def queue_page(queue: DataFrame, sort: str, page: int = 1, size: int = PAGE) -> DataFrame:
    orders = {
        "age-desc": [F.col("age_days").desc()], "age-asc": [F.col("age_days").asc()],
        "stage-desc": [F.col("stage_days").desc(), F.col("age_days").desc()],
        "amount-desc": [F.col("amount").desc()], "party-asc": [F.lower("party").asc()],
    }
    return queue.orderBy(*orders[sort], "id").offset((page - 1) * size).limit(size)


def role_measures(queue: DataFrame, approval_stage: str) -> DataFrame:
    """Open, awaiting, aged, held, average age and amount waiting per queue type."""
    waiting, c = F.col("stage") == approval_stage, F.col
    return queue.groupBy("type").agg(
        F.count("*").alias("open_items"), F.count_if(waiting).alias("awaiting"),
        F.count_if(c("age_days") > AGED_DAYS).alias("aged"), F.count_if(waiting & (c("stage_days") > HELD_DAYS)).alias("held"),
        F.round(F.avg("age_days"), 0).cast("bigint").alias("average_age"),
        F.coalesce(F.sum(F.when(waiting, c("cents"))), F.lit(0)).alias("waiting_cents"),
    )


# --- messages ---------------------------------------------------------------------------------------------------

def expand_rules(settings: DataFrame) -> DataFrame:
    """One rule per combination of sender, recipient and subject options (comma lists); blank stages are off."""
    def options(name: str) -> Column:
        items = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("")))

    live = settings.filter("coalesce(sender,'') <> '' OR coalesce(recipient,'') <> '' OR coalesce(subject,'') <> '' OR coalesce(folder,'') <> ''")
    out = live
    for name in ("sender", "recipient", "subject"):
        out = out.withColumn(name, F.explode(options(name)))
    return out


def match_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule by order whose mailbox and folder fit and whose sender, recipient and subject are contained.

    Equi join on the mailbox; the contains tests are a residual on the few rules of that mailbox.
    """
    def within(text: str, part: str) -> Column:
        return (F.col(part) == "") | F.contains(F.lower(F.col(text)), F.lower(F.col(part)))

    r = rules.select(
        F.lower("mailbox").alias("mailbox"), F.lower(F.trim(F.coalesce("folder", F.lit("")))).alias("rule_folder"), "sender", "recipient",
        F.col("subject").alias("rule_subject"), "rule_order", "rule_stage",
    )
    folder = F.when(F.col("rule_folder") != "", F.lower(F.trim("folder")) == F.col("rule_folder")).otherwise(
        ~F.col("folder").rlike(SKIPPED_FOLDERS)
    )
    joined = messages.join(r, "mailbox").filter(
        folder & within("from_addr", "sender") & within("to_addr", "recipient") & within("subject", "rule_subject")
    )
    return joined.groupBy("id").agg(
        F.min(F.struct("rule_order", "rule_stage")).alias("r"), F.first("received_on").alias("received_on")
    ).select("id", "received_on", F.col("r.rule_order").alias("rule_order"), F.col("r.rule_stage").alias("stage"))


def term_pattern(term: str) -> str:
    return r"(?iu)(?<![\p{L}\p{N}])" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def search_text(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows where every search word begins some word of the text, with a short excerpt at the first hit."""
    terms = query.lower().split()
    hit, first = F.lit(True), []
    for term in terms:
        at = F.regexp_instr(F.col(text), F.lit(term_pattern(term)))
        hit = hit & (at > 0)
        first.append(F.when(at > 0, at))
    found = rows.filter(hit)
    if not terms:
        return found.withColumn("excerpt", F.lit(""))
    at = F.least(*first) if len(first) > 1 else first[0]
    start = F.greatest(F.lit(1), at - SNIPPET_RADIUS)
    stop = F.least(F.length(text) + 1, at + SNIPPET_RADIUS)
    return found.withColumn(
        "excerpt",
        F.concat(
            F.when(start > 1, "…").otherwise(""), F.trim(F.substring(F.col(text), start, stop - start)),
            F.when(stop <= F.length(text), "…").otherwise(""),
        ),
    )


# What each field of a file name may look like.
FIELD_PATTERNS = {
    "vendor": "(.+?)", "invoice": r"((?=[A-Za-z0-9-]*\d)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)", "bol": "([A-Za-z0-9-]+)",
}


def file_pattern(template: str) -> tuple[str, list[str]]:
    """A name template such as `{vendor} {invoice} - BOL {bol}` as one regex and its fields in order.

    Text between fields stands for itself; white space in it may be missing, white space alone between two fields not.
    """
    fields = [name.strip().lower() for name in re.findall(r"\{([^}]*)\}", template)]
    wrong = sorted({f for f in fields if f not in FIELD_PATTERNS or fields.count(f) > 1})
    missing = [f for f in ("vendor", "invoice") if f not in fields]
    if wrong or missing:
        raise ValueError(f"file name template: unknown or repeated fields {wrong}, missing fields {missing}")

    def between(text: str) -> str:
        if text and not text.strip():
            return r"\s+"
        return r"\s*".join(re.escape(word) for word in re.split(r"\s+", text))

    texts = [between(x) for x in re.split(r"\{[^}]*\}", template.strip())]
    return "(?i)^" + texts[0] + "".join(FIELD_PATTERNS[f] + x for f, x in zip(fields, texts[1:])) + "$", fields


def parse_file_names(files: DataFrame, column: str, template: str) -> DataFrame:
    """Fields of a file name; names that do not fit are kept with `recognized` false and the name as vendor."""
    pattern, fields = file_pattern(template)
    base = F.regexp_replace(F.trim(F.regexp_replace(column, r"(?i)\.pdf$", "")), r"\s+", " ")
    out = files.withColumn("_base", base).withColumn("recognized", F.col("_base").rlike(pattern))
    parts = {
        name: F.when(F.col("recognized"), F.trim(F.regexp_extract("_base", pattern, fields.index(name) + 1))).otherwise(
            F.col("_base") if name == "vendor" else F.lit("")
        ) if name in fields else F.lit("")
        for name in ("vendor", "invoice", "bol")
    }
    return out.withColumns(parts).drop("_base")


def document_key(name) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def lifecycle(files: DataFrame) -> DataFrame:
    """Per file: earliest date of each stage and the furthest stage reached. `files` need file_key, stage, received_on."""
    when = [F.min(F.when(F.col("stage") == s, F.col("received_on"))).alias(f"{s}_on") for s in STAGES]
    status = F.when(F.col("sent_on").isNotNull(), "sent").when(F.col("approved_on").isNotNull(), "approved").otherwise("received")
    return files.groupBy("file_key").agg(*when, F.count("*").alias("messages")).withColumn("status", status)


def attachment_lineage(messages: DataFrame) -> DataFrame:
    """(file key, message, received) once per message: which messages share a file name, oldest first by `received_on`."""
    exploded = messages.select("id", "received_on", F.explode("attachments").alias("a"))
    return exploded.select(document_key(F.col("a.name")).alias("file_key"), "id", "received_on").distinct()


def decided_by(events: DataFrame, decisions: list[str]) -> DataFrame:
    """Documents each person decided: (actor, decided). `events` need document, actor, action."""
    return events.filter(F.col("action").isin(*decisions)).select("actor", "document").distinct().groupBy("actor").agg(F.count("*").alias("decided"))
