"""Which receipts a period recognizes: each valid receipt once, never twice, never silently dropped."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window as Over, functions as F

from ..functions.dates import label_year, period_number
from ..functions.text import is_blank
from ..runtime import BLOCK_ROWS, cut, hot_places, in_places, inside_spans, running_before
from .fifo import QTY_TOLERANCE, VALUE_TOLERANCE
from .materials import name_key


@dataclass(frozen=True)
class Window:
    """The dates of the period, its fiscal year, and the receipt cutoff of the opening layers."""

    fiscal_year: int
    period: int
    start: date
    end: date
    year_start: date
    year_end: date
    cutoff: date | None = None
    cutoff_period: int | None = None


def receipt_key(alias="alias", day="delivered", qty="qty", total="total", po="po", invoice="invoice") -> Column:
    def ref(name: str) -> Column:
        return F.coalesce(name_key(name), F.lit(""))

    return F.concat_ws(
        "|", F.col(alias).cast("string"), F.col(day).cast("string"), F.round(F.col(qty).cast("decimal(24,8)"), 4).cast("string"),
        F.round(F.col(total).cast("decimal(24,8)"), 2).cast("string"), ref(po), ref(invoice),
    )


def mark_registered(log: DataFrame, register: DataFrame) -> DataFrame:
    """Adds `receipt_key` and `processed`: each registered occurrence of a key cancels one log row, in log order.

    Log and register meet in one shuffle by material and day, which equal keys share; the log keeps all its columns there, so nothing is
    joined back. Rows without a full key are never registered and are not moved. `source_row` names a row: a row that comes
    several times is registered as a whole.
    """
    group, fields = ["alias", "delivered"], ["alias", "delivered", "qty", "total", "source_row"]
    full = F.lit(True)
    for name in fields:
        full = full & F.col(name).isNotNull()
    log = log.drop("receipt_key")
    whole = log.filter(full)
    # The register's keys are taken from its own types, its material and day then take those of the log.
    known = register.filter("alias IS NOT NULL AND delivered IS NOT NULL").select(
        receipt_key().alias("receipt_key"), *[F.col(n).try_cast(log.schema[n].dataType).alias(n) for n in group]
    )
    hot = hot_places([whole, known], group)
    marked = _mark_by_window(whole.filter(~in_places(group, hot)), known.filter(~in_places(group, hot))) if hot else _mark_by_window(whole, known)
    if hot:
        marked = marked.unionByName(_mark_by_join(whole.filter(in_places(group, hot)), known.filter(in_places(group, hot)).select("receipt_key")))
    rest = log.filter(~full).withColumns({"receipt_key": receipt_key(), "processed": F.lit(False)})
    return marked.unionByName(rest)


def _mark_by_window(log: DataFrame, known: DataFrame) -> DataFrame:
    """Windows over one key: its register rows come first, so they are counted when the first log row comes."""
    met = log.withColumn("_logged", F.lit(1)).unionByName(known.withColumn("_logged", F.lit(0)), allowMissingColumns=True)
    # The key of a log row is made behind the shuffle, from what travels anyway.
    met = met.repartition("alias", "delivered").withColumn("receipt_key", F.coalesce("receipt_key", receipt_key()))
    order = Over.partitionBy("alias", "delivered", "receipt_key").orderBy("_logged", "source_row")
    so_far = order.rowsBetween(Over.unboundedPreceding, Over.currentRow)
    placed = met.withColumns({
        "_registered": F.sum(F.lit(1) - F.col("_logged")).over(so_far), "_rank": F.rank().over(order),
        "_copies": F.count(F.lit(1)).over(order.rangeBetween(Over.currentRow, Over.currentRow)),
    }).filter("_logged = 1")
    # `_rank` counts the register rows too. Copies of a row share their registered occurrences, each with each.
    cancelled = F.least("_copies", 2 * F.col("_registered") + 1 - F.col("_rank"))
    out = placed.withColumn("_cancelled", F.greatest(cancelled, F.lit(0)).cast("int"))
    times = F.when(F.col("_cancelled") > 1, F.array_repeat(F.lit(0), F.col("_cancelled"))).otherwise(F.array(F.lit(0)))
    return out.withColumn("processed", F.col("_cancelled") > 0).select(*log.columns, "receipt_key", "processed", F.explode(times).alias("_time")).drop("_time")


def _mark_by_join(log: DataFrame, register: DataFrame) -> DataFrame:
    """The same for keys of any size: counts are joined, log rows are placed in blocks."""
    known = register.groupBy("receipt_key").agg(F.count("*").alias("registered"))
    keyed = cut(log.withColumn("receipt_key", receipt_key()), "keyed", compression="zstd")
    hits = keyed.join(known, "receipt_key")
    placed = running_before(
        hits.withColumn("_chunk", F.floor(F.col("source_row") / BLOCK_ROWS)), ["receipt_key"], "_chunk", "source_row", {"earlier": F.lit(1)}
    )
    done = placed.filter("earlier < registered").select("source_row", F.lit(True).alias("processed"))
    return keyed.join(done, "source_row", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


def classify(log: DataFrame, register: DataFrame, w: Window) -> DataFrame:
    """One `placement` per log row.

    `log`: source_row, alias (null: not a known material), delivered (null: unreadable), qty, total, po, invoice,
    label, section_label. The label column speaks first, the heading above it supports it; if both speak and differ
    the row is in conflict.
    """
    d = F.col
    marked = mark_registered(log, register).withColumns({"own": period_number("label"), "above": period_number("section_label")})
    marked = marked.withColumns({
        "label_text": F.when(d("own").isNotNull(), d("label")).otherwise(d("section_label")),
        "label_period": F.coalesce("own", "above"),
        "conflict": F.coalesce(d("own") != d("above"), F.lit(False)),
        "empty": d("alias").isNull() & d("delivered").isNull() & d("qty").isNull() & d("total").isNull(),
    }).withColumn("label_year", label_year(F.coalesce("label_text", F.lit(""))))
    in_year = F.coalesce(d("delivered").between(F.lit(w.year_start), F.lit(w.year_end)), F.lit(False))
    named = F.coalesce(d("label_year") == w.fiscal_year, F.lit(False))
    year_fits = named | (d("label_year").isNull() & in_year)
    here = F.coalesce(d("label_period") == w.period, F.lit(False))
    early = d("delivered") < F.lit(w.start)
    if w.cutoff is not None:
        later = F.coalesce((d("label_period") > w.cutoff_period) & (d("label_period") <= w.period), F.lit(False)) if w.cutoff_period is not None else here
        before_cutoff = d("delivered") <= F.lit(w.cutoff)
        crossing = early & before_cutoff & later & year_fits
        late = early & (~before_cutoff | crossing)
        presumed = early & before_cutoff & ~crossing
    else:
        crossing, late, presumed = F.lit(False), early & here & year_fits, F.lit(False)
    placement = (
        F.when(d("empty"), "empty").when(d("processed"), "registered")
        .when(d("delivered").isNull(), F.when(here & named, "rejected").otherwise("unplaced"))
        .when(presumed, "presumed in opening").when(crossing, "crossing").when(late, "late")
        .when(early, "earlier period").when(d("delivered") > F.lit(w.end), F.when(here & year_fits, "mislabelled").otherwise("pending"))
        .otherwise("in period")
    )
    return marked.withColumn("placement", placement).drop("own", "above", "empty", "label_text")


def rejection_reason() -> Column:
    c = F.col
    return F.concat_ws("; ", F.array_compact(F.array(
        F.when(c("alias").isNull(), "Material not recognized"),
        F.when(c("qty").isNull(), "Quantity is missing or not a number").when(c("qty") <= QTY_TOLERANCE, "Quantity must be positive"),
        F.when(c("total").isNull(), "Cost is missing or not a number").when(c("total") < -VALUE_TOLERANCE, "Cost is negative"),
        F.when(c("delivered").isNull(), "Delivery date is missing or not a date"),
    )))


def opening_evidence(crossing: DataFrame, layers: DataFrame, lineage: DataFrame) -> DataFrame:
    """(source_row, evidence): included on proof, unclear when a layer could hold the receipt, else not_included.

    `lineage`: alias, delivered, qty, po, invoice of receipts recorded in the opening layers. `layers`: alias,
    start_day, end_day. Spans of a material are swept day by day, so neither side is paired with the other.
    """
    rows = crossing.withColumns({"ref_po": F.coalesce(name_key("po"), F.lit("")), "ref_inv": F.coalesce(name_key("invoice"), F.lit(""))})
    proof = None
    for ref, source in (("ref_po", "po"), ("ref_inv", "invoice")):
        known = lineage.select("alias", "delivered", F.col("qty").alias("l_qty"), F.coalesce(name_key(source), F.lit("")).alias(ref)).filter(F.col(ref) != "")
        hit = rows.join(known, ["alias", "delivered", ref]).filter(F.abs(F.col("l_qty") - F.col("qty")) <= 0.5).select("source_row")
        proof = hit if proof is None else proof.unionByName(hit)
    spans = layers.select("alias", "start_day", F.coalesce("end_day", "start_day").alias("end_day"))
    undated = spans.filter("start_day IS NULL").select("alias", F.lit(True).alias("undated")).distinct()
    covered = inside_spans(rows, spans, ["alias"], "delivered", "start_day", "end_day", "covered")
    out = (
        rows.join(proof.distinct().withColumn("proven", F.lit(True)), "source_row", "left").join(undated, "alias", "left")
        .join(covered, ["alias", "delivered"], "left")
    )
    return out.select("source_row", F.when(F.col("proven"), "included").when(F.col("undated") | F.col("covered"), "unclear").otherwise("not_included").alias("evidence"))


def _asked() -> Column:
    """Rows whose outcome rests on the opening layers."""
    p = F.col("placement")
    return F.coalesce((rejection_reason() == "") & ((p == "crossing") | ((p == "late") & F.col("conflict"))), F.lit(False))


def recognize(log: DataFrame, register: DataFrame, w: Window, layers: DataFrame, lineage: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Final `outcome` per log row: recognized (in period or late), rejected, review, in opening, or why it waits.

    `decisions`: receipt_key, decision ('include' or 'opening'), each taken once by a person.
    """
    # Read twice below, and its conditions are long: written once, so that no filter carries them along. The key is made again from the row.
    placed = classify(log, register, w).withColumns({"reason": rejection_reason(), "asked": _asked()}).drop("receipt_key")
    placed = cut(placed, "placed", compression="zstd").withColumn("receipt_key", receipt_key())
    # Only rows that are asked about have evidence; the others are not moved again.
    asked = placed.filter("asked").drop("asked")
    out = placed.filter("NOT asked").drop("asked").withColumn("evidence", F.lit(None).cast("string")).unionByName(
        asked.join(opening_evidence(asked, layers, lineage), "source_row", "left")
    )
    if decisions is not None:
        out = out.join(decisions.select("receipt_key", "decision"), "receipt_key", "left")
    else:
        out = out.withColumn("decision", F.lit(None).cast("string"))
    p, looked = F.col("placement"), F.col("evidence").isNotNull()
    evidence_now = F.when(F.col("conflict"), "unclear").when(p == "crossing", F.col("evidence")).otherwise("not_included")
    recognized = F.when(p == "in period", "in period").otherwise("late")
    outcome = (
        F.when(p.isin("in period", "late", "crossing", "rejected") & (F.col("reason") != ""), "rejected")
        .when(looked & (F.col("decision") == "include"), "late").when(looked & (F.col("decision") == "opening"), "in opening")
        .when(looked & (evidence_now == "included"), "in opening").when(looked & (evidence_now == "unclear"), "review")
        .when(p.isin("in period", "late", "crossing"), recognized).otherwise(p)
    )
    return out.withColumn("outcome", outcome)


def repeated_receipts(recognized: DataFrame) -> DataFrame:
    """Receipts equal in every principal field (kept, but worth a look), and invoices repeated for one material."""
    keys = recognized.groupBy(receipt_key().alias("receipt_key")).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("all fields equal").alias("kind"), F.col("receipt_key").alias("subject"), "n"
    )
    ref = name_key("invoice")
    invoices = recognized.filter(~is_blank("invoice")).groupBy(F.concat_ws("|", F.col("alias").cast("string"), ref).alias("subject")).agg(F.count("*").alias("n"))
    return keys.unionByName(invoices.filter("n > 1").select(F.lit("same invoice").alias("kind"), "subject", "n"))


def look_alikes(recognized: DataFrame, register: DataFrame) -> DataFrame:
    """Recognized rows equal to a registered receipt in material, quantity, cost and PO or invoice, on another date."""
    def keyed(df: DataFrame, source: str) -> DataFrame:
        return df.filter(~is_blank(source)).withColumn("ref", name_key(source))

    out = None
    for source in ("po", "invoice"):
        fields = ["alias", "qty", "total", "ref"]
        mine, known = keyed(recognized, source), keyed(register, source)
        hit = mine.join(known.select(*fields).distinct(), fields, "left_semi").join(
            known.select(*fields, "delivered").distinct(), [*fields, "delivered"], "left_anti"
        ).select("source_row")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def clamp_late(recognized: DataFrame, layers: DataFrame) -> DataFrame:
    """A late receipt joins the queue after the layers already carried; the date as reported is kept beside it."""
    newest = layers.groupBy("alias").agg(F.max(F.coalesce("end_day", "start_day")).alias("newest"))
    late = F.col("outcome") == "late"
    return recognized.join(newest, "alias", "left").withColumn("original_delivered", F.col("delivered")).withColumn(
        "delivered", F.when(late & (F.col("newest") > F.col("delivered")), F.col("newest")).otherwise(F.col("delivered"))
    ).drop("newest")


def receipts_report(recognized: DataFrame) -> DataFrame:
    """One line per recognized receipt, by material and original delivery date."""
    return recognized.select(
        "alias", "original_delivered", (F.col("outcome") == "late").alias("late"), "qty", "total",
        F.when(F.col("qty") != 0, F.col("total") / F.col("qty")).alias("unit_cost"), "source_row",
    ).orderBy("alias", "original_delivered", "source_row")


def input_exceptions(counts: DataFrame, outcome: DataFrame) -> DataFrame:
    """(severity, place, item, what) rows of the inputs that need a person."""
    count_rows = counts.filter(F.col("outcome").isin("duplicate", "invalid", "unmapped")).select(
        F.when(F.col("outcome") == "unmapped", "WARNING").otherwise("ERROR").alias("severity"), F.lit("Ending report").alias("place"),
        F.col("name").alias("item"), F.col("outcome").alias("what"),
    )
    receipt_rows = outcome.filter(F.col("outcome").isin("rejected", "review")).select(
        F.lit("ERROR").alias("severity"), F.lit("Receiving report").alias("place"), F.col("source_row").cast("string").alias("item"),
        F.when(F.col("outcome") == "review", "needs a one-time review").otherwise(F.col("reason")).alias("what"),
    )
    return count_rows.unionByName(receipt_rows)


def product_exceptions(statuses: DataFrame) -> DataFrame:
    """Products whose costing did not pass."""
    return statuses.filter(~F.col("overall_status").startswith("PASS")).select(
        F.when(F.col("overall_status") == "FAIL", "ERROR").otherwise("WARNING").alias("severity"), F.lit("Calculation").alias("place"),
        F.concat_ws(" ", F.col("product").cast("string"), "name").alias("item"), F.col("message").alias("what"),
    )
