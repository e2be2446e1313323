"""Duplicate screening inside one ledger and against another scope: detect, confirm, hold, report.

Sharing a key only makes rows candidates. A copy is confirmed by a trusted line id or by an equal fingerprint over
stable fields. Everything is decided from aggregates per key and per copy set, so no window ever has to hold a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import joined_ids
from ..functions.values import fingerprint_value
from ..runtime import beside, cut, first_per_group

# Field roles, bases, dispositions.
FINGERPRINT_FIELDS = ("customer", "txn_date", "product", "quantity", "rate")
IDENTITY_FIELDS = ("customer", "txn_date", "product", "rate")
MIN_IDENTITY_FIELDS = 2
BASIS_STRICT = "PO + Invoice + Amount"
BASIS_PO = "PO + Amount (invoice blank on both rows)"
BASIS_INVOICE = "Invoice + Amount (PO blank on both rows)"
BASIS_CROSS = "Primary/Historical overlap"
CANONICAL = "Retained canonical row"
EXCESS = "Excluded excess copy"
REVIEW = "Review required - retained for matching"
OVERLAP = "Excluded historical overlap"
RESOLVED = "Resolved via match - no exclusion applied"
HOLD = "Held for review - excluded from proposed JE pending disposition"
HISTORICAL_HOLD = "Held for review - excluded from historical clearance pending disposition"
CONFIDENCE = {
    CANONICAL: "High", EXCESS: "High", OVERLAP: "High", REVIEW: "Review", HOLD: "Hold", HISTORICAL_HOLD: "Hold",
    RESOLVED: "Resolved",
}
KEY = ["basis", "dup_po", "dup_inv", "cents"]
UNIT = "\x1f"


def input_violations(frame: DataFrame) -> DataFrame:
    """One row of violation counts for the screening contract: all must be zero."""
    repeats = frame.groupBy("row_id").count().agg(F.sum((F.col("count") > 1).cast("int")).alias("repeated_row_ids"))
    counts = frame.agg(
        F.count_if(F.col("row_id").isNull()).alias("blank_row_ids"),
        F.count_if(F.col("norm_po") != F.trim("norm_po")).alias("untrimmed_po"),
        F.count_if(F.col("norm_inv") != F.trim("norm_inv")).alias("untrimmed_invoice"),
        F.count_if(F.col("cents").isNull()).alias("missing_amounts"),
    )
    return counts.transform(beside, repeats)


def with_basis(frame: DataFrame) -> DataFrame:
    """Adds the duplicate key; `basis` is null when the row has none."""
    has_po, has_inv = F.col("norm_po") != "", F.col("norm_inv") != ""
    basis = F.when(
        F.col("cents").isNotNull(),
        F.when(has_po & has_inv, BASIS_STRICT).when(has_po, BASIS_PO).when(has_inv, BASIS_INVOICE),
    )
    return frame.withColumns(
        {
            "basis": basis,
            "dup_po": F.when(has_po, F.col("norm_po")).otherwise(""),
            "dup_inv": F.when(has_inv, F.col("norm_inv")).otherwise(""),
        }
    )


def with_prints(frame: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return frame.withColumns({f"fp_{name}": fingerprint_value(name) for name in fields})


def with_duplicate_key(frame: DataFrame, fields: tuple[str, ...] = FINGERPRINT_FIELDS) -> DataFrame:
    """Adds the duplicate key and one fingerprint column per field."""
    return with_prints(with_basis(frame), fields)


def group_id() -> Column:
    text = F.concat_ws(UNIT, *[F.col(k).cast("string") for k in KEY])
    return F.concat(F.lit("DUP-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def copy_set_id(signature: str) -> Column:
    text = F.concat_ws(UNIT, *[F.col(k).cast("string") for k in KEY], F.lit("\x1e"), F.col(signature))
    return F.concat(F.lit("COPY-"), F.upper(F.substring(F.sha2(text, 256), 1, 16)))


def line_id_trust(keyed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row: may the line id alone confirm a copy? Only if every shared id has one key and one fingerprint."""
    prints = F.concat_ws(UNIT, *[F.col(k).cast("string") for k in KEY], *[F.col(f"fp_{f}") for f in fields])
    shared = keyed.filter("line_id <> ''").groupBy("line_id").count().filter("count > 1").select("line_id")
    broken = (
        with_prints(keyed.join(shared, "line_id", "left_semi"), fields).groupBy("line_id")
        .agg(
            F.min(prints).alias("low"), F.max(prints).alias("high"),
            F.count_if(F.col("basis").isNull()).alias("keyless"),
        )
        .filter("low <> high OR keyless > 0")
    )
    return broken.agg((F.count("*") == 0).alias("trusted"))


def same_file_decisions(
    frame: DataFrame, fields: tuple[str, ...] = FINGERPRINT_FIELDS, identity: tuple[str, ...] = IDENTITY_FIELDS,
    min_identity: int = MIN_IDENTITY_FIELDS,
) -> DataFrame:
    """One decision per row whose duplicate key repeats inside the file."""
    keyed = with_basis(frame)
    sizes = (
        keyed.filter("basis IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("group_size")).filter("group_size > 1")
    )
    # Only rows of repeated keys go further; fingerprints are computed for them alone.
    candidates = cut(with_prints(keyed.join(sizes, KEY), fields), "repeated-keys")
    groups = candidates.groupBy(*KEY).agg(
        F.count_if(F.col("line_id") != "").alias("line_ids"),
        F.count_if(F.col("transaction_id") != "").alias("txn_ids"),
        *[F.count_if(F.col(f"fp_{f}") != "<NULL>").alias(f"have_{f}") for f in identity],
    )
    present = sum((F.col(f"have_{f}") == F.col("group_size")).cast("int") for f in identity)
    all_lines, all_txns = F.col("line_ids") == F.col("group_size"), F.col("txn_ids") == F.col("group_size")
    by_line = F.col("trusted") & all_lines
    print_text = F.concat_ws(UNIT, *[F.col(f"fp_{f}") for f in fields])
    signature = F.when(by_line, F.col("line_id")).otherwise(
        F.concat_ws(
            UNIT, F.when(all_txns, F.col("transaction_id")), F.when(all_lines, F.col("line_id")), print_text
        )
    )
    rows = (
        candidates.join(groups, KEY).transform(beside, line_id_trust(keyed, fields))
        .withColumns(
            {
                "sufficient": by_line | (present >= min_identity),
                "signature": signature,
                "confirmation_basis": F.when(by_line, "Line-level source ID").otherwise(
                    F.concat(
                        F.lit(f"Stable-field fingerprint ({', '.join(fields)})"),
                        F.when(all_txns | all_lines, F.lit(" + transaction ID")).otherwise(""),
                    )
                ),
            }
        )
    )
    sets = rows.groupBy(*KEY, "signature").agg(
        F.count("*").alias("copy_set_size"), F.min("row_id").alias("first_row_id")
    )
    strict = F.col("basis") == BASIS_STRICT
    confirmed = strict & F.col("sufficient") & (F.col("copy_set_size") > 1)
    out = rows.join(sets, [*KEY, "signature"]).withColumn("payload_confirmed", confirmed)
    return out.select(
        "side", "row_id", *KEY, group_id().alias("group_id"), copy_set_id("signature").alias("copy_set_id"),
        "group_size", "copy_set_size", "payload_confirmed",
        F.when(F.col("payload_confirmed"), F.col("first_row_id")).alias("canonical_row_id"),
        F.when(F.col("payload_confirmed"), F.col("confirmation_basis")).otherwise("").alias("confirmation_basis"),
        (strict & ~F.col("sufficient")).alias("insufficient"),
        F.when(F.col("payload_confirmed") & (F.col("row_id") == F.col("first_row_id")), CANONICAL)
        .when(F.col("payload_confirmed"), EXCESS).otherwise(REVIEW).alias("disposition"),
        F.lit("Same-file").alias("stage"),
        *[f"fp_{f}" for f in fields],
    )


def cross_scope_decisions(
    frame: DataFrame, reference: DataFrame, fields: tuple[str, ...] = FINGERPRINT_FIELDS
) -> DataFrame:
    """Rows of `frame` (same-file excess already removed) whose key also exists in the primary `reference`."""
    keyed = with_duplicate_key(frame, fields).filter("basis IS NOT NULL")
    other = with_duplicate_key(reference, fields).filter("basis IS NOT NULL")
    prints = F.concat_ws(UNIT, *[F.col(f"fp_{f}") for f in fields])
    rows, known = keyed.withColumn("signature", prints), other.withColumn("signature", prints)
    by_key = known.groupBy(*KEY).agg(F.count("*").alias("reference_rows"), F.min("row_id").alias("reference_row_id"))
    by_print = known.groupBy(*KEY, "signature").agg(F.min("row_id").alias("copied_row_id"))
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("own_rows"))
    sets = rows.groupBy(*KEY, "signature").agg(F.count("*").alias("copy_set_size"))
    return (
        rows.join(by_key, KEY).join(by_print, [*KEY, "signature"], "left").join(sizes, KEY)
        .join(sets, [*KEY, "signature"])
        .select(
            "side", "row_id", *KEY, group_id().alias("group_id"), copy_set_id("signature").alias("copy_set_id"),
            (F.col("own_rows") + F.col("reference_rows")).alias("group_size"), "copy_set_size",
            F.col("copied_row_id").isNotNull().alias("payload_confirmed"),
            F.col("copied_row_id").alias("canonical_row_id"), F.lit("").alias("confirmation_basis"),
            F.lit(False).alias("insufficient"),
            F.when(F.col("copied_row_id").isNotNull(), OVERLAP).otherwise(REVIEW).alias("disposition"),
            F.lit("Cross-scope").alias("stage"),
            *[f"fp_{f}" for f in fields],
        )
    )


def screen(frame: DataFrame, reference: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(decisions, active rows): same-file copies first, then overlap with the primary scope."""
    decisions = same_file_decisions(frame, **options)
    excess = decisions.filter(F.col("disposition") == EXCESS).select("side", "row_id")
    if reference is not None:
        survivors = frame.join(excess, ["side", "row_id"], "left_anti")
        decisions = decisions.unionByName(cross_scope_decisions(survivors, reference))
        excess = decisions.filter(F.col("disposition").isin(EXCESS, OVERLAP)).select("side", "row_id")
    return decisions, frame.join(excess, ["side", "row_id"], "left_anti")


def suspected(decisions: DataFrame) -> DataFrame:
    """Rows under review that no decision excluded."""
    out = decisions.groupBy("side", "row_id").agg(
        F.max(F.col("disposition") == REVIEW).alias("review"),
        F.max(F.col("disposition").isin(EXCESS, OVERLAP)).alias("excluded"),
        F.min("group_id").alias("group_id"),
    )
    return out.filter("review AND NOT excluded").select("side", "row_id", "group_id")


def account_suspects(suspects: DataFrame, unmatched: DataFrame) -> DataFrame:
    """After matching: who in each suspect group is resolved, stays, or is held as a potential duplicate.

    If any member matched, its unmatched siblings are held. If none matched, the earliest stays an ordinary exception
    and the others are held as potential duplicates of it.
    """
    marked = suspects.join(unmatched.select("side", "row_id", F.lit(True).alias("open")), ["side", "row_id"], "left")
    marked = marked.withColumn("open", F.coalesce("open", F.lit(False)))
    groups = marked.groupBy("side", "group_id").agg(
        F.min(F.when(~F.col("open"), F.col("row_id"))).alias("first_matched"),
        F.min(F.when(F.col("open"), F.col("row_id"))).alias("first_open"),
    )
    none_matched = F.col("first_matched").isNull()
    outcome = (
        F.when(~F.col("open"), RESOLVED)
        .when(none_matched & (F.col("row_id") == F.col("first_open")), CANONICAL)
        .otherwise(HOLD)
    )
    representative = F.when(
        outcome == HOLD, F.when(none_matched, F.col("first_open")).otherwise(F.col("first_matched"))
    )
    return marked.join(groups, ["side", "group_id"]).select(
        "side", "row_id", "group_id", outcome.alias("outcome"), representative.alias("held_for_row_id")
    )


def finalize(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Final disposition of rows that were under review; canonical, excess and overlap rows stay as screened."""
    joined = decisions.join(outcomes.select("side", "row_id", "outcome", "held_for_row_id"), ["side", "row_id"], "left")
    patched = F.when((F.col("disposition") == REVIEW) & F.col("outcome").isNotNull(), F.col("outcome")).otherwise(
        F.col("disposition")
    )
    labels = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return joined.withColumns(
        {
            "canonical_row_id": F.coalesce(
                F.when(F.col("disposition") == REVIEW, F.col("held_for_row_id")), "canonical_row_id"
            ),
            "disposition": patched,
        }
    ).withColumns(
        {
            "automatically_excluded": F.col("disposition").isin(EXCESS, OVERLAP, HOLD, HISTORICAL_HOLD),
            "confidence": labels[F.col("disposition")],
        }
    ).drop("outcome", "held_for_row_id")


def overlapping_outcomes(outcomes: DataFrame) -> DataFrame:
    """Rows given more than one final outcome; must be empty."""
    return outcomes.groupBy("side", "row_id").agg(F.count_distinct("outcome").alias("n")).filter("n > 1")


def report(decisions: DataFrame, fields: tuple[str, ...] = FINGERPRINT_FIELDS, shown: int = 25) -> DataFrame:
    """Reviewer report: reason, fields that differ, group sizes and the first sibling ids of the group."""

    def differing(prefix: str) -> list[Column]:
        return [
            (F.min(f"fp_{f}") != F.max(f"fp_{f}")).alias(f"{prefix}_{f}") for f in fields
        ]

    in_group = decisions.groupBy("side", "stage", "group_id").agg(*differing("g"))
    in_set = decisions.groupBy("side", "stage", "copy_set_id").agg(*differing("s"))
    members = (
        first_per_group(decisions, ["side", "stage", "group_id"], [F.col("row_id")], shown + 1)
        .groupBy("side", "stage", "group_id")
        .agg(F.array_sort(F.collect_list("row_id")).alias("member_ids"))
    )
    differs = F.array_compact(
        F.array(*[F.when(F.when(F.col("payload_confirmed"), F.col(f"s_{f}")).otherwise(F.col(f"g_{f}")), F.lit(f))
                  for f in fields])
    )
    others = F.transform(F.filter("member_ids", lambda x: x != F.col("row_id")), lambda x: x.cast("string"))
    reason = (
        F.when(F.col("basis") == BASIS_PO, "Same normalized PO and signed amount; invoice is blank on all rows.")
        .when(F.col("basis") == BASIS_INVOICE, "Same normalized invoice and signed amount; PO is blank on all rows.")
        .when(F.col("payload_confirmed"), "Same normalized PO, invoice, signed amount, and line identity.")
        .when(F.col("insufficient"), "Same normalized PO, invoice, and signed amount, but too few fields to confirm.")
        .otherwise("Same normalized PO, invoice, and signed amount, but one or more confirmation fields differ.")
    )
    return (
        decisions.join(in_group, ["side", "stage", "group_id"]).join(in_set, ["side", "stage", "copy_set_id"])
        .join(members, ["side", "stage", "group_id"])
        .select(
            "side", "stage", "row_id", "basis", reason.alias("reason"), F.concat_ws("; ", differs).alias("differing_fields"),
            "group_id", "copy_set_id", "group_size", "copy_set_size",
            joined_ids(others, F.col("group_size") - 1, shown).alias("other_row_ids"),
            "canonical_row_id", "payload_confirmed", "confirmation_basis", "disposition", "cents",
        )
    )
