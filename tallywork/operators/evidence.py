"""What an unmatched row means: candidates on the other side, one finding per row, variances, ambiguity, holds.

Candidate sets are never listed pair by pair. Counts over "shares the PO or the invoice" follow from three aggregates
per reference (by PO, by invoice, by both), so a reference carried by a third of all rows costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, first_per_group, join_filled
from .matching import filled, unique_pairs

# Evidence findings, hold codes and classes.
NO_EVIDENCE = "NO_EVIDENCE"
WEAK_ONLY = "EVIDENCE_INSUFFICIENT_WEAK_REFERENCE"
WEAK_EXACT = "EVIDENCE_INSUFFICIENT_WEAK_REFERENCE_EXACT_AMOUNT"
AMOUNT_DIFFERS = "EVIDENCE_FOUND_AMOUNT_DIFFERS"
CONSUMED = "EVIDENCE_ALREADY_CONSUMED"
MULTIPLE = "EVIDENCE_MULTIPLE_CANDIDATES"
EXACT_NOT_UNIQUE = "EVIDENCE_EXACT_AMOUNT_NOT_UNIQUE"
CONFLICTING = "EVIDENCE_CONFLICTING_LINKS"
TYPO = "EVIDENCE_TYPO_CANDIDATES"
INVALID = "EVIDENCE_INVALID_AMOUNT"
HOLD_CLASSES = {
    "REVIEW_HOLD_AMOUNT_VARIANCE": "AMOUNT_VARIANCE",
    "REVIEW_HOLD_MULTIPLE_CANDIDATES": "MULTIPLE_CANDIDATES",
    "REVIEW_HOLD_AMBIGUOUS_CANDIDATES": "MULTIPLE_CANDIDATES",
    "REVIEW_HOLD_EXACT_CANDIDATE_NOT_UNIQUE": "MULTIPLE_CANDIDATES",
    "REVIEW_HOLD_TYPO_CANDIDATES": "MULTIPLE_CANDIDATES",
    "REVIEW_HOLD_CONFLICTING_LINKS": "CONFLICTING_IDENTIFIER_LINKS",
    "REVIEW_HOLD_PO_ALREADY_REPRESENTED": "ALREADY_REPRESENTED_OR_CONSUMED_EVIDENCE",
    "REVIEW_HOLD_ALREADY_REPRESENTED": "ALREADY_REPRESENTED_OR_CONSUMED_EVIDENCE",
    "REVIEW_HOLD_HISTORICAL_CLEARANCE": "POSSIBLE_HISTORICAL_EVIDENCE",
    "REVIEW_HOLD_POTENTIAL_DUPLICATE": "POSSIBLE_DUPLICATE",
    "REVIEW_HOLD_WEAK_REFERENCE": "WEAK_EVIDENCE_REVIEW",
    "REVIEW_HOLD_FUZZY_MATCH": "WEAK_EVIDENCE_REVIEW",
    "REVIEW_HOLD_INVALID_AMOUNT": "INVALID_AMOUNT",
    "REVIEW_HOLD_CANDIDATE_INVALID_AMOUNT": "INVALID_AMOUNT",
    "REVIEW_HOLD_PO_REUSE": "PO_REUSE",
}
SHORT_CODES = {
    "REVIEW_HOLD_POTENTIAL_DUPLICATE": "POTENTIAL_DUPLICATE",
    "REVIEW_HOLD_ALREADY_REPRESENTED": "POTENTIAL_DUPLICATE",
    "REVIEW_HOLD_EXACT_CANDIDATE_NOT_UNIQUE": "NON_UNIQUE_CANDIDATE",
    "REVIEW_HOLD_AMBIGUOUS_CANDIDATES": "MULTIPLE_CANDIDATES",
    "REVIEW_HOLD_CANDIDATE_INVALID_AMOUNT": "INVALID_AMOUNT",
    "REVIEW_HOLD_FUZZY_MATCH": "FUZZY_CANDIDATE",
    "EXACT_A_DUPLICATE_EXCESS_COPY": "DUPLICATE_EXCLUDED",
    "TRUE_UNMATCHED_NO_B_CANDIDATE": "NO_B_CANDIDATE",
    "TRUE_UNMATCHED_PO_REUSE": "PO_REUSE_UNSUPPORTED",
}
HEAVY_REUSE = 6
DATE_WINDOW_DAYS = 31


def lookup(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(pairs[key], otherwise)


def short_code(code) -> Column:
    """Compact display code of a reason code."""
    return lookup(SHORT_CODES, code, F.regexp_replace(code, "^(REVIEW_HOLD_|TRUE_UNMATCHED_)", ""))


def candidate_counts(a_rows: DataFrame, b_rows: DataFrame, open_b: DataFrame) -> DataFrame:
    """Per A row: how many B rows share its PO or invoice, how many are still open, and the only open one.

    `b_rows` is the whole active B side and `open_b` its unconsumed part.
    """
    b = b_rows.join(open_b.select("row_id", F.lit(1).alias("open")), "row_id", "left").withColumn(
        "open", F.coalesce("open", F.lit(0))
    )

    def by(*keys: str) -> DataFrame:
        tag = "both" if len(keys) == 2 else keys[0].removeprefix("key_")
        is_open = F.col("open") == 1
        return b.filter(filled(list(keys))).groupBy(*keys).agg(
            F.count("*").alias(f"{tag}_n"), F.sum("open").alias(f"{tag}_open"),
            F.min(F.when(is_open, F.col("row_id"))).alias(f"{tag}_id"),
            F.max(F.when(is_open, F.col("cents"))).alias(f"{tag}_cents"),
        )

    out = join_filled(join_filled(a_rows, by("key_po"), ["key_po"], "row_id"), by("key_inv"), ["key_inv"], "row_id")
    out = join_filled(out, by("key_po", "key_inv").drop("both_id", "both_cents"), ["key_po", "key_inv"], "row_id")
    zero = F.lit(0)

    def union(kind: str) -> Column:
        return sum(
            (sign * F.coalesce(f"{tag}_{kind}", zero) for tag, sign in (("po", 1), ("inv", 1), ("both", -1))), start=zero
        )

    one = F.col("available") == 1
    from_po = F.coalesce("po_open", zero) > 0
    drop = [f"{tag}_{x}" for tag in ("po", "inv") for x in ("n", "open", "id", "cents")] + ["both_n", "both_open"]
    return (
        out.withColumns({"candidates": union("n"), "available": union("open")})
        .withColumns(
            {
                "only_id": F.when(one, F.when(from_po, F.col("po_id")).otherwise(F.col("inv_id"))),
                "only_cents": F.when(one, F.when(from_po, F.col("po_cents")).otherwise(F.col("inv_cents"))),
            }
        )
        .withColumn("difference", F.abs(F.col("cents") - F.col("only_cents")))
        .drop(*drop)
    )


def weak_links(a_rows: DataFrame, b_rows: DataFrame, open_b: DataFrame) -> DataFrame:
    """Per A row: B rows sharing only a placeholder reference, and open ones of the same amount."""
    b = b_rows.join(open_b.select("row_id", F.lit(True).alias("open")), "row_id", "left")
    out = a_rows
    for kind in ("po", "inv"):
        norm, key = f"norm_{kind}", f"key_{kind}"
        weak_b = b.filter((F.col(norm) != "") & (F.col(key) == ""))
        is_weak = (F.col(norm) != "") & (F.col(key) == "")
        counts = weak_b.groupBy(norm).agg(F.count("*").alias("_n"))
        exact = weak_b.filter("open AND cents IS NOT NULL").groupBy(norm, "cents").agg(F.count("*").alias("_e"))
        out = join_filled(join_filled(out, counts, [norm], "row_id"), exact, [norm, "cents"], "row_id").withColumns(
            {
                f"weak_{kind}": F.when(is_weak, F.coalesce("_n", F.lit(0))).otherwise(0),
                f"weak_exact_{kind}": F.when(is_weak, F.coalesce("_e", F.lit(0))).otherwise(0),
            }
        ).drop("_n", "_e")
    return out


def candidate_table(
    unmatched_a: DataFrame, b_rows: DataFrame, open_b: DataFrame, refused: DataFrame, typo_review: DataFrame
) -> DataFrame:
    """Exactly one evidence finding per unmatched A row, by ordered tests."""
    conflict = refused.groupBy(F.col("a_id").alias("row_id")).agg(F.lit(True).alias("conflict"))
    rows = weak_links(candidate_counts(unmatched_a, b_rows, open_b), b_rows, open_b)
    rows = rows.join(conflict, "row_id", "left").join(typo_review, "row_id", "left")
    finding = (
        F.when(F.col("cents").isNull(), INVALID)
        .when(F.col("conflict"), CONFLICTING)
        .when(F.col("typo_candidates") > 0, TYPO)
        .when(F.col("available") > 1, MULTIPLE)
        .when((F.col("available") == 1) & (F.col("difference") == 0), EXACT_NOT_UNIQUE)
        .when((F.col("available") == 1) & F.col("difference").isNotNull(), AMOUNT_DIFFERS)
        .when(F.col("available") == 1, INVALID)
        .when(F.col("candidates") > 0, CONSUMED)
        .when(F.col("weak_exact_po") + F.col("weak_exact_inv") > 0, WEAK_EXACT)
        .when(F.col("weak_po") + F.col("weak_inv") > 0, WEAK_ONLY)
        .otherwise(NO_EVIDENCE)
    )
    return rows.select(
        "row_id", "norm_po", "norm_inv", "key_po", "key_inv", "cents", "candidates", "available", "only_id",
        "only_cents", "difference", F.coalesce("typo_candidates", F.lit(0)).alias("typo_candidates"),
        finding.alias("finding"),
    )


def candidate_list(a_rows: DataFrame, b_rows: DataFrame, shown: int = 25) -> DataFrame:
    """The first candidate ids of each A row for display: strong links before weak ones, then file order."""
    links = []
    for kind in ("po", "inv"):
        key, norm = f"key_{kind}", f"norm_{kind}"
        for strength, column, usable in (
            (0, key, F.col(key) != ""), (1, norm, (F.col(norm) != "") & (F.col(key) == "")),
        ):
            first = first_per_group(
                b_rows.filter(usable).select(column, F.col("row_id").alias("b_id"), F.col("cents").alias("b_cents")),
                [column], [F.col("b_id")], shown,
            ).drop("_rank")
            links.append(
                a_rows.filter(usable).select("row_id", column).join(first, column)
                .select("row_id", "b_id", "b_cents", F.lit(strength).alias("strength"), F.lit(kind).alias("kind"))
            )
    every = links[0]
    for link in links[1:]:
        every = every.unionByName(link)
    merged = every.groupBy("row_id", "b_id").agg(
        F.min("strength").alias("strength"), F.max("b_cents").alias("b_cents"),
        F.concat_ws("+", F.array_sort(F.collect_set("kind"))).alias("kinds"),
    )
    return first_per_group(merged, ["row_id"], [F.col("strength"), F.col("b_id")], shown).drop("_rank")


def conflicting_b(refused: DataFrame, a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """B rows named by a conflict: the proposed ones and those that carry the A row's other identifier."""
    a = refused.select(F.col("a_id").alias("row_id")).distinct().join(a_rows.select("row_id", "key_po", "key_inv"), "row_id")
    out = refused.select(F.col("b_id").alias("row_id"))
    for key in ("key_po", "key_inv"):
        values = a.filter(F.col(key) != "").select(key).distinct()
        out = out.unionByName(b_rows.join(values, key, "left_semi").select("row_id"))
    return out.distinct()


def amount_variances(a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """Mutually unique references whose cents differ: PO and invoice, then invoice, then PO."""
    both = a_rows.unionByName(b_rows).filter("cents IS NOT NULL").select("side", "row_id", "key_po", "key_inv", "cents")
    out = None
    for tier, keys in (
        ("PO_AND_INVOICE", ["key_po", "key_inv"]), ("INVOICE_ONLY", ["key_inv"]), ("PO_ONLY", ["key_po"]),
    ):
        pairs = unique_pairs(both, keys, ["cents"]).filter("a_cents <> b_cents").select(
            "a_id", "b_id", "a_cents", "b_cents", F.lit(tier).alias("evidence")
        )
        # Later tiers and the result read the pairs, which would be searched again for each of them.
        pairs = cut(pairs, f"variances-{tier.lower()}", compression="zstd")
        out = pairs if out is None else out.unionByName(pairs)
        if tier != "PO_ONLY":
            gone = out.select(F.lit("A").alias("side"), F.col("a_id").alias("row_id")).unionByName(
                out.select(F.lit("B").alias("side"), F.col("b_id").alias("row_id"))
            )
            both = both.join(gone, ["side", "row_id"], "left_anti")
    reversal = (F.col("a_cents") == -F.col("b_cents")) & (F.col("a_cents") != 0)
    return out.withColumns(
        {
            "difference": F.col("a_cents") - F.col("b_cents"),
            "sign_reversal": reversal,
            "classification": F.when(reversal, "Critical possible sign reversal")
            .when(F.col("evidence") == "PO_AND_INVOICE", "High-likelihood amount variance")
            .when(F.col("evidence") == "INVOICE_ONLY", "Strong invoice-linked amount variance")
            .otherwise("PO-linked amount variance"),
        }
    )


def ambiguous_candidates(a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """Open A rows whose PO or invoice is shared by at least two open B rows."""
    counted = candidate_counts(a_rows, b_rows, b_rows)
    return counted.filter("candidates >= 2").select("row_id", "key_po", "key_inv", "cents", "candidates")


def po_reuse(a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """POs on at least two open A rows, every amount readable, whose total differs from the open B total."""
    a = (
        a_rows.filter("key_po <> ''").groupBy("key_po")
        .agg(F.count("*").alias("a_rows"), F.count("cents").alias("a_valid"), F.sum("cents").alias("a_total"))
        .filter("a_rows >= 2 AND a_rows = a_valid").drop("a_valid")
    )
    b = b_rows.filter("key_po <> '' AND cents IS NOT NULL").groupBy("key_po").agg(
        F.count("*").alias("b_rows"), F.sum("cents").alias("b_total")
    )
    zero = F.lit(0).cast("bigint")
    joined = a.join(b, "key_po", "left").withColumns(
        {"b_rows": F.coalesce("b_rows", zero), "b_total": F.coalesce("b_total", zero)}
    )
    return joined.withColumn("difference", F.col("a_total") - F.col("b_total")).filter("difference <> 0")


def historical_hits(a_rows: DataFrame, withheld: DataFrame) -> DataFrame:
    """A rows with the cents and the PO or invoice of a withheld historical row: two equi joins, never an OR join."""
    hits = None
    for key in ("norm_po", "norm_inv"):
        held = withheld.filter((F.col(key) != "") & F.col("cents").isNotNull()).select(key, "cents").distinct()
        found = a_rows.join(held, [key, "cents"], "left_semi").select("row_id")
        hits = found if hits is None else hits.unionByName(found)
    return hits.distinct().withColumn("historical_hit", F.lit(True))


def reference_holds(candidates: DataFrame, reuse: DataFrame, hits: DataFrame | None) -> DataFrame:
    """Hold code per candidate-table row, by ordered tests; rows without any support get none and are left out."""
    rows = join_filled(candidates, reuse.select("key_po", F.lit(True).alias("reused")), ["key_po"], "row_id")
    if hits is not None:
        rows = rows.join(hits, "row_id", "left")
    else:
        rows = rows.withColumn("historical_hit", F.lit(None).cast("boolean"))
    code = (
        F.when(F.col("cents").isNull(), "REVIEW_HOLD_INVALID_AMOUNT")
        .when(F.col("finding") == CONFLICTING, "REVIEW_HOLD_CONFLICTING_LINKS")
        .when(F.col("finding") == WEAK_EXACT, "REVIEW_HOLD_WEAK_REFERENCE")
        .when(F.col("typo_candidates") > 0, "REVIEW_HOLD_TYPO_CANDIDATES")
        .when(F.col("reused") & (F.col("candidates") > 0), "REVIEW_HOLD_PO_REUSE")
        .when(F.col("candidates") == 0, F.when(F.col("historical_hit"), "REVIEW_HOLD_HISTORICAL_CLEARANCE"))
        .when(F.col("available") == 0, "REVIEW_HOLD_PO_ALREADY_REPRESENTED")
        .when(F.col("available") > 1, "REVIEW_HOLD_MULTIPLE_CANDIDATES")
        .when(F.col("difference").isNull(), "REVIEW_HOLD_CANDIDATE_INVALID_AMOUNT")
        .when(F.col("difference") == 0, "REVIEW_HOLD_EXACT_CANDIDATE_NOT_UNIQUE")
        .otherwise("REVIEW_HOLD_AMOUNT_VARIANCE")
    )
    return rows.withColumn("code", code).filter("code IS NOT NULL").select(
        "row_id", "code", "finding", "candidates", "available", "only_id", "cents", "only_cents"
    )


def punctuation_notes(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    """Per match: key kinds whose values agree only after punctuation is ignored."""
    joined = bridge.join(rows.select("side", "row_id", "key_po", "key_inv", "exact_po", "exact_inv"), ["side", "row_id"])
    out = None
    for kind in ("po", "inv"):
        key, exact = f"key_{kind}", f"exact_{kind}"
        per_key = joined.filter(F.col(key) != "").groupBy("match_key", key).agg(
            F.collect_set(F.when(F.col("side") == "A", F.col(exact))).alias("a"),
            F.collect_set(F.when(F.col("side") == "B", F.col(exact))).alias("b"),
        )
        notes = per_key.filter((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")).select(
            "match_key", F.lit(kind).alias("kind"), F.array_sort("a").alias("a_values"), F.array_sort("b").alias("b_values")
        )
        out = notes if out is None else out.unionByName(notes)
    return out


def corroboration(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    """Per match: what customer and date say. Explains only; never decides."""
    from ..functions.identifiers import name_words

    joined = bridge.join(rows.select("side", "row_id", "customer", "txn_date"), ["side", "row_id"])
    is_a = F.col("side") == "A"
    name, words = F.when(F.col("customer") != "", F.col("customer")), name_words("customer")
    per = joined.groupBy("match_key").agg(
        F.collect_set(F.when(is_a, name)).alias("a_names"), F.collect_set(F.when(~is_a, name)).alias("b_names"),
        F.flatten(F.collect_set(F.when(is_a, words))).alias("a_words"),
        F.flatten(F.collect_set(F.when(~is_a, words))).alias("b_words"),
        F.collect_set(F.when(is_a, F.col("txn_date"))).alias("a_days"),
        F.collect_set(F.when(~is_a, F.col("txn_date"))).alias("b_days"),
    )
    gap = F.array_min(
        F.flatten(F.transform("a_days", lambda x: F.transform("b_days", lambda y: F.abs(F.datediff(x, y)))))
    )
    names = (
        F.when((F.size("a_names") == 0) | (F.size("b_names") == 0), "customer: not available on both sides")
        .when(F.arrays_overlap("a_names", "b_names") | F.arrays_overlap("a_words", "b_words"), "customer: agrees")
        .otherwise("customer: not comparable (different naming between systems)")
    )
    days = F.col("gap").cast("string")
    dated = (
        F.when(F.col("gap").isNull(), "date: not available on both sides")
        .when(F.col("gap") <= DATE_WINDOW_DAYS, F.concat(F.lit(f"date: within {DATE_WINDOW_DAYS} days ("), days, F.lit("d)")))
        .otherwise(F.concat(F.lit("date: "), days, F.lit(" days apart (accounting-period difference, not identity evidence)")))
    )
    return per.withColumn("gap", gap).select("match_key", names.alias("customer_note"), dated.alias("date_note"))


def heavy_reuse(rows: DataFrame) -> DataFrame:
    """Specific references on at least six rows of one ledger."""
    out = None
    for label, key in (("PO", "key_po"), ("Invoice", "key_inv")):
        counts = rows.filter(F.col(key) != "").groupBy("side", F.col(key).alias("value")).agg(F.count("*").alias("rows"))
        counts = counts.filter(F.col("rows") >= HEAVY_REUSE).withColumn("kind", F.lit(label))
        out = counts if out is None else out.unionByName(counts)
    return out


def evidence_sentences(bridge: DataFrame, rows: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Per match: which fields carried it and where each came from, with any harmless discrepancy."""
    joined = bridge.join(rows.select("side", "row_id", "po_field", "inv_field"), ["side", "row_id"])

    def fields(side: str, column: str) -> Column:
        return F.concat_ws(", ", F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col(column)))))

    per = joined.groupBy("match_key", "method").agg(
        fields("A", "po_field").alias("a_po"), fields("B", "po_field").alias("b_po"),
        fields("A", "inv_field").alias("a_inv"), fields("B", "inv_field").alias("b_inv"),
    )

    def part(word: str, label: str, a: str, b: str) -> Column:
        return F.when(F.col("method").contains(word), F.concat(F.lit(f"{label} (A "), F.col(a), F.lit("; B "), F.col(b), F.lit(")")))

    text = F.concat(
        F.lit("Matched on "), F.concat_ws(" + ", part("PO", "PO", "a_po", "b_po"), part("Invoice", "Invoice", "a_inv", "b_inv")),
        F.lit(" and exact signed amount"),
    )
    if notes is not None:
        said = notes.groupBy("match_key").agg(F.concat_ws("; ", F.array_sort(F.collect_set(F.concat(F.lit("punctuation differs in "), "kind")))).alias("said"))
        per = per.join(said, "match_key", "left")
        text = F.concat(text, F.coalesce(F.concat(F.lit(". Non-competing discrepancy: "), F.col("said")), F.lit("")))
    return per.select("match_key", text.alias("evidence"))


def already_matched(candidates: DataFrame, b_rows: DataFrame, bridge: DataFrame, register: DataFrame, named: int = 3) -> DataFrame:
    """For rows whose every candidate is taken: which matches took them, by PO, else by invoice, as one sentence."""
    refs = bridge.filter("side = 'B'").join(register.select("match_key", "match_ref"), "match_key").select("row_id", "match_ref")
    taken = b_rows.join(refs, "row_id").select("key_po", "key_inv", "match_ref")
    rows = candidates.filter(F.col("finding") == CONSUMED).select("row_id", "key_po", "key_inv")

    def per(key: str) -> DataFrame:
        distinct = taken.filter(F.col(key) != "").select(key, "match_ref").distinct()
        total = distinct.groupBy(key).agg(F.count("*").alias("n"))
        first = first_per_group(distinct, [key], [F.col("match_ref")], named).groupBy(key).agg(F.array_sort(F.collect_list("match_ref")).alias("refs"))
        return total.join(first, key)

    po = per("key_po").select("key_po", F.col("n").alias("po_n"), F.col("refs").alias("po_refs"))
    inv = per("key_inv").select("key_inv", F.col("n").alias("inv_n"), F.col("refs").alias("inv_refs"))
    out = join_filled(join_filled(rows, po, ["key_po"], "row_id"), inv, ["key_inv"], "row_id")
    by_po = F.col("po_n").isNotNull()
    refs_, n = F.when(by_po, F.col("po_refs")).otherwise(F.col("inv_refs")), F.when(by_po, F.col("po_n")).otherwise(F.col("inv_n"))
    more = F.when(n > named, F.concat(F.lit(" and "), (n - named).cast("string"), F.lit(" more"))).otherwise("")
    basis = F.when(by_po, "PO").otherwise("Invoice")
    return out.select("row_id", basis.alias("basis"), F.concat(basis, F.lit(" already represented by "), F.concat_ws(", ", refs_), more).alias("wording"))
