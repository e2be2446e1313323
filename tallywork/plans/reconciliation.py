"""The full two-ledger reconciliation, in its fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import assessments, duplicates, evidence, ledger, matching, reports, words
from ..operators.working import Roles, working_frame
from ..runtime import cut


@dataclass
class Matching:
    """What one matching call decides. `rows` are all its rows, with `matching.MATCH_COLUMNS`; so are the open ones, with link flags."""

    bridge: DataFrame
    refused: DataFrame
    open_rows: DataFrame
    rows: DataFrame
    fuzzy: DataFrame | None = None
    typo_words: DataFrame | None = None
    typo_review: DataFrame | None = None


@dataclass
class Reconciliation:
    """The named tables of a finished run. `a` and `b` are the working frames with link flags."""

    a: DataFrame
    b: DataFrame
    matching: Matching
    screening: dict[str, DataFrame]
    ledger: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def match_ledgers(both: DataFrame, fuzzy: bool = True, aliases: DataFrame | None = None) -> Matching:
    """One-to-one tiers, grouped tiers, confirmed aliases, word containment (held) and controlled typos."""
    rows = cut(both.select(*matching.MATCH_COLUMNS), "rows", compression="zstd")
    one, refused_one, open_rows = matching.match_one_to_one(rows)
    open_rows = flagged = cut(open_rows, "one-to-one-open", compression="zstd")
    grouped, refused_grouped, open_rows = matching.match_grouped_tiers(open_rows)
    bridges, refused = [one, grouped], [refused_one, refused_grouped]

    def vetted(bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Split a PO-keyed bridge into accepted groups and (a_id, b_id) evidence of refused ones."""
        link = cut(words.group_link(bridge, flagged), "links")
        good = bridge.join(link.filter("link <> 'CONFLICT'").select("match_key", "method"), ["match_key", "method"], "left_semi")
        bad = bridge.join(link.filter("link = 'CONFLICT'").select("match_key", "method"), ["match_key", "method"], "left_semi")
        pairs = bad.filter("side = 'A'").select("match_key", "method", F.col("row_id").alias("a_id")).join(
            bad.filter("side = 'B'").select("match_key", F.col("row_id").alias("b_id")), "match_key"
        )
        return good, pairs.select("a_id", "b_id", "method")

    if aliases is not None:
        good, bad = vetted(cut(words.match_aliases(open_rows, aliases), "alias-groups"))
        taken, open_rows = matching.consume(open_rows, good, "aliases")
        bridges.append(taken)
        refused.append(bad)
    out = Matching(matching.union_all(bridges), matching.union_all(refused), open_rows, rows)
    if fuzzy:
        out.fuzzy, open_rows = matching.consume(open_rows, words.match_contained(open_rows), "contained")
        pairs, review = words.match_typos(open_rows)
        pairs = cut(pairs, "typo-pairs")
        good, bad = vetted(matching.as_bridge(pairs, words.TYPO_METHOD))
        taken, open_rows = matching.consume(open_rows, good, "typos")
        out.bridge = out.bridge.unionByName(taken)
        out.refused = out.refused.unionByName(bad)
        out.typo_words, out.typo_review, out.open_rows = pairs, review, open_rows
    return out


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.filter(F.col("side") == side)


def _without(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("row_id"), "row_id", "left_anti")


def clear_with_history(open_a, open_b, history_a, history_b) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Match open rows of one ledger against screened historical rows of the other. Fuzzy and typo joins are off.

    Returns (clearances, open A, open B). `scope` says which side is historical; unused history never appears.
    """
    parts = []
    if history_b is not None:
        found = match_ledgers(open_a.unionByName(history_b), fuzzy=False).bridge.withColumn("scope", F.lit("B history"))
        parts.append(found)
        open_a = _without(open_a, _side(found, "A"))
    if history_a is not None:
        found = match_ledgers(history_a.unionByName(open_b), fuzzy=False).bridge.withColumn("scope", F.lit("A history"))
        parts.append(found)
        open_b = _without(open_b, _side(found, "B"))
    return (matching.union_all(parts) if parts else None), open_a, open_b


def reconcile_frames(
    a: DataFrame, b: DataFrame, history_a: DataFrame | None = None, history_b: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> Reconciliation:
    """Reconcile two working frames, with optional historical frames of either ledger."""
    ledgers = cut(a.unionByName(b), "ledgers")
    a, b = _side(ledgers, "A"), _side(ledgers, "B")
    decisions_a, active_a = duplicates.screen(a)
    decisions_b, active_b = duplicates.screen(b)
    decisions_a, decisions_b = cut(decisions_a, "screen-a"), cut(decisions_b, "screen-b")
    keep = matching.MATCH_COLUMNS
    excess = decisions_a.unionByName(decisions_b).filter(F.col("disposition") == duplicates.EXCESS)
    active = a.unionByName(b).join(excess.select("side", "row_id"), ["side", "row_id"], "left_anti")
    suspects = duplicates.suspected(decisions_a.unionByName(decisions_b))

    history, withheld_b, history_decisions = {}, None, {}
    for side, frame, primary in (("A", history_a, _side(active, "A")), ("B", history_b, _side(active, "B"))):
        if frame is None:
            history[side] = None
            continue
        decided, screened = duplicates.screen(frame, reference=primary)
        doubtful = duplicates.suspected(decided)
        history[side] = cut(screened.join(doubtful, ["side", "row_id"], "left_anti").select(*keep), f"history-{side}")
        history_decisions[side] = decided
        if side == "B":
            withheld_b = frame.join(doubtful, ["side", "row_id"], "left_semi")

    matched = match_ledgers(active, aliases=aliases)
    open_rows = matched.open_rows.select(*keep)
    clearances, open_a, open_b = clear_with_history(
        _side(open_rows, "A"), _side(open_rows, "B"), history["A"], history["B"]
    )
    first_open_b = _side(open_rows, "B")
    active_a, active_b = _side(matched.rows, "A"), _side(matched.rows, "B")
    candidates = cut(
        evidence.candidate_table(_side(open_rows, "A"), active_b, first_open_b, matched.refused, matched.typo_review),
        "candidates",
    )

    accounted = cut(duplicates.account_suspects(suspects, open_a.unionByName(open_b)), "suspects")
    held_a = _side(accounted, "A").filter(F.col("outcome") == duplicates.HOLD)
    # On side B every suspect still open is held; nothing is chosen as its representative.
    held_b = open_b.join(suspects, ["side", "row_id"], "left_semi")
    open_a, open_b = cut(_without(open_a, held_a), "open-a"), cut(_without(open_b, held_b), "open-b")

    conflict_a = candidates.filter(F.col("finding") == evidence.CONFLICTING).select("row_id")
    conflict_b = cut(evidence.conflicting_b(matched.refused, active_a, active_b), "conflict-b")
    clean_a, clean_b = _without(open_a, conflict_a), _without(open_b, conflict_b)
    variances = cut(evidence.amount_variances(clean_a, clean_b), "variances")
    varied_a, varied_b = variances.select(F.col("a_id").alias("row_id")), variances.select(F.col("b_id").alias("row_id"))
    open_a, open_b = _without(open_a, varied_a), _without(open_b, varied_b)
    ambiguous = cut(
        evidence.ambiguous_candidates(_without(clean_a, varied_a), _without(clean_b, varied_b)), "ambiguous"
    )
    open_a = cut(_without(open_a, ambiguous), "still-open-a")
    reuse = cut(evidence.po_reuse(open_a, open_b), "po-reuse")
    hits = evidence.historical_hits(open_a, withheld_b) if withheld_b is not None else None
    holds = cut(
        evidence.reference_holds(candidates.join(open_a.select("row_id"), "row_id", "left_semi"), reuse, hits), "holds"
    )
    reused = open_a.join(reuse.select("key_po"), "key_po", "left_semi").select(
        "row_id", F.lit("TRUE_UNMATCHED_PO_REUSE").alias("code")
    )

    reasons = evidence.lookup(ledger.MATCH_REASONS, F.col("method"), F.lit("MATCH"))
    outcomes = {
        "matched": _side(matched.bridge, "A").select("row_id", reasons.alias("code")),
        "duplicate": _side(excess, "A").select("row_id", F.lit("EXACT_A_DUPLICATE_EXCESS_COPY").alias("code")),
        "duplicate_hold": held_a.select("row_id", F.lit("REVIEW_HOLD_POTENTIAL_DUPLICATE").alias("code")),
        "variance": varied_a.withColumn("code", F.lit("REVIEW_HOLD_AMOUNT_VARIANCE")),
        "fuzzy": _side(matched.fuzzy, "A").select("row_id", F.lit("REVIEW_HOLD_FUZZY_MATCH").alias("code")),
        "ambiguous": ambiguous.select("row_id", F.lit("REVIEW_HOLD_AMBIGUOUS_CANDIDATES").alias("code")),
        "reference_hold": holds.select("row_id", "code"),
        "unmatched": reused,
    }
    if clearances is not None:
        outcomes["cleared"] = clearances.filter("scope = 'B history' AND side = 'A'").select(
            "row_id", F.concat(F.lit("PRIOR_PERIOD_"), reasons).alias("code")
        )
    book = cut(ledger.dispositions(a, outcomes), "ledger")
    tables = {
        "bridge": matched.bridge, "candidates": candidates, "variances": variances, "ambiguous": ambiguous,
        "po_reuse": reuse, "holds": holds, "suspects": accounted, "held_b": held_b, "open_b": open_b,
        "fuzzy": matched.fuzzy, "active": active, "excess": excess,
    }
    if clearances is not None:
        tables["clearances"] = clearances
    scoped = [frame for frame in (history_a, history_b) if frame is not None]
    if scoped:
        tables["history"] = matching.union_all([x.select("side", "row_id", "cents", "norm_po", "norm_inv") for x in scoped])
    screening = {"A": decisions_a, "B": decisions_b, **{f"history {k}": v for k, v in history_decisions.items()}}
    return Reconciliation(a, b, matched, screening, book, tables)


def reconcile(raw_a, raw_b, roles_a: Roles, roles_b: Roles, fiscal_year: int, **options) -> Reconciliation:
    """Reconcile two source tables; `options` as in `reconcile_frames`."""
    return reconcile_frames(
        working_frame(raw_a, roles_a, "A", fiscal_year), working_frame(raw_b, roles_b, "B", fiscal_year), **options
    )


def sectioned_rows(run: Reconciliation) -> DataFrame:
    """The paired-rows table: every row of both ledgers exactly once, side by side where a relationship lines it up.

    Columns: section, cause, match_key, a_id, b_id, a_cents, b_cents.
    """
    none = F.lit(None).cast("bigint")
    both = run.a.select("side", "row_id", "cents").unionByName(run.b.select("side", "row_id", "cents"))
    t, codes = run.tables, run.ledger.select(F.col("row_id").alias("a_id"), F.col("reason_code").alias("cause"))

    def lined(bridge: DataFrame, section: str) -> DataFrame:
        return ledger.paired(bridge.select("match_key", "method", "side", "row_id"), both).select(
            F.lit(section).alias("section"), F.col("method").alias("cause"), "match_key", "a_id", "b_id", "a_cents", "b_cents"
        )

    alone_a = run.ledger.filter(F.col("outcome").isin("duplicate", "duplicate_hold", "ambiguous", "reference_hold", "unmatched", "cleared")).select(
        "section", F.col("reason_code").alias("cause"), none.alias("match_key"), F.col("row_id").alias("a_id"), none.alias("b_id"),
        F.col("cents").alias("a_cents"), none.alias("b_cents"),
    )

    def named_b(ids: DataFrame, section: str, cause: str) -> DataFrame:
        return ids.select(F.lit(section).alias("section"), F.lit(cause).alias("cause"), "row_id")

    varied = t["variances"].join(codes, "a_id", "left").select(
        F.lit("08 Reference-Matched Amount Variance Review Hold").alias("section"), "cause", F.col("a_id").alias("match_key"), "a_id", "b_id", "a_cents", "b_cents"
    )
    parts = [
        lined(run.matching.bridge, "01 Matched"), lined(run.matching.fuzzy, "09 Fuzzy Match Review Hold"), varied,
        alone_a,
    ]
    alone_b = [
        named_b(t["excess"].filter("side = 'B'"), "05 Duplicate B", "Excluded excess copy"),
        named_b(t["held_b"], "07 Duplicate Review Hold B", "Potential duplicate"),
        named_b(t["open_b"], "03 Unmatched B", "No A row"),
    ]
    if "clearances" in t:
        alone_b.append(named_b(t["clearances"].filter("scope = 'A history' AND side = 'B'"), "01 Matched - Historical Clearance", "Prior period"))
    # Each name once, so that a row of B is there once for each section that names it.
    parts.append(run.b.select("row_id", "cents").join(matching.union_all(alone_b).distinct(), "row_id").select(
        "section", "cause", none.alias("match_key"), none.alias("a_id"), F.col("row_id").alias("b_id"), none.alias("a_cents"), F.col("cents").alias("b_cents")
    ))
    return matching.union_all(parts)


def metric_facts(run: Reconciliation, checks: DataFrame | None = None, subtotals: int = 0) -> DataFrame:
    """The facts `reports.run_metrics` sums: every row of the run under the populations it belongs to, every group once.

    Cents come with the rows, from one join of all stacked populations with both ledgers. `checks` are finished controls,
    `subtotals` the rows that source clean-up left out.
    """
    t, both = run.tables, run.a.select("side", "row_id", "cents").unionByName(run.b.select("side", "row_id", "cents"))

    def members(population, rows: DataFrame, side: str | None = None, row: str = "row_id") -> DataFrame:
        name = population if not isinstance(population, str) else F.lit(population)
        return rows.select(name.alias("population"), F.col("side") if side is None else F.lit(side).alias("side"), F.col(row).alias("row_id"))

    book = run.ledger
    populations = [
        members(F.col("outcome"), book, "A"), members(F.concat(F.lit("disposition "), F.col("disposition")), book, "A"),
        members("matched", _side(run.matching.bridge, "B")), members("duplicate", _side(t["excess"], "B")), members("duplicate_hold", t["held_b"]),
        members("variance", t["variances"], "B", "b_id"), members("fuzzy", _side(t["fuzzy"], "B")), members("unmatched", t["open_b"]),
        members("suspect", t["suspects"]),
    ]
    if "clearances" in t:
        populations.append(members("cleared", t["clearances"].filter("scope = 'A history' AND side = 'B'")))
    one = F.lit(1).cast("bigint").alias("n")
    none = F.lit(None).cast("bigint").alias("cents")

    def facts(population: str, rows: DataFrame, side: str | None = None, n=one, cents=none) -> DataFrame:
        return rows.select(F.lit(population).alias("population"), F.col("side") if side is None else F.lit(side).alias("side"), n.alias("n"), cents.cast("bigint").alias("cents"))

    parts = [
        matching.union_all(populations).join(both, ["side", "row_id"]).select("population", "side", one, "cents"),
        facts("source", both, cents=F.col("cents")),
        facts("variance difference", t["variances"], "A", cents=F.col("difference")),
        facts("po reuse", t["po_reuse"], "A", F.col("a_rows"), F.col("difference")),
        facts("fuzzy group", t["fuzzy"].select("match_key").distinct(), "A"),
    ]
    for side in "AB":
        decided = run.screening[side]
        parts.append(facts("duplicate group", decided.select("side", "group_id").distinct()))
        parts.append(facts("copy set", decided.filter("payload_confirmed").select("side", "copy_set_id").distinct()))
        if f"history {side}" in run.screening:
            decided = run.screening[f"history {side}"]
            excluded = decided.filter(F.col("disposition").isin(duplicates.EXCESS, duplicates.OVERLAP))
            parts.append(facts("history suspect", duplicates.suspected(decided)))
            parts.append(facts("history excluded", excluded.select("side", "row_id").distinct()))
            parts.append(facts("history", _side(t["history"], side)))
    if "clearances" in t:
        used = t["clearances"].filter(F.col("scope") == F.concat("side", F.lit(" history")))
        parts.append(facts("history used", used))
        parts.append(facts("clearance", t["clearances"].select("scope", "match_key").distinct(), "A"))
    if checks is not None:
        parts.append(facts("failed control", checks.filter("status <> 'PASS'"), "A"))
    if subtotals:
        parts.append(facts("subtotal", run.a.sparkSession.range(1), "A", F.lit(subtotals).cast("bigint")))
    return matching.union_all(parts)


def match_assessments(run: Reconciliation) -> DataFrame:
    """One assessment for every match, clearance, open A row and row held for reference evidence, variance or ambiguity."""
    t, both = run.tables, run.a.unionByName(run.b)
    a_open = run.a.join(run.ledger.filter("outcome = 'unmatched'").select("row_id"), "row_id", "left_semi")
    parts = [
        assessments.match_facts(run.matching.bridge, both), assessments.open_facts(a_open, t["candidates"]), assessments.hold_facts(run.a, t["holds"]),
        assessments.variance_facts(run.a, t["variances"]), assessments.ambiguous_facts(run.a, t["ambiguous"]),
    ]
    if "clearances" in t:
        columns = ["side", "row_id", "cents", "norm_po", "norm_inv"]
        for side, other in (("B", "A"), ("A", "B")):
            scope = f"{side} history"
            rows = _side(both, other).select(*columns).unionByName(_side(t["history"], side).select(*columns))
            parts.append(assessments.match_facts(t["clearances"].filter(F.col("scope") == scope).drop("scope"), rows, "clearance"))
    return assessments.assess(matching.union_all(parts))


def explained_rows(run: Reconciliation) -> DataFrame:
    """`sectioned_rows` with the cause, confidence and treatment of every row."""
    still = run.a.join(run.ledger.filter("outcome = 'unmatched'").select("row_id"), "row_id", "left_semi")
    groups = reports.repeated_invoice_cause(still, run.b).select("key_inv")
    repeated = still.filter("key_inv <> ''").join(groups, "key_inv", "left_semi").select("row_id")
    basis = run.screening["A"].unionByName(run.screening["B"]).select("side", "row_id", "basis")
    return assessments.exception_causes(sectioned_rows(run), basis, run.tables["candidates"], repeated)
