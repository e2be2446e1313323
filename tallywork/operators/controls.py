"""Independent proofs over a finished run. Each check returns the rows that break it, or one line with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import beside
from .matching import MAX_GROUP, counted, on_side
from .reports import stack


def verdict(check: str, broken: DataFrame) -> DataFrame:
    """(check, expected, actual, difference, status): a check that must find nothing."""
    return broken.agg(F.count("*").alias("actual")).select(
        F.lit(check).alias("check"), F.lit(0).cast("bigint").alias("expected"), F.col("actual").cast("bigint"), F.col("actual").cast("bigint").alias("difference"),
        F.when(F.col("actual") == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def tie(check: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare two one-value frames."""
    left = expected.toDF("expected").select(F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"))
    right = actual.toDF("actual").select(F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))
    return left.transform(beside, right).select(
        F.lit(check).alias("check"), "expected", "actual", (F.col("expected") - F.col("actual")).alias("difference"),
        F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL").alias("status"),
    )


def multiple_populations(populations: DataFrame, source: DataFrame) -> DataFrame:
    """Rows in no population or in several: `populations` stacks (row_id) of every outcome."""
    seen = populations.groupBy("row_id").agg(F.count("*").alias("n"))
    return source.select("row_id").join(seen, "row_id", "full_outer").filter("n IS NULL OR n <> 1")


def consumed_twice(bridge: DataFrame) -> DataFrame:
    """Rows that sit in more than one match."""
    return bridge.groupBy("side", "row_id").agg(F.count_distinct("match_key").alias("n")).filter("n > 1")


def illegal_matches(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches that do not tie to the cent or have a shape no rule allows (1:1, 1:n, n:1 with n up to MAX_GROUP)."""
    per = bridge.join(rows.select("side", "row_id", "cents"), ["side", "row_id"]).groupBy("match_key").agg(
        counted("A").alias("a"), counted("B").alias("b"),
        F.sum(on_side("A", F.col("cents"))).alias("a_cents"), F.sum(on_side("B", F.col("cents"))).alias("b_cents"),
    )
    shape = (F.least("a", "b") == 1) & (F.greatest("a", "b") <= MAX_GROUP)
    return per.filter(~shape | ~F.col("a_cents").eqNullSafe(F.col("b_cents")))


def signed_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, difference): rows that `left` holds more often (above zero) or `right` does (below). Both are counted in one
    aggregate, the right side as minus one, so a value in a third of all rows is one partial row per task."""
    one = left.select(*columns, F.lit(1).cast("bigint").alias("difference"))
    other = right.select(*columns, F.lit(-1).cast("bigint").alias("difference"))
    return one.unionByName(other).groupBy(*columns).agg(F.sum("difference").alias("difference")).filter("difference <> 0")


def same_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only, each as often as it is there too often."""
    found = signed_difference(left, right, ["row_id"])
    return found.select("row_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("difference"))).alias("_n")).drop("_n")


def identities(run) -> tuple[DataFrame, DataFrame]:
    """What reports say, and what the ledger or the sources say, as (check, side, row_id) each: the two must hold the same rows.

    A side: each report holds the rows of its outcome; all outcomes together are the ledger A; the proposed entry is
    what no report names. B side: every population of B rows, once each, is the ledger B. Suspects: every held copy was a suspect
    first, and no suspect was excluded.
    """
    book, t = run.ledger, run.tables
    a_rows = {
        "Excess copies": t["excess"].filter("side = 'A'"), "Held copies": t["suspects"].filter("side = 'A' AND outcome LIKE 'Held%'"),
        "Amount variances": t["variances"].withColumnRenamed("a_id", "row_id"), "Fuzzy holds": t["fuzzy"].filter("side = 'A'"),
        "Ambiguous candidates": t["ambiguous"], "Reference holds": t["holds"], "Matches": run.matching.bridge.filter("side = 'A'"),
    }
    outcomes = {
        "Excess copies": "duplicate", "Held copies": "duplicate_hold", "Amount variances": "variance", "Fuzzy holds": "fuzzy",
        "Ambiguous candidates": "ambiguous", "Reference holds": "reference_hold", "Matches": "matched",
    }
    b_rows = [t["excess"].filter("side = 'B'"), t["held_b"], t["variances"].withColumnRenamed("b_id", "row_id"), t["fuzzy"].filter("side = 'B'"),
              run.matching.bridge.filter("side = 'B'"), t["open_b"]]
    if "clearances" in t:
        a_rows["Clearances"] = t["clearances"].filter("scope = 'B history' AND side = 'A'")
        outcomes["Clearances"] = "cleared"
        b_rows.append(t["clearances"].filter("scope = 'A history' AND side = 'B'"))

    def named(check: str, side: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), F.lit(side).alias("side"), "row_id")

    said = [named(f"{name}: report and ledger", "A", rows) for name, rows in a_rows.items()]
    known = [named(f"{name}: report and ledger", "A", book.filter(F.col("outcome") == outcomes[name])) for name in a_rows]
    entry = book.filter("in_proposed_entry")
    said += [named("Reports and proposed entry are ledger A", "A", rows) for rows in (*a_rows.values(), entry)]
    known.append(named("Reports and proposed entry are ledger A", "A", run.a))
    said += [named("B populations are ledger B", "B", rows) for rows in b_rows]
    known.append(named("B populations are ledger B", "B", run.b))
    # Rows held as copies that no screening suspected, or suspects that were excluded as well, have no counterpart.
    for side in "AB":
        suspects = t["suspects"].filter(F.col("side") == side)
        excluded = suspects.join(t["excess"].select("side", "row_id"), ["side", "row_id"], "left_semi")
        said.append(named(f"No suspect of {side} is excluded", side, excluded))
        known.append(named(f"No suspect of {side} is excluded", side, suspects.limit(0)))
    return stack(said), stack(known)


def identity_breaks(run) -> DataFrame:
    """(check, side, row_id, difference) of every row that breaks an identity of `identities`, all in one aggregate."""
    return signed_difference(*identities(run), ["check", "side", "row_id"])


def identity_controls(run) -> DataFrame:
    """(check, n_rows, broken, status): one line an identity, with the rows the reports hold."""
    said, known = identities(run)
    both = said.select("check", "side", "row_id", F.lit(1).alias("d")).unionByName(known.select("check", "side", "row_id", F.lit(-1).alias("d")))
    rows = both.groupBy("check", "side", "row_id").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("n"))
    lines = rows.groupBy("check").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("d") != 0).alias("broken"))
    names = [f"{x}: report and ledger" for x in (
        "Excess copies", "Held copies", "Amount variances", "Fuzzy holds", "Ambiguous candidates", "Reference holds", "Matches"
    )] + ["Reports and proposed entry are ledger A", "B populations are ledger B", "No suspect of A is excluded", "No suspect of B is excluded"]
    if "clearances" in run.tables:
        names.append("Clearances: report and ledger")
    every = lines.sparkSession.createDataFrame([(n,) for n in names], "check string")
    broken = F.coalesce("broken", F.lit(0))
    return every.join(lines, "check", "left").select(
        "check", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), broken.alias("broken"), F.when(broken == 0, "PASS").otherwise("FAIL").alias("status")
    )


# What a row adds to the figures of its id: source rows and cents, ledger rows (all, not unmatched, held), matches, other populations.
_COUNTS = ("n", "cents", "booked", "settled", "held", "matched", "taken", "open", "fuzzy", "copies", "reported")


def _per_id(run) -> DataFrame:
    """One row for each (side, row_id): how often every place of a run holds it, from one aggregate over all places stacked."""
    t, book = run.tables, run.ledger

    def adds(rows: DataFrame, side: str | None = None, row: str = "row_id", match: Column | None = None, **values) -> DataFrame:
        given = {name: F.lit(v) if isinstance(v, int) else v for name, v in values.items()}
        return rows.select(
            F.col("side") if side is None else F.lit(side).alias("side"), F.col(row).alias("row_id"),
            *[F.coalesce(given.get(name, F.lit(0)), F.lit(0)).cast("bigint").alias(name) for name in _COUNTS],
            (F.lit(None) if match is None else match).cast("bigint").alias("match_key"),
        )

    def on(name: str, side: str) -> DataFrame:
        return t[name].filter(F.col("side") == side)

    parts = [
        adds(run.a, "A", n=1, cents=F.col("cents")), adds(run.b, "B", n=1, cents=F.col("cents")),
        adds(book, "A", booked=1, settled=(F.col("outcome") != "unmatched").cast("int"), held=(F.col("disposition") == "REVIEW_HOLD").cast("int")),
        adds(run.matching.bridge, match=F.col("match_key"), matched=1, taken=1),
        adds(on("excess", "B"), taken=1), adds(t["held_b"], "B", taken=1), adds(t["variances"], "B", "b_id", taken=1), adds(t["open_b"], "B", open=1),
        adds(on("fuzzy", "B"), taken=1), adds(on("fuzzy", "A"), fuzzy=1, reported=1), adds(t["variances"], "A", "a_id", reported=1),
        adds(t["ambiguous"], "A", reported=1), adds(t["holds"], "A", reported=1), adds(on("suspects", "A").filter("outcome LIKE 'Held%'"), copies=1, reported=1),
    ]
    if "clearances" in t:
        parts.append(adds(t["clearances"].filter("scope = 'A history' AND side = 'B'"), taken=1))
    return stack(parts).groupBy("side", "row_id").agg(
        *[F.sum(name).alias(name) for name in _COUNTS], (F.min("match_key") < F.max("match_key")).alias("twice")
    )


def _unequal(places: Column) -> Column:
    """Source rows of an id that are not in exactly one place, or an id that only the places have, several times. A null id finds nothing."""
    alone = F.when(places > 1, 1).otherwise(0)
    return F.when(F.col("row_id").isNull(), F.col("n") + alone).when(F.col("n") > 0, F.when(places != 1, F.col("n")).otherwise(0)).otherwise(alone)


def _control_figures(run) -> DataFrame:
    """One row with the figures of `_ROW_CHECKS` and `_AMOUNT_CHECKS`. What a join of a population with its source would sum is the product of
    their counts for each id."""
    t, real = run.tables, F.col("row_id").isNotNull()
    a, b, n, cents = F.col("side") == "A", F.col("side") == "B", F.col("n"), F.col("cents")
    everywhere = F.col("taken") + F.col("open")

    def total(name: str, value: Column, *where: Column) -> Column:
        for condition in where:
            value = F.when(condition, value)
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)

    rows = _per_id(run).agg(
        total("a_rows", n, a), total("a_cents", cents, a), total("b_rows", n, b), total("b_cents", cents, b),
        total("a_unequal", _unequal(F.col("booked")), a), total("b_unequal", _unequal(everywhere), b),
        total("a_matched_cents", F.col("matched") * cents, a, real), total("b_matched_cents", F.col("matched") * cents, b, real),
        total("consumed_twice", F.lit(1), F.col("twice")), total("held_unequal", F.abs(F.col("held") - F.col("reported")), a),
        total("unsettled_cents", cents, a, ~real | (F.col("settled") == 0)), total("a_bridge_rows", F.col("matched"), a),
        total("b_found_rows", everywhere * n, b, real), total("b_found_cents", everywhere * cents, b, real),
        total("b_unclaimed_cents", cents, b, ~real | (F.col("taken") == 0)), total("b_open_cents", F.col("open") * cents, b, real),
        total("copies_cents", F.col("copies") * cents, a, real), total("fuzzy_cents", F.col("fuzzy") * cents, a, real),
    )
    outside = ~F.col("in_proposed_entry")
    book = run.ledger.agg(
        F.count("*").alias("book_rows"), total("book_cents", cents), total("book_matched", F.lit(1), F.col("outcome") == "matched"),
        total("book_duplicate", cents, F.col("outcome") == "duplicate"), total("book_entry", cents, F.col("in_proposed_entry")),
        total("book_known", F.lit(1), F.col("disposition").isin("MATCHED", "EXACT_A_DUPLICATE_EXCLUDED", "REVIEW_HOLD", "TRUE_UNMATCHED")),
        *[total(f"book_{x}", cents, F.col("outcome") == x, outside) for x in ("duplicate_hold", "variance", "ambiguous", "fuzzy", "reference_hold")],
    )
    for other in (
        book, illegal_matches(run.matching.bridge, run.a.select("side", "row_id", "cents").unionByName(run.b.select("side", "row_id", "cents"))).agg(F.count("*").alias("illegal")),
        t["excess"].agg(total("excess_cents", cents, a)), t["variances"].agg(total("variance_cents", F.col("a_cents"))),
        t["ambiguous"].agg(total("ambiguous_cents", cents)), t["holds"].agg(total("holds_cents", cents)),
    ):
        rows = rows.transform(beside, other)
    return rows


# Fixed values: (check, expected figure, actual figure); a check without an expected figure must find nothing.
_ROW_CHECKS = (
    ("A row completeness", "a_rows", "book_rows"), ("A amount roll-forward", "a_cents", "book_cents"),
    ("Every A row has exactly one final disposition", None, "a_unequal"), ("Every B row is in exactly one population", None, "b_unequal"),
    ("Matched totals agree", "a_matched_cents", "b_matched_cents"), ("Every match ties to the cent and has a legal shape", None, "illegal"),
    ("No record is consumed twice", None, "consumed_twice"), ("Held rows are the rows of the hold reports", None, "held_unequal"),
    ("Matched rows of the ledger are the rows of the bridge", "book_matched", "a_bridge_rows"), ("Excess copies are excluded", "excess_cents", "book_duplicate"),
    ("Proposed entry = unmatched rows", "book_entry", "unsettled_cents"),
)
_AMOUNT_CHECKS = (
    ("B row completeness", "b_rows", "b_found_rows"), ("B amount roll-forward", "b_cents", "b_found_cents"),
    ("B rows that nothing claimed are reported apart", "b_unclaimed_cents", "b_open_cents"), ("Every A row has a known disposition", "a_rows", "book_known"),
    ("Held copies of A are kept out of the entry", "copies_cents", "book_duplicate_hold"), ("Amount variances are kept out of the entry", "variance_cents", "book_variance"),
    ("Ambiguous candidates are kept out of the entry", "ambiguous_cents", "book_ambiguous"), ("Fuzzy holds are kept out of the entry", "fuzzy_cents", "book_fuzzy"),
    ("Reference holds are kept out of the entry", "holds_cents", "book_reference_hold"),
)


def _spelled(figures: DataFrame, checks: tuple) -> DataFrame:
    """(check, expected, actual, difference, status) of a row of figures. Checks that must find nothing show what they found as the difference."""
    lines = F.array(*[
        F.struct(
            F.lit(check).alias("check"), (F.lit(0) if expected is None else F.col(expected)).cast("bigint").alias("expected"), F.col(actual).cast("bigint").alias("actual"),
            F.lit(-1 if expected is None else 1).alias("sign"),
        )
        for check, expected, actual in checks
    ])
    return figures.select(F.inline(lines)).select(
        "check", "expected", "actual", (F.col("sign") * (F.col("expected") - F.col("actual"))).alias("difference"),
        F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL").alias("status"),
    )


def balance_controls(run) -> DataFrame:
    """The controls table of a reconciliation: completeness, roll-forward, ties, shapes, and report identity.

    Figures are taken from different places (source frames, bridge, outcome tables, ledger), so a broken outcome fails.
    """
    return _with_clearances(_spelled(_control_figures(run), _ROW_CHECKS + _AMOUNT_CHECKS), run)


def figure(check: str, role: str, rows: DataFrame, value) -> DataFrame:
    """Rows as addends of one side ('expected' or 'actual') of a check."""
    return rows.select(F.lit(check).alias("check"), F.lit(role).alias("role"), F.coalesce(value, F.lit(0)).cast("bigint").alias("v"))


def tied_figures(figures: list[DataFrame]) -> DataFrame:
    """All checks of stacked figures from one aggregate: (check, expected, actual, difference, status). A check is named by an addend of
    zero on each side, so that one without rows is a line as well."""
    rows = stack(figures)
    sums = rows.groupBy("check").agg(*[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("v"))), F.lit(0)).alias(r) for r in ("expected", "actual")])
    return sums.select("check", "expected", "actual", (F.col("expected") - F.col("actual")).alias("difference"), F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL").alias("status"))


def amount_controls(run) -> DataFrame:
    """Rows and signed cents of every population of both ledgers against a figure from elsewhere.

    A: each report against the ledger's rows of that outcome. B: its populations against the source, and what no
    population but the open one claims against the open rows. History: what cleared against what was cleared.
    """
    return _with_clearances(_spelled(_control_figures(run), _AMOUNT_CHECKS), run)


def _with_clearances(lines: DataFrame, run) -> DataFrame:
    """The line of historical clearances, where there are any."""
    t, cents = run.tables, F.col("cents")
    if "clearances" not in t:
        return lines

    def of(rows: DataFrame, source: DataFrame) -> DataFrame:
        return rows.select("row_id").join(source.select("row_id", "cents"), "row_id")

    name = "Historical clearance amount difference"
    figures = [lines.sparkSession.createDataFrame([(name, "expected", 0)], "check string, role string, v bigint")]
    for scope, source, ledger in (("A history", "B", run.b), ("B history", "A", run.a)):
        rows = t["clearances"].filter(F.col("scope") == scope)
        live, old = rows.filter(F.col("side") == source), rows.filter(F.col("side") != source)
        figures += [figure(name, "expected", of(live, ledger), cents), figure(name, "actual", of(old, t["history"].filter(F.col("side") != source)), cents)]
    return lines.unionByName(tied_figures(figures))


def stop_on_failure(checks: DataFrame) -> None:
    """Raise when any control failed; call before results are written."""
    bad = [r["check"] for r in checks.filter("status <> 'PASS'").select("check").limit(20).collect()]
    if bad:
        raise ValueError("Controls failed: " + "; ".join(bad))


def table_digest(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(table_name, columns, n_rows, digest): a digest of a table's rows that does not depend on their order.

    Each row is spelled as its cells in column-name order, each with its length, so no two rows are spelled alike, and hashed
    to 128 bits; the four words of the hashes are summed. So a table of any size is one aggregate with partial sums,
    a repeated row counts as often as it is there, and equal digests mean equal rows, but for chance. A null cell differs from
    an empty one. No rows: sums of zero.
    """
    names = sorted(columns or df.columns)
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in names]
    hashed = df.select(F.md5(F.concat_ws("|", *cells).cast("binary")).alias("h"))
    word = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k, x in enumerate(word)]
    spelled = F.concat_ws("|", F.lit(",".join(names)), F.col("n_rows").cast("string"), *[f"s{k}" for k in range(4)])
    return hashed.agg(F.count("*").alias("n_rows"), *sums).select(
        F.lit(name).alias("table_name"), F.lit(",".join(names)).alias("columns"), "n_rows", F.sha2(spelled, 256).alias("digest")
    )


def changed_tables(before: DataFrame, now: DataFrame) -> DataFrame:
    """Tables of two lists of digests that differ, are gone or are new."""
    a, b = (x.select("table_name", F.col("digest").alias(n)) for x, n in ((before, "before"), (now, "now")))
    return a.join(b, "table_name", "full_outer").filter(~F.col("before").eqNullSafe(F.col("now")))


def record_digest(columns: list[str]) -> Column:
    """Digest of a record's content, in column order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def tampered(records: DataFrame, columns: list[str], digest: str = "digest") -> DataFrame:
    """Records whose stored digest does not match their content."""
    return records.filter(~F.col(digest).eqNullSafe(record_digest(columns)))
