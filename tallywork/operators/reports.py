"""Summaries over working frames and outcome tables. Every report is a group-by; lists shown to people are top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import beside, numbered
from .matching import on_side
from .materials import REVIEW_LABELS, pack_size

URGENT_PERIODS = 2
TOP_NAMES = 10


def stack(frames: list[DataFrame]) -> DataFrame:
    """Stack reports, keeping every column of any of them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def totals(rows: DataFrame) -> DataFrame:
    """Exact signed and gross cents per side."""
    zero = F.lit(0)
    return rows.groupBy("side").agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("cents"), zero).alias("signed_cents"),
        F.coalesce(F.sum(F.abs("cents")), zero).alias("gross_cents"),
    )


def method_summary(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows, cents, difference and share of the A total per match method."""
    joined = bridge.join(rows.select("side", "row_id", "cents"), ["side", "row_id"])
    zero = F.lit(0)
    per = joined.groupBy("method").agg(
        F.count_if(F.col("side") == "A").alias("a_rows"), F.count_if(F.col("side") == "B").alias("b_rows"),
        F.coalesce(F.sum(on_side("A", F.col("cents"))), zero).alias("a_cents"),
        F.coalesce(F.sum(on_side("B", F.col("cents"))), zero).alias("b_cents"),
    )
    every = rows.filter("side = 'A'").agg(F.sum("cents").alias("all_cents"))
    return per.transform(beside, every).select(
        "method", "a_rows", "b_rows", "a_cents", "b_cents", (F.col("a_cents") - F.col("b_cents")).alias("difference"),
        (F.col("a_cents") / F.nullif("all_cents", F.lit(0))).alias("share"),
    )


def in_period(rows: DataFrame, label: str | None) -> DataFrame:
    return rows if label is None else rows.filter(F.col("fiscal_label") == label)


def _cases() -> Column:
    return F.coalesce(F.col("quantity").try_cast("double"), F.lit(0.0))


def product_summary(rows: DataFrame) -> DataFrame:
    """Cases, bottles and cents per product label; review labels come last and have no bottle count."""
    review = F.array_position(F.array(*[F.lit(x) for x in REVIEW_LABELS]), F.col("label"))
    per = rows.groupBy("label").agg(F.sum(_cases()).alias("cases"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    size = pack_size(F.col("label"))
    return per.select("label", size.alias("bottles_per_case"), "cases", (size * F.col("cases")).alias("bottles"), "cents", review.alias("_r")).orderBy("_r", "label").drop("_r")


def product_review(rows: DataFrame) -> DataFrame:
    """Lines whose product needs review."""
    return rows.filter(F.col("label").isin(*REVIEW_LABELS)).select("label", "row_id", "product", "customer", _cases().alias("cases"), "cents").orderBy("label", "row_id")


def customer_summary(rows: DataFrame) -> DataFrame:
    """Cases, bottles and cents per customer; bottles are null when no line has a known pack size."""
    named = rows.filter("customer IS NOT NULL AND customer <> ''")
    return named.groupBy("customer").agg(
        F.sum(_cases()).alias("cases"), F.sum(pack_size(F.col("label")) * _cases()).alias("bottles"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        F.coalesce(F.sum(F.when(pack_size(F.col("label")).isNull(), _cases())), F.lit(0.0)).alias("cases_without_bottles"),
    )


def exception_analysis(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Stack several breakdowns: {analysis: (rows with cents, dimension column)}."""
    return stack([
        rows.groupBy(F.col(column).cast("string").alias("dimension")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents")).withColumn("analysis", F.lit(name))
        for name, (rows, column) in parts.items()
    ])


def fiscal_exceptions(rows: DataFrame, period: int | None, year: int) -> DataFrame:
    """Open items per fiscal label, classed current, prior, urgent prior, future or unspecified."""
    p = F.regexp_extract("fiscal_label", r"^P(\d{2})-", 1).try_cast("int")
    y = F.regexp_extract("fiscal_label", r"-(\d{4})$", 1).try_cast("int")
    age = (F.lit(year * 13 + (period or 0)) - (y * 13 + p))
    kind = F.when(p.isNull(), "Unspecified Period - Review")
    if period is None:
        kind = kind.otherwise("Period not selected")
    else:
        kind = kind.when(age == 0, "Current Period").when(age < 0, "Future Period - Review").when(age <= URGENT_PERIODS, "Prior Period").otherwise("Urgent Prior Period")
    return rows.groupBy("fiscal_label", kind.alias("kind")).agg(
        F.count("*").alias("n_rows"), F.sum(_cases()).alias("quantity"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents")
    )


def age_buckets(rows: DataFrame, period: int, year: int) -> DataFrame:
    """Open items by age in fiscal periods, with shares of the absolute value."""
    p = F.regexp_extract("fiscal_label", r"^P(\d{2})-\d{4}$", 1).try_cast("int")
    y = F.regexp_extract("fiscal_label", r"^P\d{2}-(\d{4})$", 1).try_cast("int")
    age = F.lit(year * 13 + period) - (y * 13 + p)
    bucket = (
        F.when(age.isNull(), "Period not stated").when(age < 0, "After the selected period").when(age >= 3, "3 or more periods old")
        .when(age == 0, "Current period").when(age == 1, "1 period old").otherwise("2 periods old")
    )
    return _with_share(rows.groupBy(bucket.alias("item")).agg(*_measures()))


def _measures() -> list[Column]:
    return [F.count("*").alias("n_rows"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.coalesce(F.sum(F.abs("cents")), F.lit(0)).alias("gross")]


def _with_share(per: DataFrame) -> DataFrame:
    every = per.agg(F.sum("gross").alias("_all"))
    return per.transform(beside, every).withColumn("share", F.col("gross") / F.nullif("_all", F.lit(0))).drop("_all", "gross")


def same_amount(open_a: DataFrame, open_b: DataFrame) -> DataFrame:
    """Open rows whose non-zero cents also occur among the other side's open rows, and those whose do not."""
    def one(mine: DataFrame, other: DataFrame, side: str) -> DataFrame:
        rows = mine.filter("cents IS NOT NULL AND cents <> 0")
        pool = other.filter("cents <> 0").select("cents").distinct().withColumn("same", F.lit(True))
        return rows.join(pool, "cents", "left").groupBy(F.lit(side).alias("side"), F.coalesce("same", F.lit(False)).alias("same_amount")).agg(
            F.count("*").alias("n_rows"), F.sum("cents").alias("cents")
        )

    return one(open_a, open_b, "A").unionByName(one(open_b, open_a, "B"))


def top_with_rest(rows: DataFrame, name: str, limit: int = TOP_NAMES) -> DataFrame:
    """The largest names by absolute cents, and one line for all others with how many they are.

    Only the top names are ranked in one place: a top-k, not a sort of all names.
    """
    per = rows.groupBy(F.coalesce(F.nullif(name, F.lit("")), F.lit("(no name)")).alias("item")).agg(*_measures())
    top = per.orderBy(F.desc("gross"), "item").limit(limit)
    rest = per.join(F.broadcast(top.select("item")), "item", "left_anti").agg(
        F.count("*").alias("others"), F.sum("n_rows").alias("n_rows"), F.sum("cents").alias("cents"), F.sum("gross").alias("gross")
    ).filter("others > 0").select(F.concat(F.lit("All other ("), F.col("others").cast("string"), F.lit(")")).alias("item"), "n_rows", "cents", "gross")
    return _with_share(top.unionByName(rest))


def repeated_invoice_cause(open_a: DataFrame, b_rows: DataFrame) -> DataFrame:
    """Invoices on several open A rows with no B row of that invoice equal to the group total."""
    groups = open_a.filter("key_inv <> '' AND cents IS NOT NULL").groupBy("key_inv").agg(
        F.count("*").alias("n_rows"), F.sum("cents").alias("cents")
    ).filter("n_rows > 1")
    return groups.join(b_rows.filter("key_inv <> ''").select("key_inv", "cents").distinct(), ["key_inv", "cents"], "left_anti")


def amount_quality(source: DataFrame, amount: str) -> DataFrame:
    """Blank, unreadable, zero and negative amounts of a source column."""
    from ..functions.money import cents
    from ..functions.text import is_blank

    read = source.select(is_blank(amount).alias("blank"), cents(amount).alias("cents"))
    return read.agg(
        F.count("*").alias("n_rows"), F.count_if("blank").alias("blank"), F.count_if(~F.col("blank") & F.col("cents").isNull()).alias("unreadable"),
        F.count_if(F.col("cents") == 0).alias("zero"), F.count_if(F.col("cents") < 0).alias("negative"),
        F.coalesce(F.sum(F.when(F.col("cents") < 0, F.col("cents"))), F.lit(0)).alias("negative_cents"),
    )


def period_mismatch(rows: DataFrame, period: int) -> DataFrame:
    """One row when fewer than half of the readable rows belong to the selected period: its share and the common one."""
    p = F.regexp_extract("fiscal_label", r"^P(\d{2})-", 1).try_cast("int")
    counts = rows.select(p.alias("p")).filter("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("n"))
    found = counts.agg(
        F.sum("n").alias("readable"), F.coalesce(F.sum(F.when(F.col("p") == period, F.col("n"))), F.lit(0)).alias("selected"),
        F.max_by("p", F.struct("n", -F.col("p"))).alias("common_period"), F.max("n").alias("common_rows"),
    )
    return found.filter("readable > 0 AND selected < 0.5 * readable")


# Measures of a run: (name, population, side or None for both, what is summed). A fact is (population, side, n, cents).
MEASURES = (
    *((f"{side.lower()}_{name}", "source", side, what) for side in "AB" for name, what in (("rows", "n"), ("total", "cents"), ("gross", "gross"), ("invalid_amounts", "unreadable"))),
    *((f"matched_{side.lower()}_{name}", ("matched", "cleared"), side, what) for side in "AB" for name, what in (("rows", "n"), ("cents", "cents"), ("gross", "gross"))),
    *((f"matched_only_{side.lower()}_cents", "matched", side, "cents") for side in "AB"),
    *((f"{outcome}_{side.lower()}_{name}", outcome, side, what)
      for outcome in ("cleared", "unmatched", "duplicate", "duplicate_hold", "variance", "fuzzy") for side in "AB" for name, what in (("rows", "n"), ("cents", "cents"))),
    *((f"{outcome}_a_{name}", outcome, "A", what) for outcome in ("ambiguous", "reference_hold") for name, what in (("rows", "n"), ("cents", "cents"))),
    *((f"history_{side.lower()}_{name}", population, side, "n") for side in "AB" for name, population in (
        ("rows", "history"), ("used", "history used"), ("suspects", "history suspect"), ("excluded", "history excluded"))),
    *((f"suspect_{side.lower()}_rows", "suspect", side, "n") for side in "AB"),
    *((f"{side.lower()}_{name}", population, side, "n") for side in "AB" for name, population in (("duplicate_groups", "duplicate group"), ("copy_sets", "copy set"))),
    ("clearances", "clearance", None, "n"),
    ("variance_net", "variance difference", None, "cents"), ("variance_gross", "variance difference", None, "gross"),
    ("po_reuse_groups", "po reuse", None, "facts"), ("po_reuse_rows", "po reuse", None, "n"), ("po_reuse_net", "po reuse", None, "cents"),
    ("fuzzy_groups", "fuzzy group", None, "n"), ("subtotal_rows_excluded", "subtotal", None, "n"), ("failed_controls", "failed control", None, "n"),
    *((f"disposition_{d.lower()}_{name}", f"disposition {d}", "A", what)
      for d in ("MATCHED", "EXACT_A_DUPLICATE_EXCLUDED", "REVIEW_HOLD", "TRUE_UNMATCHED") for name, what in (("rows", "n"), ("cents", "cents"))),
)
# What keeps a run from being posted: (measure that must be zero, the reason).
BLOCKERS = (
    ("duplicate_hold_a_rows", "unresolved duplicate review holds of A"), ("duplicate_hold_b_rows", "unresolved duplicate review holds of B"),
    ("history_a_suspects", "unresolved duplicate review holds of A history"), ("history_b_suspects", "unresolved duplicate review holds of B history"),
    ("variance_a_rows", "unresolved amount variances"), ("ambiguous_a_rows", "unresolved ambiguous candidates"), ("fuzzy_groups", "unresolved fuzzy matches"),
    ("reference_hold_a_rows", "unresolved reference-evidence holds"), ("a_invalid_amounts", "invalid amounts of A"), ("b_invalid_amounts", "invalid amounts of B"),
)
EXCLUSIONS = ("duplicate_a_rows", "duplicate_b_rows", "history_a_excluded", "history_b_excluded")
GRAIN_BLOCKER = "the grain of the sources is not documented as safe for automatic duplicate exclusion"


def _measure(population, side: str | None, what: str) -> Column:
    names = (population,) if isinstance(population, str) else population
    meant = F.col("population").isin(*names)
    if side is not None:
        meant = meant & (F.col("side") == side)
    if what == "facts":
        return F.count_if(meant)
    value = {
        "n": F.col("n"), "cents": F.col("cents"), "gross": F.abs("cents"), "unreadable": F.when(F.col("cents").isNull(), F.col("n")),
    }[what]
    return F.coalesce(F.sum(F.when(meant, value)), F.lit(0)).cast("bigint")


def run_metrics(facts: DataFrame, grain_validated: bool = False) -> DataFrame:
    """One row: every measure of MEASURES, match rates, blockers and posting status.

    `facts`: (population, side, n, cents), a row or a group of rows each. All measures are conditional sums of one aggregate over one scan,
    with partial sums in every task; nothing is joined, and no count is distinct (groups come as facts of their own).
    An empty run has zeros, null rates and no blockers.
    """
    one = facts.agg(*[_measure(population, side, what).alias(name) for name, population, side, what in MEASURES])
    excluded = sum((F.col(x) for x in EXCLUSIONS), start=F.lit(0)) > 0
    reasons = [F.when(F.col(measure) > 0, F.lit(reason)) for measure, reason in BLOCKERS]
    if not grain_validated:
        reasons.append(F.when(excluded, F.lit(GRAIN_BLOCKER)))
    blockers = F.array_compact(F.array(*reasons))
    open_ = F.size(blockers) > 0
    return one.withColumns({
        "source_difference": F.col("a_total") - F.col("b_total"),
        "matched_difference": F.col("matched_only_a_cents") - F.col("matched_only_b_cents"),
        "history_a_ignored": F.col("history_a_rows") - F.col("history_a_used"), "history_b_ignored": F.col("history_b_rows") - F.col("history_b_used"),
        "proposed_entry_cents": F.col("disposition_true_unmatched_cents"),
        "a_match_rate": F.col("matched_a_rows") / F.nullif("a_rows", F.lit(0)),
        "a_match_rate_by_gross": F.col("matched_a_gross") / F.nullif("a_gross", F.lit(0)),
        "b_match_rate": F.col("matched_b_rows") / F.nullif("b_rows", F.lit(0)),
        "posting_blockers": F.when(open_, F.concat_ws("; ", blockers)).otherwise("None"),
        "posting_status": F.when(open_, "REVIEW REQUIRED").otherwise("READY TO POST"),
        "posting_authorization": F.when(open_, "DO NOT POST").otherwise("AUTHORIZED BY AUTOMATED CONTROLS"),
        "control_status": F.when(F.col("failed_controls") == 0, "PASS").otherwise("FAIL"),
    }).drop("matched_only_a_cents", "matched_only_b_cents")


def fuzzy_report(fuzzy: DataFrame, rows: DataFrame) -> DataFrame:
    """Word-containment groups held for review, with the words both sides share."""
    joined = fuzzy.join(rows.select("side", "row_id", "cents", "words"), ["side", "row_id"])
    return joined.groupBy("match_key").agg(
        F.count_if(F.col("side") == "A").alias("a_rows"), F.count_if(F.col("side") == "B").alias("b_rows"),
        F.sum(on_side("A", F.col("cents"))).alias("a_cents"), F.sum(on_side("B", F.col("cents"))).alias("b_cents"),
        F.concat_ws(", ", F.array_sort(F.array_intersect(
            F.array_distinct(F.flatten(F.collect_list(on_side("A", F.col("words"))))), F.array_distinct(F.flatten(F.collect_list(on_side("B", F.col("words"))))),
        ))).alias("shared_words"),
    ).withColumn("classification", F.when((F.col("a_rows") > 1) | (F.col("b_rows") > 1), "Fuzzy Match - Multiple Line Items Netting to One Total").otherwise("Fuzzy Match - Possible Text Variant of PO or Invoice"))


def outcome_sections(book: DataFrame) -> DataFrame:
    """Rows and cents per section of the paired rows, in section order."""
    return book.groupBy("section").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents")).orderBy("section")


def ranked_within(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """Rank inside each group; `order` must end in a unique column. Rows are range-partitioned by group and order, so
    one large group is spread over many tasks."""
    placed = numbered(rows, [*group, *order], "place")
    firsts = placed.groupBy(*group).agg(F.min("place").alias("first_place"))
    return placed.join(firsts, group).withColumn("rank", (F.col("place") - F.col("first_place") + 1).cast("bigint")).drop("place", "first_place")


# --- reviewer layer ---------------------------------------------------------------------------------------------

RELEASE, EXCLUDE, CONFIRM, CARRY = "RELEASE_TO_JE", "EXCLUDE", "CONFIRM_MATCH", "CARRY_FORWARD"


def decision_problems(decisions: DataFrame, book: DataFrame, b_rows: DataFrame, consumed_b: DataFrame) -> DataFrame:
    """(row_id, problem) for every decision that cannot be applied.

    `decisions`: row_id, action, decided_on, reason, support, b_ids (array of B row ids).
    """
    d = decisions.join(book.select("row_id", "disposition"), "row_id", "left")
    known = F.col("disposition").isNotNull()
    hold = F.col("disposition") == "REVIEW_HOLD"
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    problems = F.array_compact(F.array(
        F.when(~F.col("action").isin(RELEASE, EXCLUDE, CONFIRM, CARRY), "unknown action"), F.when(~known, "not a row of this run"),
        F.when(F.col("decided_on").isNull(), "a valid decision date is required"), F.when(blank("reason"), "a reason is required"),
        F.when(known & F.col("action").isin(RELEASE, CONFIRM, CARRY) & ~hold, "applies only to review holds"),
        F.when(known & (F.col("action") == EXCLUDE) & ~F.col("disposition").isin("TRUE_UNMATCHED", "REVIEW_HOLD"), "applies only to open or held rows"),
        F.when((F.col("action") == EXCLUDE) & blank("support"), "a supporting reference is required"),
        F.when((F.col("action") == CONFIRM) & (F.coalesce(F.size("b_ids"), F.lit(0)) <= 0), "must name the rows it matches"),
    ))
    own = d.select("row_id", F.explode(problems).alias("problem"))
    repeated = decisions.groupBy("row_id").count().filter("count > 1").select("row_id", F.lit("more than one decision for the same row").alias("problem"))
    claims = decisions.filter(F.col("action") == CONFIRM).select("row_id", F.explode("b_ids").alias("b_id"))
    b = claims.join(b_rows.select(F.col("row_id").alias("b_id"), F.lit(True).alias("exists")), "b_id", "left").join(
        consumed_b.select(F.col("row_id").alias("b_id"), F.lit(True).alias("taken")).distinct(), "b_id", "left")
    named = b.filter("exists IS NULL").select("row_id", F.lit("names a row that is not in this run").alias("problem"))
    taken = b.filter("taken").select("row_id", F.lit("names a row that is already consumed").alias("problem"))
    twice = claims.groupBy("b_id").agg(F.count_distinct("row_id").alias("n")).filter("n > 1").join(claims, "b_id").select("row_id", F.lit("names a row claimed by another decision").alias("problem"))
    return stack([own, repeated, named, taken, twice]).distinct()


def adjustment_bridge(decisions: DataFrame, book: DataFrame, b_rows: DataFrame) -> DataFrame:
    """Engine entry + released - excluded = adjusted entry, with memo and open lines, as (line, n_rows, cents)."""
    d = decisions.join(book.select("row_id", "disposition", "cents"), "row_id")
    named = decisions.filter(F.col("action") == CONFIRM).select("row_id", F.explode("b_ids").alias("b_id"))
    sums = named.join(b_rows.select(F.col("row_id").alias("b_id"), F.col("cents").alias("b_cents")), "b_id").groupBy("row_id").agg(F.sum("b_cents").alias("b_total"))
    d = d.join(sums, "row_id", "left").withColumn("gap", F.col("cents") - F.coalesce("b_total", F.lit(0)))
    action, zero = F.col("action"), F.lit(0)

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), zero)

    excluded = (action == EXCLUDE) & (F.col("disposition") == "TRUE_UNMATCHED")
    left = d.agg(
        F.count_if(action == RELEASE).alias("rel_n"), total(action == RELEASE, F.col("cents")).alias("rel"),
        F.count_if(action == EXCLUDE).alias("exc_n"), (-total(excluded, F.col("cents"))).alias("exc"),
        F.count_if(action == CONFIRM).alias("con_n"), total(action == CONFIRM, F.col("cents")).alias("con"),
        F.count_if((action == CONFIRM) & (F.col("gap") != 0)).alias("gap_n"), total(action == CONFIRM, F.col("gap")).alias("gap"),
        F.count_if(action == CARRY).alias("car_n"), total(action == CARRY, F.col("cents")).alias("car"),
    )
    undecided = book.filter("disposition = 'REVIEW_HOLD'").join(decisions.select("row_id").distinct(), "row_id", "left_anti").agg(F.count("*").alias("und_n"), F.coalesce(F.sum("cents"), zero).alias("und"))
    engine = book.filter("disposition = 'TRUE_UNMATCHED'").agg(F.count("*").alias("eng_n"), F.coalesce(F.sum("cents"), zero).alias("eng"))
    one, none = left.transform(beside, undecided).transform(beside, engine), F.lit(None).cast("bigint")
    lines = (
        ("Engine proposed entry", F.col("eng_n"), F.col("eng")), ("Plus: review holds released", F.col("rel_n"), F.col("rel")),
        ("Less: excluded with documentation", F.col("exc_n"), F.col("exc")), ("Adjusted entry", none, F.col("eng") + F.col("rel") + F.col("exc")),
        ("Memo: holds confirmed as matched", F.col("con_n"), F.col("con")), ("Memo: confirmed with a difference", F.col("gap_n"), F.col("gap")),
        ("Open: holds undecided or carried forward", F.col("und_n") + F.col("car_n"), F.col("und") + F.col("car")),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("line"), r.cast("bigint").alias("n_rows"), c.cast("bigint").alias("cents")) for n, r, c in lines])))
