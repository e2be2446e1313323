"""The whole reconciliation on a small hand-made pair of ledgers: one row per rule, and controls that notice damage."""

import pytest
from pyspark.sql import functions as F

from tallywork.operators import controls, ledger
from tallywork.operators.working import Roles
from tallywork.plans.reconciliation import reconcile

SCHEMA = "source_pos bigint, po string, inv string, amt string, cust string, day string, item string, qty string"
ROLES = Roles(po="po", invoice="inv", amount="amt", customer="cust", date="day", product="item", quantity="qty")


def rows(spark, data):
    return spark.createDataFrame([(n, po, inv, amt, cust, "2026-01-05", "item", "1") for n, po, inv, amt, cust in data], SCHEMA)


A = [
    (1, "PO 100", "I1", "$10.00", "x"),            # exact
    (2, "PO-20-0", "I2", "20.00", "x"),            # punctuation only
    (3, "300", "", "30.00", "x"),                  # one A row, two B rows
    (4, "400", "I4", "40.00", "x"),                # amount differs
    (5, "NA", "", "50.00", "x"),                   # weak reference, exact amount
    (6, "600", "I6", "60.00", "x"),                # nowhere
    (7, "700", "I7", "70.00", "x"), (8, "700", "I7", "70.00", "x"),      # confirmed copy
    (9, "900", "I9", "90.00", "x"), (10, "900", "I9", "90.00", "other"),  # same key, other customer
    (11, "1100", "I12", "11.00", "x"),             # PO and invoice point at different rows
    (12, "1200", "I13", "n/a", "x"),               # unreadable
    (13, "HOPPER", "", "13.00", "x"),              # word containment
    (14, "ELIOT SMITH", "", "14.00", "x"),         # typo
    (15, "1500", "", "15.00", "x"), (16, "1500", "", "16.00", "x"),      # PO used twice, one B row consumed neither
    (17, "1700", "I17", "17.00", "x"),             # cleared by history
    (18, "1800", "", "18.00", "x"),                # two open B rows share the PO
]
B = [
    (1, "100", "I1", "10.00", "x"), (2, "200", "I2", "20.00", "x"), (3, "300", "", "12.00", "x"), (4, "300", "", "18.00", "x"),
    (5, "400", "I4", "41.00", "x"), (6, "NA", "", "50.00", "x"), (7, "700", "I7", "70.00", "x"), (9, "900", "I9", "90.00", "x"),
    (11, "1100", "I11", "11.00", "x"), (12, "1112", "I12", "99.00", "x"), (13, "DAVID HOPPER 2.2", "", "13.00", "x"),
    (14, "ELLIOT SMITH", "", "14.00", "x"), (15, "1500", "", "40.00", "x"), (18, "1800", "", "1.00", "x"), (19, "1800", "", "2.00", "x"),
]
HISTORY_B = [(1, "1700", "I17", "17.00", "x")]


@pytest.fixture(scope="module")
def run(spark):
    from tallywork.operators.working import working_frame

    history = working_frame(rows(spark, HISTORY_B), ROLES, "B", 2026)
    return reconcile(rows(spark, A), rows(spark, B), ROLES, ROLES, 2026, history_b=history)


def test_every_row_has_the_expected_outcome(run):
    got = {r["row_id"]: (r["outcome"], r["reason_code"]) for r in run.ledger.collect()}
    assert got == {
        1: ("matched", "MATCH_EXACT_PO_INVOICE_AMOUNT"), 2: ("matched", "MATCH_EXACT_PO_INVOICE_AMOUNT"),
        3: ("matched", "MATCH_AGGREGATE_PO_AMOUNT"), 4: ("variance", "REVIEW_HOLD_AMOUNT_VARIANCE"),
        5: ("reference_hold", "REVIEW_HOLD_WEAK_REFERENCE"), 6: ("unmatched", "TRUE_UNMATCHED_NO_B_CANDIDATE"),
        7: ("matched", "MATCH_EXACT_PO_INVOICE_AMOUNT"), 8: ("duplicate", "EXACT_A_DUPLICATE_EXCESS_COPY"),
        9: ("reference_hold", "REVIEW_HOLD_EXACT_CANDIDATE_NOT_UNIQUE"),
        10: ("duplicate_hold", "REVIEW_HOLD_POTENTIAL_DUPLICATE"),
        11: ("reference_hold", "REVIEW_HOLD_CONFLICTING_LINKS"), 12: ("reference_hold", "REVIEW_HOLD_INVALID_AMOUNT"),
        13: ("fuzzy", "REVIEW_HOLD_FUZZY_MATCH"), 14: ("matched", "MATCH_CONTROLLED_PO_TYPO"),
        15: ("reference_hold", "REVIEW_HOLD_PO_REUSE"), 16: ("reference_hold", "REVIEW_HOLD_PO_REUSE"),
        17: ("cleared", "PRIOR_PERIOD_MATCH_EXACT_PO_INVOICE_AMOUNT"), 18: ("ambiguous", "REVIEW_HOLD_AMBIGUOUS_CANDIDATES"),
    }


def test_all_controls_pass_and_the_gate_opens(run):
    checks = controls.balance_controls(run)
    assert {r["check"]: r["status"] for r in checks.collect() if r["status"] != "PASS"} == {}
    controls.stop_on_failure(checks)


@pytest.mark.parametrize("damage", ["ledger", "bridge", "open_b"])
def test_damage_is_noticed(run, damage):
    import dataclasses

    if damage == "ledger":
        broken = dataclasses.replace(run, ledger=run.ledger.filter("row_id <> 6"))
    elif damage == "bridge":
        extra = run.matching.bridge.filter("side = 'A' AND row_id = 1").withColumn("match_key", F.lit(99).cast("bigint"))
        broken = dataclasses.replace(run, matching=dataclasses.replace(run.matching, bridge=run.matching.bridge.unionByName(extra)))
    else:
        broken = dataclasses.replace(run, tables={**run.tables, "open_b": run.tables["open_b"].limit(0)})
    with pytest.raises(ValueError):
        controls.stop_on_failure(controls.balance_controls(broken))


def test_paired_rows_hold_every_row_once(run):
    from tallywork.plans.reconciliation import sectioned_rows

    rows_ = sectioned_rows(run).collect()
    assert sorted(r["a_id"] for r in rows_ if r["a_id"] is not None) == [a[0] for a in A]
    assert sorted(r["b_id"] for r in rows_ if r["b_id"] is not None) == [b[0] for b in B]


def test_register_numbers_matches_by_earliest_row(run):
    both = run.a.unionByName(run.b)
    got = {r["match_key"]: (r["match_ref"], r["match_type"]) for r in ledger.match_register(run.matching.bridge, both).collect()}
    assert got[1] == ("M-001", "One-to-One") and got[3] == ("G-001", "Grouped") and got[14][0] == "M-004"
    lines = [(r["seq"], r["a_id"], r["b_id"]) for r in ledger.paired(run.matching.bridge, both).filter("match_key = 3").orderBy("seq").collect()]
    assert lines == [(1, 3, 3), (2, None, 4)]


def test_result_does_not_depend_on_input_order(spark, run):
    from tallywork.operators.working import working_frame

    history = working_frame(rows(spark, HISTORY_B), ROLES, "B", 2026)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = reconcile(rows(spark, A[::-1]), rows(spark, B[::-1]), ROLES, ROLES, 2026, history_b=history)
        columns = ["row_id", "outcome", "reason_code"]
        assert again.ledger.select(*columns).exceptAll(run.ledger.select(*columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_identities_hold_and_every_damage_breaks_one(run):
    from dataclasses import replace

    assert controls.identity_breaks(run).collect() == []
    lines = {r["check"]: (r["n_rows"], r["status"]) for r in controls.identity_controls(run).collect()}
    assert {s for _, s in lines.values()} == {"PASS"} and lines["Matches: report and ledger"][0] > 0 and lines["Clearances: report and ledger"][0] == 1

    def broken(**changes):
        damaged = replace(run, **{k: v for k, v in changes.items() if k == "ledger"}, tables=run.tables | {k: v for k, v in changes.items() if k in run.tables})
        return {r["check"] for r in controls.identity_breaks(damaged).collect()}

    whole = {"Reports and proposed entry are ledger A", "B populations are ledger B"}
    for name, check in (("excess", "Excess copies"), ("ambiguous", "Ambiguous candidates"), ("holds", "Reference holds"), ("variances", "Amount variances"), ("fuzzy", "Fuzzy holds")):
        table = run.tables[name]
        if table.isEmpty():
            continue
        gone = broken(**{name: table.limit(0)})
        assert f"{check}: report and ledger" in gone and gone & whole, name
        twice = broken(**{name: table.unionByName(table)})
        assert f"{check}: report and ledger" in twice, name
    assert "B populations are ledger B" in broken(open_b=run.tables["open_b"].limit(0))
    assert "B populations are ledger B" in broken(held_b=run.b)
    assert "No suspect of A is excluded" in broken(excess=run.tables["excess"].unionByName(run.tables["suspects"].select("side", "row_id"), allowMissingColumns=True))
    assert "Matches: report and ledger" in broken(ledger=run.ledger.filter("outcome <> 'matched'"))
    moved = run.ledger.withColumn("outcome", F.when(F.col("outcome") == "unmatched", "matched").otherwise(F.col("outcome")))
    assert "Matches: report and ledger" in broken(ledger=moved)


def test_signed_difference_counts_repeats(spark):
    left, right = (spark.createDataFrame([(x,) for x in xs], "row_id int") for xs in ([1, 1, 2, None, 4], [1, 2, 2, 3, None]))
    got = {r["row_id"]: r["difference"] for r in controls.signed_difference(left, right, ["row_id"]).collect()}
    assert got == {1: 1, 2: -1, 3: -1, 4: 1}
    assert sorted(r["row_id"] for r in controls.same_ids(left, right).collect()) == [1, 2, 3, 4]


def test_every_subject_has_one_assessment(run):
    from tallywork.plans.reconciliation import match_assessments

    got = {}
    for r in match_assessments(run).collect():
        assert (r["kind"], r["subject"]) not in got
        got[r["kind"], r["subject"]] = r
    assert {k: r["rule"] for k, r in got.items()} == {
        ("match", 1): "M1", ("match", 2): "M1", ("match", 3): "M2", ("match", 7): "M1", ("match", 14): "M4", ("clearance", 17): "C1",
        ("open", 6): "U3", ("hold", 5): "H2", ("hold", 9): "H2", ("hold", 11): "H2", ("hold", 12): "H2", ("hold", 15): "H2",
        ("hold", 16): "H2", ("variance", 4): "V1", ("ambiguous", 18): "A1",
    }
    three = got["match", 3]
    assert (three["b_rows"], three["b_ids"], three["b_cents"], three["grouped"], three["difference"]) == (2, [3, 4], 3000, True, 0)
    assert (got["clearance", 17]["po_criterion"], got["clearance", 17]["b_cents"]) == ("Applied under controlled historical pass", 1700)
    assert (got["open", 6]["po_criterion"], got["open", 6]["amount_criterion"]) == ("Candidate search performed", "Valid")
    assert (got["variance", 4]["difference"], got["variance", 4]["amount_criterion"]) == (-100, "Differs - review required")


def test_every_rule_is_hit_and_the_first_one_wins(spark):
    from tallywork.operators import assessments as s

    grid = s.rule_grid(spark).collect()
    assert len(grid) == len(s.KINDS) * 36 and {r["rule"] for r in grid} == {rule[0] for rule in s.RULES}
    for r in grid:  # plain reading of the table from the bottom up, so that what stands above overwrites
        states, winner = (r["po_state"], r["inv_state"], r["amount_state"]), None
        for rule in reversed(s.RULES):
            if rule[1] == r["kind"] and all(w in (None, h) for w, h in zip(rule[2:5], states)):
                winner = rule[0]
        assert r["rule"] == winner
    odd = spark.createDataFrame([("other", "same", "same", "equal")], "kind string, po_state string, inv_state string, amount_state string")
    assert s.assess(odd).first()["rule"] is None


def test_every_exception_has_its_cause(run):
    from tallywork.operators import assessments as s, duplicates, evidence
    from tallywork.plans.reconciliation import explained_rows

    rows_ = explained_rows(run).collect()
    a = {r["a_id"]: (r["exception_cause"], r["cause_confidence"]) for r in rows_ if r["a_id"] is not None}
    assert a[1] == (s.NOT_AN_EXCEPTION, "") and a[17][0] == s.NOT_AN_EXCEPTION and a[8][1] == "High"
    assert a[15] == a[16] == (s.PO_REUSE, "Review") and a[6] == (evidence.NO_EVIDENCE, "Review")
    assert a[10] == (s.DUPLICATE_CAUSES[duplicates.BASIS_STRICT], "Hold") and a[12][0] == evidence.INVALID
    assert len(rows_) == len({(r["a_id"], r["b_id"]) for r in rows_}) and all(r["exception_cause"] and r["treatment"] for r in rows_)


def test_metrics_count_every_population_of_the_run(run):
    from tallywork.operators import reports
    from tallywork.plans.reconciliation import metric_facts

    facts = metric_facts(run, controls.balance_controls(run), subtotals=3)
    got = reports.run_metrics(facts).first().asDict()
    book = [r.asDict() for r in run.ledger.collect()]
    cents = lambda keep: sum(r["cents"] or 0 for r in book if keep(r))
    assert got["a_rows"] == len(A) and got["b_rows"] == len(B) and got["a_total"] == cents(lambda r: True)
    for outcome in ("unmatched", "duplicate", "duplicate_hold", "variance", "fuzzy", "ambiguous", "reference_hold", "cleared"):
        of = [r for r in book if r["outcome"] == outcome]
        assert (got[f"{outcome}_a_rows"], got[f"{outcome}_a_cents"]) == (len(of), sum(r["cents"] or 0 for r in of)), outcome
    for d in ("MATCHED", "EXACT_A_DUPLICATE_EXCLUDED", "REVIEW_HOLD", "TRUE_UNMATCHED"):
        assert got[f"disposition_{d.lower()}_rows"] == sum(r["disposition"] == d for r in book)
    assert got["proposed_entry_cents"] == cents(lambda r: r["disposition"] == "TRUE_UNMATCHED")
    assert (got["a_invalid_amounts"], got["history_b_rows"], got["history_b_used"], got["history_b_ignored"], got["clearances"]) == (1, 1, 1, 0, 1)
    assert (got["po_reuse_groups"], got["po_reuse_rows"], got["po_reuse_net"]) == (1, 2, -900)
    assert (got["variance_net"], got["variance_gross"], got["fuzzy_groups"], got["subtotal_rows_excluded"]) == (-100, 100, 1, 3)
    assert (got["a_duplicate_groups"], got["a_copy_sets"], got["b_duplicate_groups"]) == (2, 1, 0)
    assert got["matched_difference"] == 0 and got["a_match_rate"] == (got["matched_a_rows"] / len(A)) and got["control_status"] == "PASS"
    b_named = sum(got[f"{x}_b_rows"] for x in ("cleared", "unmatched", "duplicate", "duplicate_hold", "variance", "fuzzy")) + got["matched_b_rows"]
    assert b_named == len(B)
    why = got["posting_blockers"].split("; ")
    assert got["posting_status"] == "REVIEW REQUIRED" and reports.GRAIN_BLOCKER in why and "invalid amounts of A" in why and "invalid amounts of B" not in why
    assert reports.GRAIN_BLOCKER not in reports.run_metrics(facts, grain_validated=True).first()["posting_blockers"]


def test_metrics_of_nothing_are_zero_and_open_the_gate(spark):
    from tallywork.operators import reports

    none = spark.createDataFrame([], "population string, side string, n bigint, cents bigint")
    got = reports.run_metrics(none).first().asDict()
    assert got["posting_status"] == "READY TO POST" and got["a_match_rate"] is None and got["a_rows"] == 0
    for measure, reason in reports.BLOCKERS:  # each blocker alone closes the gate
        spec = next(m for m in reports.MEASURES if m[0] == measure)
        population = spec[1] if isinstance(spec[1], str) else spec[1][0]
        one = spark.createDataFrame([(population, spec[2] or "A", 1, None)], none.schema)
        assert reason in reports.run_metrics(one).first()["posting_blockers"].split("; "), measure


def test_amount_controls_each_fail_for_their_own_damage(run):
    from dataclasses import replace

    lines = {r["check"]: r for r in controls.amount_controls(run).collect()}
    assert len(lines) == 10 and {r["status"] for r in lines.values()} == {"PASS"}
    assert lines["B row completeness"]["expected"] == len(B) and lines["Historical clearance amount difference"]["expected"] == 1700

    def failing(**tables):
        return {r["check"] for r in controls.amount_controls(replace(run, tables=run.tables | tables)).filter("status = 'FAIL'").collect()}

    t = run.tables
    assert "Amount variances are kept out of the entry" in failing(variances=t["variances"].withColumn("a_cents", F.col("a_cents") + 1))
    assert "Ambiguous candidates are kept out of the entry" in failing(ambiguous=t["ambiguous"].limit(0))
    assert "Reference holds are kept out of the entry" in failing(holds=t["holds"].filter("row_id <> 5"))
    assert failing(fuzzy=t["fuzzy"].limit(0)) >= {"Fuzzy holds are kept out of the entry", "B row completeness", "B rows that nothing claimed are reported apart"}
    assert failing(open_b=t["open_b"].limit(0)) >= {"B row completeness", "B amount roll-forward", "B rows that nothing claimed are reported apart"}
    assert failing(suspects=t["suspects"].limit(0)) == {"Held copies of A are kept out of the entry"}
    assert failing(history=t["history"].withColumn("cents", F.col("cents") - 1)) == {"Historical clearance amount difference"}
    odd = run.ledger.withColumn("disposition", F.when(F.col("row_id") == 1, "LOST").otherwise(F.col("disposition")))
    assert {r["check"] for r in controls.amount_controls(replace(run, ledger=odd)).filter("status = 'FAIL'").collect()} == {"Every A row has a known disposition"}
