"""Shapes of plans and rows that only large tables make dear."""

import io
from contextlib import redirect_stdout
from datetime import date
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from tallywork import runtime
from tallywork.operators import controls, fifo, matching, receipts, words
from tallywork.runtime import join_known

ROWS = "side string, row_id bigint, exact_po string, exact_inv string, key_po string, key_inv string, cents bigint, words array<string>"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_spellings_never_pass_through_the_driver(spark):
    """the planner sizes exploded spellings as the sets they come from, and would broadcast them."""
    rows = [("A", 1, "", "", "", "", 100, ["TRADEAB"]), ("B", 2, "", "", "", "", 100, ["TRAEAB"]), ("B", 3, "", "", "", "", 100, ["OTHERS"])]
    edges = words.typo_edges(spark.createDataFrame(rows, ROWS))
    joins = [line for line in plan(edges).splitlines() if "Join" in line and "spelling" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert [(r["a_id"], r["b_id"], r["a_word"], r["b_word"]) for r in edges.collect()] == [(1, 2, "TRADEAB", "TRAEAB")]


def test_tiers_write_only_what_they_read(spark, monkeypatch):
    """F13 to F23: flags are looked up for open rows, wide columns never travel through the tiers, and come back with the open rows."""
    written = {}
    real = matching.cut
    monkeypatch.setattr(matching, "cut", lambda df, name, **options: written.setdefault(name, df.columns) and real(df, name, **options))
    rows = [
        ("A", 1, "P1", "I1", "P1", "I1", 100, ["WIDE"]), ("B", 1, "P1", "I1", "P1", "I1", 100, []),
        ("A", 2, "P2", "I2", "P2", "I2", 200, ["WIDE"]), ("B", 2, "P2", "I1", "P2", "I1", 200, []), ("A", 3, "P2", "", "P2", "", None, ["OPEN"]),
    ]
    both = spark.createDataFrame(rows, ROWS)
    bridge, refused, open_rows = matching.match_one_to_one(both)
    assert all("words" not in columns for columns in written.values())
    assert sorted((r["method"], r["side"], r["row_id"]) for r in bridge.collect()) == [("PO + Invoice + Amount", s, 1) for s in "AB"]
    assert [tuple(r) for r in refused.collect()] == [(2, 2, "PO + Amount")]
    want = matching.match_one_to_one(matching.with_link_flags(both))[2]
    columns = sorted(want.columns)
    assert sorted(open_rows.columns) == columns and "words" in columns
    got, known = (sorted(map(str, x.select(*columns).collect())) for x in (open_rows, want))
    assert got == known and len(got) == 3


def test_rows_without_a_key_are_spread(spark):
    """rows whose key is null find nothing and must not meet in one task; a key that is there finds every row it has."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(4000).selectExpr("id AS b_id", "CASE WHEN id < 4 THEN id END AS a_id")
        right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "never")], "a_id bigint, finding string").hint("merge")
        joined = join_known(left, right, ["a_id"], ["b_id"])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert joined.count() == 4001 and max(sizes) < 4001
        assert sorted(r["finding"] for r in joined.filter("finding IS NOT NULL").collect()) == ["x", "y", "z"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_controls_read_their_sources_once(spark):
    """one aggregate over all places of a run in place of a join for each line."""
    rows = [("A", k, "", "", f"P{k}", f"I{k}", 100 + k) for k in range(4)] + [("B", k, "", "", f"P{k}", f"I{k}", 100 + k) for k in range(3)]
    base = spark.createDataFrame(rows, "side string, row_id bigint, exact_po string, exact_inv string, norm_po string, norm_inv string, cents bigint")
    a, b = base.filter("side = 'A'"), base.filter("side = 'B'")
    none = base.limit(0)
    book = a.select("row_id", "cents", F.when(F.col("row_id") < 3, "matched").otherwise("unmatched").alias("outcome"),
                    F.when(F.col("row_id") < 3, "MATCHED").otherwise("TRUE_UNMATCHED").alias("disposition"), (F.col("row_id") == 3).alias("in_proposed_entry"))
    bridge = base.filter("row_id < 3").select(F.col("row_id").alias("match_key"), F.lit("PO").alias("method"), "side", "row_id")
    tables = {
        "excess": none, "held_b": none, "open_b": none, "fuzzy": none, "ambiguous": none, "holds": none,
        "suspects": none.withColumn("outcome", F.lit("")),
        "variances": none.select(F.col("row_id").alias("a_id"), F.col("row_id").alias("b_id"), F.col("cents").alias("a_cents")),
    }
    run = SimpleNamespace(a=a, b=b, ledger=book, matching=SimpleNamespace(bridge=bridge), tables=tables)
    checks = controls.balance_controls(run)
    assert {r["status"] for r in checks.collect()} == {"PASS"} and checks.count() == 20
    keyed = [line for line in plan(controls.balance_controls(run)).splitlines() if "Join" in line and "Nested" not in line]
    assert len(keyed) <= 1
    run.tables = {**tables, "open_b": b.limit(1)}
    bad = {r["check"]: r["difference"] for r in controls.balance_controls(run).filter("status = 'FAIL'").collect()}
    assert set(bad) == {"Every B row is in exactly one population", "B row completeness", "B amount roll-forward", "B rows that nothing claimed are reported apart"}
    assert bad["Every B row is in exactly one population"] == 1 and bad["B row completeness"] == -1


def test_grouped_sums_settle_many_keys_in_one_call_of_python(spark):
    """F4 to F12: a call of Python for each key cost more than the key, as most keys hold three rows."""
    rows = []
    for k in range(300):
        rows += [("A", k, "", "", f"P{k}", "", 300 + k, []), ("B", 2 * k, "", "", f"P{k}", "", 100, []), ("B", 2 * k + 1, "", "", f"P{k}", "", 200 + k, [])]
    found = matching.match_grouped(matching.with_link_flags(spark.createDataFrame(rows, ROWS)), ("po",))
    steps = plan(found)
    assert "MapInArrow" in steps and steps.count("FlatMapGroupsInPandas") == 1  # that one cuts down the large side of hot keys
    got = {}
    for r in found.collect():
        got.setdefault(r["match_key"], set()).add((r["side"], r["row_id"]))
    assert got == {k: {("A", k), ("B", 2 * k), ("B", 2 * k + 1)} for k in range(300)}


def test_a_key_that_goes_on_in_the_next_batch_is_settled_whole():
    """F4 to F12: rows reach Python in batches that end anywhere; `None` is a row id of its own."""
    records = [
        {"key_po": key, "side": side, "row_id": n, "cents": cents, "key_inv": "", "inv_shared": False, "copies": 1, "over_pool": False}
        for key, side, n, cents in [
            ("P1", "A", 1, 300), ("P1", "B", 1, 100), ("P1", "B", 2, 200), ("P2", "A", 2, 50), ("P2", "A", 3, 60), ("P2", "B", 3, 110),
            ("P3", "A", 4, 70), ("P3", "B", 4, 30), ("P3", "B", None, 40),
        ]
    ]
    whole = [(1, "A", 1), (1, "B", 1), (1, "B", 2), (2, "A", 2), (2, "A", 3), (2, "B", 3), (4, "A", 4), (4, "B", 4), (4, "B", None)]
    for size in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_pylist(records[k:k + size]) for k in range(0, 9, size)]
        out = [r for b in matching._solve_keys(["key_po"], ["inv"], 20)(iter(batches)) for r in b.to_pylist()]
        assert sorted(((r["match_key"], r["side"], r["row_id"]) for r in out), key=str) == sorted(whole, key=str)


def test_variances_are_searched_once(spark, monkeypatch):
    """the pairs of a tier are written, as later tiers and the result would search them again; each row is still in one pair."""
    from tallywork.operators import evidence

    written, real = [], evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda df, name, **options: written.append(name) or real(df, name, **options))
    rows = [("A", 1, "P1", "I1", 100), ("B", 1, "P1", "I1", 90), ("A", 2, "P2", "I2", 50), ("B", 2, "", "I2", -50), ("A", 3, "P3", "", 7), ("B", 3, "P3", "I9", 8),
            ("A", 4, "P4", "", 5), ("B", 4, "P4", "", 5), ("A", 5, "P5", "", None), ("B", 5, "P5", "", 1), ("A", 6, "P1", "", 4)]
    both = spark.createDataFrame(rows, "side string, row_id bigint, key_po string, key_inv string, cents bigint")
    out = evidence.amount_variances(both.filter("side = 'A'"), both.filter("side = 'B'"))
    assert len(written) == 3 and "Scan parquet" in plan(out) and "Join" not in plan(out)
    assert sorted((r["a_id"], r["b_id"], r["evidence"], r["difference"], r["sign_reversal"]) for r in out.collect()) == [
        (1, 1, "PO_AND_INVOICE", 10, False), (2, 2, "INVOICE_ONLY", 100, True), (3, 3, "PO_ONLY", -1, False),
    ]


def test_matches_are_gathered_as_rows(spark):
    """the rows of a match travel once as they are, and never as lists of parts of it."""
    from tallywork.operators import assessments

    rows = spark.createDataFrame([("A", 1, 5, "P", "I"), ("B", 2, 2, "P", ""), ("B", 3, 3, "", "I")], "side string, row_id bigint, cents bigint, norm_po string, norm_inv string")
    bridge = spark.createDataFrame([(1, "PO", "A", 1), (1, "PO", "B", 2), (1, "PO", "B", 3)], "match_key bigint, method string, side string, row_id bigint")
    facts = assessments.match_facts(bridge, rows)
    text = plan(facts)
    assert text.index("Aggregate") < text.rindex("Aggregate") < text.index("Exchange hashpartitioning(match_key")
    got = facts.collect()[0]
    assert (got["a_ids"], got["b_ids"], got["a_cents"], got["b_cents"], got["grouped"], got["po_state"], got["inv_state"]) == ([1], [2, 3], 5, 5, True, "same", "same")


def test_running_values_take_one_shuffle(spark):
    """F1 to F3, F5 to F10: sums and previous values took an aggregate by day and block, as long as the rows, and a shuffle for each level."""
    rows = spark.createDataFrame([(1, d, 1, float(d)) for d in range(5)] + [(2, 1, 1, 7.0), (None, 1, 1, 9.0), (2, None, 1, 9.0)], "product bigint, day int, pos bigint, qty double")
    sums = runtime.running_before(rows, ["product"], "day", "pos", {"before": F.col("qty")}, {"newest": F.col("day")})
    both = runtime.previous_values(sums, ["product"], "day", "pos", ["qty"])
    assert plan(both).count("Exchange hashpartitioning") == 1 and "Join" not in plan(both)
    got = sorted((r["product"], r["day"], r["before"], r["newest"], r["previous"] and r["previous"]["qty"]) for r in both.collect())
    assert got == [(1, 0, 0.0, None, None), (1, 1, 0.0, 0, 0.0), (1, 2, 1.0, 1, 1.0), (1, 3, 3.0, 2, 2.0), (1, 4, 6.0, 3, 3.0), (2, 1, 9.0, None, None)]


def test_a_hot_group_is_found_and_split(spark, monkeypatch):
    """F1 to F3, F5 to F10: a group of more than a block of rows never lands in one window, and gets the same values."""
    # Rows without a day or a position are left out, but count for the rows behind them; a day of such rows alone hides the day before.
    odd = [(1, None, 50, 0.5), (1, 1, None, 0.25), (1, 3, None, 2.0), (1, 4, 60, 1.0), (1, 5, 61, 1.0), (3, None, None, 3.0), (3, 0, 1, 1.0)]
    rows = spark.createDataFrame([(1, n // 4, n, float(n)) for n in range(12)] + odd + [(2, 1, 1, 7.0), (2, 2, 1, 8.0)], "product bigint, day int, pos bigint, qty double")
    last = {(r["product"], r["pos"]): r["previous"] and r["previous"]["qty"] for r in runtime.previous_values(rows, ["product"], "day", "pos", ["qty"]).collect()}
    assert (last[1, 0], last[1, 4], last[1, 60], last[1, 61], last[3, 1]) == (0.5, 3.0, None, 1.0, None) and len(last) == 16

    def values():
        out = runtime.previous_values(rows, ["product"], "day", "pos", ["qty"])
        out = runtime.running_before(out, ["product"], "day", "pos", {"before": F.col("qty")}, {"newest": F.col("day")})
        out = runtime.over_group(out, ["product"], {"most": F.max("qty")})
        straight = runtime.running_before(rows, ["product"], "day", "pos", {"before": F.col("qty")}, {"newest": F.col("day")})
        told = ["product", "day", "pos", "qty", "before", "newest"]
        return sorted([*map(str, out.select(*told, "previous", "most").collect()), *map(str, straight.select(*told).collect())])

    cool = values()
    assert runtime.hot_places([rows], ["product"]) == []
    monkeypatch.setattr(runtime, "BLOCK_ROWS", 3)
    assert len(runtime.hot_places([rows], ["product"])) == 1 and len(runtime.hot_places([rows, rows], ["product"])) == 3
    assert values() == cool and len(cool) == 34


def test_costing_writes_its_layers_once(spark, monkeypatch):
    """F1 to F3, F5, F9, F10: layers were written, shuffled for their order, and shuffled again level by level for their sums."""
    d = [date(2026, 1, n) for n in range(1, 10)]
    products = spark.createDataFrame([(1, "caps"), (2, "film"), (3, "back"), (3, "again"), (4, "new")], "product bigint, name string")
    grid = spark.createDataFrame([(1, None, 4.0), (2, None, None), (3, None, 1.0), (4, 2.0, 1.0)], "product bigint, expected_qty double, ending_qty double")
    log = spark.createDataFrame([(1, d[k], k, 2.0, float(k)) for k in range(8)] + [(3, d[0], 1, 5.0, 5.0), (2, d[1], 1, 0.0, 1.0)], "product bigint, delivered date, source_pos bigint, qty double, total double")
    opening = spark.createDataFrame(
        [(1, 1, "x", None, 3.0, 6.0, 9.0, ""), (2, 1, "y", d[0], 1.0, 1.0, 1.0, "MINE"), (3, 1, "z", d[5], 2.0, 2.0, 1.0, None)],
        "product bigint, seq bigint, date_text string, start_day date, qty double, total_value double, unit_cost double, layer_id string",
    )
    written, real = {}, fifo.cut
    monkeypatch.setattr(fifo, "cut", lambda df, name, **options: written.setdefault(name, df.columns) and real(df, name, **options))

    def told():
        results, used = fifo.stage_batch(products, grid, log, opening, "P01")
        return [sorted(map(str, x.select(*sorted(x.columns)).collect())) for x in (results, used)], results, used

    cool, results, used = told()
    assert set(written) == {"batch", "consumed"} and "unit_cost" not in written["consumed"]
    names = {(r["product"], r["kind"], r["seq"]): (r["layer_id"], r["date_text"], r["source_period"], r["consumed"]) for r in used.collect()}
    assert names[1, 0, 1] == ("OPEN-001", "x", None, 3.0) and names[1, 1, 2] == ("P01-002", "2026-01-02", "P01", 2.0)
    assert names[2, 0, 1] == ("MINE", "y", None, 0.0) and names[4, 0, 1] == ("OPEN-001", "Prior Period Carryover", None, 1.0)
    assert [k for k in names if k[0] == 3] == [(3, 0, 1)] and used.filter("product = 3").count() == 2
    said = {r["product"]: r["processing_error"] for r in results.collect()}
    assert said == {1: None, 2: "Receipt quantity must be positive", 3: "FIFO layers are not in non-decreasing chronological order.", 4: None}
    monkeypatch.setattr(runtime, "BLOCK_ROWS", 2)
    assert told()[0] == cool


def test_the_log_meets_its_register_once(spark, monkeypatch):
    """F1, F6 to F8: log rows were shuffled with their keys, level by level, and again to join what was found; a row that comes twice is
    registered as a whole, as before."""
    d = date(2026, 2, 10)
    log = spark.createDataFrame(
        [(n, 1, d, 5.0, 10.0, "P1", "") for n in (3, 1, 2)] + [(4, 1, d, 5.0, 11.0, "P1", ""), (None, 1, d, 5.0, 10.0, "p 1", ""), (6, None, d, 5.0, 10.0, "P1", "")]
        + [(7, 2, d, 1.0, 1.0, None, "I")] * 2 + [(8, 3, d, 1.0, 1.0, "", "I")] * 2,
        "source_row bigint, alias bigint, delivered date, qty double, total double, po string, invoice string",
    )
    register = spark.createDataFrame(
        [("1", d, 5.0, 10.0, "p-1", "")] * 2 + [("2", d, 1.0, 1.0, "", "i")] * 2 + [("3", d, 1.0, 1.0, "", "i"), (None, d, 5.0, 10.0, "P1", ""), ("none", d, 1.0, 1.0, "", "")],
        "alias string, delivered date, qty double, total double, po string, invoice string",
    )

    def told():
        return sorted(((r["source_row"] or 0, r["processed"]) for r in receipts.mark_registered(log, register).collect()))

    steps = plan(receipts.mark_registered(log, register))
    assert "Join" not in steps and steps.count("Exchange hashpartitioning") == 1
    want = [(0, False), (1, True), (2, True), (3, False), (4, False), (6, False)] + [(7, True)] * 4 + [(8, True)] * 2
    assert told() == want
    monkeypatch.setattr(runtime, "BLOCK_ROWS", 1)
    assert told() == want


def test_only_rows_that_are_asked_about_are_moved_for_evidence(spark, monkeypatch):
    """F1, F6 to F8: all rows of the log were joined with the evidence, keys and reasons included."""
    d = [date(2026, 2, 10), date(2025, 12, 1)]
    log = spark.createDataFrame(
        [(1, 1, d[0], 5.0, 10.0, "P1", "", "", ""), (2, 1, d[1], 7.0, 7.0, "P3", "", "P.2 FYE 2026", ""), (3, None, d[0], 5.0, 10.0, "P1", "", "", "")],
        "source_row bigint, alias bigint, delivered date, qty double, total double, po string, invoice string, label string, section_label string",
    )
    win = receipts.Window(2026, 2, date(2026, 1, 29), date(2026, 2, 25), date(2026, 1, 1), date(2026, 12, 30), date(2025, 12, 31), 0)
    layers = spark.createDataFrame([(1, d[1], d[1])], "alias bigint, start_day date, end_day date")
    asked, real = [], receipts.opening_evidence
    written, real_cut = {}, receipts.cut
    monkeypatch.setattr(receipts, "opening_evidence", lambda rows, *more: asked.append(rows) or real(rows, *more))
    monkeypatch.setattr(receipts, "cut", lambda df, name, **options: written.setdefault(name, df.columns) and real_cut(df, name, **options))
    out = receipts.recognize(log, log.limit(0), win, layers, log.limit(0))
    assert "receipt_key" not in written["placed"] and "receipt_key" in out.columns
    assert [r["source_row"] for r in asked[0].collect()] == [2] and "Union" in plan(out)
    assert {r["source_row"]: (r["outcome"], r["evidence"]) for r in out.collect()} == {1: ("in period", None), 2: ("review", "unclear"), 3: ("rejected", None)}
