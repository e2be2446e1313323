import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywork.operators import cleanup, late, receipts as r, tax, workflow as w
from tallywork.operators.materials import classify_products, ending_counts, resolve_cells, spelling_table, suggest_names
from tallywork.sources import delimited, grid, profile, sinks


def test_text_scan_keeps_identifiers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('PO,Amount\n"0105","1,000.00"\n,\n"Monday, January 5, 2026 10:30 AM GMT-06:00",\nPO,Amount\n1e5,7\n')
    raw = delimited.read_text_table(spark, str(path), 2)
    kept = delimited.classify_rows(raw, {"c1": "PO", "c2": "Amount"})
    got = {(x["c1"], x["row_class"]) for x in kept.collect()}
    assert ("0105", "data") in got and ("1e5", "data") in got and ("PO", "header") in got
    assert {x["row_class"]: x["n_rows"] for x in delimited.removal_counts(kept).collect()}["stamp"] == 1
    assert delimited.blank_columns(raw.withColumn("c3", F.lit(" ")), ["c1", "c3"]) == ["c3"]


@pytest.mark.parametrize("header,want", [("01", (1, "qty")), ("P1", (1, "qty")), ("PD01", (1, "qty")), ("01V", (1, "value")), ("PD13V", (13, "value")), ("14", None), ("V", None), ("NAME", None)])
def test_period_columns(header, want):
    assert grid.period_column(header) == want


def test_run_log_digest_and_groups(spark, tmp_path):
    from tallywork.operators.controls import tampered

    inputs = spark.createDataFrame([("A", "f1"), ("B", "f2")], "role string, sha256 string")
    metrics = spark.createDataFrame([(1, 2)], "matched long, held long")
    record = sinks.run_record(metrics, "RUN-1", "2026-01-05T10:00:00", "", 2026, 1, "PASS", "{}", inputs)
    path = str(tmp_path / "runs")
    sinks.append_run(record, path)
    stored = spark.read.parquet(path)
    assert tampered(stored, sinks.RUN_COLUMNS).count() == 0 and stored.first()["ran_by"] == "Unverified"
    assert tampered(stored.withColumn("control_status", F.lit("FAIL")), sinks.RUN_COLUMNS).count() == 1
    with pytest.raises(ValueError):
        sinks.run_record(metrics, "RUN-2", "x", "", 2026, 1, "", "{}", inputs)
    assert sinks.log_csv(spark.createDataFrame([("=cmd", "2026")], "a string, ran_at string")).first()["a"] == "'=cmd"
    kept = spark.createDataFrame([("T1", False), ("", True), ("", False)], "taxability string, new_vendor boolean")
    sinks.write_groups(kept, kept.limit(0), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "kept"))
    assert {x["output_group"] for x in back.collect()} == {"T1", "New Vendors", "Unclassified"}
    assert profile.infer_period_column(spark.createDataFrame([("1", "x"), ("13", "2")], "a string, b string"), ["b", "a"]) == "a"


def test_replay_equals_a_sequential_fold(spark):
    rng = random.Random(3)
    rules = {"submit": ("coding", "approval"), "approve": ("approval", "paid"), "reject": ("approval", "coding")}
    start = datetime(2026, 1, 5)
    events = [(f"d{rng.randrange(4)}", rng.choice([*rules, "other"]), start + timedelta(minutes=rng.randrange(6000)), n) for n in range(300)]
    want = {}
    for doc in {e[0] for e in events}:
        stage, applied, all_ = "coding", 0, 0
        for _, action, _, _ in sorted((e for e in events if e[0] == doc), key=lambda e: (e[2], e[3])):
            all_ += 1
            if action in rules and rules[action][0] == stage:
                stage, applied = rules[action][1], applied + 1
        want[doc] = (stage, applied, all_ - applied)
    got = w.replay(spark.createDataFrame(events, "document string, action string, at timestamp, event_no bigint"), rules, "coding")
    assert {x["document"]: (x["stage"], x["applied"], x["refused"]) for x in got.collect()} == want


def test_file_names_and_search(spark):
    files = spark.createDataFrame([("Acme Co  INV-77 - BOL B9.pdf",), ("scan.pdf",)], "n string")
    got = {x["n"]: x for x in w.parse_file_names(files, "n", "{vendor} {invoice} - BOL {bol}").collect()}
    assert got["Acme Co  INV-77 - BOL B9.pdf"][1:] == (True, "Acme Co", "INV-77", "B9") and got["scan.pdf"][1:] == (False, "scan", "", "")
    with pytest.raises(ValueError):
        w.file_pattern("{vendor} only")
    texts = spark.createDataFrame([(1, "PO 8840 is here"), (2, "hypochlorite"), (3, "INV-9930 po")], "k int, t string")
    assert {x["k"] for x in w.search_text(texts, "t", "po").collect()} == {1, 3}
    assert w.search_text(texts, "t", "INV-99").first()["excerpt"] == "INV-9930 po"
    notes = spark.createDataFrame([("", True), ("because", True), ("", False)], "n string, req boolean").select(w.note_problem(F.col("n"), F.col("req")).alias("p"))
    assert [x["p"] is None for x in notes.collect()] == [False, True, True]


def test_late_entries_and_calendar(spark):
    cal = late.calendar(spark, 2026, date(2026, 1, 1))
    assert late.calendar_problems(cal).count() == 0
    assert late.calendar_problems(cal.filter("period < 13")).count() == 12
    rows = spark.createDataFrame(
        [(1, date(2026, 1, 10), date(2026, 2, 10), 5), (2, date(2026, 1, 10), date(2026, 1, 29), 5), (3, date(2025, 12, 1), date(2026, 1, 2), 5), (4, date(2027, 6, 1), date(2027, 9, 1), 5)],
        "k int, txn_date date, created date, cents int",
    )
    got = {x["k"]: (x["period_label"], x["days_after"]) for x in late.late_entries(rows, cal, close_days=1).collect()}
    assert got == {1: ("P01", 13), 3: ("Prior year", 2)}


def test_tax_lines_round_on_their_own(spark):
    rates = spark.createDataFrame([("here", 0.0, 0.5, 0.0, 0.0)], "location string, city_rate double, county_rate double, district_rate double, combined_rate double")
    sales = spark.createDataFrame([("500.00", "here", True), ("0.99", "here", False)], "p string, location string, saas boolean").withColumn("price", tax.price_cents("p"))
    got = {str(x["price"]): (str(x["taxable"]), str(x["state_tax"]), str(x["local_tax"]), str(x["total_tax"])) for x in tax.sales_tax(sales, rates).collect()}
    assert got == {"500.00": ("400.00", "25.00", "2.00", "27.00"), "0.99": ("0.99", "0.06", "0.00", "0.06")}
    labels = spark.createDataFrame([("Tax Code §§151.0101(13), 151.0047; 34 TAC §3.357; Pub. 94-116",)], "t string").select(tax.provision_labels("t").alias("l")).first()["l"]
    assert labels == sorted(["Tax Code §151.0101", "Tax Code §151.0047", "34 TAC §3.357", "Comptroller Pub. 94-116"])
    docs = spark.createDataFrame([("Tools", "forklift rules", ["crane lease", "forklift hire"]), ("Other", "forklift", ["none"])], "title string, summary string, sections array<string>")
    assert {x["title"]: x["found"] for x in tax.search_sections(docs, "forklift").collect()} == {"Tools": ["forklift hire"], "Other": ["none"]}


def test_receipts_once_each(spark):
    log_schema = "source_row bigint, alias bigint, delivered date, qty double, total double, po string, invoice string, label string, section_label string"
    d = date(2026, 2, 10)
    log = spark.createDataFrame(
        [(1, 1, d, 5.0, 10.0, "P1", "", "", ""), (2, 1, d, 5.0, 10.0, "p-1", "", "", ""), (3, 1, d, 5.0, 10.0, "P1", "", "", ""), (4, 1, date(2026, 1, 20), 7.0, 7.0, "P2", "", "", ""),
         (5, 1, date(2025, 12, 1), 7.0, 7.0, "P3", "", "P.2 FYE 2026", ""), (6, None, d, 1.0, 1.0, "", "", "", ""), (7, 1, date(2026, 3, 9), 1.0, 1.0, "", "", "", "")], log_schema,
    )
    register = spark.createDataFrame([(1, d, 5.0, 10.0, "P1", "")] * 2, "alias bigint, delivered date, qty double, total double, po string, invoice string")
    win = r.Window(2026, 2, date(2026, 1, 29), date(2026, 2, 25), date(2026, 1, 1), date(2026, 12, 30), date(2025, 12, 31), 13)
    win = r.Window(2026, 2, win.start, win.end, win.year_start, win.year_end, date(2025, 12, 31), 0)
    layers = spark.createDataFrame([(1, date(2025, 11, 20), date(2025, 12, 5))], "alias bigint, start_day date, end_day date")
    lineage = spark.createDataFrame([], "alias bigint, delivered date, qty double, po string, invoice string")
    out = {x["source_row"]: x["outcome"] for x in r.recognize(log, register, win, layers, lineage).collect()}
    assert out == {1: "registered", 2: "registered", 3: "in period", 4: "late", 5: "review", 6: "rejected", 7: "pending"}
    known = r.receipt_key()
    key = log.filter("source_row = 5").select(known.alias("receipt_key"), F.lit("include").alias("decision"))
    assert {x["source_row"]: x["outcome"] for x in r.recognize(log, register, win, layers, lineage, key).collect()}[5] == "late"
    proof = spark.createDataFrame([(1, date(2025, 12, 1), 7.2, "p3", "")], lineage.schema)
    assert {x["source_row"]: x["outcome"] for x in r.recognize(log, register, win, layers, proof).collect()}[5] == "in opening"


def test_materials(spark):
    products = spark.createDataFrame([(5, "W1 - PP24 FILM"), (6, "PP32 FILM"), (7, "GLUE")], "alias int, name string")
    known = spark.createDataFrame([("sticky", 7), ("shared", 5), ("shared", 6)], "spelling string, alias int")
    rows = spark.createDataFrame([(1, "5", ""), (2, "", "pp 24 rolls"), (3, "", "Sticky"), (4, "6", "glue"), (5, "", "shared"), (6, "", "Pallet Wrap (24)"), (7, "", "")], "n int, a string, b string")
    got = {x["n"]: (x["alias"], x["status"]) for x in resolve_cells(rows, ["a", "b"], spelling_table(products, known), "n").collect()}
    assert got == {1: (5, "OK"), 2: (5, "OK"), 3: (7, "OK"), 4: (None, "AMBIGUOUS"), 5: (None, "AMBIGUOUS"), 6: (None, "UNMAPPED"), 7: (None, "UNMAPPED")}
    lines = rows.withColumn("q", F.when(F.col("n") < 4, "10").otherwise("1"))
    counted = {x["n"]: (x["outcome"], x["counted"]) for x in ending_counts(lines, resolve_cells(rows, ["a", "b"], spelling_table(products, known), "n"), "n", "b", "q").collect()}
    assert counted[1] == ("used", 20.0) and counted[3] == ("used", 10.0) and counted[4][0] == "unmapped" and counted[6][0] == "ignored"
    near = suggest_names(spark.createDataFrame([("PP24 FILMS",)], "x string"), "x", products).first()["suggestions"]
    assert near[0].startswith("5 ") or near[0].startswith("6 ")


def test_product_classification(spark):
    lexicon = spark.createDataFrame([("Acme 24 Case", "ACME", 0), ("Lowell 24 Case", "LOWELL 24", 1), ("Lowell 40 Case", "LOWELL 40", 2)], "standard_name string, spelling string, place int")
    texts = ["acme pack", "LOWELL40PK", "lowell", "Lowel 24 cse", "acme 32", "zebra", "case", "ACMEPACK", "lowell 24 40"]
    lines = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {x["text"]: x["label"] for x in classify_products(lines, "t", lexicon).collect()}
    assert got["ACME PACK"] == "Acme 24 Case" and got["LOWELL40PK"] == "Lowell 40 Case" and got["LOWEL 24 CSE"] == "Lowell 24 Case"
    assert got["ACME 32"] == "New item – 32-count" and got["ZEBRA"] == got["CASE"] == "Unrecognized product" and got["ACMEPACK"] == "Acme 24 Case"
    assert got["LOWELL 24 40"] == "Needs review – size unclear"


def test_cleanup_keeps_one_eligible_row_per_transaction(spark):
    rows = spark.createDataFrame(
        [(1, "V1", "T1", "x9", "10.00"), (2, "V1", "T1", "9", "20.00"), (3, "v1 ", "t1", "9", "30.00"), (4, "V2", "T2", "9", "5.00"), (5, "V3", "", "9", "1.00"), (6, "V3", "", "9", "1.00")],
        "source_pos bigint, vendor string, transaction_id string, code string, amount string",
    ).withColumns({"cost_center": F.lit("10"), "account": F.lit("20")})
    excluded = cleanup.membership(spark.createDataFrame([("v2;V9",)], "x string"), "x")
    marked = cleanup.mark_removals(rows, excluded)
    assert {x["source_pos"]: (x["drop_reason"], x["retained_pos"]) for x in marked.collect()} == {
        1: ("letter", None), 2: ("keep", None), 3: ("duplicate", 2), 4: ("excluded", None), 5: ("keep", None), 6: ("keep", None)}
    mapping = spark.createDataFrame([("V1", "T", "G", 1), ("V1", "", "", 2)], "vendor_name string, taxability string, grouping string, source_pos bigint")
    accounts = spark.createDataFrame([("001-10000-200000-000", "Cash", 1)], "gl_account string, account_name string, source_pos bigint")
    done = cleanup.enrich(marked, mapping, accounts)
    assert {x["source_pos"]: (x["taxability"], x["account_name"], x["new_vendor"]) for x in done.collect()} == {2: ("T", "Cash", False), 5: ("", "Cash", True), 6: ("", "Cash", True)}
    stats = cleanup.cleanup_statistics(marked, done).first()
    assert stats["control_difference"] == 0 and stats["original_total"] == 67
    with pytest.raises(ValueError):
        cleanup.positional(rows)


def test_digests_of_tables_see_every_change_and_no_order(spark):
    from tallywork.operators.controls import changed_tables, table_digest

    rows = [(1, "a", None), (2, "", "x"), (2, "", "x"), (3, "1:b|", "")]
    schema = "k int, v string, w string"
    make = lambda r: spark.createDataFrame(r, schema)
    known = table_digest(make(rows), "t").first()
    assert table_digest(make(rows[::-1]).repartition(3), "t").first() == known and known.n_rows == 4
    assert table_digest(make(rows).select("w", "k", "v"), "t").first() == known
    others = [rows[:3], rows + rows[:1], [(1, "a", ""), *rows[1:]], [(1, None, "a"), *rows[1:]], [*rows[:2], (2, "x", ""), rows[3]], []]
    found = {table_digest(make(r), "t").first().digest for r in others}
    assert len(found) == len(others) and known.digest not in found
    assert [x.table_name for x in changed_tables(table_digest(make(rows), "t"), table_digest(make(rows[:1]), "t")).collect()] == ["t"]
    assert changed_tables(table_digest(make(rows), "t"), table_digest(make(rows[::-1]), "t")).collect() == []


def test_a_run_proves_its_inputs(spark, tmp_path):
    tables = {"orders": spark.range(50), "lines": spark.range(9).selectExpr("id", "'x' v")}
    inputs, metrics = sinks.proved(tables), spark.createDataFrame([(1,)], "n long")
    path = str(tmp_path / "log")
    for ref in ("R1", "R2"):
        sinks.append_run(sinks.run_record(metrics, ref, "2026-01-01", "J", 2026, 1, "PASS", "{}", inputs), path, inputs)
    log = spark.read.parquet(path)
    assert log.count() == 2 and sinks.inputs_changed(log, inputs).count() == 0
    assert sinks.inputs_changed(log, sinks.proved(tables | {"lines": spark.range(9).selectExpr("id", "'y' v")})).count() == 2
    assert {tuple(r) for r in spark.read.parquet(f"{path}-inputs").select("run_ref", "role").collect()} == {(r, t) for r in ("R1", "R2") for t in tables}


def test_archived_templates_are_hidden_until_saved_again(spark):
    from tallywork.operators import specrecon as sr

    specs = lambda rows: spark.createDataFrame(rows, "template_id string, spec string")
    rows_of = lambda store: sorted((r.template_id, r.version, r.spec) for r in sr.current(store).collect())
    store = sr.save_all(spark.createDataFrame([], sr.STORE), specs([("a", "1"), ("b", "1"), ("b", "0")]))
    store = sr.save_all(store, specs([("a", "1"), ("b", "2")]))
    assert rows_of(store) == [("a", 1, "1"), ("b", 2, "2")]
    store = sr.archive(sr.archive(store, specs([("a", ""), ("zz", "")])), specs([("a", "")]))
    assert rows_of(store) == [("b", 2, "2")] and store.filter("template_id = 'a'").count() == 2
    store = sr.save_all(store, specs([("a", "1")]))
    assert rows_of(store) == [("a", 3, "1"), ("b", 2, "2")]


def _lines(df):
    return {(r["dataset"], r["check"]): (r["status"], r["n_rows"], r["examples"]) for r in df.collect()}


def test_headers_are_judged_by_place_and_name():
    from tallywork.sources import checks as k

    good = ["Vendor", "Date", "Transaction ID", "d", "Account", "Cost Center", "Amount", "t", "r", "Code", "p"]
    assert {x[2] for x in k.header_lines("S", good, 11, True, k.SOURCE_HINTS)} == {"PASS"}
    swapped = [*good[:5], "Amount", "Cost Center", *good[7:]]
    moved = {x[1]: x for x in k.header_lines("S", swapped, 11, True, k.SOURCE_HINTS)}["Columns in their place"]
    assert moved[2] == "WARNING" and moved[4] == ["Cost Center: read from column 6, looks like column 7", "Amount: read from column 7, looks like column 6"]
    unknown = ["x"] * 11  # a file with other headers is never flagged for its places
    got = {x[1]: x[2:] for x in k.header_lines("S", unknown, 11, True, k.SOURCE_HINTS)}
    assert got["Columns in their place"][0] == "PASS" and got["Repeated headers"] == ("FAIL", 1, ["x"])
    got = {x[1]: x[2:] for x in k.header_lines("S", ["a", " ", "Unnamed: 2"], 5)}
    assert got["Blank headers"] == ("FAIL", 2, ["2", "3"]) and got["Columns"] == ("FAIL", 3, ["at least 5 are required"])


def test_cleanup_inputs_name_every_fault(spark):
    from tallywork.sources import checks as k

    names = [f"c{n}" for n in range(1, 12)]
    cell = ["1", "abc", " ", None, "1e3", "-5"] + ["?"] * 20
    rows = spark.createDataFrame([(*["x"] * 6, v, *["x"] * 4, n) for n, v in enumerate(cell)], ", ".join(f"{c} string" for c in names) + ", source_pos bigint")
    empty = spark.createDataFrame([], "name string, b string, c string, taxab string, groups string")
    accounts = spark.createDataFrame([("a", "b")], "a string, b string")
    got = _lines(k.cleanup_checks(rows, empty, accounts))
    assert got["Source Transactions", "Blank amounts"] == ("FAIL", 2, ["2", "3"])
    assert got["Source Transactions", "Amounts that are no number"] == ("FAIL", 21, ["1", *[str(n) for n in range(6, 15)]])
    assert got["Vendor Mapping", "Rows"] == ("FAIL", 1, ["the table is blank"]) and got["Trial Balance", "Columns"][0] == "FAIL"
    assert got["Source Transactions", "Rows"] == ("PASS", 0, [])
    nothing = _lines(k.cleanup_checks(rows.limit(0).drop("c11"), empty, accounts))
    assert nothing["Source Transactions", "Rows"][0] == "FAIL" and nothing["Source Transactions", "Columns"][0] == "FAIL"


def test_listing_and_grid_inputs(spark):
    from tallywork.sources import checks as k

    some, none = spark.createDataFrame([("1", "a")], "id string, name string"), spark.createDataFrame([], "id string, name string")
    got = _lines(k.listing_checks(some, none, {"id": "id", "name": "id", "tax": "t", "group": "t"}, {"id": "id", "name": "name"}))
    assert {key: v[0] for key, v in got.items()} == {
        ("Previous Vendor Listing", "Columns of id and name differ"): "FAIL", ("Previous Vendor Listing", "Columns of tax and group differ"): "FAIL",
        ("Updated Vendor Listing", "Columns of id and name differ"): "PASS", ("Previous Vendor Listing", "Rows"): "PASS", ("Updated Vendor Listing", "Rows"): "FAIL",
    }
    table = spark.createDataFrame([("1", "2", "0"), ("1", "", "-0.00001"), ("2", "x", "-3"), (None, "NaN", "1"), ("z", "1", "Infinity")], "alias string, `13` string, `01` string")
    products = spark.createDataFrame([("1",), ("3",), ("3",)], "alias string")
    got = _lines(k.grid_checks(table, products, "alias", 1))
    assert got["Master Grid", "Repeated products"] == ("FAIL", 1, ["1"]) and got["Master Grid", "Missing products"] == ("FAIL", 1, ["3"])
    assert got["Master Grid", "Quantities of period 13 that are blank or no number"][:2] == ("FAIL", 3)
    assert got["Master Grid", "Quantities of period 01 below zero"] == ("FAIL", 1, ["2"])
    assert got["Master Grid", "Quantities of period 01 that are blank or no number"][1] == 1
    got = _lines(k.grid_checks(table, products, "alias", 5))
    assert got["Master Grid", "Column of period 05"][0] == got["Master Grid", "Column of period 04"][0] == "FAIL"
    assert _lines(k.grid_checks(table, products, "nowhere", 5)) == {("Master Grid", "Product column"): ("FAIL", 1, ["nowhere"])}


def test_rows_and_amounts_that_went_astray(spark):
    from tallywork.sources import checks as k

    rows = spark.createDataFrame(
        [("data", True, "10.00"), ("data", True, " "), ("data", True, "x"), ("data", True, "(2.50)"), ("data", True, "0"), ("data", False, "7.00"), ("data", None, "1"), ("blank", True, ""), (None, True, "3")],
        "row_class string, used boolean, amount string",
    )
    got = {r["check"]: (r["status"], r["n_rows"], r["cents"]) for r in k.arrival_checks("A", rows, F.col("used"), "amount").collect()}
    assert got == {
        "Rows that are not accounted for": ("FAIL", 1, 0), "Rows used": ("PASS", 5, 750), "Rows removed by clean-up": ("PASS", 1, 0), "Amount in rows left out": ("WARNING", 2, 800),
        "Blank amounts": ("WARNING", 1, 0), "Unreadable amounts": ("WARNING", 1, 0), "Zero amounts": ("PASS", 1, 0), "Credits and negative amounts": ("PASS", 1, -250),
    }
    empty = {r["check"]: r["status"] for r in k.arrival_checks("A", rows.limit(0), F.col("used"), "amount").collect()}
    assert empty["Rows used"] == "FAIL" and empty["Rows that are not accounted for"] == "PASS"
