import pytest
from pyspark.sql import functions as F

from tallywork.functions import dates, identifiers as ids, money, values
from tallywork.functions.text import formula_safe, joined_ids


def evaluate(spark, make, texts):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, x string").select("n", make("x").alias("r"))
    return [r["r"] for r in rows.orderBy("n").collect()]


def test_identifier_text_keeps_zeros_and_drops_wrappers(spark):
    got = evaluate(spark, ids.identifier_text, ["  0105 ", "'0105", '="007"', "​AB-1 ", None, "'"])
    assert got == ["0105", "0105", "007", "AB-1", "", "'"]


def test_keys(spark):
    texts = ["PO 800000", "P.O. #12-34", "po800", "POLAR", "123.0", "12.30", "ab-12"]
    assert evaluate(spark, ids.po_key, texts) == ["800000", "1234", "800", "POLAR", "123", "1230", "AB12"]
    assert evaluate(spark, ids.alnum_key, ["INV-7.0", "77.00"]) == ["INV70", "77"]
    assert evaluate(spark, lambda c: ids.folded_source(c, True), ["PO AB-12", "ab 12"]) == ["AB-12", "AB12"]


@pytest.mark.parametrize("key,strength", [("", "NONE"), ("NA", "WEAK"), ("0000", "WEAK"), ("XXXX", "WEAK"), ("XXX", "SPECIFIC"), ("800000", "SPECIFIC")])
def test_reference_strength(spark, key, strength):
    assert evaluate(spark, ids.reference_strength, [key]) == [strength]


def test_numeric_identifiers_never_turn_into_floats(spark):
    out = spark.sql("SELECT CAST(12345678901234567 AS BIGINT) a, CAST(101806.0 AS DOUBLE) b, CAST(1.5 AS DOUBLE) c").select(*[ids.number_identifier(c).alias(c) for c in "abc"])
    assert tuple(out.first()) == ("12345678901234567", "101806", "1.5")


def test_cents(spark):
    texts = ["$1,234.505", "(12.00)", "-5", "1e3", "", "n/a", "(1", "$(12)", "0.004", None, "99999999999999999999"]
    assert evaluate(spark, money.cents, texts) == [123451, -1200, -500, 100000, None, None, None, None, 0, None, None]


def test_fiscal_labels(spark):
    texts = ["P03-2026", "PD 3", "3/26", "14", "PERIOD 7", "3.0", "x", None]
    want = ["P03-2026", "P03-2026", "P03-2026", "Unspecified", "P07-2026", "P03-2026", "Unspecified", "Unspecified"]
    assert evaluate(spark, lambda c: dates.fiscal_label(c, 2026), texts) == want


def test_dates(spark):
    texts = ["2026-01-05", "1/5/2026", "1/5/26", "46027", "2026-02-30", "soon", "2026-01-05 10:30:00"]
    got = [None if d is None else d.isoformat() for d in evaluate(spark, dates.flexible_date, texts)]
    assert got == ["2026-01-05"] * 3 + ["2026-01-05", None, None, "2026-01-05"]


def test_layer_labels(spark):
    got = evaluate(spark, dates.layer_label, ["PD11-26: 07/03/26-07/30/26", "Unknown - Legacy Layer", "2025 carryover"])
    assert [(r[0], str(r[1]), str(r[2])) for r in got] == [("PD11-26", "2026-07-03", "2026-07-30"), ("Legacy", "None", "None"), ("2025", "None", "None")]


def test_fingerprint_values_ignore_formatting(spark):
    got = evaluate(spark, values.fingerprint_value, ["1", "1.0", "1,000", "1/5/2026", "2026-01-05", "Acme  corp", " ACME CORP", "", None])
    assert got == ["num:1", "num:1", "num:1000", "date:2026-01-05", "date:2026-01-05", "text:ACME CORP", "text:ACME CORP", "<NULL>", "<NULL>"]


def test_reference_from_text(spark):
    got = evaluate(spark, lambda c: ids.reference_from_text(c, True), ["PO 800000", "thanks", "load 8840A now", "8840 and 9950", ""])
    assert [tuple(r) for r in got] == [("800000", "description"), ("", ""), ("8840A", "description"), ("", "ambiguous"), ("", "")]


def test_words_and_accounts(spark):
    assert evaluate(spark, ids.reference_words, ["JWOOD7060 inc", "DAVID HOPPER 2.2 co"]) == [["JWOOD"], ["DAVID", "HOPPER"]]
    assert evaluate(spark, lambda c: ids.padded_segment(c, 5), ["12", "12.0", "x", "123456", "1.5", ""]) == ["12000", "12000", None, None, None, None]


def test_small_text_helpers(spark):
    assert evaluate(spark, formula_safe, ["=1+1", "a=1"]) == ["'=1+1", "a=1"]
    out = spark.range(1).select(joined_ids(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(5), 2).alias("r")).first()["r"]
    assert out == "a; b; ... (3 more)"


def test_date_texts_are_read_by_their_evidence(spark):
    texts = {
        "Jan 5, 2026": ("2026-01-05", None, "month name"), "5 January 2026": ("2026-01-05", None, "month name"), "05-Sept-26": ("2026-09-05", None, "month name"),
        "Monday, March 3rd 2025": ("2025-03-03", None, "month name"), "2026 Feb 28": ("2026-02-28", None, "month name"), "Feb 30 2026": (None, None, None),
        "25/12/2025": ("2025-12-25", None, "day first"), "12/25/25": ("2025-12-25", None, "month first"), "3/4/2025": ("2025-03-04", "2025-04-03", "either order"),
        "7.7.2025": ("2025-07-07", None, "month first"), "2025/3/4 10:15": ("2025-03-04", None, "year first"), "20250304": ("2025-03-04", None, "year first"),
        "Ja 5 2026": (None, None, None), "5 of May 2026": (None, None, None), "13/13/2025": (None, None, None), "": (None, None, None), None: (None, None, None),
        "May 2026": (None, None, None), "1/2/3/4": (None, None, None), "Janus 5 2026": (None, None, None), "3 # 4 # 2025": (None, None, None),
    }
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", dates.read_date(dates.date_tokens("x")).alias("r"), dates.flexible_date("x").alias("f"))
    for r in rows.collect():
        got = tuple(None if v is None else str(v) for v in (r.r.day, r.r.other, r.r.reading))
        assert got == texts[r.x], r.x
        assert r.f == r.r.day


def test_short_ways_round_a_cast_read_the_same(spark):
    """F4 to F12: texts that need no work, and texts that are no number, are told before the work."""
    texts = ["AB-1", "= 1", "'A B'", " AB", "AB ", "A\nB", "é1", "A'", '="x" ', ""]
    assert evaluate(spark, ids.identifier_text, texts) == ["AB-1", "= 1", "A B'", "AB", "AB", "A\nB", "é1", "A'", "x", ""]
    texts = ["12.34", "-0.00", "(12.34)", "12.345", "1234567890123456.00", "--1.00", "1.00\n", "5.5", "٣.00"]
    assert evaluate(spark, money.cents, texts) == [1234, 0, -1234, 1235, 123456789012345600, None, 100, 550, 300]
    texts = ["2026-01-05", "2026-13-05", "2026-1-5", "46027.0", "4.6027e4", "0x1.68p15", "1-2-2026", "2026-01-05\n"]
    got = [None if d is None else d.isoformat() for d in evaluate(spark, dates.flexible_date, texts)]
    assert got == ["2026-01-05", None, "2026-01-05", "2026-01-05", "2026-01-05", "2026-02-27", "2026-01-02", "2026-01-05"]
    texts = ["1e3", "+5", "1-URGENT", "5d", "-.5", "2026/01", "CUST 12", "٣"]
    want = ["num:1000", "num:5", "text:1-URGENT", "text:5D", "num:-0.5", "text:2026/01", "text:CUST 12", "num:3"]
    assert evaluate(spark, values.fingerprint_value, texts) == want
    texts = ["AB ABC 12XYZ9 THE n/a", "ABCABC abc", "co", "ÄBCD", None]
    assert evaluate(spark, ids.reference_words, texts) == [["ABC", "XYZ"], ["ABC", "ABCABC"], [], ["BCD"], []]
    assert evaluate(spark, lambda c: dates.fiscal_label(c, 2026), ["P3", "13/1999", "12-26"]) == ["P03-2026", "P13-1999", "P12-2026"]
