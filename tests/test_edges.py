"""Cases that once gave a wrong answer, a crash or a check that could not fail."""

import os
import subprocess
import sys
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallywork.operators import cleanup, fifo, insights, materials, tax, workflow
from tallywork.sources import profile


def test_item_ids_are_whole_and_padded(spark):
    products = spark.createDataFrame([(1, "caps"), (2, "film")], "alias int, name string")
    ids = spark.createDataFrame([("ITM-12", 1), ("ITM-05", 2), ("ITM-123", 2)], "product_id string, alias int")
    spellings = materials.spelling_table(products, ids=ids)
    cells = ["ITM-12", "ITM-123", "ITM-12 spare", "ITM 05", "itm_005", "ITM5", "ITM-1234"]
    rows = spark.createDataFrame(list(enumerate(cells)), "row int, cell string")
    got = {cells[r["row"]]: (r["alias"], r["status"]) for r in materials.resolve_cells(rows, ["cell"], spellings, "row").collect()}
    assert got["ITM-12"] == (1, "OK") and got["ITM-123"] == (2, "OK")
    assert got["ITM 05"] == got["itm_005"] == got["ITM5"] == (2, "OK")
    assert got["ITM-12 spare"] == got["ITM-1234"] == (None, "UNMAPPED")


def test_a_layer_of_no_quantity_serves_no_period(spark):
    layers = spark.createDataFrame([(1, 1, 0, "x", None, 5.0, 5.0), (1, 1, 1, "y", None, 0.0, 0.0), (1, 1, 2, "z", None, 5.0, 10.0)], "product bigint, kind int, seq bigint, layer_id string, start_day date, qty double, total_value double")
    usage = spark.createDataFrame([(1, 1, 8.0)], "product bigint, period_no int, usage_qty double")
    got = {r["seq"]: (r["qty"], r["value"]) for r in fifo.allocate_periods(layers, usage).collect()}
    assert got == {0: (5.0, 5.0), 2: (3.0, 6.0)}


def test_shares_of_nothing_are_null(spark):
    hand = spark.createDataFrame([(1, date(2026, 1, 1), 1.0, 0.0)], "product bigint, start_day date, qty double, total_value double")
    assert [r["share"] for r in insights.aging_shares(hand, "2026-01-20").collect()] == [None]


def test_vendors_without_a_name_are_still_there(spark):
    columns = "vendor_id string, vendor_name string, source_pos bigint"
    old = spark.createDataFrame([("1", None, 1), ("2", "B", 2), ("3", None, 3), ("5", "E", 4)], columns)
    new = spark.createDataFrame([("1", "A", 1), ("2", None, 2), ("3", None, 3), ("4", None, 4)], columns)
    got = {r["key"]: r["change"] for r in cleanup.diff_vendors(old, new).collect()}
    assert got == {"1": "renamed", "2": "renamed", "3": "unchanged", "4": "added", "5": "removed"}


def test_events_of_one_instant_go_by_their_number(spark):
    at = datetime(2026, 1, 1, 12)
    big = 1 << 25
    events = spark.createDataFrame([(1, "a", at, big - 1), (1, "b", at, big), (1, "c", at, 3 * big + 5)], "document bigint, stage string, at timestamp, event_no bigint")
    got = {r["stage"]: r["from_stage"] for r in workflow.history(events).collect()}
    assert got == {"a": None, "b": "a", "c": "b"}
    actions = events.select("document", "at", "event_no", F.when(F.col("stage") == "a", "open").otherwise("close").alias("action"))
    end = workflow.replay(actions, {"open": ("new", "opened"), "close": ("opened", "closed")}, "new").first()
    assert (end["stage"], end["applied"], end["refused"]) == ("closed", 2, 1)


def test_fingerprint_knows_the_column_names(spark):
    rows = spark.createDataFrame([("1", "2")], "a string, b string")
    mark = lambda df: profile.fingerprint(df).first()["content"]
    assert mark(rows) != mark(rows.toDF("c", "d")) and mark(rows) != mark(rows.toDF("b", "a"))
    assert mark(rows) == mark(rows.select("b", "a"))


def test_every_search_word_counts(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h zebra")], "k int, text string")
    assert [r["k"] for r in workflow.search_text(rows, "text", "a b c d e f g h zebra").collect()] == [2]
    assert workflow.search_text(rows, "text", " ").count() == 2


def test_prices_at_thousands_of_locations(spark):
    places = spark.range(2_500).select(
        F.concat(F.lit("L"), "id").alias("location"), *[F.lit("1.00").cast("decimal(9,4)").alias(n) for n in tax.LOCAL_LINES]
    )
    prices = spark.createDataFrame([("10.00",)], "p string").select(tax.price_cents("p").alias("price"))
    out = tax.compare_locations(prices, places)
    assert out.count() == 5_000 and out.select("location").distinct().count() == 2_500


CHECKS = {
    "Processing Integrity": ("processing_error", "boom"), "Beginning Quantity Agreement": ("beg_variance_qty", 1.0),
    "Estimated Value Effect of Beginning Qty Variance": ("beg_variance_val", 1.0), "Receipt Quantity Agreement": ("raw_qty", 1.0),
    "Receipt Value Agreement": ("raw_val", 1.0), "Depletion Quantity Agreement": ("depleted_qty", 1.0),
    "Layer Value Conservation": ("value_variance", 1.0), "Ending Quantity to Open Layers": ("open_qty", 1.0),
    "Ending Value to Open Layers": ("layer_val", 999.0), "FIFO Chronology": ("unordered", True), "Unpriced Layer Count": ("unpriced_layers", 1),
}


@pytest.fixture(scope="module")
def sound(spark):
    products = spark.createDataFrame([(1, "caps")], "product bigint, name string")
    grid = spark.createDataFrame([(1, 10.0, 12.0)], "product bigint, expected_qty double, ending_qty double")
    receipts = spark.createDataFrame([(1, date(2026, 1, 5), 1, 5.0, 10.0)], "product bigint, delivered date, source_pos bigint, qty double, total double")
    opening = spark.createDataFrame([(1, 1, "2025-12-01", None, 10.0, 10.0, 1.0)], "product bigint, seq bigint, date_text string, start_day date, qty double, total_value double, unit_cost double")
    results, _ = fifo.stage_batch(products, grid, receipts, opening, "FY2026-P01")
    return spark.createDataFrame(results.collect(), results.schema)


def test_a_sound_product_passes_every_check(sound):
    assert {r["check"]: r["status"] for r in fifo.product_checks(sound).collect()} == dict.fromkeys(CHECKS, "PASS")
    assert fifo.summary_status(sound).first()["overall_status"] == "PASS"


@pytest.mark.parametrize("check", CHECKS)
def test_each_product_check_can_fail(sound, check):
    column, value = CHECKS[check]
    changed = F.lit(value) if not isinstance(value, float) else F.col(column) + F.lit(value)
    got = {r["check"]: r["status"] for r in fifo.product_checks(sound.withColumn(column, changed)).collect()}
    assert {k for k, s in got.items() if s != "PASS"} == {check}


def test_tolerances_are_the_callers(sound):
    off = sound.withColumn("value_variance", F.lit(0.5))
    assert fifo.summary_status(off).first()["overall_status"] == "FAIL"
    assert fifo.summary_status(off, value_tolerance=1).first()["overall_status"] == "PASS"
    checks = {r["check"]: r["status"] for r in fifo.product_checks(off, value_tolerance="1.00").collect()}
    assert checks["Layer Value Conservation"] == "PASS"


def test_entry_runs_from_another_folder(tmp_path):
    """Executors get the package from the session, not from the working folder."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util, sys\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"spec = importlib.util.spec_from_file_location('entry', {top + '/__spark_entry__.py'!r})\n"
        "entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)\n"
        "print('ROWS', entry.queries()['spec_full'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_days_inside_ten_thousand_spans_of_one_material(spark):
    import random
    from datetime import date, timedelta

    from tallywork.runtime import inside_spans

    luck, first = random.Random(2), date(2020, 1, 1)
    day = lambda n: first + timedelta(days=n)
    spans = [(1, day(luck.randrange(0, 3000)), luck.randrange(-1, 3)) for _ in range(10_000)] + [(2, day(5), 10), (2, None, 3), (None, day(1), 9)]
    spans = [(a, s, s and s + timedelta(days=n)) for a, s, n in spans if not (a == 1 and s and (s - first).days % 7 == 0)]
    points = [(1, day(n)) for n in range(-3, 3010)] + [(2, day(n)) for n in range(0, 20)] + [(3, day(1)), (1, None)]
    got = inside_spans(
        spark.createDataFrame(points * 2, "alias int, delivered date"), spark.createDataFrame(spans, "alias int, start_day date, end_day date"),
        ["alias"], "delivered", "start_day", "end_day", "covered",
    ).collect()
    held = {(a, s + timedelta(days=k)) for a, s, e in spans if s for k in range((e - s).days + 1)}
    assert len(got) == len({(r.alias, r.delivered) for r in got}) and {(r.alias, r.delivered) for r in got} == held & set(points)


def test_days_of_many_years_look_up_their_period(spark):
    from datetime import date, timedelta
    from functools import reduce

    from tallywork.operators import late

    years = range(1960, 2020)
    calendars = reduce(lambda x, y: x.unionByName(y), [late.calendar(spark, y, date(y, 1, 1)) for y in years])
    broken = spark.createDataFrame([(2050, 1, date(2050, 2, 1), date(2050, 1, 1)), (2051, 1, date(2051, 1, 1), None)], calendars.schema)
    days = [(k, date(1959, 12, 30) + timedelta(days=17 * k)) for k in range(1400)] + [(-1, None), (-2, date(2050, 1, 15)), (-3, date(2051, 1, 1))]
    got = {r.k: (r.fiscal_year, r.period) for r in late.with_period(spark.createDataFrame(days, "k int, day date"), calendars.unionByName(broken), "day").collect()}
    for k, d in days:
        place = (d - date(d.year, 1, 1)).days // 28 if d else None
        assert got[k] == ((d.year, place + 1) if d and d.year in years and place < 13 else (None, None))


def test_blank_keys_meet_nothing_and_are_spread(spark):
    from tallywork.runtime import join_filled

    rows = spark.createDataFrame([(n, k, n) for n, k in enumerate(["a", "", None, "b", "", "a"])], "row_id int, key string, cents int")
    other = spark.createDataFrame([("a", 0, "x"), ("", 1, "y"), (None, 2, "z"), ("b", 9, "w")], "key string, cents int, found string")
    got = {r["row_id"]: (r["key"], r["found"]) for r in join_filled(rows, other.drop("cents"), ["key"], "row_id").collect()}
    assert got == {0: ("a", "x"), 1: ("", None), 2: (None, None), 3: ("b", "w"), 4: ("", None), 5: ("a", "x")}
    got = {r["row_id"]: r["found"] for r in join_filled(rows, other, ["key", "cents"], "row_id").collect()}
    assert got == {0: "x", 1: None, 2: None, 3: None, 4: None, 5: None}
    many = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit("").alias("key"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [len(x) for x in join_filled(many, other.drop("cents"), ["key"], "row_id").rdd.glom().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 3_500
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
