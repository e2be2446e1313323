import random
from datetime import date, timedelta

import pytest

from tallywork import runtime
from tallywork.operators import fifo, insights, periods

RECEIPT = "product bigint, delivered date, source_pos bigint, qty double, total double"
OPEN = "product bigint, seq bigint, date_text string, start_day date, qty double, total_value double, unit_cost double"


def sequential(layers, usage):
    left, out = max(usage, 0.0), []
    for qty, value in layers:
        used = min(qty, left)
        left -= used
        rest = qty - used
        cost = 0.0 if used <= 1e-4 else value if rest <= 1e-4 else value * used / qty
        out.append((used, rest, cost))
    return out


@pytest.mark.parametrize("block", [1 << 20, 4])
def test_consumption_equals_the_sequential_rule(spark, block, monkeypatch):
    """Also with tiny blocks, so that totals cross block borders."""
    monkeypatch.setattr(runtime, "BLOCK_ROWS", block)
    rng = random.Random(5)
    rows, usage, want = [], [], {}
    for p in range(12):
        layers = [(float(rng.randrange(1, 50)), round(rng.random() * 500, 2)) for _ in range(rng.randrange(1, 15))]
        take = rng.choice([0.0, -5.0, sum(q for q, _ in layers), float(rng.randrange(0, 200))])
        rows += [(p, 0 if n < 3 else 1, n, "x", None, q, v) for n, (q, v) in enumerate(layers)]
        usage.append((p, take))
        want[p] = sequential(layers, take)
    out = fifo.consume(spark.createDataFrame(rows, fifo.LAYER_SCHEMA), spark.createDataFrame(usage, "product bigint, usage_qty double"))
    got = {}
    for r in out.orderBy("product", "seq").collect():
        got.setdefault(r["product"], []).append((r["consumed"], r["remaining"], r["consumed_value"]))
    for p, rows_ in want.items():
        for x, y in zip(got[p], rows_):
            assert x == pytest.approx(y, abs=1e-6)


def test_runs_break_on_an_intervening_price(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BLOCK_ROWS", 2)
    d = date(2026, 1, 5)
    receipts = spark.createDataFrame([(1, d, n, 10.0, t) for n, t in enumerate([20.0, 20.0, 30.0, 20.0, 20.0])] + [(1, d + timedelta(1), 0, 5.0, 10.0)], RECEIPT)
    got = [(r["seq"], r["qty"], r["receipt_count"], r["layer_id"]) for r in fifo.consolidate_receipts(receipts, "P01").orderBy("seq").collect()]
    assert got == [(1, 20.0, 2, "P01-001"), (2, 10.0, 1, "P01-002"), (3, 25.0, 3, "P01-003")]


def batch(spark):
    d = date(2026, 1, 5)
    products = spark.createDataFrame([(1, "caps"), (2, "film"), (3, "glue"), (4, "labels"), (5, "lost"), (6, "twice")], "product bigint, name string")
    grid = spark.createDataFrame(
        [(1, 100.0, 30.0), (2, None, None), (3, None, 0.0), (4, None, 999.0), (6, None, 1.0), (6, None, 1.0)], "product bigint, expected_qty double, ending_qty double"
    )
    receipts = spark.createDataFrame([(1, d, 1, 50.0, 100.0), (2, d, 1, 5.0, 10.0), (3, d, 1, -1.0, 10.0)], RECEIPT)
    opening = spark.createDataFrame(
        [(1, 1, "2025-12-01", None, 60.0, 60.0, 1.0), (1, 2, "2025-12-20", None, 40.0, 60.0, 1.5), (2, 1, "Unknown - Legacy Layer", None, 10.0, 10.0, 1.0), (4, 1, "2025-12-01", None, 10.0, 10.0, 1.0), (6, 1, "x", None, 1.0, 1.0, 1.0)], OPEN
    )
    return fifo.stage_batch(products, grid, receipts, opening, "FY2026-P01")


def test_batch_isolates_failures_and_carries_forward(spark):
    results, used = batch(spark)
    r = {x["product"]: x for x in results.collect()}
    assert r[1]["usage_qty"] == 120.0 and r[1]["usage_val"] == pytest.approx(60 + 60 + 100 * 20 / 50) and r[1]["end_val"] == pytest.approx(60.0)
    assert r[2]["carried_forward"] and r[2]["usage_qty"] == 0 and r[2]["open_qty"] == 15.0
    assert r[3]["processing_error"] == "Receipt quantity must be positive"
    assert r[4]["variance_qty"] == 989.0
    assert r[5]["processing_error"] == "Product alias was not found in the Master Grid."
    assert r[6]["processing_error"] == "Product alias appears more than once in the Master Grid."
    status = {x["product"]: x["overall_status"] for x in fifo.summary_status(results).collect()}
    assert status[1] == "PASS" and status[2] == "PASS" and all(status[p] == "FAIL" for p in (3, 4, 5, 6))
    checks = {(x["product"], x["check"]): x["status"] for x in fifo.product_checks(results).collect()}
    assert checks[1, "Depletion Quantity Agreement"] == "PASS" and checks[4, "Ending Quantity to Open Layers"] == "FAIL"
    counts = fifo.control_counts(fifo.summary_status(results)).first()
    assert (counts["pass_count"], counts["review_count"], counts["fail_count"]) == (2, 0, 4)
    hand = {(x["product"], x["seq"]): x["qty"] for x in fifo.on_hand(used).collect()}
    assert hand[1, 1] == 30.0 and hand[2, 1] == 10.0 and hand[2, 2] == 5.0


def test_chronology_passes_over_undated_layers(spark):
    rows = [(1, 0, 1, "a", date(2026, 1, 5), 1.0, 1.0), (1, 0, 2, "b", None, 1.0, 1.0), (1, 1, 1, "c", date(2026, 1, 4), 1.0, 1.0), (2, 0, 1, "d", date(2026, 1, 5), 1.0, 1.0), (2, 1, 1, "e", date(2026, 1, 5), 1.0, 1.0)]
    assert [r["product"] for r in fifo.chronology_breaks(spark.createDataFrame(rows, fifo.LAYER_SCHEMA)).collect()] == [1]


def test_periods_in_one_pass_equal_period_by_period(spark):
    layers = spark.createDataFrame([(1, 1, n, "x", None, q, q * (n + 1)) for n, q in enumerate([10.0, 5.0, 20.0])], fifo.LAYER_SCHEMA)
    usage = spark.createDataFrame([(1, 1, 7.0), (1, 2, 0.0), (1, 3, 20.0)], "product bigint, period_no int, usage_qty double")
    got = {(r["seq"], r["period_no"]): r["qty"] for r in fifo.allocate_periods(layers, usage).collect()}
    assert got == {(0, 1): 7.0, (0, 3): 3.0, (1, 3): 5.0, (2, 3): 12.0}


def test_close_reopen_and_sequence(spark, tmp_path):
    path = str(tmp_path / "store")
    layers = spark.createDataFrame([(1, 1, 5.0, 10.0)], "product bigint, seq bigint, qty double, total_value double")
    none = spark.createDataFrame([(1, "r1")], "product bigint, receipt string")
    periods.close_period(path, 2026, 12, layers, layers, none, none)
    with pytest.raises(ValueError):
        periods.close_period(path, 2027, 1, layers, layers, none, none)
    periods.close_period(path, 2026, 13, layers, layers, none, none)
    periods.close_period(path, 2027, 1, layers, layers, none, none)
    stored = spark.read.parquet(f"{path}/layers")
    assert periods.roll_forward_breaks(stored).count() == 0
    assert periods.total_breaks(stored, periods.closures(spark, path)).count() == 0
    assert periods.receipt_register(spark, path).count() == 3
    with pytest.raises(ValueError):
        periods.reopen_latest(spark, path, 2026, 13)
    periods.reopen_latest(spark, path, 2027, 1)
    assert periods.receipt_register(spark, path).count() == 2
    assert periods.current_layers(stored, periods.closures(spark, path)).first()["period"] == 13


def test_aging(spark):
    hand = spark.createDataFrame([(1, date(2026, 1, 1), 1.0, 10.0), (1, None, 1.0, 5.0), (2, date(2025, 1, 1), 2.0, 7.0)], "product bigint, start_day date, qty double, total_value double")
    rows = {r["product"]: r for r in insights.aging_pivot(hand, "2026-01-20").collect()}
    assert rows[1]["d0_30"] == 10.0 and rows[1]["unknown"] == 5.0 and rows[2]["d90_up"] == 7.0 and rows[None]["total"] == 22.0
    shares = {r["bucket"]: r["share"] for r in insights.aging_shares(hand, "2026-01-20").collect()}
    assert sum(shares.values()) == pytest.approx(100)


def test_canonical_layers_name_what_they_refuse(spark):
    rows = [(1, 1, "x", None, -1.0, 1.0, 0.0), (2, 1, "x", None, 0.00005, 1.0, 0.0), (3, 1, "x", None, 2.0, None, 3.0)]
    got = {r["product"]: r for r in fifo.canonical_layers(spark.createDataFrame(rows, OPEN)).collect()}
    assert got[1]["layer_error"] and got[2]["qty"] == 0 and got[3]["total_value"] == 6.0
