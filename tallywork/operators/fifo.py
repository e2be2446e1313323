"""First-in, first-out layer costing for all products at once.

Layers: `product, kind (0 carried, 1 received), seq, date_text, start_day, qty, total_value`. Consumption is closed
form: what a layer gives up is the part of the usage left after the layers before it, so it needs one running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import layer_date
from ..runtime import cut, hot_places, over_group, previous_values, running_before

# Tolerances of the engine.
QTY_TOLERANCE = 0.0001
VALUE_TOLERANCE = 0.01
LAYER_SCHEMA = "product bigint, kind int, seq bigint, date_text string, start_day date, qty double, total_value double"
SAME_RUN = ["unit_cost", "uom", "cost_basis", "transaction_type"]


def canonical_layers(layers: DataFrame) -> DataFrame:
    """Tiny quantities and values to zero, unit cost = value / quantity; `layer_error` says why a layer is refused."""
    qty, supplied = F.col("qty"), F.coalesce(F.col("total_value"), F.col("qty") * F.col("unit_cost"))
    out = layers.withColumns(
        {
            "layer_error": F.when(qty < -QTY_TOLERANCE, "FIFO layer quantity cannot be negative.").when(
                supplied < -VALUE_TOLERANCE, "FIFO layer total value cannot be negative."
            ),
            "total_value": F.when(F.abs(supplied) < 1e-12, F.lit(0.0)).otherwise(supplied),
            "qty": F.when(F.abs(qty) <= QTY_TOLERANCE, F.lit(0.0)).otherwise(qty),
        }
    )
    return out.withColumn("unit_cost", F.when(F.col("qty") > QTY_TOLERANCE, F.col("total_value") / F.col("qty")).otherwise(0.0))


def receipt_errors(receipts: DataFrame) -> DataFrame:
    """Products with a receipt the engine refuses, and the first reason."""
    reason = (
        F.when(F.col("delivered").isNull(), "Receipt delivery date is invalid")
        .when(F.col("qty").isNull() | (F.col("qty") <= QTY_TOLERANCE), "Receipt quantity must be positive")
        .when(F.col("total").isNull(), "Receipt total value is not numeric")
        .when(F.col("total") < -VALUE_TOLERANCE, "Receipt total value cannot be negative")
    )
    return receipts.withColumn("receipt_error", reason).filter("receipt_error IS NOT NULL").groupBy("product").agg(
        F.min("receipt_error").alias("receipt_error")
    )


def receipt_runs(receipts: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """Number the receipt runs of each product: consecutive receipts of exactly one unit cost, unit and basis.

    Order is delivery date, then source position. An intervening receipt of another cost breaks the run. `hot`: the hot places of the
    products, if known (`runtime.hot_places`).
    """
    # What is the same on every row, or follows from other columns, is added behind the shuffle.
    given = [name for name in SAME_RUN if name != "unit_cost" and name in receipts.columns]
    hot = hot_places([receipts], ["product"]) if hot is None else hot
    linked = previous_values(receipts, ["product"], "delivered", "source_pos", ["total", "qty", *given], hot)
    same = F.col("previous").isNotNull() & (F.col("previous.total") / F.col("previous.qty") == F.col("total") / F.col("qty"))
    for name in given:
        same = same & (F.col(f"previous.{name}") == F.col(name))
    starts = linked.withColumn("starts", F.coalesce((~same).cast("bigint"), F.lit(1)))
    return running_before(starts, ["product"], "delivered", "source_pos", {"earlier_runs": F.col("starts")}, hot=hot).withColumns(
        {name: F.lit("") for name in SAME_RUN if name != "unit_cost" and name not in given}
        | {"unit_cost": F.col("total") / F.col("qty"), "run": F.col("earlier_runs") + F.col("starts")}
    ).drop("previous", "starts", "earlier_runs", "_block")


def consolidate_receipts(receipts: DataFrame, source_period: str, hot: list[int] | None = None) -> DataFrame:
    """One layer per run. The receipts behind a layer stay in the run table (`receipt_runs`): lineage is a join."""
    return receipt_runs(receipts, hot).groupBy("product", "run").agg(
        F.sum("qty").alias("qty"), F.sum("total").alias("total_value"), F.min("delivered").alias("start_day"),
        F.max("delivered").alias("end_day"), F.count("*").alias("receipt_count"),
    ).select(
        "product", F.lit(1).alias("kind"), F.col("run").alias("seq"), F.col("start_day").cast("string").alias("date_text"),
        "start_day", "end_day", "qty", "total_value", "receipt_count",
        F.format_string(f"{source_period}-%03d", "run").alias("layer_id"), F.lit(source_period).alias("source_period"),
    )


def stack_layers(opening: DataFrame, received: DataFrame) -> DataFrame:
    """Carried layers first, received layers after; unnamed carried layers are called OPEN-nnn."""
    named = opening if "layer_id" in opening.columns else opening.withColumn("layer_id", F.lit(None).cast("string"))
    carried = named.withColumns(
        {
            "kind": F.lit(0), "start_day": F.coalesce("start_day", layer_date("date_text")),
            "layer_id": F.coalesce(F.nullif("layer_id", F.lit("")), F.format_string("OPEN-%03d", "seq")),
        }
    )
    return carried.unionByName(received, allowMissingColumns=True)


def _backwards(newest: str) -> Column:
    """A dated layer older than one before it. Somewhere in a product there is one if and only if some layer is older than the
    one just before it; undated layers are passed over."""
    return F.col("start_day") < F.col(newest)


def placed_layers(layers: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """Adds `qty_before`, the quantity of the product's layers before, and `unordered`, whether its dated layers go back in
    time: one shuffle by product for both. Layers without a product or a sequence are left out."""
    running = running_before(layers, ["product"], "kind", "seq", {"qty_before": F.col("qty")}, {"newest": F.col("start_day")}, hot)
    back = running.withColumn("unordered", F.coalesce(_backwards("newest"), F.lit(False))).drop("_block", "newest")
    return over_group(back, ["product"], {"unordered": F.max("unordered")}, hot)


def chronology_breaks(layers: DataFrame) -> DataFrame:
    """Products whose dated layers are not in non-decreasing order; undated layers are passed over. What `placed_layers`
    found is taken as it is."""
    if "unordered" in layers.columns:
        return layers.filter("unordered").select("product").distinct()
    dated = layers.filter("start_day IS NOT NULL")
    linked = running_before(dated, ["product"], "kind", "seq", {}, {"newest": F.col("start_day")})
    return linked.filter(_backwards("newest")).select("product").distinct()


def consume(layers: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Take `usage_qty` of each product from its layers, oldest first; adds consumed and remaining parts.

    A negative usage (a count above stock) takes nothing. Value is split in proportion; the last part takes the rest. Layers that
    bring `qty_before` (`placed_layers`) and, without `usage`, their product's `usage_qty` are not moved again.
    """
    qty, value = F.col("qty"), F.col("total_value")
    if "qty_before" not in layers.columns:
        layers = running_before(layers, ["product"], "kind", "seq", {"qty_before": qty}).drop("_block")
    if usage is not None:
        layers = layers.join(usage.select("product", "usage_qty"), "product")
    wanted = F.greatest(F.coalesce("usage_qty", F.lit(0.0)), F.lit(0.0))
    taken = layers.withColumn("consumed", F.greatest(F.lit(0.0), F.least(qty, wanted - F.col("qty_before"))))
    taken = taken.withColumn("remaining", qty - F.col("consumed"))
    consumed_value = (
        F.when(F.col("consumed") <= QTY_TOLERANCE, F.lit(0.0))
        .when(F.col("remaining") <= QTY_TOLERANCE, value)
        .otherwise(value * (F.col("consumed") / qty))
    )
    return taken.withColumn("consumed_value", consumed_value).withColumns(
        {
            "remaining_value": value - F.col("consumed_value"),
            "unit_cost": F.when(qty > QTY_TOLERANCE, value / qty).otherwise(0.0),
            "status": F.when(
                F.col("consumed") > QTY_TOLERANCE,
                F.when(F.col("remaining") <= QTY_TOLERANCE, "Fully Depleted").otherwise("Partially Depleted"),
            ),
        }
    ).drop("qty_before")


def on_hand(consumed: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """What is left, as the layers the next period starts from (sequence closed up in FIFO order)."""
    left = consumed.filter(F.col("remaining") > QTY_TOLERANCE)
    placed = running_before(left, ["product"], "kind", "seq", {"earlier": F.lit(1)}, hot=hot).drop("_block")
    return placed.select(
        "product", (F.col("earlier") + 1).cast("bigint").alias("seq"), "layer_id", "date_text", "start_day",
        F.col("remaining").alias("qty"), F.col("remaining_value").alias("total_value"),
        (F.col("remaining_value") / F.col("remaining")).alias("unit_cost"), F.col("qty").alias("original_qty"),
    )


def depleted(consumed: DataFrame) -> DataFrame:
    return consumed.filter(F.col("consumed") > QTY_TOLERANCE).select(
        "product", "kind", "seq", "layer_id", "date_text", "start_day", F.col("qty").alias("qty_available"), "consumed",
        "remaining", "unit_cost", "consumed_value", "status",
    )


def roll_forward(consumed: DataFrame, counts: DataFrame) -> DataFrame:
    """Beginning, purchases, usage, ending and variances per product. `counts` has product, ending_qty."""
    carried, received = F.col("kind") == 0, F.col("kind") == 1
    zero = F.lit(0.0)

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name))), zero)

    used, left = F.col("consumed") > QTY_TOLERANCE, F.col("remaining") > QTY_TOLERANCE
    sums = consumed.groupBy("product").agg(
        total(carried, "qty").alias("beg_qty"), total(carried, "total_value").alias("beg_val"),
        total(received, "qty").alias("purch_qty"), total(received, "total_value").alias("purch_val"),
        total(used, "consumed_value").alias("usage_val"), total(left, "remaining_value").alias("end_val"),
        total(used, "consumed").alias("depleted_qty"), total(left, "remaining").alias("open_qty"),
        F.count_if(left).alias("open_layers"),
        F.count_if((left | used) & (F.col("unit_cost") <= 0)).alias("unpriced_layers"),
        total(left & (F.col("unit_cost") <= 0), "remaining").alias("unpriced_qty"),
        total(used & (F.col("unit_cost") <= 0), "consumed").alias("unpriced_usage_qty"),
    )
    out = counts.select("product", "ending_qty").join(sums, "product", "left").fillna(
        0.0, [c for c in sums.columns if c != "product"]
    )
    usage = F.col("beg_qty") + F.col("purch_qty") - F.col("ending_qty")
    short = usage - F.col("beg_qty") - F.col("purch_qty")
    return out.withColumns(
        {
            "usage_qty": usage,
            "variance_qty": F.when(usage < 0, -usage).when(short > 0, -short).otherwise(zero),
            "value_variance": F.col("beg_val") + F.col("purch_val") - F.col("usage_val") - F.col("end_val"),
        }
    )


def stage_batch(products: DataFrame, grid: DataFrame, receipts: DataFrame, opening: DataFrame, source_period: str):
    """Cost every product for one period. Returns (results, consumed layers).

    `grid` holds product, expected_qty (null: take what the layers hold) and ending_qty (null: no count, carry
    forward; 0 is a count of zero). A product with a problem keeps its layers and carries the reason; it never stops
    the others.
    """
    one = grid.groupBy("product").agg(
        F.count("*").alias("grid_rows"), F.max("expected_qty").alias("expected_qty"), F.max("ending_qty").alias("count_qty")
    )
    hot = hot_places([receipts, opening], ["product"])
    opening = canonical_layers(opening)
    held = opening.groupBy("product").agg(
        F.sum("qty").alias("held_qty"), F.sum("total_value").alias("held_val"), F.max("layer_error").alias("layer_error")
    )
    received = receipts.groupBy("product").agg(F.sum("qty").alias("received_qty"), F.sum("total").alias("received_val"))
    base = (
        products.join(one, "product", "left").join(held, "product", "left").join(received, "product", "left")
        .join(receipt_errors(receipts), "product", "left")
        .fillna(0.0, ["held_qty", "held_val", "received_qty"])
    )
    # No layers on file but a beginning quantity expected: it is carried at no cost, and the unpriced-layer checks name it.
    invented = F.col("held_qty").isNull() | ((F.col("held_qty") == 0) & (F.coalesce("expected_qty", F.lit(0.0)) > 0))
    base = base.withColumn("expected_qty", F.coalesce("expected_qty", "held_qty"))
    base = base.withColumns({"invented": invented, "beg_held": F.when(invented, F.col("expected_qty")).otherwise(F.col("held_qty"))})
    base = base.withColumns(
        {
            "carried_forward": F.col("count_qty").isNull(),
            "ending_qty": F.coalesce("count_qty", F.col("beg_held") + F.col("received_qty")),
            "beg_variance_qty": F.col("beg_held") - F.col("expected_qty"),
        }
    )
    error = (
        F.when(F.col("grid_rows") > 1, "Product alias appears more than once in the Master Grid.")
        .when(F.col("grid_rows").isNull(), "Product alias was not found in the Master Grid.")
        .when(F.col("layer_error").isNotNull(), F.col("layer_error"))
        .when(F.col("ending_qty") < -QTY_TOLERANCE, "Ending inventory quantity cannot be negative.")
        .when(F.col("receipt_error").isNotNull(), F.col("receipt_error"))
    )
    base = cut(base.withColumn("input_error", error), "batch", compression="zstd")
    carry = base.filter("invented").select(
        "product", F.lit(1).cast("bigint").alias("seq"), F.lit("Prior Period Carryover").alias("date_text"),
        F.lit(None).cast("date").alias("start_day"), F.col("expected_qty").alias("qty"), F.lit(0.0).alias("total_value"),
    )
    # One shuffle of the layers by product serves their sums, their order and the usage they meet; names and costs, which follow from
    # other columns, are added to what was written.
    carried = opening.drop("layer_error", "unit_cost").unionByName(carry, allowMissingColumns=True)
    sound_receipts = receipts.join(receipt_errors(receipts).select("product"), "product", "left_anti")
    fresh = consolidate_receipts(sound_receipts, source_period, hot).drop("date_text", "layer_id", "source_period")
    layers = placed_layers(stack_layers(carried, fresh), hot)
    facts = base.select(
        "product", F.col("input_error").isNotNull().alias("failed"),
        (F.col("beg_held") + F.col("received_qty") - F.col("ending_qty")).alias("usage_qty"),
    )
    failed = F.col("failed") | F.col("unordered")
    stocked = layers.join(facts, "product").withColumns({"failed": failed, "usage_qty": F.when(failed, F.lit(0.0)).otherwise(F.col("usage_qty"))})
    stocked = cut(stocked, "consumed", compression="zstd")
    # A failed product keeps its opening layers as they are: nothing received, nothing used.
    mine = F.col("kind") == 1
    period = F.col("source_period") if "source_period" in stocked.columns else F.lit(None).cast("string")
    used = consume(stocked.filter(~F.col("failed") | ~mine).drop("failed", "unordered")).withColumns(
        {
            "date_text": F.when(mine, F.col("start_day").cast("string")).otherwise(F.col("date_text")),
            "layer_id": F.when(mine, F.format_string(f"{source_period}-%03d", "seq")).otherwise(F.col("layer_id")),
            "source_period": F.when(mine, F.lit(source_period)).otherwise(period),
        }
    )
    unordered = chronology_breaks(stocked).withColumn("unordered", F.lit(True))
    base = base.join(unordered, "product", "left").withColumn(
        "processing_error", F.coalesce("input_error", F.when(F.col("unordered"), "FIFO layers are not in non-decreasing chronological order."))
    )
    failed = F.col("processing_error").isNotNull()
    figures = roll_forward(used, base.select("product", "ending_qty"))
    # What the controls compare with: sums taken from the receipts and from the layers on hand themselves.
    raw = {"raw_qty": F.when(~failed, F.col("received_qty")), "raw_val": F.when(~failed, F.col("received_val"))}
    open_layers = on_hand(used, hot).groupBy("product").agg(F.sum("total_value").alias("layer_val"))
    results = base.select(
        "product", "name", "processing_error", "carried_forward", "beg_variance_qty", F.col("grid_rows"),
        F.coalesce("unordered", F.lit(False)).alias("unordered"), *[v.alias(n) for n, v in raw.items()],
    ).join(figures, "product").join(open_layers, "product", "left").fillna(
        0.0, ["raw_qty", "raw_val", "layer_val"]
    ).withColumns(
        {
            "usage_qty": F.when(failed, F.lit(0.0)).otherwise(F.col("usage_qty")),
            "variance_qty": F.when(failed, F.col("beg_qty") - F.col("ending_qty")).otherwise(F.col("variance_qty")),
            "beg_variance_val": F.col("beg_variance_qty")
            * F.when(F.col("beg_qty") != 0, F.col("beg_val") / F.col("beg_qty")).otherwise(0.0),
        }
    )
    return results, used


# --- controls ---------------------------------------------------------------------------------------------------

def _qty_material(value, tolerance: float = QTY_TOLERANCE) -> Column:
    return F.abs(F.coalesce(value, F.lit(0.0))) > tolerance


def _value_material(value, tolerance: str | float = "0.01") -> Column:
    """Beyond the tolerance (a cent unless told otherwise) at report precision."""
    return F.abs(F.round(F.coalesce(value, F.lit(0.0)).cast("decimal(30,8)"), 2)) > F.lit(str(tolerance)).cast("decimal(30,8)")


def product_checks(results: DataFrame, qty_tolerance: float = QTY_TOLERANCE, value_tolerance: str | float = "0.01") -> DataFrame:
    """Eleven control checks per product as rows (product, check, status).

    `results` as made by `stage_batch`: figures of the roll-forward beside what the receipts (`raw_qty`, `raw_val`), the
    layers on hand (`layer_val`) and their order (`unordered`) say on their own.
    """
    rows = results

    def qty_material(value: Column) -> Column:
        return _qty_material(value, qty_tolerance)

    def value_material(value: Column) -> Column:
        return _value_material(value, value_tolerance)

    def fail(condition: Column, bad: str = "FAIL") -> Column:
        return F.when(condition, bad).otherwise("PASS")

    c = F.col
    checks = (
        ("Processing Integrity", fail(c("processing_error").isNotNull())),
        ("Beginning Quantity Agreement", fail(qty_material(c("beg_variance_qty")))),
        ("Estimated Value Effect of Beginning Qty Variance", fail(value_material(c("beg_variance_val")), "REVIEW")),
        ("Receipt Quantity Agreement", fail(qty_material(c("raw_qty") - c("purch_qty")))),
        ("Receipt Value Agreement", fail(value_material(c("raw_val") - c("purch_val")))),
        ("Depletion Quantity Agreement", fail(qty_material(c("depleted_qty") - c("usage_qty")))),
        ("Layer Value Conservation", fail(value_material(c("value_variance")))),
        ("Ending Quantity to Open Layers", fail(qty_material(c("open_qty") - c("ending_qty")))),
        ("Ending Value to Open Layers", fail(value_material(c("layer_val") - c("end_val")))),
        ("FIFO Chronology", fail(F.coalesce(c("unordered"), F.lit(False)))),
        ("Unpriced Layer Count", fail(c("unpriced_layers") > 0, "REVIEW")),
    )
    return rows.select(
        "product",
        F.inline(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status")) for n, s in checks])),
    )


def summary_status(results: DataFrame, qty_tolerance: float = QTY_TOLERANCE, value_tolerance: str | float = "0.01") -> DataFrame:
    """Overall status and message per product, for the executive summary and the exceptions list."""
    c = F.col

    def qty_material(value: Column) -> Column:
        return _qty_material(value, qty_tolerance)

    def value_material(value: Column) -> Column:
        return _value_material(value, value_tolerance)

    def units(value: Column, text: str) -> Column:
        return F.concat(F.format_number(value, 0), F.lit(text))

    reasons = F.array_compact(
        F.array(
            F.when(c("processing_error").isNotNull(), F.concat(F.lit("Processing error: "), c("processing_error"))),
            F.when(c("grid_rows").isNull(), "Alias not found in Master Grid").when(
                c("grid_rows") > 1, "Alias appears more than once in Master Grid"
            ),
            F.when(
                qty_material(c("variance_qty")),
                F.concat(F.lit("Rollforward quantity does not balance ("), units(c("variance_qty"), " unit variance)")),
            ),
            F.when(qty_material(c("open_qty") - c("ending_qty")), "Open layers do not equal ending quantity"),
            F.when(value_material(c("value_variance")), "Layer value rollforward does not conserve"),
            F.when(value_material(c("layer_val") - c("end_val")), "Value of the open layers differs from the ending value"),
            F.when(qty_material(c("unpriced_qty")), units(c("unpriced_qty"), " unit(s) on hand carry no recorded cost")),
            F.when(
                qty_material(c("unpriced_usage_qty")),
                units(c("unpriced_usage_qty"), " depleted unit(s) carried no recorded cost"),
            ),
            F.when(
                qty_material(c("beg_variance_qty")),
                F.concat(F.lit("Beginning quantity differs from Master Grid by "), units(c("beg_variance_qty"), " units")),
            ),
        )
    )
    hard = (
        c("processing_error").isNotNull() | c("grid_rows").isNull() | (c("grid_rows") > 1)
        | qty_material(c("variance_qty")) | qty_material(c("open_qty") - c("ending_qty"))
        | value_material(c("value_variance")) | qty_material(c("beg_variance_qty"))
        | value_material(c("layer_val") - c("end_val"))
    )
    review = qty_material(c("unpriced_qty")) | qty_material(c("unpriced_usage_qty"))
    idle = ~qty_material(c("purch_qty")) & ~qty_material(c("usage_qty")) & ~qty_material(c("beg_qty") - c("ending_qty"))
    empty = ~qty_material(c("ending_qty")) & ~value_material(c("end_val"))
    status = (
        F.when(hard, "FAIL").when(review, "REVIEW").when(idle, "PASS - No Activity")
        .when(empty, "PASS - Zero Balance").otherwise("PASS")
    )
    return results.withColumns({"overall_status": status, "message": F.concat_ws("; ", reasons)})


def control_counts(statuses: DataFrame) -> DataFrame:
    """Products passing, to review and failing."""
    s = F.col("overall_status")
    return statuses.agg(
        F.count_if(s.startswith("PASS")).alias("pass_count"), F.count_if(s.startswith("REVIEW")).alias("review_count"),
        F.count_if(s.startswith("FAIL")).alias("fail_count"),
    )


def executive_summary(statuses: DataFrame) -> DataFrame:
    c = F.col
    return statuses.select(
        "product", "name", c("ending_qty").alias("end_qty"), "end_val", (-c("usage_val")).alias("usage_val"),
        F.when(c("ending_qty") != 0, c("end_val") / c("ending_qty")).alias("cost_on_hand"),
        F.when(c("usage_qty") != 0, c("usage_val") / c("usage_qty")).alias("cost_depleted"),
        "overall_status", "message",
    )


# --- several periods in one pass --------------------------------------------------------------------------------

def allocate_periods(layers: DataFrame, usage: DataFrame) -> DataFrame:
    """Which layer served which period: overlap of cumulative-in intervals of layers and cumulative-out of usage.

    `usage` has product, period_no, usage_qty. The usage intervals of a product are at most one per fiscal period, so
    they travel as a short array; only real overlaps are emitted.
    """
    span = Window.partitionBy("product").orderBy("period_no").rowsBetween(Window.unboundedPreceding, -1)
    out = usage.withColumn("out_lo", F.coalesce(F.sum("usage_qty").over(span), F.lit(0.0)))
    per_product = out.filter("usage_qty > 0").groupBy("product").agg(
        F.collect_list(
            F.struct("period_no", "out_lo", (F.col("out_lo") + F.col("usage_qty")).alias("out_hi"))
        ).alias("periods")
    )
    stacked = running_before(layers, ["product"], "kind", "seq", {"in_lo": F.col("qty")}).drop("_block")
    stacked = stacked.withColumn("in_hi", F.col("in_lo") + F.col("qty"))
    hits = F.filter("periods", lambda p: (p["out_lo"] < F.col("in_hi")) & (F.col("in_lo") < p["out_hi"]))
    # A layer of no quantity serves nobody.
    served = stacked.filter("in_hi > in_lo").join(per_product, "product").withColumn("p", F.explode(hits))
    qty = F.least("in_hi", "p.out_hi") - F.greatest("in_lo", "p.out_lo")
    return served.select(
        "product", "kind", "seq", F.col("p.period_no").alias("period_no"), qty.alias("qty"),
        (F.col("total_value") * (qty / F.col("qty"))).alias("value"),
    )
