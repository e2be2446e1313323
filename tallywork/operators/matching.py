"""Two-ledger matching: unique-on-both-sides joins in tiers, link vetting, exact grouped sums.

Both ledgers travel as one long frame with a `side` column ('A' or 'B'), so "unique on both sides" is one aggregation
with a map-side combine instead of two de-duplications and a join, and a key that holds a third of all rows costs one
partial row per task.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut, join_filled, spread

# Bounds of the grouped search.
MAX_POOL = 20
MAX_GROUP = 8

# Match methods in evidence order: (method, key columns, identifier kinds in the key).
ONE_TO_ONE_TIERS = (
    ("PO + Invoice + Amount", "exact", ("po", "inv")),
    ("PO + Invoice + Amount", "key", ("po", "inv")),
    ("PO + Amount", "exact", ("po",)),
    ("PO + Amount", "key", ("po",)),
    ("Invoice + Amount", "exact", ("inv",)),
    ("Invoice + Amount", "key", ("inv",)),
)
GROUPED_TIERS = (
    ("PO + Invoice + Aggregate Amount (Grouped)", ("po", "inv")),
    ("PO + Aggregate Amount (Grouped)", ("po",)),
    ("Invoice + Aggregate Amount (Grouped)", ("inv",)),
)
CONFIDENCE = {
    "PO + Invoice + Amount": "Strong",
    "PO + Amount": "Moderate",
    "Invoice + Amount": "Strong",
    "PO + Invoice + Aggregate Amount (Grouped)": "Moderate",
    "PO + Aggregate Amount (Grouped)": "Moderate",
    "Invoice + Aggregate Amount (Grouped)": "Moderate",
}
BRIDGE_COLUMNS = ("match_key", "method", "side", "row_id")
# What the one-to-one tiers read of a row, and what all steps of a matching call read.
TIER_COLUMNS = ("side", "row_id", "cents", "key_po", "key_inv", "exact_po", "exact_inv")
MATCH_COLUMNS = (*TIER_COLUMNS, "norm_po", "norm_inv", "words")
FLAGS = ("po_shared", "inv_shared")
# Rows of one amount that a task takes, and hash values by which amounts with more rows are found.
AMOUNT_ROWS = 1 << 20
AMOUNT_SLOTS = 1 << 16


def on_side(side: str, value) -> Column:
    return F.when(F.col("side") == side, value)


def counted(side: str) -> Column:
    return F.sum((F.col("side") == side).cast("bigint"))


def filled(columns: list[str]) -> Column:
    """Every key part present: a blank is never a key."""
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).isNotNull()
        if not name.endswith("cents"):
            out = out & (F.col(name) != "")
    return out


def unique_pairs(both: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Keys held by exactly one row on each side: one row per pair with `a_id`, `b_id` and the carried columns."""
    carried = [
        F.max(on_side(side, F.col(name))).alias(f"{side.lower()}_{name}") for name in carry or [] for side in "AB"
    ]
    return (
        both.filter(filled(keys))
        .groupBy(*keys)
        .agg(
            counted("A").alias("n_a"), counted("B").alias("n_b"),
            F.max(on_side("A", F.col("row_id"))).alias("a_id"), F.max(on_side("B", F.col("row_id"))).alias("b_id"),
            *carried,
        )
        .filter("n_a = 1 AND n_b = 1")
        .drop("n_a", "n_b")
    )


def with_link_flags(rows: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Adds `po_shared` / `inv_shared`: the row's specific reference also exists on the other side's whole frame (`whole`, if `rows`
    are only some of its rows)."""
    out, whole = rows, rows if whole is None else whole
    for kind in ("po", "inv"):
        key = f"key_{kind}"
        shared = (
            whole.filter(F.col(key) != "").groupBy(key).agg(counted("A").alias("n_a"), counted("B").alias("n_b"))
            .filter("n_a > 0 AND n_b > 0").select(key, F.lit(True).alias(f"{kind}_shared"))
        )
        out = join_filled(out, shared, [key], "row_id").withColumn(f"{kind}_shared", F.coalesce(f"{kind}_shared", F.lit(False)))
    return out


def link_status(kind: str) -> Column:
    """CLEAN, DISCREPANCY or CONFLICT for an identifier that was not the key of a one-to-one pair."""
    a, b = F.col(f"a_key_{kind}"), F.col(f"b_key_{kind}")
    differs = (a != "") & (b != "") & (a != b)
    points_away = F.col(f"a_{kind}_shared") | F.col(f"b_{kind}_shared")
    return F.when(differs & points_away, "CONFLICT").when(differs, "DISCREPANCY").otherwise("CLEAN")


def tier_pairs(both: DataFrame, form: str, kinds: tuple[str, ...]) -> DataFrame:
    """Proposed pairs of one tier with their link status."""
    keys = [f"{form}_{kind}" for kind in kinds] + ["cents"]
    other = [kind for kind in ("po", "inv") if kind not in kinds]
    carry = [name for kind in other for name in (f"key_{kind}", f"{kind}_shared")]
    pairs = unique_pairs(both, keys, carry)
    status = link_status(other[0]) if other else F.lit("CLEAN")
    return pairs.select("a_id", "b_id", status.alias("link"))


def as_bridge(pairs: DataFrame, method: str) -> DataFrame:
    sides = F.array(
        F.struct(F.lit("A").alias("side"), F.col("a_id").alias("row_id")),
        F.struct(F.lit("B").alias("side"), F.col("b_id").alias("row_id")),
    )
    return pairs.select(F.col("a_id").alias("match_key"), F.lit(method).alias("method"), F.inline(sides))


def consume(open_rows: DataFrame, bridge: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Label the rows a bridge takes, write once, and split into (taken, still open)."""
    taken = bridge.select("side", "row_id", "match_key", "method")
    labelled = cut(open_rows.join(taken, ["side", "row_id"], "left"), name, compression="zstd")
    return (
        labelled.filter("match_key IS NOT NULL").select(*BRIDGE_COLUMNS),
        labelled.filter("match_key IS NULL").drop("match_key", "method"),
    )


def consume_pairs(open_rows: DataFrame, pairs: DataFrame, method: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Like `consume` for one tier of proposals, which also yields the refused ones: (taken, refused, still open)."""
    sides = F.array(
        F.struct(F.lit("A").alias("side"), F.col("a_id").alias("row_id"), F.col("b_id").alias("_other")),
        F.struct(F.lit("B").alias("side"), F.col("b_id").alias("row_id"), F.col("a_id").alias("_other")),
    )
    proposed = pairs.select(F.col("a_id").alias("_key"), F.col("link").alias("_link"), F.inline(sides))
    gone = F.col("_link") != "CONFLICT"
    labelled = open_rows.join(proposed, ["side", "row_id"], "left").withColumns(
        # Of a taken row only its ids are read again.
        {c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)) for c in open_rows.columns if c not in ("side", "row_id")}
    )
    labelled = cut(labelled, name, compression="zstd")
    taken = labelled.filter("_link <> 'CONFLICT'").select(F.col("_key").alias("match_key"), F.lit(method).alias("method"), "side", "row_id")
    refused = labelled.filter("_link = 'CONFLICT' AND side = 'A'").select(
        F.col("row_id").alias("a_id"), F.col("_other").alias("b_id"), F.lit(method).alias("method")
    )
    return taken, refused, labelled.filter("_link IS NULL OR _link = 'CONFLICT'").drop("_key", "_link", "_other")


def crowded_amounts(rows: DataFrame, most: int) -> tuple[list[int], list[int]]:
    """Amounts that more than `most` rows hold: (those of one side, those of both). Rows are counted by hash first, so that
    amounts are counted one by one only where a hash holds that many rows; there are at most rows / `most` of them."""
    known = rows.filter("cents IS NOT NULL").select("side", "cents", F.pmod(F.xxhash64("cents"), F.lit(AMOUNT_SLOTS)).alias("slot"))
    slots = [r["slot"] for r in known.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()]
    if not slots:
        return [], []
    sides = known.filter(F.col("slot").isin(slots)).groupBy("cents").agg(counted("A").alias("n_a"), counted("B").alias("n_b"))
    found = sides.filter(F.col("n_a") + F.col("n_b") > most).collect()
    return [r["cents"] for r in found if not r["n_a"] or not r["n_b"]], [r["cents"] for r in found if r["n_a"] and r["n_b"]]


def match_one_to_one(both: DataFrame, amount_rows: int = AMOUNT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The six one-to-one tiers. Returns (bridge, refused proposals, rows still open with link flags).

    A proposal whose other identifier points at another record is refused: it consumes nothing and is kept as evidence.
    The tiers move `TIER_COLUMNS` only. Link flags that `both` lacks are looked up for the rows that the tiers of both
    identifiers leave open, as no earlier tier reads them.

    The amount is part of every key, so rows are brought together by amount once and pass tier after tier where they are. Amounts
    that more than `amount_rows` rows of both sides hold are matched by aggregates, in which no task holds an amount.
    """
    given = all(name in both.columns for name in FLAGS)
    narrow = both.select(*TIER_COLUMNS, *(FLAGS if given else ()))
    lone, crowded = crowded_amounts(narrow, amount_rows)
    if crowded:
        apart = F.coalesce(F.col("cents").isin(crowded), F.lit(False))
        parts = [_tiers_by_amount(narrow.filter(~apart), narrow, given, lone), _tiers_by_aggregates(narrow.filter(apart), narrow, given)]
    else:
        parts = [_tiers_by_amount(narrow, narrow, given, lone)]
    bridge, refused, open_rows = (union_all(list(frames)) for frames in zip(*parts))
    return bridge, refused.distinct(), _whole_rows(both, bridge, open_rows)


def _tiers_by_amount(rows: DataFrame, whole: DataFrame, flagged: bool, lone: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tiers with one exchange by amount before the tiers of both identifiers and one before the others (one for all, if
    `rows` are `flagged`). `lone` are crowded amounts of one side, which no tier can match."""
    steps = list(enumerate(ONE_TO_ONE_TIERS, 1))
    calls = [steps] if flagged else [[s for s in steps if len(s[1][2]) == 2], [s for s in steps if len(s[1][2]) == 1]]
    open_rows, bridges, refused = rows, [], []
    methods = F.array(*[F.lit(method) for method, _, _ in ONE_TO_ONE_TIERS])
    for number, tiers in enumerate(calls):
        if number:
            open_rows = with_link_flags(open_rows, whole)
        labelled = cut(_settled(open_rows, tiers, lone), f"tiers{tiers[0][0]}", compression="zstd")
        taken = labelled.filter("_tier IS NOT NULL")
        bridges.append(taken.select(F.col("_key").alias("match_key"), F.element_at(methods, F.col("_tier")).alias("method"), "side", "row_id"))
        for n, (method, _, kinds) in tiers:
            if len(kinds) == 1:
                against = labelled.filter(f"_against{n} IS NOT NULL")
                refused.append(against.select(F.col("row_id").alias("a_id"), F.col(f"_against{n}.b_id").alias("b_id"), F.lit(method).alias("method")))
        open_rows = labelled.filter("_tier IS NULL").select(*open_rows.columns)
    return union_all(bridges), union_all(refused), open_rows


def _settled(rows: DataFrame, tiers: list[tuple], lone: list[int]) -> DataFrame:
    """`rows` after some tiers: `_tier` and `_key` (the A row of the pair) of taken rows, of which only the ids are kept, and
    `_against<tier>` (the B row) of A rows whose proposal was refused."""
    known = F.lit(False)
    for name in ("key_po", "key_inv", "exact_po", "exact_inv"):
        known = known | F.coalesce(F.col(name) != "", F.lit(False))
    able = F.col("cents").isNotNull() & known & (~F.col("cents").isin(lone) if lone else F.lit(True))
    # Rows that no tier can use are spread by row in place of their amount.
    amount = F.when(able, F.col("cents")).otherwise(F.xxhash64("row_id", "key_po", "key_inv"))
    out = rows.withColumn("_amount", amount).repartition("_amount").withColumns(
        {"_tier": F.lit(None).cast("int"), "_key": F.lit(None).cast("bigint")}
    )
    for number, (_, form, kinds) in tiers:
        keys = [f"{form}_{kind}" for kind in kinds]
        other = [kind for kind in ("po", "inv") if kind not in kinds]
        usable = F.col("_tier").isNull() & (F.col("_amount") == F.col("cents")) & filled([*keys, "cents"])
        same = Window.partitionBy("_amount", *keys)
        facts = {}
        for side in "AB":
            mine, name = usable & (F.col("side") == side), side.lower()
            facts[f"{name}_n"] = F.count(F.when(mine, 1)).over(same)
            carry = {"id": "row_id"} | {x: x for kind in other for x in (f"key_{kind}", f"{kind}_shared")}
            facts |= {f"{name}_{to}": F.max(F.when(mine, F.col(x))).over(same) for to, x in carry.items()}
        status = link_status(other[0]) if other else F.lit("CLEAN")
        pair = usable & (F.col("a_n") == 1) & (F.col("b_n") == 1) & F.col("row_id").isNotNull()
        taken = pair & (status != "CONFLICT")
        labels = {
            "_tier": F.when(taken, F.lit(number)).otherwise(F.col("_tier")), "_key": F.when(taken, F.col("a_id")).otherwise(F.col("_key")),
        }
        if other:
            labels[f"_against{number}"] = F.when(pair & (status == "CONFLICT") & (F.col("side") == "A"), F.struct(F.col("b_id").alias("b_id")))
        out = out.withColumns(facts).withColumns(labels).drop(*facts)
    kept = [c for c in rows.columns if c not in ("side", "row_id")]
    return out.withColumns({c: F.when(F.col("_tier").isNull(), F.col(c)) for c in kept}).drop("_amount")


def _tiers_by_aggregates(rows: DataFrame, whole: DataFrame, flagged: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tiers with one aggregate and one join each: a key of any size costs one partial row per task."""
    open_rows, bridges, refused = rows, [], []
    for number, (method, form, kinds) in enumerate(ONE_TO_ONE_TIERS, 1):
        if len(kinds) == 1 and not flagged:
            open_rows, flagged = cut(with_link_flags(open_rows, whole), "flagged", compression="zstd"), True
        taken, against, open_rows = consume_pairs(open_rows, tier_pairs(open_rows, form, kinds), method, f"tier{number}")
        bridges.append(taken)
        if len(kinds) == 1:
            refused.append(against)
    return union_all(bridges), union_all(refused), open_rows


def _whole_rows(both: DataFrame, bridge: DataFrame, open_rows: DataFrame) -> DataFrame:
    """The rows of `both` that `bridge` leaves open, with all their columns and the link flags of `open_rows`."""
    if set(both.columns) <= set(open_rows.columns):
        return open_rows
    out = both.join(bridge.select("side", "row_id"), ["side", "row_id"], "left_anti")
    for flag, key in zip(FLAGS, ("key_po", "key_inv")):
        if flag not in both.columns:
            shared = open_rows.filter(flag).select(key, flag).distinct()
            out = join_filled(out, shared, [key], "row_id").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- grouped sums -----------------------------------------------------------------------------------------------

# Rows per slice when the large side of a key is searched for reachable sums before the key is solved.
SLICE_ROWS = 50_000
# Rows of solutions handed back to Spark at a time.
OUT_ROWS = 10_000
_SOLVED = "match_key bigint, proposal int, side string, row_id bigint, link string"


def subset_sums(cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and size of every subset of at most MAX_POOL amounts; the subset is the bits of its place in the array."""
    sums, sizes = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int8)
    for value in cents:
        sums = np.concatenate([sums, sums + value])
        sizes = np.concatenate([sizes, sizes + np.int8(1)])
    return sums, sizes


def two_solutions(cents: np.ndarray, targets: np.ndarray, pool: int = MAX_POOL) -> dict[int, list[int]]:
    """Up to two subsets of 2 to MAX_GROUP rows per target amount, as bit masks.

    Smaller subsets come first; among equal sizes, the one that finishes earliest in source order, which is the
    numeric order of the masks. Two are enough to tell a unique solution from an ambiguous one.
    """
    if not 2 <= len(cents) <= pool or not len(targets):
        return {}
    sums, sizes = subset_sums(cents)
    usable = (sizes >= 2) & (sizes <= MAX_GROUP) & np.isin(sums, targets)
    masks = np.flatnonzero(usable)
    found: dict[int, list[int]] = {}
    for mask in masks[np.lexsort((masks, sizes[masks]))]:
        picked = found.setdefault(int(sums[mask]), [])
        if len(picked) < 2:
            picked.append(int(mask))
    return found


def _vet(rows: list, kinds: list[str]) -> str:
    """Link status of a proposed group: `rows` are (side, other-kind values and flags) records."""
    status = "CLEAN"
    for kind in kinds:
        a = {r[f"key_{kind}"] for r in rows if r["side"] == "A"} - {""}
        b = {r[f"key_{kind}"] for r in rows if r["side"] == "B"} - {""}
        if a and b and not a & b:
            if any(r[f"{kind}_shared"] and r[f"key_{kind}"] for r in rows):
                return "CONFLICT"
            status = "DISCREPANCY"
    return status


def _solve_key(records: list[dict], other_kinds: list[str], pool: int) -> list[tuple]:
    """Settle one key: propose, keep proposals no other proposal touches, repeat until none is left. `records` come by side and row."""
    # A row of a large side stands for `copies` rows of one amount. Two copies already block each other, so more
    # need not be tried, and such a side is over the pool bound for good.
    open_rows = {(r["side"], r["row_id"]): r for r in records}
    out, refused, number = [], set(), 0
    while True:
        pools = {s: [r for r in open_rows.values() if r["side"] == s] for s in "AB"}
        proposals: set[tuple] = set()
        for many, one in (("A", "B"), ("B", "A")):
            if not 2 <= len(pools[many]) <= pool or any(r["over_pool"] for r in pools[many]):
                continue
            found = two_solutions(
                np.array([r["cents"] for r in pools[many]], dtype=np.int64),
                np.unique(np.array([r["cents"] for r in pools[one]], dtype=np.int64)), pool,
            )
            for single in pools[one]:
                for mask in found.get(single["cents"], []):
                    group = tuple(r["row_id"] for bit, r in enumerate(pools[many]) if mask >> bit & 1)
                    for copy in range(min(single["copies"], 2)):
                        proposals.add((many, group, one, single["row_id"], copy))
        claims: dict[tuple, int] = {}
        for many, group, one, single, copy in proposals:
            for row in [(many, r, 0) for r in group] + [(one, single, copy)]:
                claims[row] = claims.get(row, 0) + 1
        progressed = False
        for proposal in sorted(proposals):
            many, group, one, single, copy = proposal
            members = [(many, r) for r in group] + [(one, single)]
            if proposal in refused or any(claims[(*m, 0)] > 1 for m in members[:-1]) or claims[
                (one, single, copy)
            ] > 1:
                continue
            link = _vet([open_rows[m] for m in members], other_kinds)
            match_key = min(r for s, r in members if s == "A")
            number += 1
            out += [(match_key, number, s, r, link) for s, r in members]
            if link == "CONFLICT":
                refused.add(proposal)
                continue
            for member in members:
                del open_rows[member]
            progressed = True
        if not progressed:
            return out


def _solve_keys(keys: list[str], other_kinds: list[str], pool: int):
    """A function that settles the keys of a partition sorted by key, side and row, one after the other: it holds the rows of one
    key and a batch, whatever the number of keys."""

    def solve(batches):
        schema = pa.schema([("match_key", pa.int64()), ("proposal", pa.int32()), ("side", pa.string()), ("row_id", pa.int64()), ("link", pa.string())])
        rows = (row for batch in batches for row in batch.to_pylist())
        out: list[tuple] = []

        def written() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in schema]
            return pa.record_batch([pa.array(values, field.type, from_pandas=True) for values, field in zip(columns, schema)], schema=schema)

        for _, same_key in groupby(rows, itemgetter(*keys)):
            records = list(same_key)
            for record in records:
                if record["row_id"] is None:
                    record["row_id"] = float("nan")  # a row of its own, as no two of them are equal
            out += _solve_key(records, other_kinds, pool)
            if len(out) >= OUT_ROWS:
                yield written()
                out = []
        yield written()

    return solve


def _reachable(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one slice whose amount some subset of the key's small pool can reach."""
    pool = pdf[pdf["small"]].sort_values("row_id")
    rest = pdf[~pdf["small"]]
    sums, sizes = subset_sums(pool["cents"].to_numpy(dtype=np.int64))
    hits = np.isin(rest["cents"].to_numpy(dtype=np.int64), sums[(sizes >= 2) & (sizes <= MAX_GROUP)])
    return rest[hits]


def match_grouped(open_rows: DataFrame, kinds: tuple[str, ...], pool_rows: int = MAX_POOL) -> DataFrame:
    """Exact 1:n and n:1 groups inside one key. CONFLICT groups take nothing.

    Only keys whose pool is within `pool_rows` on a side can hold a group, by the rule (`unsearched_rows` names the others), so other keys never leave their task. Where one
    side is within the bound and the other is large, the large side is first cut down, slice by slice, to the distinct
    amounts the small pool can reach: at most one row per subset, whatever the size of the key.
    """
    keys = [f"key_{kind}" for kind in kinds]
    other = [kind for kind in ("po", "inv") if kind not in kinds]
    carry = [name for kind in other for name in (f"key_{kind}", f"{kind}_shared")]
    usable = open_rows.filter(filled([*keys, "cents"])).select(*keys, "side", "row_id", "cents", *carry)
    sizes = (
        usable.groupBy(*keys).agg(
            counted("A").alias("n_a"), counted("B").alias("n_b"),
            *[fn(on_side(side, F.col("cents"))).alias(f"{name}_{side.lower()}")
              for side in "AB" for name, fn in (("total", F.sum), ("low", F.min), ("high", F.max))],
        )
        .filter(f"n_a > 0 AND n_b > 0 AND n_a + n_b > 2 AND (n_a BETWEEN 2 AND {pool_rows} OR n_b BETWEEN 2 AND {pool_rows})")
        # The only group of a two-row pool is the pair itself, so most keys are settled here.
        .filter(
            "n_a > 2 OR n_b > 2 OR (n_a = 2 AND total_a IN (low_b, high_b)) OR (n_b = 2 AND total_b IN (low_a, high_a))"
        )
        .select(*keys, "n_a", "n_b")
    )
    rows = usable.join(sizes, keys)
    # At most half of a full pool can be consumed as single rows, so a side above this bound never comes back under it.
    bound = pool_rows + pool_rows // 2
    large = F.when(F.col("n_a") > bound, "A").when(F.col("n_b") > bound, "B")
    rows = cut(rows.withColumn("large", large), "pools-" + "-".join(kinds))
    plain = rows.filter("large IS NULL")

    hot = rows.filter("large IS NOT NULL")
    small_side = hot.filter("side <> large")
    by_amount = (
        hot.filter("side = large").groupBy(*keys, "side", "cents")
        .agg(
            F.min("row_id").alias("row_id"), F.count("*").alias("copies"),
            *[F.max(name).alias(name) for name in carry],
        )
        .withColumn("slice", F.pmod(F.xxhash64("cents"), F.lit(1 << 16)))
    )
    slices = by_amount.groupBy(*keys).agg(F.count("*").alias("amounts"))
    wide = F.greatest(F.lit(1), F.ceil(F.col("amounts") / SLICE_ROWS)).cast("bigint")
    sliced = by_amount.join(slices, keys).withColumn("slice", F.pmod("slice", wide))
    pool = small_side.join(slices, keys).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), wide - 1)))
    shape = [*keys, "slice", "side", "row_id", "cents", "copies", *carry, "small"]
    searched = sliced.withColumn("small", F.lit(False)).select(*shape).unionByName(
        pool.withColumns({"small": F.lit(True), "copies": F.lit(1).cast("bigint")}).select(*shape)
    )
    reached = spread(searched, [*keys, "slice"]).groupBy(*keys, "slice").applyInPandas(_reachable, searched.schema)
    columns = [*keys, "side", "row_id", "cents", *carry]
    single, closed = F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("over_pool")
    candidates = union_all([
        plain.select(*columns, single, F.lit(False).alias("over_pool")),
        small_side.select(*columns, single, F.lit(False).alias("over_pool")),
        reached.select(*columns, "copies", closed),
    ])
    # Keys are settled in a row within a task, as a call of Python for each key costs more than the key: most hold three rows.
    ordered = spread(candidates, keys).sortWithinPartitions(*keys, "side", F.asc_nulls_last("row_id"))
    return ordered.mapInArrow(_solve_keys(keys, other, pool_rows), _SOLVED)


OVER_POOL = "POOL_OVER_BOUND: the key has more open rows on this side than a search for their sums takes."


def unsearched_rows(open_rows: DataFrame, pool_rows: int = MAX_POOL) -> DataFrame:
    """(method, side, row_id, pool, reason): rows whose sums no tier looks for, because their key holds more than `pool_rows` of
    them on their side while the other side has rows too. One row for each tier that leaves a row out."""
    out = []
    for method, kinds in GROUPED_TIERS:
        keys = [f"key_{kind}" for kind in kinds]
        usable = open_rows.filter(filled([*keys, "cents"])).select(*keys, "side", "row_id")
        sizes = usable.groupBy(*keys).agg(counted("A").alias("n_a"), counted("B").alias("n_b"))
        sizes = sizes.filter(f"n_a > 0 AND n_b > 0 AND greatest(n_a, n_b) > {pool_rows}")
        mine = F.when(F.col("side") == "A", F.col("n_a")).otherwise(F.col("n_b"))
        out.append(usable.join(sizes, keys).withColumn("pool", mine).filter(F.col("pool") > pool_rows).select(
            F.lit(method).alias("method"), "side", "row_id", "pool", F.lit(OVER_POOL).alias("reason")))
    return union_all(out)


def search_control(open_rows: DataFrame, pool_rows: int = MAX_POOL) -> DataFrame:
    """(check, status, n): one line a tier and side, REVIEW where rows were left out of the search for sums."""
    names = open_rows.sparkSession.createDataFrame([(m, s) for m, _ in GROUPED_TIERS for s in "AB"], "method string, side string")
    left = unsearched_rows(open_rows, pool_rows).groupBy("method", "side").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return names.join(left, ["method", "side"], "left").select(
        F.concat(F.lit("Sums of "), "side", F.lit(" rows searched: "), "method").alias("check"),
        F.when(n == 0, "PASS").otherwise("REVIEW").alias("status"), n.alias("n"),
    )


def match_grouped_tiers(open_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three grouped tiers, in order. Returns (bridge, refused proposals, rows still open)."""
    bridges, refused = [], []
    for number, (method, kinds) in enumerate(GROUPED_TIERS, 1):
        solved = cut(match_grouped(open_rows, kinds), f"groups{number}")
        bridge = solved.filter("link <> 'CONFLICT'").select("match_key", F.lit(method).alias("method"), "side", "row_id")
        taken, open_rows = consume(open_rows, bridge, f"grouped{number}")
        bridges.append(taken)
        against = solved.filter("link = 'CONFLICT'")
        refused.append(
            against.filter("side = 'A'").select("match_key", "proposal", F.col("row_id").alias("a_id")).join(
                against.filter("side = 'B'").select("match_key", "proposal", F.col("row_id").alias("b_id")),
                ["match_key", "proposal"],
            ).select("a_id", "b_id", F.lit(method).alias("method"))
        )
    return union_all(bridges), union_all(refused).distinct(), open_rows
