import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallywork.operators import matching as m, words

SCHEMA = "side string, row_id bigint, exact_po string, exact_inv string, key_po string, key_inv string, cents bigint, words array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(side, n, po, inv, cents, exact_po=None, exact_inv=None, w=()):
    return (side, n, exact_po if exact_po is not None else po, exact_inv if exact_inv is not None else inv, po, inv, cents, list(w))


def link(rows, members, kinds):
    state = "CLEAN"
    for column, kind in ((4, "po"), (5, "inv")):
        if kind in kinds:
            continue
        a = {r[column] for r in members if r[0] == "A"} - {""}
        b = {r[column] for r in members if r[0] == "B"} - {""}
        if a and b and not a & b:
            if a & {r[column] for r in rows if r[0] == "B"} or b & {r[column] for r in rows if r[0] == "A"}:
                return "CONFLICT"
            state = "DISCREPANCY"
    return state


def brute_one_to_one(rows):
    left, out = list(rows), set()
    place = {("exact", "po"): 2, ("exact", "inv"): 3, ("key", "po"): 4, ("key", "inv"): 5}
    for method, form, kinds in m.ONE_TO_ONE_TIERS:
        def key(r):
            parts = tuple(r[place[form, k]] for k in kinds)
            return None if "" in parts or r[6] is None else (*parts, r[6])

        counts = Counter((r[0], key(r)) for r in left)
        taken = []
        for a in [r for r in left if r[0] == "A" and key(r)]:
            if counts["A", key(a)] == 1 and counts["B", key(a)] == 1:
                b = next(r for r in left if r[0] == "B" and key(r) == key(a))
                if link(rows, [a, b], kinds) != "CONFLICT":
                    taken += [a, b]
                    out.add((a[1], b[1], method))
        left = [r for r in left if r not in taken]
    return out, left


def brute_grouped(rows, left):
    out = set()
    for method, kinds in m.GROUPED_TIERS:
        columns = [4 if k == "po" else 5 for k in kinds]
        while True:
            pools = {}
            for r in left:
                key = tuple(r[c] for c in columns)
                if "" not in key and r[6] is not None:
                    pools.setdefault(key, {"A": [], "B": []})[r[0]].append(r)
            proposals = []
            for pool in pools.values():
                for many, one in (("A", "B"), ("B", "A")):
                    if not 2 <= len(pool[many]) <= m.MAX_POOL:
                        continue
                    rows_in = sorted(pool[many], key=lambda r: r[1])
                    for single in pool[one]:
                        found = []
                        for size in range(2, m.MAX_GROUP + 1):
                            hits = [c for c in combinations(rows_in, size) if sum(r[6] for r in c) == single[6]]
                            found += sorted(hits, key=lambda c: [r[1] for r in reversed(c)])
                        proposals += [(c, single) for c in found[:2]]
            uses = Counter(r[:2] for c, s in proposals for r in (*c, s))
            good = [(c, s) for c, s in proposals if all(uses[r[:2]] == 1 for r in (*c, s)) and link(rows, [*c, s], kinds) != "CONFLICT"]
            if not good:
                break
            for c, s in good:
                out.add((method, frozenset(r[:2] for r in (*c, s))))
                left = [r for r in left if r not in (*c, s)]
    return out


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for side in "AB":
        for k in range(n):
            po = rng.choice(["", "P1", "P2", "P3", "P4", f"P{rng.randrange(30)}"])
            inv = rng.choice(["", "I1", "I2", f"I{rng.randrange(30)}"])
            punct = rng.choice(["", "-"])
            rows.append(row(side, k, po, inv, rng.choice([None, 100, 200, 300, 500, rng.randrange(1, 9) * 100]), po and po + punct, inv))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_tiers_and_groups_agree_with_brute_force(spark, seed):
    rows = random_rows(seed)
    shuffled = rows[:]
    random.Random(seed + 99).shuffle(shuffled)
    flagged = m.with_link_flags(frame(spark, shuffled))
    bridge, _, open_rows = m.match_one_to_one(flagged)
    want, left = brute_one_to_one(rows)
    got = {}
    for r in bridge.collect():
        got.setdefault((r["match_key"], r["method"]), {})[r["side"]] = r["row_id"]
    assert {(v["A"], v["B"], k[1]) for k, v in got.items()} == want
    grouped, _, _ = m.match_grouped_tiers(open_rows)
    sets = {}
    for r in grouped.collect():
        sets.setdefault((r["match_key"], r["method"]), set()).add((r["side"], r["row_id"]))
    assert {(k[1], frozenset(v)) for k, v in sets.items()} == brute_grouped(rows, left)


def test_ambiguous_keys_never_pair(spark):
    rows = [row("A", 1, "P1", "", 100), row("A", 2, "P1", "", 100), row("B", 1, "P1", "", 100)]
    assert m.match_one_to_one(m.with_link_flags(frame(spark, rows)))[0].count() == 0


def test_conflicting_links_refuse_and_consume_nothing(spark):
    rows = [row("A", 1, "P1", "I1", 100), row("B", 1, "P1", "I2", 100), row("B", 2, "P9", "I1", 700)]
    bridge, refused, open_rows = m.match_one_to_one(m.with_link_flags(frame(spark, rows)))
    assert bridge.count() == 0 and open_rows.count() == 3
    assert [(r["a_id"], r["b_id"]) for r in refused.collect()] == [(1, 1)]


def test_hot_key_with_a_small_pool_is_searched_exactly(spark):
    """One side far over the pool bound: only amounts the small pool can reach matter, and copies block."""
    rows = [row("A", 1, "P1", "", 100), row("A", 2, "P1", "", 250), row("A", 3, "P1", "", 1000)]
    rows += [row("B", n, "P1", "", 7_000_000 + n) for n in range(200)]
    rows += [row("B", 500, "P1", "", 350), row("B", 501, "P1", "", 1100), row("B", 502, "P1", "", 1100)]
    old = m.SLICE_ROWS
    m.SLICE_ROWS = 50
    try:
        got = m.match_grouped(m.with_link_flags(frame(spark, rows)), ("po",)).collect()
    finally:
        m.SLICE_ROWS = old
    # 100 + 250 = 350 shares row 1 with 100 + 1000 = 1100 (twice), so nothing may be accepted.
    assert got == []
    got = m.match_grouped(m.with_link_flags(frame(spark, [r for r in rows if r[1] not in (501, 502)])), ("po",)).collect()
    assert {(r["side"], r["row_id"]) for r in got} == {("A", 1), ("A", 2), ("B", 500)}


def test_two_solutions_prefers_small_then_early():
    import numpy as np

    found = m.two_solutions(np.array([1, 2, 3, 4, 5]), np.array([5, 15]))
    assert found[5] == [0b00110, 0b01001]      # 2+3 ends before 1+4; both have two rows
    assert found[15] == [0b11111]


def brute_containment(a_rows, b_rows):
    def fits(x, y):
        s, big = sorted((set(x), set(y)), key=len)
        shared = s & big
        return len(shared) == len(s) and (len(shared) > 1 or len(next(iter(shared))) >= 6)

    edges = [(a, b) for a in a_rows for b in b_rows if a[6] is not None and b[6] is not None and a[7] and b[7] and fits(a[7], b[7])]
    near = {}
    for a, b in edges:
        near.setdefault(a[:2], []).append(b)
        near.setdefault(b[:2], []).append(a)
    seen, out = set(), set()
    for a, _ in edges:
        if a[:2] in seen:
            continue
        stack, part = [a], {}
        while stack:
            r = stack.pop()
            if r[:2] in part:
                continue
            part[r[:2]] = r
            stack += near[r[:2]]
        seen |= set(part)
        qa, qb = [r for k, r in part.items() if k[0] == "A"], [r for k, r in part.items() if k[0] == "B"]
        if min(len(qa), len(qb)) > 1 or max(len(qa), len(qb)) > 8:
            continue
        if sum(r[6] for r in qa) == sum(r[6] for r in qb):
            out.add(frozenset(part))
            continue
        single, many = (qa[0], qb) if len(qa) == 1 else (qb[0], qa)
        ties = [r for r in many if r[6] == single[6]]
        if len(many) > 1 and len(ties) == 1:
            out.add(frozenset([single[:2], ties[0][:2]]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_containment_groups_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["HOPPER", "DAVID", "YARD", "MILLER", "STATION", "CARTER", "EAST", "WEST", "GARDNER", "BAXTER", "POTTERS", "DALTON"]
    rows = [
        row(side, n, "", "", rng.choice([None, 100, 200, 300]), w=sorted(set(rng.choices(names, k=rng.choice([1, 1, 2, 3])))))
        for side in "AB" for n in range(14)
    ]
    got = {}
    for r in words.match_contained(frame(spark, rows)).collect():
        got.setdefault(r["match_key"], set()).add((r["side"], r["row_id"]))
    want = brute_containment([r for r in rows if r[0] == "A"], [r for r in rows if r[0] == "B"])
    assert {frozenset(v) for v in got.values()} == want


def test_alias_groups(spark):
    rows = [row("A", 1, "", "", 300, w=["HOPPER"]), row("B", 1, "", "", 100, w=["DAVID"]), row("B", 2, "", "", 200, w=["DAVID", "EAST"]), row("B", 3, "", "", 9, w=["OTHER"])]
    aliases = spark.createDataFrame([("ALIAS-0001", ["HOPPER", "DAVID"], True), ("ALIAS-0002", ["OTHER", "NOBODY"], False)], "alias_id string, terms array<string>, active boolean")
    got = words.match_aliases(frame(spark, rows), aliases).collect()
    assert {(r["side"], r["row_id"]) for r in got} == {("A", 1), ("B", 1), ("B", 2)}
    grown = words.new_alias(aliases, ["miller", "Potter "], "Miller", "J", "2026-01-05", "same party")
    assert grown.filter("alias_id = 'ALIAS-0003'").first()["terms"] == ["MILLER", "POTTER"]
    with pytest.raises(ValueError):
        words.new_alias(aliases, ["one"], "x", "J", "2026-01-05", "y")


def test_controlled_typos(spark):
    rows = [
        row("A", 1, "", "", 100, w=["ELIOT", "SMITH"]), row("B", 1, "", "", 100, w=["ELLIOT", "SMITH"]),
        row("A", 2, "", "", 200, w=["HOPPER"]), row("B", 2, "", "", 200, w=["HOOPER"]),          # lone substitution
        row("A", 3, "", "", 300, w=["SHOPPER"]), row("B", 3, "", "", 300, w=["HOPPER"]),          # first letter
        row("A", 4, "", "", 400, w=["BAXTER"]), row("B", 4, "", "", 400, w=["BAXTERS"]), row("B", 5, "", "", 400, w=["BAXTR"]),
        row("A", 6, "", "", 500, w=["CARTER", "EAST"]), row("B", 6, "", "", 500, w=["CARTAR", "EAST", "YARD"]),
    ]
    accepted, review = words.match_typos(frame(spark, rows))
    assert {(r["a_id"], r["b_id"], r["a_word"], r["b_word"]) for r in accepted.collect()} == {(1, 1, "ELIOT", "ELLIOT"), (6, 6, "CARTER", "CARTAR")}
    assert {(r["row_id"], r["typo_candidates"]) for r in review.collect()} == {(4, 2)}


def test_numbering_is_global_and_gap_free(spark):
    from tallywork.runtime import numbered

    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    rows = numbered(df, ["v", "id"], "place").orderBy("v", "id").collect()
    assert [r["place"] for r in rows] == list(range(1, 1001))


def test_rows_beyond_the_pool_bound_are_named(spark):
    rows = [row("A", k, "P1", "", 100 + k) for k in range(25)] + [row("B", 1, "P1", "", 201), row("B", 2, "P2", "I1", 5), row("A", 90, "P2", "I1", 6)]
    flagged = m.with_link_flags(frame(spark, rows))
    got = {(r.method, r.side, r.row_id, r.pool) for r in m.unsearched_rows(flagged).collect()}
    assert got == {("PO + Aggregate Amount (Grouped)", "A", k, 25) for k in range(25)}
    control = {(r.check, r.status, r.n) for r in m.search_control(flagged).collect()}
    assert ("Sums of A rows searched: PO + Aggregate Amount (Grouped)", "REVIEW", 25) in control and sum(s == "REVIEW" for _, s, _ in control) == 1
    assert m.unsearched_rows(flagged, 25).collect() == []


def test_a_word_in_a_third_of_all_rows_is_one_degree(spark):
    """One A row names a word that 3,000 B sets hold: nothing but its degree is kept, and small stars beside it are settled."""
    rows = [row("A", 1, "", "", 10, w=["COMMON"])] + [row("B", k, "", "", 10, w=["COMMON", f"X{'ABCDEFGHIJ'[k % 10]}{k}"]) for k in range(3000)]
    rows += [row("A", 5000, "", "", 30, w=["HARBOR"]), row("B", 5001, "", "", 10, w=["HARBOR", "NORTH"]), row("B", 5002, "", "", 20, w=["HARBOR", "SOUTH"])]
    got = {(r.side, r.row_id, r.match_key) for r in words.match_contained(frame(spark, rows)).collect()}
    assert got == {("A", 5000, 5000), ("B", 5001, 5000), ("B", 5002, 5000)}


def test_a_leaf_of_two_centres_spoils_the_star(spark):
    """A set with two neighbours is no leaf, so a centre that touches it is no star even if its other leaves add up."""
    rows = [row("A", 1, "", "", 30, w=["HARBOR"]), row("A", 2, "", "", 5, w=["NORTHERN"]), row("B", 1, "", "", 30, w=["HARBOR", "WEST"]),
            row("B", 2, "", "", 9, w=["HARBOR", "NORTHERN"])]
    assert words.match_contained(frame(spark, rows)).collect() == []


@pytest.mark.parametrize("amount_rows", [m.AMOUNT_ROWS, 3])
def test_tiers_pass_rows_once_whatever_the_amounts(spark, amount_rows, monkeypatch):
    """F14 to F22: rows meet by amount, once for the tiers of both identifiers and once for the others; crowded amounts take aggregates."""
    names, real = [], m.cut
    monkeypatch.setattr(m, "cut", lambda df, name, **options: names.append(name) or real(df, name, **options))
    rng = random.Random(7)
    rows, n = [], 0
    for side in "AB":
        for _ in range(60):
            n += 1
            po, inv = rng.choice(["", "P1", "P2", "P3", "P4"]), rng.choice(["", "I1", "I2", "I3"])
            cents = rng.choice([100, 200, 300, 400, None])
            rows.append(row(side, n, po, inv, cents, po and po + rng.choice(["", "."]), inv and inv + rng.choice(["", "-"])))
    # An amount of many rows of one side only, and pairs that need no luck.
    rows += [row("B", 500 + k, f"P{k}", "", 1000) for k in range(9)] + [row(s, 600, "P77", "I77", 7700) for s in "AB"]
    bridge, refused, open_rows = m.match_one_to_one(frame(spark, rows), amount_rows)
    assert ("tier1" in names) == (amount_rows == 3) and [x for x in names if x.startswith("tiers")] == ["tiers1", "tiers3"]
    assert len(names) == 2 or amount_rows == 3
    want, left = brute_one_to_one(rows)
    taken = bridge.collect()
    pairs = {(a["row_id"], b["row_id"], a["method"]) for a in taken for b in taken
             if a["side"] == "A" and b["side"] == "B" and a["match_key"] == b["match_key"] == a["row_id"]}
    assert pairs == want and len(taken) == 2 * len(want) and len({x[2] for x in want}) > 1
    assert sorted((r["side"], r["row_id"]) for r in open_rows.collect()) == sorted(r[:2] for r in left)
    by_aggregates = m._tiers_by_aggregates(frame(spark, rows).select(*m.TIER_COLUMNS), frame(spark, rows).select(*m.TIER_COLUMNS), False)
    for one, other in zip((bridge, refused), by_aggregates):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.distinct().collect()))
    flags = ["side", "row_id", *m.TIER_COLUMNS[2:], *m.FLAGS]
    assert sorted(map(str, open_rows.select(*flags).collect())) == sorted(map(str, by_aggregates[2].select(*flags).collect()))
    assert refused.count() > 0


def test_unusable_rows_never_share_a_task(spark):
    """Rows without an amount or a reference, and crowded amounts of one side, are spread by row."""
    rows = [row("A", k, "P1", "I1", None) for k in range(300)] + [row("B", k, "P1", "I1", 1000) for k in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert m.crowded_amounts(frame(spark, rows), 100) == ([1000], [])
        placed = m._settled(frame(spark, rows).select(*m.TIER_COLUMNS), list(enumerate(m.ONE_TO_ONE_TIERS[:2], 1)), [1000])
        sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 600 and max(sizes) < 300
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
