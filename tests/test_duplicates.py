import pytest
from pyspark.sql import functions as F

from tallywork.operators import duplicates as d

SCHEMA = "side string, row_id bigint, norm_po string, norm_inv string, cents bigint, customer string, txn_date date, product string, quantity string, rate string, line_id string, transaction_id string"


def frame(spark, rows):
    """rows: (row_id, po, inv, cents, customer, line id, transaction id)"""
    out = [("A", n, po, inv, c, who, None, "P", "1", "2.0", line, txn) for n, po, inv, c, who, line, txn in rows]
    return spark.createDataFrame(out, SCHEMA)


def decided(spark, rows, **kw):
    return {r["row_id"]: r["disposition"] for r in d.same_file_decisions(frame(spark, rows), **kw).collect()}


def test_confirmed_copies_keep_the_first(spark):
    got = decided(spark, [(1, "P", "I", 100, "x", "", ""), (2, "P", "I", 100, "X ", "", ""), (3, "P", "I", 100, "y", "", "")])
    assert got == {1: d.CANONICAL, 2: d.EXCESS, 3: d.REVIEW}


def test_weak_bases_are_only_reviewed(spark):
    assert decided(spark, [(1, "P", "", 100, "x", "", ""), (2, "P", "", 100, "x", "", "")]) == {1: d.REVIEW, 2: d.REVIEW}


def test_trusted_line_ids_confirm_and_separate(spark):
    rows = [(1, "P", "I", 100, "x", "L1", ""), (2, "P", "I", 100, "x", "L1", ""), (3, "P", "I", 100, "x", "L2", "")]
    assert decided(spark, rows) == {1: d.CANONICAL, 2: d.EXCESS, 3: d.REVIEW}
    # one id on two different lines anywhere in the file: the column is no line id, and only supports
    broken = rows + [(4, "Q", "J", 5, "x", "L9", ""), (5, "Q", "K", 6, "x", "L9", "")]
    assert decided(spark, broken) == {1: d.CANONICAL, 2: d.EXCESS, 3: d.REVIEW}


def test_transaction_ids_must_agree(spark):
    assert decided(spark, [(1, "P", "I", 100, "x", "", "T1"), (2, "P", "I", 100, "x", "", "T2")]) == {1: d.REVIEW, 2: d.REVIEW}


def test_too_little_identity_is_not_enough(spark):
    rows = frame(spark, [(1, "P", "I", 100, None, "", ""), (2, "P", "I", 100, None, "", "")]).withColumn("rate", F.lit(None).cast("string"))
    assert {r["disposition"] for r in d.same_file_decisions(rows).collect()} == {d.REVIEW}


def test_cross_scope(spark):
    primary = frame(spark, [(1, "P", "I", 100, "x", "", ""), (2, "Q", "J", 5, "x", "", "")])
    history = frame(spark, [(10, "P", "I", 100, "x", "", ""), (11, "Q", "J", 5, "other", "", ""), (12, "Z", "Z", 1, "x", "", "")])
    decisions, active = d.screen(history, reference=primary)
    assert {r["row_id"]: r["disposition"] for r in decisions.collect()} == {10: d.OVERLAP, 11: d.REVIEW}
    assert sorted(r["row_id"] for r in active.collect()) == [11, 12]


def test_accounting_and_finalize(spark):
    decisions = d.same_file_decisions(frame(spark, [(n, "P", "", 100, "x", "", "") for n in (1, 2, 3)]))
    suspects = d.suspected(decisions)
    open_rows = frame(spark, [(2, "P", "", 100, "x", "", ""), (3, "P", "", 100, "x", "", "")])
    got = {r["row_id"]: (r["outcome"], r["held_for_row_id"]) for r in d.account_suspects(suspects, open_rows).collect()}
    assert got == {1: (d.RESOLVED, None), 2: (d.HOLD, 1), 3: (d.HOLD, 1)}
    none = {r["row_id"]: r["outcome"] for r in d.account_suspects(suspects, suspects).collect()}
    assert none == {1: d.CANONICAL, 2: d.HOLD, 3: d.HOLD}
    final = d.finalize(decisions, d.account_suspects(suspects, open_rows))
    assert {r["row_id"]: r["automatically_excluded"] for r in final.collect()} == {1: False, 2: True, 3: True}
    assert d.overlapping_outcomes(d.account_suspects(suspects, open_rows)).count() == 0


@pytest.mark.parametrize("key,ident", [(("PO + Invoice + Amount", "P", "I", 100), 12)])
def test_ids_are_stable(spark, key, ident):
    import hashlib

    want = "DUP-" + hashlib.sha256("\x1f".join(map(str, key)).encode()).hexdigest()[:ident].upper()
    got = d.same_file_decisions(frame(spark, [(1, "P", "I", 100, "x", "", ""), (2, "P", "I", 100, "x", "", "")])).first()["group_id"]
    assert got == want
