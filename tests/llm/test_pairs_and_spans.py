"""Near-duplicates, substring dedup and decontamination against brute force."""

import collections
import hashlib
import random

import numpy as np
import plain
import pytest

from tallywork.llm import decontaminate, near_dedup, queries, substring_dedup
from tallywork.llm.fm_index import FMIndex
from tallywork.llm.words import grams, lowest


def test_number_of_a_run_depends_on_its_words_and_length_alone():
    values = np.random.default_rng(1).integers(0, 2**64, 200, np.uint64)
    for n in (1, 2, 3, 5, 8, 35):
        whole = grams(values, n)
        assert len(whole) == 200 - n + 1
        for k in (0, 7, 200 - n):
            assert whole[k] == grams(values[k:k + n].copy(), n)[0]
    assert len(grams(values[:3], 5)) == 0
    assert grams(values[:1], 1)[0] != values[0]


def test_lowest_takes_the_leftmost():
    values = np.array([5, 3, 3, 9, 1, 1, 1, 7], np.uint64)
    assert lowest(values, 3).tolist() == [min(range(k, k + 3), key=lambda x: (values[x], x)) for k in range(6)]


def test_fm_index_finds_every_place():
    chance = random.Random(3)
    for _ in range(60):
        text = np.array([chance.randint(0, 3) for _ in range(chance.randint(1, 60))])
        index = FMIndex(text)
        for size in (1, 2, 4):
            rows = np.array([[chance.randint(0, 4) for _ in range(size)] for _ in range(10)])
            for row, low, high in zip(rows, *index.ranges(rows)):
                want = [k for k in range(len(text) - size + 1) if (text[k:k + size] == row).all()]
                assert sorted(index.places(np.arange(low, high)).tolist()) == want


def test_fm_index_of_a_long_repeat():
    text = np.tile(np.arange(50), 200)
    index = FMIndex(text)
    low, high = index.ranges(np.array([[48, 49, 0, 1]]))
    assert sorted(index.places(np.arange(low[0], high[0])).tolist()) == list(range(48, 9_950, 50))


def test_queries_equal_brute_force(spark, folder, given):
    docs = given("SELECT doc_id, text FROM {documents}")
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op1_substring_dedup"](spark, folder).collect()}
    for (doc, _), (n, gone, kept) in zip(docs, plain.repeats([t for _, t in docs], 35)):
        assert got[doc] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_minhash_near_dedup"](spark, folder).collect()}
    assert got == plain.groups(docs)
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op9_benchmark_decontamination"](spark, folder).collect()}
    assert got == plain.hits(docs, given("SELECT item_id, text FROM {benchmark}"))


@pytest.mark.parametrize("window, anchor", [(6, 3), (35, 8)])
def test_repeats_of_random_texts(spark, window, anchor):
    chance = random.Random(window)
    texts = []
    for _ in range(60):
        own = [chance.choice("abc") for _ in range(chance.randint(0, 90))]
        if texts and chance.random() < 0.5:
            own[3:3] = chance.choice(texts).split()[:chance.randint(0, 70)]
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = substring_dedup.remove_repeats(docs, window, anchor, chunk_bytes=500).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out}
    assert [got[k] for k in range(60)] == plain.repeats(texts, window)
    for r in out:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_repeats_odd_rows(odd, none):
    rows, docs, clash = odd
    want = collections.Counter((i, *r) for (i, _), r in zip(rows, plain.repeats([t for _, t in rows], 35)))
    for table in (docs, clash):
        out = substring_dedup.remove_repeats(table).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == want
    assert substring_dedup.remove_repeats(none).collect() == []


def test_near_copies_of_a_passage_at_all_distances(spark):
    """A group whose members are linked with its middle, with each other, in chains, or not at all."""
    chance = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for k in range(150):
        own = list(base)
        for _ in range(chance.randint(0, 9)):
            own[chance.randrange(len(own))] = f"e{chance.randrange(10**6)}"
        if k % 7 == 0:
            own += [f"t{chance.randrange(10**6)}" for _ in range(chance.randint(0, 60))]
        docs.append((k, " ".join(own)))
    chain = [f"c{k}" for k in range(200)]
    docs += [(1000 + k, " ".join(chain[k * 8:k * 8 + 80])) for k in range(15)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = plain.groups(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_circulant_signatures_estimate_similarity():
    chance = np.random.default_rng(2)
    both, a, b = (chance.integers(0, 2**63, n, np.uint64) for n in (600, 100, 100))
    signs = near_dedup.signatures([np.unique(np.r_[both, a]), np.unique(np.r_[both, b])], 512)
    assert abs((signs[:, 0] == signs[:, 1]).mean() - 0.75) < 0.08


def test_near_duplicates_odd_rows(odd, none):
    rows, docs, clash = odd
    for table in (docs, clash):
        out = near_dedup.near_duplicates(table).collect()
        assert len(out) == len(rows)
        got = collections.Counter((r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in out)
        assert got[5, 4, False, True] == 2 and got[None, 4, False, True] == 1 and got[4, 4, True, True] == 1
        assert got[7, 6, False, True] == 1 and got[6, 6, True, True] == 1
        assert got[1, 1, True, False] == 1 and got[2, 2, True, False] == 1 and got[None, None, True, False] == 1
    assert near_dedup.near_duplicates(none).collect() == []


def test_decontamination_odd_rows(spark, odd, none):
    rows, docs, clash = odd
    items = [("a", " ".join(f"w{k}" for k in range(20, 45))), ("b", "ONE, two"), ("c", None), ("d", "!!"), (None, "one two"), ("a", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = collections.Counter()
    for row in rows:
        want.update({(row[0], *plain.hits([row], items)[row[0]]): 1})
    for table, size in ((docs, 4 << 20), (clash, 60)):  # the small size searches item by item
        out = decontaminate.decontaminate(table, bench, query_bytes=size).collect()
        got = collections.Counter(
            (r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
            for r in out
        )
        assert got == want
        assert all(r.clean_text is None for r in out if r.doc_id == 1)
        assert {r.clean_text for r in out if r.doc_id == 6} == {""}
    assert decontaminate.decontaminate(none, bench).collect() == []
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_text_without_spans_keeps_everything_else():
    assert decontaminate.without("é, One-two three!".encode(), [(1, 3)]).decode() == "é,  three!"


def test_a_repeated_row_keeps_its_links(spark, monkeypatch):
    base, far = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    rows = [(1, base), (1, base), (2, [*base[:-1], "other"]), (3, far), (4, [f"u{k}" for k in range(60)])]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")

    def one_bucket(batches):
        """All in bucket 7; row 3 is its centre, as it shares another one with row 4."""
        for batch in near_dedup._sketches(batches):  # in the tasks, where it is not replaced
            bands = near_dedup.pa.array([[7, 8] if i in (3, 4) else [7] for i in batch.column("doc_id").to_pylist()])
            yield batch.set_column(batch.schema.get_field_index("bands"), "bands", bands)

    monkeypatch.setattr(near_dedup, "_sketches", one_bucket)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
