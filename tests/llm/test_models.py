"""Quality, language and language-model scores."""

import collections
import math
from math import lgamma, log

import numpy as np
import plain
import pyarrow as pa
import pytest

from tallywork.llm import context_tree, language_id, lm_scoring, quality, queries


def test_quality_held_out(spark, given):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op7_quality_classifier"](spark, folder).collect()}
    assert len(got) == 1000 and all(r.held_out != plain.learned(r.doc_id, 3, 1) for r in got.values())
    labels = given("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'")
    held = [(got[d].predicted, q) for d, q in labels if got[d].held_out]
    assert sum(p == q for p, q in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_votes_equal_a_plain_count(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    voters = quality.train(docs, labels, 20)
    texts = [r.text.encode() for r in docs.orderBy("doc_id").limit(30).collect()]
    near = voters.latent(texts, quality.WordFeatures()).astype(float) @ voters.vectors.T.astype(float)
    for row, score in zip(near, voters.score(texts, quality.WordFeatures())):
        top = np.argsort(-row, kind="stable")[:quality.NEIGHBOURS]
        vote = np.maximum(row[top], 0) ** quality.SHARPNESS
        assert score == pytest.approx((vote * voters.labels[top]).sum() / vote.sum(), abs=1e-3)


def test_repeated_ids_add_no_voters(spark):
    rows = [(k, f"good text number {k}" if k % 2 else f"bad word {k}") for k in range(60)]
    one = next(k for k, _ in rows if plain.learned(k, 3, 1))
    docs = spark.createDataFrame(rows + [(one, rows[one][1])] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows] + [(one, one % 2)] * 300, "doc_id long, quality int")
    for most in (5, 1000):
        voters = quality.train(docs, labels, most)
        learned = [k for k, _ in rows if plain.learned(k, 3, 1)]
        assert len(voters.vectors) == sum(min(most, sum(k % 2 == label for k in learned)) for label in (0, 1))


def test_quality_odd_rows(spark, odd, none, folder):
    rows, docs, clash = odd
    voters = quality.train(*(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels")))
    for table in (docs, clash):
        out = quality.classify(table, voters).collect()
        assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows)
        assert {r.score for r in out if r.doc_id in (1, 2, 3)} == {voters.prior}
    assert quality.classify(none, voters).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    empty = quality.train(docs, labels)
    assert {r.score for r in quality.classify(docs, empty).collect()} == {0.5}


def test_language_held_out(spark, given):
    got = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = given("SELECT doc_id, lang, text FROM '/root/testdata/sf0.01/documents.parquet'")
    held = [got[d].lang_pred == lang for d, lang, _ in docs if got[d].held_out]
    assert sum(held) / len(held) >= 0.97
    assert all(r.held_out != plain.learned(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got.values())


def _plain_bits(words, characters, text):
    """Interpolated Kneser-Ney bits of a word, by counting; `words`: word to its count."""
    order, bound = language_id.ORDER, "\n"
    n = collections.Counter()
    for word, times in words.items():
        own = bound + word + bound
        for end in range(2, len(own) + 1):
            for size in range(1, min(order, end) + 1):
                n[own[end - size:end]] += times
    levels = [{} for _ in range(order)]
    for gram, times in n.items():
        if len(gram) == order or gram[0] == bound and len(gram) > 1:
            levels[len(gram) - 1][gram] = times
        if len(gram) > 1:
            levels[len(gram) - 2][gram[1:]] = levels[len(gram) - 2].get(gram[1:], 0) + 1
    total = 0.0
    own = bound + text + bound
    for end in range(2, len(own) + 1):
        chance = 1 / (characters + 1)
        for size in range(1, min(order, end) + 1):
            gram = own[end - size:end]
            same = {g: c for g, c in levels[size - 1].items() if g[:-1] == gram[:-1]}
            if same:
                total_n, d = sum(same.values()), language_id.DISCOUNT
                chance = max(same.get(gram, 0) - d, 0) / total_n + d * len(same) / total_n * chance
        total -= math.log2(chance)
    return total


def test_kneser_ney_equals_a_plain_count():
    words = {"x": {"abc": 3, "abd": 3, "été": 2, "a": 1}, "y": {"bca": 4, "cab": 1, "longerwords": 2}}
    rows = [(lang, word, n) for lang, own in words.items() for word, n in own.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "word", "n"])
    model = language_id.build(*(c.to_pylist() for c in next(language_id._grams(iter([batch]))).columns))
    assert model.languages == ["x", "y"]
    asked = ["abc", "", "longer", "Été", "zzz", "abcabc", "a"]
    bits, sizes = model.word_bits(asked)
    assert sizes.tolist() == [len(x) + 1 for x in asked]
    characters = len(set("\n".join(w for own in words.values() for w in own)))
    for k, lang in enumerate(model.languages):
        assert bits[:, k].tolist() == pytest.approx([_plain_bits(words[lang], characters, x.lower()) for x in asked])


def test_language_odd_rows(spark, odd, none):
    rows, docs, clash = odd
    learn = spark.createDataFrame(
        [(k, "the cat and the dog" if k % 2 else "le chat et le chien", "en" if k % 2 else "fr") for k in range(60)],
        "doc_id long, text string, lang string",
    )
    model = language_id.train(learn)
    for table in (docs, clash):
        out = language_id.identify(table, model).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id in (1, 2, 3, 12):
                assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            elif r.doc_id is not None:
                assert r.lang_pred in ("en", "fr")
    assert language_id.identify(none, model).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(none)).collect()} == {"und"}


def test_scores_of_given_documents(spark, folder, given):
    """Counts and base of the whole table; the scores of some of its documents against a tree over whole texts."""
    got = {r.doc_id: r for r in queries.QUERIES["op10_lm_scoring"](spark, folder).collect()}
    given_texts = given("SELECT doc_id, text FROM {documents}")
    docs = [(d, [*t.encode().lower().split(), b""]) for d, t in given_texts]
    c = collections.Counter(x for d, own in docs if plain.learned(d, 5, 1) for x in own)
    tokens, distinct = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for d, own in docs:
        base = sum(math.log10((c[x] + 0.5) / (tokens + 0.5 * (distinct + 1))) for x in own)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not plain.learned(d, 5, 1), len(own), sum(c[x] > 0 for x in own), tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    some = sorted(given_texts, key=lambda x: len(x[1]))[::5][:20]
    cost = _whole_tree([t.encode() for d, t in some if plain.learned(d, 5, 1)])
    out = lm_scoring.score(spark.createDataFrame(some, "doc_id long, text string").repartition(3), chunk_bytes=3_000).collect()
    texts = dict(some)
    assert len(out) == len(some) and any(r.held_out for r in out)
    for r in out:
        assert r.score == pytest.approx(cost(texts[r.doc_id].encode()), rel=1e-9)


def test_places_of_keys():
    chance = np.random.default_rng(2)
    keys = np.unique(chance.integers(-(1 << 62), 1 << 62, 5000))
    chance.shuffle(keys)
    for n in (0, 1, 7, len(keys)):
        asked = np.concatenate((keys[:n], keys[n:], np.arange(50)))
        want = np.concatenate((np.arange(n), np.full(len(asked) - n, -1)))
        assert (context_tree.Places(keys[:n])(asked) == want).all()


def test_scratch_tables_leave_the_catalog(spark):
    from tallywork.runtime import release_scratch

    lm_scoring.score(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    release_scratch(spark)
    assert [t.name for t in spark.catalog.listTables() if not t.isTemporary] == []


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 8.0, 1e3, 1e12])
    assert context_tree.log_gamma(x) == pytest.approx([lgamma(v) for v in x], rel=1e-12, abs=1e-10)


def test_scores_odd_rows(spark, odd, none):
    rows, docs, clash = odd
    for table in (docs, clash):
        out = lm_scoring.score(table, chunk_bytes=2_000).collect()
        want = collections.Counter((i, len(plain.words(t)) + 1, not plain.learned(i, 5, 1)) for i, t in rows)
        assert collections.Counter((r.doc_id, r.n_tokens, r.held_out) for r in out) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm_scoring.score(none).collect() == []
    bits = lm_scoring.score(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert bits.train_tokens == 0 and bits.score == pytest.approx(-math.log10(2) * 8 * 4)


def _whole_tree(texts):
    """Log10 cost of a text under a context tree over the running bytes, built node by node; texts to learn from."""
    def contexts(text):
        run = b"  " + b"".join(x + b" " for x in text.lower().split()) + b" "
        for at in range(2, len(run)):
            own = tuple(run[max(0, at - context_tree.DEPTH):at][::-1])
            for k in range(8):
                yield own, (1 << k) | (run[at] >> 8 - k), run[at] >> 7 - k & 1

    n, below = collections.Counter(), collections.defaultdict(set)
    for text in texts:
        for own, place, bit in contexts(text):
            for d in range(len(own) + 1):
                n[own[:d], place, bit] += 1
                if d:
                    below[own[:d - 1], place].add(own[:d])
    memo = {}

    def estimate(own, place):
        a, b = n[own, place, 0], n[own, place, 1]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(math.pi)

    def weighted(own, place):
        if (own, place) not in memo:
            e, deep = estimate(own, place), below.get((own, place))
            memo[own, place] = e if not deep else np.logaddexp(e, sum(weighted(x, place) for x in deep)) - log(2)
        return memo[own, place]

    def one(own, place, d=0):
        here, nxt = own[:d], own[:d + 1]
        kt = (n[here, place, 1] + 0.5) / (n[here, place, 0] + n[here, place, 1] + 1)
        if d == len(own) or not n[nxt, place, 0] + n[nxt, place, 1]:
            return kt
        gap = sum(weighted(x, place) for x in below[here, place]) - estimate(here, place)
        share = 1 / (1 + math.exp(min(gap, 700)))
        return share * kt + (1 - share) * one(own, place, d + 1)

    return lambda text: sum(math.log10(p if bit else 1 - p) for own, place, bit in contexts(text) for p in [one(own, place)])


def test_scores_equal_a_tree_over_whole_texts(spark):
    texts = ["of the cat", "a b c of the end", "the  Dog\nof the cat a b d", "", "of a cat of the dog", "x"] * 4
    rows = [(k, t) for k, t in enumerate(texts)]
    cost = _whole_tree([t.encode() for k, t in rows if plain.learned(k, 5, 1)])
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_bytes=40).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.score == pytest.approx(cost(texts[r.doc_id].encode()), rel=1e-9)
        assert r.n_tokens == len(texts[r.doc_id].split()) + 1


def test_every_language_is_learned(spark):
    rows = [(k, "the cat and the dog ", "en") for k in range(40)] + [(100 + k, "le chat et le chien " * 60, "fr") for k in range(40)]
    alone = next(k for k in range(1000, 2000) if plain.learned(k, 4, 2) and spark.range(1).selectExpr(f"pmod(xxhash64({k}L, 5), 8) n").first().n == 0)
    rows.append((alone, "ein hund", "de"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, 600)
    assert model.languages == ["de", "en", "fr"]
    assert {r.lang_pred for r in language_id.identify(docs.where("lang = 'fr'"), model).collect()} == {"fr"}


def test_more_languages_than_one_group(spark):
    n = language_id.LANGUAGES + 4
    rows = [(10 * n * k + a, f"{chr(0x4E00 + a) * 3} {chr(0x4E00 + a)}", f"l{a:04}") for a in range(n) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == len({lang for i, _, lang in rows if plain.learned(i, 4, 2)}) > language_id.LANGUAGES
    texts = [chr(0x4E00 + int(x[1:])) for x in model.languages]
    assert model.word_bits(texts)[0].argmin(axis=1).tolist() == list(range(len(texts)))
