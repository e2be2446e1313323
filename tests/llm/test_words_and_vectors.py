"""Spelling variants, top-k search and tokenizer alignment against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallywork.llm import alignment, queries, topk, variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_vocabulary(docs):
    count = collections.Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            check = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if check % 97 == 0:
                at = check % len(word)
                word = word[:at] + word[at + 1:]
            count[word] += 1
    return {x: n for x, n in count.items() if len(x) >= 5 and n >= 3}


def plain_groups(words):
    by_gap = collections.defaultdict(set)  # words that agree once a place is taken out are at most one edit apart
    for x in words:
        by_gap[x].add(x)
        for k in range(len(x)):
            by_gap[x[:k] + x[k + 1:]].add(x)
    linked = collections.defaultdict(set)
    for own in by_gap.values():
        for x in own:
            linked[x] |= {y for y in own if near(x, y)}
    out, form = {}, {}
    for x, n in words.items():
        best = min(((-words[y], y) for y in linked[x]), default=None)
        if best and -best[0] >= 2 * n:
            form[x] = best[1]
    for x, n in words.items():
        root = x
        while root in form:
            root = form[root]
        out[x] = (form.get(x), root, n, len(linked[x]), words[form[x]] if x in form else None)
    return out


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_equal_brute_force(spark, given):
    docs = given("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'")
    got = queries.QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain_groups(plain_vocabulary(docs)) != {}


@pytest.mark.parametrize("limit", [1, 40, variants.BUCKET_PAIRS])
def test_words_of_one_pattern(spark, limit):
    """Hot keys: thousands of words share both halves with others, few letters, ties of counts, chains of forms."""
    luck = random.Random(5)
    words = {}
    for _ in range(1500):
        x = "".join(luck.choice("abé") for _ in range(luck.randint(5, 8)))
        words[x] = luck.choice((3, 3, 6, 12, 24, 60))
    for k in range(700):
        words["common" + "".join(luck.choice("xyz") for _ in range(luck.randint(1, 6)))] = 3 + k % 5
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r.a, r.b) for r in variants.near_pairs(frame, limit).collect()]
    want = plain_groups(words)
    assert len(pairs) == len(set(pairs)) == sum(x[3] for x in want.values()) // 2
    assert rows_of(variants.group_variants(frame)) == want


def test_long_chain_of_forms(spark):
    chain = ["a" * 5 + "b" * k for k in range(20)]
    frame = spark.createDataFrame([(x, 3 * 2 ** (20 - k)) for k, x in enumerate(chain)], "word string, n long")
    got = rows_of(variants.group_variants(frame))
    assert {x[1] for x in got.values()} == {chain[0]} and got[chain[-1]][0] == chain[-2] and got[chain[0]][0] is None


def test_variants_odd_rows(spark, odd, none):
    rows, docs, clash = odd
    want = plain_groups(plain_vocabulary([(i, t) for i, t in rows]))
    assert rows_of(variants.variants(docs)) == rows_of(variants.variants(clash)) == want
    assert variants.variants(none).collect() == []
    texts = [(None, "Größe größe GRößE größe× "), (1, "été÷été " * 4), (2, "naïve naive naïve naïve naive naive naive naïves " * 3)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(variants.variants(frame)) == plain_groups(plain_vocabulary(texts))


def plain_top(vectors, asked, k, scale=64):
    """Every score with whole numbers of Python."""
    usable = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(float(x) * scale)) for x in v]))
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in usable if asked(i)}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def top_rows(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_top_k_whole_table(spark, given):
    vectors = given("SELECT vec_id, embedding FROM {embeddings}")
    got = queries.QUERIES["op12_exact_topk"](spark, "/root/testdata/sf0.001")
    assert [f.simpleString() for f in got.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"]
    assert top_rows(got) == plain_top(vectors, lambda i: i % 20 == 0, 20)


def test_top_k_ties_slices_and_groups(spark, monkeypatch):
    """A third of the rows is one vector, ids in any range, several slices, groups and rounds."""
    luck = random.Random(3)
    rows = []
    for i in range(900):
        v = [1.0, -2.0, 0.5] if i % 3 == 0 else [luck.choice((0.25, 1.0, -1.0)) for _ in range(3)]
        rows.append(((i - 450) * luck.choice((1, 1 << 33)), v))
    rows += [(7, None), (None, [1.0, 1.0, 1.0]), (40, [float("nan"), 1.0, 1.0]), (60, [1.0, None, 1.0]), (80, [float("inf"), 0.0, 0.0]),
             (100, []), (120, [3.0]), (141, [1.0, 1.0, 1.0, 5.0]), (161, [2.0, 2.0, 2.0]), (161, [2.0, 2.0, 2.0]), (180, [1.5] * 3), (180, [1.5] * 3)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = frame.where("id % 20 = 0").selectExpr("id", "vector", "'x' score", "1 q", "2 phase")
    monkeypatch.setattr(topk, "SLICE_BYTES", 2000)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    for k in (1, 20, 2000):
        assert top_rows(topk.top_k(frame, asked, k, 64.0)) == plain_top(rows, lambda i: i % 20 == 0, k)


def test_top_k_large_numbers_and_empty_tables(spark):
    rows = [(20, [1e300, 1.0]), (21, [1e300, 1.0]), (22, [-1e300, 2.0]), (23, [3e9, 3e9]), (24, [1e-9, -1e-9])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    got = top_rows(topk.top_k(frame, frame.where("id % 20 = 0"), 3, 64.0))
    assert [(i, s) for _, _, i, s in got] == [(21, 1 << 61), (23, 1 << 61), (24, -64)]
    none = frame.where("false")
    assert topk.top_k(none, none, 3).collect() == topk.top_k(none, frame.where("id is null"), 3).collect() == []
    assert topk.top_k(none, frame, 3).collect() == []


PATHS = [public_tokenizers.path(x) for x in (alignment.BYTE_LEVEL, alignment.PIECES)]


def plain_alignment(texts):
    """By both libraries themselves and a walk over the bytes of each text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_side.encode_special_tokens = True
    spelled = alignment.spelled_bytes()
    docs, count = [], collections.Counter()
    for doc, text in texts:
        if not text:
            docs.append((doc, [], [], [], []))
            continue
        a = a_side.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(spelled[c] for c in a_side.id_to_token(i))) for i in a.ids]
        b = [(i, bytes([int(b_side.id_to_piece(i)[1:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode())
             for i in b_side.encode(text)]
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc, [], [], [], []))
            continue
        owner = [[], []]
        for side, tokens in enumerate((a, b)):
            for place, (_, own) in enumerate(tokens):
                owner[side] += [place] * len(own)
        linked = sorted(set(zip(*owner)))
        groups, x, y = [], 0, 0
        for at in range(1, len(whole) + 1):
            if at == len(whole) or owner[0][at] != owner[0][at - 1] and owner[1][at] != owner[1][at - 1]:
                to = [owner[s][at] if at < len(whole) else len((a, b)[s]) for s in (0, 1)]
                groups.append(",".join(str(i) for i, _ in a[x:to[0]]) + "|" + ",".join(str(i) for i, _ in b[y:to[1]]))
                x, y = to
        pairs = [(a[i][0], b[j][0]) for i, j in linked]
        count.update(pairs)
        docs.append((doc, a, b, groups, pairs))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted((
        (doc, len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, a, b, groups, pairs in docs
    ), key=str)


def aligned(frame):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str)


def test_alignment_whole_table(spark, given):
    texts = given("SELECT doc_id, text FROM {documents}")
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    assert aligned(got) == plain_alignment(texts)


def test_alignment_odd_rows(spark, odd, none, monkeypatch):
    rows, docs, clash = odd
    more = [(20, "a<|endoftext|>b<s> </s><unk>"), (21, "  two  spaces\t\ttabs\r\n"), (22, "▁under"), (23, "é​\U0001f600 Ａ"), (24, " "), (25, "x")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = plain_alignment([*rows, *more])
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    for chunk_bytes, chunk_pairs in ((alignment.CHUNK_BYTES, alignment.CHUNK_PAIRS), (100, 5)):
        out = alignment.align(frame, *PATHS, digest=True, chunk_bytes=chunk_bytes, chunk_pairs=chunk_pairs)
        assert aligned(out.withColumnRenamed("groups", "groups_sha256")) == want
    assert len(alignment.align(clash, *PATHS).collect()) == len(rows)
    assert alignment.align(none, *PATHS).collect() == [] == alignment.links(none, *PATHS).collect()
    texts = {r.doc_id: r.groups for r in alignment.align(frame, *PATHS).collect()}
    assert texts[25] and hashlib.sha256(texts[25].encode()).hexdigest() in {x[-1] for x in want if x[0] == 25}


def test_links_share_bytes(spark):
    frame = spark.createDataFrame([(1, "unbelievable tokenisation of naïveté"), (2, None)], "doc_id long, text string")
    links = alignment.links(frame, *PATHS).collect()
    counts = alignment.align(frame, *PATHS).where("doc_id = 1").first()
    assert len(links) == counts.n_links and sum(x.length for x in links) == len(" unbelievable tokenisation of naïveté".encode())
    assert [x.start for x in links] == sorted(x.start for x in links)


def test_other_byte_level_files_use_their_library(spark, tmp_path):
    import json

    with open(PATHS[0], encoding="utf-8") as file:
        own = json.load(file)
    own["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "other.json"
    path.write_text(json.dumps(own))
    from tokenizers import Tokenizer

    texts = ["it's a test 12  x", "don't\n\n stop<|endoftext|>", "a" * 300]
    for name in (PATHS[0], str(path)):
        library = Tokenizer.from_file(name)
        library.encode_special_tokens = True
        assert alignment.ByteLevel(name).encode(texts) == [library.encode(" " + x, add_special_tokens=False).ids for x in texts]
