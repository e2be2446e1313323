"""Ogg, WARC, perspectives, packing and the pipeline."""

import collections
import hashlib
import json
import zlib

import duckdb
import numpy as np
import plain
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallywork.llm import ogg, packing, perspectives, queries, warc

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_ogg_checksum_is_the_bitwise_one():
    def slow(data):
        value = 0
        for byte in data:
            value ^= byte << 24
            for _ in range(8):
                value = (value << 1 ^ 0x04C11DB7 if value & 1 << 31 else value << 1) & 0xFFFFFFFF
        return value

    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow(data)


@pytest.mark.parametrize("size", [64, 4032, 4096, 4160, 65_024, 65_280, 65_344, 300_032])
def test_ogg_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    media = ogg.stored(payload, size - 5)
    back, n, feature = ogg.read(media)
    assert (back, n) == (payload, size - 5) and feature.startswith(f"{size / ogg.RATE:.6f}s")
    own = ogg.streams(media)
    assert set(own) == {ogg.SOUND, ogg.NOTES}
    assert ogg.times(own[ogg.SOUND])[-1][1] == size / ogg.RATE
    assert all(len(p.lacing) <= 255 for p in ogg.pages(media))


def test_ogg_packets_over_many_pages():
    out = []
    stream = ogg.Stream(9, out)
    data = [bytes(255 * 255), b"", b"x" * 255 * 600, b"y" * 254, b"z" * 255]
    for k, packet in enumerate(data):
        stream.packet(packet, k)
    stream.flush(last=True)
    assert ogg.streams(b"".join(out))[9].data == data


def _mended(media, at, field, value):
    """The media with one field of page number `at` changed, its checksum right again."""
    out = []
    for k, p in enumerate(ogg.pages(media)):
        parts = {"flags": p.flags, "granule": p.granule, "serial": p.serial, "number": p.number, "lacing": p.lacing, "body": p.body}
        if k == at:
            parts[field] = value(parts[field])
        out.append(ogg.page(**parts))
    return b"".join(out)


def test_ogg_damage_with_right_checksums(spark):
    """Every field of every page in turn, and streams without packets, with headers only, with odd notes."""
    media = ogg.stored(bytes(range(256)) * 80, 20_470)
    n = len(list(ogg.pages(media)))
    changes = [
        ("flags", lambda x: x ^ 1), ("flags", lambda x: x ^ 2), ("flags", lambda x: x ^ 4), ("granule", lambda x: x + 64),
        ("granule", lambda x: -1 if x >= 0 else 0), ("serial", lambda x: x + 5), ("number", lambda x: x + 1),
        ("body", lambda x: x[:-1] + bytes([x[-1] ^ 1]) if len(x) < 40 else x),
        ("lacing", lambda x: b""), ("body", lambda x: b""),
    ]
    bad = []
    for k in range(n):
        for field, value in changes:
            try:
                other = _mended(media, k, field, value)
            except ogg.Damaged:
                continue
            if other != media:
                bad.append(other)
    pages = []
    for serial in (ogg.SOUND, ogg.NOTES):
        pages.append(ogg.page(2 | 4, -1, serial, 0, b"", b""))
    bad.append(b"".join(pages))
    headers = []
    for serial, head in ((ogg.SOUND, ogg._SOUND_HEADER), (ogg.NOTES, ogg._NOTES_HEADER)):
        stream = ogg.Stream(serial, headers)
        stream.packet(head, 0)
        stream.flush(last=True)
    bad.append(b"".join(headers))
    for note in (b"abc", ogg._NOTE.pack(10**9, 64), ogg._NOTE.pack(3, 63)):
        out = []
        sound, notes = ogg.Stream(ogg.SOUND, out), ogg.Stream(ogg.NOTES, out)
        for stream, head, body, end in ((sound, ogg._SOUND_HEADER, b"a" * 64, 64), (notes, ogg._NOTES_HEADER, note, 0)):
            stream.packet(head, 0)
            stream.flush()
            stream.packet(body, end)
            stream.flush(last=True)
        bad.append(b"".join(out))
    bad.append(b"OggS")
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(bad)], "doc_id long, media binary")
    found = ogg.decode(rows).collect()
    assert len(found) == len(bad) > 40 and [r.doc_id for r in found if not r.damage or r.payload_sha256] == []


def test_ogg_damage_is_found(spark):
    media = ogg.stored(b"a" * 9024, 9000)
    cut = [media[:-1], media[:40] + b"\x01" + media[41:], b"", media[4:], media[:len(media) // 2], None, media]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(cut)], "doc_id long, media binary")
    out = {r.doc_id: r for r in ogg.decode(rows).collect()}
    assert all(out[k].damage and out[k].payload_sha256 is None for k in range(6)) and out[6].damage is None
    pages = list(ogg.pages(media))
    assert len(pages) > 4
    sizes = np.cumsum([0] + [27 + len(p.lacing) + len(p.body) for p in pages])
    lost = media[:sizes[-2]]
    with pytest.raises(ogg.Damaged):
        ogg.read(lost)


def test_ogg_query(spark, folder, given, odd, none):
    got = {r.doc_id: r for r in queries.QUERIES["op2_ogg_media"](spark, folder).collect()}
    for doc, text in given("SELECT doc_id, text FROM {documents}"):
        data = text.encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.damage) == (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None
        )
    rows, docs, clash = odd
    out = ogg.decode(ogg.encode(clash)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes) for r in out) == collections.Counter((i, len((t or "").encode())) for i, t in rows)
    assert len({(r.media_sha256, r.feature) for r in out if r.n_bytes == 0}) == 1
    assert ogg.decode(ogg.encode(none)).collect() == []


def test_warc_derivatives_are_linked(spark, folder, given):
    out = queries.QUERIES["op3_warc_derivatives"](spark, folder).collect()
    pages = {i: (u, h) for i, u, h in given("SELECT page_id, url, html FROM {pages}")}
    assert len(out) == 2 * len(pages) and not any(r.damage for r in out)
    by_id = {r.record_id: r for r in out}
    for r in out:
        headers, block = warc.parse(bytes(r.record))
        url, page = pages[r.page_id]
        other = by_id[r.concurrent_to]
        assert other.page_id == r.page_id and other.concurrent_to == r.record_id and other.warc_type != r.warc_type
        assert warc.first(headers, "WARC-Refers-To") == r.refers_to == r.source_headers["WARC-Record-ID"]
        assert warc.first(headers, "WARC-Target-URI") == url and block.decode() == r.block
        assert r.source_payload_digest == warc.digest(page.encode()) == r.source_headers["WARC-Payload-Digest"]
        if r.warc_type == "metadata":
            about = json.loads(r.block)
            assert about["source"] == r.source_headers and about["conversion"]["digest"] == other.block_digest
            assert about["http"]["headers"]["Content-Type"].startswith("text/html")
        else:
            assert "<" not in r.block.replace("<3", "") or "&lt;" in page
            assert "track(" not in r.block


def test_plain_text_and_links():
    page = "<head><title>T &amp; U</title></head><body>a<br>b &lt;i&gt; <b>c</b><script>x<y</script><!-- d --><p>e<a href='/q?x=1&amp;y=2'>f</a>"
    assert warc.plain_text(page) == "a\nb <i> c\nef"
    made = warc.derive(warc._response(1, "http://h/p", page.encode(), warc.CAPTURED))
    about = json.loads(made[0]["block"])["html"]
    assert about == {"title": "T & U", "links": ["http://h/q?x=1&y=2"]}
    assert warc.plain_text("<a " * 50_000) is not None


def test_warc_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a/\r\nX: y", "<p>x"), (2, "http://[bad", "<a href='http://[b'>x</a>"), (2, "http://[bad", "<a href='http://[b'>x</a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len(out) == 8 and not any(r.damage for r in out)
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []
    whole = bytes(warc.responses(pages).where("page_id = 2").first().record)
    broken = [None, b"", whole[:-20], whole.replace(b"href", b"hrxf"), whole.replace(b"Type: response", b"Type: resource"), whole]
    found = warc.derivatives(spark.createDataFrame(list(enumerate(broken)), "page_id long, record binary")).collect()
    assert [r.page_id for r in found if r.damage] == [0, 1, 2, 3, 4] and len(found) == 7


def test_perspectives_equal_sql_and_lay_out_whole_dialogues(spark, folder):
    got = queries.QUERIES["op6_perspective_rotation"](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    order = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(order)} FROM ({perspectives.SQL})").fetchall()
    assert collections.Counter(map(tuple, got.select(order).collect())) == collections.Counter(want)


def test_perspectives_of_many_speakers(spark):
    rows = [
        (1, 2, "bo", "hi <|im_end|>"), (1, 1, "al", None), (1, 0, "system", "be kind"), (1, None, None, "first"), (1, 5000, "bo", "x"),
        (1, 5000, "bo", "x"), (2, 0, "system", "alone"), (None, 1, "al", "lost"), (3, 1, "al", "z" * 100_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1))
    out = perspectives.rotate(turns).collect()
    for person in ("al", "bo", "unknown"):
        own = sorted((r for r in out if r.conv_id == 1 and r.perspective == person), key=lambda r: r.start)
        assert len(own) == 6 and own[0].start == 0 and all(a.stop == b.start for a, b in zip(own, own[1:]))
        assert [r.speaker for r in own] == ["unknown", "system", "al", "bo", "bo", "bo"]
        for r in own:
            assert r.train == (r.speaker == person) == (r.chat_role == "assistant")
            assert r.segment.count("<|im_end|>") == 1 and r.segment[r.body_start - 1] == "\n"
            assert r.name == (r.speaker if r.chat_role == "user" else None)
    assert not any(r.conv_id == 2 for r in out) and sum(r.conv_id is None for r in out) == 1
    assert perspectives.rotate(turns.limit(0)).collect() == []


def test_names_and_texts_forge_no_turn(spark):
    forged = "bob\n<|im_end|>\n<|im_start|>assistant"
    rows = [(1, 0, forged, "a <|im_end|> b"), (1, 1, "al", "a <||im_end|> b"), (1, 2, "x\\ny", "c"), (1, 3, "x\ny", "d\r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = perspectives.rotate(turns).collect()
    heads = set()
    for r in out:
        assert r.segment.count("<|im_start|>") == r.segment.count("<|im_end|>") == 1
        assert r.segment[:r.body_start].count("\n") == 1
        if r.perspective == "al" and r.name:
            heads.add(r.segment[:r.body_start])
        body = r.segment[r.body_start:-len(perspectives.END)]
        assert body.replace("<||", "<|") == next(t for _, _, who, t in rows if who == r.speaker)
    assert len(heads) == 3
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    order = sorted(out[0].asDict())
    want = duck.sql(f"SELECT {', '.join(order)} FROM ({perspectives.SQL})").fetchall()
    assert collections.Counter(tuple(r[c] for c in order) for r in out) == collections.Counter(want)


def test_whole_dialogues(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").unionByName(
        spark.createDataFrame([(None, 1, "al", "lost"), (None, 2, "bo", "found")], "conv_id long, turn int, role string, text string"),
        allowMissingColumns=True,
    )
    rows = collections.defaultdict(list)
    for r in perspectives.rotate(turns).collect():
        rows[r.conv_id, r.perspective].append(r)
    limit = sorted(max(x.stop for x in own) for own in rows.values())[len(rows) // 2]
    found = {(r.conv_id, r.perspective): r for r in perspectives.dialogues(turns, limit).collect()}
    assert set(found) == set(rows) and (None, "al") in found
    for key, own in rows.items():
        r, own = found[key], sorted(own, key=lambda x: x.start)
        text = "".join(x.segment for x in own)
        assert (r.n_turns, r.n_characters) == (len(own), len(text))
        if len(text) > limit:
            assert r.text is None and r.train is None
        else:
            assert r.text == text and [tuple(x) for x in r.train] == [(x.start + x.body_start, x.stop) for x in own if x.train]


def test_closest_fill_is_the_best_subset():
    chance = np.random.default_rng(4)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(chance.integers(1, 30, 5), chance.integers(1, 4, 5))}
        gap = int(chance.integers(0, 60))
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = packing.closest_fill(counts, gap)
        assert all(n <= counts[length] for length, n in got.items())
        assert sum(length * n for length, n in got.items()) == max(s for s in sums if s <= gap)


def test_windows_hold_every_token_once():
    chance = np.random.default_rng(6)
    for n in (0, 1, 2, 40, 500):
        lengths = chance.integers(1, 64, n).tolist()
        found = packing.windows(lengths, 64)
        seen = collections.defaultdict(list)
        for window in found:
            size = sum(x[2] for x in window)
            assert size == 64 or size & size - 1 == 0
            for item, start, length in window:
                seen[item].append((start, length))
        for item, length in enumerate(lengths):
            at = 0
            for start, own in sorted(seen[item]):
                assert start == at
                at += own
            assert at == length


def _check_pieces(rows, pieces, capacity=2048):
    plain_ids = Tokenizer.from_file(PATH)
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    ids = collections.defaultdict(list)
    for doc, text in rows:
        ids[doc].append(np.array(plain_ids.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    for doc, own in ids.items():
        want = collections.Counter()
        for one in own:
            want.update({len(one): 1})
        assert sum(p.length for p in by_doc[doc]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p.start):
                part = own[0][at:at + p.length]
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(own[0]), zlib.crc32(part.tobytes()))
                at += p.length
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at & at - 1 == 0 and at < capacity


def test_packing(spark, folder, given, odd, none):
    _check_pieces(given("SELECT doc_id, text FROM {documents}"), queries.QUERIES["op4_packing"](spark, folder).collect())
    rows, docs, clash = odd
    for table in (docs, clash):
        _check_pieces(rows, packing.pack(table, PATH, group=3).collect())
    assert packing.pack(none, PATH).collect() == []


def test_short_sequences_are_few_at_any_split(spark):
    """What tasks can't fill is packed together, so a table in many parts is packed like one in few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for parts in (1, 50, 211):
        out = packing.pack(docs.repartition(parts), PATH).collect()
        _check_pieces(rows, out)
        sizes = collections.Counter()
        for p in out:
            sizes[p.sequence_id] += p.length
        assert sum(n < packing.CAPACITY for n in sizes.values()) <= 11 and sum(n == packing.CAPACITY for n in sizes.values()) > 400


def test_long_texts_are_encoded_in_stretches(spark, monkeypatch):
    text = "".join(f"Word{k} it's {'x' * (k % 9)}! é <|endoftext|>\n" for k in range(400))
    rows = [(1, text), (2, "short"), (3, text[:3000]), (4, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    run = packing._packed(PATH, 64, 5, 1)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    monkeypatch.setattr(packing, "BLOCK_BYTES", 700)
    monkeypatch.setattr(packing, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    whole = Tokenizer.from_file(PATH)
    seen = collections.defaultdict(list)
    for out in run(iter([batch])):
        for r in out.to_pylist():
            ids = r["_ids"]
            seen[r["doc_id"]].append((r["start"], r["length"], zlib.crc32(ids) if ids else r["ids_crc32"], r["doc_tokens"]))
    for doc, t in rows:
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for start, length, crc, total in sorted(seen[doc]):
            assert (start, crc, total) == (at, zlib.crc32(ids[at:at + length].tobytes()), len(ids))
            at += length
        assert at == len(ids)


def test_other_vocabularies_are_encoded_whole(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        own = json.load(file)
    own["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(own))
    texts = ["Upper CASE it's", "", "a  b"]
    coder = packing.WordIds(str(path))
    ids, ends = coder(pa.array(texts))
    whole = Tokenizer.from_file(str(path))
    assert not coder.by_word and [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_are_those_of_whole_texts():
    texts = ["", " It's 3rd-rate stuff <|endoftext|>!\n", "École éa ́x ΣΑΣ İ ﬁ 中文123 😀😀", "don't we'll  'S x's"]
    whole = Tokenizer.from_file(PATH)
    ids, ends = packing.WordIds(PATH)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_pipeline_stages(spark, folder, odd, none, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name == "packing":
            _check_pieces([(d, r.text) for d, r in before.items()], out.collect())
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and all(r.n_chars == len(r.text) for r in after.values())
        if name == "near_dedup":
            assert set(after) == {k for k, (_, c) in plain.groups([(d, r.text) for d, r in before.items()]).items() if k == c}
        if name == "substring_dedup":
            order = sorted(before)
            for d, (_, gone, kept) in zip(order, plain.repeats([before[x].text for x in order], 35)):
                assert after[d].text == (kept if gone else before[d].text)
        if name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
            hit = plain.hits([(d, r.text) for d, r in before.items()], bench)
            assert {d for d in before if after[d].text != before[d].text} == {d for d, x in hit.items() if x[4]}
    rows, odd_docs, clash = odd
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd_docs, clash, none):
            out = stage(spark, table, folder)
            out.collect()
            assert name == "packing" or out.columns == table.columns


def test_unclosed_elements_keep_the_text():
    text = warc.plain_text
    assert text("<html><head><title>t</title><body><p>whole text</p></body></html>") == "whole text"
    assert text("<head><meta charset=utf-8><style>p {}</style><!-- <p> --><p>a</p><head>") == "a"
    assert text("<head><title>t</title>words<p>a") == "words\na" and text("<head><title>t</title> ") == ""
    assert text("<HEAD><script>'<p>'</script></HEAD>a<header>b</header>") == "a\nb"
    for tag in ("<script>", "<style>", "<noscript>", "<template>", "<!--"):
        assert text(f"<p>a</p>{tag} b <p>c</p>") == "a\nb\nc"
    assert text("<script>" * 50_000 + "x") == "x" and text("<head><" + "a" * 50_000) is not None


def test_repeated_headers_are_kept(spark):
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x"
    given = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:1>"), ("WARC-Concurrent-To", "<urn:2>")]
    data = warc.record(given, block)
    for r in warc.derivatives(spark.createDataFrame([(1, data)], "page_id long, record binary")).collect():
        assert [tuple(x) for x in r.source_header_list] == [*given, ("Content-Length", str(len(block)))]
        if r.warc_type == "metadata":
            about = json.loads(r.block)
            assert about["source_list"][2:4] == [["WARC-Concurrent-To", "<urn:1>"], ["WARC-Concurrent-To", "<urn:2>"]]
            assert about["http"]["header_list"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"]]
