"""Language-model scores of whole texts: context-tree weighting over bytes, beside a smoothed word-count base."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut, scratch_path, scratch_table
from . import context_tree as ct
from . import words as w

CHUNK_BYTES = 32 << 20  # text whose words and bytes are looked up together
COST_STEPS = 1 << 32  # costs travel in whole steps of this part of one
BATCH_BYTES = 1 << 19  # compressed texts that are scored in one go
BATCHES = 8  # of these, whose words are looked up in one go
_LATEST_TWO = (1 << 18) - 1


def training_rows(doc_id: Column) -> Column:
    """Rows to learn from; a row without id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(False))


def _by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Written to the shared folder in buckets of `column`: later group-bys and joins on it do not shuffle it again."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_table(spark, name)
    rows = df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("compression", "zstd")
    rows.option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def _shut(slot: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted slots with a 64-bit value each, compressed: their steps and the values byte by byte of the numbers."""
    columns = (np.diff(slot, prepend=0), values)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns))


def _opened(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, 8, -1)
    steps, values = (np.ascontiguousarray(x.T).view(t).ravel() for x, t in zip(raw, (np.int64, kind)))
    return np.cumsum(steps), values


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        for batch in w.blocks(batches):
            size = batch.column("text").nbytes
            for small in w.packed(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [*small.columns, pa.array(np.full(small.num_rows, chunk, np.int64))], names=[*small.schema.names, "_chunk"]
                )
            held += size
            if held >= limit:
                chunk, held = chunk + 1, 0

    return w.released(run)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in a row, and the bounds of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    there = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    return words.filter(pa.array(there)), np.concatenate(([0], np.cumsum(there)))[w.bounds(pc.list_value_length(lists).to_numpy())]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each chunk with their counts in training rows; the end of a text is the empty word."""
    chunk, held, size = None, [], 0  # count 0: met in rows that are not learned from alone

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            found = merged()
            found = found.append_column("_chunk", pa.array(np.full(found.num_rows, chunk, np.int64)))
            found = found.set_column(0, "word", found.column("word").cast(pa.binary()))
            yield from found.select(["_chunk", "word", "n"]).to_batches(50_000)

    for batch in w.blocks(batches, "_packed", w.BLOCK_BYTES // 2):
        runs = batch.column("_chunk").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if runs[a] != chunk:
                yield from out()
                chunk, held, size = int(runs[a]), [], 0
            own = batch.slice(a, b - a)
            texts = [text or b"" for text in w.opened(own)]
            learn = own.column("_learn").to_numpy(zero_copy_only=False)
            words, ends = _words(pa.array(texts, pa.binary()).cast(pa.string()))
            for learned in (True, False):
                mask = learn == learned
                if mask.any():
                    found = words.filter(pa.array(np.repeat(mask, np.diff(ends)))).value_counts()
                    count = found.field("counts").to_numpy() if learned else np.zeros(len(found), np.int64)
                    held.append(pa.table({
                        "word": pa.concat_arrays([found.field("values"), pa.array([""])]),
                        "n": np.append(count, int(mask.sum()) if learned else 0),
                    }))
                    size += held[-1].num_rows
            if size > 2 * held[0].num_rows + 4 * w.CACHE_WORDS:
                held = [merged()]
                size = held[0].num_rows
    yield from out()


def _distinct(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = np.sort(slot)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
    return slot[first], np.diff(first, append=len(slot))


def _bucket(slot: np.ndarray, buckets: int) -> np.ndarray:
    """By context, so that the slots of a context lie side by side, which keeps their steps small."""
    return (w.mixed((slot >> 8).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _slots(buckets: int):
    """Distinct slots of the running texts of each chunk with their counts in training rows, shut by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0  # count 0: as in _vocabulary

        def merged() -> list[tuple[np.ndarray, np.ndarray]]:
            return [ct.summed(*(np.concatenate(x) for x in zip(*held)))] if held else []

        def out() -> Iterator[pa.RecordBatch]:
            for slot, n in merged():
                bucket = _bucket(slot, buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, slot, n = bucket[order], slot[order], n[order]
                own, first = np.unique(bucket, return_index=True)
                shut = [_shut(slot[a:b], n[a:b]) for a, b in zip(first, [*first[1:], len(slot)])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), chunk, np.int64)), pa.array(own), pa.array(shut, pa.binary()),
                ], names=["_chunk", "_bucket", "data"])

        for batch in w.blocks(batches, "_packed", w.BLOCK_BYTES // 4):
            runs = batch.column("_chunk").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if runs[a] != chunk:
                    yield from out()
                    chunk, held, size = int(runs[a]), [], 0
                own = batch.slice(a, b - a)
                found, ends = ct.slots([(text or b"").lower().split() for text in w.opened(own)])
                learn = np.repeat(own.column("_learn").to_numpy(zero_copy_only=False), np.diff(ends))
                slot, _ = _distinct(found[~learn])
                held += [_distinct(found[learn]), (slot, np.zeros(len(slot), np.int64))]
                size += len(held[-1][0]) + len(held[-2][0])
                if size > 2 * len(held[0][0]) + (2 << 20):
                    held = merged()
                    size = len(held[0][0])
        yield from out()

    return w.released(run)


def _model(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The slots of a bucket with their counts over all chunks."""
    slot, n, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for data in [*table.column("data"), None]:
        if data is not None:
            held.append(_opened(data.as_py(), np.int64))
        if data is None or sum(len(x) for x, _ in held) > len(slot) + (1 << 20):
            slot, n = ct.summed(*(np.concatenate(x) for x in zip((slot, n), *held)))
            held = []
    w.trim()
    return pa.table({
        "slot": slot, "n": n, "_bucket": np.full(len(slot), key[0].as_py(), np.int64), "_latest": slot >> 8 & _LATEST_TWO,
    })


def _tops(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The nodes of depth 2 over one pair of latest bytes, which every context has."""
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
    lv = ct.subtree(slot, n, 2)[2]
    up = ct.shortened(lv.node >> 8, 1) << 8 | lv.node & 255
    return pa.table({"node": up, "zeros": lv.zeros, "ones": lv.ones, "below": lv.weighted})


def _slot_costs(top: ct.Top):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
        return pa.table({"slot": slot, "cost": ct.log10_cost(slot, n, top), "_bucket": table.column("_bucket")})

    return run


def _chunk_costs(key, used: pa.Table, costs: pa.Table) -> pa.Table:
    """The slots of each chunk with their costs, of one bucket."""
    known, cost = costs.column("slot").to_numpy(), costs.column("cost").to_numpy()
    order = np.argsort(known)
    known, cost, shut = known[order], cost[order], []
    for data in used.column("data"):
        slot, _ = _opened(data.as_py(), np.int64)
        at, there = ct.find(known, slot)
        if not there.all():
            raise ValueError("a slot lacks its cost")
        shut.append(_shut(slot, np.rint(cost[at] * COST_STEPS).astype(np.int64)))
    w.trim()
    return pa.table({"_chunk": used.column("_chunk"), "data": pa.array(shut, pa.binary())})


def _scores(tokens: int, distinct: int, schema: pa.Schema):
    def run(key, docs: pa.Table, costs: pa.Table) -> pa.Table:
        words = costs.filter(pc.is_null(costs.column("data")))
        known = words.column("word").cast(pa.string()).combine_chunks()
        c, end = words.column("c").to_numpy(), pc.index_in(pa.scalar(""), value_set=known).as_py()
        parts = [_opened(x.as_py(), np.int64) for x in costs.column("data").drop_null()]
        place = ct.Places(np.concatenate([slot for slot, _ in parts]))
        cost = np.concatenate([cost for _, cost in parts])
        del parts
        base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        parts, ahead = [], []

        def scored(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Words are looked up for several batches in one call, which hashes the vocabulary."""
            blocks = [[text or b"" for text in w.opened(batch)] for batch in batches]
            split = [_words(pa.array(texts, pa.binary()).cast(pa.string())) for texts in blocks]
            found = pc.index_in(pa.chunked_array([own for own, _ in split]), value_set=known).to_numpy()
            bounds, after = [ends for _, ends in split], 0
            del split
            for batch, texts, ends in zip(batches, blocks, bounds):
                yield of_batch(batch, texts, found[after:after + ends[-1]], ends)
                after += ends[-1]

        def of_batch(batch: pa.RecordBatch, texts: list[bytes], at: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            # Every text has one more token, its end, behind its words.
            at = np.insert(at, ends[1:], end)
            ends = ends + np.arange(len(ends))
            total = [np.add.reduceat(v[at], ends[:-1]) for v in (base, (c > 0).astype(np.int64))]
            own, byte_ends = ct.slots([text.lower().split() for text in texts])
            at = place(own)
            if (at < 0).any():
                raise ValueError("a slot lacks its cost")
            score = np.add.reduceat(cost[at], byte_ends[:-1]) / COST_STEPS
            size = np.array([max(1, len(text)) for text in texts])
            return pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(ends)), pa.array(total[1]),
                pa.array(np.full(len(texts), tokens, np.int64)), pa.array(total[0]), pa.array(score),
                pa.array(-score * math.log2(10) / size),
            ], schema=schema)

        for batch in w.blocks(docs.to_batches(), "_packed", BATCH_BYTES):
            ahead.append(batch)
            if len(ahead) == BATCHES:
                parts += scored(ahead)
                ahead = []
        if ahead:
            parts += scored(ahead)
        w.trim()
        return pa.Table.from_batches(parts, schema=schema)

    return run


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)` for each row of
    `docs(doc_id, text)`.

    The model codes a text as one run of bytes: the words, a break behind each, and one more break as the end. Each
    byte is eight binary decisions; each decision has a tree of contexts, the last DEPTH bytes before it, over all breaks
    back to the start of the text; it mixes the Krichevsky-Trofimov estimates of all depths by their weights. Contexts
    that training never saw are not part of the tree: the mixture ends at the longest one seen. Every byte of whole texts
    of all rows to learn from is counted.

    Texts are split into chunks as they are read. Words and pairs of context and byte are counted in each chunk and then
    over all chunks (the pairs in buckets, compressed), trees are built for each pair of latest bytes (a bounded number of contexts, however many rows), and
    costs go back to the chunks and the texts by joins: no task holds all words or all contexts.

    Nulls: a null text is empty, which is one token, the end; a row without doc_id is scored, never learned from.
    Repeated rows count each. Other columns are not read. An empty table gives an empty result; without any row to learn
    from every decision costs one bit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select("doc_id", "text").withColumn("held_out", ~training_rows(F.col("doc_id")))
    crossing = T.StructType([
        docs.schema["doc_id"], docs.schema["held_out"], T.StructField("_packed", T.BinaryType()), T.StructField("_chunk", T.LongType()),
    ])
    docs = cut(docs.mapInArrow(_chunks(chunk_bytes), crossing), "chunks")
    vocabulary = _by(
        docs.select("_packed", "_chunk", (~F.col("held_out")).alias("_learn"))
        .mapInArrow(w.released(_vocabulary), "_chunk long, word binary, n long"), "word", "vocabulary",
    )
    words = cut(vocabulary.groupBy("word").agg(F.sum("n").alias("c")), "words", compression="zstd")
    counts = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = _by(
        docs.select("_packed", "_chunk", (~F.col("held_out")).alias("_learn"))
        .mapInArrow(_slots(buckets), "_chunk long, _bucket long, data binary"), "_bucket", "slots",
    )
    model = used.groupBy("_bucket").applyInArrow(_model, "slot long, n long, _bucket long, _latest long")
    slots = _by(model, "_latest", "model")
    tops = slots.where("n > 0").groupBy("_latest").applyInArrow(_tops, "node long, zeros double, ones double, below double")
    # At most 257 * 255 rows: one for each byte of context and place in a byte's tree.
    first = tops.groupBy("node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below"))).toPandas()
    top = ct.top(*(first[x].to_numpy() for x in ("node", "zeros", "ones", "below")))
    costs = slots.groupBy("_latest").applyInArrow(_slot_costs(top), "slot long, cost double, _bucket long")
    known = vocabulary.select("_chunk", "word").join(words, "word").groupBy("_chunk", "word").agg(F.max("c").alias("c"))
    coded = used.groupBy("_bucket").cogroup(costs.groupBy("_bucket")).applyInArrow(_chunk_costs, "_chunk long, data binary")
    back = known.selectExpr("_chunk", "word", "c", "cast(null as binary) data").unionByName(
        coded.selectExpr("_chunk", "cast(null as binary) word", "cast(null as long) c", "data")
    )
    out = T.StructType([
        docs.schema["doc_id"], docs.schema["held_out"], *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score", "bits_per_byte")),
    ])
    return docs.groupBy("_chunk").cogroup(back.groupBy("_chunk")).applyInArrow(
        _scores(counts["n"] or 0, counts["v"] or 0, to_arrow_schema(out)), out
    )
