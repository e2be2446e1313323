"""Substring dedup by seed and extend: winnowed anchors, windows around repeated anchors, maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut
from . import words as w

WINDOW_WORDS = 35
ANCHOR_WORDS = 8
CHUNK_BYTES = 4 << 20  # text that one task holds at a time


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`docs` with `_chunk`, so that each chunk holds about `chunk_bytes` of text; the same for every run over the same
    rows, and independent of how they are partitioned."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.withColumn("_chunk", chunk_of(max(1, -(-size // chunk_bytes)), "doc_id", "text"))


def chunk_of(chunks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int")


def _windows(documents: list[bytes], window: int, anchor: int, numbers: w.WordNumbers):
    """Words of each text, their bounds, and for each window that lies in one text: start, place of its anchor, and
    numbers of the anchor and the window."""
    split = [text.split() for text in documents]
    values, ends = w.numbers(split, numbers)
    keys = w.grams(values, window)
    inside = np.zeros(len(keys) + 1, np.int64)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= window:
            inside[a] += 1
            inside[b - window + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside)[:-1])
    seeds = w.grams(values, anchor)
    places = w.lowest(seeds, window - anchor + 1)[starts] if len(starts) else starts
    return split, ends, starts, places, seeds[places] if len(starts) else seeds[:0], keys[starts] if len(starts) else keys


def _both(window: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return window + seed * np.uint64(0x9E3779B97F4A7C15)


def _seeds(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each text: `(seed, chunk)`."""
        numbers = w.WordNumbers()
        for batch in w.blocks(batches):
            _, ends, starts, places, seeds, _ = _windows(w.texts(batch), window, anchor, numbers)
            if not len(starts):
                continue
            new = np.concatenate(([True], places[1:] != places[:-1]))
            rows = np.searchsorted(ends, places[new], side="right") - 1
            chunks = batch.column("_chunk").to_numpy(zero_copy_only=False)[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.signed(seeds[new])), pa.array(chunks.astype(np.int32))], names=["seed", "_chunk"]
            )

    return w.released(run)


def _extended(window: int, anchor: int):
    def run(key, texts: pa.Table, seeds: pa.Table) -> pa.Table:
        """Windows of the chunk whose anchor is repeated in the corpus: `(window, seed, chunk, n)`."""
        numbers, known = w.WordNumbers(), np.sort(seeds.column("seed").to_numpy().view(np.uint64))
        found: dict[str, list] = {"window": [], "seed": [], "_chunk": [], "n": []}
        for batch in w.blocks(texts.to_batches(), "_packed", w.BLOCK_BYTES // 2) if len(known) else ():
            _, _, starts, _, own, keys = _windows([t or b"" for t in w.opened(batch)], window, anchor, numbers)
            hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            own, keys = own[hit], keys[hit]
            _, first, n = np.unique(_both(keys, own), return_index=True, return_counts=True)
            found["window"].append(w.signed(keys[first]))
            found["seed"].append((own[first] >> np.uint64(33)).astype(np.int32))
            found["n"].append(n.astype(np.int32))
        size = sum(map(len, found["n"]))
        w.trim()
        found["_chunk"] = [np.full(size, key[0].as_py(), np.int32)]
        kinds = {"window": np.int64, "seed": np.int32, "_chunk": np.int32, "n": np.int32}
        return pa.table({k: np.concatenate([np.zeros(0, kinds[k]), *v]) for k, v in found.items()})

    return run


def _kept(window: int, anchor: int, carry: list[str], schema: pa.Schema):
    def run(key, texts: pa.Table, repeated: pa.Table) -> Iterator[pa.RecordBatch]:
        """Each text without the words that a repeated window covers."""
        numbers = w.WordNumbers()
        known = np.sort(repeated.column("window").to_numpy().view(np.uint64))
        for batch in w.blocks(texts.to_batches(), "_packed", w.BLOCK_BYTES // 2):
            whole = w.opened(batch)
            split, ends, starts, _, _, keys = _windows([t or b"" for t in whole], window, anchor, numbers)
            cover = np.zeros(int(ends[-1]) + 1, np.int32)
            if len(known) and len(starts):
                hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
                np.add.at(cover, starts[hit], 1)
                np.add.at(cover, starts[hit] + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept, counts, spans = [], [], []
            for words, a, b in zip(split, ends[:-1], ends[1:]):
                mask = gone[a:b]
                n = int(mask.sum())
                counts.append(n)
                kept.append(b" ".join(words if not n else [x for x, g in zip(words, mask.tolist()) if not g]).decode())
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist() if n else []
                spans.append([{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2])])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                *(batch.column(c) if c != "text" else pa.array(whole, pa.binary()).cast(pa.string()) for c in carry), pa.array([len(x) for x in split], pa.int64()),
                pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.string()),
            ], schema=schema)

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, carry: tuple[str, ...] = (),
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """`(doc_id, carried columns, n_words, n_removed, spans, kept_text)` for each row of `docs(doc_id, text)`.

    Seed: of every `window` consecutive words the lowest-numbered run of `anchor` words is the anchor, so two equal
    windows have the same anchor at the same place. Anchors that occur twice in the corpus are kept. Extend: the
    windows that hold a repeated anchor, from as far left to as far right of it as a window reaches, are counted over
    the corpus; overlapping repeated windows join into maximal repeats (`spans` in words). No pair of places is ever
    written: a passage in a third of all rows adds a number to a count. Windows are counted by 95 bits (of window and
    anchor), and found again in their chunk by 64.

    Nulls and texts shorter than a window: nothing is removed (null: no words, empty `kept_text`). Repeated rows remove
    each other's words, also with equal or null doc_id. Columns that are not carried are not read. An empty table gives
    an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(dict.fromkeys(("doc_id", "text", *carry)))
    docs = chunked(docs.select(*columns), chunk_bytes)
    seeds = cut(docs.select("text", "_chunk").mapInArrow(_seeds(window, anchor), "seed long, _chunk int"), "seeds")
    twice = seeds.groupBy("seed").count().where("count > 1").select("seed")
    per_chunk = seeds.join(twice, "seed", "left_semi").distinct()
    crossing = T.StructType([*(docs.schema[c] for c in columns if c != "text"), docs.schema["_chunk"], T.StructField("_packed", T.BinaryType())])
    texts = docs.select(*columns, "_chunk").mapInArrow(w.packed, crossing)
    bare = T.StructType([docs.schema["_chunk"], T.StructField("_packed", T.BinaryType())])
    windows = cut(
        docs.select("text", "_chunk").mapInArrow(w.packed, bare).groupBy("_chunk").cogroup(per_chunk.groupBy("_chunk"))
        .applyInArrow(_extended(window, anchor), "window long, seed int, _chunk int, n int"), "windows",
    )
    repeated = windows.groupBy("window", "seed").agg(F.sum("n").alias("n")).where("n > 1").select("window", "seed")
    back = windows.join(repeated, ["window", "seed"], "left_semi").select("_chunk", "window")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    out = T.StructType([
        docs.schema["doc_id"], *(docs.schema[c] for c in carry), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept_text", T.StringType()),
    ])
    return texts.groupBy("_chunk").cogroup(back.groupBy("_chunk")).applyInArrow(
        _table_of(_kept(window, anchor, list(carry), to_arrow_schema(out))), out
    )


def _table_of(blocks):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(list(blocks(key, left, right)))
        w.trim()
        return out

    return run
