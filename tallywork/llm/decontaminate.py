"""Benchmark decontamination: each shard's words in an FM-index, benchmark phrases searched backwards in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as w
from .fm_index import FMIndex

PHRASE_WORDS = 10
QUERY_BYTES = 4 << 20  # benchmark text searched in one go; more than that is searched in several goes
SHARD_BYTES = 4 << 20  # text behind one index
# Words are runs of letters, digits and non-ASCII bytes.
_BREAKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def item_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_BREAKS).split()


@dataclass
class Phrases:
    """The distinct phrases of one go, by length: word numbers, and the items of each phrase."""

    vocabulary: dict[bytes, int]
    by_length: list[tuple[np.ndarray, list[list[str]]]]
    shortest: int


def phrases(items: list[tuple[str, str | None]]) -> Phrases | None:
    """Windows of PHRASE_WORDS words of each item; a shorter item is one phrase, one without words none."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        known = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in item_words((text or "").encode())]
        size = min(len(known), PHRASE_WORDS)
        for k in range(len(known) - size + 1 if size else 0):
            owners.setdefault(size, {}).setdefault(tuple(known[k:k + size]), set()).add(item)
    if not owners:
        return None
    by_length = [(np.array(list(own), np.int64), [sorted(x) for x in own.values()]) for _, own in sorted(owners.items())]
    return Phrases(vocabulary, by_length, min(owners))


def _goes(benchmark: DataFrame, limit: int) -> list[list[tuple[str, str | None]]]:
    """Benchmark items in goes of at most `limit` bytes (one item at least). The driver holds one go at a time while it
    makes the phrases; items come one by one."""
    out, go, size = [], [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL").toLocalIterator():
        add = len((text or "").encode())
        if go and size + add > limit:
            out.append(go)
            go, size = [], 0
        go.append((item, text))
        size += add
    return out + [go] if go else out


def _search(phrases: Phrases, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document its spans of hit words and the items behind them.

    A phrase lies inside one run of words that all occur in the benchmark, so the shard's index holds those runs that
    are at least as long as the shortest phrase, with a break between any two.
    """
    ends = w.bounds([len(words) for words in documents])
    known = phrases.vocabulary
    values = np.fromiter((known.get(x, 0) for words in documents for x in words), np.int64, int(ends[-1]))
    inside = np.concatenate(([0], (values > 0).astype(np.int8), [0]))
    step = np.flatnonzero(np.diff(inside))
    starts, stops = step[::2], step[1::2]
    cuts = ends[1:-1][np.isin(ends[1:-1], np.concatenate((starts, stops)), invert=True)] if len(starts) else ends[:0]
    cuts = cuts[values[np.minimum(cuts, len(values) - 1)] > 0] if len(cuts) and len(values) else cuts[:0]
    starts, stops = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((stops, cuts)))
    long = stops - starts >= phrases.shortest
    starts, stops = starts[long], stops[long]
    out: list = [([], []) for _ in documents]
    if not len(starts):
        return out
    size = stops - starts
    base = w.bounds((size + 1).tolist())[:-1]
    origin = np.repeat(starts - base, size + 1) + np.arange(int((size + 1).sum()))
    text = np.where(origin < np.repeat(stops, size + 1), values[np.minimum(origin, len(values) - 1)], 0)
    index = FMIndex(text)
    cover = np.zeros(len(values) + 1, np.int32)
    owners: dict[int, set] = {}
    for rows, items in phrases.by_length:
        low, high = index.ranges(rows)
        n = high - low
        if not n.any():
            continue
        phrase = np.repeat(np.arange(len(rows)), n)
        ranks = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        at = origin[index.places(ranks)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + rows.shape[1], -1)
        owner = np.searchsorted(ends, at, side="right") - 1
        for pair in np.unique(owner * len(rows) + phrase).tolist():
            owners.setdefault(pair // len(rows), set()).update(items[pair % len(rows)])
    hit = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
    for d, items in owners.items():
        a, b = int(ends[d]), int(ends[d + 1])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a + 1:b + 1], [0])))).tolist()
        out[d] = (list(zip(edge[::2], edge[1::2])), sorted(items))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    if not spans:
        return text
    places, out, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[last:places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, text[last:]])


def _pass(go: Phrases, schema: pa.Schema, carry: list[str], final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, limit=SHARD_BYTES):
            texts = w.texts(batch)
            split = [item_words(text) for text in texts]
            found = _search(go, split) if go is not None else [([], []) for _ in split]
            spans, items = [], []
            earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for (new_spans, new_items), (old_spans, old_items) in zip(found, earlier):
                spans.append(_merged(new_spans + [(s["start"], s["stop"]) for s in old_spans or ()]))
                items.append(sorted({*new_items, *(old_items or ())}))
            there = batch.column("text").is_valid().to_pylist()
            clean = [without(text, s).decode() if ok and final else None for ok, text, s in zip(there, texts, spans)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text"), *(batch.column(c) for c in carry),
                pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], schema.field("spans").type),
                pa.array(items, pa.list_(pa.string())), pa.array([len(x) for x in split], pa.int64()),
                pa.array(clean, pa.string()),
            ], schema=schema)

    return w.released(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = (), query_bytes: int = QUERY_BYTES) -> DataFrame:
    """`(doc_id, carried columns, n_words, n_hit, spans, items, contaminated, clean_text)` for each row of
    `docs(doc_id, text)` against `benchmark(item_id, text)`.

    Each shard of documents, at most SHARD_BYTES of text or one long document, is indexed and searched for every
    phrase in the task that reads it; nothing is shuffled. `spans` are merged runs of hit words, `items` the ids of
    items with an occurring phrase as sorted strings, `clean_text` the text without the spans. Phrases travel with the
    tasks in goes of `query_bytes`; a larger benchmark takes further passes over the documents.

    Nulls: a null text has no words and stays null; an item without id, or without words, has no phrase. Repeated items
    count once for each id. An empty table of documents gives an empty result; without items nothing is hit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([
        docs.schema["doc_id"], docs.schema["text"], *(docs.schema[c] for c in carry), T.StructField("spans", HITS),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType()),
        T.StructField("clean_text", T.StringType()),
    ])
    arrow = to_arrow_schema(out)
    now = docs.select("doc_id", "text", *carry).withColumns({
        "spans": F.lit(None).cast(HITS), "items": F.lit(None).cast("array<string>"),
    })
    goes = [phrases(go) for go in _goes(benchmark, query_bytes)] or [None]
    for k, go in enumerate(goes):
        now = now.mapInArrow(_pass(go, arrow, list(carry), k + 1 == len(goes)), out)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return now.select(
        "doc_id", *carry, "n_words", n_hit.alias("n_hit"), "spans", "items", (n_hit > 0).alias("contaminated"), "clean_text"
    )
