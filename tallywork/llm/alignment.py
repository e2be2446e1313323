"""Alignment of two tokenizers over the same bytes: covering tokens by merge_asof, overlaps, groups of equal ends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut
from . import words as w

CHUNK_BYTES = 64 << 20  # text whose id pairs are numbered together
CHUNK_PAIRS = 500_000  # distinct id pairs after which a chunk ends early
BATCH_BYTES = 2 << 20  # text aligned in one go
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
_SPACE = "▁"
# Fixed value: how a byte-level vocabulary splits texts before it merges bytes.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def spelled_bytes() -> dict[str, int]:
    """The characters in which byte-level vocabularies spell bytes: printable ones as they are, the others from U+0100 up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + k): byte for k, byte in enumerate(others)}


class ByteLevel:
    """Ids of a byte-level vocabulary file, strings of special tokens taken as plain text. Where ids rank the merges in
    order and texts are split in the usual way, which is checked, the ids come from the ranks; otherwise from the file's
    own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before, special = whole["model"], whole["pre_tokenizer"] or {}, {x["content"] for x in whole["added_tokens"]}
        to_byte = spelled_bytes()
        self.bytes = [b""] * (1 + max([*model["vocab"].values(), *(x["id"] for x in whole["added_tokens"])]))
        for piece, id_ in model["vocab"].items():
            self.bytes[id_] = piece.encode() if piece in special else bytes(to_byte[c] for c in piece)
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ranked = [model["vocab"].get("".join(x)) for x in merges] == list(range(256, 256 + len(merges)))
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if ranked and usual and not whole["normalizer"] and not model.get("ignore_merges"):
            import tiktoken

            ranks = {text: id_ for id_, text in enumerate(self.bytes[:256 + len(merges)])}
            ranked_ids = tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [ranked_ids.encode_ordinary(" " + text) for text in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [
                x.ids for x in own.encode_batch_fast([" " + text for text in texts], add_special_tokens=False)
            ]


class Pieces:
    """Ids of a piece vocabulary file, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace(_SPACE, " ").encode()
            for k in range(own.get_piece_size())
        ]
        self.encode = lambda texts: own.encode(texts, num_threads=1)


def tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def _ranges(ids: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    """Tokens of all texts with the byte range of each in the joined texts."""
    count = [len(x) for x in ids]
    token = np.fromiter(chain.from_iterable(ids), np.int64, sum(count))
    end = np.cumsum(sizes[token])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), count), "id": token, "start": end - sizes[token], "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in `a` and `b` of all pairs of tokens whose byte ranges overlap, and how many of them come from a start in `a`.

    Of two overlapping tokens one starts inside the other or both start together: the token of `b` over each start in `a`,
    and the token of `a` over each start in `b` that is no start in `a`, are all pairs, each once. Starts are places in
    the joined texts, so they are sorted, and looked up by document."""
    left, right = a[["doc", "start"]].assign(_a=np.arange(len(a))), b[["doc", "start"]].assign(_b=np.arange(len(b)))
    over_a = pd.merge_asof(left, right, on="start", by="doc")
    over_b = pd.merge_asof(right, left.assign(_at=left["start"]), on="start", by="doc")
    over_b = over_b[over_b["_at"] != over_b["start"]]
    return (
        np.concatenate((over_a["_a"], over_b["_a"])), np.concatenate((over_a["_b"], over_b["_b"])),
        np.concatenate((over_a["doc"], over_b["doc"])),
    )


class _Spelled:
    """Decimal ids with what stands behind them in a group: a comma, the bar, a semicolon, nothing."""

    def __init__(self, ids: int):
        self.table = [b"%d%s" % (k, end) for k in range(ids) for end in (b",", b"|", b";", b"")]

    def __call__(self, a: pd.DataFrame, b: pd.DataFrame, last_a: np.ndarray, last_b: np.ndarray, docs: int):
        """The groups of each document as text, and how many there are. `last_a`, `last_b`: whether a token ends a group."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        first_b = np.concatenate(([0], np.flatnonzero(last_b) + 1))  # of each group
        behind_a = np.concatenate((np.flatnonzero(last_a) + 1, [len(a)]))
        doc_b = b["doc"].to_numpy()
        ends_doc = np.concatenate((doc_b[1:] != doc_b[:-1], [True])) if len(b) else np.zeros(0, bool)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + first_b[group_a]] = a["id"].to_numpy() * 4 + last_a
        code[np.arange(len(b)) + behind_a[group_b]] = b["id"].to_numpy() * 4 + np.where(ends_doc, 3, 2 * last_b)
        n_groups = np.bincount(doc_b[last_b], minlength=docs)
        ends = w.bounds(np.bincount(a["doc"], minlength=docs) + np.bincount(doc_b, minlength=docs)).tolist()
        return [b"".join(map(self.table.__getitem__, code[x:y].tolist())) for x, y in zip(ends[:-1], ends[1:])], n_groups


def _shut(places: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(places.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_OUT = "_chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, _places binary, " \
       "_place long, a long, b long, n long"
_KINDS = {"groups": pa.string(), "_places": pa.binary()}
_ARROW = pa.schema([(x.split()[0], _KINDS.get(x.split()[0], pa.int64())) for x in _OUT.split(", ")])


def _tokenized(batch: pa.RecordBatch, one, other) -> tuple[np.ndarray, list, list]:
    """Rows of the batch whose tokens spell the text, and their ids on both sides."""
    raw = w.texts(batch)
    rows = [k for k, text in enumerate(raw) if text]
    texts = [raw[k].decode("utf-8", "replace") for k in rows]
    ids = list(zip(rows, one.encode(texts), other.encode(texts)))
    spell_a, spell_b = one.bytes.__getitem__, other.bytes.__getitem__
    ids = [
        (k, x, y) for k, x, y in ids
        if b"".join(map(spell_a, x)) == (whole := b" " + raw[k]) and b"".join(map(spell_b, y)) == whole
    ]
    return np.array([k for k, _, _ in ids], np.int64), [x for _, x, _ in ids], [y for _, _, y in ids]


def _aligned(path_a: str, path_b: str, digest: bool, limit: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = tokenizer(path_a), tokenizer(path_b)
        sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (one, other)]
        spelled, width = _Spelled(max(map(len, sizes))), len(sizes[1])
        chunk, held, known, times = TaskContext.get().partitionId() << 24, 0, {}, np.zeros(0, np.int64)

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW
            )

        def pairs() -> Iterator[pa.RecordBatch]:
            code = np.fromiter(known, np.int64, len(known))
            for x in range(0, len(code), 100_000):
                part = code[x:x + 100_000]
                yield rows(
                    _chunk=np.full(len(part), chunk), _place=np.arange(x, x + len(part)), a=part // width, b=part % width,
                    n=times[x:x + len(part)],
                )

        for batch in w.blocks(batches, limit=BATCH_BYTES):
            at, ids_a, ids_b = _tokenized(batch, one, other)
            a, b = _ranges(ids_a, sizes[0]), _ranges(ids_b, sizes[1])
            end_a, end_b = a["end"].to_numpy(), b["end"].to_numpy()
            meets = np.searchsorted(end_b, end_a)  # both texts end at the same byte, so every place is inside
            last_a = end_b[meets] == end_a
            last_b = np.zeros(len(b), bool)
            last_b[meets[last_a]] = True
            texts, n_groups = spelled(a, b, last_a, last_b, len(at))
            place_a, place_b, doc = overlaps(a, b)
            number, code = pd.factorize(a["id"].to_numpy()[place_a] * width + b["id"].to_numpy()[place_b])
            found = np.fromiter((known.setdefault(x, len(known)) for x in code.tolist()), np.int64, len(code))
            times = np.concatenate((times, np.zeros(len(known) - len(times), np.int64)))
            times[found] += np.bincount(number, minlength=len(code))
            order = np.argsort(doc, kind="stable")
            linked, n_links = found[number[order]], np.bincount(doc, minlength=len(at))
            ends = w.bounds(n_links).tolist()
            whole = {k: np.zeros(batch.num_rows, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
            for name, values in zip(whole, (
                np.bincount(a["doc"], minlength=len(at)), np.bincount(b["doc"], minlength=len(at)), n_groups, n_links,
            )):
                whole[name][at] = values
            groups, places = [""] * batch.num_rows, [None] * batch.num_rows
            for k, text, x, y in zip(at.tolist(), texts, ends[:-1], ends[1:]):
                groups[k] = hashlib.sha256(text).hexdigest() if digest else text.decode()
                places[k] = _shut(linked[x:y])
            yield rows(
                _chunk=np.full(batch.num_rows, chunk), doc_id=batch.column("doc_id"), groups=groups, _places=places, **whole
            )
            held += batch.column("text").nbytes
            if held >= limit or len(known) >= most:
                yield from pairs()
                chunk, held, known, times = chunk + 1, 0, {}, np.zeros(0, np.int64)
        yield from pairs()

    return run


_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_RESULT = ", ".join(f"{x} long" for x in _COLUMNS) + ", groups string, n_best long, count_sum long"


def _counted(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The links of each document with the counts of their pairs, of one chunk."""
    size = pairs.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = pairs.column("_place").to_numpy()
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for data in docs.column("_places"):
        at = _opened(data.as_py()) if data.is_valid else np.zeros(0, np.int64)
        sums.append((int(best[at].sum()), int(count[at].sum())))
    n_best, count_sum = zip(*sums) if sums else ((), ())
    return docs.select([*_COLUMNS, "groups"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64())
    )


def align(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, chunk_bytes: int = CHUNK_BYTES, chunk_pairs: int = CHUNK_PAIRS
) -> DataFrame:
    """`(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)` for each row of `docs(doc_id, text)`; the paths
    are those of the vocabulary files on all machines. `groups` is `a1,a2|b1;a3|b2`, ids in order, cut where tokens of both
    sides end; with `digest` its SHA-256.

    Every task tokenizes what it reads and aligns it in batches. A link is kept as the number of its id pair inside its
    chunk of text; a chunk ends at `chunk_bytes` or at `chunk_pairs` pairs. Counts of pairs are summed over all chunks, the
    highest of each B id is joined to them (an id has no more pairs than the other side has ids), and they go back to
    their chunks by a join on the pair; no task holds more than the links of a chunk.

    Nulls: a null or empty text has no tokens, nor has one whose tokens spell other bytes than a space and the text;
    its counts are zero and `groups` is empty. A null doc_id stays null. Repeated rows count each; ties of the highest
    count are all best. A text longer than a batch is a batch of its own. Other columns are not read. An empty table
    gives an empty result."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    table = cut(rows.mapInArrow(_aligned(path_a, path_b, digest, chunk_bytes, chunk_pairs), _OUT), "aligned")
    entries = table.where("_place is not null").select("_chunk", "_place", "a", "b", "n")
    pairs = cut(entries.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = pairs.groupBy("b").agg(F.max("count").alias("_most"))
    judged = pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("_most")).cast("long").alias("best"))
    back = entries.join(judged, ["a", "b"]).select(F.col("_chunk").alias("_of"), "_place", "count", "best")
    own = table.where("_place is null").select("_chunk", *_COLUMNS, "groups", "_places")
    return own.groupBy("_chunk").cogroup(back.groupBy("_of")).applyInArrow(_counted, _RESULT)


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`(doc_id, a_place, b_place, a, b, start, length)`: every overlap of two tokens of a document, with the bytes they
    share, counted from the space before the text. Nulls and texts without tokens: as in `align`, no rows."""
    names = ("doc_id", "a_place", "b_place", "a", "b", "start", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = tokenizer(path_a), tokenizer(path_b)
        sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (one, other)]
        for batch in w.blocks(batches, limit=BATCH_BYTES):
            at, ids_a, ids_b = _tokenized(batch, one, other)
            a, b = _ranges(ids_a, sizes[0]), _ranges(ids_b, sizes[1])
            x, y, doc = overlaps(a, b)
            order = np.lexsort((y, x))
            x, y, doc = x[order], y[order], doc[order]
            first = [w.bounds(np.bincount(side["doc"], minlength=len(at)))[:-1] for side in (a, b)]
            begin = w.bounds([sum(sizes[0][k] for k in ids) for ids in ids_a])[:-1]
            start = np.maximum(a["start"].to_numpy()[x], b["start"].to_numpy()[y])
            length = np.minimum(a["end"].to_numpy()[x], b["end"].to_numpy()[y]) - start
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(at[doc])), *(pa.array(v, pa.int64()) for v in (
                    x - first[0][doc], y - first[1][doc], a["id"].to_numpy()[x], b["id"].to_numpy()[y], start - begin[doc], length,
                )),
            ], names=list(names))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))
