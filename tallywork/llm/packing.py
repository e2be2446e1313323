"""Packing by minimum bin slack: a bitset of reachable sums picks the remainders that fill each window closest."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import cut
from . import words as w

CAPACITY = 2048
END_ID = 1
GROUP_ITEMS = 4096  # remainders packed together
TASKS_A_GROUP = 1024  # tasks whose last remainders, less than a window each, are packed together
BLOCK_BYTES = 4 << 20  # text encoded in one go; a longer one is encoded in stretches of about this size
TOKENIZER = "word_bpe_49k.json"
KNOWN_BYTES = 48 << 20  # of words and their ids that a task remembers
_TAIL = r"(?s)^(.*[a-z0-9])([!-&(-/:-@\[-`{-~]+)$"  # ASCII signs but the apostrophe
_LETTERS = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"  # one letter each, composed as they stand
# Fixed value: the steps before byte pairs of a vocabulary whose texts can be encoded word by word.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}

_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECES = T.StructType([T.StructField(name, T.LongType()) for name in _COLUMNS])
_ARROW = pa.schema([(name, pa.int64()) for name in _COLUMNS])
_LEFT = pa.schema([*_ARROW, ("_task", pa.int64()), ("_ids", pa.binary())])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """Token ids of whole texts by way of the ids of their words, where the vocabulary lower-cases and splits at white
    space, and between a letter or digit and the signs behind it, before anything else (its steps are compared with
    `_STEPS`): the ids of a text are those of its words in a row, and those of a word are those of its core and its tail. Words
    that spell a special token are not split. Words are told apart, looked up and split as Arrow columns; what was
    met before is remembered, up to KNOWN_BYTES. Texts for any other vocabulary are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores; threads of a task only take memory
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        special = [x["content"] for x in model["added_tokens"]]
        self.by_word = all(model[k] == v for k, v in _STEPS.items()) and all("<|" in x and not any(c.isspace() for c in x) for x in special)
        if self.by_word:
            # The same vocabulary for parts that need no other step than the bytes' spelling: many parts in one call.
            spelling = model["pre_tokenizer"]["pretokenizers"][-1]
            self.plain = Tokenizer.from_str(json.dumps(model | {"normalizer": None, "pre_tokenizer": spelling, "added_tokens": []}))
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _held(self) -> int:
        return self.known.nbytes + self.pool.nbytes + self.starts.nbytes + self.sizes.nbytes

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used:self.used + len(ids)] = ids
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(ids)

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of words among the known ones, and whether they are there."""
        at = pc.index_in(words, value_set=self.known)
        return pc.fill_null(at, 0).to_numpy().astype(np.int64), pc.is_valid(at).to_numpy(zero_copy_only=False)

    def _coded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts in a row, and how many each has."""
        letters = pc.match_substring_regex(parts, _LETTERS)
        is_letters = letters.to_numpy(zero_copy_only=False)
        sizes, flat = np.zeros(len(parts), np.int64), []
        lowered = pc.utf8_lower(parts.filter(letters)).to_pylist()
        if lowered:
            coded = self.plain.encode(lowered, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(coded.ids, np.uint32))
            sizes[is_letters] = np.bincount(np.array(coded.word_ids), minlength=len(lowered))
        others = self.tokenizer.encode_batch_fast(parts.filter(pc.invert(letters)).to_pylist(), add_special_tokens=False)
        ids = [x.ids for x in others]
        sizes[~is_letters] = [len(x) for x in ids]
        flat.append(np.array([x for own in ids for x in own], np.uint32))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[np.concatenate([_ranges(starts[x], sizes[x]) for x in ([is_letters, ~is_letters] if lowered else [~is_letters])])] = np.concatenate(flat)
        return out, sizes

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """The places of distinct new words; their parts become known as well."""
        tailed = pc.and_(pc.match_substring_regex(fresh, _TAIL), pc.invert(pc.match_substring(fresh, "<|")))
        split, is_split = fresh.filter(tailed), tailed.to_numpy(zero_copy_only=False)
        pieces = [pc.replace_substring_regex(split, _TAIL, part) for part in (r"\1", r"\2")]
        parts = pa.concat_arrays([fresh.filter(pc.invert(tailed)), *pieces]).dictionary_encode()
        place, there = self._places(parts.dictionary)
        place[~there] = len(self.known) + np.arange(int((~there).sum()))
        new = parts.dictionary.filter(pa.array(~there))
        self._add(new, *self._coded(new))
        at = place[parts.indices.to_numpy(zero_copy_only=False)]
        whole, core, tail = np.split(at, [len(at) - 2 * len(split), len(at) - len(split)])
        out = np.empty(len(fresh), np.int64)
        out[~is_split], out[is_split] = whole, len(self.known) + np.arange(len(split))
        both = np.stack((core, tail), axis=1).ravel()
        self._add(split, self.pool[_ranges(self.starts[both], self.sizes[both])], self.sizes[core] + self.sizes[tail])
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for own in ids for x in own], np.uint32), w.bounds([len(x) for x in ids])
        if self._held() > KNOWN_BYTES:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        at, there = self._places(words.dictionary)
        if not there.all():
            at[~there] = self._learn(words.dictionary.filter(pa.array(~there)))
        places = at[words.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[places]
        ends = w.bounds(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return self.pool[_ranges(self.starts[places], sizes)], w.bounds(sizes)[ends]


def stretches(text: bytes, limit: int) -> Iterator[str]:
    """A long text in stretches of about `limit` bytes, cut in front of white space."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, min(len(text), start + limit))
        end = gap.start() if gap else len(text)
        yield text[start:end].decode()
        start = end


_GAP = re.compile(rb"[ \t-\r]")


def closest_fill(counts: dict[int, int], gap: int) -> dict[int, int]:
    """How many of each length fill `gap` best without passing it: subset sums as bits of a whole number, stopped once
    the gap itself is reachable, and the counts read backwards from the highest sum."""
    mask, reach, steps = (1 << gap + 1) - 1, 1, []
    for length in sorted((n for n in counts if n <= gap), reverse=True):
        left, batch = min(counts[length], gap // length), 1
        while left:  # 1, 2, 4, ... copies and the rest: every number of copies is a sum of these
            take = min(batch, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, batch = left - take, batch * 2
        if reach >> gap & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            out[length] = out.get(length, 0) + take
            target -= length * take
    return out


def powers(length: int) -> list[int]:
    """The powers of two that add up to `length`, largest first."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


def full_windows(lengths: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of `(item, start, length)` for items of 1 to capacity - 1 tokens, and what is left of the items, less
    than a window in all, longest first.

    The longest item left opens a window, the best-fitting multiset of the rest fills it. A gap that no multiset closes
    is closed by cutting the head off the shortest item that is long enough.
    """
    stacks: dict[int, list[tuple[int, int]]] = {}
    for item, length in enumerate(lengths):
        stacks.setdefault(length, []).append((item, 0))
    left, out = sum(lengths), []

    def take(length: int) -> tuple[int, int]:
        got = stacks[length].pop()
        if not stacks[length]:
            del stacks[length]
        return got

    while left >= capacity:
        longest = max(stacks)
        item, start = take(longest)
        window, gap = [(item, start, longest)], capacity - longest
        for length, n in closest_fill({n: len(s) for n, s in stacks.items()}, gap).items():
            for _ in range(n):
                window.append((*take(length), length))
                gap -= length
        if gap:
            length = min(n for n in stacks if n > gap)
            item, start = take(length)
            window.append((item, start, gap))
            stacks.setdefault(length - gap, []).append((item, start + gap))
        out.append(window)
        left -= capacity
    return out, [(item, start, length) for length in sorted(stacks, reverse=True) for item, start in stacks[length]]


def short_windows(left: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Windows of power-of-two length that hold what is left."""
    room, window, out = powers(sum(x[2] for x in left)), [], []
    for item, start, rest in left:
        while rest:
            fits = min(rest, room[0] - sum(x[2] for x in window))
            window.append((item, start, fits))
            start, rest = start + fits, rest - fits
            if sum(x[2] for x in window) == room[0]:
                out.append(window)
                window = []
                room.pop(0)
    return out


def windows(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows that hold all items, none with padding: full ones, then short ones for what is left."""
    out, left = full_windows(lengths, capacity)
    return out + short_windows(left)


class _Rows:
    """Pieces of windows, numbered from `sequence` on."""

    def __init__(self, sequence: int):
        self.sequence, self.rows = sequence, []

    def window(self, pieces) -> None:
        """`pieces`: (doc_id, first token, tokens of the document, ids) in the order of the window."""
        offset = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def columns(self) -> list[pa.Array]:
        out = [pa.array(c, pa.int64()) for c in (zip(*self.rows) if self.rows else [[]] * len(_COLUMNS))]
        self.rows = []
        return out


def _closed(held: list[tuple], rows: _Rows, capacity: int) -> list[tuple]:
    """Packs remainders `(doc_id, first token, tokens of the document, ids)` into full windows; gives back what is left."""
    def part(item: int, start: int, length: int) -> tuple:
        doc, first, total, ids = held[item]
        return doc, first + start, total, ids[start:start + length]

    full, left = full_windows([len(x[3]) for x in held], capacity)
    for window in full:
        rows.window([part(*x) for x in window])
    return [part(*x) for x in left]


def _packed(path: str, capacity: int, group: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode, rows, held = WordIds(path), _Rows(task << 40), []

        def documents(batch: pa.RecordBatch) -> Iterator[tuple]:
            """Ids of the documents of a batch, a long one in stretches: (row, ids, whether the document ends)."""
            text = batch.column("text")
            if batch.num_rows == 1 and text.nbytes > 2 * BLOCK_BYTES and encode.by_word:
                for some in stretches(w.texts(batch)[0], BLOCK_BYTES):
                    yield 0, encode(pa.array([some]))[0], False
                yield 0, np.array([end_id], np.uint32), True
            else:
                ids, ends = encode(text)
                for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    yield row, np.append(ids[a:b], np.uint32(end_id)), True

        def out() -> pa.RecordBatch:
            columns = rows.columns()
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_LEFT)

        for batch in w.blocks(batches, limit=BLOCK_BYTES):
            doc_ids = batch.column("doc_id").to_pylist()
            full, rest, done = [], np.zeros(0, np.uint32), 0
            for row, ids, ends in documents(batch):
                ids = np.concatenate((rest, ids)) if len(rest) else ids
                whole = len(ids) // capacity * capacity
                full += [(done + x, zlib.crc32(np.ascontiguousarray(ids[x:x + capacity], "<u4"))) for x in range(0, whole, capacity)]
                rest, done = ids[whole:], done + whole
                if ends:
                    total = done + len(rest)
                    for start, crc in full:
                        rows.rows.append((doc_ids[row], start, capacity, crc, total, rows.sequence, 0))
                        rows.sequence += 1
                    if len(rest):
                        held.append((doc_ids[row], done, total, rest.copy()))
                    if len(held) >= group:
                        held = _closed(held, rows, capacity)
                    full, rest, done = [], np.zeros(0, np.uint32), 0
            yield out()
        held = _closed(held, rows, capacity)
        yield out()
        left = [(doc, start, len(ids), 0, total, None, None, task, ids.astype("<u4").tobytes()) for doc, start, total, ids in held]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*left), _LEFT)], schema=_LEFT)

    return w.released(run)


def _last(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Packs what the tasks of a group had left, in the order of the tasks."""
        table = table.sort_by([("_task", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        rows = _Rows(1 << 62 | key[0].as_py() << 40)
        held = [
            (*x, np.frombuffer(ids, "<u4"))
            for *x, ids in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "_ids")))
        ]
        held = _closed(held, rows, capacity)
        for window in short_windows([(item, 0, len(x[3])) for item, x in enumerate(held)]):
            rows.window([(*held[item][:1], held[item][1] + start, held[item][2], held[item][3][start:start + n]) for item, start, n in window])
        return pa.Table.from_arrays(rows.columns(), schema=_ARROW)

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP_ITEMS, end_id: int = END_ID,
    tasks_a_group: int = TASKS_A_GROUP,
) -> DataFrame:
    """The pieces `PIECES` of all rows of `docs(doc_id, text)`; `tokenizer` is the path of the vocabulary file, the same
    on all machines.

    Every task packs what it reads: full windows are cut off each document, remainders wait in groups of `group` and are
    packed by minimum bin slack; what fills no window goes on to the next group. Of each task less than one window is left. These rests
    (places and ids) of `tasks_a_group` tasks meet in one more exchange and are packed in the same way; only what is left then is laid in
    windows of power-of-two length, at most one for each bit of the capacity.

    Nulls: a null text is empty, an empty text is its end id alone, a null doc_id stays null. Repeated rows are packed
    each for itself. Ties: of items of one length the last one read is taken first. A very long text is encoded in
    stretches and cut into windows as it goes. Other columns are not read. An empty table gives no pieces.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    schema = T.StructType([*PIECES, T.StructField("_task", T.LongType()), T.StructField("_ids", T.BinaryType())])
    packed = cut(rows.mapInArrow(_packed(tokenizer, capacity, group, end_id), schema), "packed")
    left = packed.where("_task is not null").withColumn("_group", F.expr(f"_task div {tasks_a_group}"))
    last = left.groupBy("_group").applyInArrow(_last(capacity), PIECES)
    return packed.where("_task is null").select(*_COLUMNS).unionByName(last)
