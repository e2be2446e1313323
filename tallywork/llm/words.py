"""Words of whole texts as 64-bit numbers, in blocks that fit a Python worker."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

BLOCK_BYTES = 4 << 20  # text per numpy block inside a task
CACHE_WORDS = 200_000  # words a task remembers before it starts anew
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordNumbers(dict):
    """Word (bytes) to its 64-bit number; forgets everything once it holds CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text each (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch | pa.Table, column: str = "text") -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [b"" if text is None else text for text in batch.column(column).cast(pa.binary()).to_pylist()]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with each text compressed on its own, in a binary column `_packed`: for texts that are to be
    shuffled, which takes the most room of all. `opened` gives the texts back."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in blocks(batches):
        small = [None if text is None else press.compress(text) for text in batch.column("text").cast(pa.binary()).to_pylist()]
        rest = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(small, pa.binary())], names=[*rest, "_packed"])


def opened(batch: pa.RecordBatch) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if data is None else press.decompress(data) for data in batch.column("_packed").to_pylist()]


def released(run):
    """The iterator function `run`, with the memory of its task handed back to the system when it ends: Python workers go on
    to other tasks and stages, and what each of them left would add up."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def hand_back() -> None:
    gc.collect()
    trim()


def trim() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        own = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if own is not None:
            own(0)


def bounds(counts: list[int]) -> np.ndarray:
    """Start of each text in the joined word array, and its end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def numbers(documents: list[list[bytes]], known: WordNumbers) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all documents in one array, and the documents' bounds in it."""
    ends = bounds([len(words) for words in documents])
    out = np.fromiter((known[w] for words in documents for w in words), np.uint64, int(ends[-1]))
    return out, ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (xor-shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """A number for each n consecutive values (polynomial, built by doubling)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out, length, part, size, rest = None, 0, values, 1, n
    while rest:
        if rest & 1:
            if out is None:
                out, length = part, size
            else:  # `part` stands before `out`: shift it by the length so far
                k = len(values) - length - size + 1
                out, length = part[:k] * _power(length) + out[size:size + k], length + size
        rest >>= 1
        if rest:
            k = len(values) - 2 * size + 1
            part, size = part[:k] * _power(size) + part[size:size + k], 2 * size
    return mixed(out + np.uint64(n))


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the lowest value in each stretch of `width` values; the leftmost of equals."""
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        k = len(low) - step
        left = low[:k] <= low[step:]
        at = np.where(left, at[:k], at[step:])
        low = np.minimum(low[:k], low[step:])
        have += step
    return at


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
