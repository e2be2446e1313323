"""A full-text index of a word sequence: suffix order, Burrows-Wheeler words in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order, by doubling; only places still tied are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: first place of the equal ones
    step = 1
    while not new.all():
        same = ~new
        tied = same | np.concatenate((same[1:], [False]))
        at = np.flatnonzero(tied)
        where = order[at]
        ahead = where + step
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[where]
        again = np.lexsort((key, group))
        order[at] = where[again]
        group, key = group[again], key[again]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        new[at] = fresh
        step *= 2
    return order


class Wavelet:
    """Counts of a symbol before a place, and the symbol at a place, over a bit matrix with one level for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        rest = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (rest >> bit) & 1
            before = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(rest) - int(before[-1])))
            rest = rest[np.argsort(ones, kind="stable")]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            start = np.where(one, zeros + before[start], start - before[start])
            place = np.where(one, zeros + before[place], place - before[place])
        return place - start

    def at(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for bit, before, zeros in self.levels:
            one = before[place + 1] > before[place]
            symbol |= one.astype(symbol.dtype) << bit
            place = np.where(one, zeros + before[place], place - before[place])
        return symbol


class FMIndex:
    """Index of `symbols` (0 or more each); the end of the sequence is added as a symbol below all others."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate((symbols.astype(np.int64) + 1, [0]))
        order = suffix_order(text)
        size = int(text.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.wavelet = Wavelet(text[order - 1], max(1, (size - 1).bit_length()))
        sampled = order % SAMPLE_EVERY == 0
        self.sampled, self.samples = sampled, order[sampled]
        self.sample_no = np.concatenate(([0], np.cumsum(sampled)))
        self.size = size

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of `phrases` (equally long) at once: their ranges in the suffix order."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sampled), np.int64)
        open_rows = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[open_rows, column] + 1
            known = symbol < self.size
            low[open_rows[~known]] = high[open_rows[~known]] = 0
            open_rows, symbol = open_rows[known], symbol[known]
            both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low[open_rows], high[open_rows])))
            base = self.first[symbol]
            low[open_rows], high[open_rows] = base + both[:len(symbol)], base + both[len(symbol):]
            open_rows = open_rows[low[open_rows] < high[open_rows]]
            if not len(open_rows):
                break
        return low, np.maximum(high, low)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes given by their rank: step back until a sampled one is met."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, row = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.sampled[row]
            out[todo[done]] = self.samples[self.sample_no[row[done]]] + steps[todo[done]]
            todo, row = todo[~done], row[~done]
            if len(todo):
                symbol = self.wavelet.at(row)
                row = self.first[symbol] + self.wavelet.rank(symbol, row)
                steps[todo] += 1
        return out
