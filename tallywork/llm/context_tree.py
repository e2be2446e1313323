"""Context trees over byte contexts: binary decomposition, Krichevsky-Trofimov estimates, mixture over all depths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import mixed

DEPTH = 6
_DIGIT = 9  # bits of one byte of context (0: none); six of them and the coded byte fit in 62 bits


def slots(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """`context << 8 | byte` of each coded byte of texts given as words, and the texts' bounds in it. A text runs with one
    break behind each word and one more as its end, and starts behind two breaks that are not coded, as every end is.
    The context is what stands before, over all breaks, at most DEPTH bytes, the latest byte lowest."""
    whole = [b"  " + b" ".join([*words, b" "] if words else [b" "]) for words in texts]
    starts = np.zeros(len(whole) + 1, np.int64)
    np.cumsum([len(x) for x in whole], out=starts[1:])
    text = np.frombuffer(b"".join(whole), np.uint8).astype(np.int64)
    inside = np.arange(len(text)) - np.repeat(starts[:-1], np.diff(starts))
    context = np.zeros(len(text), np.int64)
    for k in range(DEPTH):
        context[k + 1:] |= np.where(inside[k + 1:] > k, text[:-k - 1] + 1 << _DIGIT * k, 0)
    coded = inside > 1
    return (context << 8 | text)[coded], starts - 2 * np.arange(len(starts))


def depth_of(context: np.ndarray) -> np.ndarray:
    return sum((context >> _DIGIT * k > 0).astype(np.int64) for k in range(DEPTH))


def shortened(context: np.ndarray, depth: int) -> np.ndarray:
    """The latest `depth` bytes of contexts."""
    return context & (1 << _DIGIT * depth) - 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.ones_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift * y, shift)
        y = np.where(small, y + 1, y)
    tail = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - np.log(shift)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth, sorted by `context << 8 | place in the byte's binary tree (1 to 255)`."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray  # log of the node's weighted probability
    own: np.ndarray  # share of the node's own estimate in its prediction; the rest is the deeper node's
    one: np.ndarray | None = None  # the root's probability of a one where this is the deepest node with data


def summed(node: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(node, kind="stable")
    node = node[order]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    return node[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def decisions(byte: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The eight binary decisions of each byte: place in the byte's tree, and the bit."""
    return [((1 << k) | (byte >> 8 - k), byte >> 7 - k & 1) for k in range(8)]


def level(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
    """Nodes with the summed weighted log probabilities of the nodes below them (nan: a leaf)."""
    estimate = log_estimate(zeros, ones)
    if below is None:
        return Level(node, zeros, ones, estimate, np.ones(len(node)))
    leaf = np.isnan(below)
    under = np.where(leaf, estimate, below)
    weighted = np.where(leaf, estimate, np.logaddexp(estimate, under) - np.log(2))
    own = np.where(leaf, 1.0, 1 / (1 + np.exp(np.clip(under - estimate, -700, 700))))
    return Level(node, zeros, ones, weighted, own)


def subtree(slot: np.ndarray, n: np.ndarray, top: int) -> dict[int, Level]:
    """Levels DEPTH down to `top` of the trees over the given slots (all with n > 0)."""
    context, byte = slot >> 8, slot & 255
    depth, n = depth_of(context), n.astype(np.float64)
    out: dict[int, Level] = {}
    for d in range(DEPTH, top - 1, -1):
        here = depth == d
        places = decisions(byte[here])
        node = np.concatenate([context[here] << 8 | at for at, _ in places]) if here.any() else np.zeros(0, np.int64)
        bit = np.concatenate([b for _, b in places]) if here.any() else node
        count = np.tile(n[here], 8)
        node, zeros, ones = summed(node, count * (bit == 0), count * (bit == 1))
        below = np.full(len(node), np.nan)
        if d < DEPTH and len(out[d + 1].node):
            deep = out[d + 1]
            up = shortened(deep.node >> 8, d) << 8 | deep.node & 255
            up, z, o, w = summed(up, deep.zeros, deep.ones, deep.weighted)
            node, zeros, ones = np.concatenate((node, up)), np.concatenate((zeros, z)), np.concatenate((ones, o))
            below = np.concatenate((below, w))
            order = np.argsort(node)
            node, zeros, ones, below = node[order], zeros[order], ones[order], below[order]
        out[d] = level(node, zeros, ones, below)
    return out


def find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Places:
    """Places of keys in a column of distinct ones, in any order: a hash table of half-empty 32-bit cells, next cell on a clash."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.cells = keys, np.full(1 << (2 * len(keys)).bit_length(), -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(todo):
            free = self.cells[at] < 0
            self.cells[at[free]] = todo[free]
            left = self.cells[at] != todo
            todo, at = todo[left], self._next(at[left])

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) & np.uint64(len(self.cells) - 1)).astype(np.int32)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & len(self.cells) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that is not there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(todo):
            found = self.cells[at]
            hit = (found >= 0) & (self.keys[found] == keys[todo])
            out[todo[hit]] = found[hit]
            on = (found >= 0) & ~hit
            todo, at = todo[on], self._next(at[on])
        return out


def _estimate(lv: Level) -> np.ndarray:
    return (lv.ones + 0.5) / (lv.zeros + lv.ones + 1.0)


@dataclass
class Top:
    """Depths 0 and 1 for all contexts, at most 255 and 257 * 255 nodes: what the root passes on below each node."""

    root_one: np.ndarray  # by place: the root's own estimate of a one
    node: np.ndarray
    one: np.ndarray
    passed: np.ndarray  # mixed in by depths 0 and 1
    weight: np.ndarray  # left for depth 2 and below


def top(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
    """From the nodes of depth 1 (`below`: as in level)."""
    order = np.argsort(node)
    first = level(node[order], zeros[order], ones[order], below[order])
    place, z, o, w = summed(first.node & 255, first.zeros, first.ones, first.weighted)
    root = level(place, z, o, w)
    root_one, root_own = np.full(256, 0.5), np.zeros(256)
    root_one[place], root_own[place] = _estimate(root), root.own
    at = first.node & 255
    passed, weight = root_own[at] * root_one[at], 1 - root_own[at]
    mine = _estimate(first)
    return Top(root_one, first.node, passed + weight * mine, passed + weight * first.own * mine, weight * (1 - first.own))


def log10_cost(slot: np.ndarray, n: np.ndarray, top: Top, start: int = 2) -> np.ndarray:
    """Log10 probability of the byte of each slot (n: its count in training, 0 if unseen) in its context; the slots
    must hold all those that share the latest `start` bytes."""
    seen = n > 0
    levels = subtree(slot[seen], n[seen], start)
    for d in range(start, DEPTH + 1):
        lv = levels[d]
        if d == start:
            up = shortened(lv.node >> 8, 1) << 8 | lv.node & 255
            at, there = find(top.node, up)
            passed, weight = top.passed[at], top.weight[at]
        else:
            up = shortened(lv.node >> 8, d - 1) << 8 | lv.node & 255
            at, there = find(levels[d - 1].node, up)
            passed, weight = above_passed[at], above_weight[at]
        if not there.all():
            raise ValueError("a context lacks its shorter one")
        mine = _estimate(lv)
        lv.one = passed + weight * mine
        above_passed, above_weight = passed + weight * lv.own * mine, weight * (1 - lv.own)
    context, total = slot >> 8, np.zeros(len(slot))
    for place, bit in decisions(slot & 255):
        one, todo = top.root_one[place], np.arange(len(slot))
        for d in range(DEPTH, 0, -1):
            key = shortened(context[todo], d) << 8 | place[todo]
            table, values = (levels[d].node, levels[d].one) if d >= start else (top.node, top.one)
            at, there = find(table, key)
            one[todo[there]] = values[at[there]]
            todo = todo[~there]
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total
