"""Plain single-process versions of the operators, to hold the results against."""

import collections
import hashlib
import re
import zlib


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(texts, window):
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(s[i:i + window]) for s in split for i in range(len(s) - window + 1))
    out = []
    for s in split:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(s), sum(gone), " ".join(x for x, g in zip(s, gone) if not g)))
    return out


def shingles(text):
    s = words(low(text))
    return {tuple(s[i:i + 5]) for i in range(len(s) - 4)} if len(s) >= 5 else {tuple(s)} if s else set()


def groups(docs):
    """{doc_id: (n_shingles, component_id)} of distinct ids."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def hits(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    phrases = collections.defaultdict(set)
    for item, text in items:
        s = split(text)
        n = min(10, len(s))
        for k in range(len(s) - n + 1 if n and item is not None else 0):
            phrases[tuple(s[k:k + n])].add(str(item))
    out = {}
    for doc, text in docs:
        s, found = split(text), set()
        hit = [0] * len(s)
        for n in {len(p) for p in phrases}:
            for k in range(len(s) - n + 1):
                if own := phrases.get(tuple(s[k:k + n])):
                    found |= own
                    hit[k:k + n] = [1] * n
        out[doc] = (len(s), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0)
    return out


def learned(doc_id, mod, but):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod != but
