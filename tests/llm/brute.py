"""Plain-Python versions of the contracts, for small fixtures."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def substring(docs, window=50):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, sha)}."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near(docs, size, num=80, den=100):
    """docs: (doc_id, text) -> {doc_id: (n, component)}; every pair that shares a shingle is compared."""
    sets = {d: shingles(t, size) for d, t in docs}
    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    count = defaultdict(int)
    for ds in at.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                count[a, b] += 1
    for (a, b), n in count.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows(rows, size, num=80, den=100):
    """(doc_id, text) rows, ids repeated or not -> sorted (doc_id, n, component) of each row; rows with one id are one document."""
    sets = [shingles(t, size) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d) if s else d) for (d, _), s in zip(rows, sets))
