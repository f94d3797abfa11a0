"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode())


def near_duplicates(docs, shingle, percent):
    sets = {}
    for d, text in docs:
        w = [x.lower() for x in words(text)]
        k = min(shingle, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    seen = set()
    for group in index.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def repeated_words(docs, length):
    first = {}
    lists = {d: words(t) for d, t in docs}
    for d, w in lists.items():
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in lists.items():
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                keep[i : i + length] = [False] * length
        kept = [x for x, k in zip(w, keep) if k]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)
