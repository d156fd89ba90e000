"""Plain answers to compare the operators with."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, percent=80, size=4):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}"""
    sets = {d: shingle_set(t, size) for d, t in rows}
    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    same = defaultdict(list)
    for d, s in sets.items():
        if s:
            same[s].append(d)
    links = [(g[0], d) for g in same.values() for d in g[1:]]
    first = {g[0] for g in same.values()}
    for d in first:
        common = defaultdict(int)
        for x in sets[d]:
            for e in held[x]:
                if e > d and e in first:
                    common[e] += 1
        links += [(d, e) for e, c in common.items() if 100 * c >= percent * (len(sets[d]) + len(sets[e]) - c)]
    found = roots(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}
