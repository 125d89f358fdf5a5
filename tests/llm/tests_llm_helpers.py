"""Brute force for the tests."""

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), data) if lower else data)


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_expected(rows, ngram=5, percent=75):
    sets, ids = [], []
    for r in rows:
        w = words(r["text"], True)
        sets.append({tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} if w else set())
        ids.append(r["doc_id"])
    union, places = Union(range(len(sets))), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            places[g].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in places[g] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                union.join(i, j)
    least = {}
    for i in range(len(sets)):
        root = union.find(i)
        least[root] = min((x for x in (least.get(root), ids[i]) if x is not None), default=None)
    return sorted(((ids[i], len(s), least[union.find(i)] if s else ids[i]) for i, s in enumerate(sets)), key=str)
