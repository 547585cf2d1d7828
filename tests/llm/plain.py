"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[a:a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(rows):
    """rows: (key, text).  List of (key, size, component)."""
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in at[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return [(key, len(sets[i]), min((k for k in least[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def benchmark_hits(docs, items, window=10):
    found = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            found[tuple(w[a:a + window])].add(str(i))
    out = []
    for key, t in docs:
        w, hit, names = item_words(t), set(), set()
        for n in {len(x) for x in found}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in found:
                    names |= found[tuple(w[a:a + n])]
                    hit |= set(range(a, a + n))
        out.append((key, len(w), len(hit), sorted(names)))
    return out


def without_repeats(texts, length):
    """Per text: removed bytes, maximal runs, the rest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[a:a + length] for b in data for a in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if seen[b[a:a + length]] > 1:
                gone[a:a + length] = [True] * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def without_boilerplate(rows, least_sites):
    """rows: (text, site).  Per row: lines, removed lines, text."""
    sites = defaultdict(set)
    for t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None:
                sites[x.strip(" \t\n\x0b\f\r")].add(s)
    out = []
    for t, _ in rows:
        lines = [(x, x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")]
        keep = [x for x, k in lines if not k or len(sites[k]) < least_sites]
        out.append((sum(1 for _, k in lines if k), len(lines) - len(keep), None if t is None else "\n".join(keep)))
    return out
