"""Plain-Python versions of the operators, for small inputs."""

import re
from collections import defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text, k):
    w = words_of(text, lower=True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(rows, k, num, den):
    """{row index: (n_shingles, component)} for rows (doc_id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return [(i, len(s), find(i)) for (i, _), s in zip(rows, sets)]


def repeats(rows, k):
    """[(doc_id, n_words, n_removed, kept)]."""
    first = {}
    split = [(i, words_of(t)) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def leaks(rows, items, k, num, den):
    out = {}
    for d, t in rows:
        s = shingles(t, k)
        for i, u in items:
            q = shingles(u, k)
            if q and den * len(s & q) >= num * len(q):
                out[d, i] = max(out.get((d, i), (Fraction(0), 0, 0)), (Fraction(len(s & q), len(q)), len(s & q), len(q)))
    return {key: v[1:] for key, v in out.items()}


def top_k(vectors, queries, k):
    """vectors, queries: [(id, [int])]."""
    out = defaultdict(list)
    for q, x in queries:
        pad = lambda a, b: sum(u * v for u, v in zip(a, b))
        best = sorted(((-pad(x, y), v) for v, y in vectors if v != q))[:k]
        out[q] += [(r, v, -s) for r, (s, v) in enumerate(best, 1)]
    return dict(out)
