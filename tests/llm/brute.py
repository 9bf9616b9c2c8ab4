"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(texts: dict, size: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable); ids must be unique and not null."""
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = [x.encode().lower().decode() for x in words(t)]
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else (
            frozenset([tuple(w)]) if w else frozenset())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def removed_words(rows: list, window: int = 20) -> list:
    """(doc_id, text) rows -> per row the set of removed word positions."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, (i, j)), (i, j))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < (i, j):
                gone.update(range(j, j + window))
        out.append(gone)
    return out


def targets(sizes: dict, weights=(5, 2, 1), times=3) -> dict:
    """source -> target by repeated resharing."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > times * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: times * sizes[s] for s in over}


def base_counts(text) -> tuple:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for j, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(j, j + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
