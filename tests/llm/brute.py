"""Plain Python versions of the operators."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def suffix_cover(docs, width):
    """Mask of removed bytes of each (doc_id, text), in order of ids."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        mask = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first.setdefault(b[i : i + width], (d, i)) != (d, i):
                mask[i : i + width] = [True] * width
        out[d] = mask
    return out


def word_cover(docs, width):
    ws = {d: words(t) for d, t in docs}
    seen = Counter(tuple(w[i : i + width]) for w in ws.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in ws.items():
        mask = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                mask[i : i + width] = [True] * width
        out[d] = (w, mask)
    return out


def shingle_sets(docs, size=5):
    out = {}
    for d, t in docs:
        w = words(t)
        out[d] = Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()
    return out


def similar(a, b, threshold=0.8):
    both = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - both
    return union > 0 and both >= threshold * union


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs):
    sets, holders = shingle_sets(docs), defaultdict(set)
    for d, s in sets.items():
        for g in s:
            holders[g].add(d)
    pairs = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}
    return components(sets, [(a, b) for a, b in pairs if similar(sets[a], sets[b])])


def quality_kept(text, stop):
    w = words(text)
    n = len(w)
    grams = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = len({j for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    if n < 10 or 100 * repeated > 20 * n:
        return False
    share = lambda test: sum(map(test, w)) / n
    symbols = len(re.findall(r"[#*$%&|<>]", text)) / n
    same = sum(a == b for a, b in zip(w, w[1:])) / n
    ok = 2.5 <= sum(map(len, w)) / n <= 10 and symbols <= 0.1 and share(lambda x: x.upper() == x and x.lower() != x) <= 0.5 and same <= 0.25
    if n >= 30:
        ok &= share(lambda x: any(c.isalpha() for c in x)) >= 0.8 and share(lambda x: x.lower() in stop) >= 0.05
    return ok and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.35
