"""Plain versions of the operators, on lists."""

import re
from collections import defaultdict

import xxhash

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, width):
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            rank = float("inf") if i is None else i
            first[key] = min(first.get(key, float("inf")), rank)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (float("inf") if i is None else i):
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprint(text):
    w = words((text or "").translate(LETTERS))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    """The component of each of n things as a list of sets of indexes."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    return [groups[root(i)] for i in range(n)]


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def private(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            n = len(re.sub("[^0-9]", "", m[0]))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= n <= 19 and luhn(m[0])):
                continue
            if kind == "phone" and not 9 <= n <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out
