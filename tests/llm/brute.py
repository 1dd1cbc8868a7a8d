"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(rows, k, percent=80):
    """{doc: (set size, component)} of (doc, text) rows."""
    sets = {}
    for i, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            where[s].append(i)
    for i in sets:
        for j, n in Counter(j for s in sets[i] for j in where[s] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def kept_words(rows, window=13):
    """{doc: (words, removed, kept text)}."""
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, text in rows:
        w = words(text)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def statistics(text):
    w = words(text)
    c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
