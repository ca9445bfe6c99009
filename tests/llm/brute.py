"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(texts, width):
    """(bytes, removed, spans, kept digest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, sha(kept)))
    return out


def shared(rows, width):
    """Bytes of each (id, text) that strings cover which also stand in another text; equal rows are one text."""
    raw = [(k, (t or "").encode()) for k, t in rows]
    holders = defaultdict(set)
    for k, b in raw:
        for i in range(len(b) - width + 1):
            holders[b[i : i + width]].add((k, b))
    out = []
    for _, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if len(holders[b[i : i + width]]) > 1:
                gone[i : i + width] = [True] * width
        out.append(sum(gone))
    return out


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near(rows, n, percent):
    """id -> (size, component) of (id, text) rows with different ids."""
    sets = {k: shingle_set(t, n) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k in sorted(sets):
        common = Counter(j for s in sets[k] for j in holders[s])
        for j, m in common.items():
            if 100 * m >= percent * (len(sets[k]) + len(sets[j]) - m):
                a, b = root(k), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(sets[k]), root(k)) for k in sets}


def crc(data: bytes) -> int:
    return zlib.crc32(data)
