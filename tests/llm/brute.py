"""Plain restatements of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def substring(docs, length=20):
    """doc_id -> (n_words, n_removed, kept sha) for distinct, non-null doc ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(text or "")
        drop = [False] * len(w)
        for i in range(len(w) - length + 1):
            g = tuple(w[i:i + length])
            if g in seen:
                drop[i:i + length] = [True] * length
            seen.add(g)
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        out[doc_id] = (len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix(docs, length=400):
    count = defaultdict(int)
    for _, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = {}
    for doc_id, text in docs:
        b = (text or "").encode()
        drop = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                drop[i:i + length] = [True] * length
        spans = sum(1 for i, d in enumerate(drop) if d and (i == 0 or not drop[i - 1]))
        kept = bytes(x for x, d in zip(b, drop) if not d)
        out[doc_id] = (len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest())
    return out


def components(sets, num=80, den=100):
    """doc_id -> least doc_id reachable by links; ``sets``: doc_id -> shingles."""
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: root(i) for i in ids}
