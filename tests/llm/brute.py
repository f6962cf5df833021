"""Plain reference versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_rows(docs: dict[int, str], length: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out[d] = (len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_rows(docs: dict[int, str], length: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(docs):
        words = WORD.findall(docs[d] or "")
        mask = [False] * len(words)
        own = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
        for i, w in enumerate(own):
            if w in seen:
                mask[i : i + length] = [True] * length
        seen.update(own)
        kept = " ".join(w for w, m in zip(words, mask, strict=True) if not m)
        out[d] = (len(words), sum(mask), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text: str, k: int = 5) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_rows(docs: dict[int, str]) -> dict[int, tuple]:
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if not sets[a] or not sets[b] or 5 * min(len(sets[a]), len(sets[b])) < 4 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def quality_counts(text: str) -> tuple:
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)
